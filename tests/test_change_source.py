from pyspark.sql import functions as F

from lexcask.operators import changelog
from lexcask.sources import change_source, store


def changes(spark, name, n):
    return spark.createDataFrame([(f"{name}{i:03d}", "upsert" if i % 3 else "delete") for i in range(n)], "doc_id string, op string")


def test_log_is_planned_by_ranges_and_bounds_are_pushed(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/s"
    s = store.Store(spark, root, 2)
    change_source.register(spark)
    assert spark.read.format("change_log").load(root).count() == 0
    for k in range(4):
        s.append_changes(changes(spark, f"c{k}-", 10))
        s.commit(lambda now: store.Written(now, {}))  # a commit without changes
    log = change_source.Log(root)
    assert log.last_id() == 40 and [(p.low, p.high) for p in log.parts(0)] == [(1, 10), (11, 20), (21, 30), (31, 40)]
    assert [(p.low, p.high) for p in log.parts(25, 33)] == [(26, 30), (31, 33)] and log.parts(40) == []
    monkeypatch.setattr(change_source, "RANGE", 4)
    assert [(p.low, p.high) for p in log.parts(17, 22)] == [(18, 20), (21, 22)] and [(p.low, p.high) for p in log.parts(30)] == [(31, 34), (35, 38), (39, 40)]
    df = spark.read.format("change_log").load(root)
    since = changelog.changes_since(df, 25)
    assert sorted(map(tuple, since.collect())) == sorted(map(tuple, s.changes(25).collect())) and since.count() == 15
    reader = change_source.Reader(root)
    list(reader.pushFilters([change_source.GreaterThan(("change_id",), 25)]))
    assert [p.low for p in reader.partitions()][0] == 26
    assert changelog.net_changes(df).count() == 40


def test_stream_reads_each_change_once_over_restarts(spark, tmp_path):
    root = f"{tmp_path}/s"
    s = store.Store(spark, root, 2)
    change_source.register(spark)
    s.append_changes(changes(spark, "a", 5))
    read = lambda: spark.readStream.format("change_log").option("after", 2).load(root)
    for k in range(3):
        q = read().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        s.append_changes(changes(spark, f"b{k}", 4))
    got = sorted(r.change_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == list(range(3, 14))
    assert s.changes().agg(F.max("change_id")).first()[0] == 17
