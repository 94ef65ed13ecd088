"""A corpus on shared storage: tables replaced bucket by bucket, a change log, one commit for all of them.

A batch writes new files for the buckets it touches into folders of its own and then one
commit file, numbered one above the last, that names the folder of every bucket of every
table.  Readers follow the newest commit, so they see all of a batch or nothing; files of
untouched buckets stay as they are, and what a crash leaves behind no commit names.

A commit file is created only if it is absent.  A writer that comes second reads the log
again: if the other one touched none of its buckets it commits on top, with change ids
after the other's, else its batch is done anew; after three attempts that is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog
from . import commits

#: Fixed value: attempts to allocate change ids.
ATTEMPTS = 3
BUCKETS = 64
#: Format and columns of each table.
TABLES = {
    "manifest": ("parquet", "doc_id string, bucket_name string, status string, req_id string, vector_keys array<string>, error_message string"),
    "chunks": ("json", "doc_id string, chunk_id string, chunk_ord int, text string"),
    "vectors": ("parquet", "doc_id string, key string, batch_no bigint, embedding array<float>"),
}
CHANGES = "ordinal bigint, doc_id string, op string"



@dataclass(frozen=True)
class State:
    """What a commit says: each table's folders by bucket, each stream's last batch and its commit, the next change id; and its own changes."""

    number: int = 0
    buckets: int = BUCKETS
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    streams: dict[str, list[int]] = field(default_factory=dict)
    next_id: int = 1
    changes: dict | None = None


@dataclass(frozen=True)
class Written:
    """A batch's new folders by table and bucket (None: the bucket is empty now), and its changes' folder and number."""

    base: State
    tables: dict[str, dict[str, str | None]]
    changes: str | None = None
    n_changes: int = 0


class Store:
    """One corpus below ``root``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._log = f"{self.root}/commits"

    def bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def state(self, number: int | None = None) -> State:
        """The newest commit, or an earlier one."""
        entry = commits.newest(self.spark, self._log) if number is None else commits.read(self.spark, self._log, number)
        out = State(**entry) if entry else State(buckets=self.buckets)
        if out.buckets != self.buckets:
            raise ValueError(f"the store has {out.buckets} buckets, not {self.buckets}")
        return out

    def folder(self, what: str) -> str:
        """A new folder; nothing reads it before a commit names it."""
        return f"{self.root}/{what}/{commits.unique()}"

    def read(self, table: str, state: State | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table's rows as of a commit (the newest), of all buckets or some: only their folders are listed."""
        kind, columns = TABLES[table]
        at = (state or self.state()).tables.get(table, {})
        paths = [f"{at[b]}/bucket={b}" for b in (sorted(at) if buckets is None else map(str, sorted(buckets))) if b in at]
        if not paths:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).format(kind).load(paths)

    def written_by(self, table: str, state: State) -> DataFrame:
        """The rows of the buckets that a commit replaced."""
        before = self.state(state.number - 1).tables.get(table, {}) if state.number > 1 else {}
        return self.read(table, state, [int(b) for b, f in state.tables.get(table, {}).items() if before.get(b) != f])

    def changes_of(self, state: State) -> DataFrame:
        """change_id, doc_id, op of one commit."""
        own = state.changes
        if not own:
            return self.spark.createDataFrame([], "change_id bigint, doc_id string, op string")
        return self.spark.read.schema(CHANGES).parquet(own["folder"]).select((F.col("ordinal") + own["first"]).alias("change_id"), "doc_id", "op")

    def replace(self, table: str, base: State, gone: DataFrame, new: DataFrame | None = None, on: str = "doc_id") -> dict[str, str | None]:
        """New files for the touched buckets, without the rows of ``gone`` (doc_id, and ``on`` if that is another column) and with the new rows.

        The buckets are those of gone and new rows' documents: at most as many numbers as there are buckets come to the driver.
        """
        docs = gone.select("doc_id") if new is None else gone.select("doc_id").unionByName(new.select("doc_id"))
        touched = [r[0] for r in docs.select(self.bucket(F.col("doc_id"))).distinct().collect()]
        kept = self.read(table, base, touched).join(gone.select(on).distinct(), on, "left_anti")
        rows = kept if new is None else kept.unionByName(new.select(kept.columns))
        kind, columns = TABLES[table]
        folder = self.folder(table)
        # The exchange splits a large bucket into several files and joins small ones.
        dealt = rows.select([c.split(" ")[0] for c in columns.split(", ")]).withColumn("bucket", self.bucket(F.col("doc_id"))).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").format(kind).save(folder)
        there = set(commits.names_in(self.spark, folder))
        return {str(b): folder if f"bucket={b}" in there else None for b in touched}

    def write_changes(self, changes: DataFrame, order: str = "doc_id") -> tuple[str, int]:
        """Changes (doc_id, op) with their places in the given order; their ids are known when they are committed."""
        folder = self.folder("changes")
        none = self.spark.createDataFrame([], "change_id bigint, doc_id string, op string")
        changelog.append(none, changes, order).select((F.col("change_id") - 1).alias("ordinal"), "doc_id", "op").write.parquet(folder)
        return folder, self.spark.read.schema(CHANGES).parquet(folder).count()

    def done(self, stream: str, batch_id: int, state: State | None = None) -> bool:
        return (state or self.state()).streams.get(stream, [-1])[0] >= batch_id

    def commit(self, write: Callable[[State], Written], stream: str | None = None, batch_id: int = 0, attempts: int = ATTEMPTS) -> State:
        """Runs ``write`` on the newest state and commits what it wrote, on top of what other writers commit meanwhile.

        A batch of a stream that is in the log already changes nothing.
        """
        written = None
        for _ in range(attempts):
            now = self.state()
            if stream is not None and self.done(stream, batch_id, now):
                return now
            if written is None or any(now.tables.get(t, {}).get(b) != written.base.tables.get(t, {}).get(b) for t, at in written.tables.items() for b in at):
                written = write(now)
                if written.base.number != now.number:
                    raise ValueError("the batch was written on another state")
            tables = {t: dict(at) for t, at in now.tables.items()}
            for t, at in written.tables.items():
                tables[t] = {b: f for b, f in (tables.get(t, {}) | at).items() if f is not None}
            new = replace(
                now,
                number=now.number + 1,
                tables=tables,
                streams=now.streams | ({stream: [batch_id, now.number + 1]} if stream is not None else {}),
                next_id=now.next_id + written.n_changes,
                changes={"folder": written.changes, "first": now.next_id, "n": written.n_changes} if written.n_changes else None,
            )
            if commits.create(self.spark, self._log, new.number, asdict(new)):
                return new
        raise RuntimeError(f"no change ids allocated in {attempts} attempts")

    def append_changes(self, changes: DataFrame, order: str = "doc_id", attempts: int = ATTEMPTS) -> State:
        """Changes alone: written once, their ids follow whatever other writers commit first."""
        return self.commit(lambda now: Written(now, {}, *self.write_changes(changes, order)), attempts=attempts)

    def changes(self, cursor: int = 0, state: State | None = None) -> DataFrame:
        """change_id, doc_id, op after a cursor: only files of commits that reach beyond it are read."""
        schema = "number bigint, changes struct<folder: string, first: bigint, n: bigint>"
        if not commits.names_in(self.spark, self._log):
            return self.spark.createDataFrame([], "change_id bigint, doc_id string, op string")
        entries = self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(self._log).select("number", "changes.*").filter(F.col("first") + F.col("n") - 1 > cursor)
        if state is not None:
            entries = entries.filter(F.col("number") <= state.number)
        # One name for each commit after the cursor.
        named = entries.select("folder", "first").collect()
        if not named:
            return self.spark.createDataFrame([], "change_id bigint, doc_id string, op string")
        rows = self.spark.read.schema(CHANGES).parquet(*[r["folder"] for r in named]).withColumn("folder", F.regexp_extract(F.input_file_name(), "changes/([0-9a-f]{32})/", 1))
        first = self.spark.createDataFrame([(r["folder"].rsplit("/", 1)[1], r["first"]) for r in named], "folder string, first bigint")
        return rows.join(F.broadcast(first), "folder").select((F.col("first") + F.col("ordinal")).alias("change_id"), "doc_id", "op").filter(F.col("change_id") > cursor)

    def sweep(self) -> int:
        """Removes folders that the newest commit does not name and that no commit's changes lie in; for times without writers."""
        fs, _ = commits.filesystem(self.spark, self.root)
        now = self.state()
        named = {f.rsplit("/", 1)[1] for at in now.tables.values() for f in at.values()}
        gone = 0
        for what in TABLES:
            for name in commits.names_in(self.spark, f"{self.root}/{what}"):
                if name not in named:
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}/{name}"), True)
                    gone += 1
        return gone
