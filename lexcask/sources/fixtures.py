"""Adapters that derive the engine's record shapes from the driver's tables.

Each is one SQL text in a dialect that Spark and DuckDB share; those in BUILT are
DataFrames over whole tables, and the queries read them in place of the SQL text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EXT = "CASE {id} % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' ELSE '.html' END"

SQL = {
    "raw_objects": f"SELECT 'raws/doc-' || CAST(doc_id AS STRING) || {_EXT.format(id='doc_id')} AS key, 'corpus-bucket' AS bucket, 'doc-' || CAST(doc_id AS STRING) || ' ' || lang AS original_filename, text, n_chars FROM documents",
    "chunks": "SELECT 'raws/doc-' || CAST(doc_id AS STRING) || '.txt' AS doc_id, 1 AS chunk_ord, 'doc-' || CAST(doc_id AS STRING) || '_chunk_0001' AS chunk_id, text FROM documents",
    "change_log": f"SELECT event_id + 1 AS change_id, 'raws/doc-' || CAST(user_id AS STRING) || {_EXT.format(id='user_id')} AS doc_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'noop' ELSE 'upsert' END AS op FROM events",
    "object_events": """SELECT 'm-' || CAST(event_id AS STRING) AS message_id,
  CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 89 = 0 THEN '{"Event":"s3:TestEvent"}'
    WHEN event_id % 83 = 0 THEN '{"Records":[{"eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"corpus-bucket"},"object":{}}}]}'
    ELSE '{"Records":[{"eventName":"' || CASE event_type WHEN 'error' THEN 'ObjectRemoved:Delete' WHEN 'view' THEN 'ObjectTagging:Put' ELSE 'ObjectCreated:Put' END
      || '","s3":{"bucket":{"name":"' || CASE WHEN event_id % 11 = 0 THEN 'other-bucket' ELSE 'corpus-bucket' END || '"},"object":{"key":"raws/doc+' || CAST(user_id AS STRING) || '%28a%29.txt"}}}]}' END AS body
FROM events""",
    "index_events": """SELECT 'u-' || CAST(event_id AS STRING) AS message_id, event_id AS arrival_seq,
  CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 71 = 0 THEN '{"doc_id":"  ","op":"upsert","corpus_version":5}'
    WHEN event_id % 67 = 0 THEN '{"doc_id":"d1","op":"upsert","corpus_version":"x"}'
    ELSE '{"doc_id":" raws/doc-' || CAST(user_id AS STRING) || '.txt ","op":"' || CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'noop' ELSE 'upsert' END
      || '","corpus_version":' || CAST(event_id - event_id % 3 AS STRING) || '}' END AS body
FROM events""",
    "manifest_actions": "SELECT 'raws/doc-' || CAST(user_id AS STRING) || '.txt' AS doc_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'claim_ingest' WHEN 'purchase' THEN 'finalize_ingest' WHEN 'error' THEN 'fail_ingest' WHEN 'click' THEN 'claim_delete' ELSE 'finalize_delete' END AS action, 'req-' || CAST(event_id % 2 AS STRING) AS req_id FROM events",
    # A created and a removed event of documents, and what the manifest knows of them before.
    "created_messages": f"""SELECT 'i-' || CAST(doc_id AS STRING) AS message_id, doc_id AS arrival_seq, 0 AS attempts,
  '{{"Records":[{{"eventName":"' || CASE WHEN doc_id % 17 = 0 THEN 'ObjectTagging:Put' ELSE 'ObjectCreated:Put' END || '","s3":{{"bucket":{{"name":"corpus-bucket"}},"object":{{"key":"raws/doc-' || CAST(doc_id AS STRING) || {_EXT.format(id='doc_id')} || '"}}}}}}]}}' AS body
FROM documents""",
    "removed_messages": """SELECT 'r-' || CAST(doc_id AS STRING) AS message_id, doc_id AS arrival_seq, 0 AS attempts,
  '{"Records":[{"eventName":"ObjectRemoved:Delete","s3":{"bucket":{"name":"' || CASE WHEN doc_id % 5 = 0 THEN 'other-bucket' ELSE 'corpus-bucket' END || '"},"object":{"key":"raws/doc-' || CAST(doc_id AS STRING) || '.txt"}}}]}' AS body
FROM documents WHERE doc_id % 3 <> 0""",
    "manifest_before": f"SELECT 'raws/doc-' || CAST(doc_id AS STRING) || {_EXT.format(id='doc_id')} AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 2 = 0 THEN 'ingest failed' ELSE 'indexed' END AS status FROM documents WHERE doc_id % 3 = 0",
    "manifest_full": "SELECT 'raws/doc-' || CAST(doc_id AS STRING) || '.txt' AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 11 = 0 THEN 'ingest failed' WHEN doc_id % 13 = 0 THEN 'delete failed' ELSE 'indexed' END AS status, 'doc-' || CAST(doc_id AS STRING) || '_chunk_0001' AS chunk_id, n_chars FROM documents",
    "chat_requests": "SELECT conv_id, turn, role, text AS message FROM conversations",
    "search_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "vector_records": "SELECT 'raws/doc-' || CAST(label AS STRING) || '.txt' AS doc_id, 'doc-' || CAST(label AS STRING) || '_chunk_' || CAST(vec_id AS STRING) AS key, embedding FROM embeddings",
    # A document is indexed unless its number is divisible by 7, and its chunk is in the first or the second batch.
    "manifest": "SELECT 'raws/doc-' || CAST(doc_id AS STRING) || '.txt' AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 11 = 0 THEN 'ingest failed' ELSE 'indexed' END AS status FROM documents",
    # A change of one document for each event: every document can be reached, small numbers change more often, so some stay as they are.
    "doc_changes": """SELECT event_id + 1 AS change_id, 'raws/doc-' || CAST(CAST(floor(drawn * drawn * drawn * n) AS BIGINT) AS STRING) || '.txt' AS doc_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'noop' ELSE 'upsert' END AS op
FROM (SELECT event_id, event_type, CAST((event_id % 1000003 * (event_id % 1000003) * 7919 + event_id % 1000003 * 104729) % 1000003 AS DOUBLE) / 1000003 AS drawn FROM events),
  (SELECT coalesce(max(doc_id), 0) + 1 AS n FROM documents)""",
}
TABLES = {"documents", "events", "conversations", "benchmark", "embeddings"}


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than there are cores, dealt out: a small file is read by a single task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each document with its whole text; every third comes again with another text, and malformed rows stand between."""
    i = F.col("doc_id")
    name = F.concat(F.lit("doc-"), i.cast("string"))

    def row(content: Column) -> Column:
        ids = F.struct(F.concat(F.lit(" raws/"), name, F.lit(".txt ")).alias("doc_id"))
        return F.to_json(F.struct(F.concat(F.lit(" "), name, F.lit("_chunk_0001 ")).alias("id"), content.alias("page_content"), ids.alias("metadata")))

    bad = (
        F.when(i % 13 == 0, "{bad")
        .when(i % 11 == 0, '{"id":"c","page_content":5,"metadata":{"doc_id":"d"}}')
        .when(i % 7 == 0, '{"id":" ","page_content":"x","metadata":{"doc_id":"d"}}')
        .when(i % 5 == 0, '{"id":"c","page_content":"x","metadata":{"doc_id":" "}}')
    )
    again = F.when(i % 3 == 0, row(F.concat(F.lit("again "), F.col("text"))))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(i, F.posexplode(F.array(bad, row(F.col("text")), again)).alias("k", "row"))
    return rows.filter("row IS NOT NULL").select((i * 3 + F.col("k")).alias("row_no"), "row")


BUILT = {"snapshot_rows": _snapshot_rows}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter's rows."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    # The text holds braces of JSON, so the tables' names are replaced, not formatted.
    sql = SQL[name]
    for source in sorted(set(re.findall(r"FROM (\w+)", sql)) & TABLES):
        view = f"__lexcask_{source}"
        spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(view)
        sql = re.sub(rf"FROM {source}\b", f"FROM {view}", sql)
    return spark.sql(sql)
