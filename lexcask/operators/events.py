"""Events: validation of object and index messages, and what a batch of them comes to.

Bodies are parsed once to VARIANT, which keeps JSON's own types: a number is told
from a string, and a body that is a list or not JSON has no fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import decode_key
from ..functions.text import strip

# What an index event may do, and the kinds of object events.
OPS = ("upsert", "delete")
CREATED, REMOVED = "ObjectCreated:", "ObjectRemoved:"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v).startswith(kind), F.lit(False))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A field that is a JSON string, else null."""
    return F.when(_is(_get(v, path), "STRING"), _get(v, path, "string"))


def validate_object_events(messages: DataFrame, kind: str, bucket: str | None = None) -> DataFrame:
    """One row for each object event of each message: message_id, bucket, doc_id, event_name, reject_reason.

    The first check that fails names the reason; null means accepted.  A message
    whose body is not JSON or has no list of records gives one row.  ``bucket``
    refuses events of other buckets.
    """
    parsed = messages.select("message_id", F.try_parse_json("body").alias("v"))
    listed = F.when(_is(_get(F.col("v"), "$.Records"), "ARRAY"), _get(F.col("v"), "$.Records", "array<variant>"))
    rows = parsed.select("message_id", F.col("v").isNull().alias("bad"), listed.isNull().alias("unlisted"), F.explode_outer(F.when(listed.isNull(), F.array(F.lit(None).cast("variant"))).otherwise(listed)).alias("e"))
    rows = rows.filter("bad OR unlisted OR e IS NOT NULL")  # an empty list has no events
    e = F.col("e")
    name, key, event = _text(e, "$.s3.bucket.name"), _text(e, "$.s3.object.key"), _text(e, "$.eventName")
    checks = [
        (F.col("bad"), "invalid json body"),
        (F.col("unlisted"), "unrecognized message"),
        (~_is(e, "OBJECT"), "event is not an object"),
        (~_is(_get(e, "$.s3"), "OBJECT"), "missing s3"),
        (~_is(_get(e, "$.s3.bucket"), "OBJECT"), "missing bucket"),
        (F.coalesce(name, F.lit("")) == "", "missing bucket name"),
        (~_is(_get(e, "$.s3.object"), "OBJECT"), "missing object"),
        (F.coalesce(key, F.lit("")) == "", "missing object key"),
        (F.coalesce(event, F.lit("")) == "", "missing event name"),
        (~event.startswith(kind), "other event"),
    ]
    if bucket is not None:
        checks.append((name != bucket, "unrelated bucket"))
    reason = reduce(lambda out, c: F.when(c[0], F.lit(c[1])).otherwise(out), reversed(checks), F.lit(None).cast("string"))
    return rows.select("message_id", name.alias("bucket"), decode_key(key).alias("doc_id"), event.alias("event_name"), reason.alias("reject_reason"))


def normalize_index_events(messages: DataFrame) -> DataFrame:
    """The input (message_id, arrival_seq, body) with doc_id, op, corpus_version of valid events and whether each is valid.

    A version may be a number (cut to a whole one) or a string of digits; above 0.
    """
    v = F.try_parse_json("body")
    rows = messages.withColumn("__v", v)
    doc, op = _text(F.col("__v"), "$.doc_id"), _text(F.col("__v"), "$.op")
    version = _get(F.col("__v"), "$.corpus_version", "bigint")
    ok = (F.coalesce(strip(doc), F.lit("")) != "") & F.coalesce(op.isin(*OPS), F.lit(False)) & (F.coalesce(version, F.lit(0)) > 0)
    keep = lambda c: F.when(F.col("valid"), c)
    return rows.withColumn("valid", ok).select("message_id", "arrival_seq", keep(strip(doc)).alias("doc_id"), keep(op).alias("op"), keep(version).alias("corpus_version"), "valid")


def coalesce_events(valid: DataFrame) -> DataFrame:
    """The latest event of each document by version; of equal versions the later arrival."""
    latest = F.max_by(F.struct("op", "corpus_version", "arrival_seq"), F.struct("corpus_version", "arrival_seq"))
    return valid.groupBy("doc_id").agg(latest.alias("e")).select("doc_id", "e.op", "e.corpus_version", "e.arrival_seq")


def target_version(valid: DataFrame) -> DataFrame:
    return valid.agg(F.max("corpus_version").alias("target_version"))


def batch_failures(events: DataFrame, failed: Column) -> DataFrame:
    """itemIdentifier of the messages to deliver again: valid ones with an id, where the batch failed."""
    return events.filter(F.col("valid") & failed & (F.coalesce("message_id", F.lit("")) != "")).select(F.col("message_id").alias("itemIdentifier"))


def publishable(events: DataFrame) -> DataFrame:
    """The input (doc_id, op, corpus_version variant) with whether it may be published: a non-blank string, a known op, a non-zero whole number."""
    doc, ver = _text(F.col("payload"), "$.doc_id"), _get(F.col("payload"), "$.corpus_version")
    whole = _is(ver, "BIGINT") & (_get(F.col("payload"), "$.corpus_version", "bigint") != 0) | F.coalesce(_get(F.col("payload"), "$.corpus_version", "boolean") & _is(ver, "BOOLEAN"), F.lit(False))
    ok = (F.coalesce(strip(doc), F.lit("")) != "") & F.coalesce(_text(F.col("payload"), "$.op").isin(*OPS), F.lit(False)) & F.coalesce(whole, F.lit(False))
    return events.withColumn("publishable", ok)
