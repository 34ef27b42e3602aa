"""Tamper-evident log: canonical JSON, SHA-256 chain, verification, and what tampering would show."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window as W

from ..common import in_ranges

GENESIS = "0" * 64
FIELDS = ["seq", "ts", "actor", "role", "action", "target", "reason", "before", "after", "prev_hash"]
SCHEMA = T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(f, T.StringType()) for f in (*FIELDS[1:], "hash")]])


def canonical(obj) -> str:
    """JSON with sorted keys and no blanks, non-ASCII escaped."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), default=str)


def payload(row: dict) -> dict:
    """What the hash covers; before and after are kept as JSON text in the table."""
    out = {k: row.get(k) for k in FIELDS}
    for k in ("before", "after"):
        out[k] = json.loads(out[k]) if out[k] is not None else None
    return out


def entry_hash(row: dict) -> str:
    return hashlib.sha256(canonical(payload(row)).encode()).hexdigest()


@F.arrow_udf(T.StringType())
def content_hash(r: pa.Array) -> pa.Array:
    """Hash of each entry's fields; the canonical form needs Python's number and escape rules."""
    return pa.array([entry_hash(x) for x in r.to_pylist()], pa.string())


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSONL log; before and after stay JSON."""
    rows = spark.read.text(path).select(F.from_json("value", "map<string,variant>").alias("m")).filter("m is not null")
    text = lambda f: F.expr(f"cast(m['{f}'] as string)").alias(f)
    js = lambda f: F.expr(f"case when m['{f}'] is null or is_variant_null(m['{f}']) then null else to_json(m['{f}']) end").alias(f)
    return rows.select(F.expr("cast(m['seq'] as bigint)").alias("seq"), *[js(f) if f in ("before", "after") else text(f) for f in (*FIELDS[1:], "hash")])


def chain(entries: list[dict], prev: str = GENESIS, seq: int = 0) -> list[dict]:
    """Number and link new entries after a head; a single writer appends what it returns."""
    out = []
    for e in entries:
        seq += 1
        row = {"reason": "", "before": None, "after": None, **e, "seq": seq, "prev_hash": prev}
        row["before"], row["after"] = (None if row[k] is None else canonical(row[k]) for k in ("before", "after"))
        prev = row["hash"] = entry_hash(row)
        out.append(row)
    return out


def build_chain(events: DataFrame, order: str, text: str, seed: str = GENESIS) -> DataFrame:
    """``order, hash`` of a chain over rows: each hash covers the one before it and the row's text.

    A chain is one sequence by nature; it runs as a fold over the ordered rows in
    one task, streaming, and only for the log itself.
    """
    rows = events.select(order, text).repartitionByRange(1, order).sortWithinPartitions(order)

    def run(batches):
        prev = seed
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                prev = hashlib.sha256((prev + (t or "")).encode()).hexdigest()
                out.append(prev)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[order, "hash"])

    return rows.mapInArrow(run, T.StructType([events.schema[order], T.StructField("hash", T.StringType())]))


def checked(log: DataFrame) -> DataFrame:
    """Each entry with ``link_ok`` and ``content_ok``; ranges of the log are checked apart, and only their first links look back."""
    h = in_ranges(log.withColumn("computed", content_hash(F.struct(*FIELDS))), ["seq"])
    ends = h.groupBy("__part").agg(F.max_by("hash", "__pos").alias("end"))
    before = ends.select("__part", F.lag("end", 1, GENESIS).over(W.orderBy("__part")).alias("end"))
    h = h.join(F.broadcast(before), "__part").withColumn("expected", F.coalesce(F.lag("hash").over(W.partitionBy("__part").orderBy("__pos")), "end"))
    h = h.withColumn("link_ok", F.col("prev_hash") == F.col("expected")).withColumn("content_ok", F.col("computed") == F.col("hash"))
    return h.drop("__part", "__pos", "end")


def verify(log: DataFrame) -> DataFrame:
    """One row ``intact, broken_at, kind, verified, total, head``; a link break is told before a content break."""
    c = checked(log)
    bad = F.struct("seq", F.when(~F.col("link_ok"), "link").otherwise("content").alias("kind"))
    broken = F.coalesce(~F.col("link_ok") | ~F.col("content_ok"), F.lit(True))
    d = c.agg(F.min(F.when(broken, bad)).alias("b"), F.count(F.lit(1)).alias("total"), F.max_by("hash", "seq").alias("head"))
    intact = F.col("b").isNull()
    return d.select(
        intact.alias("intact"), F.col("b.seq").alias("broken_at"), F.col("b.kind").alias("kind"), F.coalesce(F.col("b.seq") - 1, F.col("total")).alias("verified"), "total",
        F.when(intact, F.coalesce("head", F.lit(GENESIS))).alias("head"),
    )


def tampered(log: DataFrame, seq: int, field: str, value) -> DataFrame:
    """The log with one field changed, for showing what verification says; the log itself stays."""
    return log.withColumn(field, F.when(F.col("seq") == seq, F.lit(value)).otherwise(F.col(field)))


def last_entries(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n).orderBy("seq")
