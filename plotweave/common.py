"""Session plumbing shared by all operators: lineage cuts, salts, broadcasts."""

from __future__ import annotations

import atexit
import contextvars
import functools
import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

#: A side is broadcast only if its measured size stays under this many rows.
BROADCAST_ROWS = 50_000
#: Rows of one key that a single task may hold before the key is split by salts.
HOT_ROWS = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine (tests, a laptop) that names none gets a folder of
    its own; on a cluster a missing name is an error, as no other folder is
    known to be shared.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plotweave-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write into the shared checkpoint folder and read back: no lineage, columns pruned, sizes known.

    The files are as safe as the shared file system, so a lost executor costs
    nothing. They stay until ``uncut`` or the end of the Python process.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/plotweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    if (call := _call.get()) is not None:
        call.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plotweave_path = path
    return out


_written: dict[str, SparkSession] = {}
#: What the running operator wrote; each thread and each nested operator has a list of its own.
_call: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("plotweave_call", default=None)


def uncut(*dfs: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing will read it again."""
    for df in dfs:
        path = getattr(df, "_plotweave_path", None)
        if path:
            _remove(path, _written.pop(path, None))


def finished(operator):
    """Write an operator's result, then delete all that it wrote on its way.

    For operators whose plan reads intermediate tables: without it they would
    stay until the process ends. The result itself stays until then, or until
    ``uncut``.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        mine: list[str] = []
        outer = _call.set(mine)
        kept = None
        try:
            out = operator(*args, **kwargs)
            kept = cut(out) if mine else out
        finally:
            _call.reset(outer)
            result = getattr(kept, "_plotweave_path", None)
            for path in mine:
                if path != result and path in _written:
                    _remove(path, _written.pop(path))
        if result and (call := _call.get()) is not None:
            call.append(result)
        return kept

    return run


def _remove(path: str, spark: SparkSession | None) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001, S110 - the session is gone, or the folder is
        pass


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _remove(path, spark)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; beyond ``limit`` rows the join shuffles.

    The count stops at ``limit`` + 1 rows, so it never scans a large side whole.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``rows`` rows, with the number of salts each needs.

    The aggregation is map-side combined; at most count/rows keys come out.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > rows)
        .select(*keys, F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias("__salts"))
    )


def salted_pair(many: DataFrame, other: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread hot keys of ``many`` over salts and repeat ``other`` for each of them.

    Every row of ``many`` keeps exactly one salt, so an equi-join on the
    returned keys gives the same pairs as one on ``keys``. Nothing is dropped.
    Without hot keys, which one narrow count tells, both come back as they are.
    """
    hot = cut(hot_keys(many, keys, rows))
    if hot.isEmpty():
        uncut(hot)
        return many, other, keys
    hot = broadcast_if_small(hot)
    a = many.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("__salts")).cast("int"))
    )
    b = other.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
    return a.drop("__salts"), b.drop("__salts"), [*keys, "__salt"]


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """Rows with ``__part`` and ``__pos``: their range of the order, and their place in it.

    Ranges are sorted apart, so no task sees all rows; the table is written,
    since ranges come from a sample that another run might not repeat.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return cut(d.withColumn("__part", F.shiftright("__id", 33)).withColumn("__pos", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"))


def offsets(ranges: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``__part`` and, for each name, the sum over all ranges before it: one row a range."""
    per = ranges.groupBy("__part").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return per.select("__part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rows with their number from 1 in a total order, without one task that sees them all."""
    d = in_ranges(df, order)
    before = offsets(d, {"__n": F.lit(1).cast("long")})
    return d.join(F.broadcast(before), "__part").withColumn(name, F.col("__pos") + F.col("__n") + 1).drop("__part", "__pos", "__n")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums along a total order, the row itself included, range by range."""
    d = in_ranges(df, order)
    before = offsets(d, {f"__{k}": v for k, v in sums.items()})
    w = W.partitionBy("__part").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({k: F.sum(v).over(w) for k, v in sums.items()}).join(F.broadcast(before), "__part")
    return d.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", "__pos", *[f"__{k}" for k in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Repartition a narrow scan so that heavy per-row work uses all cores.

    Small files arrive as a handful of splits however costly a row is; the
    exchange is round-robin, so no key can make it uneven.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n * factor)


def ceil_log2(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the smallest by all remaining sortable columns: repeated rows collapse."""
    rest = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


DEVANAGARI_DIGITS = "०१२३४५६७८९"


def clean_fid(c) -> F.Column:
    """Clean form of a fid: its letters and digits, the prefix in its own case.

    Case, white space, dashes and invisible characters don't count; ``govt_``
    is lower case, other prefixes are upper. Null, or nothing left: null.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.upper(F.regexp_replace(F.translate(c, DEVANAGARI_DIGITS, "0123456789"), "[^A-Za-z0-9_]", ""))
    return F.nullif(F.regexp_replace(s, "^GOVT_?", "govt_"), F.lit(""))


GEOM = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))),
    ]
)
