"""Which column is which: names against a word list, value shapes, and area units from geometry."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from .assignment import hungarian
from .units import AREA_UNITS

FIELDS = ["khasra", "owner", "area", "land_use", "tenure", "ward", "ulpin"]
# Names of each canonical field across revenue systems.
LEXICON = {
    "khasra": ["khasra", "khsra", "khasra no", "khasra number", "survey no", "survey number", "sy no", "s no", "plot no", "plot number", "parcel id", "parcel no", "gat no", "gat", "kitta", "field no", "cts no", "hissa", "num", "id"],
    "owner": ["owner", "owner name", "khatedar", "khatadar", "khatedar name", "holder", "pattadar", "patadar", "bhogvatadar", "occupant", "name", "possessor", "raiyat", "ryot", "tenant name"],
    "area": ["area", "rakba", "rakaba", "raqba", "kshetrafal", "extent", "measurement", "area sqm", "area bigha", "acre", "hectare", "bigha", "biswa", "sq yards", "sqm", "size"],
    "land_use": ["land use", "landuse", "lu code", "lu", "luc", "use", "classification", "kism", "kisam", "nature", "category", "class"],
    "tenure": ["tenure", "tenure type", "tenancy", "patta", "patta type", "title", "right", "adhikar", "ownership type", "holding type"],
    "ward": ["ward", "ward no", "zone", "mohalla", "sector", "block", "circle", "village", "mauza", "revenue circle"],
    "ulpin": ["ulpin", "upin", "uid", "parcel uid", "bhu aadhaar", "bhuaadhaar", "unique id", "global id"],
}
LEAST, CONTAINS = 0.45, 0.92


# Shapes of a plot number, a ward code, a relation word and a record number.
SHAPES = {"khasra_like": r"^\s*\d+\s*(/\s*\d+)?\s*(-\s*\d+)?\s*$", "ward_like": r"^[A-Za-z]{0,3}[-_ ]?\d{1,3}$", "rel_marker": r"\b[swd]\s*[/.]?\s*o\b", "alpha_num_fixed": r"^[A-Za-z0-9]{10,20}$"}


def column_profile(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, rows, n, fill, unique_ratio, numeric_ratio, mean_tokens, mean_len, khasra_like, ward_like, rel_marker, alpha_num_fixed``.

    One pass: columns are unpivoted next to the scan and aggregated with
    map-side combine. Null and blank values aren't filled.
    """
    cols = columns or [c for c, k in records.dtypes if not k.startswith(("struct", "array", "map"))]
    v = F.col("v")
    long = records.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols]))).alias("column", "raw"))
    d = long.withColumn("v", F.nullif(F.trim("raw"), F.lit("")))
    avg = lambda c: F.coalesce(F.avg(F.when(v.isNotNull(), c.cast("double"))), F.lit(0.0))
    n = F.count(v)
    return d.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), n.alias("n"), (n / F.count(F.lit(1))).alias("fill"), F.when(n > 0, F.count_distinct(v) / n).otherwise(0.0).alias("unique_ratio"),
        avg(t.as_number(v).isNotNull()).alias("numeric_ratio"), avg(F.size(F.split(v, r"\s+"))).alias("mean_tokens"), avg(F.length(v)).alias("mean_len"),
        *[avg((F.lower(v) if k == "rel_marker" else v).rlike(p)).alias(k) for k, p in SHAPES.items()],
    )


def name_scores(spark, columns: list[str]) -> DataFrame:
    """``column, field, name_score, word``: best Jaro-Winkler against the word list; containment counts 0.92 at least."""
    lex = spark.createDataFrame([(f, i, w) for f, ws in LEXICON.items() for i, w in enumerate(ws)], "field string, i int, word string")
    cols = spark.createDataFrame([(c,) for c in columns], "column string").withColumn("tok", t.tokenise("column"))
    d = cols.crossJoin(F.broadcast(lex)).withColumn("s", t.jaro_winkler("tok", "word"))
    inside = (F.length("word") > 2) & (F.col("tok").contains(F.col("word")) | (F.col("word").contains(F.col("tok")) & (F.length("tok") > 2)))
    d = d.withColumn("s", F.when(inside, F.greatest("s", F.lit(CONTAINS))).otherwise(F.col("s")))
    return d.groupBy("column", "field").agg(F.max("s").alias("name_score"), F.max_by("word", F.struct("s", -F.col("i"))).alias("word"))


def profile_score(field: str) -> Column:
    u, num = F.col("unique_ratio"), F.col("numeric_ratio")
    cap = lambda c: F.least(c, F.lit(1.0))
    s = {
        "khasra": 0.55 * F.col("khasra_like") + 0.45 * cap(u * 1.2),
        "owner": 0.4 * cap(F.col("mean_tokens") / 4) + 0.3 * cap(u * 1.2) + 0.3 * cap(F.col("rel_marker") * 2),
        "area": 0.75 * num + 0.25 * cap(u * 1.2),
        "land_use": 0.8 * (1 - cap(u * 12)) + 0.2 * (1 - num),
        "tenure": 0.8 * (1 - cap(u * 12)) + 0.2 * (1 - num),
        "ward": 0.6 * F.col("ward_like") + 0.4 * (1 - cap(u * 12)),
        "ulpin": 0.6 * F.col("alpha_num_fixed") + 0.4 * cap(u * 1.1),
    }[field]
    return F.when(F.col("n") == 0, 0.0).otherwise(s)


def match_scores(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, field, name_score, profile_score, score``: half name, half value shape."""
    p = column_profile(records, columns)
    cols = columns or [c for c, k in records.dtypes if not k.startswith(("struct", "array", "map"))]
    d = name_scores(records.sparkSession, cols).join(F.broadcast(p), "column")
    ps = F.coalesce(*[F.when(F.col("field") == f, profile_score(f)) for f in FIELDS])
    return d.withColumn("profile_score", ps).withColumn("score", 0.5 * F.col("name_score") + 0.5 * F.col("profile_score")).select("column", "field", "name_score", "profile_score", "score")


def match_schema(records: DataFrame, least: float = LEAST, columns: list[str] | None = None) -> tuple[dict[str, str], list[str], DataFrame]:
    """Field to column map (one to one, best total), unmapped columns, and each field's three best columns.

    The driver sees seven scores a column, nothing that grows with the rows.
    """
    s = match_scores(records, columns)
    rows = s.collect()
    cols = sorted({r["column"] for r in rows})
    m = np.zeros((len(FIELDS), len(cols)))
    for r in rows:
        m[FIELDS.index(r["field"]), cols.index(r["column"])] = r["score"]
    got = {FIELDS[i]: cols[j] for i, j in hungarian(-m) if m[i, j] >= least}
    top = s.groupBy("field").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "column")), asc=False), 1, 3).alias("alternatives"))
    return got, [c for c in cols if c not in got.values()], top


def infer_area_unit(pairs: DataFrame, least_pairs: int = 20) -> DataFrame:
    """``unit, scale, confidence, n`` of (recorded, geometric) pairs by the median ratio; no unit under 20 pairs."""
    r = t.as_number("recorded")
    d = pairs.filter((r > 0) & (F.col("geometric") > 0)).select((F.col("geometric") / r).alias("q"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    med, spread = F.col("p")[1], F.col("p")[2] / F.greatest(F.col("p")[0], F.lit(1e-9))
    errs = F.array(*[F.struct(F.abs(F.log(med / F.lit(f))).alias("e"), F.lit(i).alias("i"), F.lit(u).alias("unit"), F.lit(f).alias("f")) for i, (u, f) in enumerate(AREA_UNITS.items())])
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    s = s.withColumn("b", F.array_min(errs))
    conf = clip(1 - F.col("b.e") / 0.35) * clip(1.5 - (spread - 1))
    ok = F.col("n") >= least_pairs
    return s.select(F.when(ok, F.col("b.unit")).alias("unit"), F.when(ok, F.col("b.f")).otherwise(1.0).alias("scale"), F.when(ok, conf).otherwise(0.0).alias("confidence"), "n")


def summary(mapping: dict[str, str], unit: str | None) -> str:
    return "; ".join(f"{f} <- {mapping.get(f, '-')}" for f in FIELDS) + (f"; area in {unit}" if unit else "")


