"""Whole-layer operators: map, filter, lookup, rename, ids, alignment pairs, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..common import global_rank
from ..functions import crs, geometry as g


def map_geometry(layer: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return layer.withColumn("geom", fn(F.col("geom")))


def filter_layer(layer: DataFrame, predicate: Column) -> DataFrame:
    return layer.filter(predicate)


def total_area(layer: DataFrame) -> DataFrame:
    return layer.agg(F.sum(g.edges_area(g.edges("geom"))).alias("total_area"))


def by_id(layer: DataFrame, pos: str = "pos") -> DataFrame:
    """One row a fid, the last by pos: what a lookup table would hold."""
    return layer.groupBy("fid").agg(F.max_by(F.struct(*[c for c in layer.columns if c != "fid"]), pos).alias("r")).select("fid", "r.*")


def lookup(layer: DataFrame, fid: str) -> DataFrame:
    return layer.filter(F.col("fid") == fid)


def rename(layer: DataFrame, names: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns by an alias map; those without one in upper case, dropped ones gone."""
    keep = ("fid", "geom")
    return layer.select(*[F.col(c).alias(c if c in keep else names.get(c, c.upper())) for c in layer.columns if c not in drop])


def semantic(layer: DataFrame, fields: dict[str, str], wanted: tuple[str, ...]) -> DataFrame:
    """Columns under their field names; null where a field isn't mapped."""
    return layer.select("fid", *[(F.col(fields[f]) if f in fields else F.lit(None).cast("string")).alias(f) for f in wanted])


def to_lonlat(layer: DataFrame, zone: int = 44) -> DataFrame:
    """Layer in degrees, the largest part of each geometry only."""
    size = lambda p: g.edges_area(g.edges(F.struct(F.lit("Polygon").alias("kind"), F.array(p).alias("parts"))))
    best = F.reduce(F.col("geom.parts"), F.struct(F.lit(-1.0).alias("a"), F.element_at("geom.parts", 1).alias("p")), lambda s, p: F.when(size(p) > s.getField("a"), F.struct(size(p).alias("a"), p.alias("p"))).otherwise(s)).getField("p")
    one = layer.withColumn("geom", F.when(F.size("geom.parts") > 0, F.struct(F.lit("Polygon").alias("kind"), F.array(best).alias("parts"))))
    point = lambda x, y: crs.utm_to_geodetic(x, y, F.lit(zone))
    return one.withColumn("geom", g.map_points("geom", lambda x, y: point(x, y)[0], lambda x, y: point(x, y)[1]))


def numbered(layer: DataFrame, order: list, prefix: str, width: int = 4, name: str = "id") -> DataFrame:
    """Ids by rank in an order."""
    return global_rank(layer, order, "__k").withColumn(name, F.format_string(f"{prefix}%0{width}d", "__k")).drop("__k")


def extent(layer: DataFrame) -> DataFrame:
    b = layer.select(g.edges_bbox(g.edges("geom")).alias("b"))
    return b.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def trimmed_rmse(pairs: DataFrame, residual: str = "residual", q: float = 0.99) -> DataFrame:
    """Root mean square of residuals strictly below a quantile."""
    lim = pairs.agg(F.percentile(residual, q).alias("lim"))
    d = pairs.crossJoin(F.broadcast(lim)).filter(F.col(residual) < F.col("lim"))
    return d.agg(F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Each row's share of the sum; the sum is an aggregate, not a global window."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("__t")))).withColumn("share", F.col(value) / F.col("__t")).drop("__t")
