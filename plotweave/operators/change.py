"""Change between two epochs and encroachment on public land, with severity and dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from .blocking import best_match, pair_overlap, prepared
from .spatial import grid_pairs

SAME, LEAST, STOREY, RISE, LEAST_ON_LAND = 0.55, 8.0, 2.6, 2.6, 5.0


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    p = grid_pairs(a.select(F.col("fid").alias("src"), "bbox"), b.select(F.col("fid").alias("tgt"), "bbox"), 60.0).select("src", "tgt")
    return pair_overlap(p, a, b).withColumn("iou", g.iou("inter", "src_area", "tgt_area"))


def detect_change(before: DataFrame, after: DataFrame, strict_compat: bool = False) -> DataFrame:
    """``kind, fid, matched_fid, delta_sqm, delta_height, storeys, confidence`` between two layers.

    Layers have fid, geom and height_m. An after-outline whose best IoU is below
    0.55 is new; a before-outline that none claims is demolished; area change
    from 8 m2 goes before a rise from 2.6 m. ``strict_compat`` also labels a loss
    of height as heightened and returns nothing if either layer is empty.
    """
    a, b = prepared(after.select("fid", "geom", "height_m")), prepared(before.select("fid", "geom", "height_m"))
    if strict_compat and (after.isEmpty() or before.isEmpty()):
        return a.select(*[F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("fid", "string"), ("matched_fid", "string"), ("delta_sqm", "double"), ("delta_height", "double"), ("storeys", "int"), ("confidence", "double"))]).limit(0)
    best = best_match(_pairs(a, b)).withColumnRenamed("src", "fid")
    d = a.select("fid", "area", "height_m").join(best, "fid", "left").join(b.select(F.col("fid").alias("tgt"), F.col("area").alias("old_area"), F.col("height_m").alias("old_height")), "tgt", "left")
    iou = F.coalesce("iou", F.lit(0.0))
    known = iou >= SAME
    da, dh = F.col("area") - F.col("old_area"), F.col("height_m") - F.col("old_height")
    tall = F.abs(dh) >= RISE if strict_compat else dh >= RISE
    kind = F.when(~known & (F.col("area") >= LEAST), "new").when(known & (da >= LEAST), "extended").when(known & (da <= -LEAST), "reduced").when(known & tall, "heightened")
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    conf = F.when(known, clip(iou, 0.5, 0.99)).otherwise(clip(1 - iou / SAME, 0.5, 0.99))
    ev = d.select(
        kind.alias("kind"), "fid", F.when(known, F.col("tgt")).alias("matched_fid"), F.when(known, da).otherwise(F.col("area")).alias("delta_sqm"), F.when(known, dh).alias("delta_height"),
        F.when(known, F.bround(dh / STOREY).cast("int")).alias("storeys"), conf.alias("confidence"),
    ).filter("kind is not null")
    claimed = best.filter(F.col("iou") >= SAME).select(F.col("tgt").alias("fid")).distinct()
    gone = b.filter(F.col("area") >= LEAST).join(claimed, "fid", "left_anti")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return ev.unionByName(gone.select(F.lit("demolished").alias("kind"), "fid", none("string", "matched_fid"), (-F.col("area")).alias("delta_sqm"), none("double", "delta_height"), none("int", "storeys"), F.lit(0.85).alias("confidence")))


def severity(share: Column) -> Column:
    """Of the share of a structure on public land."""
    return F.when(share > 0.6, "severe").when(share > 0.2, "significant").otherwise("minor")


def detect_encroachment(buildings: DataFrame, govt: DataFrame, least: float = LEAST_ON_LAND) -> DataFrame:
    """``fid, govt_fid, area, share, severity`` of buildings that overlap public land by ``least`` or more."""
    a, b = prepared(buildings.select("fid", "geom")), prepared(govt.select("fid", "geom"))
    p = _pairs(a, b).filter(F.col("inter") >= least)
    share = F.when(F.col("src_area") > 0, F.col("inter") / F.col("src_area")).otherwise(0.0)
    return p.select(F.col("src").alias("fid"), F.col("tgt").alias("govt_fid"), F.col("inter").alias("area"), share.alias("share"), severity(share).alias("severity"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_sqm").alias("sqm"))


def dossiers(events: DataFrame, parcels: DataFrame | None = None, key: str = "parcel_fid") -> DataFrame:
    """``fid, dossier``: JSON of each event with its evidence, and its parcel if one is given."""
    body = {"event": F.struct(*[c for c in events.columns])}
    d = events
    if parcels is not None:
        d = events.join(parcels.select(F.col("fid").alias(key), F.struct(*[c for c in parcels.columns if c not in ("geom",)]).alias("parcel")), key, "left")
        body["parcel"] = F.col("parcel")
    return d.select("fid", F.to_json(F.struct(*[v.alias(k) for k, v in body.items()])).alias("dossier"))


def summary_lines(events: DataFrame, encroachments: DataFrame) -> DataFrame:
    """One text line a kind and one for the encroached area."""
    e = event_counts(events).select(F.format_string("%s: %d structures, %.1f sqm", "kind", "n", "sqm").alias("line"))
    x = encroachments.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("a")).select(F.format_string("encroachment: %d sites, %.1f sqm", "n", "a").alias("line"))
    return e.unionByName(x)


def listed(events: DataFrame, by: str) -> DataFrame:
    """Events by the size of a change, encroachments by their area: largest first, ties by fid."""
    return events.orderBy(F.desc(F.abs(F.col(by))), "fid")
