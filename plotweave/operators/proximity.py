"""Points near other points or inside regions, and outlines standing on regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..common import clean_fid, finished
from ..functions import crs, geometry as g, kernel
from .snapshots import identified
from .spatial import near_pairs, points_in_regions, region_overlaps

REACH = 25.0
LEAST_ENCROACHMENT = 5.0
ZONE = 44


def real_position(x="x", y="y", lon="lon", lat="lat", zone: int = ZONE) -> tuple[Column, Column]:
    """Easting and northing of a point recorded in either system, or null.

    A pair in metres or degrees counts if it is plausible for the zone: easting
    100 km to 900 km and northing up to 10,000 km; longitude within four degrees
    of the central meridian and latitude up to 84. The other order is put
    right; zeros, -9999 and other stand-ins are no position. Metres go first.
    """
    x, y, lon, lat = F.col(x), F.col(y), F.col(lon), F.col(lat)
    e_ok = lambda v: v.between(100_000.0, 900_000.0)
    n_ok = lambda v: (v > 900_000.0) & (v <= 10_000_000.0)
    mid = 6 * zone - 183
    lon_ok = lambda v: v.between(mid - 4.0, mid + 4.0)
    lat_ok = lambda v: v.between(-84.0, 84.0) & (F.abs(v) > 1e-6) & ~lon_ok(v)
    metres = F.when(e_ok(x) & n_ok(y), F.struct(x.alias("x"), y.alias("y"))).when(e_ok(y) & n_ok(x), F.struct(y.alias("x"), x.alias("y")))
    degrees = F.when(lon_ok(lon) & lat_ok(lat), F.struct(lon.alias("lon"), lat.alias("lat"))).when(lon_ok(lat) & lat_ok(lon), F.struct(lat.alias("lon"), lon.alias("lat")))

    def forward(d: Column) -> Column:
        east, north = crs.geodetic_to_utm(d.getField("lon"), d.getField("lat"), F.lit(zone))
        return F.struct(east.alias("x"), north.alias("y"))

    pos = F.coalesce(metres, F.when(degrees.isNotNull(), g.let(degrees, forward)))
    return pos.getField("x"), pos.getField("y")


def survey_positions(points: DataFrame) -> DataFrame:
    """Distinct ``fid, x, y`` of points with a real position."""
    x, y = real_position()
    return points.select(clean_fid("fid").alias("fid"), x.alias("x"), y.alias("y")).filter("fid is not null and x is not null and y is not null").distinct()


def regions(layer: DataFrame) -> DataFrame:
    """One geometry a clean fid; of several the smallest, so repeated rows collapse."""
    return layer.select(clean_fid("fid").alias("fid"), "geom").filter("fid is not null and geom is not null").groupBy("fid").agg(F.min("geom").alias("geom"))


def encroachments(buildings: DataFrame, govt: DataFrame, least_area: float = LEAST_ENCROACHMENT) -> DataFrame:
    """``fid, epoch, region, area``: current outlines that overlap public land by ``least_area`` or more.

    Every delivered outline is tested, as few come near public land; only the
    hits are then held against the narrow list of each fid's current delivery.
    """
    rows = identified(buildings)
    o = rows.withColumn("o", kernel.outline("geom")).select("fid", "epoch", F.col("turn.loaded_at").alias("at"), F.col("turn.h").alias("h"), "o.pack", "o.bbox")
    hits = region_overlaps(o, regions(govt), ["fid", "epoch", "at", "h"], least_area)
    now = rows.groupBy("fid", "epoch").agg(F.max("turn").alias("t")).select("fid", "epoch", F.col("t.loaded_at").alias("now"), F.col("t.h").alias("h"))
    return now.join(hits, ["fid", "epoch", "h"]).filter(F.col("at").eqNullSafe(F.col("now"))).select("fid", "epoch", "region", "area")


@finished
def relations(points: DataFrame, parcels: DataFrame, govt: DataFrame, buildings: DataFrame) -> DataFrame:
    """``relation, fid_a, fid_b`` of all four relations, each row once, fid_a < fid_b."""
    pos = survey_positions(points)
    ordered = lambda df, name, a, b: df.select(F.lit(name).alias("relation"), F.least(a, b).alias("fid_a"), F.greatest(a, b).alias("fid_b"))
    return (
        ordered(near_pairs(pos, REACH), "near", "fid_a", "fid_b")
        .unionByName(ordered(points_in_regions(pos, regions(parcels)), "inside_parcel", "fid", "region"))
        .unionByName(ordered(points_in_regions(pos, regions(govt)), "inside_govt", "fid", "region"))
        .unionByName(ordered(encroachments(buildings, govt), "encroaches", "fid", "region").distinct())
    )
