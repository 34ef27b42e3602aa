"""Topology of a polygon layer: diagnosis and repair with an account of every square metre."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import GEOM, cut, spread
from ..functions import geometry as g, kernel, overlay as o
from .blocking import pair_overlap, prepared
from .graph import components
from .spatial import cells, grid_pairs

SNAP, MAX_GAP, LEAST_OVERLAP, LEAST_HOLE, SLIVER = 0.60, 60.0, 1e-6, 0.05, 0.18


@F.arrow_udf(GEOM)
def make_valid(geom: pa.Array) -> pa.Array:
    """Even-odd repair, the largest part kept; null and empty geometries come back null."""
    return pa.array([o.to_geom(o.largest(x)) for x in o.repair_all([o.to_parts(x) for x in geom.to_pylist()])], type=geom.type)


@F.arrow_udf(T.BooleanType())
def is_simple(geom: pa.Array) -> pa.Array:
    """True if no edges cross: the even-odd area equals the absolute area of the rings."""
    parts = [o.to_parts(x) for x in geom.to_pylist()]
    return pa.array([bool(p) and abs(o.area(r) - o.area(p)) < 1e-6 * max(1.0, o.area(p)) for p, r in zip(parts, o.repair_all(parts), strict=True)], pa.bool_())


def overlap_pairs(layer: DataFrame) -> DataFrame:
    """``a, b, area`` of pairs of features that share more than LEAST_OVERLAP; a < b."""
    p = prepared(layer.select("fid", "geom"))
    left = p.select(F.col("fid").alias("src"), "bbox")
    right = p.select(F.col("fid").alias("tgt"), "bbox")
    pairs = grid_pairs(left, right, 60.0).filter("src < tgt").select("src", "tgt")
    return pair_overlap(pairs, p, p).filter(F.col("inter") > LEAST_OVERLAP).select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("inter").alias("area"))


def touching(layer: DataFrame, reach: float = 0.05) -> DataFrame:
    """``fid, comp``: groups of features whose boxes meet within ``reach``: no gap or overlap crosses groups."""
    p = prepared(layer.select("fid", "geom")).select("fid", "bbox")
    pairs = grid_pairs(p.select(F.col("fid").alias("a"), "bbox"), p.select(F.col("fid").alias("b"), "bbox"), 60.0, reach).filter("a < b").select("a", "b")
    return components(pairs, p.select("fid")).select(F.col("node").alias("fid"), "comp")


def diagnose(layer: DataFrame) -> DataFrame:
    """One row: features, invalid, overlaps, overlap_area, holes, hole_area, slivers, summed area.

    Holes are those of the union of features that touch.
    """
    m = g.measured(spread(layer.select("fid", "geom")), "geom").withColumn("simple", is_simple("geom"))
    thin = g.compactness("area", "perimeter") < SLIVER
    a = m.agg(F.count(F.lit(1)).alias("features"), F.sum((~F.col("simple")).cast("int")).alias("invalid"), F.sum(thin.cast("int")).alias("slivers"), F.sum("area").alias("summed_area"))
    v = overlap_pairs(layer).agg(F.count(F.lit(1)).alias("overlaps"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("overlap_area"))
    h = union_footprints(layer).agg(F.coalesce(F.sum("holes"), F.lit(0)).alias("holes"), F.coalesce(F.sum("hole_area"), F.lit(0.0)).alias("hole_area"), F.sum("area").alias("footprint"))
    return a.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(h))


def union_footprints(layer: DataFrame) -> DataFrame:
    """``comp, area, holes, hole_area`` of the union of each group of touching features."""
    d = layer.select("fid", "geom").join(touching(layer), "fid")

    def run(p: dict) -> list[tuple]:
        u = o.union_all([r for _, r in sorted(zip(p["fid"], p["geom"], strict=True), key=lambda k: k[0])])
        hs = o.holes_of(u, LEAST_HOLE)
        return [(p["comp"][0], o.area(u), len(hs), float(sum(abs(o.ring_area(h)) for h in hs)))]

    return _by_group(d, ["comp"], run, "comp string, area double, holes long, hole_area double", ("geom",))


def dissolve(layer: DataFrame, key: str) -> DataFrame:
    """``key, geom`` of the union of each key's features."""
    kind = layer.schema[key].dataType

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [p[key].iat[0]], "geom": [o.to_geom(o.union_all([o.repair(o.to_parts(x)) for x in p["geom"]]))]})

    return layer.select(key, "geom").groupBy(key).applyInPandas(run, T.StructType([T.StructField(key, kind), T.StructField("geom", GEOM)]))


def snap_vertices(layer: DataFrame, tol: float = SNAP) -> DataFrame:
    """Layer whose vertices within ``tol`` of each other, directly or by chains, moved to their mean.

    Vertices are joined by grid cell, clustered by components, averaged, and the
    rings rebuilt without repeats; a ring that falls under three points keeps
    its old form.
    """
    v = layer.select("fid", F.posexplode("geom.parts").alias("p", "part")).select("fid", "p", F.posexplode("part").alias("r", "ring")).select("fid", "p", "r", F.posexplode("ring").alias("k", "v"))
    v = v.filter("v.x is not null and v.y is not null").select("fid", "p", "r", "k", "v.x", "v.y")
    spots = cut(v.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))))
    cell = lambda c: F.floor(F.col(c) / tol)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = spots.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("i"), cell("y").alias("j"))
    b = spots.withColumn("s", steps).select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (cell("x") + F.col("s.i")).alias("i"), (cell("y") + F.col("s.j")).alias("j"))
    near = a.join(b, ["i", "j"]).filter((F.col("a") < F.col("b")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= tol)).select("a", "b")
    cl = cut(spots.join(components(near, spots.select("id")).withColumnRenamed("node", "id"), "id"))
    mean = cl.groupBy("comp").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my"))
    moved = v.join(cl.join(mean, "comp").select("x", "y", "mx", "my"), ["x", "y"])
    pt = F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("mx").alias("x"), F.col("my").alias("y")))), lambda s: F.struct(s.getField("x").alias("x"), s.getField("y").alias("y")))
    rings = moved.groupBy("fid", "p", "r").agg(pt.alias("pts"))
    tidy = F.filter(F.col("pts"), lambda q, i: (i == 0) | (F.get("pts", i - 1) != q))
    rings = rings.withColumn("pts", tidy).withColumn("ok", F.size(F.array_distinct("pts")) >= 3)
    parts = rings.groupBy("fid", "p").agg(F.array_sort(F.collect_list(F.struct("r", "pts"))).alias("rs"), F.min("ok").alias("ok"))
    g2 = parts.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "rs"))), lambda q: F.transform(q.getField("rs"), lambda r: r.getField("pts"))).alias("parts"), F.min("ok").alias("ok"))
    out = layer.join(g2, "fid", "left")
    return out.withColumn("geom", F.when(F.col("ok"), F.struct(F.col("geom.kind").alias("kind"), F.col("parts").alias("parts"))).otherwise(F.col("geom"))).drop("parts", "ok")


#: Buckets of groups for each shuffle partition: groups are small and many, so several travel together.
BUCKETS = 32


def _by_group(df: DataFrame, keys: list[str], fn, schema: str | T.StructType, outlines: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``fn`` makes of each group's columns as lists; ``outlines`` come repaired, other columns as they are.

    Groups are solved a bucket at a time, so that a small one costs no call of
    its own and outlines are repaired by whole batches.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    n = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in t.column_names if c != "__bucket"}
        for c in outlines:
            cols[c] = o.repair_all([o.to_parts(x) for x in cols[c]])
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*[cols[k] for k in keys], strict=True)):
            groups.setdefault(k, []).append(i)
        rows = [r for own in groups.values() for r in fn({c: [v[i] for i in own] for c, v in cols.items()})]
        kinds = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)], schema=kinds)

    # a given number of partitions, or few bytes of much work would be joined to one task
    parts = max(n // BUCKETS, df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(n))).repartition(parts, "__bucket").groupBy("__bucket").applyInArrow(run, schema)


OUTLINE = T.StructType([T.StructField("fid", T.StringType()), T.StructField("geom", GEOM)])


def without_overlaps(layer: DataFrame) -> DataFrame:
    """``fid, geom`` of a layer (fid, geom, priority): each outline less those of greater priority that it overlaps.

    Of equal priorities the smaller fid keeps. A feature is solved by itself from
    the outlines that reach it, in order of fid, so no group is gathered however
    far features hang together; one that would take all that is left is passed
    over. The whole layer's overlaps are found by the grid join.
    """
    p = overlap_pairs(layer)
    side = lambda n: layer.select(F.col("fid").alias(n), F.col("priority").alias(f"{n}_rank"))
    p = p.join(side("a"), "a").join(side("b"), "b").withColumn("first", F.col("a_rank") >= F.col("b_rank"))
    p = p.select(F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("fid"), F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("keeper"))
    pairs = p.join(layer.select(F.col("fid").alias("keeper"), F.col("geom").alias("other")), "keeper").join(layer.select("fid", "geom"), "fid")

    def run(d: dict) -> list[tuple]:
        own = d["geom"][0]
        for _, x in sorted(zip(d["keeper"], d["other"], strict=True), key=lambda k: k[0]):
            left = o.difference(own, x)
            own = left if o.area(left) > 0 else own
        return [(d["fid"][0], o.to_geom(own))]

    return layer.select("fid", "geom").join(p.select("fid").distinct(), "fid", "left_anti").unionByName(_by_group(pairs, ["fid"], run, OUTLINE, ("geom", "other")))


#: Metres: side of a tile in which gaps are looked for, and how far a gap may reach beyond it.
TILE, HALO = 240.0, 60.0


def gap_fillers(layer: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """``fid, hole, size``: gaps between the features of a layer up to ``max_gap`` and the feature that takes each.

    Gaps are holes of the union. Space is cut into tiles; a tile unites all
    features that come within HALO of it and owns the holes whose lowest left
    corner it holds, so a task's size doesn't depend on how far features hang
    together. A hole that reaches out of the tile and its margin is left open. The
    feature that reaches most of a hole takes it, of equal ones the first by fid.
    """
    d = layer.select("fid", "geom", kernel.outline("geom").getField("bbox").alias("bbox")).filter("bbox is not null")
    d = d.withColumn("tile", F.explode(cells(F.col("bbox"), TILE, HALO))).select("fid", "geom", "tile.i", "tile.j")
    box = lambda s: o.box(s) if s else None

    def run(p: dict) -> list[tuple]:
        i, j = p["i"][0], p["j"][0]
        order = sorted(range(len(p["fid"])), key=lambda k: p["fid"][k])
        lo, hi = np.array([i, j]) * TILE - HALO, np.array([i + 1, j + 1]) * TILE + HALO
        sets = [p["geom"][k] for k in order]
        boxes = [box(s) for s in sets]
        out = []
        for h in o.holes_of(o.union_all([s for s in sets if s]), LEAST_HOLE):
            hole = [[h[::-1]]]
            size, hb = o.area(hole), box(hole)
            corner = h[np.lexsort((h[:, 1], h[:, 0]))[0]]
            mine = (np.floor(corner / TILE) == (i, j)).all()
            if not mine or size > max_gap or (h.min(axis=0) < lo).any() or (h.max(axis=0) > hi).any():
                continue
            near = [b is not None and b[0] <= hb[2] + 0.1 and b[2] >= hb[0] - 0.1 and b[1] <= hb[3] + 0.1 and b[3] >= hb[1] - 0.1 for b in boxes]
            reach = [o.area(o.intersection(_grown(s, 0.05), hole)) if n else 0.0 for s, n in zip(sets, near, strict=True)]
            if max(reach, default=0.0) > 0:
                out.append((p["fid"][order[reach.index(max(reach))]], o.to_geom(hole), float(size)))
        return out

    return _by_group(d, ["i", "j"], run, T.StructType([T.StructField("fid", T.StringType()), T.StructField("hole", GEOM), T.StructField("size", T.DoubleType())]), ("geom",))


def _grown(s, r: float):
    """Parts with each ring pushed outwards by about r: enough to reach over a seam."""
    out = []
    for q in s:
        p = q[0]
        e1, e2 = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        n = lambda e: np.column_stack([e[:, 1], -e[:, 0]]) / np.maximum(np.hypot(*e.T), 1e-12)[:, None]
        m = n(e1) + n(e2)
        k = np.maximum((m * n(e1)).sum(axis=1), 0.2)
        out.append([p + m * (r / k)[:, None]])
    return out


def clean_layer(layer: DataFrame, snap: float = SNAP, max_gap: float = MAX_GAP, priority: str | None = None) -> DataFrame:
    """Layer with repaired, snapped, non-overlapping outlines and small gaps filled; bigger holes stay.

    An overlap stays with the feature of greater priority (its area, if none is
    given), of equal ones with the earlier fid. A feature that vanishes has null
    geometry; one without usable outline is left out.
    """
    d = spread(layer).withColumn("geom", make_valid("geom"))
    d = snap_vertices(d.filter("geom is not null"), snap) if snap else d.filter("geom is not null")
    d = cut(d.withColumn("geom", make_valid("geom")).filter("geom is not null"))
    rank = F.col(priority).cast("double") if priority else kernel.outline("geom").getField("area")
    d = cut(without_overlaps(d.select("fid", "geom", rank.alias("priority"))))
    holes = cut(gap_fillers(d, max_gap))

    fill = lambda p: [(p["fid"][0], o.to_geom(o.largest(o.union_all([p["geom"][0], *p["hole"]]))))]
    filled = _by_group(d.join(holes.select("fid", "hole"), "fid"), ["fid"], fill, OUTLINE, ("geom", "hole"))
    rest = spread(d.join(holes.select("fid").distinct(), "fid", "left_anti")).withColumn("geom", make_valid("geom"))
    return layer.drop("geom").join(rest.unionByName(filled), "fid")


def area_ledger(before: DataFrame, after: DataFrame) -> DataFrame:
    """``area_before, area_after, drift_pct, overlap_before, overlap_after, removed_double``."""
    total = lambda d, n: d.agg(F.sum(g.edges_area(g.edges("geom"))).alias(n))
    dup = lambda d, n: overlap_pairs(d).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias(n))
    x = total(before, "area_before").crossJoin(total(after, "area_after")).crossJoin(dup(before, "overlap_before")).crossJoin(dup(after, "overlap_after"))
    return x.withColumn("drift_pct", F.when(F.col("area_before") > 0, 100 * (F.col("area_after") - F.col("area_before")) / F.col("area_before")).otherwise(0.0)).withColumn("removed_double", F.col("overlap_before") - F.col("overlap_after"))
