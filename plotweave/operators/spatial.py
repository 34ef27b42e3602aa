"""Spatial joins: a grid equi-join for boxes, and a hierarchy of bounding volumes for regions.

Spark would run a range join as a nested loop. ``grid_pairs`` explodes boxes
to cells and equi-joins; ``VolumeTree`` splits space at medians of a bounded
sample so that every leaf holds about as many triangles, however dense a
place is. Either way a pair is produced once: in the cell that holds the lower
corner of the boxes' intersection, or in the one leaf that holds the triangle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..common import HOT_ROWS, cut, salted_pair, spread
from ..functions import kernel

#: Triangle centres from which the top of the hierarchy is split at least, and for each leaf.
TREE_SAMPLE, LEAF_SAMPLE = 20_000, 8
#: Triangles a leaf should hold, leaves up to which that is so, and triangles that a task may meet at once:
#: beyond so many leaves they grow to FULL_LEAF, then their number grows, one for each FULL_LEAF triangles.
LEAF_TRIANGLES, SMALL_LEAVES, FULL_LEAF = 64, 2_048, 100_000
#: The same where outlines meet few regions: small leaves have tight volumes, so most outlines reach none.
TIGHT_LEAF = 4


def cells(bbox: Column, size: float, reach: float = 0.0) -> Column:
    """Grid cells that a box grown by ``reach`` meets, as ``ARRAY<STRUCT<i, j>>``."""
    lo = lambda f: F.floor((bbox.getField(f) - reach) / size)
    hi = lambda f: F.floor((bbox.getField(f) + reach) / size)
    return F.flatten(
        F.transform(
            F.sequence(lo("xmin"), hi("xmax")), lambda i: F.transform(F.sequence(lo("ymin"), hi("ymax")), lambda j: F.struct(i.alias("i"), j.alias("j")))
        )
    )


def grid_pairs(left: DataFrame, right: DataFrame, size: float, reach: float = 0.0, keys: tuple[str, ...] = (), salt: bool = True) -> DataFrame:
    """Pairs whose boxes, the left one grown by ``reach``, meet; each once.

    Both sides have ``bbox``; ``keys`` are further equality keys both have.
    Other columns must be distinct; the right side's box comes out as ``rbox``.
    Cells with more than HOT_ROWS rows of the left side are salted. Rows with a
    null box or key pair with nothing.
    """
    a = left.filter(F.col("bbox").isNotNull()).withColumn("__c", F.explode(cells(F.col("bbox"), size, reach)))
    b = right.filter(F.col("bbox").isNotNull()).withColumnRenamed("bbox", "rbox").withColumn("__c", F.explode(cells(F.col("rbox"), size)))
    on = [*keys, "__ci", "__cj"]
    split = lambda d: d.withColumn("__ci", F.col("__c.i")).withColumn("__cj", F.col("__c.j")).drop("__c")
    a, b = split(a), split(b)
    if salt:
        a, b, on = salted_pair(a, b, on, HOT_ROWS)
    x = F.greatest(F.col("bbox.xmin") - reach, F.col("rbox.xmin"))
    y = F.greatest(F.col("bbox.ymin") - reach, F.col("rbox.ymin"))
    return (
        a.join(b, on)
        .filter(
            (F.col("bbox.xmin") - reach <= F.col("rbox.xmax"))
            & (F.col("bbox.xmax") + reach >= F.col("rbox.xmin"))
            & (F.col("bbox.ymin") - reach <= F.col("rbox.ymax"))
            & (F.col("bbox.ymax") + reach >= F.col("rbox.ymin"))
            & (F.floor(x / size) == F.col("__ci"))
            & (F.floor(y / size) == F.col("__cj"))
        )
        .drop("__ci", "__cj", "__salt")
    )


def near_pairs(points: DataFrame, reach: float) -> DataFrame:
    """``(fid_a, fid_b, dist)`` of different points at most ``reach`` apart, each pair once.

    ``points`` has fid, x, y. A point stands in its own cell and visits half of
    the neighbouring ones, so a pair of cells meets once. Crowded cells are
    salted. Null coordinates pair with nothing; repeated rows change nothing.
    """
    p = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("fid").isNotNull()).select("fid", "x", "y").distinct()
    ci, cj = F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)
    home = p.select(F.col("fid").alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"), ci.alias("__ci"), cj.alias("__cj"))
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    visit = p.withColumn("__s", F.explode(steps)).select(
        F.col("fid").alias("fb"), F.col("x").alias("xb"), F.col("y").alias("yb"), (ci + F.col("__s.i")).alias("__ci"), (cj + F.col("__s.j")).alias("__cj"),
        ((F.col("__s.i") == 0) & (F.col("__s.j") == 0)).alias("same"),
    )
    home, visit, on = salted_pair(home, visit, ["__ci", "__cj"])
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    return (
        home.join(visit, on)
        .filter((d <= reach) & F.when(F.col("same"), F.col("fa") < F.col("fb")).otherwise(F.col("fa") != F.col("fb")))
        .groupBy(F.least("fa", "fb").alias("fid_a"), F.greatest("fa", "fb").alias("fid_b"))
        .agg(F.min(d).alias("dist"))
    )


class VolumeTree:
    """Top of the bounding-volume hierarchy.

    Objects are split into leaves at medians of a bounded sample of centres; a
    leaf's volume is the box around all its objects, so each object is in one
    leaf and a query goes only to the leaves whose volume it meets.
    """

    def __init__(self, centres: np.ndarray, leaves: int):
        self.axis, self.at, self.kids, self.leaf = [], [], [], []
        self.leaves = 0
        self._split(centres, max(1, leaves))
        self.axis, self.at, self.kids, self.leaf = np.array(self.axis), np.array(self.at, float), np.array(self.kids).reshape(-1, 2), np.array(self.leaf)
        self.names, self.volumes = np.empty(0, int), kernel.Boxes(np.empty((0, 4)))
        self.parts: dict[int, int] = {}

    def _split(self, c: np.ndarray, leaves: int) -> int:
        me = len(self.axis)
        self.axis.append(0), self.at.append(0.0), self.kids.append([-1, -1]), self.leaf.append(-1)
        if leaves > 1 and len(c) > 1:
            axis = int(np.ptp(c[:, 1]) > np.ptp(c[:, 0]))
            at = float(np.median(c[:, axis]))
            low = c[:, axis] < at
            if low.any() and not low.all():
                self.axis[me], self.at[me] = axis, at
                left = self._split(c[low], leaves // 2)
                self.kids[me] = [left, self._split(c[~low], leaves - leaves // 2)]
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def place(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each object by its centre."""
        n = np.zeros(len(x), int)
        while True:
            inner = self.leaf[n] < 0
            if not inner.any():
                return self.leaf[n]
            v = np.where(self.axis[n] == 0, x, y)
            n = np.where(inner, np.where(v < self.at[n], self.kids[n, 0], self.kids[n, 1]), n)

    def placed(self, df: DataFrame, x: Column, y: Column) -> DataFrame:
        tree = self

        @F.arrow_udf(T.IntegerType())
        def place(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(tree.place(np.asarray(a, dtype=float), np.asarray(b, dtype=float)), pa.int32())

        return df.withColumn("leaf", place(x, y))

    def reached(self, df: DataFrame, box: tuple[Column, Column, Column, Column]) -> DataFrame:
        """One row for each leaf whose volume the box meets; none outside all volumes."""
        names, volumes = self.names, self.volumes

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def leaves(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            boxes = np.column_stack([np.asarray(v, dtype=float) for v in (a, b, c, d)]).reshape(-1, 4)
            q, leaf = volumes.hits(boxes)
            order = np.argsort(q, kind="stable")
            off = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(boxes)))])
            return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(names[leaf[order]], pa.int32()))

        return df.withColumn("leaf", F.explode(leaves(*box)))


TRIANGLE = "region string, ax double, ay double, bx double, by double, cx double, cy double"


def triangulate(regions: DataFrame, fid: str = "fid", geom: str = "geom") -> DataFrame:
    """Ear-clipped triangles of each region, holes left out; none for null or broken geometry."""

    def run(batches):
        for b in batches:
            fids, tris = [], []
            for f, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = kernel.triangles(g["parts"] if g else None)
                fids += [f] * len(t)
                tris.append(t.reshape(-1, 6))
            t = np.concatenate(tris) if tris else np.empty((0, 6))
            yield pa.RecordBatch.from_arrays([pa.array(fids, pa.string()), *[pa.array(t[:, k], pa.float64()) for k in range(6)]], names=[x.split()[0] for x in TRIANGLE.split(", ")])

    return spread(regions.filter(F.col(fid).isNotNull()).select(F.col(fid).alias("region"), F.col(geom).alias("g"))).mapInArrow(run, TRIANGLE)


def volume_tree(tri: DataFrame, leaf_triangles: int = LEAF_TRIANGLES, full_leaf: int = FULL_LEAF) -> tuple[VolumeTree, DataFrame]:
    """The hierarchy over triangles, and the triangles with their leaf.

    The driver sees a sample of centres and one box a leaf: a hundred-thousandth
    of the triangles, when they are many.
    """
    n = tri.count()
    leaves = min(-(-n // leaf_triangles), max(SMALL_LEAVES, -(-2 * n // full_leaf)))
    x, y = (F.col("ax") + F.col("bx") + F.col("cx")) / 3, (F.col("ay") + F.col("by") + F.col("cy")) / 3
    sample = max(TREE_SAMPLE, LEAF_SAMPLE * leaves)
    some = tri if n <= sample else tri.filter(F.xxhash64(*tri.columns) < int(2**64 * (sample / n)) - 2**63)
    rows = some.select(x.alias("x"), y.alias("y")).limit(2 * sample).collect()
    tree = VolumeTree(np.array(sorted(rows), dtype=float).reshape(-1, 2), leaves)
    tri = tree.placed(tri, x, y)
    lo = lambda a: F.min(F.least(f"a{a}", f"b{a}", f"c{a}"))
    hi = lambda a: F.max(F.greatest(f"a{a}", f"b{a}", f"c{a}"))
    boxes = tri.groupBy("leaf").agg(lo("x").alias("x0"), lo("y").alias("y0"), hi("x").alias("x1"), hi("y").alias("y1"), F.count(F.lit(1)).alias("n")).orderBy("leaf").collect()
    boxes = np.array(boxes, dtype=float).reshape(-1, 6)
    tree.names, tree.volumes = boxes[:, 0].astype(int), kernel.Boxes(boxes[:, 1:5])
    tree.parts = {int(leaf): int(-(-k // full_leaf)) for leaf, k in boxes[:, [0, 5]] if k > full_leaf}
    return tree, tri


def met(queries: DataFrame, tri: DataFrame, tree: VolumeTree) -> tuple[DataFrame, DataFrame, list[str]]:
    """Queries and triangles by the group in which they meet.

    Leaves with many queries are salted. A leaf over its bound, as stacked copies
    of a triangle make one, is cut into parts and its queries go to each.
    """
    on = ["leaf"]
    if tree.parts:
        cut_ = F.broadcast(tri.sparkSession.createDataFrame(list(tree.parts.items()), "leaf int, __parts int"))
        part = F.coalesce("__parts", F.lit(1))
        tri = tri.join(cut_, "leaf", "left").withColumn("__part", F.pmod(F.xxhash64(*tri.columns), part).cast("int")).drop("__parts")
        queries = queries.join(cut_, "leaf", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), part - 1))).drop("__parts")
        on = ["leaf", "__part"]
    return salted_pair(queries, tri, on)


def _tri_arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    p = np.column_stack([np.asarray(t.column(c), dtype=float) for c in ("ax", "ay", "bx", "by", "cx", "cy")]).reshape(-1, 3, 2)
    return p, np.concatenate([p.min(axis=1), p.max(axis=1)], axis=1).reshape(-1, 4)


def points_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``(fid, region)``: the region or regions each point lies in; a hole is outside.

    Regions are triangulated, triangles spread over the leaves of a volume
    hierarchy, points sent to their one leaf, and tested there exactly through
    a local hierarchy. A point lies strictly inside a region whose triangles
    surround it: a triangle adds a full turn around a point inside it, half a
    turn around one on its edge, and its angle at its corner. A point on a
    boundary belongs to the region with the smallest fid of those it touches,
    unless it lies strictly inside one. Points without position have no rows.
    """
    tree, tri = volume_tree(cut(triangulate(regions)))
    p = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("fid").isNotNull()).select("fid", "x", "y").distinct()
    p = cut(tree.reached(p, (F.col("x"), F.col("y"), F.col("x"), F.col("y"))))
    p, t, on = met(p, tri, tree)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tri, boxes = _tri_arrays(right)
        x, y = np.asarray(left.column("x"), dtype=float), np.asarray(left.column("y"), dtype=float)
        q, b = kernel.Boxes(boxes).hits(np.column_stack([x, y, x, y]))
        turn = _turn(np.column_stack([x[q], y[q]]), tri[b])
        ok = turn > 0
        return pa.table({"fid": left.column("fid").take(pa.array(q[ok])), "region": right.column("region").take(pa.array(b[ok])), "turn": pa.array(turn[ok])})

    found = p.groupBy(*on).cogroup(t.groupBy(*on)).applyInArrow(run, "fid string, region string, turn double")
    each = found.groupBy("fid", "region").agg((F.sum("turn") > 1 - 1e-6).alias("strict"))
    per = each.groupBy("fid").agg(F.max("strict").alias("any_strict"), F.min("region").alias("least"))
    return each.join(per, "fid").filter(F.col("strict") | (~F.col("any_strict") & (F.col("region") == F.col("least")))).select("fid", "region")


def _turn(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Share of a full turn around each point that its counter-clockwise triangle takes; 0 if it doesn't touch the point."""
    if not len(p):
        return np.empty(0)
    nxt = np.roll(tri, -1, axis=1)
    d, v = nxt - tri, p[:, None] - tri
    side = d[..., 0] * v[..., 1] - d[..., 1] * v[..., 0]
    zero = side == 0
    # edges k - 1 and k meet in corner k
    corner = zero & np.roll(zero, 1, axis=1)
    back = np.roll(tri, 1, axis=1) - tri
    angle = np.arctan2(d[..., 0] * back[..., 1] - d[..., 1] * back[..., 0], (d * back).sum(axis=2)) / (2 * np.pi)
    at = np.where(corner.any(axis=1), np.where(corner, angle, 0).sum(axis=1), np.where(zero.any(axis=1), 0.5, 1.0))
    return np.where((side >= 0).all(axis=1), at, 0.0)


def region_overlaps(outlines: DataFrame, regions: DataFrame, keys: list[str], least_area: float) -> DataFrame:
    """``keys + (region, area)``: overlap of each outline with each region, from ``least_area`` on.

    ``outlines`` has ``keys``, which identify one, ``pack`` and ``bbox``. An outline is
    tested against the region's triangles of the leaves its box meets; triangles
    of a region don't overlap, so their overlaps add up.
    """
    tree, tri = volume_tree(cut(triangulate(regions)), TIGHT_LEAF)
    b = outlines.filter(F.col("bbox").isNotNull()).select(*keys, "pack", "bbox.*")
    b = cut(tree.reached(b, tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).dropDuplicates([*keys, "leaf"]))
    schema = T.StructType([*[b.schema[k] for k in keys], T.StructField("region", T.StringType()), T.StructField("area", T.DoubleType())])
    b, t, on = met(b, tri, tree)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tri, boxes = _tri_arrays(right)
        own = np.column_stack([np.asarray(left.column(c), dtype=float) for c in ("xmin", "ymin", "xmax", "ymax")]).reshape(-1, 4)
        q, b = kernel.Boxes(boxes).hits(own)
        ea, sa, na = kernel.unpack(left.column("pack"), left.column("xmin"), left.column("ymin"))
        nxt = np.roll(tri, -1, axis=1)
        eb = np.concatenate([tri, nxt], axis=2).reshape(-1, 4)
        area = kernel.overlap_areas(ea, sa[q], na[q], eb, b * 3, np.full(len(b), 3))
        ok = area > 0
        q, b, area = pa.array(q[ok]), pa.array(b[ok]), pa.array(area[ok])
        return pa.table({**{k: left.column(k).take(q) for k in keys}, "region": right.column("region").take(b), "area": area})

    found = b.groupBy(*on).cogroup(t.groupBy(*on)).applyInArrow(run, schema)
    return found.groupBy(*keys, "region").agg(F.sum("area").alias("area")).filter(F.col("area") >= least_area)
