"""Candidate pairs of two polygon layers, their features, and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from ..common import cut, spread
from ..functions import geometry as g, kernel, shapes, text as t
from ..functions.kernel import overlap_area
from .spatial import grid_pairs

SEARCH_RADIUS, MAX_PER_SOURCE = 18.0, 18


def prepared(layer: DataFrame) -> DataFrame:
    """Layer with ``pack, bbox, area, perimeter, cx, cy, n_vertices``, computed once on all cores and kept."""
    d = spread(layer).withColumn("__o", kernel.measured_outline("geom")).select("*", "__o.*").drop("__o")
    return cut(d.withColumn("n_vertices", g.vertex_count("geom")))


def block(src: DataFrame, tgt: DataFrame, radius: float = SEARCH_RADIUS, top: int | None = MAX_PER_SOURCE, cell: float | None = None) -> DataFrame:
    """``src, tgt`` pairs whose boxes meet after growing the source's by ``radius``; the best ``top`` a source, or all.

    Over ``top`` candidates, overlapping ones rank first by shared box area, then
    nearer ones; ties by target. Both sides come from ``prepared``.
    """
    side = lambda d, n: d.select(F.col("fid").alias(n), "bbox", F.col("cx").alias(f"{n}_x"), F.col("cy").alias(f"{n}_y"))
    p = grid_pairs(side(src, "src"), side(tgt, "tgt"), cell or 2 * radius + 30, radius)
    if top is None:
        return p.select("src", "tgt")
    lap = lambda v: F.least(f"bbox.{v}max", f"rbox.{v}max") - F.greatest(f"bbox.{v}min", f"rbox.{v}min")
    inter = F.when((lap("x") > 0) & (lap("y") > 0), lap("x") * lap("y")).otherwise(0.0)
    d2 = F.pow(F.col("src_x") - F.col("tgt_x"), 2) + F.pow(F.col("src_y") - F.col("tgt_y"), 2)
    p = p.select("src", "tgt", (inter > 0).alias("hit"), F.when(inter > 0, inter).otherwise(-d2).alias("score"))
    w = W.partitionBy("src").orderBy(F.desc("hit"), F.desc("score"), "tgt")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("src", "tgt")


def pair_overlap(pairs: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Pairs with both sides' measures and ``inter``, the exact overlap area."""
    keep = ["area", "perimeter", "bbox", "pack", "cx", "cy", "n_vertices"]
    side = lambda d, n: d.select(F.col("fid").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in keep if c in d.columns])
    p = pairs.join(side(src, "src"), "src").join(side(tgt, "tgt"), "tgt")
    return p.withColumn("inter", overlap_area("src_pack", "src_bbox", "tgt_pack", "tgt_bbox"))


def context(pairs: DataFrame) -> DataFrame:
    """n_candidates, iou_rank, iou_margin, is_best_iou by source and rev_iou_rank by target; ties by the other's fid."""
    w = W.partitionBy("src").orderBy(F.desc("iou"), "tgt")
    all_ = W.partitionBy("src")
    d = pairs.withColumn("n_candidates", F.count(F.lit(1)).over(all_)).withColumn("iou_rank", F.row_number().over(w) - 1)
    second = F.max(F.when(F.col("iou_rank") == 1, F.col("iou"))).over(all_)
    d = d.withColumn("iou_margin", F.max("iou").over(all_) - F.coalesce(second, F.lit(0.0)))
    d = d.withColumn("is_best_iou", (F.col("iou_rank") == 0).cast("int"))
    return d.withColumn("rev_iou_rank", F.row_number().over(W.partitionBy("tgt").orderBy(F.desc("iou"), "src")) - 1)


# The features' names in the order in which a matcher sees them.
FEATURES = [
    "iou", "sym_diff_norm", "centroid_dist", "centroid_dist_norm", "area_ratio", "hausdorff_norm", "sig_dist", "src_frac_in_tgt", "tgt_frac_in_src", "d_compactness",
    "d_rectangularity", "d_elongation", "vertex_ratio", "name_jw", "name_lev", "name_tok", "name_present", "kh_exact", "kh_parent", "kh_child", "kh_present", "area_attr_ratio",
    "land_use_match", "ward_match", "n_candidates", "iou_rank", "iou_margin", "is_best_iou", "rev_iou_rank",
]


def described(layer: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``prepared`` layer with shape measures and attributes under their field names; unmapped fields are null."""
    d = shapes.described(prepared(layer))
    for f in ("khasra", "owner", "area", "land_use", "tenure", "ward", "ulpin"):
        d = d.withColumn(f"f_{f}", F.col(fields[f]) if f in fields else F.lit(None).cast("string"))
    return d


def pair_features(pairs: DataFrame, src: DataFrame, tgt: DataFrame, area_scale: float = 1.0) -> DataFrame:
    """The 29 features of each candidate pair, in order, after ``src`` and ``tgt``.

    Shape measures and signatures come from ``described`` layers, so nothing is
    computed per pair that belongs to one polygon.
    """
    cols = [c for c in src.columns if c not in ("fid", "geom")]
    side = lambda d, n: d.select(F.col("fid").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in cols if c in d.columns])
    p = pairs.join(side(src, "src"), "src").join(side(tgt, "tgt"), "tgt")
    p = p.withColumn("inter", overlap_area("src_pack", "src_bbox", "tgt_pack", "tgt_bbox"))
    a, b, i = F.col("src_area"), F.col("tgt_area"), F.col("inter")
    root = F.when(a + b > 0, F.sqrt((a + b) / 2)).otherwise(1.0)
    dist = g.centroid_offset("src_cx", "src_cy", "tgt_cx", "tgt_cy")
    frac = lambda x: F.when(x > 0, i / x).otherwise(0.0)
    vr = F.least("src_n_vertices", "tgt_n_vertices") / F.greatest("src_n_vertices", "tgt_n_vertices")
    rec = t.as_number("src_f_area") * area_scale
    same = lambda f: F.coalesce((F.col(f"src_f_{f}") == F.col(f"tgt_f_{f}")) & (F.col(f"src_f_{f}") != ""), F.lit(False)).cast("double")
    p = p.select(
        "src", "tgt", g.iou(i, a, b).alias("iou"), g.normalised_symmetric_difference(i, a, b).alias("sym_diff_norm"), dist.alias("centroid_dist"), (dist / root).alias("centroid_dist_norm"),
        g.area_ratio(a, b).alias("area_ratio"), (shapes.hausdorff("src_ring", "tgt_ring") / root).alias("hausdorff_norm"), shapes.signature_distance("src_signature", "tgt_signature").alias("sig_dist"),
        frac(a).alias("src_frac_in_tgt"), frac(b).alias("tgt_frac_in_src"), *[F.abs(F.col(f"src_{m}") - F.col(f"tgt_{m}")).alias(f"d_{m}") for m in ("compactness", "rectangularity", "elongation")],
        vr.alias("vertex_ratio"), *[c.alias(k) for k, c in t.name_similarity("src_f_owner", "tgt_f_owner").items()], *[c.alias(k) for k, c in t.khasra_similarity("src_f_khasra", "tgt_f_khasra").items()],
        F.when((rec > 0) & (b > 0), F.least(rec, b) / F.greatest(rec, b)).otherwise(0.0).alias("area_attr_ratio"), same("land_use").alias("land_use_match"), same("ward").alias("ward_match"),
    )
    return context(p).select("src", "tgt", *FEATURES)


def best_match(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """The target of greatest IoU of each source; the smallest of equal ones."""
    w = W.partitionBy("src").orderBy(F.desc("iou"), "tgt")
    return pairs.filter(F.col("iou") > least).withColumn("r", F.row_number().over(w)).filter("r = 1").select("src", "tgt", "iou")


#: Targets up to this many travel to the tasks whole (their count is checked); more are searched by rings of cells.
SMALL_TARGETS = 20_000
#: The same for the single nearest, which a task finds by a grid of its own.
SMALL_SINGLE = 300_000


class PointGrid:
    """Targets (m, 2) by cells of a square grid, for the nearest one of many points; of equal ones the first."""

    def __init__(self, at: np.ndarray):
        self.at, self.lo = at, at.min(axis=0)
        span = at.max(axis=0) - self.lo
        self.side = max(float(np.sqrt(2 * span[0] * span[1] / len(at))), float(span.max()) / len(at), 1e-9)
        self.n = np.floor(span / self.side).astype(np.int64) + 1
        i = np.floor((at - self.lo) / self.side).astype(np.int64)
        cell = i[:, 0] * self.n[1] + i[:, 1]
        self.order = np.argsort(cell, kind="stable")
        self.start = np.searchsorted(cell[self.order], np.arange(self.n[0] * self.n[1] + 1))

    def nearest(self, p: np.ndarray) -> np.ndarray:
        out, open_, r = np.zeros(len(p), np.int64), np.arange(len(p)), 1
        while len(open_) and r <= 16:
            c = np.floor((p[open_] - self.lo) / self.side)
            own, best = [], []
            low, high = np.clip(c[:, 1] - r, 0, self.n[1]), np.clip(c[:, 1] + r + 1, 0, self.n[1])
            for step in range(-r, r + 1):
                some = np.flatnonzero((c[:, 0] + step >= 0) & (c[:, 0] + step < self.n[0]) & (low < high))
                column = (c[some, 0] + step).astype(np.int64) * self.n[1]
                a, b = self.start[column + low[some].astype(np.int64)], self.start[column + high[some].astype(np.int64)]
                own.append(np.repeat(some, b - a))
                best.append(self.order[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())])
            own, j = np.concatenate(own), np.concatenate(best)
            q = p[open_[own]]
            d = (q[:, 0] - self.at[j, 0]) ** 2 + (q[:, 1] - self.at[j, 1]) ** 2
            o = np.lexsort((j, d, own))
            o = o[np.flatnonzero(np.diff(np.concatenate([[-1], own[o]])))]
            # within so many cells every target has been seen
            o = o[d[o] < (r * self.side) ** 2 * (1 - 1e-9)]
            out[open_[own[o]]] = j[o]
            left = np.ones(len(open_), bool)
            left[own[o]] = False
            open_, r = open_[left], 2 * r
        for lo in range(0, len(open_), step := max(1, 2_000_000 // len(self.at))):
            q = p[open_[lo : lo + step]]
            out[open_[lo : lo + step]] = ((q[:, :1] - self.at[:, 0]) ** 2 + (q[:, 1:] - self.at[:, 1]) ** 2).argmin(axis=1)
        return out


def _nearest_small(s: DataFrame, tg: DataFrame, k: int) -> DataFrame:
    rows = tg.orderBy("tgt").select("tgt", "tx", "ty").toArrow().combine_chunks()
    names = pa.concat_arrays(rows.column("tgt").chunks).cast(pa.string()) if len(rows) else pa.array([], pa.string())
    at = np.column_stack([np.asarray(rows.column(c), dtype=float) for c in ("tx", "ty")]).reshape(-1, 2)
    m = min(k, len(rows))

    def run(batches):
        grid = PointGrid(at) if m == 1 else None
        for b in batches:
            for lo in range(0, b.num_rows if m else 0, step := 500 if m > 1 else 20_000):
                c = b.slice(lo, step)
                if m == 1:  # of equal ones the first, which has the smaller name
                    x, y = np.asarray(c.column(1), dtype=float), np.asarray(c.column(2), dtype=float)
                    j = grid.nearest(np.column_stack([x, y]))
                    yield pa.RecordBatch.from_arrays([c.column(0), names.take(pa.array(j)), pa.array(np.hypot(x - at[j, 0], y - at[j, 1])), pa.array(np.ones(len(j), np.int32))], names=["src", "tgt", "dist", "rank"])
                    continue
                d = np.hypot(np.asarray(c.column(1), dtype=float)[:, None] - at[:, 0], np.asarray(c.column(2), dtype=float)[:, None] - at[:, 1])
                # every target at the k-th distance takes part, so that ties fall to the smaller name
                last = np.partition(d, m - 1, axis=1)[:, m - 1]
                i, j = np.nonzero(d <= last[:, None])
                o = np.lexsort((j, d[i, j], i))
                i, j = i[o], j[o]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                keep = rank <= m
                i, j, rank = i[keep], j[keep], rank[keep]
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(i)), names.take(pa.array(j)), pa.array(d[i, j]), pa.array(rank.astype(np.int32))], names=["src", "tgt", "dist", "rank"])

    return spread(s).mapInArrow(run, "src string, tgt string, dist double, rank int")


def nearest(src: DataFrame, tgt: DataFrame, k: int, cell: float, small: int | None = None) -> DataFrame:
    """``src, tgt, dist, rank``: the k nearest targets of each source by centre, ties by target.

    Both have fid, x, y. Rings of cells are searched outwards: a source that has
    k targets within the searched reach is settled; only the rest go on with a
    reach twice as large, until all are settled. Rows without a finite x and y
    have no neighbours and are none.
    """
    finite = lambda *c: ~F.isnan(sum((F.col(x) - F.col(x) for x in c), F.lit(0.0)))
    s = src.select(F.col("fid").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy")).filter(finite("sx", "sy"))
    tg = cut(tgt.select(F.col("fid").alias("tgt"), F.col("x").alias("tx"), F.col("y").alias("ty")).filter(finite("tx", "ty")))
    n = tg.count()
    if n <= ((SMALL_SINGLE if k == 1 else SMALL_TARGETS) if small is None else small):
        return _nearest_small(s, tg, k)
    out, open_, size = None, cut(s), cell
    while n and not open_.isEmpty():
        cells = F.explode(F.array(*[F.struct((F.floor(F.col("sx") / size) + i).alias("i"), (F.floor(F.col("sy") / size) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        p = open_.withColumn("c", cells).select("*", "c.i", "c.j").drop("c").join(tg.select("*", F.floor(F.col("tx") / size).alias("i"), F.floor(F.col("ty") / size).alias("j")), ["i", "j"])
        p = p.withColumn("dist", F.hypot(F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty")))
        w = W.partitionBy("src").orderBy("dist", "tgt")
        p = p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        # within one cell's width every target has been seen
        done = p.groupBy("src").agg(F.max("rank").alias("got"), F.max("dist").alias("far")).filter((F.col("got") == min(k, n)) & (F.col("far") <= size))
        found = cut(p.join(done.select("src"), "src", "left_semi").select("src", "tgt", "dist", "rank"))
        out = found if out is None else out.unionByName(found)
        open_ = cut(open_.join(found.select("src").distinct(), "src", "left_anti"))
        size *= 2
    return out if out is not None else s.select("src", F.lit("").alias("tgt"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
