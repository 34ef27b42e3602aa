"""Matching entities across sources without keys.

Sorted neighbourhood: both tables are laid out together along several
composite sort keys, and records that stand close along any of them are
compared by weighted field similarities. A one-to-one assignment of greatest
total confidence comes first; parts of divided or joined land and land that
is registered twice are added to it where containment proves them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..common import DEVANAGARI_DIGITS, broadcast_if_small, clean_fid, cut, finished, in_ranges, offsets
from ..functions import geometry as g, kernel
from ..operators.assignment import sparse_assignment
from ..operators.units import ward_key
from .groups import hash_to_min

#: Neighbours compared on either side along a sort key.
WINDOW = 24
#: Metres: reach of a pair, cell of the shift field, resolution of the curve.
REACH, FIELD, STEP = 60.0, 100.0, 4.0
#: Metres by which records may be displaced that tell the local shift.
SHIFT_REACH = 30.0
#: Shifts of the curve's origin; no place is at a seam of all three.
SHIFTS = ((0.0, 0.0), (1234.5, 2345.6), (3517.3, 911.7))
#: Ranks that a task compares at once.
BLOCK = 8_192
#: Pairs of a component that one task assigns, by shortest augmenting paths; larger ones go to the distributed
#: auction, whose total is within STEP_GAP for each record of the greatest.
TASK_PAIRS, STEP_GAP = 200_000, 0.01


def khasra_parts(c: Column) -> tuple[Column, Column]:
    """Parent and child number of a plot number in any spelling, as digits without leading zeros."""
    s = F.translate(c, DEVANAGARI_DIGITS, "0123456789")
    p = r"([0-9]+)\s*/\s*([0-9]+)"
    part = lambda i: F.regexp_extract(s, p, i).try_cast("int")
    return part(1), part(2)


def skeleton(c: Column) -> Column:
    """Sound of a name: relation words and vowels gone, alike consonants merged, doubles single."""
    s = F.regexp_replace(F.lower(c), r"\b(?:[swdv]\s*[/.]?\s*o\b\.?|shri|smt|late)", " ")
    s = F.regexp_replace(s, "[^a-z ]", " ")
    s = F.regexp_replace(F.translate(s, "wqz", "vkj"), "[aeiouyh]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"([a-z])\1+", "$1"), r"\s+", " "))


def canonical(rows: DataFrame, side: str) -> DataFrame:
    """One row a fid: ``fid, kp, kc, owner, sk, ward, area, bbox, pack, x, y`` of either table."""
    legacy = side == "L"
    name = {"kh": "KHSRA_NUM", "ow": "KHATEDAR_NM", "wd": "WARD", "id": "PARCEL_UID"} if legacy else {"kh": "khasra_no", "ow": "owner_name", "wd": "ward_no", "id": "ulpin"}
    d = rows.select(clean_fid("fid").alias("fid"), *[F.col(v).alias(k) for k, v in name.items()], "geom").filter("fid is not null")
    turn = F.struct(F.col("geom").isNotNull().alias("has"), "kh", "ow", "wd", "id", F.xxhash64("geom").alias("h"))
    d = d.select("fid", turn.alias("turn"), kernel.outline("geom").alias("o")).groupBy("fid").agg(F.max("turn").alias("turn"), F.max_by("o", "turn").alias("o")).select("fid", "turn.*", "o.*")
    kp, kc = khasra_parts(F.col("kh"))
    uid = F.regexp_extract("id", r"^[0-9]{2}([0-9]{6})([0-9]{6})$", 1).try_cast("double"), F.regexp_extract("id", r"^[0-9]{2}([0-9]{6})([0-9]{6})$", 2).try_cast("double")
    mid = lambda a: (F.col(f"bbox.{a}min") + F.col(f"bbox.{a}max")) / 2
    return d.select(
        "fid", kp.alias("kp"), kc.alias("kc"), F.trim(F.regexp_replace(F.lower("ow"), r"[^a-z]+", " ")).alias("owner"), F.nullif(skeleton(F.col("ow")), F.lit("")).alias("sk"), ward_key(F.col("wd")).alias("ward"),
        F.when(F.size("pack") > 0, F.col("area")).alias("area"), "bbox", "pack", mid("x").alias("x"), mid("y").alias("y"), uid[0].alias("ux"), uid[1].alias("uy"),
    )


def located(d: DataFrame, north: DataFrame) -> DataFrame:
    """x and y from the record number, which spells a place, where the outline is missing."""
    y = F.col("uy") + 1e6 * F.round((F.col("__north") - F.col("uy")) / 1e6)
    d = d.crossJoin(F.broadcast(north)).withColumn("y", F.coalesce("y", y)).withColumn("x", F.coalesce("x", F.when(F.col("y").isNotNull(), F.col("ux"))))
    return d.drop("ux", "uy", "__north")


def shift_field(left: DataFrame, right: DataFrame) -> DataFrame:
    """``ci, cj, dx, dy``: how far the left layer lies off, by cells, from records that agree on number and owner.

    Records more than SHIFT_REACH apart don't count. The cell they stand in is
    part of the key, so a number that many records share makes no large group.
    Means over a cell and its eight neighbours; sums combine before the shuffle.
    """
    told = "x is not null and kp is not null and sk is not null"
    at = lambda v: F.floor(v / (2 * SHIFT_REACH))
    x, y = F.col("x"), F.col("y")
    a = left.filter(told).select("kp", "kc", "sk", x.alias("lx"), y.alias("ly"), at(x).alias("gi"), at(y).alias("gj"))
    side = lambda v: F.array_distinct(F.array(at(v - SHIFT_REACH), at(v + SHIFT_REACH)))
    b = right.filter(told).select("kp", "kc", "sk", "x", "y", F.explode(side(x)).alias("gi")).withColumn("gj", F.explode(side(y)))
    d = a.join(b, ["kp", "kc", "sk", "gi", "gj"]).withColumn("dx", F.col("lx") - x).withColumn("dy", F.col("ly") - y).filter((F.abs("dx") < SHIFT_REACH) & (F.abs("dy") < SHIFT_REACH))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(4.0 if i == j == 0 else 1.0).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = d.groupBy(F.floor(F.col("lx") / FIELD).alias("ci"), F.floor(F.col("ly") / FIELD).alias("cj")).agg(F.count(F.lit(1)).alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"))
    d = d.withColumn("s", F.explode(steps)).select((F.col("ci") + F.col("s.i")).alias("ci"), (F.col("cj") + F.col("s.j")).alias("cj"), *[(F.col(c) * F.col("s.w")).alias(c) for c in ("n", "sx", "sy")])
    return d.groupBy("ci", "cj").agg((F.sum("sx") / F.sum("n")).alias("dx"), (F.sum("sy") / F.sum("n")).alias("dy"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left layer moved by the local shift; where no cell tells, by none."""
    f = shift_field(left, right)
    d = left.withColumn("ci", F.floor(F.col("x") / FIELD)).withColumn("cj", F.floor(F.col("y") / FIELD)).join(f, ["ci", "cj"], "left").na.fill(0.0, ["dx", "dy"])
    box = F.when(F.col("bbox").isNotNull(), F.struct(*[(F.col(f"bbox.{a}{e}") - F.col(f"d{a}")).alias(f"{a}{e}") for e in ("min", "max") for a in ("x", "y")]))
    return d.withColumn("bbox", F.when(box.isNotNull(), F.struct(*[box.getField(f).alias(f) for f in ("xmin", "ymin", "xmax", "ymax")]))).withColumn("x", F.col("x") - F.col("dx")).withColumn("y", F.col("y") - F.col("dy")).drop("ci", "cj", "dx", "dy")


@F.arrow_udf(T.LongType())
def _curve(x: pa.Array, y: pa.Array) -> pa.Array:
    """Hilbert index of a cell, so that neighbours along it are neighbours on the ground."""
    bits = 24
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    ok = ~(np.isnan(x) | np.isnan(y))
    a, b = (np.where(ok, np.clip(v / STEP, 0, 2**bits - 1), 0).astype(np.int64) for v in (x, y))
    d = np.zeros(len(a), np.int64)
    s = 1 << (bits - 1)
    while s:
        rx, ry = ((a & s) > 0).astype(np.int64), ((b & s) > 0).astype(np.int64)
        d += s * s * ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        a, b = np.where(flip, s - 1 - (a & (s - 1)), a & (s - 1)), np.where(flip, s - 1 - (b & (s - 1)), b & (s - 1))
        swap = ry == 0
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        s >>= 1
    return pa.array(d, pa.int64(), mask=~ok)


def sort_keys() -> Column:
    """Composite keys ``key, a, b, c``; a record that lacks a part has no place in that order only."""
    curves = [_curve(F.col("x") + dx, F.col("y") + dy) for dx, dy in SHIFTS]
    key = lambda n, a, b, c: F.when(a.isNotNull(), F.struct(F.lit(n).alias("key"), a.alias("a"), F.coalesce(b, F.lit(-1)).alias("b"), F.coalesce(c, F.lit(-1)).cast("long").alias("c")))
    none = F.lit(None).cast("long")
    keys = [key(i, c, F.col("kc"), none) for i, c in enumerate(curves)] + [
        key(3, F.when(F.col("sk").isNotNull(), F.xxhash64("sk")), F.col("kp"), curves[0]),
        key(4, (F.col("kp") * F.lit(100_000).cast("long") + F.col("kc")), F.lit(0), curves[0]),
    ]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r``: pairs within WINDOW of each other along any key that could belong together.

    All orders are laid end to end and ranked at once. A window slides over
    blocks of BLOCK ranks, whatever the data, so no key value can make one large;
    a block begins with the last WINDOW rows of the one before.
    """
    size = lambda a: ((F.col(f"bbox.{a}max") - F.col(f"bbox.{a}min")) / 2).cast("float")
    name = F.when(F.col("sk").isNotNull(), F.xxhash64("sk")).otherwise(F.lit(0))
    number = F.coalesce(F.col("kp") * F.lit(100_000).cast("long") + F.col("kc"), F.lit(-1))
    row = lambda d, s: d.withColumn("k", F.explode(sort_keys())).select("k.*", F.lit(s).alias("right"), "id", number.alias("number"), name.alias("name"), "x", "y", size("x").alias("w"), size("y").alias("h"))
    d = in_ranges(row(left, False).unionByName(row(right, True)), ["key", "a", "b", "c", "right", "id"])
    d = d.join(F.broadcast(offsets(d, {"before": F.lit(1).cast("long")})), "__part").withColumn("rank", F.col("__pos") + F.col("before"))
    own = F.floor(F.col("rank") / BLOCK)
    blocks = F.when(F.col("rank") % BLOCK >= BLOCK - WINDOW, F.array(own, own + 1)).otherwise(F.array(own))
    d = d.select("key", "right", "id", "number", "name", "x", "y", "w", "h", "rank", F.explode(blocks).alias("block"))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(np.asarray(t.column("rank")), kind="stable")))
        key, right, id_, number, name, rank, block = (np.asarray(t.column(c)) for c in ("key", "right", "id", "number", "name", "rank", "block"))
        x, y, w, h = (np.asarray(t.column(c), dtype=float) for c in ("x", "y", "w", "h"))
        first = np.searchsorted(rank, block[0] * BLOCK) if len(rank) else 0
        out = [np.empty((0, 2), np.int64)]
        for step in range(1, WINDOW + 1):
            j = np.arange(max(first, step), len(rank))
            i = j - step
            ok = (key[i] == key[j]) & (right[i] != right[j])
            i, j = i[ok], j[ok]
            dx, dy = np.abs(x[i] - x[j]), np.abs(y[i] - y[j])
            touch = (dx < w[i] + w[j]) & (dy < h[i] + h[j])
            same = ((number[i] == number[j]) & (number[i] >= 0)) | ((name[i] == name[j]) & (name[i] != 0))
            ok = touch | (same & ~(np.hypot(dx, dy) > REACH))
            i, j = i[ok], j[ok]
            out.append(np.column_stack([np.where(right[i], id_[j], id_[i]), np.where(right[i], id_[i], id_[j])]))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"l": pa.array(pairs[:, 0].copy(), pa.int64()), "r": pa.array(pairs[:, 1].copy(), pa.int64())})

    return d.groupBy("block").applyInArrow(run, "l long, r long").distinct()


def compared(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Field similarities of candidate pairs, and if the right one's number is ``common`` to many."""
    n = cut(right.filter("kp is not null and kc is not null").groupBy("kp", "kc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).select("kp", "kc", F.lit(True).alias("common")))
    side = lambda d, s, *more: d.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("kp", "kc", "owner", "sk", "ward", "area", "bbox", "pack", "x", "y")], *more)
    p = pairs.join(side(left, "l"), "l").join(side(right.join(broadcast_if_small(n), ["kp", "kc"], "left"), "r", "common"), "r")
    p = p.withColumn("inter", kernel.overlap_area("pack_l", "bbox_l", "pack_r", "bbox_r"))
    both = F.col("area_l").isNotNull() & F.col("area_r").isNotNull() & (F.col("area_l") > 1) & (F.col("area_r") > 1)
    frac = lambda s: F.when(both, F.least(F.lit(1.0), F.col("inter") / F.col(f"area_{s}")))
    longest = F.greatest(F.length("owner_l"), F.length("owner_r"))
    name = F.when((F.length("owner_l") > 0) & (F.length("owner_r") > 0), F.greatest(1 - F.levenshtein("owner_l", "owner_r") / longest, F.when(F.col("sk_l") == F.col("sk_r"), 0.95).otherwise(0.0)))
    return p.select(
        "l", "r", "common", frac("l").alias("fl"), frac("r").alias("fr"), name.alias("name"),
        (F.col("kp_l") == F.col("kp_r")).alias("parent"), (F.col("kc_l") == F.col("kc_r")).alias("child"), (F.col("ward_l") == F.col("ward_r")).alias("ward"),
        F.hypot(F.col("x_l") - F.col("x_r"), F.col("y_l") - F.col("y_r")).alias("dist"),
    )


#: Log-odds of the evidence, and the total from which a pair counts.
WEIGHTS = {
    "mutual": 4.0, "part": 2.5, "apart": -2.5, "sliver": -1.0, "unseen": -0.5, "spot": 1.0,
    "number": 3.0, "common_number": 0.3, "child": 1.5, "other_number": -2.5,
    "name": 3.0, "near_name": 1.0, "other_name": -1.0, "ward": 0.2, "other_ward": -1.0, "far": -3.0,
    "family": 3.0, "best": 1.0,
}
ACCEPT = 1.0
#: Records that share a plot number, from which it says little.
COMMON = 5
#: Share of a record inside another, from which it is part of it, and the share all parts make up.
PART, WHOLE = 0.65, 0.75


def scored(p: DataFrame) -> DataFrame:
    """Log-odds of each compared pair from geometry, number, name, ward, and its rivals.

    Every piece of evidence may be missing; a missing one weighs nothing.
    """
    w = WEIGHTS
    c = lambda x: F.coalesce(x, F.lit(False))
    mx, mn = F.greatest("fl", "fr"), F.least("fl", "fr")
    geo = (
        F.when(F.col("fl").isNull(), w["unseen"] + F.when(c(F.col("dist") < 5), w["spot"]).otherwise(0.0))
        .when(mn >= 0.6, w["mutual"])
        .when((mx >= PART) & (mn > 0.1), w["part"])
        .when(mx >= PART, w["sliver"])
        .when(mx > 0.35, 0.0)
        .otherwise(w["apart"])
    )
    number = (
        F.when(c(F.col("parent") & F.col("child")), F.when(c(F.col("common")), w["common_number"]).otherwise(w["number"]))
        .when(c(F.col("child")), w["child"])
        .when(F.col("child").isNotNull(), w["other_number"])
        .otherwise(0.0)
    )
    name = F.when(F.col("name").isNull(), 0.0).when(F.col("name") >= 0.8, w["name"]).when(F.col("name") >= 0.6, w["near_name"]).otherwise(w["other_name"])
    ward = F.when(F.col("ward").isNull(), 0.0).when(F.col("ward"), w["ward"]).otherwise(w["other_ward"])
    p = p.withColumn("s", geo + number + name + ward + F.when(c(F.col("dist") > 20), w["far"]).otherwise(0.0))
    # parts that together fill the other record speak for each other
    inside_l, inside_r = c((F.col("fr") >= PART) & (F.col("fl") > 0.1)), c((F.col("fl") >= PART) & (F.col("fr") > 0.1))
    of_l, of_r = W.partitionBy("l"), W.partitionBy("r")
    fills = lambda inside, share, of: (F.sum(F.when(inside, F.col(share)).otherwise(0.0)).over(of) >= WHOLE) & (F.sum(inside.cast("int")).over(of) >= 2) & (F.max(F.when(inside, F.col("s"))).over(of) >= ACCEPT)
    family = (inside_l & fills(inside_l, "fl", of_l)) | (inside_r & fills(inside_r, "fr", of_r))
    best = (F.col("s") == F.max("s").over(of_l)) & (F.col("s") == F.max("s").over(of_r))
    return p.withColumn("odds", F.col("s") + F.when(family, w["family"]).otherwise(0.0) + F.when(best, w["best"]).otherwise(0.0)).withColumn("part", inside_l | inside_r | c(mn >= 0.5))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """``l, r`` of the assignment with the greatest total confidence.

    Pairs whose records have no other pair are taken as they are. The rest falls
    into components, which are independent: each is solved exactly in one task
    as the rows stream through it, and one of more than TASK_PAIRS pairs by the
    auction.
    """
    n = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    d = cut(pairs.select("l", "r", (10 + F.col("odds")).alias("gain")).withColumn("alone", (n("l") == 1) & (n("r") == 1)))
    out, rest = d.filter("alone").select("l", "r"), d.filter("not alone").drop("alone")
    if rest.isEmpty():
        return out
    node = lambda c, side: F.col(c) * 2 + side
    comp = hash_to_min(rest.select(node("l", 0).alias("a"), node("r", 1).alias("b"))).filter("node % 2 = 0").select(F.shiftright("node", 1).alias("l"), F.col("root").alias("comp"))
    rest = cut(rest.join(comp, "l"))
    large = cut(rest.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_PAIRS).select("comp"))
    small = rest
    if not large.isEmpty():
        small = rest.join(broadcast_if_small(large), "comp", "left_anti")
        out = out.unionByName(auction(cut(rest.join(broadcast_if_small(large), "comp", "left_semi").select("l", "r", "gain"))))
    small = small.select("comp", "l", "r", "gain").repartition("comp").sortWithinPartitions("comp", "l", "r")
    return out.unionByName(small.mapInArrow(_solve_all, "l long, r long"))


def _solve_all(batches):
    """Assignments of components whose rows follow each other."""
    open_: list[tuple] = []  # rows of the component that the last batch ended in

    def solved(rows: list[tuple]) -> np.ndarray:
        l, r, gain = (np.concatenate(c) for c in zip(*rows, strict=True))
        _, li = np.unique(l, return_inverse=True)
        _, ri = np.unique(r, return_inverse=True)
        pick = sparse_assignment(li, ri, gain)
        return np.column_stack([l[pick], r[pick]])

    last = None
    for b in batches:
        comp, l, r, gain = (np.asarray(b.column(c)) for c in ("comp", "l", "r", "gain"))
        ends = np.append(np.flatnonzero(comp[1:] != comp[:-1]) + 1, len(comp))
        at, done = 0, [np.empty((0, 2), np.int64)]
        for e in ends if len(comp) else []:
            if open_ and comp[at] != last:
                done.append(solved(open_))
                open_ = []
            open_.append((l[at:e], r[at:e], gain[at:e]))
            last, at = comp[at], e
        got = np.concatenate(done)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy(), pa.int64()), pa.array(got[:, 1].copy(), pa.int64())], names=["l", "r"])
    if open_:
        got = solved(open_)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy(), pa.int64()), pa.array(got[:, 1].copy(), pa.int64())], names=["l", "r"])


def auction(pairs: DataFrame, step: float = STEP_GAP) -> DataFrame:
    """``l, r`` of an assignment whose total gain is within ``step`` for each left record of the greatest.

    Open left records bid for the right record that profits them most, as much as
    leaves them as well off as the second best or as nothing, and ``step`` more;
    the highest bid takes it and frees its holder. Prices begin at nothing and
    only rise, so a record without profit left is out for good, and unsold ones
    cost nothing: with both, the holders' profits and the prices bound the
    greatest total (complementary slackness). Each round is two joins.
    """
    held = pairs.select("l", "r", F.col("gain").alias("price")).limit(0)
    open_ = pairs.select("l").distinct()
    while True:
        p = pairs.join(open_, "l", "left_semi").join(held.select("r", "price"), "r", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
        p = p.withColumn("profit", F.col("gain") - F.col("price")).filter("profit > 0")
        w = W.partitionBy("l").orderBy(F.desc("profit"), "r")
        p = p.withColumn("i", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("profit").over(w), F.lit(0.0))).filter("i = 1")
        bids = p.select("l", "r", (F.col("price") + F.col("profit") - F.col("second") + step).alias("bid"))
        won = cut(bids.groupBy("r").agg(F.max(F.struct(F.col("bid").alias("price"), "l")).alias("b")).select("r", "b.l", "b.price"))
        if won.isEmpty():
            return held.select("l", "r")
        new = cut(held.join(won.select("r"), "r", "left_anti").select("l", "r", "price").unionByName(won.select("l", "r", "price")))
        # who bid and lost, and who held and was outbid, goes on
        lost = bids.select("l").join(won.select("l"), "l", "left_anti").unionByName(held.join(won.select("r"), "r", "left_semi").select("l"))
        open_, held = cut(lost.distinct()), new


@finished
def same_land(legacy: DataFrame, parcels: DataFrame) -> DataFrame:
    """``legacy_fid, parcel_fid, confidence, relation``: records of both tables that are the same land.

    ``relation`` is one_to_one for assigned pairs and part for those added to
    them. Records without any place, number and name pair with nothing; repeated
    rows of a fid collapse; empty tables give no rows.
    """
    # numbers rise with fid, so that ties fall alike however the rows lie
    numbered = lambda d: cut(d.repartitionByRange("fid").sortWithinPartitions("fid").withColumn("id", F.monotonically_increasing_id()))
    right0 = cut(canonical(parcels, "R"))
    north = right0.agg(F.avg("y").alias("__north"))
    right = numbered(located(right0, north))
    left = numbered(aligned(cut(located(canonical(legacy, "L"), north)), right))
    pairs = compared(left, right, neighbours(left, right))
    good = cut(scored(pairs).filter(F.col("odds") >= ACCEPT).select("l", "r", "odds", "part"))
    first = one_to_one(good).withColumn("first", F.lit(True))
    out = good.join(first, ["l", "r"], "left").filter(F.col("first") | F.col("part"))
    out = out.join(left.select(F.col("id").alias("l"), F.col("fid").alias("legacy_fid")), "l").join(right.select(F.col("id").alias("r"), F.col("fid").alias("parcel_fid")), "r")
    return out.select(
        "legacy_fid", "parcel_fid", (1 / (1 + F.exp(-F.col("odds")))).alias("confidence"), F.when(F.col("first"), "one_to_one").otherwise("part").alias("relation")
    )
