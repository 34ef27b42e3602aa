"""What changed between full snapshots of a table of outlines.

Structures are followed by place, not by fid: rows of consecutive snapshots
are linked where their outlines have an IoU of 0.55 or more, and a chain of
links is the structure's key. Every row carries a hash of its state. Gaps and
islands over key and hash give validity intervals; their starts, ends and
adjacencies are the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..common import BROADCAST_ROWS, broadcast_if_small, ceil_log2, clean_fid, cut, finished, salted_pair
from ..functions import geometry as g, kernel
from .spatial import grid_pairs

#: Outlines with this IoU are one structure.
SAME_IOU = 0.55
#: Square metres and metres from which a difference counts.
LEAST_AREA, LEAST_RISE = 8.0, 2.6
#: Grid cell in metres, about four times a structure's width: outlines are repeated for few cells.
CELL = 96.0


def epochs(df: DataFrame, col: str = "epoch") -> list[str]:
    """Snapshot names in order (number inside the name, then name); one driver row a snapshot."""
    e = F.lower(F.trim(F.col(col)))
    rows = df.select(e.alias("e")).filter(F.col("e").isNotNull() & (F.col("e") != "")).distinct().collect()
    key = lambda s: (int("".join(c for c in s if c.isdigit()) or 0), s)
    return sorted((r["e"] for r in rows), key=key)


def identified(buildings: DataFrame) -> DataFrame:
    """Rows with clean fid and epoch, and ``turn``, by which the current row of both is chosen.

    Rows without fid or epoch have no identity and are left out.
    """
    turn = F.struct("loaded_at", F.xxhash64("geom", "height_m").alias("h"))
    rows = buildings.select(clean_fid("fid").alias("fid"), F.lower(F.trim("epoch")).alias("epoch"), "geom", "height_m", turn.alias("turn"))
    return rows.filter(F.col("fid").isNotNull() & F.col("epoch").isNotNull() & (F.col("epoch") != ""))


def current_rows(buildings: DataFrame) -> DataFrame:
    """``fid, epoch, height_m, area, bbox, pack``: the row of each fid and snapshot with the latest loaded_at.

    Of equal times the row with the greatest hash counts, so repeated rows
    collapse and the choice never depends on order. A null time is earlier than
    any. Outlines are packed before the shuffle.
    """
    rows = identified(buildings).withColumn("o", kernel.outline("geom")).select("fid", "epoch", "turn", F.struct("height_m", "o.*").alias("r"))
    return rows.groupBy("fid", "epoch").agg(F.max_by("r", "turn").alias("r")).select("fid", "epoch", "r.*")


def outline_states(buildings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Distinct outlines of each snapshot, and who shares one.

    Outlines: ``id, no, fid, height_m, area, bbox, pack, shape, state``, where ``no``
    is the snapshot's number, ``shape`` a hash of the outline and ``state`` one of
    outline and height. Rows of a snapshot with the same outline are one, under
    the smallest fid and with the greatest height; ``id, fid, height_m`` of all of
    them are the second table, or it is None.
    """
    no = F.coalesce(*[F.when(F.col("epoch") == e, F.lit(i)) for i, e in enumerate(order)]) if order else F.lit(0)
    shape = F.when(F.size("pack") > 0, F.xxhash64("pack", "bbox")).otherwise(F.xxhash64("fid"))
    rows = current_rows(buildings).withColumn("no", no).withColumn("shape", shape).drop("epoch")
    rows = cut(rows.withColumn("state", F.xxhash64("shape", "height_m")).withColumn("id", F.monotonically_increasing_id()))
    shared = cut(rows.groupBy("no", "shape").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if shared.isEmpty():
        return rows, None
    own = cut(rows.join(broadcast_if_small(shared), ["no", "shape"]).select("no", "shape", "id", "fid", "height_m"))
    first = own.groupBy("no", "shape").agg(F.min(F.struct("fid", "id")).alias("f"), (F.count_distinct(F.coalesce("height_m", F.lit(-1e9))) > 1).alias("mixed"), F.max("height_m").alias("top"))
    first = first.select("no", "shape", F.col("f.id").alias("rep"), F.when(F.col("mixed"), F.struct("top")).alias("mixed"))
    own, first_, on = salted_pair(own, first, ["no", "shape"])
    own = cut(own.join(first_, on).select(F.col("rep").alias("id"), F.col("id").alias("mine"), "fid", "height_m", "mixed"))
    rows = rows.join(broadcast_if_small(own.filter("mine <> id").select(F.col("mine").alias("id"))), "id", "left_anti")
    # copies of unlike height: their outline is as tall as the tallest, and counts as changed in each snapshot, so that each copy is looked at
    mixed = own.filter("mixed is not null").select("id", "mixed").distinct()
    odd = F.col("mixed").isNotNull()
    rows = rows.join(broadcast_if_small(mixed), "id", "left").withColumn("state", F.when(odd, F.xxhash64("state", "no")).otherwise(F.col("state")))
    rows = rows.withColumn("height_m", F.when(odd, F.col("mixed.top")).otherwise(F.col("height_m"))).drop("mixed")
    return rows, own.select("id", "fid", "height_m")


def links(outlines: DataFrame) -> DataFrame:
    """``id, prev, best, primary``: outlines of consecutive snapshots with an IoU of SAME_IOU or more.

    ``best`` marks the best earlier outline of each outline, and ``primary`` the one
    later outline that carries the earlier one's key on.
    """
    o = outlines.select("id", "no", "shape", "pack", "area", "bbox")
    later = o.withColumn("pno", F.col("no") - 1).drop("no")
    earlier = o.select(F.col("id").alias("prev"), F.col("no").alias("pno"), F.col("shape").alias("pshape"), F.col("pack").alias("ppack"), F.col("area").alias("parea"), "bbox")
    pairs = grid_pairs(later, earlier, CELL, keys=("pno",))
    # the boxes alone bound the overlap, so most neighbours never reach the kernel
    side = lambda lo, hi: F.least(f"bbox.{hi}", f"rbox.{hi}") - F.greatest(f"bbox.{lo}", f"rbox.{lo}")
    bound = F.least(side("xmin", "xmax") * side("ymin", "ymax"), "area", "parea")
    pairs = pairs.filter(bound >= SAME_IOU / (1 + SAME_IOU) * (F.col("area") + F.col("parea")) - 1e-6)
    scored = pairs.withColumn("iou", g.iou(kernel.overlap_area("pack", "bbox", "ppack", "rbox"), "area", "parea")).filter(F.col("iou") >= SAME_IOU)
    scored = scored.select("id", "prev", "iou", "shape", "pshape")
    scored = scored.withColumn("best", F.row_number().over(W.partitionBy("id").orderBy(F.desc("iou"), "pshape")) == 1)
    first = F.row_number().over(W.partitionBy("prev").orderBy(F.desc("best"), F.desc("iou"), "shape")) == 1
    return scored.withColumn("primary", F.col("best") & first).select("id", "prev", "best", "primary")


def structure_keys(outlines: DataFrame, link: DataFrame, n_epochs: int) -> DataFrame:
    """``(id, key)``: the first outline of each link chain, by pointer doubling."""
    up = cut(outlines.select("id").join(link.filter("primary").select("id", "prev"), "id", "left").select("id", F.coalesce("prev", "id").alias("key")))
    for _ in range(ceil_log2(n_epochs)):
        up = up.join(up.select(F.col("id").alias("key"), F.col("key").alias("root")), "key").select("id", F.col("root").alias("key"))
    return up


def keyed_states(outlines: DataFrame, link: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, no, state, ghost`` and ``r``: every outline under its structure's key.

    Where two outlines continue one, or one continues two, the key can go one way
    only. The other way gets the neighbour's state under its own key as a ghost,
    so that its interval is adjacent to something and neither begins nor ends.
    """
    r = F.struct("id", "fid", "area", "height_m")
    rows = outlines.select("id", "no", "state", r.alias("r")).join(keys, "id")
    out = rows.select("key", "no", "state", F.lit(False).alias("ghost"), "r")
    before = link.filter("best and not primary").select(F.col("id").alias("to"), F.col("prev").alias("id"), F.lit(0).alias("later"))
    after = link.groupBy("prev").agg(F.max("primary").alias("goes_on")).filter("not goes_on").select(F.lit(None).cast("long").alias("to"), F.col("prev").alias("id"), F.lit(1).alias("later"))
    ghosts = cut(before.unionByName(after))
    if ghosts.isEmpty():
        return out
    g_ = rows.join(broadcast_if_small(ghosts), "id")
    return out.unionByName(g_.select(F.coalesce("to", "key").alias("key"), (F.col("no") + F.col("later")).alias("no"), "state", F.lit(True).alias("ghost"), "r"))


def validity(states: DataFrame) -> DataFrame:
    """Validity intervals ``key, start_no, end_no, first, last, from_ghost, to_ghost``: gaps and islands over key and state.

    ``first`` and ``last`` are the rows at an interval's ends.
    """
    w = W.partitionBy("key").orderBy("no")
    begins = F.coalesce((F.col("no") - F.lag("no").over(w) != 1) | (F.col("state") != F.lag("state").over(w)), F.lit(True))
    d = states.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(w))
    d = d.groupBy("key", "island").agg(
        F.min("no").alias("start_no"), F.max("no").alias("end_no"), F.min_by(F.struct("r.*", "ghost"), "no").alias("first"), F.max_by(F.struct("r.*", "ghost"), "no").alias("last")
    )
    return d.select("key", "start_no", "end_no", "first", "last", F.col("first.ghost").alias("from_ghost"), F.col("last.ghost").alias("to_ghost"))


def interval_events(iv: DataFrame, n_epochs: int) -> DataFrame:
    """``at, ends, id, fid, height_m, area, was``: interval starts after the first snapshot, and ends that nothing adjoins.

    ``was`` is the last row of the interval that adjoins a start, null if none does.
    """
    w = W.partitionBy("key").orderBy("start_no")
    prior = F.lag(F.struct("end_no", "last")).over(w)
    d = iv.withColumn("prior", prior).withColumn("next_no", F.lead("start_no").over(w))
    was = F.when(F.col("prior.end_no") == F.col("start_no") - 1, F.col("prior.last"))
    row = lambda at, ends, r, w_: F.struct(at.alias("at"), F.lit(ends).alias("ends"), *[F.col(f"{r}.{c}").alias(c) for c in ("id", "fid", "height_m", "area")], w_.alias("was"))
    start = F.when(~F.col("from_ghost") & (F.col("start_no") > 0), row(F.col("start_no"), False, "first", was))
    alone = F.coalesce(F.col("next_no") != F.col("end_no") + 1, F.lit(True))
    end = F.when(~F.col("to_ghost") & (F.col("end_no") < n_epochs - 1) & alone, row(F.col("end_no") + 1, True, "last", F.lit(None).cast(d.select(was).schema[0].dataType)))
    # both events of an interval at once: two branches would compute the intervals twice
    return d.select(F.explode(F.filter(F.array(start, end), lambda e: e.isNotNull())).alias("e")).select("e.*")


@finished
def snapshot_changes(buildings: DataFrame) -> DataFrame:
    """Change events ``epoch, kind, fid, matched_fid, delta_sqm`` between consecutive snapshots.

    An interval that starts where none adjoins is ``new``; one that ends where
    none adjoins is ``demolished``, under the earlier fid. Where two adjoin, the
    change of area, else of height, says ``extended``, ``reduced``, ``heightened`` or
    nothing. A null height gives no ``heightened``; a row without outline is ``new``
    or ``demolished`` only. Each of several fids with one outline gets its event.
    No rows for an empty table or a single snapshot.
    """
    order = epochs(buildings)
    outlines, copies = outline_states(buildings, order)
    link = cut(links(outlines))
    ev = interval_events(validity(keyed_states(outlines, link, structure_keys(outlines, link, len(order)))), len(order))
    if copies is not None:
        ev = _of_all_copies(ev, copies)
    d = F.col("area") - F.col("was.area")
    kind = (
        F.when(F.col("ends"), "demolished")
        .when(F.col("was").isNull(), "new")
        .when(d >= LEAST_AREA, "extended")
        .when(d <= -LEAST_AREA, "reduced")
        .when(F.col("height_m") - F.col("was.height_m") >= LEAST_RISE, "heightened")
    )
    name = F.element_at(F.array(*[F.lit(e) for e in order] or [F.lit("")]), F.col("at") + 1)
    delta = F.when(F.col("ends"), -F.col("area")).otherwise(F.coalesce(d, "area"))
    return ev.select(name.alias("epoch"), kind.alias("kind"), "fid", F.col("was.fid").alias("matched_fid"), delta.alias("delta_sqm")).filter("kind is not null")


def _of_all_copies(ev: DataFrame, copies: DataFrame) -> DataFrame:
    """Events of an outline for each fid that shares it."""
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = copies.select("id", F.col("fid").alias("own"), F.col("height_m").alias("own_height"))
    mine = lambda d: d.withColumn("height_m", F.when(F.col("own").isNotNull(), F.col("own_height")).otherwise(F.col("height_m"))).withColumn("fid", F.coalesce("own", "fid")).drop("own", "own_height")
    if few:
        return mine(ev.join(F.broadcast(own), "id", "left"))
    ev = cut(ev)
    many, one, on = salted_pair(own, ev, ["id"])
    return mine(many.join(one, on)).select(ev.columns).unionByName(ev.join(copies.select("id").distinct(), "id", "left_anti"))
