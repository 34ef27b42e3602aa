"""Consolidating pairwise matches into groups: hash-to-min over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..common import HOT_ROWS, clean_fid, cut, finished, salted_pair

#: Rounds after which a graph counts as not converging; each round at least halves the open paths.
MAX_ROUNDS = 60
#: Kinds of messages: an element of a set, a goodbye to the node that keeps the sender, and the sender's own note of it.
HELLO, BYE, SAID = 0, 1, 2


def hash_to_min(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, root)``: the smallest node of each connected component.

    ``links`` has a and b; ``nodes`` adds single ones. Each node holds a set,
    at first its neighbours and itself. In a round it sends the set to the set's
    minimum and the minimum to all others, until every set but the minimum's
    is the minimum alone. The minimum is that of random numbers that stand for
    the nodes, so that chains of consecutive names close in few rounds. Sets
    live as rows, so no set has to fit in memory; messages combine before the
    shuffle and the join back to a hub is salted.

    A node whose set is one smaller node alone is settled: that node's set is the
    only other one that holds it. It says goodbye along with its message and is
    taken out once the other still held it, to follow it in the end. So a round
    costs what is still open, not the whole graph. Self links, mirrored and
    repeated links change nothing; null ends are ignored.
    """
    e = links.select("a", "b").filter("a is not null and b is not null")
    ends = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node")))
    if nodes is not None:
        ends = ends.union(nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null"))
    # of a number of 64 bits this hash is one to one
    ids = cut(ends.distinct().withColumn("id", F.xxhash64(F.monotonically_increasing_id())))
    for end, v in (("a", "v"), ("b", "u")):
        many, one, on = salted_pair(e, ids.withColumnRenamed("node", end).withColumnRenamed("id", v), [end])
        e = many.join(one, on).drop(*on)
    e = cut(e.select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).filter("v <> u").distinct())
    told = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).unionByName(ids.select(F.col("id").alias("v"), F.col("id").alias("u"))).withColumn("bye", F.lit(HELLO))
    parents = None
    for _ in range(MAX_ROUNDS):
        state = cut(told.groupBy("v", "u").agg(F.min("bye").alias("lo"), F.max("bye").alias("hi")))
        gone = state.filter(f"lo = {HELLO} and hi = {BYE}").select(F.col("u").alias("id"), F.col("v").alias("up"))
        live = state.filter(f"hi = {HELLO}").select("v", "u")
        least = cut(live.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        gone = gone.unionByName(least.filter("n = 1 and v = m").select(F.col("v").alias("id"), F.col("m").alias("up")))
        parents = gone if parents is None else parents.unionByName(gone)
        least = least.filter("not (n = 1 and v = m)")
        most = least.agg(F.max("n")).head()[0]
        if most is None:
            return _named(_roots(cut(parents)), ids)
        many, one, on = salted_pair(live, least, ["v"]) if most > HOT_ROWS else (live, least, ["v"])
        msg = lambda to, what, bye=HELLO: F.struct(to.alias("v"), what.alias("u"), F.lit(bye).alias("bye"))
        v, u, m = F.col("v"), F.col("u"), F.col("m")
        # both messages of an element at once: the element to the minimum, the minimum to it
        sends = F.when(F.col("n") == 1, F.array(msg(m, v, BYE), msg(m, m), msg(v, m, SAID))).otherwise(F.array(msg(m, u), msg(u, m)))
        told = many.join(one, on).select(F.explode(sends).alias("x")).select("x.*")
    raise RuntimeError(f"components still open after {MAX_ROUNDS} rounds")


def _roots(parents: DataFrame) -> DataFrame:
    """``id, root`` by pointer doubling over settled nodes; a root is its own parent."""
    p = parents.select("id", F.col("up").alias("root"))
    while True:
        many, one, on = salted_pair(p.withColumnRenamed("root", "up"), p.select(F.col("id").alias("up"), "root"), ["up"])
        new = cut(many.join(one, on).select("id", "up", "root"))
        if new.filter("up <> root").isEmpty():
            return new.select("id", "root")
        p = new.select("id", "root")


def _named(roots: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, root`` by name, the root being the smallest name of its component."""
    d = cut(roots.join(ids, "id").select("node", F.col("root").alias("id")))
    many, one, on = salted_pair(d, d.groupBy("id").agg(F.min("node").alias("root")), ["id"])
    return many.join(one, on).select("node", "root")


def match_links(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and records of a match table, fids clean.

    Rows whose relation is spurious link nothing but name their records. Null
    or empty targets and null elements name nothing.
    """
    m = matches.select(clean_fid("src_fid").alias("a"), F.explode_outer("tgt_fids").alias("t"), F.lower(F.trim("relation")).alias("relation")).select("a", clean_fid("t").alias("b"), "relation")
    m = cut(m.distinct())  # fids are cleaned once
    nodes = m.select(F.explode(F.array("a", "b")).alias("v")).filter("v is not null").distinct()
    links = m.filter("a is not null and b is not null and a <> b and coalesce(relation, '') <> 'spurious'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links, nodes


@finished
def match_groups(matches: DataFrame) -> DataFrame:
    """``group_fid, fid``: every record with the smallest fid of its group; its own if it stands alone."""
    links, nodes = match_links(matches)
    return hash_to_min(links, nodes).select(F.col("root").alias("group_fid"), F.col("node").alias("fid"))
