"""Conflicts between sources: fusion, votes, legal authority, and chains that don't close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..common import broadcast_if_small
from ..functions import text as t

#: Fields a legal record decides.
LEGAL = ("owner", "tenure", "khasra", "land_use", "ulpin")
NOW, HALF_LIFE = 2026, 25.0
ESCALATE, DOMINANT, ALIKE = 0.55, 10.0, 0.82


def source_weight(accuracy="accuracy_m", vintage="vintage", now: int = NOW) -> Column:
    """Inverse variance times recency: 0.5 + 0.5 exp(-age / 25)."""
    acc, age = F.greatest(F.col(accuracy), F.lit(0.01)), F.greatest(F.lit(now) - F.col(vintage), F.lit(0))
    return 1 / (acc * acc) * (0.5 + 0.5 * F.exp(-age / HALF_LIFE))


def weighted(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (fid, field, value, source_id, confidence, pos) with their source's weight."""
    d = claims.join(broadcast_if_small(sources.select("source_id", "accuracy_m", "vintage", "authority")), "source_id")
    return d.withColumn("w", source_weight()).withColumn("lawful", F.coalesce(F.array_contains("authority", F.col("field")), F.lit(False)))


def numeric_fusion(d: DataFrame) -> DataFrame:
    """``fid, field, fused, sigma, agreement, best_sigma, next_sigma, best_value`` of numeric claims.

    Agreement is exp(-mean squared residual / 4), residuals in each source's own sigma.
    """
    n = d.withColumn("num", t.as_number("value")).filter("num is not null")
    acc = F.greatest(F.col("accuracy_m"), F.lit(0.01))
    # sum of (v - mu)^2 / s^2 from three sums, so one pass is enough
    a = n.groupBy("fid", "field").agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("num") * F.col("w")).alias("swv"),
        F.sum(1 / (acc * acc)).alias("q0"), F.sum(F.col("num") / (acc * acc)).alias("q1"), F.sum(F.col("num") * F.col("num") / (acc * acc)).alias("q2"),
        F.array_sort(F.collect_list(F.struct(F.col("accuracy_m").alias("s"), "pos", "num"))).alias("by"),
    )
    mu = F.col("swv") / F.col("sw")
    chi = F.greatest((F.col("q2") - 2 * mu * F.col("q1") + mu * mu * F.col("q0")) / F.col("k"), F.lit(0.0))
    return a.select(
        "fid", "field", "k", mu.alias("fused"), F.sqrt(1 / F.col("sw")).alias("sigma"), F.when(F.col("k") < 2, 1.0).otherwise(F.exp(-chi / 4)).alias("agreement"),
        F.col("by")[0]["s"].alias("best_sigma"), F.get("by", F.lit(1))["s"].alias("next_sigma"), F.col("by")[0]["num"].alias("best_value"),
    )


def vote(d: DataFrame) -> DataFrame:
    """``fid, field, value, share, n_keys`` of the folded value with most weight, to six places; ties go to the first, then by the folded value."""
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    b = d.groupBy("fid", "field", t.normalise_key("value").alias("key")).agg(F.sum(F.col("w") * conf).alias("w"), F.min(F.struct("pos", "value")).alias("first"))
    g = b.groupBy("fid", "field").agg(F.sum("w").alias("total"), F.min(F.struct(-F.round("w", 6), "first.pos", "key", F.col("first.value").alias("value"), "w")).alias("b"), F.count(F.lit(1)).alias("n_keys"), F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("weights"))
    return g.select("fid", "field", F.col("b.value").alias("value"), F.col("b.key").alias("key"), (F.col("b.w") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)).alias("share"), "n_keys", "weights", "total")


def transitive(d: DataFrame, tol: float = ALIKE) -> DataFrame:
    """``fid, field, a, b, c, sim`` of claims i < j < k with i like j and j like k but i unlike k.

    Similarity is computed once a pair; the triple is an equi-join of pairs on
    the middle claim.
    """
    side = lambda s: d.select("fid", "field", F.col("pos").alias(f"pos_{s}"), F.col("value").alias(f"value_{s}"), F.col("source_id").alias(f"source_{s}"))
    pairs = side("i").join(side("k"), ["fid", "field"]).filter("pos_i < pos_k").withColumn("sim", t.claim_similarity("value_i", "value_k"))
    like = pairs.filter(F.col("sim") >= tol)
    ij = like.select("fid", "field", F.col("pos_i").alias("i"), F.col("source_i").alias("a"), F.col("pos_k").alias("j"))
    jk = like.select("fid", "field", F.col("pos_i").alias("j"), F.col("source_i").alias("b"), F.col("pos_k").alias("k"), F.col("source_k").alias("c"))
    ik = pairs.filter(F.col("sim") < tol).select("fid", "field", F.col("pos_i").alias("i"), F.col("pos_k").alias("k"), "sim")
    return ij.join(jk, ["fid", "field", "j"]).join(ik, ["fid", "field", "i", "k"]).select("fid", "field", "a", "b", "c", "sim")


def resolve_claims(claims: DataFrame, sources: DataFrame, escalate: float = ESCALATE) -> DataFrame:
    """``fid, field, value, rule, confidence, agreement, n_claims, transitive, needs_human`` of every field.

    Rules: sole source; legal authority of the latest lawful source; vote where
    no source is lawful; dominant precision (ten times better than the next);
    inverse-variance fusion; vote for other text.
    """
    d = weighted(claims, sources)
    n = d.groupBy("fid", "field").agg(
        F.count(F.lit(1)).alias("n_claims"), F.min("pos").alias("first_pos"), F.min_by("value", "pos").alias("only"), F.min(t.as_number("value").isNotNull()).alias("numeric"),
        F.max(F.when(F.col("lawful"), F.struct("vintage", -F.col("pos"), "value"))).alias("law"),
    )
    v, f = vote(d), numeric_fusion(d)
    tr = transitive(d).groupBy("fid", "field").agg(F.count(F.lit(1)).alias("transitive"))
    x = n.join(v.withColumnRenamed("value", "voted"), ["fid", "field"]).join(f, ["fid", "field"], "left").join(tr, ["fid", "field"], "left").na.fill(0, ["transitive"])
    legal = F.col("field").isin(*LEGAL)
    sole, law, ballot = F.col("n_claims") == 1, legal & F.col("law").isNotNull(), legal & F.col("law").isNull()
    dominant = F.col("numeric") & F.col("next_sigma").isNotNull() & (F.col("best_sigma") * DOMINANT <= F.col("next_sigma"))
    law_share = F.coalesce(F.try_element_at("weights", t.normalise_key(F.col("law.value"))), F.lit(0.0)) / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    text = lambda c: c.cast("string")
    pick = lambda a, b, c, d_, e, f_: F.when(sole, a).when(law, b).when(ballot, c).when(dominant, d_).when(F.col("numeric"), e).otherwise(f_)
    share, agree = F.col("share"), F.col("agreement")
    value = pick(F.col("only"), F.col("law.value"), F.col("voted"), text(F.col("best_value")), text(F.col("fused")), F.col("voted"))
    rule = pick(*[F.lit(r) for r in ("sole source", "legal authority", "provenance vote", "dominant precision", "inverse-variance fusion", "provenance vote")])
    conf = pick(F.lit(1.0), F.when(F.col("n_keys") > 1, 0.85).otherwise(1.0), share, F.greatest(F.least(agree, F.lit(1.0)), F.lit(0.5)), agree, share)
    agreement = pick(F.lit(1.0), law_share, share, agree, agree, share)
    own = (law & (F.col("field") == "owner") & (F.col("n_keys") > 1)) | (ballot & (share < escalate)) | (~legal & F.col("numeric") & ~dominant & (agree < escalate)) | (~legal & ~F.col("numeric") & (share < escalate))
    return x.select("fid", "field", value.alias("value"), rule.alias("rule"), conf.alias("confidence"), agreement.alias("agreement"), "n_claims", "transitive", F.coalesce((~sole & own) | (F.col("transitive") > 0), F.lit(False)).alias("needs_human"), "first_pos")


def parcel_review(resolved: DataFrame) -> DataFrame:
    """``fid, needs_human, reason``: the last field to ask for one, by first-seen order."""
    return resolved.groupBy("fid").agg(F.max("needs_human").alias("needs_human"), F.max_by(F.col("field"), F.when(F.col("needs_human"), F.col("first_pos"))).alias("reason"))


def latest_authority(d: DataFrame) -> DataFrame:
    """The lawful claim of latest vintage of each fid and field; the first wins ties."""
    w = W.partitionBy("fid", "field").orderBy(F.desc("vintage"), "pos")
    return d.filter("lawful").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
