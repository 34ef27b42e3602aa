"""Best representative of each duplicate group, field by field.

Among usable claims the source decides, then currency. The values of a fid,
field and source are ordered by what is known of their succession: their own
times, and where times are missing, the transitions between values learned
from all timestamped claims. The topologically latest value survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..common import clean_fid, broadcast_if_small, cut, finished

# What a value says when it says nothing, without case and punctuation.
UNKNOWN = ["", "na", "n a", "nil", "null", "none", "nan", "unknown", "unk", "tbd", "blank", "xxx", "xx", "xxxx", "not known", "not available", "not recorded", "missing", "unreadable", "illegible", "not legible", "अज्ञात", "नहीं मालूम", "उपलब्ध नहीं", "पता नहीं"]
#: Share of a pair's transitions that must go one way for it to count as precedence.
ONE_WAY = 0.6


def says_something(value: Column) -> Column:
    """False for null, blank and stand-ins for unknown, whatever their case and punctuation."""
    s = F.trim(F.regexp_replace(F.lower(F.regexp_replace(value, r"[ ​-‍﻿]", " ")), r"[^\p{L}\p{M}\p{N}]+", " "))
    s = F.when(s == "n a", "na").otherwise(s)
    return F.coalesce(~s.isin(UNKNOWN), F.lit(False))


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def usable_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims that say something, of listed sources, one row a claim_id, with their source's standing."""
    s = sources.filter("source_id is not null").select(source_key(F.col("source_id")).alias("source"), "accuracy_m", "vintage", "authority")
    s = s.groupBy("source").agg(F.min("accuracy_m").alias("accuracy_m"), F.max("vintage").alias("vintage"), F.max("authority").alias("authority"))
    c = claims.filter(says_something(F.col("value"))).select(
        "claim_id", clean_fid("fid").alias("fid"), F.lower(F.trim("field")).alias("field"), source_key(F.col("source_id")).alias("source"), F.trim("value").alias("value"), "claimed_at"
    )
    c = c.filter("claim_id is not null and fid is not null and field is not null")
    out = c.join(broadcast_if_small(s), "source")
    return out.withColumn("lawful", F.coalesce(F.array_contains("authority", F.col("field")), F.lit(False))).drop("authority")


def value_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{N}/.]+", " "))


GROUP = ["fid", "field", "source"]


def group_values(usable: DataFrame) -> DataFrame:
    """The nodes of the partial orders: ``fid, field, source, v``, its standing, latest time ``at``, and ``claim``, its latest.

    One row a distinct value of a group, so copies and repeated rows collapse
    next to the scan. ``at`` is null where none of its claims has a time.
    """
    last = F.struct("claimed_at", "claim_id")
    d = usable.groupBy(*GROUP, value_key(F.col("value")).alias("v")).agg(
        F.max("claimed_at").alias("at"), F.max_by(F.struct("claim_id", "value"), last).alias("claim"), F.max("lawful").alias("lawful"), F.max("vintage").alias("vintage"), F.min("accuracy_m").alias("accuracy_m")
    )
    return d.withColumn("last_at", F.max("at").over(W.partitionBy(*GROUP)))


def precedence(values: DataFrame) -> DataFrame:
    """``field, v, later``: value transitions that go mostly one way.

    Learned over all timestamped values: consecutive different ones of one fid,
    field and source.
    """
    pairs = values.filter("at is not null").withColumn("before", F.lag("v").over(W.partitionBy(*GROUP).orderBy("at", "v"))).filter("before is not null")
    n = pairs.groupBy("field", F.col("before").alias("v"), F.col("v").alias("later")).agg(F.count(F.lit(1)).alias("n"))
    back = n.select("field", F.col("later").alias("v"), F.col("v").alias("later"), F.col("n").alias("m"))
    return n.join(back, ["field", "v", "later"], "left").filter(F.col("n") > ONE_WAY * (F.col("n") + F.coalesce("m", F.lit(0)))).select("field", "v", "later")


def successions(starts: DataFrame, step: DataFrame) -> DataFrame:
    """``field, v, later``: all values that follow a start by chains of steps, also through values that no group here has.

    Values that follow each other both ways are one class and order nothing.
    """
    known = cut(starts.join(step, ["field", "v"]))
    front = known
    while not front.isEmpty():
        on = step.select("field", F.col("v").alias("later"), F.col("later").alias("next"))
        new = front.join(on, ["field", "later"]).select("field", "v", F.col("next").alias("later")).distinct()
        front = cut(new.join(known, ["field", "v", "later"], "left_anti"))
        known = cut(known.unionByName(front))
    both = known.select("field", F.col("later").alias("v"), F.col("v").alias("later"))
    return cut(known.filter("v <> later").join(both, ["field", "v", "later"], "left_anti"))


def superseded(values: DataFrame) -> DataFrame:
    """``fid, field, source, v`` of the values that another one of their group follows, in groups with an untimed value.

    Two timed values follow each other by their times alone; learned successions
    order the others. Where they contradict a group's own times, as an untimed
    value that is to come after a late value and before an early one, what the
    contradiction holds together is tied.
    """
    open_ = values.filter("at is null").select(*GROUP).distinct()
    own = cut(values.join(open_, GROUP, "left_semi").select(*GROUP, "v", "at"))
    strict = successions(own.select("field", "v").distinct(), precedence(values))
    links = own.join(broadcast_if_small(strict), ["field", "v"]).join(own.select(*GROUP, F.col("v").alias("later"), F.col("at").alias("later_at")), [*GROUP, "later"])
    links = cut(links.filter("at is null or later_at is null").select(*GROUP, "v", "at", "later", "later_at"))
    # an untimed value's place among the times: after the latest it follows, before the earliest that follows it
    after = links.filter("at is not null").groupBy(*GROUP, F.col("later").alias("v")).agg(F.max("at").alias("after"))
    until = links.filter("later_at is not null").groupBy(*GROUP, "v").agg(F.min("later_at").alias("until"))
    by_time = links.filter("later_at is not null").join(after, [*GROUP, "v"], "left").filter("after is null or later_at > after")
    by_value = links.filter("later_at is null").join(until.withColumnRenamed("v", "later"), [*GROUP, "later"], "left").filter("at is null or until is null or until > at")
    return by_time.select(*GROUP, "v").unionByName(by_value.select(*GROUP, "v")).distinct()


@finished
def surviving_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``fid, field, claim_id, value, source`` of the surviving claim of each fid and field.

    Order: authority over the field; with it the later vintage, without it the
    smaller accuracy_m (an unknown one last); equal sources by name. Within the
    source the topologically latest value: a timed one that has a later one is
    superseded, as is one that a learned succession puts before another. Of
    several latest, or if each is superseded by another, the latest time counts,
    an untimed one being earlier than any, then the greater claim_id. Groups
    without usable claim have no row. The choice is one aggregate with map-side
    combine, so no group is gathered.
    """
    v = cut(group_values(usable_claims(claims, sources)))
    gone = F.coalesce(F.col("at") < F.col("last_at"), F.lit(False))
    if not v.filter("at is null").isEmpty():
        v = v.join(superseded(v).withColumn("learned", F.lit(True)), [*GROUP, "v"], "left")
        gone = gone | F.coalesce("learned", F.lit(False))
    rank = F.struct(
        F.col("lawful").cast("int"),
        F.when(F.col("lawful"), F.coalesce(F.col("vintage").cast("double"), F.lit(-1e18))).otherwise(-F.coalesce("accuracy_m", F.lit(1e18))),
        F.when(F.col("lawful"), -F.coalesce("accuracy_m", F.lit(1e18))).otherwise(F.coalesce(F.col("vintage").cast("double"), F.lit(-1e18))),
        F.col("source"),
        ~gone,
        F.col("at"),
        F.col("claim.claim_id"),
    )
    best = v.groupBy("fid", "field").agg(F.max_by(F.struct("claim", "source"), rank).alias("b"))
    return best.select("fid", "field", "b.claim.claim_id", "b.claim.value", "b.source")


FIELDS = ("owner", "area", "land_use", "tenure", "khasra", "ulpin")


def surviving_records(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One record a fid, its fields the surviving values; null where no claim is usable."""
    s = surviving_claims(claims, sources)
    return s.groupBy("fid").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
