"""Quantities recorded in different units, brought to square metres.

Spellings of units are mapped once per distinct spelling: a character n-gram
inverted index proposes aliases, a weighted edit distance decides, and the
resulting dictionary is joined to all rows. Where no text names the unit, it
is inferred from the ratio of surveyed to recorded area and from the units
that prevail in the ward.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..common import DEVANAGARI_DIGITS, broadcast_if_small, clean_fid
from ..functions import kernel

# Square metres per unit.
AREA_UNITS = {
    "sqm": 1.0,
    "sq_yard": 0.836127,
    "sq_ft": 0.092903,
    "biswa": 126.44,
    "bigha": 2529.285,
    "acre": 4046.86,
    "hectare": 10000.0,
    "guntha": 101.17,
    "cent": 40.4686,
    "ground": 222.967,
}

# Known names of each unit, lower case, without filler words.
ALIASES = {
    "sqm": ["sqm", "sq m", "sq metre", "sq meter", "sq mtr", "square metre", "square meter", "square metres", "m2", "varg meter", "वर्ग मीटर", "वर्गमीटर"],
    "sq_yard": ["sq yard", "sq yd", "sq yards", "square yard", "square yards", "gaj", "varg gaj", "yard", "syd", "गज", "वर्ग गज"],
    "sq_ft": ["sq ft", "sq feet", "square feet", "square foot", "sft", "sqft", "varg fut", "fut", "वर्ग फुट", "वर्ग फीट"],
    "biswa": ["biswa", "bsw", "biswas", "bis", "bisva", "बिस्वा"],
    "bigha": ["bigha", "bgh", "bighas", "big", "bhigha", "बीघा"],
    "acre": ["acre", "acres", "ac", "acr", "एकड़"],
    "hectare": ["hectare", "hectares", "ha", "hect", "हेक्टेयर"],
    "guntha": ["guntha", "gunthas", "gunta", "gth", "gunth", "गुंठा"],
    "cent": ["cent", "cents", "cent 1 100 ac", "सेंट"],
    "ground": ["ground", "grounds", "grd", "ग्राउंड"],
    "biswansi": ["biswansi", "bwn", "biswansis", "bisvansi", "बिस्वांसी"],
}
# Words around a unit that say nothing about it.
FILLER = ["in", "me", "mein", "rakba", "total", "about", "approx", "as", "taped", "darj", "pucca", "pakka", "recorded", "area", "of", "extent", "के", "में", "रकबा", "कुल"]

#: A biswansi is a twentieth of a biswa.
SUB_FACTORS = {**AREA_UNITS, "biswansi": AREA_UNITS["biswa"] / 20}
#: Weighted edit cost per character of the longer name up to which a spelling is accepted.
ACCEPT = 0.34
#: Standard deviation of log(surveyed / recorded) within a unit, share of rows whose ratio says nothing,
#: and spread of log plot size, which then decides.
SIGMA, STRAY, SIZE_SIGMA = 0.045, 0.02, 0.45
#: Pseudo-count of each unit in a ward.
PRIOR = 0.5

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def spelled(c: Column) -> Column:
    """Unit text as compared: lower case, filler and punctuation gone, single spaces."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}0-9]+", " ")
    s = F.regexp_replace(s, r"(?<=^|\s)(?:" + "|".join(FILLER) + r")(?=\s|$)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _ngrams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), F.regexp_replace(c, " ", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 1, F.lit(1))), lambda i: F.substring(padded, i, 2)))


def _weight(ch: str) -> float:
    return 0.25 if ch == " " else 0.5 if ch in "aeiouािीुूेैोौंँ़्" else 1.0


def _cost(a: str, b: str) -> float:
    """Edit distance in which vowels, doubled letters and blanks cost less, and the first letter more."""
    weight = _weight
    row = [0.0]
    for ch in b:
        row.append(row[-1] + weight(ch))
    for i, x in enumerate(a):
        new = [row[0] + weight(x)]
        for j, y in enumerate(b):
            sub = 0.0 if x == y else max(weight(x), weight(y)) * (1.5 if i == j == 0 else 1.0)
            drop = weight(x) * (0.5 if i and a[i - 1] == x else 1.0)
            add = weight(y) * (0.5 if j and b[j - 1] == y else 1.0)
            new.append(min(row[j] + sub, row[j + 1] + drop, new[j] + add))
        row = new
    return row[-1]


def relative_cost(a: str, b: str, most: float = ACCEPT) -> float:
    """Edit cost per letter of the longer text; infinite where the surplus letters alone cost more than ``most``.

    A surplus letter is dropped, at half its weight if it is doubled, or changed
    at its weight or more; so a long remark never reaches the table of costs.
    """
    letters = max(len(a.replace(" ", "")), len(b.replace(" ", "")), 1)
    ca, cb = Counter(a), Counter(b)
    surplus = max(sum(_weight(ch) * n for ch, n in (x - y).items()) for x, y in ((ca, cb), (cb, ca)))
    return math.inf if surplus / 2 > most * letters else _cost(a, b) / letters


@F.arrow_udf(T.DoubleType())
def _relative_cost(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([relative_cost(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def unit_dictionary(spellings: DataFrame) -> DataFrame:
    """``(spelling, unit)`` of the distinct spellings that name a unit.

    ``spellings`` has one column, ``spelling``. The n-gram index over the alias
    list proposes candidates that share two-letter grams; the cheapest within
    ACCEPT wins, of equals the alphabetically first unit. Free remarks share
    too few letters with any name and get no row.
    """
    spark = spellings.sparkSession
    names = spark.createDataFrame([(a, u) for u, al in ALIASES.items() for a in al], "alias string, unit string")
    s = spellings.filter(F.col("spelling").isNotNull() & (F.col("spelling") != "")).distinct()
    index = names.withColumn("gram", F.explode(_ngrams(F.col("alias"))))
    post = s.withColumn("gram", F.explode(_ngrams(F.col("spelling"))))
    hits = post.join(F.broadcast(index), "gram").groupBy("spelling", "alias", "unit").agg(F.count(F.lit(1)).alias("shared"))
    hits = hits.withColumn("cost", _relative_cost("spelling", "alias")).filter(F.col("cost") <= ACCEPT)
    return hits.groupBy("spelling").agg(F.min(F.struct("cost", "unit")).alias("b")).select("spelling", F.col("b.unit").alias("unit"))


def _num(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def parse_note(note: Column) -> Column:
    """Entries of a remark as ``ARRAY<STRUCT<q, spelling>>``; ``q`` is null where only a unit is named.

    Understood: a unit alone, ``12.3 unit``, ``unit 12``, ``1 unit 2 unit`` and
    ``a-b-c (u-v-w)``. A sentence that mentions a quantity of something else
    ("boundary with 1 bigha tank") gives none, since words other than filler
    surround it.
    """
    t = F.trim(F.lower(F.translate(note, DEVANAGARI_DIGITS, "0123456789")))
    entry = lambda q, u: F.struct(q.alias("q"), spelled(u).alias("spelling"))
    none = F.lit(None).cast("double")
    head = r"^(?:total|rakba|area|रकबा|कुल)?\s*:?\s*"
    triple = r"^([0-9]+)\s*-\s*([0-9]+)\s*-\s*([0-9]+)\s*\(?\s*(\p{L}[\p{L}\p{M}]*)\.?\s*-\s*(\p{L}[\p{L}\p{M}]*)\.?\s*-\s*(\p{L}[\p{L}\p{M}]*)\.?\s*\)?$"
    unit = r"([^0-9]*?[\p{L}\p{M}][^0-9]*2?)"
    pair = head + f"({NUMBER})\\s*{unit}\\s*[,;]?\\s*({NUMBER})\\s*([^0-9]+)$"
    pair_rev = r"^([\p{L}\p{M}. ]+?)\s*:?\s*(" + NUMBER + r")\s*[,;]\s*([\p{L}\p{M}. ]+?)\s*:?\s*(" + NUMBER + r")$"
    one = head + f"({NUMBER})\\s*{unit}$"
    rev = r"^([\p{L}\p{M}. ]+?)\s*:?\s*(" + NUMBER + r")$"
    ex = lambda p, i: F.regexp_extract(t, p, i)
    return (
        F.when(t.rlike(triple), F.array(*[entry(_num(ex(triple, i)), ex(triple, i + 3)) for i in (1, 2, 3)]))
        .when(t.rlike(one), F.array(entry(_num(ex(one, 1)), ex(one, 2))))
        .when(t.rlike(pair), F.array(entry(_num(ex(pair, 1)), ex(pair, 2)), entry(_num(ex(pair, 3)), ex(pair, 4))))
        .when(t.rlike(pair_rev), F.array(entry(_num(ex(pair_rev, 2)), ex(pair_rev, 1)), entry(_num(ex(pair_rev, 4)), ex(pair_rev, 3))))
        .when(t.rlike(rev), F.array(entry(_num(ex(rev, 2)), ex(rev, 1))))
        .when((t != "") & t.isNotNull(), F.array(entry(none, t)))
        .otherwise(F.array().cast("array<struct<q:double,spelling:string>>"))
    )


def factor_of(unit: Column, factors: dict[str, float] = SUB_FACTORS) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for k in factors.items() for v in k]), unit)


def noted_areas(rows: DataFrame, keys: list[str], note: str) -> DataFrame:
    """``keys + (unit, quantity, sqm)`` that a remark states.

    ``quantity`` and ``sqm`` are null where the remark only names the unit. An
    entry in several units goes under the largest one with a quantity. Remarks
    without a unit have no row.
    """
    e = rows.select(*keys, F.posexplode(parse_note(F.col(note))).alias("at", "e")).select(*keys, "e.q", "e.spelling")
    named = e.join(broadcast_if_small(unit_dictionary(e.select("spelling"))), "spelling", "left")
    sqm = F.col("q") * factor_of(F.col("unit"))
    by_size = F.struct(F.when(F.coalesce(F.col("q"), F.lit(1.0)) > 0, factor_of(F.col("unit"))).otherwise(0.0), F.col("unit"))
    out = named.groupBy(*keys).agg(F.max(by_size).alias("b"), F.sum(sqm).alias("sqm"), F.max("q").alias("q"), F.max(F.col("unit").isNull()).alias("unknown"))
    unit = F.col("b.unit")
    return out.filter(~F.col("unknown")).select(*keys, F.when(unit == "biswansi", "biswa").otherwise(unit).alias("unit"), F.col("q").alias("quantity"), "sqm")


def infer_units(rows: DataFrame) -> DataFrame:
    """``(key, unit, confidence)`` of recorded values without a named unit.

    ``rows`` has key, value, surveyed (null if unknown), ward and ``named`` (the
    unit a remark gives, or null). A unit's likelihood is a normal density of
    log(surveyed / value / factor), mixed with that of the plot size it would
    mean; its prior is its share of the ward's rows, counted from named rows and
    from a first pass without ward. Statistics cover all rows.
    """
    units = list(AREA_UNITS)
    lv, ls = F.log("value"), F.when(F.col("surveyed") > 0, F.log("surveyed"))
    typical = rows.filter("surveyed > 0").agg(F.percentile_approx(F.log("surveyed"), 0.5, 10_000).alias("typical"))
    d = rows.filter("value > 0").crossJoin(F.broadcast(typical)).withColumn("typical", F.coalesce("typical", F.lit(math.log(150.0))))

    def density(u: str) -> Column:
        f = math.log(AREA_UNITS[u])
        size = F.exp(-F.pow((lv + f - F.col("typical")) / SIZE_SIGMA, 2) / 2) / SIZE_SIGMA + 1e-12
        near = F.exp(-F.pow((ls - lv - f) / SIGMA, 2) / 2) / SIGMA
        return F.when(ls.isNull(), size).otherwise((1 - STRAY) * near + STRAY * size)

    d = d.withColumn("dens", F.array(*[density(u) for u in units]))
    argmax = lambda a: F.element_at(F.array(*[F.lit(u) for u in units]), F.array_position(a, F.array_max(a)).cast("int"))
    d = d.withColumn("first", F.coalesce("named", argmax(F.col("dens"))))
    share = d.groupBy("ward").agg(*[F.sum((F.col("first") == u).cast("double")).alias(f"n_{u}") for u in units])
    d = d.join(share, d["ward"].eqNullSafe(share["ward"])).drop(share["ward"])
    post = F.array(*[F.element_at("dens", i + 1) * (F.col(f"n_{u}") + PRIOR) for i, u in enumerate(units)])
    d = d.withColumn("post", post)
    total = F.aggregate("post", F.lit(0.0), lambda s, v: s + v)
    return d.filter(F.col("named").isNull()).select("key", argmax(F.col("post")).alias("unit"), (F.array_max("post") / total).alias("confidence"))


def ward_key(c: Column) -> Column:
    """Ward number, whatever its spelling; null if there is none."""
    n = F.regexp_extract(F.translate(c, DEVANAGARI_DIGITS, "0123456789"), "([0-9]+)", 1)
    return F.when(n != "", n.cast("int"))


def legacy_areas(legacy: DataFrame) -> DataFrame:
    """``fid, area_unit, area_sqm DOUBLE, recorded, confidence`` of every legacy record with an area.

    The recorded area is AREA_BIGHA if positive; its unit is the one AREA_NOTE
    names, else inferred. Where AREA_BIGHA is null, it is the quantity in
    AREA_NOTE. Null, zero and negative areas without such a note have no row.
    Repeated rows of a fid collapse.
    """
    rows = legacy.select(
        clean_fid("fid").alias("key"), F.col("AREA_BIGHA").alias("value"), F.col("AREA_NOTE").alias("note"), ward_key(F.col("WARD")).alias("ward"), kernel.outline("geom").getField("area").alias("surveyed")
    ).filter("key is not null and (value > 0 or (value is null and note is not null))")
    rows = rows.groupBy("key").agg(F.max(F.struct("value", "note", "surveyed", "ward")).alias("r")).select("key", "r.*")
    noted = noted_areas(rows.filter("note is not null"), ["key"], "note").withColumnRenamed("unit", "noted")
    d = rows.join(noted, "key", "left")
    # a note that states its own quantity beside a value isn't the value's unit
    named = F.when(F.col("quantity").isNull(), F.col("noted"))
    guess = infer_units(d.filter("value > 0").select("key", "value", "surveyed", "ward", named.alias("named")))
    d = d.withColumn("named", named).join(guess, "key", "left")
    unit = F.when(F.col("value").isNull(), F.col("noted")).otherwise(F.coalesce("named", "unit"))
    sqm = F.when(F.col("value").isNull(), F.col("sqm")).otherwise(F.col("value") * factor_of(unit))
    d = d.filter(F.col("value").isNotNull() | (F.col("quantity") > 0))
    return d.select(
        F.col("key").alias("fid"), unit.alias("area_unit"), sqm.alias("area_sqm"), F.coalesce("value", "quantity").alias("recorded"),
        F.when(F.col("value").isNull() | F.col("named").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
    ).filter("area_unit is not null and area_sqm is not null")


def claim_areas(claims: DataFrame) -> DataFrame:
    """``claim_id, area_unit, area_sqm`` of claims of field area; a bare number is in square metres."""
    rows = claims.filter(F.lower(F.trim("field")) == "area").select("claim_id", F.col("value").alias("note")).dropDuplicates(["claim_id"])
    bare = _num(F.trim(F.translate(F.col("note"), DEVANAGARI_DIGITS, "0123456789")))
    rows = rows.withColumn("bare", bare)
    noted = noted_areas(rows.filter("bare is null and note is not null"), ["claim_id"], "note").filter("quantity > 0")
    return rows.filter("bare > 0").select("claim_id", F.lit("sqm").alias("area_unit"), F.col("bare").alias("area_sqm")).unionByName(
        noted.select("claim_id", F.col("unit").alias("area_unit"), F.col("sqm").alias("area_sqm"))
    )
