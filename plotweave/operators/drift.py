"""Schemas that drift between the files of a source.

Each file's columns get a versioned fingerprint: presence, JSON type and the
hashes of the normalised content. Comparing a file with the one before it
gives explicit migration steps (rename, retype, add, remove); chaining the
steps from a source's first file on routes every record into one consistent
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..common import ceil_log2, cut, finished, spread
from .schema_match import LEXICON

#: Share of the smaller column's distinct values that must recur, from which two columns have the same content; with the
#: same field name by the word list, half of it.
SAME_CONTENT = 0.3

#: Words that name each field of a register: the schema matcher's, and what register files add.
_MORE_WORDS = {
    "khasra": ["plotno", "khsra num"],
    "owner": ["khatedar nm"],
    "area": ["area rec"],
    "tenure": ["tenure typ"],
    "ward": ["mohalla code"],
    "ulpin": ["bhu id"],
    "irrigated": ["irrigated", "is irrigated", "water", "sinchit"],
    "crop": ["crop", "crop name", "fasal"],
    "revenue": ["land revenue", "assessed tax", "lagan", "lagan rs"],
    "mutation": ["mutation no", "mut no", "dakhil kharij"],
    "survey_year": ["survey yr", "surveyed in", "yr", "year", "bandobast year"],
    "remark": ["remarks", "remark", "note text", "note", "kaifiyat"],
}
FIELD_WORDS = {f: [*LEXICON.get(f, []), *_MORE_WORDS.get(f, [])] for f in (*LEXICON, *(f for f in _MORE_WORDS if f not in LEXICON))}
#: Types of the consistent table; a value that doesn't cast becomes null there.
FIELD_TYPES = {"area": "double", "revenue": "double", "mutation": "bigint", "survey_year": "bigint", "ward": "bigint", "irrigated": "boolean"}


def name_words(c: Column) -> Column:
    """A key as words: separators and camel case to blanks, lower case."""
    s = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{M}0-9]+", " "))


def field_of(c: Column) -> Column:
    """Field that a key names by the word list, or null."""
    words = {w: f for f, ws in FIELD_WORDS.items() for w in ws}
    return F.element_at(F.create_map(*[F.lit(v) for k in words.items() for v in k]), name_words(c))


def normal_value(value: Column) -> Column:
    """Content of a value whatever its JSON type: 6, "W06" and "Ward 6" agree, as do false, "no" and 0."""
    s = F.lower(F.trim(value))
    num = r"^[a-z]{0,6}[-_ .]*([0-9][0-9,]*(?:\.[0-9]+)?)\s*[a-z.]{0,12}$"
    n = F.regexp_replace(F.regexp_extract(s, num, 1), ",", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    truth = F.when(s.isin("false", "no", "n"), "0").when(s.isin("true", "yes", "y"), "1")
    return F.coalesce(truth, F.when(s.rlike(num), plain), F.regexp_replace(s, r"\s+", " "))


def whole(v: Column) -> Column:
    """If a row, whose payload is ``v``, is a whole line of a file."""
    return F.col("source").isNotNull() & F.col("file_id").isNotNull() & v.isNotNull() & F.call_function("schema_of_variant", v).like("OBJECT%")


def cells_of(records: DataFrame) -> DataFrame:
    """``source, file_id, as_of, line, column, type, value``, one row for each key of each whole line.

    Lines that aren't a whole JSON object don't count; a repeated line counts
    once. ``type`` is number, string, boolean or other, and null with ``value``
    for a JSON null.
    """
    rows = records.select("source", "file_id", "as_of", F.expr("try_parse_json(payload)").alias("v"), F.xxhash64("payload").alias("line"))
    rows = rows.filter(whole(F.col("v"))).dropDuplicates(["source", "file_id", "line"])
    entry = rows.selectExpr("source", "file_id", "as_of", "line", "explode(map_entries(cast(v as map<string, variant>))) as e")
    kind = F.expr("schema_of_variant(e.value)")
    text = F.expr("cast(e.value as string)")
    t = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT|TINYINT|SMALLINT)"), "number").when(kind == "VOID", None).otherwise("other")
    return entry.select("source", "file_id", "as_of", "line", F.col("e.key").alias("column"), t.alias("type"), F.when(t.isNotNull(), text).alias("value"))


def fingerprints(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source, file_id, column, type, size`` of each column of each file, and ``source, file_id, column, h`` of its content.

    ``type`` is that of most non-null values (of equals the alphabetically last),
    null if there are none; ``size`` counts the distinct hashes ``h``. Counts
    combine before the shuffle, so a file with a third of all rows doesn't meet
    in one task.
    """
    keys = ["source", "file_id", "column"]
    per = cut(cells.groupBy(*keys, "type", F.xxhash64(normal_value(F.col("value"))).alias("h")).agg(F.count(F.lit(1)).alias("n")))
    types = per.groupBy(*keys, "type").agg(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))).alias("n")).groupBy(*keys).agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    hashes = per.filter(F.col("type").isNotNull()).select(*keys, "h").distinct()
    sizes = hashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return types.join(sizes, keys, "left").na.fill(0, ["size"]), hashes


def file_order(cells: DataFrame) -> DataFrame:
    """``source, file_id, prev_id, version``: files of a source in order of as_of, then file_id."""
    w = W.partitionBy("source").orderBy("as_of", "file_id")
    files = cells.groupBy("source", "file_id").agg(F.min("as_of").alias("as_of"))
    return files.select("source", "file_id", F.lag("file_id").over(w).alias("prev_id"), F.row_number().over(w).alias("version"))


def migrations(cells: DataFrame) -> DataFrame:
    """Steps between consecutive files: ``source, file_id, version, step, column, earlier, type, earlier_type``.

    ``step`` is added, removed, renamed or retyped. A rename pairs a column that
    vanished with one that appeared when each is the other's best in content.
    """
    prints, hashes = fingerprints(cells)
    prints = cut(prints)
    order = cut(file_order(cells))
    now = order.filter("prev_id is not null").join(prints, ["source", "file_id"])
    old = order.filter("prev_id is not null").join(prints.withColumnRenamed("file_id", "prev_id"), ["source", "prev_id"])
    k = ["source", "file_id", "version"]
    both = now.select(*k, "column", "type", "size").join(
        old.select(*k, "column", F.col("type").alias("earlier_type"), F.col("size").alias("earlier_size"), F.lit(True).alias("was")).withColumn("earlier", F.col("column")),
        [*k, "column"], "full",
    )
    both = cut(both)
    kept = both.filter("was and size is not null")
    fresh = both.filter("was is null").select(*k, "column", "type", "size")
    gone = both.filter("was and size is null").select(*k, "earlier", "earlier_type", "earlier_size")
    # values in common are counted whole, for columns that came against columns that went only
    came = hashes.join(fresh.select(*k, "column"), ["source", "file_id", "column"]).select(*k, "column", "h")
    went = gone.select(*k, "earlier").join(order.select("source", "file_id", "prev_id"), ["source", "file_id"])
    went = hashes.select("source", F.col("file_id").alias("prev_id"), F.col("column").alias("earlier"), "h").join(went, ["source", "prev_id", "earlier"]).select(*k, "earlier", "h")
    common = came.join(went, [*k, "h"]).groupBy(*k, "column", "earlier").agg(F.count(F.lit(1)).alias("common"))
    least = F.least("size", "earlier_size")
    score = F.when(least > 0, F.coalesce("common", F.lit(0)) / least).otherwise(0.0)
    alike = F.coalesce(field_of(F.col("column")) == field_of(F.col("earlier")), F.lit(False))
    pairs = fresh.join(gone, k).join(common, [*k, "column", "earlier"], "left").withColumn("score", score + alike.cast("double"))
    pairs = pairs.filter((F.col("score") >= F.when(alike, 1 + SAME_CONTENT / 2).otherwise(SAME_CONTENT)) | (alike & ((F.col("size") == 0) | (F.col("earlier_size") == 0))))
    best = lambda side: F.row_number().over(W.partitionBy(*k, side).orderBy(F.desc("score"), "column", "earlier"))
    renamed = pairs.withColumn("ra", best("column")).withColumn("rb", best("earlier")).filter("ra = 1 and rb = 1").select(*k, "column", "type", "earlier", "earlier_type")
    cols = [*k, "column", "earlier", "type", "earlier_type"]
    steps = lambda df, name: df.select(*k, F.lit(name).alias("step"), *cols[3:])
    retyped = kept.select(*cols).unionByName(renamed.select(*cols)).filter("type is not null and earlier_type is not null and type <> earlier_type")
    none = F.lit(None).cast("string")
    added = fresh.join(renamed.select(*k, "column"), [*k, "column"], "left_anti").select(*k, "column", none.alias("earlier"), "type", none.alias("earlier_type"))
    removed = gone.join(renamed.select(*k, "earlier"), [*k, "earlier"], "left_anti").select(*k, F.col("earlier").alias("column"), "earlier", none.alias("type"), "earlier_type")
    return steps(renamed, "renamed").unionByName(steps(retyped, "retyped")).unionByName(steps(added, "added")).unionByName(steps(removed, "removed"))


@finished
def drift_report(records: DataFrame) -> DataFrame:
    """``file_id, column_name, change``: one row per column that differs from the source's previous file.

    Empty for an empty table; a source's first file has no changes.
    """
    m = migrations(cut(cells_of(spread(records.select("source", "file_id", "as_of", "payload")))))
    return m.select("file_id", F.col("column").alias("column_name"), F.col("step").alias("change")).distinct()


@finished
def unmapped_columns(records: DataFrame) -> DataFrame:
    """``column_name, n_files`` of keys that no field's word list and no rename chain reaches, whichever way."""
    cells = cut(cells_of(records))
    f = column_fields(cells, migrations(cells))
    return f.filter("field is null").groupBy(F.col("column").alias("column_name")).agg(F.count_distinct("file_id").alias("n_files"))


def column_fields(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """``source, file_id, column, field, name``: the field each column holds, and the name of its rename chain.

    By the word list where it knows the key, else the field of the nearest
    version of the chain, earlier or later (of two equally near the earlier);
    null if none is known. ``name`` is the chain's first key; where chains of a
    source begin with the same key, all but the first add their first file.
    """
    cols = cells.select("source", "file_id", "column").distinct().join(file_order(cells), ["source", "file_id"])
    ren = steps.filter("step = 'renamed'").select("source", "file_id", "column", "earlier")
    # versions of a column are one chain: the name changes at renames, the chain number doesn't
    start = steps.filter("step = 'added'").select("source", "file_id", "column", F.lit(True).alias("start"))
    c = cols.join(ren, ["source", "file_id", "column"], "left").join(start, ["source", "file_id", "column"], "left")
    own = F.concat_ws("\u0001", F.col("file_id").cast("string"), F.col("column"))
    up = F.when((F.col("version") > 1) & F.col("start").isNull(), F.concat_ws("\u0001", F.col("prev_id").cast("string"), F.coalesce("earlier", "column")))
    c = cut(c.select("source", "file_id", "column", "version", own.alias("id"), F.coalesce(up, own).alias("up")))
    # pointer doubling: each round leads twice as many versions back, until all point to a chain's first
    ups = c.select("source", "id", "up")
    for _ in range(ceil_log2(c.agg(F.max("version")).head()[0] or 1)):
        ups = cut(ups.join(ups.select("source", F.col("id").alias("up"), F.col("up").alias("up2")), ["source", "up"]).select("source", "id", F.col("up2").alias("up")))
    c = c.drop("up").join(ups, ["source", "id"]).withColumn("f", field_of(F.col("column")))
    chain = W.partitionBy("source", "up").orderBy("version")
    at = F.when(F.col("f").isNotNull(), F.struct("version", "f"))
    c = c.withColumn("before", F.last(at, True).over(chain)).withColumn("after", F.first(at, True).over(chain.rowsBetween(0, W.unboundedFollowing)))
    later = F.col("before").isNull() | (F.col("after.version") - F.col("version") < F.col("version") - F.col("before.version"))
    c = c.withColumn("field", F.coalesce("f", F.when(later, F.col("after.f")), "before.f"))
    first = c.filter("id = up").select("source", "up", F.col("column").alias("key"), F.col("file_id").alias("since"), F.row_number().over(W.partitionBy("source", "column").orderBy("version")).alias("r"))
    name = F.when(F.col("r") == 1, F.col("key")).otherwise(F.concat_ws("@", "key", F.col("since").cast("string")))
    return c.join(first, ["source", "up"]).select("source", "file_id", "column", "field", name.alias("name"))


@finished
def consistent_records(records: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """One consistent table of all whole lines: ``record_id, file_id, source``, one column a field, and ``other``.

    ``other`` maps the chains that hold no known field, by their names, to the
    values; null if the line has none. Keys go through the chained renames, absent
    keys through the defaults (by field, as text; null without one), values
    through the fields' casts: a JSON null stays null, and so does a value that
    doesn't cast. A number keeps its unit text out: "0.4 bigha" casts as 0.4.
    """
    base = records.select("source", "file_id", "as_of", "payload", "record_id")
    cells = cut(cells_of(spread(base)))
    fields = column_fields(cells, migrations(cells))
    lines = base.filter(whole(F.expr("try_parse_json(payload)"))).select("record_id", "source", "file_id", F.xxhash64("payload").alias("line"))
    long = cells.join(fields, ["source", "file_id", "column"])
    other = F.when(F.col("field").isNull() & F.col("value").isNotNull(), F.struct("name", "value"))
    wide = long.groupBy("source", "file_id", "line").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELD_WORDS], F.collect_list(other).alias("other"), F.collect_set("field").alias("there"))
    out = lines.join(wide, ["source", "file_id", "line"], "left")
    for f, v in (defaults or {}).items():
        out = out.withColumn(f, F.when(F.coalesce(F.array_contains("there", f), F.lit(False)), F.col(f)).otherwise(F.lit(v)))
    out = out.withColumn("other", F.when(F.size("other") > 0, F.map_from_entries("other")))

    def cast(f: str) -> Column:
        t = FIELD_TYPES.get(f)
        n = normal_value(F.col(f))
        return (F.when(n == "1", True).when(n == "0", False) if t == "boolean" else n.try_cast(t) if t else F.col(f)).alias(f)

    return out.select("record_id", "file_id", "source", *[cast(f) for f in FIELD_WORDS], "other")
