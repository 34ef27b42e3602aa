"""String similarity for land-record attributes: native expressions where Spark has them, Arrow kernels else."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Romanised spellings that fold to one name, applied in this order.
NAME_FOLDS = [
    (["mohammad", "mohammed", "muhammad", "mohd", "md"], "mohammad"),
    (["abdool", "abdul"], "abdul"),
    (["kureshi", "qureshi", "qurashi"], "qureshi"),
    (["sing", "singh"], "singh"),
    (["sarma", "sharma", "shrama"], "sharma"),
    (["varma", "verma"], "verma"),
    (["gupt", "gupta"], "gupta"),
    (["chouhan", "chauhan", "chowhan"], "chauhan"),
    (["jadav", "yadav", "yadaw"], "yadav"),
    (["agarwal", "aggarwal", "agrawal"], "agarwal"),
    (["misra", "mishra"], "mishra"),
    (["ansaari", "ansari"], "ansari"),
    (["kr", "kumar"], "kumar"),
    (["tiwary", "tiwari", "tewari"], "tiwari"),
]
# Fixed value: son, wife or daughter of, in any spelling.
RELATION = r"\b([swd])\s*[/\.]?\s*o\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_name(c) -> Column:
    """Name as compared: lower case, relation words as s/o, w/o, d/o, known spellings folded; "" for null."""
    s = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    s = F.regexp_replace(s, RELATION, "$1/o")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9/\s]", " "), r"\s+", " "))
    for names, to in NAME_FOLDS:
        s = F.regexp_replace(s, r"\b(?:" + "|".join(names) + r")\b", to)
    return s


def tokenise(c) -> Column:
    """Column name as words: separators and camel case to blanks, lower case."""
    s = F.regexp_replace(col(c), r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, r"[_\-]+", " ")), r"\s+", " "))


def token_set_ratio(a, b) -> Column:
    """Jaccard of the sets of blank-separated words; 1 if both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / u)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro-Winkler with the prefix boost at every similarity."""
    j = _jaro(a, b)
    k = 0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return j + k * weight * (1 - j)


def _pairwise(fn):
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        # a pair of values recurs a lot: compare each distinct one once
        seen: dict[tuple, float] = {}
        out = np.empty(len(a))
        for i, k in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
            if k not in seen:
                seen[k] = fn(k[0] or "", k[1] or "")
            out[i] = seen[k]
        return pa.array(out)

    return run


jaro_winkler = _pairwise(jaro_winkler_text)
levenshtein_ratio = _pairwise(lambda a, b: SequenceMatcher(None, a, b).ratio())
levenshtein_ratio.__doc__ = "Matching-block ratio of two strings (Ratcliff and Obershelp), not an edit distance."


def name_similarity(a, b) -> dict[str, Column]:
    """name_jw, name_lev, name_tok, name_present of two raw names; all 0 if either folds to nothing."""
    x, y = normalise_name(a), normalise_name(b)
    ok = (x != "") & (y != "")
    z = lambda c: F.when(ok, c).otherwise(0.0)
    return {"name_jw": z(jaro_winkler(x, y)), "name_lev": z(levenshtein_ratio(x, y)), "name_tok": z(token_set_ratio(x, y)), "name_present": ok.cast("double")}


# Fixed value: a plot number with its optional child and sub numbers.
KHASRA = r"(\d+)(?:\s*/\s*(\d+))?(?:\s*-\s*(\d+))?"


def parse_khasra(c) -> Column:
    """``STRUCT<parent, child, sub>`` of the first plot number in a text; missing parts are null."""
    part = lambda i: F.regexp_extract(col(c).cast("string"), KHASRA, i).try_cast("bigint")
    return F.struct(part(1).alias("parent"), part(2).alias("child"), part(3).alias("sub"))


def khasra_similarity(a, b) -> dict[str, Column]:
    """kh_exact, kh_parent, kh_child, kh_present; exact ignores the sub number, child equality the parent."""
    x, y = parse_khasra(a), parse_khasra(b)
    ok = x.getField("parent").isNotNull() & y.getField("parent").isNotNull()
    parent = x.getField("parent") == y.getField("parent")
    child_eq = x.getField("child").eqNullSafe(y.getField("child"))
    child = F.coalesce(x.getField("child") == y.getField("child"), F.lit(False))
    z = lambda c: F.coalesce(ok & c, F.lit(False)).cast("double")
    return {"kh_exact": z(parent & child_eq), "kh_parent": z(parent), "kh_child": z(child), "kh_present": ok.cast("double")}


def normalise_key(c) -> Column:
    """Folded form of a value: name folding if it has a letter, else trimmed lower case."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(s.rlike("[A-Za-z]"), normalise_name(s)).otherwise(F.lower(F.trim(s)))


def as_number(c) -> Column:
    """DOUBLE of a numeric text, else null; "nan" and "inf" aren't numbers here."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


def claim_similarity(a, b) -> Column:
    """1 - |a - b| / max for two numbers, else Jaro-Winkler of the folded names."""
    x, y = as_number(a), as_number(b)
    top = F.greatest(F.abs(x), F.abs(y))
    return F.when(x.isNotNull() & y.isNotNull(), 1 - F.least(F.abs(x - y) / F.greatest(top, F.lit(1e-9)), F.lit(1.0))).otherwise(jaro_winkler(normalise_name(a), normalise_name(b)))


# Characters that a latin-1 page can't hold, and what stands for them.
PAGE_FOLDS = {
    "—": "-", "–": "-", "→": "->", "…": "...", "·": "-", "²": "2", "³": "3", "’": "'", "“": '"', "”": '"', "‘": "'", "₹": "Rs ", "σ": "sigma", "≥": ">=", "≤": "<=", "×": "x",
}


def latin1_fold(c) -> Column:
    """Text that a latin-1 page can hold; what has no stand-in becomes "?"."""
    s = col(c)
    for a, b in PAGE_FOLDS.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r"[^\x00-\u00ff]", "?")
