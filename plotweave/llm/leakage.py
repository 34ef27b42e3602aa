"""Evaluation texts leaking into training text: a distributed positional inverted index.

The corpus is read as postings (term, document, position) of the terms that
the test items use. From each item's rarest terms the offset-adjusted lists
are intersected: terms of one passage lie at the same offset from it. What
survives is aligned word by word, which settles exact phrases and passages
with changed or inserted words alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..common import broadcast_if_small, cut, finished, spread

#: Words of an instruction that items share, from which it counts as standing, and the items that share it.
SHARED_WORDS, SHARED_ITEMS = 6, 4
#: Each run of SPAN item words contributes its ANCHORS rarest terms.
SPAN, ANCHORS = 5, 2
#: Anchors at one offset, and in the offsets up to DRIFT away, that make a candidate.
AT_OFFSET, NEARBY, DRIFT = 2, 3, 4
#: A passage counts with so many item words, its changed ends included, so many of them found in order, and at most
#: one in SINGLE of them changed or missing and as many put in; or with found ones outnumbering all these by LEAST_SCORE.
LEAST_SPAN, LEAST_FOUND, SINGLE, LEAST_SCORE = 12, 9, 4, 7
#: Weight of a found word in the alignment; a changed, missing or inserted one weighs 1 against it.
FOUND = 2
#: Weight that the best alignment of a passage has at least: nine words of a dozen found, one of them beyond changed
#: ones, three changed or missing and three put in. An alignment below it is not followed any further.
LEAST_WEIGHT = FOUND * (LEAST_FOUND - 1) - 2 * (LEAST_SPAN // SINGLE)
#: Words that a task aligns at once.
CELLS = 400_000
#: Words of margin around a candidate's place in the document.
MARGIN = 30


def words(text: Column) -> Column:
    """Words in order, whatever case, punctuation, spacing, line breaks and markup; empty for null."""
    s = F.regexp_replace(F.lower(text), "[­​-‏⁠﻿]", "")
    s = F.regexp_replace(s, "</?[a-z][^<>]{0,200}>|&[a-z]{2,8};|&#[0-9]+;", " ")
    w = F.split(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " "), " ")
    return F.coalesce(F.filter(w, lambda x: x != ""), F.array().cast("array<string>"))


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, pos, term, standing`` of each item word; ``standing`` inside an instruction many items share."""
    w = items.filter("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).select("item_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    here = W.partitionBy("item_id").orderBy("pos").rowsBetween(0, SHARED_WORDS - 1)
    w = w.withColumn("run", F.collect_list("term").over(here))
    shared = w.filter(F.size("run") == SHARED_WORDS).groupBy("run").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") >= SHARED_ITEMS).select("run", F.lit(1).alias("s"))
    back = W.partitionBy("item_id").orderBy("pos").rowsBetween(-(SHARED_WORDS - 1), 0)
    return w.join(shared, "run", "left").select("item_id", "pos", "term", F.max(F.coalesce("s", F.lit(0))).over(back).cast("boolean").alias("standing"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, pos`` of the given terms in every document (doc_id, w), whole texts."""
    p = docs.select("doc_id", F.posexplode("w").alias("pos", "term"))
    return p.join(broadcast_if_small(terms.select("term").distinct()), "term")


def own_words(items: DataFrame) -> DataFrame:
    """``item_id, own``: words of an item outside standing instructions."""
    return items.filter("not standing").groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("own"))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """``item_id, pos, term`` of the rarest terms in every run of SPAN words; of all words of an item shorter than LEAST_SPAN."""
    w = items.filter("not standing").join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = W.partitionBy("item_id").orderBy("pos").rowsBetween(0, SPAN - 1)
    rare = w.withColumn("r", F.sort_array(F.collect_list(F.struct("n", "pos")).over(run)))
    rare = rare.join(broadcast_if_small(own_words(items)), "item_id")
    picked = rare.select("item_id", F.explode(F.when(F.col("own") < LEAST_SPAN, F.col("r")).otherwise(F.slice("r", 1, ANCHORS))).alias("x")).select("item_id", F.col("x.pos").alias("pos")).distinct()
    return picked.join(w.select("item_id", "pos", "term"), ["item_id", "pos"])


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, offset``: places of documents (doc_id, w) where anchors of an item stand as they do in it."""
    vocabulary = items.filter("not standing").select("term").distinct()
    counts = cut(postings(docs, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    a = cut(anchors(items, counts))
    # a document's postings stay together, so its offsets need no further shuffle
    hits = postings(docs.repartition("doc_id"), a).join(broadcast_if_small(a.select("term", "item_id", F.col("pos").alias("ipos"))), "term")
    per = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    near = W.partitionBy("doc_id", "item_id").orderBy("offset").rangeBetween(-DRIFT, DRIFT)
    per = per.withColumn("around", F.sum("n").over(near)).join(broadcast_if_small(own_words(items)), "item_id")
    return per.filter((F.col("n") >= F.least(F.lit(AT_OFFSET), "own")) & (F.col("around") >= F.least(F.lit(NEARBY), "own"))).select("doc_id", "item_id", "offset")


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: item words spanned, words found, score.

    A found word weighs two changed, missing or inserted ones, so that a changed
    word next to an end doesn't cut the end off. Words changed at the ends
    themselves leave no trace: a span is widened up to LEAST_SPAN as far as both
    texts go on, over changed words to a lone found one, and if LEAST_FOUND are
    found, over changed ones alone. The score is the found words less the changed,
    missing and inserted ones.
    """
    n, m = len(item), len(doc)
    h = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        diag = h[i - 1, :-1] + np.where(doc == item[i - 1], FOUND, -1)
        row = np.maximum(np.maximum(np.concatenate([[0], diag]), h[i - 1] - 1), 0)
        h[i] = np.maximum.accumulate(row + steps) - steps
    i, j = divmod(int(h.argmax()), m + 1)
    weight, end, found, first = int(h[i, j]), i, 0, i
    room, start, stop = min(n - i, m - j), j, j
    while i and j and h[i, j] > 0:
        if item[i - 1] == doc[j - 1] and h[i, j] == h[i - 1, j - 1] + FOUND:
            found, first, start, i, j = found + 1, i, j, i - 1, j - 1
        elif h[i, j] == h[i - 1, j - 1] - 1:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    span, score = end - first + 1, found - (FOUND * found - weight)
    # a lone word beyond changed ones, and changed ends, up to the least span
    changes, left, right = LEAST_SPAN // SINGLE - (span - found), min(first, start) - 1, room
    for side in (-1, 1):
        at, to = (first - 2, start - 2) if side < 0 else (end, stop)
        for k in range(min(changes, LEAST_SPAN - span - 1, (left if side < 0 else right) - 1), 0, -1):
            if item[at + side * k] == doc[to + side * k]:
                span, found, score, changes = span + k + 1, found + 1, score + 1 - k, changes - k
                left, right = (left - k - 1, right) if side < 0 else (left, right - k - 1)
                break
    ends = max(0, min(LEAST_SPAN - span, left + right)) if found >= LEAST_FOUND else 0
    return span + ends, found, score - ends


def best_weights(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Weight of the best local alignment of each pair of word sequences, as ``align`` finds it, many pairs at once."""
    out = np.zeros(len(items), np.int32)
    order = np.argsort([len(d) for d in docs], kind="stable")
    at = 0
    while at < len(order):
        # pairs of like length together, so that little is padding
        wide = len(docs[order[min(len(order), at + 4_000) - 1]])
        pick = order[at : at + max(1, min(4_000, CELLS // (wide + 1)))]
        at += len(pick)
        m = max(len(docs[k]) for k in pick)
        n = max(len(items[k]) for k in pick)
        t, d = np.full((len(pick), n), -3, np.int32), np.full((len(pick), m), -4, np.int32)
        for row, k in enumerate(pick):
            t[row, : len(items[k])], d[row, : len(docs[k])] = items[k], docs[k]
        steps = np.arange(m + 1, dtype=np.int16)
        h = np.zeros((len(pick), m + 1), np.int16)
        top = np.zeros(len(pick), np.int16)
        for i in range(n):
            row = np.maximum(h - 1, 0)
            np.maximum(row[:, 1:], h[:, :-1] + np.where(d == t[:, i : i + 1], np.int16(FOUND), np.int16(-1)), out=row[:, 1:])
            h = np.maximum.accumulate(row + steps, axis=1) - steps
            np.maximum(top, h.max(axis=1), out=top)
        out[pick] = top
    return out


def counts(span, found, score):
    """If a passage of these figures, numbers or columns, is a leak."""
    single = (SINGLE * (span - found) <= span) & (SINGLE * (2 * found - score - span) <= span)
    return (span >= LEAST_SPAN) & (found >= LEAST_FOUND) & (single | (score >= LEAST_SCORE))


@finished
def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, span, found, score, own`` of every document that may hold a passage of an item.

    Left out are those whose best alignment weighs less than any passage's.

    Null and empty texts hold nothing; repeated item rows count once. An item
    shorter than LEAST_SPAN words counts where it is found whole: ``own`` is the
    number of its words.
    """
    iw = cut(item_words(items))
    # texts are split into words once: the index, its counts and the alignment read them
    split = cut(spread(docs.filter("text is not null").select("doc_id", "text")).select("doc_id", words(F.col("text")).alias("w")))
    cand = cut(candidates(split, iw))
    per = cand.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "offset")).alias("at"))
    # the item set is fixed; it goes along with the code of the alignment
    rows = iw.orderBy("item_id", "pos").collect()
    terms: dict[str, int] = {}
    texts: dict[int, list[int]] = {}
    for r in rows:
        texts.setdefault(r["item_id"], []).append(-2 if r["standing"] else terms.setdefault(r["term"], len(terms)))
    packed = docs.sparkSession.sparkContext.broadcast((terms, {k: np.array(v) for k, v in texts.items()}))
    found = spread(split.join(per, "doc_id")).select("doc_id", "w", "at")

    def run(batches):
        terms, texts = packed.value
        for b in batches:
            pairs: list[tuple] = []
            for d, w, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.fromiter((terms.get(x, -1) for x in w), np.int64, len(w))
                spots: dict[int, list[int]] = {}
                for x in at:
                    spots.setdefault(x["item_id"], []).append(x["offset"])
                for item, offs in spots.items():
                    t = texts[item]
                    own = t[t >= 0]
                    offs.sort()
                    group = [offs[0], offs[0]]
                    groups = [group]
                    for o in offs[1:]:
                        if o - group[1] > len(t):
                            group = [o, o]
                            groups.append(group)
                        group[1] = o
                    for lo, hi in groups:
                        part = ids[max(0, lo - MARGIN) : max(0, hi + len(t) + MARGIN)]
                        # no alignment finds more words than both texts have
                        if np.isin(own, part).sum() >= min(LEAST_FOUND, len(own)):
                            pairs.append((item, d, t, part, min(LEAST_WEIGHT, FOUND * len(own))))
            weight = best_weights([p[2] for p in pairs], [p[3] for p in pairs])
            best: dict[tuple, tuple] = {}
            for (item, d, t, part, least), w in zip(pairs, weight, strict=True):
                if w >= least:
                    best[item, d] = max(best.get((item, d), (0, 0, 0)), align(t, part), key=lambda x: (counts(*x), x[2]))
            out = [(*k, *v) for k, v in best.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]], names=["item_id", "doc_id", "span", "found", "score"])

    got = found.mapInArrow(run, "item_id bigint, doc_id bigint, span int, found int, score int")
    return got.join(broadcast_if_small(own_words(iw)), "item_id")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id`` of the leaks that count."""
    whole = (F.col("own") < LEAST_SPAN) & (F.col("found") == F.col("own")) & (F.col("score") == F.col("own"))
    return leaks(docs, items).filter(counts(F.col("span"), F.col("found"), F.col("score")) | whole).select("item_id", "doc_id").distinct()
