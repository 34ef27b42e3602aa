"""Abusive, hateful or sexual content: noisy-channel restoration, then a trained score.

Disguised spellings are restored by Viterbi decoding: each written character
may stand for several plain ones (leetspeak, masks), may be a repetition, or
may be a separator that stands between the letters of one word or between
words; a character trigram model of the whole corpus says which reading is
likely. The restored sentences are scored by a log-linear model over word
n-grams, fitted here on labelled rows. A document scores as its worst
sentence, so one insult in a long text counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..common import spread

#: Labelled documents the score is fitted on: the bound on what the driver holds.
TRAIN_ROWS = 20_000
#: One labelled document in so many is held out, to choose the threshold on.
HOLD_OUT = 5
BITS = 18
ROUNDS = 2
EPOCHS = 50
L2 = 2e-6
#: Sentences longer than this many words are scored in windows that overlap by half.
WINDOW = 40
#: Distinct words, or disguises, that a task remembers before it starts afresh.
REMEMBERED = 200_000

# Plain letters a written character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
# Look-alikes of Latin letters in other scripts.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαεορνικτυ", "aeopcyxijsdhqwbkmhtaeopviktu")
#: Prices of the channel: a substituted letter, a masked one, a dropped repetition, a separator inside a word, one between words.
SWAP, MASK, REPEAT, JOIN, BREAK = 0.7, 1.0, 0.4, 0.2, 0.2
#: Weight of a trigram that the corpus doesn't have.
UNSEEN = 0.02

_INVISIBLE = re.compile("[­͏​-‏‪-‮⁠-⁤﻿]")
_LETTERS = "a-z\u0904-\u0939\u0958-\u0961"
_SIGNS = "\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963"
# tokens with a written sign among letters, and words with a letter three times over
_SIGNED = re.compile(r"(?<![a-z0-9@$!|*+€\u0900-\u0963])[a-z\u0900-\u0963]*+[0-9@$!|*+€][a-z0-9@$!|*+€\u0900-\u0963]+")
_THRICE = re.compile(rf"([{_LETTERS}])\1\1")
_STRETCHED = re.compile(rf"[{_LETTERS}{_SIGNS}]*([{_LETTERS}])\1\1[{_LETTERS}{_SIGNS}]*")
# single letters with something between them; what that is the lattice says
_PIECE = rf"(?:[{_LETTERS}][{_SIGNS}]*|[0134579@$!*])"
_APART = re.compile(rf"(?<![^\W_]){_PIECE}(?:(?:[ .\-_*~]|  ){_PIECE}){{2,}}(?![^\W_])")
_SEPARATORS = frozenset(" .-_~")
_ALIEN = re.compile("[\u0370-\u052f]")
_NUMBERED = re.compile(r"[a-z]?[0-9]+[a-z]?|w[0-9]+|[0-9]+(?:st|nd|rd|th|m|am|pm|km|bis|sqm)")
_NUMBER = "\ue000"
_WORD = re.compile(r"(?:[^\W_]|\ue000)+(?:[ऀ-ॿ]*(?:[^\W_]|\ue000)*)*|[ऀ-ॿ]+")
_SENTENCE = re.compile(r"[.!?।॥\n\r…]+(?=\s|$)|[\n\r]+")
_DIGITS = re.compile(r"[0-9०-९]+")


@dataclass
class CharModel:
    """Character trigrams of plain words, Latin and Devanagari; a blank stands for a word's ends.

    ``tri`` has the log probability of the trigrams that occur, ``rest`` that of
    any other letter after two, ``after`` the letters that follow them.
    """

    tri: dict[str, float]
    rest: dict[str, float]
    after: dict[str, str]
    default: float
    memory: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(trigrams: dict[str, float]) -> CharModel:
        letters = len({c for t in trigrams for c in t}) + 1
        total: dict[str, float] = defaultdict(float)
        after: dict[str, str] = defaultdict(str)
        for t, n in trigrams.items():
            total[t[:2]] += n
            after[t[:2]] += t[2].strip()
        log = lambda n, ab: math.log((n + UNSEEN) / (total.get(ab, 0.0) + UNSEEN * letters))
        return CharModel({t: log(n, t[:2]) for t, n in trigrams.items()}, {ab: log(0.0, ab) for ab in total}, dict(after), math.log(1 / letters))

    @staticmethod
    def of_words(words: dict[str, float]) -> CharModel:
        n: dict[str, float] = defaultdict(float)
        for w, k in words.items():
            for i in range(len(w) + 1):
                n[f"  {w} "[i : i + 3]] += k
        return CharModel.of(n)

    def logp(self, ab: str, c: str) -> float:
        p = self.tri.get(ab + c)
        return p if p is not None else self.rest.get(ab, self.default)

    def decoded(self, token: str) -> str:
        """``viterbi`` once for each distinct token."""
        got = self.memory.get(token)
        if got is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            got = self.memory[token] = viterbi(token, self)
        return got


def viterbi(token: str, model: CharModel) -> str:
    """Likeliest plain words behind a written token.

    States are the last two letters; an edge costs what the channel charges for
    a substitution, a masked letter, a dropped repetition, a separator inside a
    word or one that ends it. A token with a character that stands for no letter
    stays as it is.
    """
    best: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for ch in token:
        new: dict[str, tuple[float, str]] = {}

        def reach(state: str, score: float, out: str, new=new) -> None:
            if score > new.get(state, (-1e18, ""))[0]:
                new[state] = (score, out)

        plain = "a" <= ch <= "z" or "\u0900" <= ch <= "\u0963"
        for ab, (s, out) in best.items():
            options = [(ch, 0.0)] if plain else [(x, SWAP) for x in LEET.get(ch, "")] if ch != "*" else [(x, MASK) for x in model.after.get(ab, "")]
            for x, price in options:
                reach(ab[1] + x, s - price + model.logp(ab, x), out + x)
                if x == ab[1]:
                    reach(ab, s - REPEAT - price, out)
            if ch in _SEPARATORS or ch == "*":
                reach(ab, s - JOIN, out)
                if ab[1] != " ":
                    reach("  ", s - BREAK + model.logp(ab, " "), out + " ")
        if not new:
            return token
        best = new
    return max((s + (model.logp(ab, " ") if ab[1] != " " else 0.0), out) for ab, (s, out) in best.items())[1].strip()


def restore(text: str, model: CharModel) -> str:
    """Text with disguises undone: invisible characters, look-alikes, then what the lattice reads as leetspeak, repetition and spacing."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    s = s.lower()
    if _ALIEN.search(s):
        s = re.sub(r"[^\W\d_]+", lambda m: m[0].translate(LOOKALIKE) if re.search("[a-z]", m[0]) or re.fullmatch("[аеорсухіјѕԁһԛԝ]+", m[0]) else m[0], s)

    def apart(m: re.Match) -> str:
        # a row of figures with a letter or so is a measure
        letters, digits = sum(c.isalpha() for c in m[0]), sum(c.isdigit() for c in m[0])
        pieces = sum(c not in _SEPARATORS for c in m[0])
        return model.decoded(m[0]) if letters >= 2 and pieces >= 2 * digits else m[0]

    def signed(m: re.Match) -> str:
        w = m[0]
        core = w.rstrip("!|+")
        if _NUMBERED.fullmatch(w) or not (re.search(rf"[{_LETTERS}]", core) and re.search("[@$!|0-9*+€]", core) or re.fullmatch(r"[@$][a-z0-9@$!]+", core)):
            return w
        return model.decoded(core) + w[len(core) :]

    s = _SIGNED.sub(signed, _APART.sub(apart, s))
    return _STRETCHED.sub(lambda m: model.decoded(m[0]), s) if _THRICE.search(s) else s


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, numbers as one symbol; long ones as overlapping windows."""
    out = []
    for s in _SENTENCE.split(_DIGITS.sub(_NUMBER, text)):
        w = _WORD.findall(s or "")
        if len(w) > WINDOW:
            out += [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
        elif w:
            out.append(w)
    return out


class Words:
    """Numbers of words, each hashed once while it is remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def features(sents: list[list[str]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word 1- to 3-grams and pairs one word apart of all sentences, and the sentence of each."""
    n = np.fromiter(map(len, sents), np.int64, len(sents))
    h = words.numbers([w for s in sents for w in s])
    of = np.repeat(np.arange(len(sents)), n)
    a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    two, three = of[1:] == of[:-1], of[2:] == of[:-2]
    p, q, r = h[:-1][two], h[1:][two], h[:-2][three]
    mid, end = h[1:-1][three], h[2:][three]
    grams = [h * a, (p * b) ^ (q * c), (r * b) ^ (mid * c) ^ (end * a), (r * c) ^ (end * b)]
    flat = np.concatenate(grams)
    flat = ((flat ^ (flat >> np.uint64(29))) * b >> np.uint64(64 - BITS)).astype(np.int64)
    return flat, np.concatenate([of, of[:-1][two], of[:-2][three], of[:-2][three]])


def sentence_scores(flat: np.ndarray, of: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each of n sentences."""
    size = np.bincount(of, minlength=n)
    return np.bincount(of, weights=weights[flat], minlength=n) / np.sqrt(np.maximum(size, 1)) + bias


@dataclass
class Scorer:
    chars: CharModel
    weights: np.ndarray
    bias: float
    threshold: float

    def scores(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        """Probability of each text's worst sentence; 0 for null, empty and wordless texts."""
        per = [sentences(restore(t, self.chars)) if t else [] for t in texts]
        sents = [s for d in per for s in d]
        top = np.full(len(texts), -np.inf)
        if sents:
            z = sentence_scores(*features(sents, words or Words()), len(sents), self.weights, self.bias)
            np.maximum.at(top, np.repeat(np.arange(len(texts)), [len(d) for d in per]), z)
        return np.where(np.isinf(top), 0.0, 1 / (1 + np.exp(-np.clip(top, -30, 30))))


def _fit(flat: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows scaled by the root of their size, by full-batch Adam."""
    rows = len(y)
    val = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=rows), 1))[of]
    w, b = np.zeros(1 << BITS), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for t in range(1, EPOCHS + 1):
        z = np.bincount(of, weights=w[flat] * val, minlength=rows) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        gw = np.bincount(flat, weights=g[of] * val, minlength=len(w)) + L2 * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.3 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.3 * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


def fit_scorer(texts: list[str], labels: list[int], chars: CharModel, held: list[bool] | None = None) -> Scorer:
    """Fit on documents: at first the sentences whose n-grams lean to positive documents, then the model's own.

    Labels are of documents and partly wrong; only the sentences that repeat
    across positive documents and not across negative ones can pull weight. The
    threshold is chosen on the held-out documents, which the fit doesn't see.
    """
    held = held if held is not None and any(held) else [False] * len(texts)
    own = [i for i, h in enumerate(held) if not h]
    docs = [sentences(restore(texts[i], chars)) for i in own]
    y = np.array([labels[i] for i in own], np.int64)
    sents = [x for d in docs for x in d]
    doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat, of = features(sents, Words())
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    once = np.unique(doc_of[of] << BITS | flat) if len(flat) else np.empty(0, np.int64)
    in_positive = y[once >> BITS] == 1
    pos, neg = (np.bincount(once[k] & ((1 << BITS) - 1), minlength=1 << BITS) for k in (in_positive, ~in_positive))
    odds = np.log((pos + 0.3) / (n1 + 0.6)) - np.log((neg + 0.3) / (n0 + 0.6))
    odds[pos < 2] = np.minimum(odds[pos < 2], 0)
    mine = y[doc_of]
    z = np.bincount(of, weights=np.clip(odds, -1, 3)[flat], minlength=len(sents)) / np.maximum(np.bincount(of, minlength=len(sents)), 1)
    target = (mine == 1) & (z > 0.8)
    w, b = np.zeros(1 << BITS), -30.0
    for _ in range(ROUNDS):
        if not target.any():
            break
        use = (mine == 0) | target | ((mine == 1) & (z < 0.2))
        weight = np.where(target, min(8.0, max(1.0, (~target).sum() / target.sum() / 8)), 1.0)
        row = np.cumsum(use) - 1
        keep = use[of]
        w, b = _fit(flat[keep], row[of[keep]], target[use].astype(float), weight[use])
        z = sentence_scores(flat, of, len(sents), w, b)
        target, z = (mine == 1) & (z > 0), z / 4
    out = Scorer(chars, w.astype(np.float32), float(b), 0.5)
    trial = [i for i, h in enumerate(held) if h] or own
    scores, yt = out.scores([texts[i] for i in trial]), np.array([labels[i] for i in trial])
    best = (0.0, 0.5)  # of equally good thresholds the highest
    for t in np.arange(0.3, 0.96, 0.05):
        tp, fp, fn = ((scores >= t) & (yt == 1)).sum(), ((scores >= t) & (yt == 0)).sum(), ((scores < t) & (yt == 1)).sum()
        best = max(best, (round(2 * tp / max(1, 2 * tp + fp + fn), 9), float(t)))
    out.threshold = best[-1]
    return out


def corpus_characters(docs: DataFrame) -> CharModel:
    """Character trigrams of all plain words of the corpus, Latin and Devanagari.

    Words are counted over all documents and weigh by the root of their count;
    words with a letter three times over don't count. What reaches the driver
    are sums of trigrams, whose number the alphabets bound.
    """
    words = docs.filter("text is not null").select(F.explode(F.split(F.lower("text"), rf"[^a-z\u0900-\u0963]+")).alias("w")).filter(F.length("w") > 1)
    counts = words.groupBy("w").agg(F.sqrt(F.count(F.lit(1))).alias("n")).filter(~F.col("w").rlike(r"(.)\1\1"))
    padded = F.concat(F.lit("  "), "w", F.lit(" "))
    tri = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, 3))).alias("t"), "n")
    return CharModel.of({r["t"]: r["n"] for r in tri.groupBy("t").agg(F.sum("n").alias("n")).collect()})


def label_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """At most ``rows`` labelled documents, by a hash of their id; majority label, ties and nulls left out; one in HOLD_OUT is ``held``."""
    vote = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("p")).filter("p <> 0.5")
    vote = vote.orderBy(F.xxhash64("doc_id")).limit(rows)
    texts = docs.filter("text is not null").select("doc_id", "text").join(vote, "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), HOLD_OUT) == 0
    return texts.select("doc_id", "text", (F.col("p") > 0.5).cast("int").alias("y"), held.alias("held")).orderBy("doc_id", "text").collect()


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    got = label_sample(docs, labels)
    return fit_scorer([r["text"] for r in got], [r["y"] for r in got], corpus_characters(docs), [r["held"] for r in got])


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, source, score, abusive`` of every row; texts are read whole."""
    spark: SparkSession = docs.sparkSession
    scorer.chars.memory.clear()
    model = spark.sparkContext.broadcast(scorer)

    def run(batches):
        s, words = model.value, Words()
        for b in batches:
            got = s.scores(b.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array(got >= s.threshold)], names=["doc_id", "source", "score", "abusive"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("abusive", T.BooleanType())])
    return spread(docs.select("doc_id", "source", "text")).mapInArrow(run, schema)


def source_rates(scored: DataFrame) -> DataFrame:
    """``source, n_docs, n_abusive, rate, mean_score``; documents without source come under null."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
