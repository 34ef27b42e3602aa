import numpy as np
import pytest

from plotweave.llm import resolution
from plotweave.operators.assignment import hungarian, sparse_assignment


def planted(n, seed):
    """A joined-up component: each left record meets several right ones next to it."""
    rng = np.random.default_rng(seed)
    left = np.repeat(np.arange(n), 4)
    pairs = np.unique(np.column_stack([left, (left + rng.integers(-5, 6, len(left))) % n]), axis=0)
    return pairs[:, 0], pairs[:, 1], rng.normal(12, 3, len(pairs))


def greatest(l, r, gain):
    m = np.zeros((l.max() + 1, r.max() + 1))
    np.maximum.at(m, (l, r), np.maximum(gain, 0))
    return sum(m[i, j] for i, j in hungarian(-m))


def table(spark, l, r, odds):
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(l, r, odds, strict=True)], "l long, r long, odds double")


def total(pairs, found, column="odds"):
    got = found.collect()
    assert len({x["l"] for x in got}) == len(got) == len({x["r"] for x in got})
    return found.join(pairs, ["l", "r"]).selectExpr(f"sum({column})").head()[0], len(got)


def test_sparse_against_dense():
    rng = np.random.default_rng(1)
    for k in range(150):
        l, r = np.nonzero(rng.random(rng.integers(1, 9, 2)) < 0.5)
        if len(l):
            gain = rng.integers(-2, 9, len(l)).astype(float) if k % 2 else rng.normal(3, 3, len(l))
            pick = sparse_assignment(l, r, gain)
            assert len(set(l[pick])) == len(pick) == len(set(r[pick]))
            assert gain[pick].sum() == pytest.approx(greatest(l, r, gain))
    assert len(sparse_assignment(np.empty(0, int), np.empty(0, int), np.empty(0))) == 0


def test_large_component_is_exact(spark):
    l, r, odds = planted(1600, 2)
    assert len(l) > 4900
    pairs = table(spark, l, r, odds)
    got, n = total(pairs, resolution.one_to_one(pairs))
    assert got + 10 * n == pytest.approx(greatest(l, r, 10 + odds), abs=1e-6)


def test_many_components_and_lone_pairs(spark):
    rows = [(10 * c + i, 10 * c + j, float((7 * c + 3 * i + 5 * j) % 11)) for c in range(60) for i in range(3) for j in range(3) if (i + j + c) % 4]
    rows += [(10_000 + i, 10_000 + i, 1.0) for i in range(50)]
    l, r, odds = (np.array(c) for c in zip(*rows, strict=True))
    pairs = table(spark, l, r, odds)
    got, n = total(pairs, resolution.one_to_one(pairs))
    want = sum(greatest(l[(l // 10) == c] % 10, r[(l // 10) == c] % 10, 10 + odds[(l // 10) == c]) for c in range(60)) + 50 * 11
    assert got + 10 * n == pytest.approx(want)
    assert resolution.one_to_one(pairs.limit(0)).count() == 0


def test_auction_stays_within_its_bound(spark):
    l, r, gain = planted(12, 3)
    pairs = table(spark, l, r, gain).withColumnRenamed("odds", "gain")
    got, n = total(pairs, resolution.auction(pairs, 0.5), "gain")
    assert greatest(l, r, gain) - 12 * 0.5 - 1e-9 <= got <= greatest(l, r, gain) + 1e-9
