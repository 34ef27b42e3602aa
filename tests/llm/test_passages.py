import random

import numpy as np
import pytest

from plotweave.llm import leakage


def planted(rng, n, changed, inserted):
    """An item, and a document holding n of its words with single ones changed and put in."""
    item = list(range(1000, 1040))
    at = rng.randrange(0, 40 - n)
    part = item[at : at + n]
    for i in rng.sample(range(n), changed):
        part[i] = -1
    for _ in range(inserted):
        part.insert(rng.randrange(1, len(part)), -1)
    noise = lambda: [rng.choice([-1, -1, -1, *item]) if rng.random() < 0.1 else -1 for _ in range(30)]
    return np.array(item), np.array(noise() + part + noise())


@pytest.mark.parametrize(("n", "changed", "inserted"), [(12, 0, 0), (12, 1, 0), (12, 2, 0), (12, 3, 0), (12, 1, 1), (12, 1, 3), (14, 3, 0), (18, 4, 2)])
def test_planted_passages(n, changed, inserted):
    rng = random.Random(n * 100 + changed * 10 + inserted)
    got = [leakage.counts(*leakage.align(*planted(rng, n, changed, inserted))) for _ in range(300)]
    assert sum(got) >= 297


def test_weights_of_many_at_once():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(300)]
    docs = [rng.integers(0, 30, rng.integers(1, 90)) for _ in items]
    for i, d, w in zip(items, docs, leakage.best_weights(items, docs), strict=True):
        h = np.zeros((len(i) + 1, len(d) + 1), int)
        for a in range(1, len(i) + 1):
            for b in range(1, len(d) + 1):
                h[a, b] = max(0, h[a - 1, b - 1] + (leakage.FOUND if i[a - 1] == d[b - 1] else -1), h[a - 1, b] - 1, h[a, b - 1] - 1)
        assert w == h.max()
    assert len(leakage.best_weights([], [])) == 0


@pytest.mark.parametrize(("n", "changed", "inserted"), [(12, 3, 0), (12, 1, 3), (12, 3, 3), (14, 3, 0), (18, 4, 2)])
def test_passages_weigh_enough(n, changed, inserted):
    rng = random.Random(n + changed)
    for _ in range(200):
        item, doc = planted(rng, n, changed, inserted)
        assert not leakage.counts(*leakage.align(item, doc)) or leakage.best_weights([item], [doc])[0] >= leakage.LEAST_WEIGHT


def test_no_passages():
    rng = random.Random(5)
    for n in (14, 30):
        item = list(range(n))
        for _ in range(200):
            other = item[:]
            rng.shuffle(other)
            assert not leakage.counts(*leakage.align(np.array(item), np.array([-1] * 20 + other + [-1] * 20)))
    for n in range(3, 9):
        assert not leakage.counts(*leakage.align(np.arange(40), np.array([-1] * 20 + list(range(10, 10 + n)) + [-1] * 20)))


def test_short_items_count_where_they_are_whole(spark):
    items = spark.createDataFrame([(1, "only three words"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, "solo pair")], "item_id long, text string")
    docs = [(10, "so Only three, words stood here"), (11, "only three other words"), (12, "x alpha beta gamma delta epsilon zeta eta y"), (13, "alpha beta gamma delta zeta eta"), (14, "a solo pair"), (15, "pair solo")]
    assert {tuple(r) for r in leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()} == {(1, 10), (2, 12), (3, 14)}
