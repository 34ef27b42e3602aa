import time

import numpy as np

from plotweave.functions import overlay as o
from plotweave.operators import topology

RINGS = [[(0, 0), (4, 0), (4, 3), (0, 3)], [(0, 0), (2, 0), (4, 0), (4, 3)], [(0, 3), (4, 3), (4, 0), (0, 0)], [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], [(0, 0), (1, 0), (2, 0)]]


def test_batch_repair_gives_what_single_repair_gives():
    sets = [[[np.array(r, float) + 2e5]] for r in RINGS] + [[]]
    for a, b in zip(o.repair_all(sets), map(o.repair, sets), strict=True):
        assert len(a) == len(b)
        for p, q in zip(a, b, strict=True):
            assert [len(r) for r in p] == [len(r) for r in q] and all(np.allclose(r, s, atol=1e-8) for r, s in zip(p, q, strict=True))


def test_union_of_what_lies_apart_and_together():
    square = lambda x, y: [[np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float) + (x, y)]]
    ring = [square(x, y) for x in (0, 2, 4) for y in (0, 2, 4) if (x, y) != (2, 2)]
    u = o.union_all([*ring, square(50, 0), []])
    assert len(u) == 2 and o.area(u) == 36 and len(o.holes_of(u)) == 1


def test_many_simple_outlines_take_little_time():
    sets = [[[np.array([(0, 0), (9, 0), (9, 5), (4, 6), (0, 5)], float) + (i, 0)]] for i in range(4000)]
    began = time.process_time()
    assert len(o.repair_all(sets)) == 4000 and time.process_time() - began < 2


def test_groups_use_several_tasks(spark):
    d = spark.range(400).selectExpr("id % 100 AS k", "id")
    got = topology._by_group(d, ["k"], lambda g: [(g["k"][0], len(g["id"]))], "k long, n long")
    assert got.rdd.getNumPartitions() >= 4
    assert sorted(map(tuple, got.collect())) == [(i, 4) for i in range(100)]
