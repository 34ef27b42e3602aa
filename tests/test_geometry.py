import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plotweave.common import GEOM, clean_fid
from plotweave.functions import geometry as g, kernel as k, overlay as o


def box(x, y, w, h):
    return [[np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)]]


def row(rings, kind="Polygon"):
    return {"kind": kind, "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]}


def test_area_whatever_the_ring(spark):
    base = [(0, 0), (4, 0), (4, 3), (0, 3)]
    rings = [base, base[::-1], base[2:] + base[:2], base + base[:1], [base[0], *base], [(0, 0), (2, 0), (4, 0), (4, 3), (0, 3)]]
    rows = [(row([r]),) for r in rings] + [(None,), ({"kind": "Polygon", "parts": []},), (row([[(0, 0), (1, 1)]]),)]
    d = spark.createDataFrame(rows, "geom struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>")
    m = g.measured(d).select("area", "perimeter", "cx", "cy", "bbox").collect()
    assert [round(r["area"], 9) for r in m] == [12.0] * 6 + [0.0] * 3
    assert all(abs(r["perimeter"] - 14) < 1e-9 and abs(r["cx"] - 2) < 1e-9 and abs(r["cy"] - 1.5) < 1e-9 for r in m[:6])
    assert m[6]["bbox"] is None


def test_holes_and_overlap(spark):
    hole = row([[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)]])
    d = spark.createDataFrame([(hole, row([[(1, 1), (5, 1), (5, 5), (1, 5)]]))], "a " + GEOM.simpleString() + ", b " + GEOM.simpleString())
    d = d.withColumn("ea", g.edges("a")).withColumn("eb", g.edges("b")).withColumn("ba", g.edges_bbox("ea")).withColumn("bb", g.edges_bbox("eb"))
    r = d.withColumn("pa", g.packed("ea", "ba")).withColumn("pb", g.packed("eb", "bb")).select(g.edges_area("ea").alias("area"), k.overlap_area("pa", "ba", "pb", "bb").alias("o"))
    got = r.head()
    assert got["area"] == pytest.approx(96) and got["o"] == pytest.approx(12, abs=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(2, 10), st.floats(2, 10)), min_size=4, max_size=8), st.floats(-4, 4), st.floats(-4, 4))
def test_overlay_identities(radii, dx, dy):
    n = len(radii)
    a = np.arange(n) * 2 * math.pi / n
    star = lambda i, x, y: [[np.column_stack([[r[i] for r in radii] * np.cos(a) + x, [r[i] for r in radii] * np.sin(a) + y])]]
    p, q = o.repair(star(0, 0, 0)), o.repair(star(1, dx, dy))
    inter = o.area(o.intersection(p, q))
    assert abs(o.area(p) + o.area(q) - o.area(o.union(p, q)) - inter) < 1e-4
    assert abs(o.area(p) - o.area(o.difference(p, q)) - inter) < 1e-4
    ea, eb = o._segments(p), o._segments(q)
    if len(p) == len(q) == 1 and o.ring_area(p[0][0]) > 0:
        fast = k.overlap_areas(ea, np.array([0]), np.array([len(ea)]), eb, np.array([0]), np.array([len(eb)]))[0]
        assert abs(fast - inter) < 1e-4


def test_ears_add_up():
    rng = np.random.default_rng(1)
    for n in range(3, 12):
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        if np.diff(np.append(a, a[0] + 2 * np.pi)).max() > np.pi:
            continue
        ring = np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(2, 9, n)[:, None]
        t = k.ear_clip(ring)
        area = sum(abs((q[1] - q[0])[0] * (q[2] - q[0])[1] - (q[1] - q[0])[1] * (q[2] - q[0])[0]) / 2 for q in t)
        assert area == pytest.approx(abs(o.ring_area(ring)))
    hole = [[[{"x": x, "y": y} for x, y in r] for r in ([(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)])]]
    t = k.triangles(hole)
    assert sum(abs((q[1] - q[0])[0] * (q[2] - q[0])[1] - (q[1] - q[0])[1] * (q[2] - q[0])[0]) / 2 for q in t) == pytest.approx(72)
    assert len(k.triangles(None)) == 0


def test_bow_tie_and_boxes_tree():
    tie = [[np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)]]
    assert o.area(o.repair(tie)) == pytest.approx(2) and len(o.largest(o.repair(tie))) == 1
    rng = np.random.default_rng(0)
    b = rng.uniform(0, 100, (300, 2))
    b = np.concatenate([b, b + rng.uniform(0, 5, (300, 2))], axis=1)
    q, h = k.Boxes(b).hits(b[:50])
    want = {(i, j) for i in range(50) for j in range(300) if b[i, 0] <= b[j, 2] and b[i, 2] >= b[j, 0] and b[i, 1] <= b[j, 3] and b[i, 3] >= b[j, 1]}
    assert set(zip(q.tolist(), h.tolist(), strict=True)) == want


def test_clean_fid(spark):
    rows = [("P00000001",), (" p00000001 ",), ("p-00000001\t",), ("Govt_00000003",), ("",), (None,), ("B०००००१२३",)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string").select(clean_fid("f")).collect()]
    assert got == ["P00000001"] * 3 + ["govt_00000003", None, None, "B00000123"]
