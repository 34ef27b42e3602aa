import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plotweave.functions import text as t
from plotweave.operators import access, audit, graph, metrics, resolve
from plotweave.operators.assignment import hungarian
from plotweave.operators.matcher import expected, tree_shap
from plotweave.operators.targeting import nelder_mead
from plotweave.sources import writers
from plotweave.streaming.windows import event_windows


def test_hungarian_against_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        c = rng.integers(0, 9, (n, m)).astype(float)
        small, big = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
        got = hungarian(c)
        assert len(got) == min(n, m) and sum(c[i, j] for i, j in got) == best
    assert hungarian(np.empty((0, 3))) == []


def test_shap_adds_up():
    tree = {"f": 0, "t": 0.5, "n": 10, "l": {"v": 1.0, "n": 4}, "r": {"f": 1, "t": 0.5, "n": 6, "l": {"v": 2.0, "n": 3}, "r": {"f": 0, "t": 0.8, "n": 3, "l": {"v": 5.0, "n": 1}, "r": {"v": 9.0, "n": 2}}}}
    for x, out in (([0.1, 0.1], 1.0), ([0.6, 0.1], 2.0), ([0.6, 0.9], 5.0), ([0.9, 0.9], 9.0)):
        assert tree_shap(tree, np.array(x), 2).sum() + expected(tree) == pytest.approx(out)


def test_nelder_mead():
    assert np.allclose(nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.zeros(2)), [3, -1], atol=1e-3)


def test_audit_chain(spark):
    rows = audit.chain([{"ts": "2026-01-01T00:00:00Z", "actor": "a", "role": "clerk", "action": "escalate", "target": f"C{i}", "after": {"n": i, "k": "é"}} for i in range(5)])
    log = spark.createDataFrame(rows, audit.SCHEMA)
    ok = audit.verify(log).head()
    assert ok["intact"] and ok["verified"] == 5 and ok["head"] == rows[-1]["hash"]
    bad = audit.verify(audit.tampered(log, 3, "reason", "x")).head()
    assert (bad["intact"], bad["broken_at"], bad["kind"]) == (False, 3, "content")
    gone = audit.verify(log.filter("seq <> 3")).head()
    assert (gone["broken_at"], gone["kind"]) == (4, "link")
    assert audit.verify(log.limit(0)).head()["intact"]


def test_audit_append(spark, tmp_path):
    p = str(tmp_path / "audit.jsonl")
    writers.append_audit(p, [{"ts": "t", "actor": "a", "role": "clerk", "action": "x", "target": "1", "before": {"b": 1}}])
    head = writers.append_audit(p, [{"ts": "t", "actor": "b", "role": "clerk", "action": "y", "target": "2"}])
    v = audit.verify(audit.read_log(spark, p)).head()
    assert v["intact"] and v["head"] == head and v["total"] == 2


SOURCES = [("gnss", 0.03, 2026, None), ("drone", 0.10, 2025, None), ("ms_ai", 1.20, 2024, None), ("municipal", 2.50, 2019, None), ("legacy", 6.00, 1987, ["owner", "tenure", "khasra"]), ("revenue", 8.00, 2023, ["owner", "tenure", "khasra", "ulpin"])]
CASES = [
    ("P1", "area", [("142.8", "gnss"), ("149.5", "legacy"), ("144.1", "ms_ai")], 142.8, "dominant precision", 0.817, False),
    ("P2", "owner", [("UNKNOWN", "drone"), ("Ramesh Kumar s/o Suresh Kumar", "revenue"), ("Ramesh Kr. s/o Suresh Kr.", "legacy")], "Ramesh Kumar s/o Suresh Kumar", "legal authority", 0.0, True),
    ("P3", "area", [("100", "gnss"), ("118", "drone"), ("139", "municipal")], 101.46382340852126, "inverse-variance fusion", 0.0, True),
    ("P4", "area", [("210.4", "drone"), ("210.9", "ms_ai"), ("209.8", "municipal")], 210.4, "dominant precision", 0.981, False),
    ("P5", "ward", [("W1", "drone")], "W1", "sole source", 1.0, False),
]


def test_resolution_cases(spark):
    rows = [(c[0], c[1], v, s, None, i) for c in CASES for i, (v, s) in enumerate(c[2])]
    claims = spark.createDataFrame(rows, "fid string, field string, value string, source_id string, confidence double, pos int")
    got = {r["fid"]: r for r in resolve.resolve_claims(claims, spark.createDataFrame(SOURCES, "source_id string, accuracy_m double, vintage long, authority array<string>")).collect()}
    for fid, _, _, value, rule, agree, human in CASES:
        r = got[fid]
        assert r["rule"] == rule and r["needs_human"] == human and round(r["agreement"], 2) == round(agree, 2), fid
        assert (float(r["value"]) == pytest.approx(value)) if isinstance(value, float) else r["value"] == value


def test_metrics_by_hand(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1), (5, None, 0.5)], "id int, y int, p double")
    assert metrics.roc_auc(d).head()[0] == pytest.approx(0.875)
    c = metrics.confusion(d).head()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 0, 1)
    assert metrics.reliability(d).count() == 10 and metrics.classification_report(d).head()["n"] == 4
    assert metrics.coverage_at_precision(d.filter("y = 0"), 0.9).head()["coverage"] == 0
    assert np.isnan(metrics.roc_auc(d.filter("y = 1")).head()[0])


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "q"), ("c", "a")], "a string, b string")
    got = dict(graph.components(e, spark.createDataFrame([("z",)], "v string")).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "z": "z"}


def test_text(spark):
    d = spark.createDataFrame([("Mohd. Kureshi S/O Abdool", "MOHAMMED QURESHI s/o abdul", "123/4-1"), (None, "", None)], "a string, b string, k string")
    r = d.select(t.normalise_name("a").alias("a"), t.normalise_name("b").alias("b"), t.parse_khasra("k").alias("k"), *[c.alias(n) for n, c in t.name_similarity("a", "b").items()]).collect()
    assert r[0]["a"] == r[0]["b"] == "mohammad qureshi s/o abdul" and r[0]["name_jw"] == 1 and tuple(r[0]["k"]) == (123, 4, 1)
    assert r[1]["a"] == "" and r[1]["name_present"] == 0 and tuple(r[1]["k"]) == (None, None, None)
    assert t.jaro_winkler_text("abcdefgh", "axyzwvut") == pytest.approx(0.4750, abs=1e-4)


def test_roles(spark):
    d = spark.createDataFrame([("1", "o", "A", "open")], "id string, owner string, fid string, status string")
    assert "owner" not in access.review_queue(d, "surveyor").columns and "owner" in access.review_queue(d, "clerk").columns
    assert access.redact(d, "public").head()["_redacted"] == ["id", "owner", "status"]
    with pytest.raises(PermissionError):
        access.review(d, "1", "public", "accept", "because")
    with pytest.raises(KeyError):
        access.review(d, "9", "tehsildar", "accept", "because")
    with pytest.raises(ValueError):
        access.redact(d, "king")


def test_sinks(spark, tmp_path):
    from tests.test_problems import G, box

    d = spark.createDataFrame([("A", box(0, 0, 2, 2), 1.5, "x")], f"fid string, geom {G}, a_long_field_name double, a_long_field_two string")
    p = writers.write_geojson(d, str(tmp_path / "a.geojson"))
    doc = json.load(open(p))
    assert doc["features"][0]["id"] == "A" and doc["features"][0]["geometry"]["coordinates"][0][0] == [0.0, 0.0]
    from plotweave.sources import readers

    back, meta = readers.read_geojson(spark, p)
    assert back.head()["fid"] == "A" and meta.crs == "EPSG:4326" and len(back.head()["geom"]["parts"][0][0]) == 5
    files = writers.write_shapefile(d, str(tmp_path / "a"))
    assert all(os.path.getsize(f) > 50 or f.endswith("json") for f in files)
    assert writers.dbf_names(["a_long_field_name", "a_long_field_two", "A_LONG_FIELD"]) == {"a_long_field_name": "a_long_fie", "a_long_field_two": "a_long_fi1", "A_LONG_FIELD": "A_LONG_FI2"}
    assert writers.manifest(files, "h", {})["files"][0]["bytes"] > 0


def test_windows(spark, data):
    ev = spark.read.parquet(f"{data}/events.parquet")
    assert event_windows(ev).agg(F.sum("n")).head()[0] == ev.count()


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(c.dtype for c in entry.entry(spark).schema.fields if hasattr(c, "dtype"))
