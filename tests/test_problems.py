import datetime as dt

from pyspark.sql import functions as F

from plotweave.common import GEOM
from plotweave.operators import drift, proximity, snapshots, units

G = GEOM.simpleString()


def box(x, y, w, h):
    p = lambda a, b: {"x": float(a), "y": float(b)}
    return {"kind": "Polygon", "parts": [[[p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)]]]}


def buildings(spark, rows):
    t = dt.datetime(2021, 1, 1)
    return spark.createDataFrame([(f, e, g, h, None if a is None else t + dt.timedelta(days=a), "x", 1.0) for f, e, g, h, a in rows], f"fid string, epoch string, geom {G}, height_m double, loaded_at timestamp_ntz, id string, area double")


def test_snapshot_changes(spark):
    rows = [
        ("B00000001", "t0", box(0, 0, 10, 10), 3.0, 1), ("b00000001 ", "t1", box(0, 0, 10, 10), 3.0, 1), ("B00000001", "t1", box(0, 0, 10, 12), 3.0, 2),  # extended, the later delivery counts
        ("B00000002", "t0", box(50, 0, 10, 10), 3.0, 1), ("B00000092", "t1", box(50, 0, 10, 10), 6.0, 1),  # another fid, heightened
        ("B00000003", "t0", box(100, 0, 10, 10), None, 1), ("B00000003", "t1", box(100, 0, 10, 10), 9.0, 1),  # null height
        ("B00000004", "t0", box(150, 0, 10, 10), 3.0, 1),  # demolished
        ("B00000005", "t1", box(200, 0, 10, 10), 3.0, None), ("B00000005", "t1", box(200, 0, 10, 10), 3.0, None),  # new, repeated
        ("B00000006", "t0", box(250, 0, 10, 10), 3.0, 1), ("B00000006", "t1", box(300, 0, 10, 10), 3.0, 1),  # replaced elsewhere
        (None, "t1", box(0, 0, 1, 1), 1.0, 1), ("B00000007", None, box(0, 0, 1, 1), 1.0, 1), ("B00000008", "t0", None, 3.0, 1), ("B00000008", "t1", None, 3.0, 1),
    ]
    got = {(r["epoch"], r["kind"], r["fid"]) for r in snapshots.snapshot_changes(buildings(spark, rows)).collect()}
    want = {("t1", "extended", "B00000001"), ("t1", "heightened", "B00000092"), ("t1", "demolished", "B00000004"), ("t1", "new", "B00000005"), ("t1", "demolished", "B00000006"), ("t1", "new", "B00000006"), ("t1", "new", "B00000008"), ("t1", "demolished", "B00000008")}
    assert got == want
    assert snapshots.snapshot_changes(buildings(spark, [])).count() == 0


def test_copies_of_an_outline(spark):
    rows = [(f"B{i:08d}", e, box(0, 0, 10, 10 + (e == "t1") * 2), 3.0, 1) for i in range(30) for e in ("t0", "t1")]
    got = snapshots.snapshot_changes(buildings(spark, rows)).collect()
    assert len(got) == 30 and {r["kind"] for r in got} == {"extended"}


def test_outlines_that_part_and_join(spark):
    """Two outlines continue one, and one continues two: neither side is new or demolished."""
    rows = [
        ("B00000001", "t0", box(0, 0, 10, 10), 3.0, 1), ("B00000001", "t1", box(0, 0, 10, 9.5), 3.0, 1), ("B00000002", "t1", box(0, 0, 10, 8.5), 3.0, 1), ("B00000002", "t2", box(0, 0, 10, 8.5), 3.0, 1), ("B00000001", "t2", box(0, 0, 10, 9.5), 3.0, 1),
        ("B00000003", "t0", box(50, 0, 10, 10), 3.0, 1), ("B00000004", "t0", box(50, 0, 10, 8), 3.0, 1), ("B00000003", "t1", box(50, 0, 10, 10), 3.0, 1),
        ("B00000005", "t0", box(90, 0, 10, 10), 3.0, 1), ("B00000006", "t0", box(90, 0, 10, 10), 8.0, 1), ("B00000005", "t1", box(90, 0, 10, 10), 3.0, 1), ("B00000006", "t1", box(90, 0, 10, 10), 8.0, 1), ("B00000005", "t2", box(90, 0, 10, 10), 3.0, 1),
    ]
    got = {(r["epoch"], r["kind"], r["fid"], r["matched_fid"]) for r in snapshots.snapshot_changes(buildings(spark, rows)).collect()}
    assert got == {("t1", "reduced", "B00000002", "B00000001"), ("t2", "demolished", "B00000003", None)}


def test_relations(spark):
    pts = [("S00000001", 250005.0, 2300005.0, None, None), ("S00000002", 2300015.0, 250005.0, None, None), ("S00000003", 0.0, 0.0, None, None), ("S00000004", -9999.0, -9999.0, None, None), ("S00000005", None, None, 0.0, 0.0), ("S00000001", 250005.0, 2300005.0, None, None), ("S00000006", 250055.0, 2300055.0, None, None), ("S00000007", 250010.0, 2300005.0, None, None), (None, 250005.0, 2300005.0, None, None)]
    points = spark.createDataFrame(pts, "fid string, x double, y double, lon double, lat double")
    parcels = spark.createDataFrame([("P00000001", box(250000, 2300000, 10, 10)), ("P00000002", box(250010, 2300000, 10, 10)), ("P00000001", box(250000, 2300000, 10, 10)), ("P00000003", None)], f"fid string, geom {G}")
    ring = {"kind": "Polygon", "parts": [box(250040, 2300040, 30, 30)["parts"][0] + box(250050, 2300050, 10, 10)["parts"][0]]}
    govt = spark.createDataFrame([("govt_00000001", ring)], f"fid string, geom {G}")
    b = buildings(spark, [("B00000001", "t0", box(250035, 2300045, 10, 4), 3.0, 1), ("B00000002", "t0", box(250038, 2300045, 3, 4), 3.0, 1), ("B00000003", "t0", box(250052, 2300052, 5, 5), 3.0, 1)])
    got = {tuple(r) for r in proximity.relations(points, parcels, govt, b).collect()}
    assert got == {
        ("near", "S00000001", "S00000002"), ("near", "S00000001", "S00000007"), ("near", "S00000002", "S00000007"), ("inside_parcel", "P00000001", "S00000001"),
        ("inside_parcel", "P00000001", "S00000007"), ("encroaches", "B00000001", "govt_00000001"),
    }
    assert proximity.relations(points.limit(0), parcels.limit(0), govt.limit(0), b.limit(0)).count() == 0


def test_corners_and_holes(spark):
    from plotweave.operators import spatial

    regions = [(f"P{i}{j}", box(10 * i, 10 * j, 10, 10)) for i in range(3) for j in range(3)]
    notch = {"kind": "Polygon", "parts": [[[{"x": float(x), "y": float(y)} for x, y in ((100, 0), (120, 0), (120, 20), (110, 20), (110, 10), (100, 10))], box(112, 2, 4, 4)["parts"][0][0]]]}
    r = spark.createDataFrame([*regions, ("N", notch)], f"fid string, geom {G}")
    pts = {"corner": (10, 10), "edge": (15, 10), "rim": (0, 5), "in": (5, 5), "centre": (15, 15), "inner corner": (110, 10), "hole corner": (112, 2), "hole": (114, 4), "beside": (111, 12), "out": (105, 15)}
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "fid string, x double, y double")
    want = {"corner": ["P00"], "edge": ["P10"], "rim": ["P00"], "in": ["P00"], "centre": ["P11"], "inner corner": ["N"], "hole corner": ["N"], "beside": ["N"]}
    got = {}
    for x in spatial.points_in_regions(p, r).collect():
        got.setdefault(x["fid"], []).append(x["region"])
    assert got == want


def test_stacked_regions_stay_bounded(spark):
    from plotweave.operators import spatial

    r = spark.createDataFrame([(f"P{i:03d}", box(0, 0, 10, 10)) for i in range(300)] + [("Q", box(50, 0, 10, 10))], f"fid string, geom {G}")
    tree, tri = spatial.volume_tree(spatial.triangulate(r), 8, 50)
    assert max(tree.parts.values()) >= 6
    q, t, on = spatial.met(tree.reached(spark.createDataFrame([("a", 5.0, 5.5)], "fid string, x double, y double"), (F.col("x"), F.col("y"), F.col("x"), F.col("y"))), tri, tree)
    assert t.groupBy(*on).count().agg(F.max("count")).head()[0] < 120
    assert q.join(t, on).count() == tri.count() == 602


def test_degrees_agree_with_metres(spark):
    d = spark.createDataFrame([("S00000197", None, None, 78.604654309, 20.785695317), ("S00000197", None, None, 20.785695317, 78.604654309)], "fid string, x double, y double, lon double, lat double")
    r = proximity.survey_positions(d).collect()
    assert len(r) == 1 and abs(r[0]["x"] - 250646.244) < 0.01 and abs(r[0]["y"] - 2300280.716) < 0.01


def test_notes(spark):
    notes = {
        "rakba: 1,810 sft": ("sq_ft", 1810.0), "0.0085hectare": ("hectare", 0.0085), "115.9m2": ("sqm", 115.9), "1 biswa 10 biswansi": ("biswa", None), "biswa 1, biswansi 4": ("biswa", None),
        "0-1-16 (big.-bis.-bwn.)": ("biswa", None), "2 guntha 90 sq ft": ("guntha", None), "गुंठा": ("guntha", None), "बिस्वा": ("biswa", None), "sq. yards": ("sq_yard", None), "gunthaa": ("guntha", None),
        "map shows 2 acre pasture to the east": None, "boundary with 1 bigha tank": None, "see register 4": None, "copy faded": None, "": None,
    }
    d = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, note string")
    got = {r["i"]: r for r in units.noted_areas(d, ["i"], "note").collect()}
    for i, (n, want) in enumerate(notes.items()):
        assert (got.get(i) is None) == (want is None), n
        if want:
            assert got[i]["unit"] == want[0] and (want[1] is None or got[i]["quantity"] == want[1]), n
    assert abs(got[3]["sqm"] - 126.44 * 1.5) < 1e-9


def test_legacy_areas(spark):
    rows = [(f"L{i:08d}", box(0, 0, 10, 12), 0.0474, None, "W01") for i in range(30)] + [
        ("L00000100", box(0, 0, 10, 12), 120.0, None, "W 1"), ("L00000101", box(0, 0, 10, 12), 1.186, "in guntha", "W01"), ("L00000102", None, None, "1 biswa 1 biswansi", "W01"), ("L00000103", None, 0.0, "biswa", "W01"),
        ("L00000104", None, None, "copy faded", None), ("L00000105", None, None, None, None), ("L00000101", box(0, 0, 10, 12), 1.186, "in guntha", "W01"),
    ]
    d = spark.createDataFrame(rows, f"fid string, geom {G}, AREA_BIGHA double, AREA_NOTE string, WARD string")
    got = {r["fid"]: (r["area_unit"], round(r["area_sqm"])) for r in units.legacy_areas(d).collect()}
    assert got["L00000100"] == ("sqm", 120) and got["L00000101"] == ("guntha", 120) and got["L00000102"] == ("biswa", 133) and got["L00000000"][0] == "bigha"
    assert set(got) == {f"L{i:08d}" for i in range(30)} | {"L00000100", "L00000101", "L00000102"}
    assert units.legacy_areas(d.limit(0)).count() == 0


def test_drift(spark):
    t = dt.datetime(2021, 1, 1)
    line = lambda f, n, s: (f * 100 + n, f, "s1", t + dt.timedelta(days=f), n, s)
    rows = [line(1, n, f'{{"ward no": "W0{n}", "AREA": {n}.5, "x": null, "kept": "a"}}') for n in range(1, 9)]
    rows += [line(2, n, f'{{"mohalla": {n}, "AREA": "{n}.5 bigha", "fresh": "new{n}", "kept": "a"}}') for n in range(1, 9)] + [line(2, 9, '{"cut": 1, "of'), line(2, 10, None), line(2, 1, '{"mohalla": 1, "AREA": "1.5 bigha", "fresh": "new1", "kept": "a"}')]
    d = spark.createDataFrame(rows, "record_id long, file_id long, source string, as_of timestamp_ntz, line_no long, payload string").withColumn("column", F.lit(1))
    got = {tuple(r) for r in drift.drift_report(d).collect()}
    assert got == {(2, "mohalla", "renamed"), (2, "mohalla", "retyped"), (2, "AREA", "retyped"), (2, "fresh", "added"), (2, "x", "removed")}
    rec = {r["record_id"]: r for r in drift.consistent_records(d).collect()}
    assert rec[203]["ward"] == 3 and rec[203]["area"] == 3.5 and rec[103]["ward"] == 3
    assert drift.drift_report(d.limit(0)).count() == 0
