"""More queries of the engine's operators, each with its SQL: layers, shapes, topology, alignment, conflicts, audit, readers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import ensure_checkpoint_dir, spread, table
from ..functions import crs, geometry as g, shapes, text as t
from ..operators import access, assign, audit, blocking, change, georef, layers, matcher, metrics, resolve, schema_match, targeting, topology
from ..sources import readers, writers
from .catalogue import BOXES, EPOCHS, FITTED, GEOJSON, LAND, LEGACY, LONLAT, POINTS, RANKED, SCORED, _fold_sql, boxes, change_events, customer_points, encroachment_severity, fitted_pairs, key, lonlat, query, r6, schema_scores as match_scores, scored, source_layer, supplier_points, target_layer

# ------------------------------------------------------------------ layers


@query(f"WITH {BOXES} SELECT k, round(x+3,6) AS xmin, round(y-2,6) AS ymin, round(w*h,6) AS area FROM src")
def layer_translate(spark, d):
    m = layers.map_geometry(source_layer(spark, d), lambda geom: g.translate(geom, 3.0, -2.0))
    e = m.select("k", g.edges("geom").alias("e"))
    return e.select("k", r6(g.edges_bbox("e").getField("xmin"), "xmin"), r6(g.edges_bbox("e").getField("ymin"), "ymin"), r6(g.edges_area("e"), "area"))


@query(f"WITH {BOXES} SELECT k FROM src WHERE price > 100000")
def layer_filter(spark, d):
    return layers.filter_layer(source_layer(spark, d), F.col("height_m") > 100000).select("k")


@query("SELECT user_id AS fid, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def layer_by_id(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("fid"), F.col("event_id").alias("pos"), "event_type", "value")
    return layers.by_id(e).select("fid", "event_type", "value")


@query(f"WITH {BOXES} SELECT k, price FROM src WHERE k=42")
def layer_lookup(spark, d):
    return layers.lookup(source_layer(spark, d), f"{42:012d}").select("k", F.col("height_m").alias("price"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS fid, c_name AS "KHATEDAR_NM", c_mktsegment AS "C_MKTSEGMENT" FROM customer""")
def layer_rename(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("fid"), "c_name", "c_mktsegment", "c_acctbal")
    return layers.rename(c, {"c_name": "KHATEDAR_NM"}, ("c_acctbal",))


@query("SELECT CAST(c_custkey AS VARCHAR) AS fid, c_name AS owner, CAST(NULL AS VARCHAR) AS khasra FROM customer")
def layer_semantic(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("fid"), "c_name")
    return layers.semantic(c, {"owner": "c_name"}, ("owner", "khasra"))


@query(f"WITH {BOXES} SELECT k, round(x+500000,3) AS east, round(y+2300000,3) AS north FROM src")
def layer_lonlat(spark, d):
    ll = layers.to_lonlat(layers.map_geometry(source_layer(spark, d), lambda geom: g.translate(geom, 500000.0, 2300000.0)))
    p = F.col("geom.parts")[0][0][0]
    e, n = crs.geodetic_to_utm(p.getField("x"), p.getField("y"), F.lit(44))
    return ll.select("k", r6(e, "east", 3), r6(n, "north", 3))


RESIDUALS = "WITH r AS (SELECT o_orderkey AS k, ((o_orderkey*37)%1013)/10.0e0 AS dx, ((o_orderkey*53)%1009)/40.0e0 AS dy FROM orders), q AS (SELECT *, sqrt(dx*dx+dy*dy) AS residual FROM r)"


def displaced(spark, d):
    k = F.col("o_orderkey")
    dx, dy = ((k * 37) % 1013) / F.lit(10.0), ((k * 53) % 1009) / F.lit(40.0)
    return table(spark, d, "orders").select(k.alias("fid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), dx.alias("tx"), dy.alias("ty"))


@query(RESIDUALS + " SELECT k, round(residual,6) AS residual FROM q WHERE residual<=40")
def residual_vectors(spark, d):
    return georef.residual_vectors(displaced(spark, d)).select(F.col("fid").alias("k"), r6("residual", "residual"))


@query(RESIDUALS + ", l AS (SELECT quantile_cont(residual,0.99) AS l FROM q) SELECT round(sqrt(avg(residual*residual)),6) AS rmse, count(*) AS n FROM q, l WHERE residual<l")
def trimmed_rmse(spark, d):
    return layers.trimmed_rmse(georef.residual_vectors(displaced(spark, d), 1e9)).select(r6("rmse", "rmse"), "n")


@query("SELECT o_orderkey AS k, round(o_totalprice/(SELECT sum(o_totalprice) FROM orders),12) AS share FROM orders")
def share_of_total(spark, d):
    return layers.share_of_total(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "o_totalprice").select("k", r6("share", "share", 12))


@query("SELECT c_custkey, format('C{:04d}', row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)) AS id FROM customer")
def numbered_ids(spark, d):
    return layers.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], "C").select("c_custkey", "id")


# --------------------------------------------------------------- conflicts

RELATIONS = """WITH o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR),12,'0') AS fid, o_orderkey AS k, round(o_totalprice/100,1) AS area FROM orders),
 a AS (SELECT fid, k, CASE WHEN k%7=0 THEN 'split' WHEN k%11=0 THEN 'merge' ELSE 'one_to_one' END AS relation, (k%101)/100.0e0 AS confidence FROM o WHERE k%5<>0)"""
LISTED = RELATIONS + """, c AS (SELECT 0 AS part, fid, [fid] AS ref, CASE relation WHEN 'split' THEN 'subdivision' WHEN 'merge' THEN 'amalgamation' ELSE CASE WHEN confidence<0.85 THEN 'unresolved' END END AS class, confidence FROM a
  UNION ALL SELECT 1, fid, [], 'missing_reference', 0.0e0 FROM o WHERE k%5=0), n AS (SELECT *, row_number() OVER (ORDER BY part, fid, class) AS n FROM c WHERE class IS NOT NULL)"""


def assigned(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("fid"), k.alias("k"), (F.col("o_totalprice") / 100).alias("area"))
    rel = F.when(F.col("k") % 7 == 0, "split").when(F.col("k") % 11 == 0, "merge").otherwise("one_to_one")
    return o.filter("k % 5 <> 0").select(F.col("fid").alias("src"), F.array("fid").alias("tgts"), rel.alias("relation"), (F.col("k") % 101 / F.lit(100.0)).alias("confidence")), o


@query(LISTED + " SELECT format('C{:04d}', n) AS id, n.fid, ref, class, confidence, area AS area_sqm, 'open' AS status FROM n JOIN o ON o.fid=n.fid")
def conflict_list(spark, d):
    a, o = assigned(spark, d)
    return assign.conflict_list(a, o)


@query(LISTED + " SELECT class, count(*) AS n FROM n WHERE part=0 GROUP BY class")
def conflict_classes(spark, d):
    return assign.conflict_class(assigned(spark, d)[0]).groupBy(F.col("conflict").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(RELATIONS + " SELECT relation, count(*) AS n FROM a GROUP BY relation")
def relation_counts(spark, d):
    return assign.by_relation(assigned(spark, d)[0])


@query(RELATIONS + " SELECT o.fid, coalesce(relation,'unmatched') AS relation, coalesce(confidence,0) AS confidence FROM o LEFT JOIN a ON a.fid=o.fid")
def labelled_layer(spark, d):
    a, o = assigned(spark, d)
    return assign.labelled_layer(o, a).select("fid", "relation", "confidence")


@query(f"WITH {BOXES} SELECT s.k AS src, t.k AS tgt, CASE WHEN s.k=t.k THEN 1 ELSE 0 END AS y FROM src s JOIN tgt t ON t.y<=s.y+s.h+18 AND t.y+t.h>=s.y-18 AND t.x<=s.x+s.w+18 AND t.x+t.w>=s.x-18")
def pair_labels(spark, d):
    p = blocking.block(blocking.prepared(source_layer(spark, d)), blocking.prepared(target_layer(spark, d)), 18.0, None)
    return assign.pair_labels(p, source_layer(spark, d).select(F.col("fid").alias("src"), F.array("fid").alias("tgts"))).select(key("src", "src"), key("tgt", "tgt"), "y")


@query(f"WITH {BOXES}, c AS (SELECT DISTINCT s.k FROM src s JOIN tgt t ON t.k=s.k WHERE s.k%3<>0) SELECT round(CAST((SELECT count(*) FROM c) AS DOUBLE)/(SELECT count(*) FROM tgt),9) AS recall")
def blocking_recall(spark, d):
    same = target_layer(spark, d).select(F.col("fid").alias("src"), F.col("fid").alias("tgt"), "k")
    return metrics.blocking_recall(same, same.filter("k % 3 <> 0")).select(r6("recall", "recall", 9))


@query("WITH c AS (SELECT c_custkey AS k FROM customer) SELECT round(avg(CASE WHEN k%4<>0 THEN CASE WHEN k%9<>0 THEN 1.0e0 ELSE 0 END END),9) AS exact, round(avg(CASE WHEN k%4=0 THEN CASE WHEN k%5<>0 THEN 1.0e0 ELSE 0 END END),9) AS spurious_rejected FROM c")
def exact_sets(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("src"))
    none = F.array().cast("array<string>")
    truth = c.select("src", F.when(F.col("k") % 4 == 0, none).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("tgts"))
    found = c.filter("k % 4 <> 0").select("src", F.when(F.col("k") % 9 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("tgts")).unionByName(c.filter("k % 4 = 0 and k % 5 = 0").select("src", F.array(F.lit("z")).alias("tgts")))
    return metrics.exact_sets(truth, found).select(r6("exact", "exact", 9), r6("spurious_rejected", "spurious_rejected", 9))


@query(RANKED + " SELECT id, k, tp FROM r")
def running_hits(spark, d):
    return metrics.ranked(scored(spark, d)).select("id", "k", "tp")


REPORT = SCORED + """, c AS (SELECT count(*) FILTER (p>=0.5 AND y=1) AS tp, count(*) FILTER (p>=0.5 AND y=0) AS fp, count(*) FILTER (p<0.5 AND y=1) AS fn, count(*) FILTER (p<0.5 AND y=0) AS tn, avg(power(p-y,2)) AS brier, count(*) AS n, sum(y) AS positives FROM s),
 ra AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0e0 AS r FROM s), au AS (SELECT (sum(CASE WHEN y=1 THEN r END)-sum(y)*(sum(y)+1)/2.0e0)/(sum(y)*(count(*)-sum(y))) AS roc_auc FROM ra),
 rk AS (SELECT y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM s WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)), ap AS (SELECT sum(CASE WHEN y=1 THEN tp/CAST(k AS DOUBLE) END)/sum(y) AS avg_precision FROM rk),
 b AS (SELECT least(CAST(floor(p*10) AS INTEGER),9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM s GROUP BY 1), e AS (SELECT sum(n*abs(mp-rate))/sum(n) AS ece FROM b)"""


@query(REPORT + " SELECT tp, fp, fn, tn, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives, round(roc_auc,6) AS roc_auc, round(avg_precision,6) AS avg_precision, round(brier,6) AS brier, round(ece,6) AS ece FROM c, au, ap, e")
def metrics_report(spark, d):
    return metrics.classification_report(scored(spark, d)).select("tp", "fp", "fn", "tn", "n", "positives", *[r6(c, c) for c in ("roc_auc", "avg_precision", "brier", "ece")])


@query("SELECT count(DISTINCT o_custkey) AS groups, CAST(0 AS BIGINT) AS straddling FROM orders")
def grouped_split(spark, d):
    p = matcher.group_split(table(spark, d, "orders"), "o_custkey").groupBy("o_custkey").agg(F.count_distinct("held").alias("sides"))
    return p.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("sides") > 1).alias("straddling"))


# ------------------------------------------------------- change and shapes


@query(EPOCHS + " SELECT kind, count(*) AS n, round(sum(delta),3) AS sqm FROM e WHERE kind IS NOT NULL GROUP BY kind")
def change_counts(spark, d):
    return change.event_counts(change_events(spark, d).withColumnRenamed("delta", "delta_sqm")).select("kind", "n", r6("sqm", "sqm", 3))


@query(EPOCHS + " SELECT row_number() OVER (ORDER BY abs(round(delta,6)) DESC, k, kind) AS n, k, kind FROM e WHERE kind IS NOT NULL")
def change_ranking(spark, d):
    return layers.global_rank(change_events(spark, d), [F.desc(F.abs("delta")), F.col("k"), F.col("kind")], "n").select("n", "k", "kind")


ON_LAND = LAND + """, p AS (SELECT s.k, l.g, (least(s.x+s.w,l.x+l.w)-greatest(s.x,l.x))*(least(s.y+s.h,l.y+l.h)-greatest(s.y,l.y)) AS area
  FROM src s JOIN land l ON l.y<s.y+s.h AND l.y+l.h>s.y AND l.x<s.x+s.w AND l.x+l.w>s.x)"""


@query(ON_LAND + " SELECT count(*) AS n, round(sum(area),3) AS area FROM p WHERE area>=5")
def encroached_total(spark, d):
    return encroachment_severity(spark, d).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("area"), "area", 3))


@query(EPOCHS + " SELECT format('{}: {:d} structures, {:.1f} sqm', kind, count(*), round(sum(delta),1)) AS line FROM e WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'encroachment: 0 sites, 0.0 sqm'")
def change_summary(spark, d):
    ev = change_events(spark, d).withColumn("delta_sqm", F.round("delta", 1))
    return change.summary_lines(ev, encroachment_severity(spark, d).filter("area < 0"))


@query(f"WITH {BOXES} SELECT k, 1.0e0 AS rectangularity, round(least(w,h)/greatest(w,h),6) AS elongation, 1.0e0 AS signature_mean, 64 AS steps FROM src")
def shape_measures(spark, d):
    m = shapes.described(blocking.prepared(source_layer(spark, d)))
    mean = F.aggregate("signature", F.lit(0.0), lambda s, v: s + v) / F.size("signature")
    return m.select("k", r6("rectangularity", "rectangularity"), r6("elongation", "elongation"), r6(mean, "signature_mean"), F.lit(64).alias("steps"))


@query(f"WITH {BOXES} SELECT k, round(sqrt(0.3e0*0.3e0+0.2e0*0.2e0),6) AS hausdorff, 0.0e0 AS signature, 1.0e0 AS boundary FROM src")
def shape_distances(spark, d):
    b = spread(boxes(spark, d)).select("k", "fid", g.box("x", "y", "w", "h").alias("geom"), g.box(F.col("x") + 0.3, F.col("y") - 0.2, F.col("w"), F.col("h")).alias("moved"))
    r = b.select("k", shapes.ring("geom").alias("a"), shapes.ring("moved").alias("b"))
    r = r.select("k", "a", "b", shapes._measures("a").getField("signature").alias("sa"), shapes._measures("b").getField("signature").alias("sb"))
    return r.select("k", r6(shapes.hausdorff("a", "b"), "hausdorff"), F.abs(r6(shapes.signature_distance("sa", "sb"), None, 5)).alias("signature"), r6(shapes.boundary_overlap("a", "b"), "boundary"))


@query(f"WITH {BOXES} SELECT k, round(x+w/2,6) AS half_x, round(y,6) AS half_y, round(2*(w+h),6) AS length, round(x+0.25e0,6) AS lerp_x, x BETWEEN 0 AND 500 AND y BETWEEN 0 AND 500 OR x+w BETWEEN 0 AND 500 AND y BETWEEN 0 AND 500 OR x BETWEEN 0 AND 500 AND y+h BETWEEN 0 AND 500 OR x+w BETWEEN 0 AND 500 AND y+h BETWEEN 0 AND 500 AS inside FROM src")
def ring_functions(spark, d):
    b = boxes(spark, d).select("k", "w", g.box("x", "y", "w", "h").alias("geom"), g.box(F.col("x") + 1.0, F.col("y"), F.col("w"), F.col("h")).alias("moved"))
    ring = lambda c: F.col(f"{c}.parts")[0][0]
    half = g.point_along(ring("geom"), F.col("w") / 2)
    return b.select("k", r6(half.getField("x"), "half_x"), r6(half.getField("y"), "half_y"), r6(g.ring_length(ring("geom")), "length"), r6(g.ring_lerp(ring("geom"), ring("moved"), 0.25)[0].getField("x"), "lerp_x"), g.any_vertex_in_bbox("geom", 0.0, 0.0, 500.0, 500.0).alias("inside"))


@query(f"WITH {BOXES} SELECT k, round(0.5e0*x-2*y+7,6) AS x, round(2*x+0.5e0*y-3,6) AS y FROM src")
def scale_rotate(spark, d):
    p = source_layer(spark, d).select("k", g.scale_rotate("geom", 0.5, 2.0, 7.0, -3.0).alias("geom"))
    return p.select("k", r6(F.col("geom.parts")[0][0][0]["x"], "x"), r6(F.col("geom.parts")[0][0][0]["y"], "y"))


LL = f"WITH l AS ({LONLAT}), q AS (SELECT k, lon, lat, radians((3*lat+2*(lat+0.001e0))/5) AS phi FROM l), a AS (SELECT k, lon, lat, 0.001e0*0.002e0*(111132.92e0-559.82e0*cos(2*phi)+1.175e0*cos(4*phi))*(111412.84e0*cos(phi)-93.5e0*cos(3*phi)) AS area FROM q)"


def lonlat_boxes(spark, d):
    return lonlat(spark, d).select("k", g.box("lon", "lat", F.lit(0.002), F.lit(0.001)).alias("geom"))


@query(LL + " SELECT k, round(area,3) AS area FROM a")
def lonlat_areas(spark, d):
    return lonlat_boxes(spark, d).select("k", r6(g.lonlat_area("geom"), "area", 3))


@query(LL + ", s AS (SELECT *, row_number() OVER (ORDER BY area)-1 AS i, count(*) OVER () AS c FROM a) SELECT count(*) AS n, count(*) FILTER (area<5) AS degenerate, count(*) FILTER (area>20000) AS implausible, round(max(CASE WHEN i=c//2 THEN area END),3) AS median, round(max(CASE WHEN i=CAST(floor(c*0.05e0) AS BIGINT) THEN area END),3) AS p05, round(max(CASE WHEN i=CAST(floor(c*0.95e0) AS BIGINT) THEN area END),3) AS p95, round(min(lon),6) AS xmin, round(max(lat)+0.001e0,6) AS ymax FROM s")
def lonlat_profile(spark, d):
    p = readers.profile_lonlat(lonlat_boxes(spark, d))
    return p.select("n", F.col("degenerate").cast("long").alias("degenerate"), F.col("implausible").cast("long").alias("implausible"), *[r6(c, c, 3) for c in ("median", "p05", "p95")], r6("xmin", "xmin"), r6("ymax", "ymax"))


@query(f"WITH {BOXES} SELECT k, round(w*h,6) AS area, round((w-1)*h/(w*h+h),6) AS iou, round((w-1)*h,6) AS common, round(x,6) AS xmin FROM src")
def sql_functions(spark, d):
    """The kernel called from SQL."""
    g.register(spark)
    view = f"boxes_{uuid.uuid4().hex}"
    boxes(spark, d).select("k", g.box("x", "y", "w", "h").alias("a"), g.box(F.col("x") + 1.0, F.col("y"), F.col("w"), F.col("h")).alias("b")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT k, round(geo_area(a),6) AS area, round(geo_iou(a,b),6) AS iou, round(geo_intersection_area(a,b),6) AS common, round(geo_bbox(a).xmin,6) AS xmin FROM {view}")


# ---------------------------------------------------------------- topology

TWO = "WITH s AS (SELECT s_suppkey AS k FROM supplier)"


def plates(spark, d, rows: list[tuple]) -> DataFrame:
    """For each supplier the given rectangles (name, x, y, w, h), 100 m apart."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    p = spark.createDataFrame(rows, "name string, dx double, dy double, w double, h double")
    return s.crossJoin(F.broadcast(p)).select("k", "name", F.concat_ws("-", F.lpad(F.col("k").cast("string"), 9, "0"), "name").alias("fid"), g.box(100.0 * F.col("k") + F.col("dx"), F.col("dy"), F.col("w"), F.col("h")).alias("geom"))


FRAME = [("bottom", 0.0, 0.0, 12.0, 0.4), ("left", 0.0, 0.4, 2.0, 9.6), ("right", 10.0, 0.4, 2.0, 9.6), ("top", 0.0, 10.0, 12.0, 2.0)]


@query(TWO + " SELECT 4*count(*) AS features, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS overlaps, count(*) AS holes, round(76.8e0*count(*),3) AS hole_area, count(*) AS slivers, round(67.2e0*count(*),3) AS summed_area, round(67.2e0*count(*),3) AS footprint FROM s")
def topology_frames(spark, d):
    t_ = topology.diagnose(plates(spark, d, FRAME).select("fid", "geom"))
    return t_.select(*[F.col(c).cast("long").alias(c) for c in ("features", "invalid", "overlaps", "holes", "slivers")], *[r6(c, c, 3) for c in ("hole_area", "summed_area", "footprint")])


@query(TWO + " SELECT k, 100.0e0 AS a, 40.0e0 AS b FROM s")
def topology_overlaps_resolved(spark, d):
    c = topology.clean_layer(plates(spark, d, [("a", 0.0, 0.0, 10.0, 10.0), ("b", 8.0, 0.0, 6.0, 10.0)]), 0.0)
    area = c.select("k", "name", g.edges_area(g.edges("geom")).alias("area"))
    return area.groupBy("k").agg(r6(F.sum(F.when(F.col("name") == "a", F.col("area"))), "a"), r6(F.sum(F.when(F.col("name") == "b", F.col("area"))), "b"))


@query(TWO + " SELECT k, round(60.0e0+36.0e0,6) AS area FROM s")
def topology_gaps_filled(spark, d):
    """A ring of four plates around a gap of 36 square metres, which one of them takes."""
    c = topology.clean_layer(plates(spark, d, [("b", 0.0, 0.0, 10.0, 1.5), ("l", 0.0, 1.5, 2.0, 6.0), ("r", 8.0, 1.5, 2.0, 6.0), ("t", 0.0, 7.5, 10.0, 2.1)]), 0.0)
    return c.groupBy("k").agg(r6(F.sum(g.edges_area(g.edges("geom"))), "area"))


@query(TWO + " SELECT k, round(100*k+(10+2*10.2e0)/3,6) AS left_to, round(100*k+10.1e0,6) AS right_from FROM s")
def vertices_snapped(spark, d):
    """Corners that close a ring count twice in the mean."""
    c = topology.snap_vertices(plates(spark, d, [("a", 0.0, 0.0, 10.0, 10.0), ("b", 10.2, 0.0, 10.0, 10.0)]))
    b = c.select("k", "name", g.edges_bbox(g.edges("geom")).alias("b"))
    return b.groupBy("k").agg(r6(F.max(F.when(F.col("name") == "a", F.col("b.xmax"))), "left_to"), r6(F.max(F.when(F.col("name") == "b", F.col("b.xmin"))), "right_from"))


@query(TWO + " SELECT k, 140.0e0 AS area FROM s")
def dissolved_area(spark, d):
    u = topology.dissolve(plates(spark, d, [("a", 0.0, 0.0, 10.0, 10.0), ("b", 8.0, 0.0, 6.0, 10.0)]), "k")
    return u.select("k", r6(g.edges_area(g.edges("geom")), "area"))


@query(TWO + " SELECT k, 25.0e0 AS area FROM s")
def bowties_repaired(spark, d):
    """Of a crossed outline's two triangles one stays."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    pt = lambda x, y: F.struct((100.0 * F.col("k") + x).alias("x"), F.lit(float(y)).alias("y"))
    geom = F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(F.array(pt(0, 0), pt(10, 10), pt(10, 0), pt(0, 10)))).alias("parts"))
    return s.select("k", topology.make_valid(geom).alias("geom")).select("k", r6(g.edges_area(g.edges("geom")), "area"))


SELVES = """os AS (SELECT sum((least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))) AS o FROM src a JOIN src b ON a.k<b.k AND b.y<a.y+a.h AND b.y+b.h>a.y AND b.x<a.x+a.w AND b.x+b.w>a.x),
 ot AS (SELECT sum((least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))) AS o FROM tgt a JOIN tgt b ON a.k<b.k AND b.y<a.y+a.h AND b.y+b.h>a.y AND b.x<a.x+a.w AND b.x+b.w>a.x)"""


@query(f"WITH {BOXES}, {SELVES}, a AS (SELECT sum(w*h) AS v FROM src), b AS (SELECT sum(w*h) AS v FROM tgt) SELECT round(a.v,2) AS area_before, round(b.v,2) AS area_after, round(100*(b.v-a.v)/a.v,6) AS drift_pct, round(os.o,2) AS overlap_before, round(ot.o,2) AS overlap_after, round(os.o-ot.o,2) AS removed_double FROM a, b, os, ot")
def area_ledger(spark, d):
    a = topology.area_ledger(source_layer(spark, d), target_layer(spark, d))
    return a.select(*[r6(c, c, 2) for c in ("area_before", "area_after", "overlap_before", "overlap_after", "removed_double")], r6("drift_pct", "drift_pct"))


MATCHED = TWO + ", r AS (SELECT k, CASE k%3 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' ELSE 'one_to_one' END AS relation FROM s)"


@query(MATCHED + " SELECT 's'||k AS src, relation, len AS n_tgts FROM (SELECT k, relation, CASE relation WHEN 'merge' THEN 2 ELSE 1 END AS len FROM r) UNION ALL SELECT 's'||k||'b', relation, 1 FROM r WHERE relation='split'")
def assignment_relations(spark, d):
    """Two halves of one plate, one plate of two halves, and plates that correspond."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    whole, west, east = ((0.0, 10.0), (0.0, 5.0), (5.0, 5.0))
    piece = lambda q, suffix, side, at: s.filter(q).select(F.concat(F.lit(side), F.col("k").cast("string"), F.lit(suffix)).alias("fid"), "k", g.box(100.0 * F.col("k") + at[0], F.lit(0.0), F.lit(at[1]), F.lit(10.0)).alias("geom"))
    src = piece("k % 3 <> 0", "", "s", whole).unionByName(piece("k % 3 = 0", "", "s", west)).unionByName(piece("k % 3 = 0", "b", "s", east))
    tgt = piece("k % 3 <> 1", "", "t", whole).unionByName(piece("k % 3 = 1", "", "t", west)).unionByName(piece("k % 3 = 1", "b", "t", east))
    size = lambda x: x.withColumn("area", g.edges_area(g.edges("geom")))
    src, tgt = size(src), size(tgt)
    p = src.select(F.col("fid").alias("src"), "k", F.col("area").alias("a")).join(tgt.select(F.col("fid").alias("tgt"), "k", F.col("area").alias("b")), "k").select("src", "tgt", F.lit(0.9).alias("prob"), F.least("a", "b").alias("inter"))
    return assign.assign_matches(p, src, tgt).select("src", "relation", F.size("tgts").alias("n_tgts"))


# --------------------------------------------------------------- alignment


@query(f"WITH {POINTS}, n AS (SELECT p.k AS src, q.k AS tgt, sqrt(power(p.x-q.x,2)+power(p.y-q.y,2)) AS d, row_number() OVER (PARTITION BY p.k ORDER BY power(p.x-q.x,2)+power(p.y-q.y,2), q.k) AS r FROM p, q) SELECT src, tgt, round(d,6) AS dist, CAST(r AS INTEGER) AS rank FROM n WHERE r<=3")
def knn3_rings(spark, d):
    """The search by rings of cells, whatever the number of targets."""
    return blocking.nearest(customer_points(spark, d), supplier_points(spark, d), 3, 100.0, small=0).select(key("src", "src"), key("tgt", "tgt"), r6("dist", "dist"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {POINTS}, n AS (SELECT p.k AS src, q.k AS tgt, row_number() OVER (PARTITION BY p.k ORDER BY power(p.x-q.x,2)+power(p.y-q.y,2), q.k) AS r FROM p, q) SELECT src, tgt FROM n WHERE r=1")
def nearest_one(spark, d):
    return blocking.nearest(customer_points(spark, d), supplier_points(spark, d), 1, 200.0).select(key("src", "src"), key("tgt", "tgt"))


@query("""WITH v AS (SELECT ((o_orderkey*31)%119)-59.25e0 AS dx, ((o_orderkey*17)%113)-56.25e0 AS dy FROM orders), b AS (SELECT least(CAST(floor((dx+60)/(120.0e0/121)) AS INTEGER),120) AS bi, least(CAST(floor((dy+60)/(120.0e0/121)) AS INTEGER),120) AS bj FROM v WHERE abs(dx)<=60 AND abs(dy)<=60),
 n AS (SELECT bi, bj, count(*) AS n FROM b GROUP BY bi, bj), t AS (SELECT * FROM n ORDER BY n DESC, bi, bj LIMIT 1)
 SELECT round(sum(n.n*(-60+(n.bi+0.5e0)*120/121))/sum(n.n),6) AS dx, round(sum(n.n*(-60+(n.bj+0.5e0)*120/121))/sum(n.n),6) AS dy, max(t.n) AS votes FROM n, t WHERE abs(n.bi-t.bi)<=1 AND abs(n.bj-t.bj)<=1""")
def vote_peak(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(((k * 31) % 119 - F.lit(59.25)).alias("dx"), ((k * 17) % 113 - F.lit(56.25)).alias("dy"))
    return georef.vote_peak(georef.displacement_votes(v)).select(r6("dx", "dx"), r6("dy", "dy"), "votes")


CURVED = "WITH p AS (SELECT c_custkey AS k, CAST((c_custkey*7919)%3001 AS DOUBLE) AS x, CAST((c_custkey*104729)%2003 AS DOUBLE) AS y FROM customer)"


def curved(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), ((k * 7919) % 3001).cast("double").alias("x"), ((k * 104729) % 2003).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return p.select("k", "x", "y", (x + 0.1 * y + 1e-5 * x * x + 3).alias("tx"), (y - 0.05 * x + 2e-5 * x * y - 8).alias("ty"))


@query(CURVED + " SELECT k, round(x+0.1e0*y+1e-5*x*x+3,5) AS x, round(y-0.05e0*x+2e-5*x*y-8,5) AS y FROM p")
def polynomial_fit(spark, d):
    p = curved(spark, d)
    x, y = georef.Polynomial.fit(p, 2).apply(F.col("x"), F.col("y"))
    return p.select("k", r6(x, "x", 5), r6(y, "y", 5))


@query("SELECT 'similarity' AS first, 'polynomial2' AS second")
def model_escalation(spark, d):
    """The simplest model that fits: a similarity for similar points, a quadratic for curved ones."""
    one = georef.fit_best(fitted_pairs(spark, d))[0]
    two = georef.fit_best(curved(spark, d), 1e-3)[0]
    return spark.createDataFrame([(one, two)], "first string, second string")


@query(FITTED + ", r AS (SELECT 1) SELECT round(max(abs(x)),6) AS far FROM c")
def fitted_extent(spark, d):
    p = fitted_pairs(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.avg("x").alias("m")))).agg(r6(F.max(F.abs(F.col("x") - F.col("m"))), "far"))


GP = "12.25e0-power(12.25e0*exp(-(power(x-1500,2)+power(y-1000,2))/(2*297.1e0*297.1e0)),2)/(12.25e0+0.28e0+1e-8)"


@query(f"WITH {POINTS} SELECT k, round({GP},6) AS variance, round(3*12.25e0*exp(-(power(x-1500,2)+power(y-1000,2))/(2*297.1e0*297.1e0))/(12.25e0+0.28e0+1e-8),6) AS mx FROM p")
def gp_one_point(spark, d):
    """The posterior given a single point, which has a closed form."""
    model = targeting.Uncertainty(297.1, 12.25, 0.28)
    p = model.posterior(customer_points(spark, d), np.array([[1500.0, 1000.0]]), np.array([[3.0, 0.0]]))
    return p.select(key("fid", "k"), r6("variance", "variance"), r6("mx", "mx"))


@query(f"WITH {POINTS} SELECT round(sqrt(2*avg({GP}+0.28e0)),6) AS rmse FROM p")
def gp_rmse(spark, d):
    return targeting.Uncertainty(297.1, 12.25, 0.28).rmse(customer_points(spark, d), np.array([[1500.0, 1000.0]])).select(r6("rmse", "rmse"))


@query(f"""WITH {POINTS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), c AS (SELECT i, j, x0+(x1-x0)*i/59.0e0 AS x, y0+(y1-y0)*j/59.0e0 AS y FROM e, range(60) a(i), range(60) b(j))
 SELECT i, j, round(x,6) AS x, round(y,6) AS y, round(sqrt(12.25e0),6) AS before, round(sqrt({GP}),6) AS after FROM c""")
def uncertainty_grid(spark, d):
    u = targeting.uncertainty_grid(customer_points(spark, d), targeting.Uncertainty(297.1, 12.25, 0.28), np.array([[1500.0, 1000.0]]))
    return u.select("i", "j", *[r6(c, c) for c in ("x", "y", "before", "after")])


@query("SELECT round(median((1+o_orderkey%7)*(0.5e0+(o_orderkey%13)/10.0e0)/(1+o_orderkey%7)),9) AS scale FROM orders")
def prediction_scale(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select((1 + k % 7).cast("double").alias("predicted"), ((1 + k % 7) * (0.5 + (k % 13) / 10)).alias("achieved"))
    return spark.createDataFrame([(round(targeting.Uncertainty().calibrate(p).scale, 9),)], "scale double")


@query(TWO + " SELECT x, y, count(*) AS n FROM (SELECT 100.0e0*k AS x, 0.0e0 AS y FROM s UNION ALL SELECT 100.0e0*k+10, 0.0e0 FROM s UNION ALL SELECT 100.0e0*k+10, 10.0e0 FROM s UNION ALL SELECT 100.0e0*k, 10.0e0 FROM s) GROUP BY x, y")
def candidate_corners(spark, d):
    c = targeting.candidate_corners(plates(spark, d, [("a", 0.0, 0.0, 10.0, 10.0)]), 10**9)
    return c.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)*5750.0e0 AS plan_cost, 56725.0e0*count(*)/100 AS resurvey_cost FROM supplier")
def plan_costs(spark, d):
    n = table(spark, d, "supplier").count()
    c = targeting.plan_costs(n, n / 100)
    return spark.createDataFrame([(c["plan_cost"], c["resurvey_cost"])], "plan_cost double, resurvey_cost double")


# ------------------------------------------------------------ text, schema


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace('kisamCode_'||p_type||'-'||p_name,'([a-z])([A-Z])','\\1 \\2','g'),'[_\\-]+',' ','g')),'\\s+',' ','g')) AS words FROM part")
def column_words(spark, d):
    return table(spark, d, "part").select("p_partkey", t.tokenise(F.concat(F.lit("kisamCode_"), "p_type", F.lit("-"), "p_name")).alias("words"))


@query(f"WITH v AS (SELECT fid, coalesce(owner_name,'') AS v FROM parcels UNION ALL SELECT fid, coalesce(khasra_no,'') FROM parcels) SELECT fid, v, CASE WHEN regexp_matches(v,'[A-Za-z]') THEN {_fold_sql('v')} ELSE lower(trim(v)) END AS folded FROM v")
def value_keys(spark, d):
    p = table(spark, d, "parcels")
    v = p.select("fid", F.coalesce("owner_name", F.lit("")).alias("v")).unionByName(p.select("fid", F.coalesce("khasra_no", F.lit("")).alias("v")))
    return v.select("fid", "v", t.normalise_key("v").alias("folded"))


def _page_sql() -> str:
    s, quoted = "text", lambda v: "'" + v.replace("'", "''") + "'"
    for a, b in t.PAGE_FOLDS.items():
        s = f"replace({s}, {quoted(a)}, {quoted(b)})"
    return f"SELECT doc_id, md5(regexp_replace({s}, '[^\\x{{00}}-\\x{{ff}}]', '?', 'g')) AS folded FROM documents WHERE text IS NOT NULL"


@query(_page_sql())
def page_text(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(t.latin1_fold("text")).alias("folded"))


@query(f"""WITH n AS (SELECT DISTINCT {_fold_sql('owner_name')} AS a, {_fold_sql('tenure')} AS b FROM parcels WHERE owner_name IS NOT NULL AND tenure IS NOT NULL), j AS (SELECT a, b, jaro_similarity(a,b) AS j,
  CASE WHEN a[1]<>b[1] THEN 0 WHEN a[2]<>b[2] THEN 1 WHEN a[3]<>b[3] THEN 2 WHEN a[4]<>b[4] THEN 3 ELSE 4 END AS p FROM n) SELECT a, b, round(j+p*0.1e0*(1-j),6) AS similarity FROM j""")
def claim_similarity(spark, d):
    p = table(spark, d, "parcels").filter("owner_name is not null and tenure is not null").select(t.normalise_name("owner_name").alias("a"), t.normalise_name("tenure").alias("b")).distinct()
    return p.select("a", "b", r6(t.claim_similarity("a", "b"), "similarity"))


def _schema_sql() -> str:
    like = lambda c, p: f"coalesce(avg(CAST(regexp_matches({c},'{p}') AS DOUBLE)),0)"
    one = lambda c: f"""SELECT '{c}' AS "column", count(v) AS n, CASE WHEN count(v)>0 THEN count(DISTINCT v)/CAST(count(v) AS DOUBLE) ELSE 0 END AS u, {like('v', r'^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$')} AS num,
      coalesce(avg(len(string_split_regex(v,'\\s+'))),0) AS tok, {like('v', schema_match.SHAPES['khasra_like'])} AS kl, {like('v', schema_match.SHAPES['ward_like'])} AS wl, {like('lower(v)', schema_match.SHAPES['rel_marker'])} AS rel, {like('v', schema_match.SHAPES['alpha_num_fixed'])} AS anf
      FROM (SELECT nullif(trim(CAST("{c}" AS VARCHAR)),'') AS v FROM parcels_legacy)"""  # noqa: E731
    prof = " UNION ALL ".join(one(c) for c in LEGACY)
    score = {
        "khasra": "0.55e0*kl+0.45e0*least(u*1.2e0,1)", "owner": "0.4e0*least(tok/4,1)+0.3e0*least(u*1.2e0,1)+0.3e0*least(rel*2,1)", "area": "0.75e0*num+0.25e0*least(u*1.2e0,1)",
        "land_use": "0.8e0*(1-least(u*12,1))+0.2e0*(1-num)", "tenure": "0.8e0*(1-least(u*12,1))+0.2e0*(1-num)", "ward": "0.6e0*wl+0.4e0*(1-least(u*12,1))", "ulpin": "0.6e0*anf+0.4e0*least(u*1.1e0,1)",
    }
    return f"WITH p AS ({prof}) " + " UNION ALL ".join(f"""SELECT "column", '{f}' AS field, round(CASE WHEN n=0 THEN 0 ELSE {e} END,6) AS profile_score FROM p""" for f, e in score.items())


@query(_schema_sql())
def schema_profile_scores(spark, d):
    return schema_match.match_scores(table(spark, d, "parcels_legacy"), LEGACY).select("column", "field", r6("profile_score", "profile_score"))


def _names_sql() -> str:
    words = ", ".join(f"('{f}', '{w}')" for f, ws in schema_match.LEXICON.items() for w in ws)
    cols = ", ".join(f"('{c}', '{' '.join(c.lower().split('_'))}')" for c in LEGACY)
    return f"""WITH w(field, word) AS (VALUES {words}), c("column", tok) AS (VALUES {cols}), j AS (SELECT "column", field, tok, word, jaro_similarity(tok,word) AS j, CASE WHEN tok[1]<>word[1] THEN 0 WHEN len(tok)<2 OR len(word)<2 OR tok[2]<>word[2] THEN 1 WHEN len(tok)<3 OR len(word)<3 OR tok[3]<>word[3] THEN 2 WHEN len(tok)<4 OR len(word)<4 OR tok[4]<>word[4] THEN 3 ELSE 4 END AS p FROM c, w),
     s AS (SELECT *, j+p*0.1e0*(1-j) AS s FROM j) SELECT "column", field, round(max(CASE WHEN len(word)>2 AND (contains(tok,word) OR (contains(word,tok) AND len(tok)>2)) THEN greatest(s,0.92e0) ELSE s END),6) AS name_score FROM s GROUP BY "column", field"""


@query(_names_sql())
def schema_name_scores(spark, d):
    return schema_match.name_scores(spark, LEGACY).select("column", "field", r6("name_score", "name_score"))


@query(f"""WITH a AS ({_names_sql()}), b AS ({_schema_sql()}) SELECT "column", field, name_score, profile_score, round(0.5e0*name_score+0.5e0*profile_score,5) AS score FROM a JOIN b USING ("column", field)""")
def schema_scores(spark, d):
    s = match_scores(spark, d)
    return s.select("column", "field", r6("name_score", "name_score"), r6("profile_score", "profile_score"), F.round(0.5 * F.round("name_score", 6) + 0.5 * F.round("profile_score", 6), 5).alias("score"))


@query("""SELECT * FROM (VALUES ('khasra','KHSRA_NUM'), ('owner','KHATEDAR_NM'), ('area','AREA_BIGHA'), ('land_use','LU_CODE'), ('tenure','TENURE_TYP'), ('ward','WARD'), ('ulpin','PARCEL_UID')) v(field, "column")""")
def schema_mapping(spark, d):
    got, _, _ = schema_match.match_schema(table(spark, d, "parcels_legacy"), columns=LEGACY)
    return spark.createDataFrame(list(got.items()), "field string, column string")


# ------------------------------------------------------- audit and service

ENTRY = """'{"action":"escalate","actor":"'||c_name||'","after":null,"before":null,"prev_hash":"00","reason":"","role":"clerk","seq":'||c_custkey||',"target":"T'||c_custkey||'","ts":"2026-01-01T00:00:00Z"}'"""


@query(f"SELECT c_custkey, sha256({ENTRY}) AS hash FROM customer")
def audit_entry_hash(spark, d):
    c = table(spark, d, "customer")
    text = lambda v, n: F.lit(v).cast("string").alias(n)
    log = c.select(F.col("c_custkey").alias("seq"), text("2026-01-01T00:00:00Z", "ts"), F.col("c_name").alias("actor"), text("clerk", "role"), text("escalate", "action"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("target"), text("", "reason"), text(None, "before"), text(None, "after"), text("00", "prev_hash"))
    return log.select(F.col("seq").alias("c_custkey"), audit.content_hash(F.struct(*audit.FIELDS)).alias("hash"))


LOG = "WITH h AS (SELECT c_custkey AS seq, sha256(c_name) AS hash FROM customer), l AS (SELECT seq, hash, lag(hash,1,repeat('0',64)) OVER (ORDER BY seq) AS prev FROM h)"


def broken_log(spark, d):
    h = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.sha2("c_name", 256).alias("hash"))
    prev = h.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("p"))
    h = h.join(prev, "seq", "left").withColumn("prev_hash", F.when(F.col("seq") % 100 == 99, "broken").otherwise(F.coalesce("p", F.lit(audit.GENESIS)))).drop("p")
    return h.select("seq", *[F.lit(None).cast("string").alias(f) for f in audit.FIELDS[1:-1]], "prev_hash", "hash")


@query(LOG + " SELECT seq, CASE WHEN seq%100=99 THEN false ELSE true END AS link_ok FROM l")
def audit_links(spark, d):
    return audit.checked(broken_log(spark, d)).select("seq", "link_ok")


@query(LOG + " SELECT false AS intact, CAST(0 AS BIGINT) AS broken_at, 'content' AS kind, count(*) AS total FROM l")
def audit_verdict(spark, d):
    """Of a log whose contents were never hashed, with broken links: the first break is told."""
    return audit.verify(broken_log(spark, d)).select("intact", "broken_at", "kind", "total")


@query("SELECT user_id AS fid, arg_max(event_type, event_id%5*100000000-event_id) AS value FROM events WHERE event_id%2=0 GROUP BY user_id")
def latest_authority(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("fid"), F.lit("owner").alias("field"), F.col("event_type").alias("value"), (F.col("event_id") % 5).alias("vintage"), F.col("event_id").alias("pos"), (F.col("event_id") % 2 == 0).alias("lawful"))
    return resolve.latest_authority(e).select("fid", "value")


@query("SELECT * FROM (VALUES ('parcels','geojson','/export/parcels.geojson'), ('parcels','csv','/export/parcels.csv'), ('parcels','zip','/export/parcels.zip')) v(id, format, href)")
def service_exports(spark, d):
    return access.endpoints({"parcels": "parcels.geojson", "roads": "roads.geojson"}, {"parcels.geojson"}, "0", spark.createDataFrame)["exports"]


@query("SELECT * FROM (VALUES ('parcels','parcels.geojson',true), ('roads','roads.geojson',false)) v(id, file, available)")
def service_catalogue(spark, d):
    return access.catalogue({"parcels": "parcels.geojson", "roads": "roads.geojson"}, {"parcels.geojson"}, spark.createDataFrame)


# ------------------------------------------------------- readers and sinks


def written(spark: SparkSession, lines: DataFrame) -> str:
    """Folder of text files in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/plotweave-text-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


FEATURE = GEOJSON + "||'}}'"


@query(f"WITH {BOXES} SELECT lpad(CAST(k AS VARCHAR),12,'0') AS fid, {FEATURE} AS feature FROM src")
def geojson_features(spark, d):
    return writers.geojson_rows(source_layer(spark, d).select("fid", "geom", "k", F.lit(1).alias("_hidden")))


@query(f"WITH {BOXES} SELECT lpad(CAST(k AS VARCHAR),12,'0') AS fid, round(w*h,6) AS area, 'test' AS source FROM src WHERE (x BETWEEN 0 AND 500 OR x+w BETWEEN 0 AND 500) AND (y BETWEEN 0 AND 900 OR y+h BETWEEN 0 AND 900)")
def footprints_read(spark, d):
    path = written(spark, writers.geojson_rows(source_layer(spark, d).select("fid", "geom", "k")).select("feature"))
    f = readers.read_footprints(spark, path, (0.0, 0.0, 500.0, 900.0), "test")
    return f.select("fid", r6(g.edges_area(g.edges("geom")), "area"), F.col("attrs")["_source"].alias("source"))


@query(f"WITH {BOXES} SELECT k AS pos, lpad(CAST(k AS VARCHAR),12,'0') AS fid, round(w*h,6) AS area, CAST(k AS VARCHAR) AS k FROM src")
def geojson_read(spark, d):
    f = writers.geojson_rows(source_layer(spark, d).select("fid", "geom", "k")).agg(F.array_sort(F.collect_list("feature")).alias("f"))
    doc = f.select(F.concat(F.lit('{"type":"FeatureCollection","name":"boxes","features":['), F.array_join("f", ","), F.lit("]}")).alias("value"))
    rows, _ = readers.read_geojson(spark, written(spark, doc.coalesce(1)) + "/part-*")
    return rows.select("pos", "fid", r6(g.edges_area(g.edges("geom")), "area"), F.col("attrs")["k"].alias("k"))


@query("SELECT s_suppkey AS osm_id, s_suppkey%2=0 AS polygon, 'yes' AS building FROM supplier")
def map_ways_read(spark, d):
    k = F.col("s_suppkey")
    pt = lambda x, y: F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon"))
    ring = [pt(0, 0), pt(1, 0), pt(1, 1)]
    way = F.struct(F.lit("way").alias("type"), k.alias("id"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), F.when(k % 2 == 0, F.array(*ring, pt(0, 0))).otherwise(F.array(*ring)).alias("geometry"))
    doc = table(spark, d, "supplier").agg(F.collect_list(way).alias("elements")).select(F.to_json(F.struct("elements")).alias("value"))
    w = readers.read_map_ways(spark, written(spark, doc.coalesce(1)) + "/part-*")
    return w.select("osm_id", F.col("geom").isNotNull().alias("polygon"), F.col("attrs")["building"].alias("building"))


@query("SELECT c_custkey AS seq, c_name AS actor, CASE WHEN c_custkey%2=0 THEN '{\"n\":'||c_custkey||'}' END AS after FROM customer")
def audit_log_read(spark, d):
    c = table(spark, d, "customer")
    row = F.struct(F.col("c_custkey").alias("seq"), F.col("c_name").alias("actor"), F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_custkey").alias("n"))).alias("after"))
    return audit.read_log(spark, written(spark, c.select(F.to_json(row).alias("value")))).select("seq", "actor", "after")


@query("SELECT c_custkey, c_name FROM customer")
def artifact_round_trip(spark, d):
    folder = f"{ensure_checkpoint_dir(spark)}/plotweave-artifacts-{uuid.uuid4().hex}"
    writers.write_tables({"customers": table(spark, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("_hidden"))}, folder)
    return readers.load_artifact(spark, folder, "customers")


@query(f"""WITH l AS ({LONLAT}), a AS (SELECT k, CAST(floor((lon+180)/360*512) AS INTEGER) AS x, CAST(floor((0.5e0-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*512) AS INTEGER) AS y FROM l),
  q AS (SELECT k, {'||'.join(f"CAST(((x>>{i})&1)+2*((y>>{i})&1) AS VARCHAR)" for i in range(8, -1, -1))} AS quadkey FROM a) SELECT k, quadkey FROM q WHERE quadkey IN (SELECT quadkey FROM q WHERE k%7=0)""")
def tiles_for(spark, d):
    l = lonlat(spark, d)
    return readers.tiles_for(l.select("k", readers.quadkey("lon", "lat").alias("quadkey")), l.filter("k % 7 = 0")).select("k", "quadkey")
