"""Queries of the matching engine's operators over the star-schema tables, each with its SQL.

Two polygon layers are laid out from orders: a box an order, and a displaced
copy with some boxes gone. Everything runs over whole tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import clean_fid, cut, first_of, table
from ..functions import crs, geometry as g, text as t
from ..operators import access, assign, audit, blocking, change, georef, graph, layers, matcher, metrics, proximity, resolve, schema_match, targeting, topology
from ..sources import readers, synth, writers
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def r6(c, name: str | None = None, places: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, places)
    return out.alias(name) if name else out


# ------------------------------------------------------------------ layers

BOXES = """src AS (SELECT o_orderkey AS k, 20*(o_orderkey%100) + 0.01e0*((o_orderkey*7919)%500) AS x, CAST(20*(o_orderkey//100) AS DOUBLE) AS y,
  CAST(15+(o_orderkey*31)%9 AS DOUBLE) AS w, CAST(14+(o_orderkey*17)%9 AS DOUBLE) AS h, o_totalprice AS price FROM orders),
tgt AS (SELECT k, x+1.5e0 AS x, y-0.7e0 AS y, w, h, price FROM src WHERE k%23<>0)"""
INTER = """inter AS (SELECT s.k AS src, t.k AS tgt, s.w*s.h AS a, t.w*t.h AS b, s.x+s.w/2 AS ax, s.y+s.h/2 AS ay, t.x+t.w/2 AS bx, t.y+t.h/2 AS b_y,
  (least(s.x+s.w,t.x+t.w)-greatest(s.x,t.x)) AS ox, (least(s.y+s.h,t.y+t.h)-greatest(s.y,t.y)) AS oy
  FROM src s JOIN tgt t ON t.y<=s.y+s.h AND t.y+t.h>=s.y AND t.x<=s.x+s.w AND t.x+t.w>=s.x)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("k"), (20 * (k % 100) + F.lit(0.01) * ((k * 7919) % 500)).alias("x"), (20 * F.floor(k / 100)).cast("double").alias("y"),
        (15 + (k * 31) % 9).cast("double").alias("w"), (14 + (k * 17) % 9).cast("double").alias("h"), F.col("o_totalprice").alias("price"),
    )
    return o.withColumn("fid", F.lpad(F.col("k").cast("string"), 12, "0"))


def source_layer(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("fid", "k", g.box("x", "y", "w", "h").alias("geom"), F.col("price").alias("height_m"))


def target_layer(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).filter("k % 23 <> 0")
    return b.select("fid", "k", g.box(F.col("x") + 1.5, F.col("y") - 0.7, F.col("w"), F.col("h")).alias("geom"), F.col("price").alias("height_m"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose boxes meet, with overlap and IoU."""
    a, b = blocking.prepared(source_layer(spark, d)), blocking.prepared(target_layer(spark, d))
    p = blocking.block(a, b, 0.0, None, 40.0)
    return blocking.pair_overlap(p, a, b).withColumn("iou", g.iou("inter", "src_area", "tgt_area"))


key = lambda c, name: F.col(c).cast("long").alias(name)


@query(f"WITH {BOXES} SELECT k, round(w*h,6) AS area, round(2*(w+h),6) AS perimeter, round(4*pi()*w*h/power(2*(w+h),2),6) AS compactness, 5 AS n_vertices FROM src")
def box_area_perimeter(spark, d):
    m = g.measured(source_layer(spark, d))
    return m.select("k", r6("area", "area"), r6("perimeter", "perimeter"), r6(g.compactness("area", "perimeter"), "compactness"), g.vertex_count("geom").cast("int").alias("n_vertices"))


@query(f"WITH {BOXES} SELECT round(sum(w*h),2) AS total_area FROM src")
def layer_total_area(spark, d):
    return layers.total_area(source_layer(spark, d)).select(r6("total_area", "total_area", 2))


@query(f"WITH {BOXES} SELECT round(min(x),6) AS xmin, round(min(y),6) AS ymin, round(max(x+w),6) AS xmax, round(max(y+h),6) AS ymax FROM src")
def layer_extent(spark, d):
    return layers.extent(source_layer(spark, d)).select(*[r6(c, c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {BOXES} SELECT s.k AS src, t.k AS tgt FROM src s JOIN tgt t ON t.y<=s.y+s.h+18 AND t.y+t.h>=s.y-18 AND t.x<=s.x+s.w+18 AND t.x+t.w>=s.x-18")
def block_range_join(spark, d):
    p = blocking.block(blocking.prepared(source_layer(spark, d)), blocking.prepared(target_layer(spark, d)), 18.0, None)
    return p.select(key("src", "src"), key("tgt", "tgt"))


@query(f"""WITH {BOXES}, p AS (SELECT s.k AS src, t.k AS tgt, least(s.x+s.w,t.x+t.w)-greatest(s.x,t.x) AS ox, least(s.y+s.h,t.y+t.h)-greatest(s.y,t.y) AS oy,
  power(s.x+s.w/2-t.x-t.w/2,2)+power(s.y+s.h/2-t.y-t.h/2,2) AS d2 FROM src s JOIN tgt t ON t.y<=s.y+s.h+30 AND t.y+t.h>=s.y-30 AND t.x<=s.x+s.w+30 AND t.x+t.w>=s.x-30),
  q AS (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY (ox>0 AND oy>0) DESC, CASE WHEN ox>0 AND oy>0 THEN round(ox*oy,6) ELSE -round(d2,6) END DESC, tgt) AS r FROM p)
  SELECT src, count(*) AS n FROM q WHERE r<=18 GROUP BY src""")
def block_topk18(spark, d):
    p = blocking.block(blocking.prepared(source_layer(spark, d)), blocking.prepared(target_layer(spark, d)), 30.0)
    return p.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(key("src", "src"), "n")


@query(f"""WITH {BOXES}, {INTER}, i AS (SELECT *, ox*oy AS o FROM inter)
  SELECT src, tgt, round(o,6) AS inter, round(o/(a+b-o),6) AS iou, round((a+b-2*o)/((a+b)/2),6) AS sym_diff, round(sqrt(power(ax-bx,2)+power(ay-b_y,2)),6) AS centroid_dist,
  round(least(a,b)/greatest(a,b),6) AS area_ratio, round(o/a,6) AS src_frac, round(o/b,6) AS tgt_frac FROM i""")
def pair_iou_fracs(spark, d):
    p = pairs_of(spark, d)
    a, b, i = F.col("src_area"), F.col("tgt_area"), F.col("inter")
    return p.select(
        key("src", "src"), key("tgt", "tgt"), r6(i, "inter"), r6("iou", "iou"), r6(g.normalised_symmetric_difference(i, a, b), "sym_diff"),
        r6(g.centroid_offset("src_cx", "src_cy", "tgt_cx", "tgt_cy"), "centroid_dist"), r6(g.area_ratio(a, b), "area_ratio"), r6(i / a, "src_frac"), r6(i / b, "tgt_frac"),
    )


@query(f"""WITH {BOXES}, {INTER}, i AS (SELECT src, tgt, round(ox*oy/(a+b-ox*oy),9) AS iou FROM inter),
  r AS (SELECT *, count(*) OVER (PARTITION BY src) AS n_candidates, row_number() OVER (PARTITION BY src ORDER BY iou DESC, tgt)-1 AS iou_rank, row_number() OVER (PARTITION BY tgt ORDER BY iou DESC, src)-1 AS rev_iou_rank FROM i)
  SELECT src, tgt, CAST(n_candidates AS BIGINT) AS n_candidates, CAST(iou_rank AS BIGINT) AS iou_rank, round(max(iou) OVER (PARTITION BY src) - coalesce(max(CASE WHEN iou_rank=1 THEN iou END) OVER (PARTITION BY src),0),6) AS iou_margin,
  CAST(iou_rank=0 AS INTEGER) AS is_best_iou, CAST(rev_iou_rank AS BIGINT) AS rev_iou_rank FROM r""")
def context_features(spark, d):
    c = blocking.context(pairs_of(spark, d).select("src", "tgt", r6("iou", "iou", 9)))
    big = lambda n: F.col(n).cast("long").alias(n)
    return c.select(key("src", "src"), key("tgt", "tgt"), big("n_candidates"), big("iou_rank"), r6("iou_margin", "iou_margin"), "is_best_iou", big("rev_iou_rank"))


BEST = f"""WITH {BOXES}, {INTER}, i AS (SELECT src, tgt, ox*oy/(a+b-ox*oy) AS iou FROM inter WHERE ox>0 AND oy>0),
  b AS (SELECT src, tgt, iou, row_number() OVER (PARTITION BY src ORDER BY iou DESC, tgt) AS r FROM i)"""


@query(BEST + " SELECT src, tgt, round(iou,6) AS iou FROM b WHERE r=1")
def best_match(spark, d):
    return blocking.best_match(pairs_of(spark, d)).select(key("src", "src"), key("tgt", "tgt"), r6("iou", "iou"))


@query(BEST + " SELECT k FROM src WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src=src.k AND r=1 AND iou>=0.55)")
def unmatched_anti(spark, d):
    used = blocking.best_match(pairs_of(spark, d)).filter("iou >= 0.55").select(F.col("src").alias("fid"))
    return source_layer(spark, d).join(used.distinct(), "fid", "left_anti").select("k")


SELF = f"""WITH {BOXES}, p AS (SELECT s.k AS a, t.k AS b, (least(s.x+s.w,t.x+t.w)-greatest(s.x,t.x))*(least(s.y+s.h,t.y+t.h)-greatest(s.y,t.y)) AS area
  FROM src s JOIN src t ON s.k<t.k AND t.y<s.y+s.h AND t.y+t.h>s.y AND t.x<s.x+s.w AND t.x+t.w>s.x)"""


@query(SELF + " SELECT a, b, round(area,6) AS area FROM p WHERE area>0.000001")
def overlap_self_join(spark, d):
    return topology.overlap_pairs(source_layer(spark, d)).select(key("a", "a"), key("b", "b"), r6("area", "area"))


@query(SELF + " SELECT count(*) AS n, round(sum(area),3) AS area FROM p WHERE area>0.000001")
def overlap_stats(spark, d):
    return topology.overlap_pairs(source_layer(spark, d)).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("area"), "area", 3))


LAND = f"""WITH {BOXES}, land AS (SELECT DISTINCT k//2000 AS g, CAST(0 AS DOUBLE) AS x, CAST(400*(k//2000) AS DOUBLE) AS y, 300.0e0 AS w, 107.0e0 AS h FROM src)"""


@query(LAND + """, p AS (SELECT s.k, l.g, s.w*s.h AS a, (least(s.x+s.w,l.x+l.w)-greatest(s.x,l.x))*(least(s.y+s.h,l.y+l.h)-greatest(s.y,l.y)) AS area
  FROM src s JOIN land l ON l.y<s.y+s.h AND l.y+l.h>s.y AND l.x<s.x+s.w AND l.x+l.w>s.x)
  SELECT k, g, round(area,6) AS area, CASE WHEN area/a>0.6 THEN 'severe' WHEN area/a>0.2 THEN 'significant' ELSE 'minor' END AS severity FROM p WHERE area>=5""")
def encroachment_severity(spark, d):
    b = boxes(spark, d).select(F.floor(F.col("k") / 2000).alias("g")).distinct()
    land = b.select(F.col("g").cast("string").alias("fid"), g.box(F.lit(0.0), (400 * F.col("g")).cast("double"), F.lit(300.0), F.lit(107.0)).alias("geom"))
    e = change.detect_encroachment(source_layer(spark, d), land)
    return e.select(key("fid", "k"), key("govt_fid", "g"), r6("area", "area"), "severity")


EPOCHS = f"""WITH {BOXES}, t0 AS (SELECT k, x, y, w, h, price/40000 AS ht FROM src WHERE k%11<>0), t1 AS (SELECT k, x, y, w+CASE WHEN k%7=0 THEN 1 ELSE 0 END AS w, h, price/40000+CASE WHEN k%5=0 THEN 3.1e0 ELSE 0 END AS ht FROM src WHERE k%13<>0),
  p AS (SELECT a.k AS k, b.k AS m, a.w*a.h AS aa, b.w*b.h AS ba, a.ht AS ah, b.ht AS bh, (least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) AS o
   FROM t1 a JOIN t0 b ON b.y<a.y+a.h AND b.y+b.h>a.y AND b.x<a.x+a.w AND b.x+b.w>a.x),
  q AS (SELECT *, o/(aa+ba-o) AS iou, row_number() OVER (PARTITION BY k ORDER BY o/(aa+ba-o) DESC, m) AS r FROM p), best AS (SELECT * FROM q WHERE r=1),
  j AS (SELECT t1.k, t1.w*t1.h AS area, coalesce(iou,0) AS iou, m, area-ba AS da, ah-bh AS dh FROM t1 LEFT JOIN best ON best.k=t1.k),
  e AS (SELECT k, CASE WHEN iou<0.55 THEN 'new' WHEN da>=8 THEN 'extended' WHEN da<=-8 THEN 'reduced' WHEN dh>=2.6 THEN 'heightened' END AS kind, CASE WHEN iou<0.55 THEN area ELSE da END AS delta FROM j
   UNION ALL SELECT k, 'demolished', -w*h FROM t0 WHERE k NOT IN (SELECT m FROM best WHERE iou>=0.55))"""


@query(EPOCHS + " SELECT k, kind, round(delta,6) AS delta FROM e WHERE kind IS NOT NULL")
def change_events(spark, d):
    b = boxes(spark, d)
    layer = lambda x, extra, rise: x.select("fid", "k", g.box(F.col("x"), F.col("y"), F.col("w") + extra, F.col("h")).alias("geom"), (F.col("price") / 40000 + rise).alias("height_m"))
    t0 = layer(b.filter("k % 11 <> 0"), F.lit(0.0), F.lit(0.0))
    t1 = layer(b.filter("k % 13 <> 0"), F.when(F.col("k") % 7 == 0, 1.0).otherwise(0.0), F.when(F.col("k") % 5 == 0, 3.1).otherwise(0.0))
    return change.detect_change(t0, t1).select(key("fid", "k"), "kind", r6("delta_sqm", "delta"))


# -------------------------------------------------------------- alignment

POINTS = """p AS (SELECT c_custkey AS k, CAST((c_custkey*7919)%3001 AS DOUBLE) AS x, CAST((c_custkey*104729)%2003 AS DOUBLE) AS y FROM customer), q AS (SELECT s_suppkey AS k, CAST((s_suppkey*7907)%3001 AS DOUBLE) AS x, CAST((s_suppkey*104723)%2003 AS DOUBLE) AS y FROM supplier)"""


def customer_points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.lpad(k.cast("string"), 12, "0").alias("fid"), ((k * 7919) % 3001).cast("double").alias("x"), ((k * 104729) % 2003).cast("double").alias("y"))


def supplier_points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.lpad(k.cast("string"), 12, "0").alias("fid"), ((k * 7907) % 3001).cast("double").alias("x"), ((k * 104723) % 2003).cast("double").alias("y"))


@query(f"WITH {POINTS}, n AS (SELECT p.k AS src, q.k AS tgt, sqrt(power(p.x-q.x,2)+power(p.y-q.y,2)) AS d, row_number() OVER (PARTITION BY p.k ORDER BY power(p.x-q.x,2)+power(p.y-q.y,2), q.k) AS r FROM p, q) SELECT src, tgt, round(d,6) AS dist, CAST(r AS INTEGER) AS rank FROM n WHERE r<=6")
def knn6(spark, d):
    return blocking.nearest(customer_points(spark, d), supplier_points(spark, d), 6, 200.0).select(key("src", "src"), key("tgt", "tgt"), r6("dist", "dist"), F.col("rank").cast("int").alias("rank"))


@query("""WITH v AS (SELECT ((o_orderkey*31)%119)-59.25e0 AS dx, ((o_orderkey*17)%113)-56.25e0 AS dy FROM orders), b AS (SELECT least(CAST(floor((dx+60)/(120.0e0/121)) AS INTEGER),120) AS bi, least(CAST(floor((dy+60)/(120.0e0/121)) AS INTEGER),120) AS bj FROM v WHERE abs(dx)<=60 AND abs(dy)<=60)
  SELECT bi, bj, count(*) AS n FROM b GROUP BY bi, bj""")
def hough_vote(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(((k * 31) % 119 - F.lit(59.25)).alias("dx"), ((k * 17) % 113 - F.lit(56.25)).alias("dy"))
    return georef.displacement_votes(v).select("bi", "bj", "n")


FITTED = """WITH p AS (SELECT CAST((c_custkey*7919)%3001 AS DOUBLE) AS x, CAST((c_custkey*104729)%2003 AS DOUBLE) AS y, c_custkey AS k FROM customer), q AS (SELECT x, y, 0.999e0*x-0.012e0*y+6.5e0+(k%5)*0.1e0 AS tx, 0.012e0*x+0.999e0*y-4.2e0-(k%7)*0.1e0 AS ty FROM p),
  c AS (SELECT x-avg(x) OVER () AS x, y-avg(y) OVER () AS y, tx-avg(tx) OVER () AS u, ty-avg(ty) OVER () AS v FROM q)"""


def fitted_pairs(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), ((k * 7919) % 3001).cast("double").alias("x"), ((k * 104729) % 2003).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return p.select("x", "y", (0.999 * x - 0.012 * y + 6.5 + (F.col("k") % 5) * 0.1).alias("tx"), (0.012 * x + 0.999 * y - 4.2 - (F.col("k") % 7) * 0.1).alias("ty"))


@query(FITTED + " SELECT round(sum(x*u+y*v)/sum(x*x+y*y),9) AS a, round(sum(x*v-y*u)/sum(x*x+y*y),9) AS b FROM c")
def similarity_fit(spark, d):
    return georef.similarity_sums(fitted_pairs(spark, d)).select(r6(F.col("p") / F.col("q"), "a", 9), r6(F.col("r") / F.col("q"), "b", 9))


@query(FITTED + ", s AS (SELECT sum(x*u+y*v)/sum(x*x+y*y) AS a, sum(x*v-y*u)/sum(x*x+y*y) AS b FROM c) SELECT round(sqrt(avg(power(a*x-b*y-u,2)+power(b*x+a*y-v,2))),6) AS rmse FROM c, s")
def align_rmse(spark, d):
    p = fitted_pairs(spark, d)
    return georef.rmse(p, georef.fit_similarity(p)).select(r6("rmse", "rmse"))


LONLAT = "SELECT c_custkey AS k, 78+(c_custkey*7919%6000)/1000.0e0 AS lon, 8+(c_custkey*104729%28000)/1000.0e0 AS lat FROM customer"


def lonlat(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), (78 + (k * 7919 % 6000) / F.lit(1000.0)).alias("lon"), (8 + (k * 104729 % 28000) / F.lit(1000.0)).alias("lat"))


E2 = "(2-1/298.257223563e0)/298.257223563e0"
UTM_SQL = f"""WITH l AS ({LONLAT}), a AS (SELECT k, radians(lat) AS phi, radians(lon-81) AS lam, {E2} AS e2 FROM l),
 b AS (SELECT k, phi, e2, e2/(1-e2) AS ep, 6378137.0e0/sqrt(1-e2*power(sin(phi),2)) AS n, power(tan(phi),2) AS t, e2/(1-e2)*power(cos(phi),2) AS c, cos(phi)*lam AS a,
  6378137.0e0*((1-e2/4-3*power(e2,2)/64-5*power(e2,3)/256)*phi-(3*e2/8+3*power(e2,2)/32+45*power(e2,3)/1024)*sin(2*phi)+(15*power(e2,2)/256+45*power(e2,3)/1024)*sin(4*phi)-(35*power(e2,3)/3072)*sin(6*phi)) AS m FROM a)"""


@query(UTM_SQL + """ SELECT k, 44 AS zone, 32644 AS epsg, round(0.9996e0*n*(a+(1-t+c)*power(a,3)/6+(5-18*t+t*t+72*c-58*ep)*power(a,5)/120)+500000,4) AS east,
 round(0.9996e0*(m+n*tan(phi)*(a*a/2+(5-t+9*c+4*c*c)*power(a,4)/24+(61-58*t+t*t+600*c-330*ep)*power(a,6)/720)),4) AS north FROM b""")
def utm_forward(spark, d):
    e, n = crs.geodetic_to_utm("lon", "lat", F.lit(44))
    zone = crs.utm_zone("lon")
    return lonlat(spark, d).select("k", zone.alias("zone"), crs.utm_epsg(zone, F.col("lat") >= 0).alias("epsg"), r6(e, "east", 4), r6(n, "north", 4))


@query(f"WITH l AS ({LONLAT}) SELECT k, round(lon,6) AS lon, round(lat,6) AS lat FROM l")
def utm_inverse(spark, d):
    e, n = crs.geodetic_to_utm("lon", "lat", F.lit(44))
    u = lonlat(spark, d).select("k", e.alias("e"), n.alias("n"))
    lon, lat = crs.utm_to_geodetic("e", "n", F.lit(44))
    return u.select("k", r6(lon, "lon"), r6(lat, "lat"))


@query(f"""WITH l AS ({LONLAT}), s AS (SELECT k, radians(lon) AS lam, radians(lat) AS phi, 6377276.345e0 AS a, (2-1/300.8017e0)/300.8017e0 AS e2 FROM l), n AS (SELECT *, a/sqrt(1-e2*power(sin(phi),2)) AS n FROM s)
 SELECT k, round(n*cos(phi)*cos(lam)+295,3) AS x, round(n*cos(phi)*sin(lam)+736,3) AS y, round(n*(1-e2)*sin(phi)+257,3) AS z FROM n""")
def helmert_ecef(spark, d):
    x, y, z = crs.helmert(*crs.geodetic_to_ecef("lon", "lat", F.lit(0.0), crs.EVEREST_1830))
    return lonlat(spark, d).select("k", r6(x, "x", 3), r6(y, "y", 3), r6(z, "z", 3))


@query(f"WITH l AS ({LONLAT}) SELECT k, round(lon,7) AS lon, round(lat,7) AS lat, 0.0e0 AS h FROM l")
def datum_round_trip(spark, d):
    a = crs.everest_to_wgs84("lon", "lat")
    m = lonlat(spark, d).select("k", *[c.alias(n) for c, n in zip(a, ("lo", "la", "h"), strict=True)])
    b = crs.wgs84_to_everest("lo", "la", F.col("h"))
    return m.select("k", r6(b[0], "lon", 7), r6(b[1], "lat", 7), F.abs(r6(b[2], None, 4)).alias("h"))


# -------------------------------------------------------------------- text


def _fold_sql(c: str) -> str:
    s = f"lower(trim(coalesce({c},'')))"
    s = f"regexp_replace({s}, '\\b([swd])\\s*[/\\.]?\\s*o\\b', '\\1/o', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9/\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for names, to in t.NAME_FOLDS:
        s = f"regexp_replace({s}, '\\b(?:{'|'.join(names)})\\b', '{to}', 'g')"
    return s


@query(f"SELECT fid, coalesce(owner_name,'') AS owner, {_fold_sql('owner_name')} AS folded FROM parcels")
def name_normalise(spark, d):
    return table(spark, d, "parcels").select("fid", F.coalesce("owner_name", F.lit("")).alias("owner"), t.normalise_name("owner_name").alias("folded"))


@query("""WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(p_name,' ')) AS a, list_distinct(string_split(p_type,' ')) AS b FROM part)
  SELECT k, round(len(list_intersect(a,b))/CAST(len(list_distinct(list_concat(a,b))) AS DOUBLE),6) AS ratio FROM w""")
def token_set(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(t.token_set_ratio("p_name", "p_type"), "ratio"))


@query("""WITH n AS (SELECT fid, coalesce(owner_name,'') AS a, coalesce(tenure,'') AS b FROM parcels WHERE owner_name IS NOT NULL AND tenure IS NOT NULL), j AS (SELECT DISTINCT a, b, jaro_similarity(a,b) AS j,
  CASE WHEN a[1]<>b[1] THEN 0 WHEN a[2]<>b[2] THEN 1 WHEN a[3]<>b[3] THEN 2 WHEN a[4]<>b[4] THEN 3 ELSE 4 END AS p FROM n) SELECT a, b, round(j+p*0.1e0*(1-j),6) AS jw FROM j""")
def jaro_winkler(spark, d):
    p = table(spark, d, "parcels").filter("owner_name is not null and tenure is not null").select(F.col("owner_name").alias("a"), F.col("tenure").alias("b")).distinct()
    return p.select("a", "b", r6(t.jaro_winkler("a", "b"), "jw"))


KH = t.KHASRA


@query(f"""SELECT fid, khasra_no, TRY_CAST(nullif(regexp_extract(khasra_no,'{KH}',1),'') AS BIGINT) AS parent, TRY_CAST(nullif(regexp_extract(khasra_no,'{KH}',2),'') AS BIGINT) AS child, TRY_CAST(nullif(regexp_extract(khasra_no,'{KH}',3),'') AS BIGINT) AS sub FROM parcels""")
def khasra_parse(spark, d):
    return table(spark, d, "parcels").select("fid", "khasra_no", t.parse_khasra("khasra_no").alias("p")).select("fid", "khasra_no", "p.*")


@query(f"""WITH p AS (SELECT fid, TRY_CAST(nullif(regexp_extract(khasra_no,'{KH}',1),'') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(khasra_no,'{KH}',2),'') AS BIGINT) AS b, TRY_CAST(nullif(regexp_extract(parent_khasra,'{KH}',1),'') AS BIGINT) AS c FROM parcels)
  SELECT fid, CASE WHEN a=c AND b IS NULL THEN 1.0e0 ELSE 0 END AS kh_exact, CASE WHEN a=c THEN 1.0e0 ELSE 0 END AS kh_parent, 0.0e0 AS kh_child, CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 1.0e0 ELSE 0 END AS kh_present FROM p""")
def khasra_compare(spark, d):
    return table(spark, d, "parcels").select("fid", *[c.alias(k) for k, c in t.khasra_similarity("khasra_no", "parent_khasra").items()])


PROFILED = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _profile_sql() -> str:
    one = lambda c: f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(nullif(trim(CAST({c} AS VARCHAR)),'')) AS n, count(DISTINCT {c}) AS n_distinct, round(avg(CAST(regexp_matches(CAST({c} AS VARCHAR),'^[-+]?(\\d+\\.?\\d*|\\.\\d+)$') AS DOUBLE)),6) AS numeric_ratio,
      round(avg(len(string_split_regex(CAST({c} AS VARCHAR),'\\s+'))),6) AS mean_tokens FROM part"""  # noqa: E731
    return " UNION ALL ".join(one(c) for c in PROFILED)


@query(_profile_sql())
def column_profile(spark, d):
    p = schema_match.column_profile(table(spark, d, "part"), PROFILED)
    return p.select("column", F.col("rows").alias("n_rows"), "n", F.round(F.col("unique_ratio") * F.col("n")).cast("long").alias("n_distinct"), r6("numeric_ratio", "numeric_ratio"), r6("mean_tokens", "mean_tokens"))


@query("""WITH q AS (SELECT (l_extendedprice)/(l_extendedprice/2529.285e0*(1+(l_orderkey%7-3)/100.0e0)) AS q FROM lineitem WHERE l_extendedprice>0), s AS (SELECT count(*) AS n, quantile_cont(q,0.25) AS a, quantile_cont(q,0.5) AS m, quantile_cont(q,0.75) AS b FROM q)
  SELECT 'bigha' AS unit, 2529.285e0 AS scale, round(greatest(0,1-abs(ln(m/2529.285e0))/0.35)*least(1,greatest(0,1.5-(b/a-1))),6) AS confidence, n FROM s""")
def unit_inference(spark, d):
    p = table(spark, d, "lineitem").filter("l_extendedprice > 0").select(F.col("l_extendedprice").alias("geometric"), (F.col("l_extendedprice") / 2529.285 * (1 + (F.col("l_orderkey") % 7 - 3) / F.lit(100.0))).alias("recorded"))
    return schema_match.infer_area_unit(p).select("unit", "scale", r6("confidence", "confidence"), "n")


def schema_scores(spark, d):
    return schema_match.match_scores(table(spark, d, "parcels_legacy"), ["KHSRA_NUM", "KHATEDAR_NM", "AREA_BIGHA", "LU_CODE", "TENURE_TYP", "WARD", "PARCEL_UID"])


# ------------------------------------------------------------------ claims

ACC = [0.03, 0.10, 1.20, 2.50, 6.00, 8.00]
VIN = [2026, 2025, 2024, 2019, 1987, 2023]
SOURCES_SQL = " UNION ALL ".join(f"SELECT {i} AS s, {a}e0 AS acc, {v} AS vin" for i, (a, v) in enumerate(zip(ACC, VIN, strict=True)))
CLAIMS_SQL = f"WITH so AS ({SOURCES_SQL}), c AS (SELECT l_orderkey AS fid, l_quantity AS v, l_shipmode AS x, l_linenumber AS pos, acc, 1/(acc*acc)*(0.5+0.5*exp(-greatest(2026-vin,0)/25.0e0)) AS w FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) JOIN so ON so.s=l_suppkey%6)"


def order_claims(spark, d, field: str, value: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    c = l.select(F.col("l_orderkey").alias("fid"), F.lit(field).alias("field"), F.col(value).cast("string").alias("value"), (F.col("l_suppkey") % 6).cast("string").alias("source_id"), F.lit(None).cast("double").alias("confidence"), F.col("l_linenumber").alias("pos"))
    s = spark.createDataFrame([(str(i), a, v, None) for i, (a, v) in enumerate(zip(ACC, VIN, strict=True))], "source_id string, accuracy_m double, vintage long, authority array<string>")
    return resolve.weighted(c, s)


@query(CLAIMS_SQL + ", m AS (SELECT fid, count(*) AS k, sum(v*w)/sum(w) AS mu, sqrt(1/sum(w)) AS sg FROM c GROUP BY fid) SELECT c.fid, any_value(k) AS k, round(any_value(mu),6) AS fused, round(any_value(sg),6) AS sigma, round(CASE WHEN any_value(k)<2 THEN 1 ELSE exp(-avg(power((v-mu)/acc,2))/4) END,4) AS agreement FROM c JOIN m ON m.fid=c.fid GROUP BY c.fid")
def claim_fusion(spark, d):
    return resolve.numeric_fusion(order_claims(spark, d, "area", "l_quantity")).select("fid", "k", r6("fused", "fused"), r6("sigma", "sigma"), r6("agreement", "agreement", 4))


@query(CLAIMS_SQL + ", b AS (SELECT fid, lower(x) AS key, sum(w) AS w, min(pos) AS p, arg_min(x,pos) AS value FROM c GROUP BY fid, lower(x)), r AS (SELECT *, sum(w) OVER (PARTITION BY fid) AS total, count(*) OVER (PARTITION BY fid) AS n_keys, row_number() OVER (PARTITION BY fid ORDER BY round(w,6) DESC, p, key) AS r FROM b) SELECT fid, value, round(w/total,6) AS share, n_keys FROM r WHERE r=1")
def claim_vote(spark, d):
    return resolve.vote(order_claims(spark, d, "land_use", "l_returnflag")).select("fid", "value", r6("share", "share"), "n_keys")


@query(CLAIMS_SQL + """, p AS (SELECT a.fid, a.pos AS i, b.pos AS k, 1-least(abs(a.v-b.v)/greatest(abs(a.v),abs(b.v),1e-9),1) AS sim FROM c a JOIN c b ON a.fid=b.fid AND a.pos<b.pos)
  SELECT x.fid, count(*) AS n FROM p x JOIN p y ON y.fid=x.fid AND y.i=x.k JOIN p z ON z.fid=x.fid AND z.i=x.i AND z.k=y.k WHERE x.sim>=0.82 AND y.sim>=0.82 AND z.sim<0.82 GROUP BY x.fid""")
def transitive_claims(spark, d):
    return resolve.transitive(order_claims(spark, d, "area", "l_quantity")).groupBy("fid").agg(F.count(F.lit(1)).alias("n"))


@query()
def claim_resolution(spark, d):
    c = table(spark, d, "claims").dropDuplicates(["claim_id"]).withColumn("pos", F.col("claim_id"))
    return resolve.resolve_claims(c, table(spark, d, "sources"))


# ----------------------------------------------------------------- metrics

SCORED = "WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS y, ((o_orderkey*37)%1000)/1000.0e0 AS p FROM orders)"


def scored(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_orderkey") * 37) % 1000 / F.lit(1000.0)).alias("p"))


@query(SCORED + ", c AS (SELECT count(*) FILTER (p>=0.5 AND y=1) AS tp, count(*) FILTER (p>=0.5 AND y=0) AS fp, count(*) FILTER (p<0.5 AND y=1) AS fn, count(*) FILTER (p<0.5 AND y=0) AS tn FROM s) SELECT *, round(tp/CAST(tp+fp AS DOUBLE),6) AS precision, round(tp/CAST(tp+fn AS DOUBLE),6) AS recall, round(2.0e0*tp/(2*tp+fp+fn),6) AS f1 FROM c")
def confusion_prf(spark, d):
    return metrics.confusion(scored(spark, d)).select("tp", "fp", "fn", "tn", *[r6(c, c) for c in ("precision", "recall", "f1")])


@query(SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0e0 AS r FROM s), n AS (SELECT sum(y) AS n1, count(*)-sum(y) AS n0, sum(CASE WHEN y=1 THEN r END) AS s FROM r) SELECT round((s-n1*(n1+1)/2.0e0)/(n1*n0),6) AS roc_auc FROM n")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d)).select(r6("roc_auc", "roc_auc"))


RANKED = SCORED + ", r AS (SELECT *, row_number() OVER w AS k, sum(y) OVER w AS tp FROM s WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING))"


@query(RANKED + " SELECT round(sum(CASE WHEN y=1 THEN tp/CAST(k AS DOUBLE) END)/sum(y),6) AS avg_precision FROM r")
def avg_precision(spark, d):
    return metrics.average_precision(scored(spark, d)).select(r6("avg_precision", "avg_precision"))


@query(SCORED + " SELECT round(avg(power(p-y,2)),9) AS brier FROM s")
def brier(spark, d):
    return metrics.brier(scored(spark, d)).select(r6("brier", "brier", 9))


BINS = SCORED + ", b AS (SELECT least(CAST(floor(p*10) AS INTEGER),9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM s GROUP BY 1)"


@query(BINS + " SELECT bin, n, round(mp,6) AS mean_p, round(rate,6) AS rate FROM b")
def reliability(spark, d):
    return metrics.reliability(scored(spark, d)).select("bin", "n", r6("mean_p", "mean_p"), r6("rate", "rate"))


@query(BINS + " SELECT round(sum(n*abs(mp-rate))/sum(n),6) AS ece FROM b")
def calibration_error(spark, d):
    return metrics.expected_calibration_error(scored(spark, d)).select(r6("ece", "ece"))


@query(RANKED + ", o AS (SELECT max(k) AS k FROM r WHERE tp/CAST(k AS DOUBLE)>=0.45) SELECT round(r.k/CAST((SELECT count(*) FROM s) AS DOUBLE),6) AS coverage, r.p AS threshold, round(tp/CAST(r.k AS DOUBLE),6) AS precision FROM r JOIN o ON r.k=o.k")
def coverage_at_precision(spark, d):
    return metrics.coverage_at_precision(scored(spark, d), 0.45).select(r6("coverage", "coverage"), "threshold", r6("precision", "precision"))


# ------------------------------------------------- graph, audit and access


@query("""WITH e AS (SELECT 'c'||lpad(CAST(c_custkey AS VARCHAR),9,'0') AS c, 'n'||c_nationkey AS n FROM customer), m AS (SELECT n, min(c) AS comp FROM e GROUP BY n) SELECT c AS node, comp FROM e JOIN m USING (n) UNION ALL SELECT n, comp FROM m""")
def components_min_label(spark, d):
    e = table(spark, d, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"))
    return graph.components(e)


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), h AS (SELECT i, c_custkey, sha256(repeat('0',64)||c_name) AS hash FROM r WHERE i=1 UNION ALL SELECT r.i, r.c_custkey, sha256(h.hash||r.c_name) FROM h JOIN r ON r.i=h.i+1) SELECT c_custkey, hash FROM h""")
def audit_chain_build(spark, d):
    return audit.build_chain(table(spark, d, "customer"), "c_custkey", "c_name")


@query("SELECT c_custkey AS fid, c_mktsegment AS \"LU_CODE\", c_acctbal AS area_sqm, 'c_name' AS withheld FROM customer")
def redacted_layer(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("LU_CODE"), F.col("c_acctbal").alias("area_sqm"), "c_name")
    return access.redact(c, "public").select("fid", "LU_CODE", "area_sqm", F.array_join("_redacted", ",").alias("withheld"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, 'survey' AS may_act FROM orders WHERE o_orderstatus='O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def review_queue(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), "o_totalprice")
    return access.review_queue(o, "surveyor", "O", 500, [F.desc("o_totalprice"), "id"]).select("id", "status", F.array_join("may_act", ",").alias("may_act"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50")
def ogc_page(spark, d):
    return access.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 100, 50)[0]


@query("SELECT count(*) AS \"numberMatched\", CAST(least(greatest(count(*)-50,0),100) AS BIGINT) AS \"numberReturned\" FROM customer")
def ogc_page_counts(spark, d):
    return access.page(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 100, 50)[1].select("numberMatched", F.col("numberReturned").cast("long").alias("numberReturned"))


@query("SELECT p_name, p_partkey FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' ORDER BY p_name, p_partkey LIMIT 6")
def search_topk(spark, d):
    p = table(spark, d, "part").select("p_name", "p_partkey", "p_brand")
    return access.search(p, "red", ["p_name", "p_brand"], None, "public", order=["p_name", "p_partkey"]).select("p_name", "p_partkey")


@query("SELECT o_orderkey AS k, CASE WHEN (o_orderkey%101)/100.0e0>=0.95 THEN 'ok' WHEN (o_orderkey%101)/100.0e0>=0.7 THEN 'warn' ELSE 'critical' END AS tier FROM orders")
def confidence_tiers(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), access.confidence_tier((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("tier"))


# ------------------------------------------------------ sources and sinks


@query(f"WITH {BOXES} SELECT k, round((x+(x+w)+(x+w)+x+x)/5,7) AS lon, round((y+y+(y+h)+(y+h)+y)/5,7) AS lat FROM src")
def csv_export_rows(spark, d):
    return writers.csv_rows(source_layer(spark, d).select("fid", "k", "geom")).select("k", r6("lon", "lon", 7), r6("lat", "lat", 7))


GEOJSON = """'{"type":"Feature","id":"'||lpad(CAST(k AS VARCHAR),12,'0')||'","geometry":{"type":"Polygon","coordinates":[[['||x||','||y||'],['||(x+w)||','||y||'],['||(x+w)||','||(y+h)||'],['||x||','||(y+h)||'],['||x||','||y||']]]},"properties":{"k":'||k"""


@query(f"""WITH {BOXES} SELECT lpad(CAST(k AS VARCHAR),12,'0') AS fid, {GEOJSON}||',"height_m":'||price||'}}}}' AS feature FROM src""")
def geojson_rows(spark, d):
    return writers.geojson_rows(source_layer(spark, d))


@query(f"""WITH l AS ({LONLAT}), a AS (SELECT k, CAST(floor((lon+180)/360*512) AS INTEGER) AS x, CAST(floor((0.5e0-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*512) AS INTEGER) AS y FROM l)
  SELECT k, {'||'.join(f"CAST(((x>>{i})&1)+2*((y>>{i})&1) AS VARCHAR)" for i in range(8, -1, -1))} AS quadkey FROM a""")
def quadkeys(spark, d):
    return lonlat(spark, d).select("k", readers.quadkey("lon", "lat").alias("quadkey"))


@query("WITH n AS (SELECT n_nationkey AS k, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1) SELECT k, n, CASE WHEN n>=3000 THEN 'excellent' WHEN n>=1200 THEN 'good' WHEN n>=300 THEN 'sparse' ELSE 'unusable' END AS verdict FROM n")
def density_probe(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k")).agg(F.count("c_custkey").alias("n"))
    return n.withColumn("verdict", readers.density_verdict("n"))


@query("WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice)-1 AS i, count(*) OVER () AS n FROM orders) SELECT max(CASE WHEN i=n//2 THEN v END) AS median, max(CASE WHEN i=n//20 THEN v END) AS p05 FROM s")
def index_percentiles(spark, d):
    return readers.pick(table(spark, d, "orders"), "o_totalprice", {"median": 1 / 2, "p05": 1 / 20})


# --------------------------------------------------------------- streaming


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windows.event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total", "total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events), s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# ------------------------------------- models and algorithms without SQL


def given(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """All records of a given layer that have an outline, one row a fid."""
    t_ = table(spark, d, name).select(clean_fid("fid").alias("fid"), "geom", *columns).filter("fid is not null and size(geom.parts) > 0 and size(geom.parts[0][0]) > 2")
    return first_of(t_, ["fid"])


def city_size(spark: SparkSession, d: str) -> synth.CityConfig:
    """A city of as many blocks as the given parcels extend over, never fewer than the generator's own default."""
    r = table(spark, d, "parcels").agg(F.max("block_i").alias("i"), F.max("block_j").alias("j")).head()
    c = synth.CityConfig()
    return synth.CityConfig(blocks_x=max(c.blocks_x, (r["i"] or 0) + 1), blocks_y=max(c.blocks_y, (r["j"] or 0) + 1))


@query()
def city_layers(spark, d):
    return synth.generate_city(spark, city_size(spark, d)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query()
def coarse_alignment(spark, d):
    """Similarity of the whole legacy layer onto the parcels, and the median distance before and after."""
    a = georef.centres(table(spark, d, "parcels_legacy").dropDuplicates(["fid"]).filter("geom is not null"))
    b = georef.centres(table(spark, d, "parcels").dropDuplicates(["fid"]))
    m = georef.coarse_align(a, b)
    return spark.createDataFrame([(m.a, m.b, m.tx, m.ty, m.scale, m.rotation_deg)], "a double, b double, tx double, ty double, scale double, rotation_deg double")


LEGACY = ["KHSRA_NUM", "KHATEDAR_NM", "AREA_BIGHA", "LU_CODE", "TENURE_TYP", "WARD", "PARCEL_UID"]
PARCEL = ["khasra_no", "owner_name", "recorded_area_sqm", "land_use", "tenure", "ward_no", "ulpin"]


def candidate_pairs(legacy: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all candidate pairs of a legacy layer and the parcels, and both layers as described."""
    m = georef.coarse_align(georef.centres(legacy), georef.centres(parcels))
    x = lambda a, b: m.apply(a, b)
    moved = legacy.withColumn("geom", g.map_points("geom", lambda a, b: x(a, b)[0], lambda a, b: x(a, b)[1]))
    src = cut(blocking.described(moved, {"khasra": "KHSRA_NUM", "owner": "KHATEDAR_NM", "area": "AREA_BIGHA", "land_use": "LU_CODE", "tenure": "TENURE_TYP", "ward": "WARD", "ulpin": "PARCEL_UID"}))
    tgt = cut(blocking.described(parcels, {"khasra": "khasra_no", "owner": "owner_name", "land_use": "land_use", "tenure": "tenure", "ward": "ward_no", "ulpin": "ulpin"}))
    return cut(blocking.pair_features(blocking.block(src, tgt), src, tgt, 2529.285)), src, tgt


def given_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return candidate_pairs(cut(given(spark, d, "parcels_legacy", *LEGACY)), cut(given(spark, d, "parcels", *PARCEL)))


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of all given parcels and their damaged twin, with ``y`` by its answer key."""
    parcels = cut(given(spark, d, "parcels", *PARCEL))
    twin = cut(synth.corrupt_cadastre(parcels))
    truth = twin.select(F.col("fid").alias("src"), F.explode("truth_fids").alias("tgt")).withColumn("y", F.lit(1))
    return cut(candidate_pairs(twin, parcels)[0].join(truth, ["src", "tgt"], "left").na.fill(0, ["y"]))


@query()
def pair_features29(spark, d):
    return given_pairs(spark, d)[0]


@query()
def gbdt_match(spark, d):
    """Held-out precision, recall and F1 of the matcher trained on the twin of all parcels; pairs it scores and takes of the given layers."""
    p = matcher.group_split(labelled_pairs(spark, d), "src")
    m = matcher.PairMatcher().fit(p.filter("not held"))
    report = metrics.classification_report(m.predict(p.filter("held")).select("y", F.col("prob").alias("p"), F.concat_ws("|", "src", "tgt").alias("id")))
    taken = m.predict(given_pairs(spark, d)[0]).agg(F.count(F.lit(1)).alias("given_pairs"), F.count_if(F.col("prob") >= 0.5).alias("given_matches"))
    return report.crossJoin(F.broadcast(taken))


@query()
def global_assignment(spark, d):
    p, src, tgt = given_pairs(spark, d)
    prob = 1 / (1 + F.exp(-12 * (F.greatest("src_frac_in_tgt", "tgt_frac_in_src") - 0.5)))
    scored_pairs = p.select("src", "tgt", prob.alias("prob"), (F.col("src_frac_in_tgt")).alias("f")).join(src.select(F.col("fid").alias("src"), "area"), "src").withColumn("inter", F.col("f") * F.col("area")).drop("f", "area")
    return assign.assign_matches(scored_pairs, src, tgt).drop("comp", "siblings")


@query()
def topology_clean(spark, d):
    legacy = cut(given(spark, d, "parcels_legacy"))
    return topology.area_ledger(legacy, cut(topology.clean_layer(legacy)))


@query()
def topology_diagnosis(spark, d):
    return topology.diagnose(cut(given(spark, d, "parcels_legacy")))


UNCERTAINTY = targeting.Uncertainty(297.1, 12.25, 0.28)


def whole_plan(spark: SparkSession, d: str) -> tuple[list[dict], str]:
    """Plan of the operator's default size for the given parcels, and why it stopped."""
    p = cut(given(spark, d, "parcels"))
    return targeting.plan_survey(georef.centres(p), targeting.candidate_corners(p), UNCERTAINTY)


@query()
def gp_posterior(spark, d):
    """Posterior spread at every survey position given all points of the plan."""
    pts = proximity.survey_positions(table(spark, d, "survey_points")).select("x", "y")
    return UNCERTAINTY.posterior(pts, np.array([(r["x"], r["y"]) for r in whole_plan(spark, d)[0]], float).reshape(-1, 2))


@query()
def survey_plan(spark, d):
    plan, why = whole_plan(spark, d)
    cols = ["rank", "x", "y", "marginal_gain", "rmse_before", "rmse_after", "rmse_delta"]
    return spark.createDataFrame([tuple(r[c] for c in cols) + (r["reason"], why) for r in plan], "rank int, x double, y double, marginal_gain double, rmse_before double, rmse_after double, rmse_delta double, reason string, stopped string")


@query()
def epoch_recovery(spark, d):
    """Injected against detected changes of a later state of each whole snapshot of the given buildings."""
    b = table(spark, d, "buildings").select(clean_fid("fid").alias("fid"), "epoch", "geom", "height_m", "loaded_at").filter("fid is not null and epoch is not null and size(geom.parts) > 0")
    b = cut(b.groupBy("epoch", "fid").agg(F.max_by(F.struct("geom", "height_m"), F.struct("loaded_at", "geom", "height_m")).alias("r")).select("epoch", "fid", "r.*"))
    e = layers.extent(b).head()
    out = []
    for r in b.select("epoch").distinct().orderBy("epoch").collect():
        before = b.filter(F.col("epoch") == r["epoch"]).drop("epoch")
        later = cut(synth.build_epoch(before, north=max(5_000.0, 100.0 + e["ymax"] - e["ymin"])))
        found = change.detect_change(before, later).filter("kind <> 'demolished'")
        out.append(later.join(found.select("fid", "kind"), "fid", "left").groupBy("injected", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(r["epoch"]).alias("epoch"), "injected", "kind", "n"))
    none = spark.createDataFrame([], "epoch string, injected string, kind string, n bigint")
    return functools.reduce(DataFrame.unionByName, out, none)
