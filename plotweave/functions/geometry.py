"""Planar geometry as Column expressions (JVM side, no Python).

A geometry is ``STRUCT<kind, parts ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>>``.
``edges`` turns one into a flat list of directed edges with outer rings
counter-clockwise and holes clockwise; area, centroid and the overlay kernel
all work on that list. Rings may start anywhere, run either way, lack the
closing point or repeat points; null or NaN points are ignored; a ring of
fewer than three points has no edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def let(value: Column, body) -> Column:
    """Bind an expression once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(ring: Column) -> Column:
    return F.filter(ring, lambda v: v.getField("x").isNotNull() & v.getField("y").isNotNull() & ~F.isnan(v.getField("x")) & ~F.isnan(v.getField("y")))


def _loop(ring: Column) -> Column:
    """Edges of one ring, closed, in the order given."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.when(
        F.size(ring) >= 3,
        F.zip_with(
            ring,
            nxt,
            lambda a, b: F.struct(a.getField("x").alias("x1"), a.getField("y").alias("y1"), b.getField("x").alias("x2"), b.getField("y").alias("y2")),
        ),
    ).otherwise(F.array().cast(EDGES_TYPE))


def _signed(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e.getField("x1") - e.getField("x2")) * (e.getField("y1") + e.getField("y2")) / 2)


def _swap(e: Column) -> Column:
    return F.struct(e.getField("x2").alias("x1"), e.getField("y2").alias("y1"), e.getField("x1").alias("x2"), e.getField("y1").alias("y2"))


def edges(geom) -> Column:
    """Directed edges of a geometry; empty for null or broken input."""
    parts = F.coalesce(col(geom).getField("parts"), F.array().cast("array<array<array<struct<x:double,y:double>>>>"))

    def ring(r: Column, i: Column) -> Column:
        return let(
            _loop(_clean(F.coalesce(r, F.array().cast("array<struct<x:double,y:double>>")))),
            lambda es: F.when((_signed(es) >= 0) == (i == 0), es).otherwise(F.reverse(F.transform(es, _swap))),
        )

    return F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(F.coalesce(p, F.array().cast("array<array<struct<x:double,y:double>>>")), ring))))


def edges_area(es) -> Column:
    """Area of an edge list, square units of the coordinates; 0 for an empty one."""
    return F.abs(_signed(col(es)))


def edges_perimeter(es) -> Column:
    return F.aggregate(
        col(es), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e.getField("x2") - e.getField("x1"), 2) + F.pow(e.getField("y2") - e.getField("y1"), 2))
    )


def edges_bbox(es) -> Column:
    """``STRUCT<xmin, ymin, xmax, ymax>``; null for an empty list."""
    es = col(es)
    xs, ys = es.getField("x1"), es.getField("y1")
    return F.when(
        F.size(es) > 0,
        F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")),
    )


def edges_centroid(es) -> Column:
    """``STRUCT<x, y>`` of the area centroid; of the vertices if the area is nil."""
    es = col(es)
    # moments about the first vertex: UTM northings would lose half the digits
    def moments(ox: Column, oy: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

        def add(s: Column, e: Column) -> Column:
            x1, y1, x2, y2 = e.getField("x1") - ox, e.getField("y1") - oy, e.getField("x2") - ox, e.getField("y2") - oy
            k = x1 * y2 - x2 * y1
            return F.struct((s.getField("a") + k).alias("a"), (s.getField("mx") + (x1 + x2) * k).alias("mx"), (s.getField("my") + (y1 + y2) * k).alias("my"))

        return F.aggregate(es, zero, add)

    first = F.element_at(es, 1)
    n = F.size(es)
    mean = lambda f: F.aggregate(es, F.lit(0.0), lambda s, e: s + e.getField(f)) / n
    m = moments(first.getField("x1"), first.getField("y1"))
    return F.when(
        n > 0,
        let(
            m,
            lambda s: F.when(
                F.abs(s.getField("a")) > 1e-9,
                F.struct(
                    (first.getField("x1") + s.getField("mx") / (3 * s.getField("a"))).alias("x"),
                    (first.getField("y1") + s.getField("my") / (3 * s.getField("a"))).alias("y"),
                ),
            ).otherwise(F.struct(mean("x1").alias("x"), mean("y1").alias("y"))),
        ),
    )


def packed(es, bbox, kind: str = "float") -> Column:
    """Rings of an edge list as ``ARRAY<FLOAT>`` (or doubles): offsets from the box's corner, NaN pairs after each ring.

    An eighth of the edges' size in a shuffle; floats of offsets keep a relative
    precision of 1e-7 of the outline's own extent.
    """
    es, bbox = col(es), col(bbox)

    def point(e: Column, i: Column) -> Column:
        nxt = F.get(es, i + 1)
        x, y = (e.getField("x1") - bbox.getField("xmin")).cast(kind), (e.getField("y1") - bbox.getField("ymin")).cast(kind)
        nan = F.lit(float("nan")).cast(kind)
        same = (nxt.getField("x1") == e.getField("x2")) & (nxt.getField("y1") == e.getField("y2"))
        return F.when(F.coalesce(same, F.lit(False)), F.array(x, y)).otherwise(F.array(x, y, nan, nan))

    return F.flatten(F.transform(es, point))


def measured(df, geom: str = "geom", prefix: str = ""):
    """Add ``edges, area, perimeter, bbox, cx, cy`` of a geometry column."""
    out = df.withColumn(f"{prefix}edges", edges(geom))
    c = f"{prefix}edges"
    return (
        out.withColumn(f"{prefix}area", edges_area(c))
        .withColumn(f"{prefix}perimeter", edges_perimeter(c))
        .withColumn(f"{prefix}bbox", edges_bbox(c))
        .withColumn(f"{prefix}cx", edges_centroid(c).getField("x"))
        .withColumn(f"{prefix}cy", edges_centroid(c).getField("y"))
    )


def compactness(area, perimeter) -> Column:
    """4 pi A / P^2; 0 where the perimeter is nil."""
    a, p = col(area), col(perimeter)
    return F.when(p > 0, 4 * math.pi * a / (p * p)).otherwise(0.0)


def area_ratio(a, b) -> Column:
    """Smaller over larger; 0 if either is nil."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def iou(inter, a, b) -> Column:
    i, a, b = col(inter), col(a), col(b)
    return F.when(a + b - i > 0, i / (a + b - i)).otherwise(0.0)


def normalised_symmetric_difference(inter, a, b) -> Column:
    """(A + B - 2I) over the mean area; 1 where the mean area is nil."""
    i, a, b = col(inter), col(a), col(b)
    return F.when(a + b > 0, (a + b - 2 * i) / ((a + b) / 2)).otherwise(1.0)


def centroid_offset(ax, ay, bx, by) -> Column:
    return F.hypot(col(ax) - col(bx), col(ay) - col(by))


def vertex_count(geom) -> Column:
    """Points of the outer ring of the first part, the closing point included."""
    r = _clean(F.element_at(F.element_at(col(geom).getField("parts"), 1), 1))
    first, last = F.element_at(r, 1), F.element_at(r, -1)
    return F.when(F.size(r) == 0, 0).otherwise(F.size(r) + F.when((first.getField("x") == last.getField("x")) & (first.getField("y") == last.getField("y")), 0).otherwise(1))


def box(x, y, w, h) -> Column:
    """Axis-parallel rectangle as a geometry."""
    x, y, w, h = col(x), col(y), col(w), col(h)
    pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h), pt(x, y)))).alias("parts"))


def map_points(geom, fx, fy) -> Column:
    """Apply (x, y) -> (fx, fy) to every vertex."""
    g = col(geom)
    return F.when(
        g.isNotNull(),
        F.struct(
            g.getField("kind").alias("kind"),
            F.transform(
                g.getField("parts"),
                lambda p: F.transform(
                    p, lambda r: F.transform(r, lambda v: F.struct(fx(v.getField("x"), v.getField("y")).alias("x"), fy(v.getField("x"), v.getField("y")).alias("y")))
                ),
            ).alias("parts"),
        ),
    )


def translate(geom, dx, dy) -> Column:
    return map_points(geom, lambda x, y: x + dx, lambda x, y: y + dy)


def scale_rotate(geom, a: float, b: float, tx: float, ty: float, ox: float = 0.0, oy: float = 0.0) -> Column:
    """Similarity (a, b, tx, ty) about an origin."""
    return map_points(
        geom,
        lambda x, y: F.lit(a) * (x - ox) - F.lit(b) * (y - oy) + ox + tx,
        lambda x, y: F.lit(b) * (x - ox) + F.lit(a) * (y - oy) + oy + ty,
    )


def ring_lerp(r0, r1, t: float) -> Column:
    """Points between two rings of equal length, paired by position; null if lengths differ."""
    r0, r1 = col(r0), col(r1)
    return F.when(
        F.size(r0) == F.size(r1),
        F.zip_with(
            r0,
            r1,
            lambda a, b: F.struct(
                (a.getField("x") + (b.getField("x") - a.getField("x")) * t).alias("x"), (a.getField("y") + (b.getField("y") - a.getField("y")) * t).alias("y")
            ),
        ),
    )


def any_vertex_in_bbox(geom, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return F.coalesce(
        F.exists(
            F.flatten(F.flatten(col(geom).getField("parts"))),
            lambda v: v.getField("x").between(xmin, xmax) & v.getField("y").between(ymin, ymax),
        ),
        F.lit(False),
    )


def lonlat_area(geom) -> Column:
    """Shoelace area of a lon/lat geometry with a metre scale taken at its mean latitude."""
    es = edges(geom)

    def body(e: Column) -> Column:
        lat = F.radians(F.aggregate(e, F.lit(0.0), lambda s, v: s + v.getField("y1")) / F.size(e))
        m_lat = 111132.92 - 559.82 * F.cos(2 * lat) + 1.175 * F.cos(4 * lat)
        m_lon = 111412.84 * F.cos(lat) - 93.5 * F.cos(3 * lat)
        return edges_area(e) * m_lat * m_lon

    return let(es, lambda e: F.when(F.size(e) > 0, body(e)).otherwise(0.0))


def ring_length(ring) -> Column:
    """Length of a ring or line of points, without the way back to its start."""
    r = col(ring)
    step = F.zip_with(r, F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.hypot(b.getField("x") - a.getField("x"), b.getField("y") - a.getField("y"))).otherwise(0.0))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def point_along(ring, distance) -> Column:
    """``STRUCT<x, y>`` at a distance along a line of points; its ends beyond them, null for an empty one."""
    r, d = col(ring), col(distance)
    seg = F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b.getField("x") - a.getField("x"), b.getField("y") - a.getField("y")).alias("n")))
    zero = F.struct(F.greatest(d, F.lit(0.0)).cast("double").alias("left"), F.get(r, F.lit(0)).alias("p"))

    def go(s: Column, e: Column) -> Column:
        left, n, a, b = s.getField("left"), e.getField("n"), e.getField("a"), e.getField("b")
        t = F.when(n > 0, F.least(left / n, F.lit(1.0))).otherwise(1.0)
        on = lambda f: (a.getField(f) + (b.getField(f) - a.getField(f)) * t).alias(f)
        return F.when(left <= 0, s).otherwise(F.struct((left - n).alias("left"), F.struct(on("x"), on("y")).alias("p")))

    return F.when(F.size(r) > 0, F.aggregate(seg, zero, go).getField("p"))


def register(spark) -> list[str]:
    """The kernel as SQL functions of the session; their names.

    ``geo_area(geom)``, ``geo_bbox(geom)``, ``geo_intersection_area(a, b)`` and
    ``geo_iou(a, b)``; null and broken geometry has area 0 and no box.
    """
    from . import kernel

    made = kernel.sql_functions()
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)
