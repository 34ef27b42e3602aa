"""Vectorised overlay kernel over Arrow batches.

The overlap area of two polygons is a sum over pairs of their edges, so a
whole batch of pairs is one set of numpy arrays: no polygon is built, no
degenerate case exists. For directed edges e of A and f of B (outer rings
counter-clockwise, holes clockwise)

    area(A and B) = sum over e, f of s(e) s(f) * integral of min(e(x), f(x)) dx

over the common x range, where s is +1 for an edge that runs to the left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F, types as T

#: Edge pairs worked on at once; bounds the memory of a batch (about 100 bytes each).
CHUNK = 400_000


def unpack(col: pa.Array, ox: pa.Array, oy: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (n, 4) of packed outlines, and start and number of each row's edges."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    ox, oy = np.asarray(ox, dtype=float), np.asarray(oy, dtype=float)
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64) // 2
    lo, hi = off[0] * 2, off[-1] * 2
    p = np.asarray(col.values[lo:hi], dtype=np.float64).reshape(-1, 2)
    off -= off[0]
    rows = len(col)
    size = np.diff(off)
    if col.null_count:
        size = np.where(np.asarray(col.is_null()), 0, size)
    row = np.repeat(np.arange(rows), np.diff(off))
    end = np.isnan(p[:, 0])
    real = ~end
    # the point after a ring's last one is its first
    ring = np.cumsum(end) - end
    first = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]) if end.any() else np.zeros(1, int)
    nxt = np.arange(1, len(p) + 1)
    last = real & np.concatenate([end[1:], [True]])
    nxt[last] = first[ring[last]]
    nxt = nxt[real]
    o = np.column_stack([ox[row], oy[row]])
    q = p + o if len(p) else p
    n = np.bincount(row[real], minlength=rows)[:rows] if len(p) else np.zeros(rows, int)
    n = np.where(size > 0, n, 0)
    return np.concatenate([q[real], q[nxt]], axis=1) if len(p) else np.empty((0, 4)), np.cumsum(n) - n, n


def overlap_areas(ea: np.ndarray, sa: np.ndarray, na: np.ndarray, eb: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Overlap area of each row's two edge lists."""
    rows = len(na)
    out = np.zeros(rows)
    todo = na * nb
    if not rows or not todo.sum():
        return out
    cum = np.cumsum(todo)
    start = 0
    while start < rows:
        base = cum[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(cum, base + CHUNK, side="right")))
        k = todo[start:stop]
        row = np.repeat(np.arange(start, stop), k)
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        e = ea[sa[row] + inner // nb[row]]
        f = eb[sb[row] + inner % nb[row]]
        lo = np.maximum(np.minimum(e[:, 0], e[:, 2]), np.minimum(f[:, 0], f[:, 2]))
        hi = np.minimum(np.maximum(e[:, 0], e[:, 2]), np.maximum(f[:, 0], f[:, 2]))
        keep = hi > lo
        row, e, f, lo, hi = row[keep], e[keep], f[keep], lo[keep], hi[keep]
        # heights above a common base per row, so that large northings cost no digits
        y0 = ea[np.minimum(sa[row], len(ea) - 1), 1]
        me, mf = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]), (f[:, 3] - f[:, 1]) / (f[:, 2] - f[:, 0])
        el, er = e[:, 1] - y0 + me * (lo - e[:, 0]), e[:, 1] - y0 + me * (hi - e[:, 0])
        fl, fr = f[:, 1] - y0 + mf * (lo - f[:, 0]), f[:, 1] - y0 + mf * (hi - f[:, 0])
        dl, dr = el - fl, er - fr
        ml, mr = np.minimum(el, fl), np.minimum(er, fr)
        cross = dl * dr < 0
        t = np.where(cross, dl / np.where(cross, dl - dr, 1.0), 0.0)
        c = el + t * (er - el)
        area = (hi - lo) * np.where(cross, t * (ml + c) / 2 + (1 - t) * (c + mr) / 2, (ml + mr) / 2)
        sign = np.sign(e[:, 0] - e[:, 2]) * np.sign(f[:, 0] - f[:, 2])
        out += np.bincount(row, weights=sign * area, minlength=rows)[:rows]
        start = stop
    return np.maximum(out, 0.0)


@F.arrow_udf(T.DoubleType())
def _overlap_area(a: pa.Array, ax: pa.Array, ay: pa.Array, b: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    ea, sa, na = unpack(a, ax, ay)
    eb, sb, nb = unpack(b, bx, by)
    return pa.array(overlap_areas(ea, sa, na, eb, sb, nb), pa.float64())


def overlap_area(a: str, abox: str, b: str, bbox: str):
    """Overlap area of two packed outlines (see geometry.packed); 0 if either is null or empty."""
    corner = lambda c: (F.coalesce(F.col(f"{c}.xmin"), F.lit(0.0)), F.coalesce(F.col(f"{c}.ymin"), F.lit(0.0)))
    return _overlap_area(a, *corner(abox), b, *corner(bbox))


# ----------------------------------------------------------------- outlines

BOX = T.StructType([T.StructField(f, T.DoubleType()) for f in ("xmin", "ymin", "xmax", "ymax")])


def rings_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points (n, 2) of all usable rings of a column of parts, and start, row and place in its part of each ring.

    Null and NaN points don't count; a ring of fewer than three points is left
    out. Outer rings come counter-clockwise and holes clockwise, from the first
    point given.
    """
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    # flatten() skips what lies under a null; offsets are rebuilt from the lengths
    size = lambda a: np.asarray(pa.compute.fill_null(pa.compute.list_value_length(a), 0)).astype(np.int64)
    polygons = parts.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    row = np.repeat(np.arange(len(parts)), size(parts))
    k = size(polygons)
    place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    row = np.repeat(row, k)
    n = size(rings)
    xy = np.column_stack([np.asarray(pa.compute.fill_null(pa.compute.struct_field(points, f), np.nan), dtype=float) for f in (0, 1)]).reshape(-1, 2)
    ring = np.repeat(np.arange(len(n)), n)
    ok = ~np.isnan(xy).any(axis=1)
    n = np.bincount(ring[ok], minlength=len(n))
    ok &= (n >= 3)[ring]
    xy, n, row, place = xy[ok], n[n >= 3], row[n >= 3], place[n >= 3]
    start = np.cumsum(n) - n
    if not len(n):
        return xy, start, row, place
    ring, at = np.repeat(np.arange(len(n)), n), np.arange(len(xy)) - np.repeat(start, n)
    turned = (twice_signed(xy, start, n) >= 0) != (place == 0)
    back = np.where(turned[ring] & (at > 0), n[ring] - at, at)
    return xy[start[ring] + back], start, row, place


def twice_signed(xy: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the signed area of each ring, from its first point so that large northings cost no digits."""
    d = xy - np.repeat(xy[start], n, axis=0)
    nxt = _next(start, n)
    return np.add.reduceat(d[:, 0] * d[nxt, 1] - d[nxt, 0] * d[:, 1], start)


def _next(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index of each point's successor in its ring."""
    nxt = np.arange(1, n.sum() + 1)
    nxt[start + n - 1] = start
    return nxt


def _outline(kind, measures: bool):
    fields = [T.StructField("area", T.DoubleType()), T.StructField("bbox", BOX), T.StructField("pack", T.ArrayType(kind))]
    if measures:
        fields += [T.StructField(f, T.DoubleType()) for f in ("perimeter", "cx", "cy")]
    to = pa.float32() if isinstance(kind, T.FloatType) else pa.float64()

    @F.arrow_udf(T.StructType(fields))
    def run(parts: pa.Array) -> pa.Array:
        rows = len(parts)
        xy, start, row, place = rings_of(parts)
        n = np.diff(np.append(start, len(xy)))
        some = np.zeros(rows, bool)
        some[row] = True
        area, box, per, mid = np.zeros(rows), np.zeros((rows, 4)), np.zeros(rows), np.zeros((rows, 2))
        sizes = np.zeros(rows, np.int64)
        flat = np.empty(0)
        if len(n):
            first = np.flatnonzero(np.diff(np.concatenate([[-1], row])))  # a row's first ring
            own = row[first]
            lo, hi = np.minimum.reduceat(xy, start[first]), np.maximum.reduceat(xy, start[first])
            box[own] = np.concatenate([lo, hi], axis=1)
            twice = twice_signed(xy, start, n)
            area[own] = np.abs(np.add.reduceat(twice, first)) / 2
            pos = xy - np.repeat(box[row, :2], n, axis=0)
            if measures:
                nxt = _next(start, n)
                per[own] = np.add.reduceat(np.hypot(*(pos[nxt] - pos).T), start[first])
                k = (pos[:, 0] * pos[nxt, 1] - pos[nxt, 0] * pos[:, 1])[:, None]
                moment = np.add.reduceat((pos + pos[nxt]) * k, start[first])
                whole = np.add.reduceat(k[:, 0], start[first])
                mean = np.add.reduceat(pos, start[first]) / np.add.reduceat(n, first)[:, None]
                thin = np.abs(whole) <= 1e-9
                mid[own] = box[own, :2] + np.where(thin[:, None], mean, moment / (3 * np.where(thin, 1.0, whole))[:, None])
            flat = np.full((len(xy) + len(n), 2), np.nan)
            flat[np.arange(len(xy)) + np.repeat(np.arange(len(n)), n)] = pos
            flat = flat.reshape(-1)
            sizes[own] = 2 * np.add.reduceat(n + 1, first)
        none = pa.array(~some)
        bbox = pa.StructArray.from_arrays([pa.array(box[:, i].copy()) for i in range(4)], ["xmin", "ymin", "xmax", "ymax"], mask=none)
        pack = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, to, from_pandas=False))
        cols = [pa.array(area), bbox, pack]
        if measures:
            cols += [pa.array(per), pa.array(mid[:, 0].copy(), mask=~some), pa.array(mid[:, 1].copy(), mask=~some)]
        return pa.StructArray.from_arrays(cols, [f.name for f in fields])

    return run


_float_outline, _measured_outline = _outline(T.FloatType(), False), _outline(T.DoubleType(), True)


def outline(geom):
    """``STRUCT<area, bbox, pack>`` of a geometry column; see geometry.packed for the pack.

    One vectorised pass, where the same in array expressions is interpreted point
    by point. Null, empty and broken geometry: area 0, no box, an empty pack.
    """
    return _float_outline(F.col(geom).getField("parts") if isinstance(geom, str) else geom.getField("parts"))


def measured_outline(geom):
    """``outline`` in doubles with ``perimeter, cx, cy``, the centroid being that of the area (of the points if there is none)."""
    return _measured_outline(F.col(geom).getField("parts") if isinstance(geom, str) else geom.getField("parts"))


# ---------------------------------------------------------------- triangles


def _area2(p: np.ndarray) -> float:
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def tidy_ring(points) -> np.ndarray:
    """Ring without null, repeated, closing and collinear points; counter-clockwise; empty if degenerate."""
    p = [(q["x"], q["y"]) for q in points if q is not None and q["x"] is not None and q["y"] is not None]
    p = [q for q in p if q[0] == q[0] and q[1] == q[1]]
    i = 0
    # a ring is short: plain floats beat arrays here
    while len(p) >= 3 and i < len(p):
        (ax, ay), (bx, by), (cx, cy) = p[i - 1], p[i], p[(i + 1) % len(p)]
        if abs((bx - ax) * (cy - by) - (by - ay) * (cx - bx)) < 1e-9:
            del p[i]
            i = max(0, i - 2)
        else:
            i += 1
    if len(p) < 3:
        return np.empty((0, 2))
    ring = np.array(p, dtype=float)
    return ring[::-1] if _area2(ring) < 0 else ring


def _bridge(outer: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """Join holes to the outer ring by cuts to a visible vertex, rightmost hole first."""
    ring = [tuple(v) for v in outer]
    for h in sorted(holes, key=lambda r: -r[:, 0].max()):
        h = [tuple(v) for v in h[::-1]]
        k = max(range(len(h)), key=lambda i: h[i])
        hx, hy = h[k]
        order = sorted(range(len(ring)), key=lambda i: (ring[i][0] - hx) ** 2 + (ring[i][1] - hy) ** 2)
        loops = [ring, h]

        def clear(i: int) -> bool:
            ax, ay = ring[i]
            for loop in loops:
                for (px, py), (qx, qy) in zip(loop, loop[1:] + loop[:1], strict=True):
                    if (px, py) in ((ax, ay), (hx, hy)) or (qx, qy) in ((ax, ay), (hx, hy)):
                        continue
                    d1 = (hx - ax) * (py - ay) - (hy - ay) * (px - ax)
                    d2 = (hx - ax) * (qy - ay) - (hy - ay) * (qx - ax)
                    d3 = (qx - px) * (ay - py) - (qy - py) * (ax - px)
                    d4 = (qx - px) * (hy - py) - (qy - py) * (hx - px)
                    if d1 * d2 <= 0 and d3 * d4 <= 0:
                        return False
            return True

        i = next((i for i in order if clear(i)), order[0])
        ring = ring[: i + 1] + h[k:] + h[: k + 1] + ring[i:]
    return np.array(ring)


def _turns(p: list) -> int:
    """Times a ring of left turns only winds around: changes from falling to rising x."""
    rise = [p[i][0] > p[i - 1][0] or (p[i][0] == p[i - 1][0] and p[i][1] < p[i - 1][1]) for i in range(len(p))]
    return sum(r and not q for q, r in zip([rise[-1], *rise[:-1]], rise, strict=True))


def ear_clip(ring: np.ndarray) -> np.ndarray:
    """Triangles (n, 3, 2) of a simple counter-clockwise ring; their areas add up to its own."""
    p = [tuple(v) for v in ring]
    out = []

    def cross(a, b, c) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    if all(cross(p[i - 2], p[i - 1], p[i]) > 0 for i in range(len(p))) and _turns(p) == 1:
        return np.array([(p[0], p[i], p[i + 1]) for i in range(1, len(p) - 1)], dtype=float).reshape(-1, 3, 2)
    while len(p) > 3:
        n = len(p)
        for i in range(n):
            a, b, c = p[i - 1], p[i], p[(i + 1) % n]
            if cross(a, b, c) <= 0:
                continue
            if any(
                q not in (a, b, c) and cross(a, b, q) >= 0 and cross(b, c, q) >= 0 and cross(c, a, q) >= 0
                for j, q in enumerate(p)
                if j not in (i, (i - 1) % n, (i + 1) % n)
            ):
                continue
            out.append((a, b, c))
            del p[i]
            break
        else:
            # a self-touching ring may hide every ear: drop its flattest corner
            i = min(range(n), key=lambda i: abs(cross(p[i - 1], p[i], p[(i + 1) % n])))
            if cross(p[i - 1], p[i], p[(i + 1) % n]) > 0:
                out.append((p[i - 1], p[i], p[(i + 1) % n]))
            del p[i]
    if len(p) == 3 and cross(*p) > 0:
        out.append(tuple(p))
    return np.array(out, dtype=float).reshape(-1, 3, 2)


def triangles(parts) -> np.ndarray:
    """Triangles of all parts of a geometry, holes left out."""
    found = []
    for part in parts if parts is not None else []:
        rings = [tidy_ring(r) for r in (part if part is not None else []) if r is not None]
        if not rings or not len(rings[0]):
            continue
        holes = [r for r in rings[1:] if len(r)]
        found.append(ear_clip(_bridge(rings[0], holes) if holes else rings[0]))
    return np.concatenate(found) if found else np.empty((0, 3, 2))


# ------------------------------------------------------ bounding-volume tree


class Boxes:
    """Bounding-volume hierarchy over boxes (n, 4), split at medians; queried for many boxes at once."""

    LEAF = 8

    def __init__(self, boxes: np.ndarray):
        self.boxes = boxes
        self.node, self.kids, self.span = [], [], []
        self.order = np.arange(len(boxes))
        if len(boxes):
            self._build(0, len(boxes))
        self.node, self.kids, self.span = np.array(self.node).reshape(-1, 4), np.array(self.kids).reshape(-1, 2), np.array(self.span).reshape(-1, 2)

    def _build(self, lo: int, hi: int) -> int:
        stack, root = [(lo, hi, -1, 0)], len(self.node)
        while stack:
            lo, hi, parent, side = stack.pop()
            own = self.order[lo:hi]
            b = self.boxes[own]
            me = len(self.node)
            self.node.append((b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max()))
            self.kids.append([-1, -1])
            self.span.append((lo, hi))
            if parent >= 0:
                self.kids[parent][side] = me
            if hi - lo > self.LEAF:
                c = b[:, :2] + b[:, 2:]
                axis = int(np.ptp(c[:, 1]) > np.ptp(c[:, 0]))
                mid = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(c[:, axis], mid)]
                stack += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        return root

    def hits(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, box) index pairs whose boxes meet."""
        if not len(self.boxes) or not len(q):
            return np.empty(0, int), np.empty(0, int)
        out_q, out_b = [], []
        qi, ni = np.arange(len(q)), np.zeros(len(q), int)
        while len(qi):
            n = self.node[ni]
            ok = (q[qi, 0] <= n[:, 2]) & (q[qi, 2] >= n[:, 0]) & (q[qi, 1] <= n[:, 3]) & (q[qi, 3] >= n[:, 1])
            qi, ni = qi[ok], ni[ok]
            leaf = self.kids[ni, 0] < 0
            lq, ln = qi[leaf], ni[leaf]
            if len(lq):
                k = self.span[ln, 1] - self.span[ln, 0]
                rq = np.repeat(lq, k)
                rb = self.order[np.repeat(self.span[ln, 0], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                b = self.boxes[rb]
                ok = (q[rq, 0] <= b[:, 2]) & (q[rq, 2] >= b[:, 0]) & (q[rq, 1] <= b[:, 3]) & (q[rq, 3] >= b[:, 1])
                out_q.append(rq[ok])
                out_b.append(rb[ok])
            qi, ni = np.repeat(qi[~leaf], 2), self.kids[ni[~leaf]].reshape(-1)
        return (np.concatenate(out_q), np.concatenate(out_b)) if out_q else (np.empty(0, int), np.empty(0, int))


# ---------------------------------------------------------------------- SQL


def sql_functions() -> dict:
    """Functions over whole geometries, for SQL; the DataFrame operators pack outlines once instead."""
    parts = lambda g: pa.compute.struct_field(g, "parts") if not isinstance(g, pa.ChunkedArray) else pa.compute.struct_field(g.combine_chunks(), "parts")

    def edges(g: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        xy, start, row, _ = rings_of(parts(g))
        n = np.diff(np.append(start, len(xy)))
        per = np.bincount(row, weights=n, minlength=len(g)).astype(np.int64) if len(n) else np.zeros(len(g), np.int64)
        e = np.concatenate([xy, xy[_next(start, n)]], axis=1) if len(n) else np.empty((0, 4))
        area = np.abs(np.bincount(row, weights=twice_signed(xy, start, n), minlength=len(g))) / 2 if len(n) else np.zeros(len(g))
        return e, np.cumsum(per) - per, per, area

    @F.arrow_udf(T.DoubleType())
    def geo_area(g: pa.Array) -> pa.Array:
        return pa.array(edges(g)[3], pa.float64())

    @F.arrow_udf(BOX)
    def geo_bbox(g: pa.Array) -> pa.Array:
        e, start, n, _ = edges(g)
        some, first = n > 0, start[n > 0]
        box = np.zeros((len(g), 4))
        if some.any():
            box[some] = np.concatenate([np.minimum.reduceat(e[:, :2], first), np.maximum.reduceat(e[:, :2], first)], axis=1)
        return pa.StructArray.from_arrays([pa.array(box[:, i].copy()) for i in range(4)], [f.name for f in BOX.fields], mask=pa.array(~some))

    @F.arrow_udf(T.DoubleType())
    def geo_intersection_area(a: pa.Array, b: pa.Array) -> pa.Array:
        (ea, sa, na, _), (eb, sb, nb, _) = edges(a), edges(b)
        return pa.array(overlap_areas(ea, sa, na, eb, sb, nb), pa.float64())

    @F.arrow_udf(T.DoubleType())
    def geo_iou(a: pa.Array, b: pa.Array) -> pa.Array:
        (ea, sa, na, p), (eb, sb, nb, q) = edges(a), edges(b)
        both = overlap_areas(ea, sa, na, eb, sb, nb)
        whole = p + q - both
        return pa.array(np.where(whole > 0, both / np.where(whole > 0, whole, 1.0), 0.0), pa.float64())

    return {"geo_area": geo_area, "geo_bbox": geo_bbox, "geo_intersection_area": geo_intersection_area, "geo_iou": geo_iou}
