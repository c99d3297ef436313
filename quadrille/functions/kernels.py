"""Exact predicates on points, lines and polygons.

Coordinates are doubles, hence whole multiples of a power of two: they are scaled to Python integers, and points that two
segments share are kept in homogeneous form. Every sign is exact; nothing depends on a tolerance. A matrix of the
nine intersections is filled from the pieces into which each outline is cut by the other: where a piece's middle lies
in the other geometry says which entries are not empty.
"""

from __future__ import annotations

from math import hypot, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks of the relations over the order II IB IE BI BB BE EI EB EE.
MASKS = {
    "inside": ("T*F**F***",),
    "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"),
    "contains": ("T*****FF*",),
    "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"),
    "meet": ("FT*******", "F**T*****", "F***T****"),
    "equal": ("T*F**FFF*",),
    "disjoint": ("FF*FF****",),
    "intersect": ("T********", "*T*******", "***T*****", "****T****"),
}


def matches(matrix: str, name: str) -> bool:
    return any(all(m == "*" or (m == "F") == (c == "F") for m, c in zip(mask, matrix)) for mask in MASKS[name])


class Shape:
    """A geometry in integers: type, points without repeats in a row, segments, box."""

    def __init__(self, kind: str, pts: list[tuple[int, int]]):
        self.kind = "POLYGON" if kind == "BOX" else kind
        out = [p for i, p in enumerate(pts) if not i or p != pts[i - 1]]
        if self.kind == "POLYGON":
            if out[0] != out[-1]:
                out.append(out[0])
            if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:])) > 0:
                out.reverse()
        self.pts = out
        self.segments = list(zip(out, out[1:]))
        self.box = (min(p[0] for p in out), min(p[1] for p in out), max(p[0] for p in out), max(p[1] for p in out))
        self.ends = () if self.kind != "LINESTRING" or out[0] == out[-1] else (out[0], out[-1])

    def locate(self, x: int, y: int, w: int = 1) -> str:
        """I, B or E for the point (x / w, y / w), w > 0."""
        b = self.box
        if x < b[0] * w or x > b[2] * w or y < b[1] * w or y > b[3] * w:
            return "E"
        if self.kind == "POINT":
            return "I" if (self.pts[0][0] * w, self.pts[0][1] * w) == (x, y) else "E"
        odd = False
        for (ax, ay), (bx, by) in self.segments:
            ax, ay, bx, by = ax * w, ay * w, bx * w, by * w
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0:
                if min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return "B" if self.kind == "POLYGON" or any((ex * w, ey * w) == (x, y) for ex, ey in self.ends) else "I"
            elif (ay > y) != (by > y) and (cross > 0) == (by > ay):
                odd = not odd
        return "I" if odd and self.kind == "POLYGON" else "E"


def shapes(kind_r: str, r, kind_s: str, s) -> tuple[Shape, Shape]:
    """Both geometries (flat x, y, ... doubles) on one integer grid."""
    ratios = [[float(v).as_integer_ratio() for v in g] for g in (r, s)]
    scale = lcm(*{d for g in ratios for _, d in g})
    whole = [[n * (scale // d) for n, d in g] for g in ratios]
    return Shape(kind_r, list(zip(whole[0][::2], whole[0][1::2]))), Shape(kind_s, list(zip(whole[1][::2], whole[1][1::2])))


def _apart(a, b) -> bool:
    return a[0] > b[2] or b[0] > a[2] or a[1] > b[3] or b[1] > a[3]


def _cuts(p, q, a, b) -> list[tuple[int, int]]:
    """Parameters (n, d), d > 0, of the points that segment pq shares with ab: none, one, or both ends of an overlap."""
    dx, dy, ex, ey = q[0] - p[0], q[1] - p[1], b[0] - a[0], b[1] - a[1]
    den = dx * ey - dy * ex
    fx, fy = a[0] - p[0], a[1] - p[1]
    if den:
        t, u = fx * ey - fy * ex, fx * dy - fy * dx
        if den < 0:
            den, t, u = -den, -t, -u
        return [(t, den)] if 0 <= t <= den and 0 <= u <= den else []
    if dx * fy - dy * fx:
        return []
    length = dx * dx + dy * dy
    t0, t1 = fx * dx + fy * dy, (b[0] - p[0]) * dx + (b[1] - p[1]) * dy
    lo, hi = max(0, min(t0, t1)), min(length, max(t0, t1))
    return [(lo, length), (hi, length)] if lo <= hi else []


def pieces(a: Shape, b: Shape):
    """(start, middle, end) points in homogeneous form, and the piece's segment, of a's outline cut by b's."""
    for p, q in a.segments:
        box = (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1]))
        cuts = {(0, 1), (1, 1)}
        if not _apart(box, b.box):
            if b.kind == "POINT":
                t = (b.pts[0][0] - p[0]) * (q[0] - p[0]) + (b.pts[0][1] - p[1]) * (q[1] - p[1])
                length = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2
                if 0 < t < length:
                    cuts.add((t, length))
            for c, d in b.segments:
                if not _apart(box, (min(c[0], d[0]), min(c[1], d[1]), max(c[0], d[0]), max(c[1], d[1]))):
                    cuts.update(_cuts(p, q, c, d))
        if len(cuts) > 2:
            den = lcm(*{d for _, d in cuts})
            at = sorted({n * (den // d) for n, d in cuts})
        else:
            den, at = 1, [0, 1]
        point = lambda n, m: (p[0] * m + n * (q[0] - p[0]), p[1] * m + n * (q[1] - p[1]), m)  # noqa: B023,E731
        for n, m in zip(at, at[1:]):
            yield point(n, den), point(n + m, 2 * den), point(m, den), (p, q)


def _sides(a: Shape, b: Shape):
    """Places of a's pieces and nodes in b: sets of letters, and the directions in which pieces shared with b run."""
    middles, inner, ends, along = set(), set(), set(), set()
    edge = {(x, y) for x, y in a.ends}
    for start, mid, stop, (p, q) in pieces(a, b):
        at = b.locate(*mid)
        middles.add(at)
        if at == "B" and b.kind == "POLYGON":
            for c, d in b.segments:
                x, y, w = mid
                if (d[0] - c[0]) * (y - c[1] * w) == (d[1] - c[1]) * (x - c[0] * w) and min(c[0], d[0]) * w <= x <= max(c[0], d[0]) * w and min(c[1], d[1]) * w <= y <= max(c[1], d[1]) * w:
                    along.add((q[0] - p[0]) * (d[0] - c[0]) + (q[1] - p[1]) * (d[1] - c[1]) > 0)
        for x, y, w in (start, stop):
            is_end = a.ends and x % w == 0 and y % w == 0 and (x // w, y // w) in edge
            (ends if is_end else inner).add(b.locate(x, y, w))
    return middles, inner, ends, along


def relate(r: Shape, s: Shape) -> str:
    """The nine-intersection matrix of r and s: F or the dimension of each entry."""
    order = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}
    if order[r.kind] < order[s.kind]:
        m = relate(s, r)
        return "".join(m[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8))
    e = dict.fromkeys((a + b for a in "IBE" for b in "IBE"), "F")
    e["EE"] = "2"

    def put(key, dim):
        if e[key] == "F" or int(e[key]) < dim:
            e[key] = str(dim)

    if s.kind == "POINT":
        x, y = s.pts[0]
        at = r.locate(x, y)
        put(at + "I", 0)
        if r.kind == "POINT":
            if at == "E":
                put("IE", 0)
            return "".join(e.values())
        put("IE", order[r.kind])
        if r.kind == "POLYGON":
            put("BE", 1)
        elif any(p != (x, y) for p in r.ends):
            put("BE", 0)
        return "".join(e.values())

    mid_r, inner_r, ends_r, along = _sides(r, s)
    mid_s, inner_s, ends_s, _ = _sides(s, r)
    if r.kind == "LINESTRING":
        for at in mid_r:
            put("I" + at, 1)
        for at in mid_s:
            put(at + "I", 1)
        for at in inner_r - {"E"}:
            put("I" + at, 0)
        for at in inner_s - {"E"}:
            put(at + "I", 0)
        for at in ends_r:
            put("B" + at, 0)
        for at in ends_s:
            put(at + "B", 0)
        return "".join(e.values())
    if s.kind == "LINESTRING":
        put("IE", 2)
        for at in mid_s:
            put(at + "I", 1)
        for at in inner_s - {"E"}:
            put(at + "I", 0)
        for at in ends_s:
            put(at + "B", 0)
        if "E" in mid_r:
            put("BE", 1)
        return "".join(e.values())
    for at in mid_r:
        put("B" + at, 1)
    for at in mid_s:
        put(at + "B", 1)
    if "B" in inner_r | inner_s:
        put("BB", 0)
    if "I" in mid_r or "I" in mid_s or True in along:
        put("II", 2)
    if "E" in mid_r or "I" in mid_s or False in along:
        put("IE", 2)
    if "E" in mid_s or "I" in mid_r or False in along:
        put("EI", 2)
    return "".join(e.values())


def intersects(r: Shape, s: Shape) -> bool:
    if _apart(r.box, s.box):
        return False
    if r.locate(*s.pts[0]) != "E" or s.locate(*r.pts[0]) != "E":
        return True
    for p, q in r.segments:
        box = (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1]))
        if not _apart(box, s.box) and any(not _apart(box, (min(c[0], d[0]), min(c[1], d[1]), max(c[0], d[0]), max(c[1], d[1]))) and _cuts(p, q, c, d) for c, d in s.segments):
            return True
    return False


def predicate(name: str, r: Shape, s: Shape) -> bool:
    if name in ("intersect", "disjoint"):
        return intersects(r, s) == (name == "intersect")
    return matches(relate(r, s), name)


def classify(case: str, m: str) -> int:
    """Relation code of a matrix, given how the boxes lie."""
    if case == "EQUAL":
        return 6 if matches(m, "equal") else 3 if matches(m, "covers") else 2 if matches(m, "covered_by") else 1 if not matches(m, "disjoint") else 0
    if matches(m, "disjoint"):
        return 0
    if case == "R_IN_S" and matches(m, "covered_by"):
        return 2 if matches(m, "inside") else 4
    if case == "S_IN_R" and matches(m, "covers"):
        return 3 if matches(m, "contains") else 5
    return 7 if matches(m, "meet") else 1


def is_valid(kind: str, pts) -> bool:
    """A line of two distinct points; a simple ring with an area."""
    if kind == "POINT" or kind == "BOX":
        return True
    a, _ = shapes(kind, pts, "POINT", pts[:2])
    if kind == "LINESTRING":
        return len(set(a.pts)) >= 2
    ring, n = a.segments, len(a.segments)
    if n < 3 or sum(p[0] * q[1] - q[0] * p[1] for p, q in ring) == 0 or len(set(a.pts)) != n:
        return False
    for i, (p, q) in enumerate(ring):
        for j in range(i + 1, n):
            c, d = ring[j]
            if min(p[0], q[0]) > max(c[0], d[0]) or max(p[0], q[0]) < min(c[0], d[0]) or min(p[1], q[1]) > max(c[1], d[1]) or max(p[1], q[1]) < min(c[1], d[1]):
                continue
            shared = len({n / m for n, m in _cuts(p, q, c, d)}) if (next_ := j == i + 1 or (i == 0 and j == n - 1)) else len(_cuts(p, q, c, d))
            if shared > (1 if next_ else 0):
                return False
    return True


def _to_segment(x, y, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
    t = min(1.0, max(0.0, t))
    return hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def shape_distance(kind_r: str, r, kind_s: str, s) -> float:
    """Planar distance of two geometries; 0 if they share a point."""
    if intersects(*shapes(kind_r, r, kind_s, s)):
        return 0.0
    lines = []
    for kind, g in ((kind_r, r), (kind_s, s)):
        pts = list(zip(map(float, g[::2]), map(float, g[1::2])))
        if kind in ("POLYGON", "BOX") and pts[0] != pts[-1]:
            pts.append(pts[0])
        lines.append((pts, list(zip(pts, pts[1:])) or [(pts[0], pts[0])]))
    (a, sa), (b, sb) = lines
    return min(min(_to_segment(*p, *e) for p in a for e in sb), min(_to_segment(*p, *e) for p in b for e in sa))


# ---------------------------------------------------------------- Arrow functions


def _lists(column: pa.Array):
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _scale(*columns: np.ndarray) -> int:
    """The power of two that makes every value of a batch whole."""
    if all((c == np.rint(c)).all() for c in columns):
        return 1
    return lcm(*{v.as_integer_ratio()[1] for c in columns for v in np.unique(c).tolist()})


class _Shapes(dict):
    """(type, coordinates) -> Shape on a batch's integer grid; a geometry of many pairs is made once."""

    def __init__(self, scale: int):
        super().__init__()
        self.scale = scale

    def __missing__(self, key):
        kind, data = key
        values = [n * (self.scale // d) for n, d in map(float.as_integer_ratio, np.frombuffer(data).tolist())]
        self[key] = shape = Shape(kind, list(zip(values[::2], values[1::2])))
        return shape


# ---------------------------------------------------------------- many pairs at once

OPEN, CROSS, R_IN_S, S_IN_R, APART = range(5)
#: Bound of the relative rounding error of a two-by-two determinant of differences of doubles.
ROUNDING = 3.3306690738754716e-16
#: Pairs of segments looked at together; a pair of shapes with more is left open.
MOST_SEGMENT_PAIRS = 1 << 20
#: Matrices of two polygons whose outlines cross, or have no point in common.
POLYGON_MATRICES = {CROSS: "212101212", R_IN_S: "2FF1FF212", S_IN_R: "212FF1FF2", APART: "FF2FF1212"}


def _side_of(ax, ay, bx, by, x, y):
    """Sign of the turn a, b, (x, y); 0 where rounding leaves it open."""
    left, right = (bx - ax) * (y - ay), (by - ay) * (x - ax)
    det = left - right
    return np.where(np.abs(det) > ROUNDING * (np.abs(left) + np.abs(right)), np.sign(det), 0).astype(np.int8)


def _within(px, py, ax, ay, bx, by):
    """For each row: is its point in its ring (1), outside (0) or not certain (-1); the point is on no edge."""
    straddles = (ay > py[:, None]) != (by > py[:, None])
    side = _side_of(ax, ay, bx, by, px[:, None], py[:, None])
    crossed = straddles & ((side > 0) == (by > ay))
    return np.where((straddles & (side == 0)).any(axis=1), -1, crossed.sum(axis=1) % 2)


def _ring(kind: str, g: np.ndarray) -> np.ndarray:
    return g[:-2] if kind != "LINESTRING" and len(g) > 2 and g[0] == g[-2] and g[1] == g[-1] else g


def _same_sizes(kr: str, r: np.ndarray, ks: str, s: np.ndarray) -> np.ndarray:
    def ends(kind, g):
        x, y = g[:, ::2], g[:, 1::2]
        return (x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]) if kind == "LINESTRING" else (x, y, np.roll(x, -1, 1), np.roll(y, -1, 1))

    a, b = ends(kr, r), ends(ks, s)
    ax, ay, bx, by = (v[:, :, None] for v in a)
    cx, cy, dx, dy = (v[:, None, :] for v in b)
    apart = ((np.maximum(ax, bx) < np.minimum(cx, dx)) | (np.maximum(cx, dx) < np.minimum(ax, bx))
             | (np.maximum(ay, by) < np.minimum(cy, dy)) | (np.maximum(cy, dy) < np.minimum(ay, by)))
    rc, rd = _side_of(ax, ay, bx, by, cx, cy), _side_of(ax, ay, bx, by, dx, dy)
    sa, sb = _side_of(cx, cy, dx, dy, ax, ay), _side_of(cx, cy, dx, dy, bx, by)
    apart |= (rc * rd > 0) | (sa * sb > 0)
    cross = (~apart & (rc * rd < 0) & (sa * sb < 0)).any(axis=(1, 2))
    overlap = (~apart & (rc == 0) & (rd == 0)).any(axis=(1, 2))  # perhaps along a segment
    out = np.where(cross & ~overlap, CROSS, OPEN).astype(np.int8)
    free = np.flatnonzero(apart.all(axis=(1, 2)))
    inside = np.zeros((2, len(free)), np.int64)
    if ks != "LINESTRING":
        inside[0] = _within(r[free, 0], r[free, 1], *(v[free] for v in b))
    if kr != "LINESTRING":
        inside[1] = _within(s[free, 0], s[free, 1], *(v[free] for v in a))
    out[free] = np.select([(inside < 0).any(axis=0), inside[0] == 1, inside[1] == 1], [OPEN, R_IN_S, S_IN_R], APART)
    return out


def quick_cases(kr: list[str], r: list[np.ndarray], ks: list[str], s: list[np.ndarray]) -> np.ndarray:
    """How the outlines of each pair of valid shapes lie where doubles decide it with certainty; OPEN for touching outlines and points."""
    groups: dict = {}
    for i, (a, b) in enumerate(zip(kr, ks)):
        if a != "POINT" and b != "POINT":
            groups.setdefault((a, len(_ring(a, r[i])), b, len(_ring(b, s[i]))), []).append(i)
    out = np.zeros(len(kr), np.int8)
    for (a, n, b, m), members in groups.items():
        step = MOST_SEGMENT_PAIRS * 4 // (n * m)
        for at in range(0, len(members) if step else 0, max(step, 1)):
            part = members[at : at + step]
            out[part] = _same_sizes(a, np.array([r[i][:n] for i in part]), b, np.array([s[i][:m] for i in part]))
    return out


# ---------------------------------------------------------------- convex shapes

#: Pairs of edges and corners up to which two convex shapes are decided edge by edge.
MOST_EDGES = 1024
#: Pairs of a step, whose columns stay in a core's cache.
PAIRS_A_STEP = 8192
#: Whole coordinates within this span of each other have exact determinants in doubles.
EXACT_SPAN = float(1 << 25)
#: How boxes lie, in this order.
EQUAL_BOXES, S_IN_R_BOX, R_IN_S_BOX, OTHER_BOXES = range(4)
BOX_CASES = ("EQUAL", "S_IN_R", "R_IN_S", "INTERSECT")


class Sides:
    """How pairs of convex shapes lie. sure: the rest holds for the pair; apart: no point in common; shallow: no inner point of
    one is one of the other; r_in_s, s_in_r: lies in the other; along: does so on one of its edges; box: how the boxes lie."""

    __slots__ = ("sure", "apart", "shallow", "r_in_s", "s_in_r", "along", "box")


def box_case(r, s) -> np.ndarray:
    """geometry.mbr_case of boxes given by columns xmin, ymin, xmax, ymax."""
    near = np.logical_and.reduce([np.abs(a - b) < 1e-8 for a, b in zip(r, s)])
    inner = lambda a, b: (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])
    return np.select([near, inner(s, r), inner(r, s)], [EQUAL_BOXES, S_IN_R_BOX, R_IN_S_BOX], OTHER_BOXES)


def _convex(kind: str, g: np.ndarray):
    """Corners, edges turned so that the shape is on their right, and which columns of g are convex shapes (a line has two points)."""
    x, y = g[::2], g[1::2]
    if kind == "LINESTRING":
        ex, ey = np.roll(x, -1, 0) - x, np.roll(y, -1, 0) - y
        return x, y, ex, ey, (ex[0] != 0) | (ey[0] != 0)
    sound = (x[0] == x[-1]) & (y[0] == y[-1])
    x, y = x[:-1], y[:-1]
    ex, ey = np.roll(x, -1, 0) - x, np.roll(y, -1, 0) - y
    turn = ex * np.roll(ey, -1, 0) - ey * np.roll(ex, -1, 0)
    left, right = (turn >= 0).all(axis=0), (turn <= 0).all(axis=0)
    sound &= (left ^ right) & ((ex != 0) | (ey != 0)).all(axis=0)
    way = np.where(left, -1.0, 1.0)
    return x, y, ex * way, ey * way, sound


def _of_edges(x, y, ex, ey, px, py):
    """Of a shape's edges against another's corners: wholly beyond an edge, beyond or on it, before all of them, on one of them."""
    n = x.shape[1]
    beyond, touching, within, along = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool), np.zeros(n, bool)
    for i in range(len(x)):
        least = most = None
        for j in range(len(px)):
            d = ex[i] * (py[j] - y[i]) - ey[i] * (px[j] - x[i])
            least, most = (d, d) if least is None else (np.minimum(least, d), np.maximum(most, d))
        beyond |= least > 0
        touching |= least >= 0
        within &= most <= 0
        along |= (least == 0) & (most == 0)
    return beyond, touching, within, along


def convex_sides(kr: str, r: np.ndarray, ks: str, s: np.ndarray) -> Sides:
    """Of pairs of valid shapes, a column of coordinates a pair. Not sure: not convex, or determinants that may be rounded."""
    out, n = Sides(), r.shape[1]
    br, bs = ((g[::2].min(axis=0), g[1::2].min(axis=0), g[::2].max(axis=0), g[1::2].max(axis=0)) for g in (r, s))
    out.box = box_case(br, bs)
    sizes = [len(g) // 2 - (k != "LINESTRING") for k, g in ((kr, r), (ks, s))]
    if "POINT" in (kr, ks) or any(m < 3 if k != "LINESTRING" else m != 2 for k, m in zip((kr, ks), sizes)) or sizes[0] * sizes[1] > MOST_EDGES:
        out.sure = np.zeros(n, bool)
        return out
    with np.errstate(invalid="ignore", over="ignore"):
        whole = (r == np.rint(r)).all(axis=0) & (s == np.rint(s)).all(axis=0)
        span = np.maximum(np.maximum(br[2], bs[2]) - np.minimum(br[0], bs[0]), np.maximum(br[3], bs[3]) - np.minimum(br[1], bs[1]))
        size = np.maximum(np.abs(r).max(axis=0), np.abs(s).max(axis=0))
        xr, yr, exr, eyr, sound_r = _convex(kr, r)
        xs, ys, exs, eys, sound_s = _convex(ks, s)
        out.sure = whole & (span <= EXACT_SPAN) & (size < 2.0**52) & sound_r & sound_s
        beyond_r, touching_r, out.s_in_r, along_s = _of_edges(xr, yr, exr, eyr, xs, ys)
        beyond_s, touching_s, out.r_in_s, along_r = _of_edges(xs, ys, exs, eys, xr, yr)
    out.apart = beyond_r | beyond_s | (br[0] > bs[2]) | (bs[0] > br[2]) | (br[1] > bs[3]) | (bs[1] > br[3])
    out.shallow = touching_r | touching_s
    if kr == "LINESTRING":
        out.s_in_r = np.zeros(n, bool)
    if ks == "LINESTRING":
        out.r_in_s = np.zeros(n, bool)
    out.along = along_r if kr == "LINESTRING" else along_s
    return out


def _convex_predicate(name: str, kr: str, ks: str, at: Sides) -> np.ndarray:
    """1, 0, or -1 where convexity does not tell."""
    lines = (kr == "LINESTRING") + (ks == "LINESTRING")
    if name in ("intersect", "disjoint"):
        yes = at.apart == (name == "disjoint")
    elif lines == 2:
        return np.full(len(at.sure), -1, np.int8)
    elif name == "meet":
        yes = ~at.apart & at.shallow
    elif name == "equal":
        yes = at.r_in_s & at.s_in_r
    else:
        yes = at.r_in_s if name in ("inside", "covered_by") else at.s_in_r
        if lines and name in ("inside", "contains"):
            yes = yes & ~at.along
    return np.where(at.sure, yes, -1).astype(np.int8)


def _convex_relation(kr: str, ks: str, at: Sides) -> np.ndarray:
    """classify() of two polygons, or -1 where convexity does not tell."""
    if "LINESTRING" in (kr, ks):
        return np.full(len(at.sure), -1, np.int8)
    same = np.select([at.r_in_s & at.s_in_r, at.s_in_r, at.r_in_s, ~at.apart], [6, 3, 2, 1], 0)
    other = np.select([at.apart, (at.box == R_IN_S_BOX) & at.r_in_s, (at.box == S_IN_R_BOX) & at.s_in_r, at.shallow], [0, 2, 3, 7], 1)
    return np.where(at.sure, np.where(at.box == EQUAL_BOXES, same, other), -1).astype(np.int8)


def answers(kr: str, r, ks: str, s, known: np.ndarray | None, convex, quick, exact) -> np.ndarray:
    """Codes of pairs, by the cheapest test that tells: what is known (-1: nothing), convex shapes at once, outlines at once
    (quick of a case, or None), the exact kernel. r and s are pairs of coordinates and offsets."""
    (vr, at_r), (vs, at_s) = r, s
    nr, ns = np.diff(at_r), np.diff(at_s)
    out = np.full(len(nr), -1, np.int8) if known is None else known.astype(np.int8)
    asked = np.flatnonzero(out < 0)
    if len(asked):
        sizes = nr[asked].astype(np.int64) << 32 | ns[asked]
        one = (sizes == sizes[0]).all()
        for size in sizes[:1] if one else np.unique(sizes):
            members = asked if one else asked[sizes == size]
            a, b = int(size) >> 32, int(size) & 0xFFFFFFFF
            step = max(1, min(PAIRS_A_STEP, (MOST_SEGMENT_PAIRS * 4) // max(a, b, 1)))
            for i in range(0, len(members) if a and b else 0, step):
                part = members[i : i + step]
                left, right = (np.ascontiguousarray(v[at[part][:, None] + np.arange(n)].T) for v, at, n in ((vr, at_r, a), (vs, at_s, b)))
                out[part] = convex(convex_sides(kr, left, ks, right))
    open_ = np.flatnonzero(out < 0)
    if len(open_):
        lr, ls = ([v[a:b] for a, b in zip(at[open_], at[open_ + 1])] for v, at in ((vr, at_r), (vs, at_s)))
        made = None
        for i, a, b, case in zip(open_.tolist(), lr, ls, quick_cases([kr] * len(lr), lr, [ks] * len(ls), ls).tolist()):
            code = quick(case, a, b) if case else None
            if code is None:
                made = _Shapes(_scale(np.concatenate(lr), np.concatenate(ls))) if made is None else made
                code = exact(made[kr, a.tobytes()], made[ks, b.tobytes()], a, b)
            out[i] = code
    return out


def _boxes_case(a: np.ndarray, b: np.ndarray) -> str:
    box = lambda g: (g[::2].min(), g[1::2].min(), g[::2].max(), g[1::2].max())
    return BOX_CASES[int(box_case(box(a), box(b)))]


def decide_predicate(name: str, kr: str, r, ks: str, s, known=None) -> np.ndarray:
    """1 or 0 for each pair; kr and ks are the types of all."""

    def quick(case, a, b):
        if name in ("intersect", "disjoint"):
            return (case != APART) == (name == "intersect")
        m = _quick_matrix(kr, ks, case)
        return None if m is None else matches(m, name)

    return answers(kr, r, ks, s, known, lambda at: _convex_predicate(name, kr, ks, at), quick, lambda x, y, a, b: predicate(name, x, y))


def decide_relation(kr: str, r, ks: str, s, known=None) -> np.ndarray:
    """The relation's code for each pair."""

    def quick(case, a, b):
        m = _quick_matrix(kr, ks, case)
        return None if m is None else classify(_boxes_case(a, b), m)

    return answers(kr, r, ks, s, known, lambda at: _convex_relation(kr, ks, at), quick, lambda x, y, a, b: classify(_boxes_case(a, b), relate(x, y)))


def laid_flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and offsets of an array of lists."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)


def _quick_matrix(kr: str, ks: str, case: int):
    return None if "LINESTRING" in (kr, ks) else POLYGON_MATRICES[case]


def predicate_column(name: str, kr: str, r: Column, ks: str, s: Column, known: Column | None = None) -> Column:
    """A predicate of two geometries given by flat coordinates, of the types kr and ks; where known is not null, that is the answer."""
    if known is None:

        @F.arrow_udf("boolean")
        def run(r: pa.Array, s: pa.Array) -> pa.Array:
            return pa.array(decide_predicate(name, kr, laid_flat(r), ks, laid_flat(s)) == 1)

        return run.asNondeterministic()(r, s)

    @F.arrow_udf("boolean")
    def run_known(r: pa.Array, s: pa.Array, known: pa.Array) -> pa.Array:
        told = known.cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array(decide_predicate(name, kr, laid_flat(r), ks, laid_flat(s), told) == 1)

    return run_known.asNondeterministic()(r, s, known)


def relation_column(kr: str, r: Column, ks: str, s: Column) -> Column:
    """The relation's code of two geometries whose boxes overlap."""

    @F.arrow_udf("int")
    def run(r: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array(decide_relation(kr, laid_flat(r), ks, laid_flat(s)).astype(np.int32))

    return run.asNondeterministic()(r, s)


def distance_column(kr: str, r: Column, ks: str, s: Column) -> Column:
    @F.arrow_udf("double")
    def run(r: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([shape_distance(kr, g, ks, h) for g, h in zip(_lists(r), _lists(s))], pa.float64())

    return run.asNondeterministic()(r, s)


def valid_column(kind: Column, pts: Column) -> Column:
    @F.arrow_udf("boolean")
    def run(kinds: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([len(g) > 1 and bool(np.isfinite(g).all()) and is_valid(k, g) for k, g in zip(kinds.to_pylist(), _lists(rows))], pa.bool_())

    return run(kind, pts)
