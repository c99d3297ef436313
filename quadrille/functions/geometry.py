"""Geometry as Column expressions: WKT, boxes, points, rings. All of it stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PTS = "array<struct<x:double,y:double>>"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: the optimizer doesn't copy them into the expressions that use them."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def wkt_tag(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def _points(body: Column) -> Column:
    pair = lambda p: F.split(F.trim(p), r"\s+")
    number = lambda p, i: F.get(pair(p), i).try_cast("double")
    return F.transform(F.split(F.trim(body), ","), lambda p: F.struct(number(p, F.lit(0)).alias("x"), number(p, F.lit(1)).alias("y")))


def wkt_points(wkt: Column) -> Column:
    """Vertices of a POINT, LINESTRING, POLYGON (outer ring) or BOX; null for anything else."""
    tag = wkt_tag(wkt)
    flat = F.regexp_extract(wkt, r"^\s*[A-Za-z]+\s*\(([^()]*)\)\s*$", 1)
    ring = F.regexp_extract(wkt, r"^\s*[A-Za-z]+\s*\(\s*\(([^()]*)\)", 1)
    body = F.when(tag.isin("POINT", "LINESTRING", "BOX"), flat).when(tag == "POLYGON", ring)
    pts = F.when(F.length(F.trim(body)) > 0, _points(body))
    sound = F.forall(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(sound, pts).cast(PTS)


def closed_ring(pts: Column) -> Column:
    same = (F.element_at(pts, 1)["x"] == F.element_at(pts, -1)["x"]) & (F.element_at(pts, 1)["y"] == F.element_at(pts, -1)["y"])
    return F.when(same, pts).otherwise(F.concat(pts, F.slice(pts, 1, 1)))


def signed_area(pts: Column) -> Column:
    """Twice the area of a closed ring; above 0 against the clock. Rings of four corners, the most common, need no lambda; sums are the same."""
    p, few = [F.get(pts, F.lit(i)) for i in range(5)], F.lit(0.0)
    for a, b in zip(p, p[1:]):
        few = few + (a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(pts) == 5, few).otherwise(F.aggregate(edges(pts), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])))


def edges(pts: Column) -> Column:
    n = F.size(pts)
    return F.arrays_zip(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(pts, 2, F.greatest(n - 1, F.lit(0))).alias("b"))


def clockwise(pts: Column) -> Column:
    return F.when(signed_area(pts) > 0, F.reverse(pts)).otherwise(pts)


def mbr(pts: Column) -> dict[str, Column]:
    xs, ys = pts["x"], pts["y"]
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def box_points(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as a closed clockwise ring."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmin, ymax), corner(xmax, ymax), corner(xmax, ymin), corner(xmin, ymin))


def flat(pts: Column) -> Column:
    """x, y, x, y, ... as the kernels take them."""
    return F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))


def to_wkt(gtype: Column, pts: Column) -> Column:
    body = F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return F.when(gtype == "POLYGON", F.concat(F.lit("POLYGON (("), body, F.lit("))"))).otherwise(F.concat(gtype, F.lit(" ("), body, F.lit(")")))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def on_ring(x: Column, y: Column, ring_edges: Column) -> Column:
    """Whether a point is on a ring's line; the ring is given by its edges()."""

    def touches(e):
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        inside = (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))
        return (cross == 0) & inside

    return F.exists(ring_edges, touches)


def in_ring(x: Column, y: Column, ring_edges: Column) -> Column:
    """Crossing number of a ray to the right; for points not on the ring."""

    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return straddles & ((cross > 0) == (b["y"] > a["y"])) & (cross != 0)

    return F.size(F.filter(ring_edges, crosses)) % 2 == 1


def point_meets_ring(x: Column, y: Column, ring_edges: Column) -> Column:
    return on_ring(x, y, ring_edges) | in_ring(x, y, ring_edges)


def point_inside_ring(x: Column, y: Column, ring_edges: Column) -> Column:
    return ~on_ring(x, y, ring_edges) & in_ring(x, y, ring_edges)


# ---------------------------------------------------------------- small convex shapes

#: Whole coordinates up to this size, and halves between them, have exact determinants in doubles.
EXACT_SIZE = float(1 << 24)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def corner_columns(line: bool) -> list[str]:
    return [f"{v}{i}" for v in "xy" for i in range(2 if line else 4)]


def convex(df: DataFrame, line: bool) -> DataFrame:
    """df with the corners of its column pts in columns of their own, clockwise: the ends of a line, or four (three and the middle
    of an edge). sure: the row is a line of two points or a convex ring of three or four corners, and determinants are exact; the
    corners are right only then.
    """
    n, size = 2 if line else 4, F.size("pts")
    p = [F.get("pts", F.lit(i)) for i in range(2 if line else 5)]
    exact = [_all(F.coalesce((q[v] == F.rint(q[v])) & (F.abs(q[v]) <= EXACT_SIZE), F.lit(False)) for v in "xy") for q in p]
    corners = {f"{v}{i}": F.coalesce(F.when(size == 4, (p[2][v] + p[0][v]) / 2).otherwise(p[3][v]) if i == 3 else p[i][v], F.lit(float("nan"))) for v in "xy" for i in range(n)}
    if line:
        return df.withColumns({**corners, "sure": (size == 2) & _all(exact) & ((p[0]["x"] != p[1]["x"]) | (p[0]["y"] != p[1]["y"]))})
    ring = size.isin(4, 5) & _all(exact[:4]) & ((size == 4) | exact[4]) & _all(F.coalesce(F.when(size == 4, p[3][v]).otherwise(p[4][v]) == p[0][v], F.lit(False)) for v in "xy")
    df = df.withColumns({**corners, "sure": ring})
    side = lambda v, i: F.col(f"{v}{(i + 1) % n}") - F.col(f"{v}{i}")
    turn = [side("x", i) * side("y", (i + 1) % n) - side("y", i) * side("x", (i + 1) % n) for i in range(n)]
    df = df.withColumns({f"turn{i}": t for i, t in enumerate(turn)})
    turn = [F.col(f"turn{i}") for i in range(n)]
    sound = (_all(t >= 0 for t in turn) != _all(t <= 0 for t in turn)) & _all((side("x", i) != 0) | (side("y", i) != 0) for i in range(n))
    left = turn[0] + turn[1] + turn[2] + turn[3] > 0
    turned = {f"{v}{i}": F.when(left, F.col(f"{v}{4 - i}")).otherwise(F.col(f"{v}{i}")) for v in "xy" for i in (1, 3)}
    return df.withColumns({"sure": F.col("sure") & sound, **turned}).drop(*[f"turn{i}" for i in range(n)])


def _beyond(shape: str, line: bool, other: str, other_line: bool) -> list[list[Column]]:
    """For each edge of a shape (a line has one each way): how far beyond it (0: on it) the other's corners are."""
    at = lambda s, i: (F.col(f"x{i}_{s}"), F.col(f"y{i}_{s}"))
    out, n = [], 2 if line else 4
    for i in range(n):
        (x, y), (to_x, to_y) = at(shape, i), at(shape, (i + 1) % n)
        out.append([(to_x - x) * (py - y) - (to_y - y) * (px - x) for px, py in (at(other, j) for j in range(2 if other_line else 4))])
    return out


def convex_predicate(name: str, line_r: bool, line_s: bool) -> Column:
    """What kernels.decide_predicate() says of two shapes that are sure, not both lines, and whose boxes overlap; their corners
    are columns of convex() that end in _r and _s."""
    of_r, of_s = _beyond("r", line_r, "s", line_s), _beyond("s", line_s, "r", line_r)
    if name in ("intersect", "disjoint", "meet"):
        gap = F.greatest(*[F.least(*edge) for edge in (*of_r, *of_s)])  # above 0: no point in common; 0: no inner point
        return {"intersect": gap <= 0, "disjoint": gap > 0, "meet": gap == 0}[name]
    within = lambda of: _all(d <= 0 for edge in of for d in edge)
    if name == "equal":
        return F.lit(False) if line_r or line_s else within(of_s) & within(of_r)
    of, outer, inner = (of_s, line_s, line_r) if name in ("inside", "covered_by") else (of_r, line_r, line_s)
    if outer:
        return F.lit(False)
    return within(of) & _all(~_all(d == 0 for d in edge) for edge in of) if inner and name in ("inside", "contains") else within(of)


def convex_relations(pairs: DataFrame) -> DataFrame:
    """pairs with relation, the code that kernels.decide_relation() gives for two rings that are sure and whose boxes, in columns
    of their own, overlap."""
    of_r, of_s = _beyond("r", False, "s", False), _beyond("s", False, "r", False)
    most = lambda of: F.greatest(*[d for edge in of for d in edge])
    pairs = pairs.withColumns({"gap": F.greatest(*[F.least(*edge) for edge in (*of_r, *of_s)]), "beyond_r": most(of_r), "beyond_s": most(of_s)})
    r, s = ({c: F.col(f"{c}_{x}") for c in ("xmin", "ymin", "xmax", "ymax")} for x in "rs")
    apart, shallow, r_in_s, s_in_r = F.col("gap") > 0, F.col("gap") >= 0, F.col("beyond_s") <= 0, F.col("beyond_r") <= 0
    same = F.when(r_in_s & s_in_r, 6).when(s_in_r, 3).when(r_in_s, 2).when(apart, 0).otherwise(1)
    other = (F.when(apart, 0).when(within(r, s) & ~within(s, r) & r_in_s, 2).when(within(s, r) & s_in_r, 3).when(shallow, 7).otherwise(1))
    return pairs.withColumn("relation", F.when(mbr_case(r, s) == "EQUAL", same).otherwise(other))


# ---------------------------------------------------------------- boxes


def overlap(r: dict[str, Column], s: dict[str, Column]) -> Column:
    """Closed boxes that share a point."""
    return (r["xmin"] <= s["xmax"]) & (s["xmin"] <= r["xmax"]) & (r["ymin"] <= s["ymax"]) & (s["ymin"] <= r["ymax"])


def interiors_meet(r: dict[str, Column], s: dict[str, Column]) -> Column:
    """Boxes whose interiors share a point. A box without width or height is a line or a point, with an interior of its own."""

    def axis(lo: str, hi: str) -> Column:
        a, b, c, d = r[lo], r[hi], s[lo], s[hi]
        return (F.when((a == b) & (c == d), a == c).when(a == b, (c < a) & (a < d)).when(c == d, (a < c) & (c < b)).otherwise((a < d) & (c < b)))

    return axis("xmin", "xmax") & axis("ymin", "ymax")


def within(r: dict[str, Column], s: dict[str, Column]) -> Column:
    return (r["xmin"] >= s["xmin"]) & (r["xmax"] <= s["xmax"]) & (r["ymin"] >= s["ymin"]) & (r["ymax"] <= s["ymax"])


def box_predicate(name: str, r: dict[str, Column], s: dict[str, Column]) -> Column:
    """The predicates on boxes, in closed form; boxes may be lines or points."""
    return {
        "intersect": lambda: overlap(r, s), "disjoint": lambda: ~overlap(r, s), "meet": lambda: overlap(r, s) & ~interiors_meet(r, s),
        "inside": lambda: within(r, s) & interiors_meet(r, s), "covered_by": lambda: within(r, s),
        "contains": lambda: within(s, r) & interiors_meet(r, s), "covers": lambda: within(s, r),
        "equal": lambda: within(r, s) & within(s, r),
    }[name]()


def box_relation(r: dict[str, Column], s: dict[str, Column]) -> Column:
    """Relation code of two boxes."""
    deep = interiors_meet(r, s)
    return (F.when(~overlap(r, s), 0).when(within(r, s) & within(s, r), 6).when(within(s, r), F.when(deep, 3).otherwise(5))
            .when(within(r, s), F.when(deep, 2).otherwise(4)).when(~deep, 7).otherwise(1))


def box_distance(r: dict[str, Column], s: dict[str, Column]) -> Column:
    """Distance of two boxes, either of which may be a point."""
    dx = F.greatest(r["xmin"] - s["xmax"], F.lit(0.0), s["xmin"] - r["xmax"])
    dy = F.greatest(r["ymin"] - s["ymax"], F.lit(0.0), s["ymin"] - r["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def mbr_case(r: dict[str, Column], s: dict[str, Column], eps: float = 1e-8) -> Column:
    """EQUAL, S_IN_R, R_IN_S or INTERSECT, in this order."""
    equal = (F.abs(r["xmin"] - s["xmin"]) < eps) & (F.abs(r["xmax"] - s["xmax"]) < eps) & (F.abs(r["ymin"] - s["ymin"]) < eps) & (F.abs(r["ymax"] - s["ymax"]) < eps)
    return F.when(equal, "EQUAL").when(within(s, r), "S_IN_R").when(within(r, s), "R_IN_S").otherwise("INTERSECT")
