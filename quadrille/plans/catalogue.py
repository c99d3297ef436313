"""Registered queries over the given tables, with the SQL that gives the same rows.

Geometries are derived from key and value columns as whole-number doubles, so that both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators import joins, selection
from quadrille.operators.april import hilbert_column, with_intervals
from quadrille.plans.grid import Grid, grid_for, layer_class
from quadrille.sources import geometry as source
from quadrille.types import Bounds, DataType

# ---------------------------------------------------------------- derived sets


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _whole(c) -> F.Column:
    return F.floor(c).cast("double")


def pts_orders(spark, sf):
    return source.from_points(_table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey"), _whole(F.col("o_totalprice") / 100))


def pts_customer(spark, sf):
    return source.from_points(_table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_custkey"), _whole(F.col("c_acctbal")))


def pts_supplier(spark, sf):
    return source.from_points(_table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_suppkey") * 10, _whole(F.col("s_acctbal")))


def pts_events(spark, sf):
    return source.from_points(_table(spark, sf, "events"), F.col("event_id"), F.col("user_id"), _whole(F.col("value")))


def _line_id():
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")


def box_lineitem(spark, sf):
    t = _table(spark, sf, "lineitem")
    return source.from_boxes(t, _line_id(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") + F.col("l_quantity"), F.col("l_suppkey") + F.col("l_linenumber"))


def box_part(spark, sf):
    y = _whole(F.col("p_retailprice"))
    return source.from_boxes(_table(spark, sf, "part"), F.col("p_partkey"), F.col("p_partkey"), y, F.col("p_partkey") + F.col("p_size"), y + F.col("p_size"))


def _corner(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def diamond_part(spark, sf, shift=0):
    x, y, r = F.col("p_partkey").cast("double") + shift, _whole(F.col("p_retailprice")), F.col("p_size").cast("double")
    pts = F.array(_corner(x - r, y), _corner(x, y + r), _corner(x + r, y), _corner(x, y - r), _corner(x - r, y))
    return source.from_vertices(_table(spark, sf, "part"), F.col("p_partkey"), DataType.POLYGON, pts)


def seg_lineitem(spark, sf, y=None):
    y = F.col("l_suppkey") if y is None else y
    ends = F.array(_corner(F.col("l_partkey"), y), _corner(F.col("l_partkey") + F.col("l_quantity"), y))
    return source.from_vertices(_table(spark, sf, "lineitem"), _line_id(), DataType.LINESTRING, ends)


def seg_prices(spark, sf):
    """Line items at the height of their price by the piece, where the boxes of parts lie."""
    return seg_lineitem(spark, sf, _whole(F.col("l_extendedprice") / F.col("l_quantity")))


def line_part(spark, sf, rise=1):
    """A line for each part, rising or falling by one in one."""
    x, y, r = F.col("p_partkey").cast("double"), _whole(F.col("p_retailprice")), F.col("p_size").cast("double")
    return source.from_vertices(_table(spark, sf, "part"), F.col("p_partkey"), DataType.LINESTRING, F.array(_corner(x, y), _corner(x + r, y + rise * r)))


def supplier_windows(spark, sf) -> DataFrame:
    """A box for each supplier, around its point."""
    t = _table(spark, sf, "supplier")
    x, y = F.col("s_suppkey") * 10, F.floor("s_acctbal")
    wkt = F.format_string("BOX(%d %d,%d %d)", x - 40, y - 300, x + 40, y + 300)
    return t.select(F.col("s_suppkey").cast("int").alias("qid"), wkt.alias("wkt"))


def supplier_diamonds(spark, sf) -> DataFrame:
    t = _table(spark, sf, "supplier")
    x, y = F.col("s_suppkey") * 10, F.floor("s_acctbal")
    wkt = F.format_string("POLYGON ((%d %d,%d %d,%d %d,%d %d,%d %d))", x - 400, y, x, y + 400, x + 400, y, x, y - 400, x - 400, y)
    return t.select(F.col("s_suppkey").cast("int").alias("qid"), wkt.alias("wkt"))


def line_windows(spark, sf) -> DataFrame:
    """A box for each supplier over the plane of line items."""
    t = _table(spark, sf, "supplier")
    wkt = F.format_string("BOX(%d %d,%d %d)", F.col("s_suppkey") * 20, F.col("s_suppkey"), F.col("s_suppkey") * 20 + 30, F.col("s_suppkey") + 3)
    return t.select(F.col("s_suppkey").cast("int").alias("qid"), wkt.alias("wkt"))


# Views of the same sets in SQL.
_SETS = {
    "po": "SELECT o_orderkey AS id, o_custkey::DOUBLE AS x, floor(o_totalprice / 100)::DOUBLE AS y FROM orders",
    "pc": "SELECT c_custkey AS id, c_custkey::DOUBLE AS x, floor(c_acctbal)::DOUBLE AS y FROM customer",
    "ps": "SELECT s_suppkey AS id, (s_suppkey * 10)::DOUBLE AS x, floor(s_acctbal)::DOUBLE AS y FROM supplier",
    "pe": "SELECT event_id AS id, user_id::DOUBLE AS x, floor(value)::DOUBLE AS y FROM events",
    "bl": "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_partkey::DOUBLE AS x0, l_suppkey::DOUBLE AS y0, l_partkey + l_quantity::DOUBLE AS x1, (l_suppkey + l_linenumber)::DOUBLE AS y1 FROM lineitem",
    "bp": "SELECT p_partkey AS id, p_partkey::DOUBLE AS x0, floor(p_retailprice)::DOUBLE AS y0, (p_partkey + p_size)::DOUBLE AS x1, floor(p_retailprice)::DOUBLE + p_size AS y1 FROM part",
    "dp": "SELECT p_partkey AS id, p_partkey::DOUBLE AS x, floor(p_retailprice)::DOUBLE AS y, p_size::DOUBLE AS r FROM part",
    "sp": "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_partkey AS x0, l_partkey + l_quantity AS x1, floor(l_extendedprice / l_quantity)::DOUBLE AS y FROM lineitem",
    "w": "SELECT s_suppkey::INTEGER AS qid, (s_suppkey * 10)::DOUBLE AS x, floor(s_acctbal)::DOUBLE AS y FROM supplier",
}


def _with(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_SETS[n]})" for n in names) + " " + sql


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ranges

WINDOW = Bounds(200, 500, 900, 1500)
_IN_WINDOW = "x BETWEEN 200 AND 900 AND y BETWEEN 500 AND 1500"


@query(_with(f"SELECT count(*) AS n FROM po WHERE {_IN_WINDOW}", "po"))
def range_box_count(spark, sf):
    return selection.range_box(pts_orders(spark, sf), WINDOW).agg(F.count(F.lit(1)).alias("n"))


@query(_with(f"SELECT id AS rec_id FROM po WHERE {_IN_WINDOW}", "po"))
def range_box_collect(spark, sf):
    return selection.range_box(pts_orders(spark, sf), WINDOW)


@query(_with("SELECT w.qid, count(po.id) AS n FROM w LEFT JOIN po ON po.x BETWEEN w.x - 40 AND w.x + 40 AND po.y BETWEEN w.y - 300 AND w.y + 300 GROUP BY w.qid", "w", "po"))
def range_batch_count(spark, sf):
    w = supplier_windows(spark, sf)
    return selection.count_by_query(w, selection.range_batch(pts_orders(spark, sf), w))


@query(_with("SELECT w.qid, pe.id AS rec_id FROM w JOIN pe ON pe.x BETWEEN w.x - 40 AND w.x + 40 AND pe.y BETWEEN w.y - 300 AND w.y + 300", "w", "pe"))
def range_batch_collect(spark, sf):
    return selection.range_batch(pts_events(spark, sf), supplier_windows(spark, sf))


@query(_with("SELECT w.qid, po.id AS rec_id FROM w JOIN po ON abs(po.x - w.x) + abs(po.y - w.y) <= 400", "w", "po"))
def range_polygon_points(spark, sf):
    return selection.range_batch(pts_orders(spark, sf), supplier_diamonds(spark, sf))


@query(_with("SELECT w.qid, bl.id AS rec_id FROM (SELECT s_suppkey::INTEGER AS qid, s_suppkey AS s FROM supplier) w JOIN bl ON x0 <= s * 20 + 30 AND x1 >= s * 20 AND y0 <= s + 3 AND y1 >= s", "bl"))
def range_box_areas(spark, sf):
    return selection.range_batch(box_lineitem(spark, sf), line_windows(spark, sf))


@query("SELECT w.qid, b.id AS rec_id FROM (SELECT s_suppkey::INTEGER AS qid, s_suppkey AS s FROM supplier) w JOIN (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_partkey AS x0, l_partkey + l_quantity AS x1, l_suppkey AS y FROM lineitem) b ON x0 <= s * 20 + 30 AND x1 >= s * 20 AND y BETWEEN s AND s + 3")
def range_linestrings(spark, sf):
    return selection.range_batch(seg_lineitem(spark, sf), line_windows(spark, sf))


# ---------------------------------------------------------------- neighbours


@query(_with("SELECT row_number() OVER (ORDER BY dist, rec_id)::INTEGER AS rank, rec_id, dist FROM (SELECT id AS rec_id, sqrt((x - 500) * (x - 500) + (y - 1000) * (y - 1000)) AS dist FROM po) ORDER BY dist, rec_id LIMIT 10", "po"))
def knn_single(spark, sf):
    return selection.knn(pts_orders(spark, sf), 500, 1000, 10)


@query(_with("SELECT qid, rank, rec_id, dist FROM (SELECT qid, rec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, rec_id)::INTEGER AS rank FROM (SELECT w.qid, pc.id AS rec_id, sqrt((pc.x - w.x) * (pc.x - w.x) + (pc.y - w.y) * (pc.y - w.y)) AS dist FROM pc, w)) WHERE rank <= 5", "pc", "w"))
def knn_batch(spark, sf):
    q = pts_supplier(spark, sf).df.select(F.col("rec_id").cast("int").alias("qid"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    return selection.knn_batch(pts_customer(spark, sf), q, 5)


# ---------------------------------------------------------------- joins

_DJ = "FROM po JOIN ps ON (po.x - ps.x) * (po.x - ps.x) + (po.y - ps.y) * (po.y - ps.y) <= 2500"


@query(_with(f"SELECT count(*) AS n {_DJ}", "po", "ps"))
def distance_join_count(spark, sf):
    return joins.distance_join(pts_orders(spark, sf), pts_supplier(spark, sf), 50).agg(F.count(F.lit(1)).alias("n"))


@query(_with(f"SELECT po.id AS id_r, ps.id AS id_s {_DJ}", "po", "ps"))
def distance_join_collect(spark, sf):
    return joins.distance_join(pts_orders(spark, sf), pts_supplier(spark, sf), 50)


_OV = "r.x0 <= s.x1 AND s.x0 <= r.x1 AND r.y0 <= s.y1 AND s.y0 <= r.y1"
_ST = "r.x0 < s.x1 AND s.x0 < r.x1 AND r.y0 < s.y1 AND s.y0 < r.y1"
_RS = "r.x0 >= s.x0 AND r.x1 <= s.x1 AND r.y0 >= s.y0 AND r.y1 <= s.y1"
_SR = "s.x0 >= r.x0 AND s.x1 <= r.x1 AND s.y0 >= r.y0 AND s.y1 <= r.y1"
_TESTS = {"intersect": _OV, "inside": _RS, "covered_by": _RS, "contains": _SR, "covers": _SR, "equal": f"{_RS} AND {_SR}", "meet": f"{_OV} AND NOT ({_ST})", "disjoint": f"{_OV} AND NOT ({_OV})"}
_CASE = f"CASE WHEN {_RS} AND {_SR} THEN 6 WHEN {_SR} THEN 3 WHEN {_RS} THEN 2 WHEN NOT ({_ST}) THEN 7 ELSE 1 END"


def _box_join(name: str, key: str):
    def run(spark, sf):
        return joins.predicate_join(box_part(spark, sf), box_part(spark, sf), name)

    run.__name__ = key
    query(_with(f"SELECT r.id AS id_r, s.id AS id_s FROM bp r JOIN bp s ON {_TESTS[name]}", "bp"))(run)


for _name in ("intersect", "inside", "contains", "covers", "covered_by", "equal", "meet"):
    _box_join(_name, f"box_{_name}_join")


@query(_with(f"SELECT count(*) AS n FROM bp r JOIN bp s ON NOT ({_OV})", "bp"))
def box_disjoint_count(spark, sf):
    """Pairs without a point in common, of all pairs: counted, as they are nearly all."""
    return joins.disjoint_count(box_part(spark, sf), box_part(spark, sf))


@query(_with(f"SELECT k.relation::INTEGER AS relation, count(t.relation) AS n FROM range(8) k(relation) LEFT JOIN (SELECT {_CASE} AS relation FROM bl r JOIN bp s ON {_OV}) t ON t.relation = k.relation GROUP BY k.relation", "bl", "bp"))
def box_find_relation_count(spark, sf):
    return joins.relation_counts(joins.find_relation(box_lineitem(spark, sf), box_part(spark, sf)))


@query(_with(f"SELECT {_CASE} AS relation, r.id AS id_r, s.id AS id_s FROM bp r JOIN bp s ON {_OV}", "bp"))
def box_find_relation_collect(spark, sf):
    return joins.find_relation(box_part(spark, sf), box_part(spark, sf))


# In u = x + y, v = x - y a diamond is the box (u0 - r, u0 + r) x (v0 - r, v0 + r).
_D = "(SELECT *, x - r AS a0, x + r AS a1, y - r AS b0, y + r AS b1, x + y - r AS x0, x + y + r AS x1, x - y - r AS y0, x - y + r AS y1 FROM dp)"
_DC = "r.a0 <= s.a1 AND s.a0 <= r.a1 AND r.b0 <= s.b1 AND s.b0 <= r.b1"


def _diamond_join(name: str):
    def run(spark, sf):
        return joins.predicate_join(diamond_part(spark, sf), diamond_part(spark, sf), name)

    run.__name__ = f"diamond_{name}_join"
    test = f"NOT ({_OV})" if name == "disjoint" else _TESTS[name]
    query(_with(f"SELECT r.id AS id_r, s.id AS id_s FROM {_D} r JOIN {_D} s ON {_DC} AND {test}", "dp"))(run)


for _name in ("intersect", "inside", "contains", "covers", "covered_by", "equal", "meet", "disjoint"):
    _diamond_join(_name)


@query(_with(f"SELECT k.relation::INTEGER AS relation, count(t.relation) AS n FROM range(8) k(relation) LEFT JOIN (SELECT CASE WHEN NOT ({_OV}) THEN 0 ELSE {_CASE} END AS relation FROM {_D} r JOIN {_D} s ON {_DC}) t ON t.relation = k.relation GROUP BY k.relation", "dp"))
def diamond_find_relation_count(spark, sf):
    return joins.relation_counts(joins.find_relation(diamond_part(spark, sf), diamond_part(spark, sf)))


@query(_with(f"SELECT CASE WHEN NOT ({_OV}) THEN 0 ELSE {_CASE} END AS relation, r.id AS id_r, s.id AS id_s FROM {_D} r JOIN {_D} s ON {_DC}", "dp"))
def diamond_find_relation_collect(spark, sf):
    return joins.find_relation(diamond_part(spark, sf), diamond_part(spark, sf))


@query(_with("SELECT r.id AS id_r, s.id AS id_s FROM sp r JOIN bp s ON r.x0 <= s.x1 AND s.x0 <= r.x1 AND r.y BETWEEN s.y0 AND s.y1", "sp", "bp"))
def segment_box_intersect_join(spark, sf):
    return joins.predicate_join(seg_prices(spark, sf), box_part(spark, sf), "intersect")


# A rising line is (x + t, y + t), t from 0 to r; it lies in a box for the t in which both coordinates do.
_RISING = "greatest(s.x0 - r.x, s.y0 - r.y, 0) <= least(s.x1 - r.x, s.y1 - r.y, r.r)"
_LINE_BOX = "r.x <= s.x1 AND s.x0 <= r.x + r.r AND r.y <= s.y1 AND s.y0 <= r.y + r.r"


def _line_box(name: str):
    def run(spark, sf):
        return joins.predicate_join(line_part(spark, sf), box_part(spark, sf), name)

    run.__name__ = f"line_box_{name}_join"
    test = _RISING if name == "intersect" else f"NOT ({_RISING})"
    query(_with(f"SELECT r.id AS id_r, s.id AS id_s FROM dp r JOIN bp s ON {_LINE_BOX} AND {test}", "dp", "bp"))(run)


_line_box("intersect")
_line_box("disjoint")

# In u = x + y, v = x - y a rising line has one v and u from x + y to x + y + 2 r; a falling one has one u, and v from x - y to x - y + 2 r.


@query(_with("SELECT r.id AS id_r, s.id AS id_s FROM dp r JOIN dp s ON s.x + s.y BETWEEN r.x + r.y AND r.x + r.y + 2 * r.r AND r.x - r.y BETWEEN s.x - s.y AND s.x - s.y + 2 * s.r", "dp"))
def line_line_intersect_join(spark, sf):
    return joins.predicate_join(line_part(spark, sf), line_part(spark, sf, -1), "intersect")


def _line_diamond(name: str, test: str):
    def run(spark, sf):
        return joins.predicate_join(line_part(spark, sf), diamond_part(spark, sf), name)

    run.__name__ = f"line_polygon_{name}_join"
    query(_with(f"SELECT r.id AS id_r, s.id AS id_s FROM dp r JOIN {_D} s ON {test}", "dp"))(run)


_line_diamond("intersect", "r.x + r.y <= s.x1 AND s.x0 <= r.x + r.y + 2 * r.r AND r.x - r.y BETWEEN s.y0 AND s.y1")
_line_diamond("inside", "r.x + r.y >= s.x0 AND r.x + r.y + 2 * r.r <= s.x1 AND r.x - r.y > s.y0 AND r.x - r.y < s.y1")

_DIAMOND_BOX = "greatest(s.x0 - r.x, 0, r.x - s.x1) + greatest(s.y0 - r.y, 0, r.y - s.y1) <= r.r"


@query(_with(f"SELECT r.id AS id_r, s.id AS id_s FROM dp r JOIN bp s ON {_DIAMOND_BOX}", "dp", "bp"))
def polygon_box_intersect_join(spark, sf):
    return joins.predicate_join(diamond_part(spark, sf), box_part(spark, sf), "intersect")


@query(_with("SELECT w.qid, s.id AS rec_id FROM w JOIN bp s ON greatest(s.x0 - w.x, 0, w.x - s.x1) + greatest(s.y0 - w.y, 0, w.y - s.y1) <= 400", "w", "bp"))
def range_polygon_areas(spark, sf):
    return selection.range_batch(box_part(spark, sf), supplier_diamonds(spark, sf))


@query(_with("SELECT w.qid, s.id AS rec_id FROM w JOIN dp s ON greatest(abs(s.x + s.y - w.x - w.y), abs(s.x - s.y - w.x + w.y)) <= 400 + s.r", "w", "dp"))
def range_polygon_polygons(spark, sf):
    return selection.range_batch(diamond_part(spark, sf), supplier_diamonds(spark, sf))


_AWAY = "sqrt(greatest(s.x0 - r.x, 0, r.x - s.x1) * greatest(s.x0 - r.x, 0, r.x - s.x1) + greatest({0}) * greatest({0}))"


def _distance(key: str, right: str, shapes, dy: str):
    def run(spark, sf):
        return joins.shape_distances(pts_customer(spark, sf), shapes(spark, sf), 15)

    run.__name__ = key
    query(_with(f"SELECT r.id AS id_r, s.id AS id_s, {_AWAY.format(dy)} AS dist FROM pc r JOIN {right} s ON r.x BETWEEN s.x0 - 15 AND s.x1 + 15 AND {_AWAY.format(dy)} <= 15", "pc", right))(run)


_distance("point_box_distances", "bp", box_part, "s.y0 - r.y, 0, r.y - s.y1")
_distance("point_line_distances", "sp", seg_prices, "s.y - r.y, r.y - s.y")


def _point_diamond(name: str, key: str, swapped: bool):
    def run(spark, sf):
        p, d = pts_customer(spark, sf), diamond_part(spark, sf)
        return joins.predicate_join(*((d, p) if swapped else (p, d)), name)

    run.__name__ = key
    ids = "dp.id AS id_r, pc.id AS id_s" if swapped else "pc.id AS id_r, dp.id AS id_s"
    query(_with(f"SELECT {ids} FROM pc JOIN dp ON abs(pc.x - dp.x) + abs(pc.y - dp.y) {'<=' if name == 'intersect' else '<'} dp.r", "pc", "dp"))(run)


_point_diamond("intersect", "point_polygon_intersect_join", False)
_point_diamond("inside", "point_polygon_inside_join", False)
_point_diamond("contains", "polygon_point_contains_join", True)


# ---------------------------------------------------------------- structure


@query(_with("SELECT min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax, count(*) AS n FROM bl", "bl"))
def dataset_bounds(spark, sf):
    return source.dataset_bounds(box_lineitem(spark, sf))


GRID = Grid(Bounds(0, 0, 32768, 32768), 128)
_IX = "least(127, greatest(0, floor({0} / 256.0)))::INTEGER"
_CELLS = ("SELECT b.id AS rec_id, i.ix::INTEGER AS ix, j.iy::INTEGER AS iy, CASE WHEN i.ix = b.i0 AND j.iy = b.j0 THEN 'A' WHEN i.ix = b.i0 THEN 'B' WHEN j.iy = b.j0 THEN 'C' ELSE 'D' END AS cls "
          f"FROM (SELECT id, {_IX.format('x0')} AS i0, {_IX.format('x1')} AS i1, {_IX.format('y0')} AS j0, {_IX.format('y1')} AS j1 FROM bp) b, range(128) i(ix), range(128) j(iy) WHERE i.ix BETWEEN b.i0 AND b.i1 AND j.iy BETWEEN b.j0 AND b.j1")


@query(_with(_CELLS, "bp"))
def grid_cell_assignment(spark, sf):
    return GRID.exploded(box_part(spark, sf).df).select("rec_id", "ix", "iy", layer_class().alias("cls"))


@query(_with(f"SELECT cls, count(*) AS n FROM ({_CELLS}) GROUP BY cls", "bp"))
def two_layer_class_counts(spark, sf):
    return grid_cell_assignment(spark, sf).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query(_with(f"SELECT g.n AS cells_per_dim, t.pairs, t.pairs AS distinct_pairs FROM (VALUES (1), (4), (64)) g(n), (SELECT count(*) AS pairs FROM bp r JOIN bp s ON {_OV}) t", "bp"))
def join_dedup_invariant(spark, sf):
    """The pairs of a join do not depend on its grid."""
    out = None
    for n in (1, 4, 64):
        p = joins.predicate_join(box_part(spark, sf), box_part(spark, sf), "intersect", n)
        one = p.agg(F.lit(n).alias("cells_per_dim"), F.count(F.lit(1)).alias("pairs"), F.count_distinct("id_r", "id_s").alias("distinct_pairs"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_with("SELECT id AS rec_id, x, y FROM pc", "pc"))
def wkt_roundtrip_points(spark, sf):
    rows = pts_customer(spark, sf).df.select("rec_id", g.to_wkt(F.col("gtype"), F.col("pts")).alias("wkt"))
    p = g.wkt_points(F.col("wkt"))
    return rows.select("rec_id", p[0]["x"].alias("x"), p[0]["y"].alias("y"))


@query(_with(f"SELECT count(*) AS n FROM {_D} r JOIN {_D} s ON {_DC} AND {_OV}", "dp"))
def april_filter_equivalence(spark, sf):
    d = diamond_part(spark, sf)
    return joins.predicate_join(d, d, "intersect", april_order=10).agg(F.count(F.lit(1)).alias("n"))


def _by_intervals(name: str):
    """The joins of diamonds by the exact kernel alone and with intervals before it give the same pairs."""

    def run(spark, sf):
        d = diamond_part(spark, sf)
        return joins.relation_counts(joins.find_relation(d, d, april_order=10)) if name == "find_relation_count" else joins.predicate_join(d, d, name, april_order=10)

    key = name if name == "find_relation_count" else f"{name}_join"
    run.__name__ = f"april_{key}"
    query(ORACLES[f"diamond_{key}"])(run)


for _name in ("inside", "contains", "covers", "covered_by", "equal", "meet", "disjoint", "find_relation_count"):
    _by_intervals(_name)


@query()
def april_intervals(spark, sf):
    d = diamond_part(spark, sf)
    return with_intervals(d.df, grid_for(d, n=1).bounds, 10).select("rec_id", F.size("april.all_").alias("n_all"), F.size("april.full_").alias("n_full"))


@query("""WITH RECURSIVE h(id, x, y, s, d) AS (
  SELECT c_custkey, (c_custkey % 1024)::BIGINT, (floor(c_acctbal)::BIGINT % 1024 + 1024) % 1024, 512::BIGINT, 0::BIGINT FROM customer
  UNION ALL
  SELECT id,
    CASE WHEN (y & s) > 0 THEN x & (s - 1) WHEN (x & s) > 0 THEN s - 1 - (y & (s - 1)) ELSE y & (s - 1) END,
    CASE WHEN (y & s) > 0 THEN y & (s - 1) WHEN (x & s) > 0 THEN s - 1 - (x & (s - 1)) ELSE x & (s - 1) END,
    s // 2, d + s * s * xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END)
  FROM h WHERE s > 0)
SELECT id AS rec_id, d FROM h WHERE s = 0""")
def hilbert_encode(spark, sf):
    p = pts_customer(spark, sf).df
    return p.select("rec_id", hilbert_column(10, F.col("xmin").cast("long") % 1024, F.pmod(F.col("ymin").cast("long"), F.lit(1024))).alias("d"))
