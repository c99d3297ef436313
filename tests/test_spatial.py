"""Answers known from small fixtures, and answers that must not depend on how they are computed."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.engine import SpatialEngine
from quadrille.functions.kernels import is_valid, relate, shapes
from quadrille.operators import joins, selection
from quadrille.sources import geometry as source
from quadrille.types import DistanceJoinQuery, InvalidGeometry, InvalidParameter, KNNQuery, PredicateJoinQuery, QueryType, RangeQuery, ResultType, UnknownDataset, query_type

SQUARE = [0, 0, 0, 4, 4, 4, 4, 0, 0, 0]


def moved(g, dx, dy, k=1):
    return [v * k + (dx if i % 2 == 0 else dy) for i, v in enumerate(g)]


@pytest.mark.parametrize(("kr", "r", "ks", "s", "matrix"), [
    ("POLYGON", SQUARE, "POLYGON", SQUARE, "2FFF1FFF2"),
    ("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 4, 0), "FF2F11212"),
    ("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 4, 4), "FF2F01212"),
    ("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 9, 9), "FF2FF1212"),
    ("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 1, 1, 0.5), "212FF1FF2"),
    ("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 2, 2), "212101212"),
    ("POLYGON", SQUARE, "LINESTRING", [1, 1, 3, 3], "102FF1FF2"),
    ("POLYGON", SQUARE, "LINESTRING", [0, 1, 0, 3], "FF2101FF2"),
    ("LINESTRING", [0, 0, 4, 4], "LINESTRING", [0, 4, 4, 0], "0F1FF0102"),
    ("POINT", [2, 2], "POLYGON", SQUARE, "0FFFFF212"),
    ("POINT", [0, 2], "POLYGON", SQUARE, "F0FFFF212"),
])
def test_matrices(kr, r, ks, s, matrix):
    assert relate(*shapes(kr, r, ks, s)) == matrix


def test_validity():
    assert is_valid("POLYGON", SQUARE) and not is_valid("POLYGON", [0, 0, 4, 4, 4, 0, 0, 4, 0, 0]) and not is_valid("POLYGON", [0, 0, 4, 0, 2, 0, 0, 0])
    assert is_valid("LINESTRING", [0, 0, 1, 1]) and not is_valid("LINESTRING", [1, 1, 1, 1])


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wkt")
    r = ["POLYGON ((0 0,0 4,4 4,4 0,0 0))\tname", "POLYGON ((0 0,4 4,4 0,0 4,0 0))", "", "POINT (1 1)", "POLYGON ((10 10,10 14,14 14,14 10,10 10),(11 11,11 12,12 12,12 11,11 11))"]
    s = ["POLYGON ((1 1,1 2,2 2,2 1,1 1))", "POLYGON ((4 0,4 4,8 4,8 0,4 0))", "POLYGON ((10 10,10 14,14 14,14 10,10 10))", "POLYGON ((2 2,2 6,6 6,6 2,2 2))"]
    p = ["POINT (0 0)", "POINT (3 4)", "POINT (-1 0)", "POINT (10 10)", "MULTIPOINT (1 1,2 2)"]
    for name, lines in zip("rsp", (r, s, p)):
        (folder / name).write_text("\n".join(lines))
    e = SpatialEngine(spark)
    assert [e.prepare_dataset(str(folder / n), "WKT", k) for n, k in zip("rsp", ("POLYGON", "POLYGON", "POINT"))] == [0, 1, 2]
    e.folder = folder
    return e


def test_wkt_source(engine):
    assert sorted(r[0] for r in engine.dataset(0).df.select("rec_id").collect()) == [0, 4]
    assert sorted(r[0] for r in engine.dataset(2).df.select("rec_id").collect()) == [0, 1, 2, 3]


def test_engine_joins(engine):
    pairs = lambda name: sorted(map(tuple, engine.query(PredicateJoinQuery(1, ResultType.COLLECT, 0, 1, query_type(name))).collect()))
    assert pairs("intersect") == [(0, 0), (0, 1), (0, 3), (4, 2)]
    assert pairs("contains") == pairs("covers") == [(0, 0), (4, 2)]
    assert pairs("inside") == pairs("covered_by") == pairs("equal") == [(4, 2)]
    assert pairs("meet") == [(0, 1)] and pairs("disjoint") == []
    counts = {r.relation: r.n for r in engine.query(PredicateJoinQuery(1, "COUNT", 0, 1, QueryType.FIND_RELATION)).collect()}
    assert counts == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1}
    everything = engine.query(PredicateJoinQuery(1, "COLLECT", 0, 1, QueryType.DISJOINT, "all"))
    assert sorted(map(tuple, everything.collect())) == [(0, 2), (4, 0), (4, 1), (4, 3)]
    assert engine.query(DistanceJoinQuery(1, "COUNT", 2, 2, 5.0)).collect()[0].n == 8


def test_engine_batches(engine):
    q = [RangeQuery(5, "COUNT", 2, "BOX(4 5,0 0)"), RangeQuery(6, "COUNT", 2, "POLYGON ((50 50,50 51,51 51,50 50))"), RangeQuery(7, "COUNT", 2, "POLYGON ((-2 -1,-2 1,2 1,2 -1,-2 -1))")]
    assert sorted(map(tuple, engine.query_batch(q, QueryType.RANGE).collect())) == [(5, 2), (6, 0), (7, 2)]
    got = engine.query_batch([KNNQuery(1, dataset=2, wkt="POINT (0 0)", k=3), KNNQuery(2, dataset=2, wkt="POINT (9 9)", k=9)], QueryType.KNN).collect()
    by = {k: [r.rec_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == k] for k in (1, 2)}
    assert by == {1: [0, 2, 1], 2: [3, 1, 0, 2]}
    (engine.folder / "q").write_text("BOX(0 0,4 4)\nPOLYGON ((9 9,9 15,15 15,15 9,9 9))")
    hits = engine.query_batch(engine.load_range_queries(str(engine.folder / "q")), QueryType.RANGE, 1)
    assert sorted(map(tuple, hits.collect())) == [(0, 3), (1, 1)]
    with pytest.raises(InvalidParameter):
        engine.query_batch([], QueryType.RANGE)
    for bad in (lambda: RangeQuery(1, "COUNT", 0, "POINT (1 1)"), lambda: KNNQuery(1, wkt="BOX(0 0,1 1)")):
        with pytest.raises(InvalidGeometry):
            bad()


def test_index_save_load(engine, tmp_path):
    engine.build_index([1])
    assert engine.indexes[1].where("cls = 'A'").count() == 4
    engine.save(1, str(tmp_path / "s"))
    again = engine.load(str(tmp_path / "s"), "POLYGON")
    assert engine.query(PredicateJoinQuery(1, "COUNT", again, 1, QueryType.EQUAL)).collect()[0].n == 4
    engine.unload_dataset(again)
    assert again not in engine.datasets


def test_joins_do_not_depend_on_the_grid_or_on_intervals(spark):
    r = random.Random(3)
    rows = [(i, float(r.randrange(60)), float(r.randrange(60)), float(r.randrange(1, 6))) for i in range(80)]
    t = spark.createDataFrame(rows, "i long, x double, y double, d double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("d")).alias("x"), (F.col("y") + dy * F.col("d")).alias("y"))
    g = source.from_vertices(t, F.col("i"), "POLYGON", F.array(*[corner(*c) for c in ((-1, 0), (0, 1), (1, 0), (0, -1))]))
    expected = {(a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) + abs(a[2] - b[2]) <= a[3] + b[3]}
    for options in ({"n": 1}, {"n": 7}, {"april_order": 8}):
        got = joins.predicate_join(g, g, "intersect", **options).collect()
        assert len(got) == len(expected) and {tuple(x) for x in got} == expected
    near = joins.predicate_join(g, g, "disjoint", april_order=8).count()
    assert near + len(expected) == joins.mbr_pairs(g, g).count() == joins.find_relation(g, g).count()


def test_streamed_ranges(spark, tmp_path):
    from quadrille.streaming.selection import stream_points, stream_range

    spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "i long, x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, x double, y double").parquet(str(tmp_path / "in"))
    hits = stream_range(stream_points(stream, "i", "x", "y"), selection.one_query(spark, "BOX(0 0,2 2)", 4))
    q = hits.writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from hits").collect()] == [(4, 1)]


def test_quick_cases_agree_with_the_exact_kernel():
    """What doubles decide with certainty is what the exact kernel says, over rings and lines that touch, cross or nest."""
    import random

    import numpy as np

    from quadrille.functions import kernels as k

    rng = random.Random(5)

    def ring():
        x, y, r = rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 5)
        step = rng.choice([1, 0.1, 1e6])
        corners = rng.choice([[(-r, 0), (0, r), (r, 0), (0, -r)], [(0, 0), (r, 0), (r, r), (0, r)], [(0, 0), (r + 1, 1), (1, r + 1)]])
        pts = [((x + a) * step, (y + b) * step) for a, b in corners]
        return "POLYGON", np.array([v for p in [*pts, pts[0]] for v in p], float)

    def line():
        return "LINESTRING", np.array([rng.randint(0, 9) for _ in range(6)], float)

    sides = [[ring() if rng.random() < 0.7 else line() for _ in range(3000)] for _ in range(2)]
    (kr, r), (ks, s) = ([list(x) for x in zip(*side)] for side in sides)
    cases, seen = k.quick_cases(kr, r, ks, s), set()
    for a, g, b, h, case in zip(kr, r, ks, s, cases.tolist()):
        if case == k.OPEN:
            continue
        x, y = k.shapes(a, g, b, h)
        assert k.intersects(x, y) == (case != k.APART)
        if a == b == "POLYGON":
            seen.add(case)
            assert k.relate(x, y) == k.POLYGON_MATRICES[case]
    assert seen == {k.CROSS, k.R_IN_S, k.S_IN_R, k.APART}


@pytest.mark.parametrize("name", ["range_box_areas", "range_linestrings", "box_find_relation_count", "segment_box_intersect_join", "dataset_bounds"])
def test_whole_line_items_agree_with_sql(spark, name):
    import duckdb

    from quadrille.plans.catalogue import ORACLES, QUERIES

    sf, key = "/root/testdata/sf0.001", name
    assert "WHERE" not in ORACLES[key].replace("WHERE t.", "")
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in QUERIES[key](spark, sf).select(*names).collect()) == sorted(want.fetchall())


def test_csv_keeps_every_vertex(spark, tmp_path):
    n = (1 << 20) + 3
    (tmp_path / "long.csv").write_text("1\n0," + ",".join(f"{k % 7} 1" for k in range(n)) + "\n")
    read = source.read_csv(spark, str(tmp_path / "long.csv"), "LINESTRING", validate=False)
    assert [r[0] for r in read.df.select(F.size("pts")).collect()] == [n]


def test_raster_intervals_by_brute_force():
    """Against each cell of a small raster: every touched cell is in all, with those of an outline's rounding at most; full cells lie inside."""
    import numpy as np

    from quadrille.functions import kernels as k
    from quadrille.operators.april import hilbert, raster
    from quadrille.types import Bounds

    order, bounds, rng = 4, Bounds(0, 0, 15, 15), random.Random(6)  # a cell is one by one
    for _ in range(60):
        kind = rng.choice(["POLYGON", "POLYGON", "LINESTRING"])
        x, y, r = rng.randint(4, 10), rng.randint(4, 10), rng.randint(1, 4)
        corners = rng.choice([[(-r, 0), (0, r), (r, 0), (0, -r)], [(-r, -r), (-r, r), (r, r), (r, -r)], [(-r, 0), (r, 1), (0, r)]])
        pts = [(x + a + 0.25, y + b + 0.5) for a, b in corners]
        flat = np.array([v for p in (pts + [pts[0]] if kind == "POLYGON" else pts[:3]) for v in p])
        every, full = ({d for run in runs for d in range(run["s"], run["e"])} for runs in raster(kind, flat, bounds, order))
        touched, inside = set(), set()
        for i in range(16):
            for j in range(16):
                cell = [i, j, i, j + 1, i + 1, j + 1, i + 1, j, i, j]
                a, b = k.shapes(kind, flat, "POLYGON", cell)
                if k.intersects(a, b):
                    touched.add(int(hilbert(order, [i], [j])[0]))
                    if kind == "POLYGON" and k.matches(k.relate(a, b), "contains"):
                        inside.add(int(hilbert(order, [i], [j])[0]))
        assert touched == every and full <= inside and (kind == "POLYGON" or not full)


@pytest.mark.parametrize("name", ["intersect", "inside", "disjoint", "equal", "meet", "contains", "covers", "covered_by"])
def test_boxes_without_width_or_height(spark, name):
    """Closed forms on boxes that are lines or points, against the exact kernel on the lines and points that they are."""
    from quadrille.functions import kernels as k

    rng = random.Random(9)
    rows = []
    for i in range(60):
        x, y = rng.randint(0, 4), rng.randint(0, 4)
        rows.append((i, x, y, x + rng.choice([0, 0, 1, 2]), y + rng.choice([0, 0, 1, 2])))
    boxes = source.from_boxes(spark.createDataFrame(rows, "i long, a long, b long, c long, d long"), *[F.col(c) for c in "iabcd"])

    def shape(_, a, b, c, d):
        if a == c and b == d:
            return "POINT", [a, b]
        return ("LINESTRING", [a, b, c, d]) if a == c or b == d else ("POLYGON", [a, b, a, d, c, d, c, b, a, b])

    def holds(r, s):
        near = r[1] <= s[3] and s[1] <= r[3] and r[2] <= s[4] and s[2] <= r[4]
        return near and k.predicate(name, *k.shapes(*shape(*r), *shape(*s)))

    got = {tuple(r) for r in joins.predicate_join(boxes, boxes, name).collect()}
    assert got == {(r[0], s[0]) for r in rows for s in rows if holds(r, s)}


def test_distances_of_shapes(spark):
    from quadrille.functions.kernels import shape_distance

    assert shape_distance("POLYGON", SQUARE, "POINT", [7, 8]) == 5 and shape_distance("POLYGON", SQUARE, "POLYGON", moved(SQUARE, 1, 1, 0.5)) == 0
    assert shape_distance("LINESTRING", [0, 0, 4, 4], "POINT", [0, 4]) == pytest.approx(8**0.5)
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(1, 4))) for i in range(50)]
    t = spark.createDataFrame(rows, "i long, x double, y double, d double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("d")).alias("x"), (F.col("y") + dy * F.col("d")).alias("y"))
    g = source.from_vertices(t, F.col("i"), "POLYGON", F.array(*[corner(*c) for c in ((-1, 0), (0, 1), (1, 0), (0, -1))]))
    flat = {i: [x - d, y, x, y + d, x + d, y, x, y - d, x - d, y] for i, x, y, d in rows}
    got = {(r.id_r, r.id_s): r.dist for r in joins.shape_distances(g, g, 3).collect()}
    expected = {(a, b): v for a in flat for b in flat if (v := shape_distance("POLYGON", flat[a], "POLYGON", flat[b])) <= 3}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_csv_lines_and_text_of_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text("3\n7,0 0,2 2.5\n8,1 1,1 1\n9,5 5,6 5,6 7\n")
    (tmp_path / "l.wkt").write_text("LINESTRING (0 0, 2 2.5)\tfirst\nLINESTRING(5 5,6 5,6 7)\nLINESTRING (1 1,1 1)\nPOINT (1 1)\n")
    csv, wkt = source.read_csv(spark, str(tmp_path / "l.csv"), "LINESTRING"), source.read_wkt(spark, str(tmp_path / "l.wkt"), "LINESTRING")
    points = lambda x: {r.rec_id: [tuple(p) for p in r.pts] for r in x.df.collect()}
    assert points(csv) == {0: [(0, 0), (2, 2.5)], 2: [(5, 5), (6, 5), (6, 7)]} and points(wkt) == {0: [(0, 0), (2, 2.5)], 1: [(5, 5), (6, 5), (6, 7)]}
    e = SpatialEngine(spark)
    a, b = e.prepare_dataset(str(tmp_path / "l.csv"), "CSV", "LINESTRING"), e.prepare_dataset(str(tmp_path / "l.wkt"), "WKT", "LINESTRING")
    assert sorted(map(tuple, e.query(PredicateJoinQuery(1, "COLLECT", a, b, QueryType.EQUAL)).collect())) == [(0, 0), (2, 1)]


def test_windows_that_are_none_are_told_from_empty_ones(engine, spark):
    w = spark.createDataFrame([(1, "BOX(0 0,4 4)"), (2, "BOX(90 90,91 91)"), (3, "BOX(1)"), (4, None)], "qid int, wkt string")
    assert sorted(map(tuple, engine.query_batch(w, QueryType.RANGE, 2).collect())) == [(1, 2), (2, 0), (3, None), (4, None)]


def test_given_bounds_are_used_without_a_scan(spark):
    from quadrille.plans.grid import grid_for
    from quadrille.types import Bounds, DataType

    class Unread:
        def __getattr__(self, name):
            raise AssertionError("read")

    grid = grid_for(source.Geometries(Unread(), DataType.BOX, Bounds(0, 0, 4, 4)), source.Geometries(Unread(), DataType.BOX, Bounds(2, 2, 9, 8)), n=3)
    assert (grid.bounds, grid.n) == (Bounds(0, 0, 9, 8), 3)


def test_neighbours_through_finer_and_finer_counts(spark):
    rng = random.Random(12)
    rows = [(i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(3000)] + [(3000 + i, 50.0, 50.0) for i in range(20)]
    data = source.from_points(spark.createDataFrame(rows, "i long, x double, y double"), *[F.col(c) for c in "ixy"])
    queries = [(q, rng.uniform(-20, 60), rng.uniform(-20, 60), rng.choice([1, 3, 30])) for q in range(40)] + [(40, 0.0, 0.0, 4000)]
    q = spark.createDataFrame(queries, "qid int, x double, y double, k int")
    for n in (None, 8, 64):
        got = {}
        for r in selection.knn_batch(data, q, n=n).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.rec_id
        for qid, x, y, k in queries:
            best = sorted(rows, key=lambda p: (((p[1] - x) ** 2 + (p[2] - y) ** 2) ** 0.5, p[0]))[:k]
            assert [got[qid][j + 1] for j in range(len(best))] == [p[0] for p in best]


def test_streams_take_a_bounded_number_of_windows(spark, monkeypatch):
    from quadrille.streaming import selection as streamed

    monkeypatch.setattr(streamed, "MOST_STREAM_WINDOWS", 1)
    points = streamed.stream_points(spark.createDataFrame([(1, 1.0, 1.0)], "i long, x double, y double"), "i", "x", "y")
    with pytest.raises(InvalidParameter):
        streamed.stream_range(points, spark.createDataFrame([(1, "BOX(0 0,1 1)"), (2, "BOX(0 0,1 1)")], "qid int, wkt string"))


@pytest.mark.parametrize("name", ["intersect", "inside", "disjoint", "equal", "meet", "contains", "covers", "covered_by"])
def test_intervals_change_no_answer(spark, name):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(30)), float(rng.randrange(30)), float(rng.choice([1, 2, 5, 9]))) for i in range(70)]
    t = spark.createDataFrame(rows, "i long, x double, y double, d double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("d")).alias("x"), (F.col("y") + dy * F.col("d")).alias("y"))
    g = source.from_vertices(t, F.col("i"), "POLYGON", F.array(*[corner(*c) for c in ((-1, 0), (0, 1), (1, 0), (0, -1))]))
    plain, quick = (sorted(map(tuple, joins.predicate_join(g, g, name, april_order=o).collect())) for o in (None, 9))
    assert plain == quick and plain
    if name == "intersect":
        plain, quick = (sorted(map(tuple, joins.find_relation(g, g, april_order=o).collect())) for o in (None, 9))
        assert plain == quick
        assert joins.disjoint_count(g, g).collect()[0].n == 70 * 70 - joins.predicate_join(g, g, "intersect").count()


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_time_and_unknown_datasets(spark):
    e = SpatialEngine(spark)
    assert 0 <= e.time() <= e.time()
    with pytest.raises(UnknownDataset):
        e.query(PredicateJoinQuery(1, "COUNT", 0, 1, QueryType.MEET))


def test_large_boxes_and_windows_touch_few_cells(spark):
    from quadrille.plans.grid import grid_for

    rng = random.Random(21)
    rows = []
    for i in range(250):
        x, y, size = rng.randrange(4000), rng.randrange(500), rng.choice([1, 2, 3])
        rows.append((i, x, y, x + size, y + size))
    rows += [(9000, 0, 0, 4000, 500), (9001, 100, 0, 130, 500), (9002, 0, 250, 4000, 251), (9003, 30, 30, 90, 90)]
    boxes = source.from_boxes(spark.createDataFrame(rows, "i long, a long, b long, c long, d long"), *[F.col(c) for c in "iabcd"])
    grid = grid_for(boxes, n=256)
    assert len(grid.levels) > 1 and grid.n == grid.ny == 256 and grid.exploded(boxes.df).groupBy("rec_id").count().agg(F.max("count")).collect()[0][0] <= 40 * len(grid.levels)
    meets = lambda r, s: r[1] <= s[3] and s[1] <= r[3] and r[2] <= s[4] and s[2] <= r[4]
    expected = sorted((r[0], s[0]) for r in rows for s in rows if meets(r, s))
    for n in (None, 1, 256):
        assert sorted(map(tuple, joins.predicate_join(boxes, boxes, "intersect", n).collect())) == expected
    some = [r for r in rows if r[0] % 60 == 0] + rows[-4:]
    windows = spark.createDataFrame([(r[0], f"BOX({r[1]} {r[2]},{r[3]} {r[4]})") for r in some], "qid int, wkt string")
    for n in (None, 256):
        assert sorted(map(tuple, selection.range_batch(boxes, windows, n).collect())) == sorted((w[0], r[0]) for w in some for r in rows if meets(w, r))


def test_a_wide_plane_has_more_columns_than_rows_of_cells(spark):
    from quadrille.plans.grid import grid_for

    t = spark.range(20_000).select(F.col("id"), (F.col("id") % 10_000).alias("x"), (F.col("id") % 7).alias("y"))
    grid = grid_for(source.from_boxes(t, F.col("id"), F.col("x"), F.col("y"), F.col("x") + 3, F.col("y") + 3))
    assert grid.n > 100 and grid.ny == 1


def test_convex_shapes_agree_with_the_exact_kernel():
    """Touching, nested, equal and crossing convex shapes: all whole ones are decided together, as the exact kernel says."""
    import numpy as np

    from quadrille.functions import kernels as k

    rng = random.Random(8)

    def shape(kind):
        x, y, r = rng.randint(0, 7), rng.randint(0, 7), rng.randint(1, 4)
        corners = rng.choice([[(-r, 0), (0, r), (r, 0), (0, -r)], [(0, 0), (r, 0), (r, r), (0, r)], [(0, 0), (0, r), (r, r), (r, 0)]])
        pts = [(x + a, y + b) for a, b in corners] if kind == "POLYGON" else [(x, y), (x + rng.choice([-r, 0, r]), y + r)]
        return np.array([v for p in (pts + pts[:1] if kind == "POLYGON" else pts) for v in p], float)

    for kr, ks in (("POLYGON", "POLYGON"), ("LINESTRING", "POLYGON"), ("POLYGON", "LINESTRING"), ("LINESTRING", "LINESTRING")):
        r, s = [shape(kr) for _ in range(250)], [shape(ks) for _ in range(250)]
        at = k.convex_sides(kr, np.array(r).T, ks, np.array(s).T)
        assert at.sure.all()
        exact = [k.shapes(kr, a, ks, b) for a, b in zip(r, s)]
        for name in k.MASKS:
            told = k._convex_predicate(name, kr, ks, at)
            assert all(t == k.predicate(name, *e) for t, e in zip(told.tolist(), exact) if t >= 0)
            assert (told >= 0).all() or kr == ks == "LINESTRING"
        if kr == ks == "POLYGON":
            assert k._convex_relation(kr, ks, at).tolist() == [k.classify(k._boxes_case(a, b), k.relate(*e)) for a, b, e in zip(r, s, exact)]
    pairs = [([0, 0, 4, 0, 1, 1, 0, 4, 0, 0], True), ([0, 0, 0.1, 0, 0.1, 0.1, 0, 0.1, 0, 0], True), ([0, 0, 4, 0, 4, 4, 0, 4, 0, 0], False)]
    for ring, open_ in pairs:  # a ring that is not convex, one that is not whole
        assert k.convex_sides("POLYGON", np.array([ring], float).T, "POLYGON", np.array([SQUARE], float).T).sure[0] != open_


@pytest.mark.parametrize("name", ["diamond_find_relation_count", "polygon_box_intersect_join", "point_polygon_inside_join", "polygon_point_contains_join", "diamond_intersect_join", "box_intersect_join", "april_contains_join"])
def test_no_side_of_a_join_is_broadcast_and_no_pair_is_shuffled(spark, name):
    """A file's few columns are small and the shapes made of them are not; pairs are far more than shapes."""
    from quadrille.plans.catalogue import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [cell" in plan or "FlatMapCoGroups" in plan
    assert "BroadcastHashJoin [cell" not in plan and "BroadcastNestedLoopJoin" not in plan and "RoundRobinPartitioning" not in plan.split("FlatMapCoGroups")[0].split("SortMergeJoin")[0]


def test_intervals_are_passed_on_in_small_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quadrille.operators import april
    from quadrille.types import Bounds

    monkeypatch.setattr(april, "MOST_HELD", 1000)
    rings = [[x - 40, 500, x, 540, x + 40, 500, x, 460, x - 40, 500] for x in range(50, 550)]
    batch = pa.record_batch({"rec_id": list(range(500)), "gtype": ["POLYGON"] * 500, "flat_": pa.array(rings, pa.list_(pa.float64()))})
    made = list(april.interval_batches([batch], Bounds(0, 0, 1023, 1023), 10))
    assert [i for b in made for i in b.column("rec_id").to_pylist()] == list(range(500))
    assert max(sum(len(x["all_"]) + len(x["full_"]) for x in b.column("april").to_pylist()) for b in made) < 1000 + 2 * 200
    for i, x in enumerate(v for b in made for v in b.column("april").to_pylist()):
        if i % 50 == 0:
            assert (x["all_"], x["full_"]) == april.raster("POLYGON", np.array(rings[i], float), Bounds(0, 0, 1023, 1023), 10)
            assert np.frombuffer(x["all_b"], "<u4").tolist() == [v for run in x["all_"] for v in (run["s"], run["e"])]


def test_cells_fit_the_windows_of_a_wide_plane(spark):
    """In a plane a thousand times wider than high, windows as wide as high touch few cells, all on one level."""
    t = spark.range(20_000).select("id", (F.col("id") * 50.0).alias("x"), (F.col("id") % 1000).cast("double").alias("y"))
    points = source.from_points(t, F.col("id"), F.col("x"), F.col("y"))
    w = spark.range(100).select((F.col("id") * 10_000.0).alias("xmin"), F.lit(100.0).alias("ymin"), (F.col("id") * 10_000.0 + 800).alias("xmax"), F.lit(900.0).alias("ymax"))
    from quadrille.plans.grid import grid_for

    grid = grid_for(points, windows=w)
    assert grid.levels == (0,) and min(grid.sides()) >= 300 and grid.exploded(w).count() <= 100 * 12
    pairs = grid.exploded(points.df.select("rec_id", "xmin", "ymin", "xmax", "ymax")).select("cell").join(grid.exploded(w).select("cell"), "cell").count()
    assert pairs <= 16 * points.df.join(w.select(*[F.col(c).alias(f"w_{c}") for c in w.columns]), (F.col("xmin") >= F.col("w_xmin")) & (F.col("xmin") <= F.col("w_xmax")) & (F.col("ymin") >= F.col("w_ymin")) & (F.col("ymin") <= F.col("w_ymax"))).count()


def test_neighbours_in_a_wide_plane(spark):
    """Cells for neighbours are about as wide as high, whatever the plane's aspect; answers as by brute force."""
    from quadrille.types import Bounds

    for b, rows in ((Bounds(0, 0, 1e6, 1000), 1_000_000), (Bounds(0, 0, 1000, 1e6), 1_000_000), (Bounds(0, 0, 100, 100), 5000)):
        nx, ny = selection.knn_cells(b, rows)
        assert 0.2 <= (b.xmax - b.xmin) / nx / ((b.ymax - b.ymin) / ny) <= 5 and rows / 50 / 4 <= nx * ny <= rows / 50
    r = random.Random(4)
    rows = [(i, r.randrange(200_000) * 1.0, r.randrange(100) * 1.0) for i in range(6000)]
    asked = [(i, r.randrange(-10, 200_010) * 1.0, r.randrange(-10, 110) * 1.0) for i in range(20)]
    points = source.from_points(spark.createDataFrame(rows, "i long, x double, y double"), F.col("i"), F.col("x"), F.col("y"))
    got = {}
    for x in selection.knn_batch(points, spark.createDataFrame(asked, "qid int, x double, y double"), 3).collect():
        got.setdefault(x.qid, []).append((x.rank, x.rec_id))
    for q, x, y in asked:
        near = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, i) for i, a, b in rows)[:3]
        assert sorted(got[q]) == [(n, i) for n, (_, i) in enumerate(near, 1)]


def test_shapes_alike_are_rastered_together(monkeypatch):
    """Shapes of mixed types and sizes in a wide plane, in parts of few cells: the same intervals as one by one, in order, by few calls."""
    import numpy as np
    import pyarrow as pa

    from quadrille.operators import april
    from quadrille.types import Bounds

    rng, bounds, shapes = random.Random(12), Bounds(0, 0, 1e6, 1000), []
    for i in range(300):
        x, y, r = rng.random() * 999_000 + 100, rng.randint(100, 900), rng.choice([1, 8, 40, 90.5])
        shapes.append([("POLYGON", [x - r, y, x, y + r, x + r, y, x, y - r, x - r, y]), ("LINESTRING", [x, y, x + r, y]), ("POLYGON", [x, y, x + 9000, y + r, x + r, y - r, x, y]), ("BOX", [x, y, x, y + r, x + r, y + r, x + r, y, x, y])][rng.randrange(4)])
    batch = pa.record_batch({"rec_id": list(range(300)), "gtype": [k for k, _ in shapes], "flat_": pa.array([f for _, f in shapes], pa.list_(pa.float64()))})
    one = [april.raster(k, np.array(f, float), bounds, 10) for k, f in shapes]
    real, sizes = april.rasters, []
    monkeypatch.setattr(april, "rasters", lambda kind, pts, *rest: (sizes.append(len(pts)), real(kind, pts, *rest))[1])
    for cells in (april.MOST_CELLS, 5000):
        sizes.clear()
        monkeypatch.setattr(april, "MOST_CELLS", cells)
        made = [x for b in april.interval_batches([batch], bounds, 10) for x in b.column("april").to_pylist()]
        assert [(x["all_"], x["full_"]) for x in made] == one and sum(sizes) == 300
        assert len(sizes) == 4 if cells > 5000 else 12 < len(sizes) < 300
    bare = [x for b in april.interval_batches([batch], bounds, 10, lists=False) for x in b.column("april").to_pylist()]
    assert bare == [{k: x[k] for k in ("all_b", "full_b")} for x in made]


@pytest.mark.parametrize("name", ["point_polygon_intersect_join", "diamond_inside_join", "diamond_meet_join", "line_polygon_inside_join", "segment_box_intersect_join"])
def test_other_joins_broadcast_no_side_either(spark, name):
    from quadrille.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [cell" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["diamond_inside_join", "diamond_meet_join", "diamond_contains_join", "diamond_covers_join", "diamond_covered_by_join"])
def test_a_set_that_meets_itself_is_dealt_once(spark, name):
    from quadrille.plans.catalogue import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["point_polygon_inside_join", "point_polygon_intersect_join"])
def test_boxes_of_polygons_are_read_without_a_ring_being_turned(spark, name):
    """The bounds of diamonds, read before each join, come of no lambda evaluated row by row; the join alone turns rings."""
    from quadrille.plans import catalogue

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan(source.dataset_bounds(catalogue.diamond_part(spark, "/root/testdata/sf0.001")))
    assert "lambda" in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_tasks_of_large_joins_follow_the_rows(spark, monkeypatch):
    """However few shuffle partitions the session has, a task of a large join holds a bounded number of rows; pairs are the same."""
    from quadrille.operators import joins
    from quadrille.plans.catalogue import QUERIES

    asked = lambda: QUERIES["segment_box_intersect_join"](spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted(asked().collect())
    monkeypatch.setattr(joins, "FEW_ROWS", 100)
    assert "REPARTITION_BY_NUM" not in plan(asked())
    monkeypatch.setattr(joins, "ROWS_A_TASK", 100)
    found = asked()
    rows = sum(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("lineitem", "part"))
    assert plan(found).count(f", {-(-rows // 100)}), REPARTITION_BY_NUM") == 2
    assert sorted(found.collect()) == want and want


def _convex_shapes(r, n):
    """Lines, triangles, boxes and diamonds either way round, on a small plane so that they touch often."""
    out = []
    for i in range(n):
        x, y, a, b = r.randint(-6, 6), r.randint(-6, 6), r.randint(1, 5), r.randint(1, 5)
        ring = r.choice([[(x, y), (x + a, y + b), (x + a, y - b)], [(x, y), (x, y + b), (x + a, y + b), (x + a, y)], [(x - a, y), (x, y + a), (x + a, y), (x, y - a)], [(x, y), (x, y + b), (x + a, y)], [(x, y), (x + a, y), (x + 2 * a, y), (x, y + b)]])
        ring = ring[::-1] if r.random() < 0.5 else ring
        out.append((i, [(float(u), float(v)) for u, v in [*ring, ring[0]]], [(float(x), float(y)), (float(x + r.choice([-a, 0, a])), float(y + b))]))
    return out


def test_small_convex_shapes_are_told_in_columns_as_by_the_kernel(spark):
    import numpy as np

    from quadrille.functions import geometry as g
    from quadrille.functions.kernels import decide_predicate

    shapes = _convex_shapes(random.Random(31), 150)
    df = spark.createDataFrame([(i, p, q) for i, p, q in shapes], f"id int, ring {g.PTS}, ends {g.PTS}")
    sides = {}
    for line in (False, True):
        rows = g.convex(df.select("id", F.col("ends" if line else "ring").alias("pts")), line)
        assert rows.where("sure").count() == len(shapes)
        sides[line] = rows.select("id", *g.corner_columns(line))
    names = ("intersect", "inside", "disjoint", "equal", "meet", "contains", "covers", "covered_by")
    for line_r, line_s in ((False, False), (True, False), (False, True)):
        a, b = (sides[line].select(*[F.col(c).alias(f"{c}_{x}") for c in sides[line].columns]) for line, x in ((line_r, "r"), (line_s, "s")))
        box = lambda x, line: [f(*[F.col(f"{v}{i}_{x}") for i in range(2 if line else 4)]) for f, v in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y"))]
        br, bs = (dict(zip(source.BOX, box(x, line))) for x, line in (("r", line_r), ("s", line_s)))
        got = a.crossJoin(b).where(g.overlap(br, bs)).select("id_r", "id_s", *[g.convex_predicate(n, line_r, line_s).alias(n) for n in names]).collect()
        flat = lambda ids, line: (np.array([v for i in ids for p in shapes[i][2 if line else 1] for v in p]), np.cumsum([0] + [2 * len(shapes[i][2 if line else 1]) for i in ids]))
        r, s = flat([x.id_r for x in got], line_r), flat([x.id_s for x in got], line_s)
        kinds = ["LINESTRING" if line else "POLYGON" for line in (line_r, line_s)]
        for n in names:
            want = decide_predicate(n, kinds[0], r, kinds[1], s)
            assert [x[n] for x in got] == (want == 1).tolist(), (n, line_r, line_s)
            assert 0 < want.sum() < len(got) or n == "equal" or line_r and n in ("contains", "covers") or line_s and n in ("inside", "covered_by")


def test_relations_of_small_convex_rings_are_told_in_columns_as_by_the_kernel(spark):
    import numpy as np

    from quadrille.functions import geometry as g
    from quadrille.functions.kernels import decide_relation

    shapes = _convex_shapes(random.Random(32), 250)
    rings = source.from_vertices(spark.createDataFrame([(i, p) for i, p, _ in shapes], f"id int, p {g.PTS}"), F.col("id"), "POLYGON", F.col("p"))
    sides = g.convex(rings.df, False).select("rec_id", *source.BOX, *g.corner_columns(False))
    a, b = (sides.select(*[F.col(c).alias(f"{c}_{x}") for c in sides.columns]) for x in "rs")
    br, bs = ({c: F.col(f"{c}_{x}") for c in source.BOX} for x in "rs")
    got = g.convex_relations(a.crossJoin(b).where(g.overlap(br, bs))).select("rec_id_r", "rec_id_s", "relation").collect()
    flat = lambda ids: (np.array([v for i in ids for p in shapes[i][1] for v in p]), np.cumsum([0] + [2 * len(shapes[i][1]) for i in ids]))
    want = decide_relation("POLYGON", flat([x.rec_id_r for x in got]), "POLYGON", flat([x.rec_id_s for x in got]))
    assert [x.relation for x in got] == want.tolist() and set(want.tolist()) == {0, 1, 2, 3, 6, 7}


def test_other_shapes_are_not_sure(spark):
    from quadrille.functions import geometry as g

    big = 2.0**24
    rings = [[(0, 0), (0, 4), (4, 0), (4, 4)], [(0, 0), (0, 4), (1, 1), (4, 0)], [(0, 0), (0, 4), (4, 4.5), (4, 0)], [(0, 0), (0, 0), (4, 4), (4, 0)], [(0, 0), (2, 2), (4, 4)],
             [(0, 0), (0, 4), (2, 5), (4, 4), (4, 0)], [(0, 0), (0, big + 2), (4, 0)], [(0, 0), (0, float("nan")), (4, 0)], [(0, 0), (0, float("inf")), (4, 0)]]
    rows = [(i, [(float(x), float(y)) for x, y in [*r, r[0]]]) for i, r in enumerate(rings)] + [(90, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]), (91, [(0.0, 0.0), (None, 4.0), (4.0, 0.0), (0.0, 0.0)])]
    assert not g.convex(spark.createDataFrame(rows, f"id int, pts {g.PTS}"), False).where("sure").count()
    lines = [(0, [(1.0, 1.0), (1.0, 1.0)]), (1, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]), (2, [(0.0, 0.5), (1.0, 1.0)]), (3, [(0.0, 0.0), (None, 1.0)])]
    assert not g.convex(spark.createDataFrame(lines, f"id int, pts {g.PTS}"), True).where("sure").count()
    assert g.convex(spark.createDataFrame([(0, [(0.0, 0.0), (0.0, big), (4.0, 0.0), (0.0, 0.0)])], f"id int, pts {g.PTS}"), False).where("sure").count() == 1


@pytest.mark.parametrize("name", ["line_polygon_inside_join", "line_polygon_intersect_join", "line_box_disjoint_join", "polygon_box_intersect_join", "diamond_meet_join", "diamond_covers_join", "diamond_find_relation_count"])
def test_pairs_of_small_convex_shapes_go_through_no_python(spark, name):
    from quadrille.plans.catalogue import QUERIES

    assert "ArrowEvalPython" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["inside", "intersect", "meet"])
def test_one_other_shape_leaves_the_join_whole(spark, name):
    """A set with a shape that is not told in columns, or a row without a box, gives the pairs of its other rows as before, and that shape's."""
    from quadrille.operators import joins

    shapes = _convex_shapes(random.Random(5), 60)
    make = lambda rows, kind: source.from_vertices(spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>"), F.col("id"), kind, F.col("p"))
    lines, rings = make([(i, q) for i, _, q in shapes], "LINESTRING"), [(i, p) for i, p, _ in shapes]
    pairs = lambda extra: {tuple(x) for x in joins.predicate_join(lines, make(rings + extra, "POLYGON"), name).collect()}
    odd = (99, [(-20.0, -20.0), (-20.0, 20.5), (20.0, 20.0), (20.0, -20.0), (-20.0, -20.0)])
    alone, mixed = pairs([]), pairs([odd])
    assert alone and {x for x in mixed if x[1] != 99} == alone
    assert {x[0] for x in mixed if x[1] == 99} == (set() if name == "meet" else set(range(60)))
    assert pairs([(98, [(None, None)] * 5)]) == alone
