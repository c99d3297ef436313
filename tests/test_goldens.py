"""Seven queries over small samples whose answers are known, through the engine, with and without an index."""

import pytest

from quadrille.engine import SpatialEngine
from quadrille.sources import geometry as source
from quadrille.types import DistanceJoinQuery, KNNQuery, PredicateJoinQuery, QueryType, RangeQuery

# The samples, and the answers that they must give.
RINGS_R = """
    -87.10 45.10,-87.20 45.30,-87.20 45.40,-87.10 45.40,-87.09 45.00,-87.10 45.10;
    -87.30 45.20,-87.40 45.40,-87.40 45.50,-87.30 45.50,-87.29 45.10,-87.30 45.20;
    -87.50 45.30,-87.60 45.50,-87.60 45.60,-87.50 45.60,-87.49 45.20,-87.50 45.30;
    -87.70 45.40,-87.80 45.60,-87.80 45.70,-87.70 45.70,-87.69 45.30,-87.70 45.40;
    -87.90 45.50,-88.00 45.70,-88.00 45.80,-87.90 45.80,-87.89 45.40,-87.90 45.50;
    -98.10 56.10,-98.20 56.30,-98.20 56.40,-98.10 56.40,-98.09 56.00,-98.10 56.10;
    -98.30 56.20,-98.40 56.40,-98.40 56.50,-98.30 56.50,-98.29 56.10,-98.30 56.20;
    -98.50 56.30,-98.60 56.50,-98.60 56.60,-98.50 56.60,-98.49 56.20,-98.50 56.30;
    -98.70 56.40,-98.80 56.60,-98.80 56.70,-98.70 56.70,-98.69 56.30,-98.70 56.40;
    -98.90 56.50,-99.00 56.70,-99.00 56.80,-98.90 56.80,-98.89 56.40,-98.90 56.50;
    -113.10 69.10,-113.20 69.30,-113.20 69.40,-113.10 69.40,-113.09 69.00,-113.10 69.10;
    -113.30 69.20,-113.40 69.40,-113.40 69.50,-113.30 69.50,-113.29 69.10,-113.30 69.20;
    -113.50 69.30,-113.60 69.50,-113.60 69.60,-113.50 69.60,-113.49 69.20,-113.50 69.30;
    -113.70 69.40,-113.80 69.60,-113.80 69.70,-113.70 69.70,-113.69 69.30,-113.70 69.40;
    -113.90 69.50,-114.00 69.70,-114.00 69.80,-113.90 69.80,-113.89 69.40,-113.90 69.50;
    -87.10 56.10,-87.20 56.30,-87.20 56.40,-87.10 56.40,-87.09 56.00,-87.10 56.10;
    -87.30 56.20,-87.40 56.40,-87.40 56.50,-87.30 56.50,-87.29 56.10,-87.30 56.20;
    -87.50 56.30,-87.60 56.50,-87.60 56.60,-87.50 56.60,-87.49 56.20,-87.50 56.30;
    -87.70 56.40,-87.80 56.60,-87.80 56.70,-87.70 56.70,-87.69 56.30,-87.70 56.40;
    -87.90 56.50,-88.00 56.70,-88.00 56.80,-87.90 56.80,-87.89 56.40,-87.90 56.50;
"""
RINGS_S = """
    -100.10 64.95,-100.20 65.15,-100.20 65.25,-100.10 65.25,-100.09 64.85,-100.10 64.95;
    -100.30 65.05,-100.40 65.25,-100.40 65.35,-100.30 65.35,-100.29 64.95,-100.30 65.05;
    -100.50 65.15,-100.60 65.35,-100.60 65.45,-100.50 65.45,-100.49 65.05,-100.50 65.15;
    -100.70 65.25,-100.80 65.45,-100.80 65.55,-100.70 65.55,-100.69 65.15,-100.70 65.25;
    -100.90 65.35,-101.00 65.55,-101.00 65.65,-100.90 65.65,-100.89 65.25,-100.90 65.35;
    -99.90 64.95,-100.00 65.15,-100.00 65.25,-99.90 65.25,-99.89 64.85,-99.90 64.95;
    -99.70 65.05,-99.80 65.25,-99.80 65.35,-99.70 65.35,-99.69 64.95,-99.70 65.05;
    -99.50 65.15,-99.60 65.35,-99.60 65.45,-99.50 65.45,-99.49 65.05,-99.50 65.15;
    -99.30 65.25,-99.40 65.45,-99.40 65.55,-99.30 65.55,-99.29 65.15,-99.30 65.25;
    -99.10 65.35,-99.20 65.55,-99.20 65.65,-99.10 65.65,-99.09 65.25,-99.10 65.35;
    -86.10 45.10,-88.20 46.30,-88.20 46.40,-89.10 46.40,-87.09 45.00,-84.10 45.10,-86.10 45.10;
    -83.70 56.40,-88.80 56.60,-85.80 56.70,-85.70 56.70,-85.69 56.30,-85.70 56.40,-83.70 56.40;
"""
POINTS = """
    -86.702714 32.386219; -86.602099 32.403848; -86.794109 32.347793; -86.586593 32.382817; -86.765115 32.471389; -86.660017 32.411372;
    -86.607479 32.438987; -86.615213 32.519849; -86.799053 32.404037; -86.579422 32.458196; -86.736717 32.466833; -86.746894 32.515607;
    -86.743259 32.491680; -86.650982 32.414928; -86.640193 32.438516; -86.737223 32.473618; -86.831442 32.454367; -86.675471 32.399038;
    -86.746901 32.467478; -86.900600 32.539156; -86.899697 32.535407; -86.898458 32.534869; -86.694355 32.496031; -86.903029 32.584076;
    -86.899023 32.549284; -86.866080 32.571624; -86.705385 32.686435; -86.713657 32.702115; -86.651411 32.583633; -86.640049 32.700300;
    -86.693715 32.669871; -86.913219 32.663643; -86.915385 32.660698; -86.916387 32.660582; -86.915523 32.658191; -86.916066 32.658820;
    -86.915104 32.642351; -86.898015 32.571774; -86.896259 32.571321; -86.895092 32.561547; -86.894861 32.560390; -86.892810 32.558849;
    -86.898089 32.551762; -86.488515 32.675255; -86.456257 32.694540; -86.543287 32.650837; -86.496033 32.705745; -86.472014 32.695034;
    -86.515597 32.674526; -86.447821 32.666621; -86.495084 32.666341; -86.431645 32.604756; -86.607979 32.635226; -86.440439 32.707180;
    -86.468632 32.697417; -86.568036 32.584577; -86.569488 32.584107; -86.489926 32.617279; -86.460170 32.698970; -86.488867 32.594731;
    -86.505285 32.599370; -86.501225 32.531787; -86.485780 32.404657; -86.542920 32.392613; -86.541148 32.388136; -86.541010 32.504859;
    -86.445784 32.584659; -86.569219 32.396834; -86.514963 32.549767; -86.560860 32.423362; -86.512946 32.549607; -86.516235 32.421833;
    -86.530729 32.386051; -86.548398 32.503918; -86.525874 32.444780; -86.444549 32.415957; -86.415978 32.478197; -86.513264 32.531819;
    -86.464767 32.449147; -86.465014 32.448816; -86.421380 32.422731; -86.569951 32.502960; -86.490289 32.447144; -86.464837 32.445138;
    -86.422874 32.432365; -86.680108 32.360285; -86.829943 32.392278; -86.590331 32.372467; -86.831939 32.439712; -86.892866 32.538286;
    -86.683971 32.389865; -86.614467 32.515567; -86.795758 32.397116; -86.802952 32.391223; -86.792288 32.358804; -86.786958 32.411640;
    -86.669800 32.425631; -86.784149 32.334826; -86.801655 32.517417; -86.699531 32.423562;
"""
LINES = """
    -86.439281 32.501317,-86.439301 32.501745,-86.439299 32.502015,-86.439297 32.502454,-86.439289 32.502764,-86.439295 32.502896,-86.43929 32.502986;
    -86.609955 32.703682,-86.609836 32.703659;
    -86.43929 32.502986,-86.439287 32.503045;
    -86.701507 32.522143,-86.701533 32.522317,-86.701606 32.522804,-86.701625 32.523021,-86.701629 32.523238,-86.701623 32.523381,-86.701598 32.523592,-86.701546 32.523833;
"""
NEAR = ['POINT (-102.362 45.6497)', 'POINT (-82.1597 39.0117)']
WINDOWS = ['POLYGON ((-102.509000 45.563400,-102.215000 45.563400,-102.215000 45.735900,-102.509000 45.735900,-102.509000 45.563400))', 'POLYGON ((-86.746881 32.515601,-86.746899 32.515601,-86.746899 32.515631,-86.746881 32.515631,-86.746881 32.515601))']
RELATIONS = {0: 0, 1: 4, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
PAIRS = [(0, 10), (1, 10), (2, 10), (3, 10), (4, 10)]
NEIGHBOURS = {0: [33, 31], 1: [53, 58]}
DISTANCES = {0: [20.18128, 20.18174], 1: [7.62048, 7.63836]}
WITHIN = [(44, 1), (47, 1), (53, 1), (54, 1), (58, 1)]


def parts(text):
    return [x.strip() for x in text.split(";") if x.strip()]


@pytest.fixture(scope="module", params=["plain", "indexed", "intervals"])
def engine(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("samples")
    files = {"r": [f"POLYGON (({x}))" for x in parts(RINGS_R)], "s": [f"POLYGON (({x}))" for x in parts(RINGS_S)], "p": [f"POINT ({x})" for x in parts(POINTS)],
             "l": [f"LINESTRING ({x})" for x in parts(LINES)], "near": NEAR, "windows": WINDOWS}
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines))
    e = SpatialEngine(spark, april_order=9 if request.param == "intervals" else None)
    kinds = {"r": "POLYGON", "s": "POLYGON", "p": "POINT", "l": "LINESTRING", "near": "POINT"}
    assert [e.prepare_dataset(str(folder / n), "WKT", k) for n, k in kinds.items()] == [0, 1, 2, 3, 4]
    if request.param != "plain":
        e.build_index([0, 1, 3])
        e.build_index([2, 4], "UNIFORM_GRID")
    e.folder, e.param = folder, request.param
    yield e
    e.finalize()


def pairs(df):
    return sorted((r.id_r, r.id_s) for r in df.collect())


def test_relations(engine):
    found = engine.query(PredicateJoinQuery(1, "COUNT", 0, 1, QueryType.FIND_RELATION))
    assert {r.relation: r.n for r in found.collect()} == RELATIONS
    each = engine.query(PredicateJoinQuery(1, "COLLECT", 0, 1, QueryType.FIND_RELATION)).collect()
    assert sorted((r.relation, r.id_r, r.id_s) for r in each) == [(1, k, 10) for k in range(1, 5)] + [(2, 0, 10)]


def test_intersections(engine):
    assert pairs(engine.query(PredicateJoinQuery(1, "COLLECT", 0, 1, QueryType.INTERSECTION))) == PAIRS
    assert pairs(engine.query(PredicateJoinQuery(1, "COLLECT", 0, 3, QueryType.INTERSECTION))) == []
    assert engine.dataset(3).df.count() == len(parts(LINES))


def test_neighbours(engine):
    got = engine.query_batch(engine.load_knn_queries(str(engine.folder / "near"), 2), QueryType.KNN, 2).collect()
    for q in (0, 1):
        mine = sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])
        assert [r.rec_id for r in mine] == NEIGHBOURS[q] and [r.dist for r in mine] == pytest.approx(DISTANCES[q], abs=1e-4)
    one = engine.query(KNNQuery(1, dataset=2, wkt=NEAR[1], k=2)).collect()
    assert [r.rec_id for r in sorted(one, key=lambda r: r["rank"])] == NEIGHBOURS[1]


def test_ranges(engine):
    windows = engine.load_range_queries(str(engine.folder / "windows"))
    assert sorted(map(tuple, engine.query_batch(windows, QueryType.RANGE, 2).collect())) == [(0, 0), (1, 1)]
    assert [r.rec_id for r in engine.query(RangeQuery(1, "COLLECT", 2, WINDOWS[1])).collect()] == [11]
    assert engine.query_batch(windows, QueryType.RANGE, 1, "COLLECT").collect() == []


def test_distances(engine):
    assert pairs(engine.query(DistanceJoinQuery(1, "COLLECT", 2, 4, 7.65))) == WITHIN


def test_an_index_spares_the_shuffle(engine):
    plan = engine.query(PredicateJoinQuery(1, "COLLECT", 0, 1, QueryType.INTERSECTION))._jdf.queryExecution().optimizedPlan().toString()
    assert ("InMemoryRelation" in plan) == (engine.param != "plain")


def test_intervals_are_saved_with_a_dataset(engine, tmp_path):
    if engine.param != "intervals":
        pytest.skip("no intervals")
    engine.save(0, str(tmp_path / "r"))
    again = source.load(engine.spark, str(tmp_path / "r"), "POLYGON")
    assert again.april == engine.dataset(0).april and again.april[0] == 9
    column = lambda df: sorted(df.select("rec_id", "april.all_", "april.full_").collect())
    assert column(again.df) == column(engine.dataset(0).df)
    assert [pairs(engine.query(PredicateJoinQuery(1, "COLLECT", n, 1, QueryType.INTERSECTION))) for n in [engine.add(again)]] == [PAIRS]
    engine.unload_dataset(5)
