"""Range and nearest-neighbour queries, single and in batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions.kernels import predicate_column
from quadrille.plans.grid import MAX_CELLS_PER_DIM, ROWS_A_CELL, Grid, grid_for, meets_once
from quadrille.sources.geometry import BOX, Geometries
from quadrille.types import Bounds, DataType, InvalidGeometry, InvalidParameter

#: Rows for each task of the exact tests, beyond the least number of tasks.
ROWS_A_TASK = 25_000
#: Windows up to this many are broadcast; more are dealt to grid cells like the data.
BROADCAST_WINDOWS = 16
#: Windows a stream's queries may have: they are broadcast to every batch (a few hundred bytes each).
MOST_STREAM_WINDOWS = 100_000
#: Neighbour queries start from counts of KNN_COARSEST ** 2 cells at most; KNN_FINEST: cells a side at most where a number is given.
KNN_COARSEST, KNN_FINEST = 8, 4096


def windows(queries: DataFrame) -> DataFrame:
    """qid, wtype, wpts and box of (qid, wkt) rows; POLYGON or BOX. A box's sides may be inverted."""
    w = g.computed(queries.select("qid", "wkt"), wtype=g.wkt_tag(F.col("wkt")), raw=g.wkt_points(F.col("wkt")))
    w = w.where(F.col("wtype").isin("POLYGON", "BOX") & F.col("raw").isNotNull())
    w = g.computed(w, **{f"w_{c}": v for c, v in g.mbr(F.col("raw")).items()}, ring=g.closed_ring(F.col("raw")))
    shape = F.when(F.col("wtype") == "POLYGON", g.clockwise(F.col("ring"))).otherwise(g.box_points(*[F.col(f"w_{c}") for c in BOX]))
    w = g.computed(w, wpts=shape).select("qid", "wtype", *[f"w_{c}" for c in BOX], "wpts")
    return g.computed(w, wedges=g.edges(F.col("wpts")))


def range_batch(data: Geometries, queries: DataFrame, n: int | None = None) -> DataFrame:
    """qid, rec_id of geometries that share a point with each window (qid, wkt). Windows that are none are left out.

    What boxes decide is decided with them; the kernel, in the same pass, gets only the rest, and nothing at all where the
    data are points, or boxes under windows that are boxes.
    """
    w = windows(queries)
    box = {c: F.col(f"w_{c}") for c in BOX}
    own = {c: F.col(c) for c in BOX}
    flat = data.kind in (DataType.POINT, DataType.BOX)
    rows = data.df.select("rec_id", *BOX, *([] if flat else ["pts"]))
    few = queries.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    rings = data.kind == DataType.BOX and not w.where("wtype <> 'BOX'").isEmpty()
    if few:
        pairs, tasks = rows.join(F.broadcast(w), g.overlap(own, box)), 0
    else:
        dealt = w.select(*w.columns, *[F.col(f"w_{c}").alias(c) for c in BOX])
        grid = grid_for(data, n=n, windows=dealt)
        a = grid.exploded(rows)
        b = grid.exploded(dealt).select("cell", *w.columns, *[F.col(c).alias(f"{c}_w") for c in ("ix0", "iy0", "own")])
        pairs, tasks = a.join(b.hint("merge"), "cell").where(g.overlap(own, box) & meets_once("", "_w")), grid.rows // ROWS_A_TASK
    boxes = F.col("wtype") == "BOX"
    if data.kind == DataType.POINT:
        pairs = pairs.where(boxes | g.point_meets_ring(F.col("xmin"), F.col("ymin"), F.col("wedges")))
    elif not flat or rings:
        if flat:
            pairs = pairs.withColumn("pts", g.box_points(*[F.col(c) for c in BOX]))
        known = F.when(boxes & (g.within(own, box) | F.lit(data.kind == DataType.BOX)), F.lit(True))
        pairs = pairs.withColumn("known", known).repartition(max(data.df.sparkSession.sparkContext.defaultParallelism * 2, tasks))
        pairs = pairs.where(predicate_column("intersect", data.kind.value, g.flat(F.col("pts")), "POLYGON", g.flat(F.col("wpts")), F.col("known")))
    return pairs.select("qid", "rec_id")


def count_by_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, n for each query, zeros too; n is null where the query's text is no window."""
    found = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    sound = g.wkt_tag(F.col("wkt")).isin("POLYGON", "BOX") & g.wkt_points(F.col("wkt")).isNotNull()
    return queries.select("qid", F.coalesce(sound, F.lit(False)).alias("sound_")).join(found, "qid", "left").select("qid", F.when(F.col("sound_"), F.coalesce("n", F.lit(0))).alias("n"))


def range_box(data: Geometries, window: Bounds) -> DataFrame:
    """rec_id in a closed box, by filters that reach the scan. Other shapes than points and boxes are tested exactly."""
    near = data.df.where((F.col("xmin") <= window.xmax) & (F.col("xmax") >= window.xmin) & (F.col("ymin") <= window.ymax) & (F.col("ymax") >= window.ymin))
    if data.kind in (DataType.POINT, DataType.BOX):
        return near.select("rec_id")
    wkt = f"BOX({window.xmin} {window.ymin},{window.xmax} {window.ymax})"
    return range_wkt(Geometries(near, data.kind), wkt)


def range_wkt(data: Geometries, wkt: str) -> DataFrame:
    """rec_id of geometries that share a point with one window; a filter on its box reaches the scan."""
    spark, corners = data.df.sparkSession, re.findall(rf"({g.NUMBER})\s+({g.NUMBER})", wkt)
    if not corners:
        raise InvalidGeometry(f"no window: {wkt[:60]!r}")
    x, y = ([float(c[i]) for c in corners] for i in (0, 1))
    near = data.df.where((F.col("xmin") <= max(x)) & (F.col("xmax") >= min(x)) & (F.col("ymin") <= max(y)) & (F.col("ymax") >= min(y)))
    return range_batch(Geometries(near, data.kind), one_query(spark, wkt)).select("rec_id")


def one_query(spark, wkt: str, qid: int = 0, **more) -> DataFrame:
    return spark.range(1).select(F.lit(qid).alias("qid"), F.lit(wkt).alias("wkt"), *[F.lit(v).alias(k) for k, v in more.items()])


def knn(data: Geometries, x: float, y: float, k: int) -> DataFrame:
    """rank, rec_id, dist of the k points nearest to (x, y); ties by rec_id. Each task keeps k rows."""
    if k <= 0:
        raise InvalidParameter("k is above 0")
    if data.kind != DataType.POINT:
        raise InvalidGeometry("neighbours are points")
    near = data.df.select("rec_id", g.distance(F.col("xmin"), F.col("ymin"), F.lit(float(x)), F.lit(float(y))).alias("dist")).orderBy("dist", "rec_id").limit(k)
    return near.select(F.row_number().over(Window.orderBy("dist", "rec_id")).alias("rank"), "rec_id", "dist")


def _power(v: float) -> int:
    """The power of two at or under v, 1 at least and KNN_FINEST at most a side."""
    side = 1
    while side * 2 <= min(KNN_FINEST, v):
        side *= 2
    return side


def knn_cells(b: Bounds, rows: int) -> tuple[int, int]:
    """Cells each way, powers of two, about as wide as high, with ROWS_A_CELL rows where rows are spread evenly."""
    width, height, cells = b.xmax - b.xmin, b.ymax - b.ymin, max(1, rows // ROWS_A_CELL)
    ratio = width / height if width > 0 and height > 0 else float(cells) if width > 0 else 1 / cells
    nx = 1
    while nx * 2 <= min(MAX_CELLS_PER_DIM, cells, (2 * cells * ratio) ** 0.5):  # the sides' ratio is within two of the plane's
        nx *= 2
    ny = 1
    while ny * 2 <= min(MAX_CELLS_PER_DIM, cells / nx):
        ny *= 2
    return nx, ny


def knn_batch(data: Geometries, queries: DataFrame, k: int | None = None, n: int | None = None) -> DataFrame:
    """qid, rank, rec_id, dist for (qid, x, y) queries (k: a column if not given); ties by rec_id.

    Points are counted in the cells of a grid that is as fine as their number asks for (or n cells a side), and the counts are
    added up to ever coarser grids. From the coarsest, each query gets a distance within which k points surely lie, keeps
    the cells that near, and goes on to their quarters on the next grid. It then meets only the points of its last cells.
    """
    k_ = F.lit(k) if k else F.col("k")
    q = queries.select("qid", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"), k_.alias("k"))
    made = grid_for(data, n=n)
    b = made.bounds
    grid = Grid(b, *([_power(n)] * 2 if n else knn_cells(b, made.rows)))
    eps = 1e-9 * max(1.0, abs(b.xmax), abs(b.xmin), abs(b.ymax), abs(b.ymin))
    points = data.df.select("rec_id", F.col("xmin").alias("px"), F.col("ymin").alias("py"), grid.index(F.col("xmin"), "x").alias("cx"), grid.index(F.col("ymin"), "y").alias("cy"))
    counts = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m"))  # a row for each ROWS_A_CELL points at most, unless n says otherwise

    def nearest(cells: DataFrame, by: int) -> DataFrame:
        """Of each query's cells of the grid with `by` by `by` cells for one, those that may hold one of its k points."""
        wx, wy = (b.xmax - b.xmin) / grid.n * min(by, grid.n), (b.ymax - b.ymin) / grid.ny * min(by, grid.ny)
        gaps, spans = [], []
        for v, c, lo, w in ((F.col("qx"), F.col("cx"), b.xmin, wx), (F.col("qy"), F.col("cy"), b.ymin, wy)):
            low = c * w + lo
            gaps.append(F.greatest(low - v, v - low - w, F.lit(0.0)))
            spans.append(F.greatest(F.abs(v - low), F.abs(v - low - w)))
        cells = cells.withColumns({"near": F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]) - eps, "far": F.sqrt(spans[0] * spans[0] + spans[1] * spans[1]) + eps})
        by_far = Window.partitionBy("qid").orderBy("far", "cx", "cy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.sum("m").over(by_far))
        enough = F.min(F.when(F.col("upto") >= F.col("k"), F.col("far"))).over(Window.partitionBy("qid"))
        cells = cells.withColumn("bound", enough).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
        return cells.select("qid", "qx", "qy", "k", "cx", "cy")

    def of_grid(by: int) -> DataFrame:
        return counts.groupBy(F.floor(F.col("cx") / by).cast("int").alias("cx"), F.floor(F.col("cy") / by).cast("int").alias("cy")).agg(F.sum("m").alias("m"))

    by = 1
    while max(1, grid.n // by) * max(1, grid.ny // by) > KNN_COARSEST**2:
        by *= 2
    nx = max(1, grid.n // by)
    every = F.explode(F.sequence(F.lit(0), F.lit(nx * max(1, grid.ny // by) - 1)))
    cells = q.withColumn("c", every).select(*q.columns, (F.col("c") % nx).alias("cx"), F.floor(F.col("c") / nx).cast("int").alias("cy"))
    cells = nearest(cells.join(F.broadcast(of_grid(by)), ["cx", "cy"]), by)  # 64 rows at most
    while by > 1:
        # A side that is one cell is not cut before the other has come to its size.
        cut = [(0, 1) if n >= by else (0,) for n in (grid.n, grid.ny)]
        by //= 2
        parts = F.explode(F.array(*[F.struct((len(cut[0]) * F.col("cx") + i).alias("x"), (len(cut[1]) * F.col("cy") + j).alias("y")) for i in cut[0] for j in cut[1]]))
        cells = cells.withColumn("c", parts).select("qid", "qx", "qy", "k", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
        cells = nearest(cells.join(of_grid(by), ["cx", "cy"]), by)
    pairs = points.join(cells.hint("merge"), ["cx", "cy"])
    dist = g.distance(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    ranked = pairs.select("qid", "rec_id", "k", dist.alias("dist")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "rec_id")))
    return ranked.where(F.col("rank") <= F.col("k")).select("qid", "rank", "rec_id", "dist")


def knn_queries(queries: DataFrame) -> DataFrame:
    """(qid, wkt, k) rows with POINT windows -> qid, x, y, k."""
    pts = g.wkt_points(F.col("wkt"))
    return queries.where(g.wkt_tag(F.col("wkt")) == "POINT").select("qid", pts[0]["x"].alias("x"), pts[0]["y"].alias("y"), "k")
