"""Predicate, find-relation and distance joins.

Both sides are dealt to grid cells and joined on the cell; a pair is kept in the one cell that holds the lower left corner
of what their boxes share, so that nothing needs a distinct. Boxes are decided in closed form, other shapes by the exact
kernel, which sees only pairs whose boxes overlap. Sets that are held by cell on the same grid are joined where they lie.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions.kernels import distance_column, predicate_column, relation_column
from quadrille.operators.april import by_cell, with_intervals
from quadrille.plans.grid import Grid, grid_for
from quadrille.sources.geometry import BOX, Geometries
from quadrille.types import DataType, InvalidParameter, PREDICATES, Relation, UnsupportedFeature, query_type

#: Sets of so many rows or fewer are dealt to a fixed number of tasks, as the engine would give them to one or two; larger ones
#: are left to it, which also splits a cell of very many rows.
FEW_ROWS = 500_000
#: Unless the session's shuffle partitions would hold more than so many of them each: a task's sorting then grows with the input.
ROWS_A_TASK = 500_000


def _named(name):
    kind = query_type(name) if isinstance(name, str) else name
    if kind not in PREDICATES:
        raise InvalidParameter(f"{name!r} is no join predicate")
    return PREDICATES[kind]


def _corners(x: Geometries, grid: Grid, suffix: str) -> DataFrame:
    """x by cell, with its corners; of a grid whose shapes are sure."""
    columns = ["rec_id", *BOX, *g.corner_columns(x.kind == DataType.LINESTRING)]
    df = grid.exploded(g.convex(x.df.select("rec_id", *BOX, "pts"), x.kind == DataType.LINESTRING).select(*columns))
    return df.select("cell", "ix", "iy", "level", *[F.col(c).alias(f"{c}_{suffix}") for c in (*columns, "ix0", "iy0", "own")])


def _side(x: Geometries, grid: Grid, suffix: str, shape: bool, margin: float = 0.0, april: bool = False) -> DataFrame:
    """x by cell; shape: with its coordinates as a flat array."""
    columns = ["rec_id", *BOX, *(["pts"] if shape else []), *(["april"] if april else []), *[c for c in ("edges",) if c in x.df.columns]]
    if x.cells is not None and x.grid == grid and not margin and set(columns) <= set(x.cells.columns):
        df = x.cells
    else:
        df = grid.exploded(x.df.select(*columns), margin)
    values = {c: F.col(c) for c in (*columns, "ix0", "iy0", "own")}
    if shape:
        values["flat"] = g.flat(values.pop("pts"))
    if april:
        values["april"] = F.struct("april.all_b", "april.full_b")
    return df.select("cell", "ix", "iy", "level", *[v.alias(f"{c}_{suffix}") for c, v in values.items()])


def _grid(r: Geometries, s: Geometries, n: int | None, shapes: bool = False) -> Grid:
    """The grid on which both are held already, else one for their bounds and sizes."""
    if r.grid is not None and r.grid == s.grid and (n is None or n == r.grid.n == r.grid.ny):
        return r.grid
    return grid_for(r, s, n=n, shapes=shapes)


def _boxes():
    return ({c: F.col(f"{c}_r") for c in BOX}, {c: F.col(f"{c}_s") for c in BOX})


def _tasks(r: Geometries, s: Geometries, grid: Grid) -> int | None:
    """Tasks that sets of few rows, or of very many for the session's partitions, are dealt to; None: left to the engine."""
    if r.grid or s.grid:
        return None
    session = r.df.sparkSession
    if grid.rows <= FEW_ROWS:
        return session.sparkContext.defaultParallelism * 2
    least = -(-grid.rows // ROWS_A_TASK)
    return least if least > int(session.conf.get("spark.sql.shuffle.partitions")) else None


def mbr_pairs(r: Geometries, s: Geometries, n: int | None = None, grid: Grid | None = None, shape: bool = True, prefilter=None, margin: float = 0.0, corners: bool = False) -> DataFrame:
    """Pairs whose boxes overlap (touching included), each once: rec_id_r, rec_id_s and what the predicates need.

    margin: r's boxes are widened by it. corners: shapes come as corners, of a grid whose shapes are sure.
    """
    grid = grid or _grid(r, s, n)
    # Sides of the same columns: a set that meets itself is dealt once.
    sides = (_corners(r, grid, "r"), _corners(s, grid, "s")) if corners else (_side(r, grid, "r", shape, margin), _side(s, grid, "s", shape))
    a, b = (x.drop("ix", "iy", "level") for x in sides)
    if tasks := _tasks(r, s, grid):
        a, b = a.repartition(tasks, "cell"), b.repartition(tasks, "cell")
    # Never by broadcast: a side is judged by the few columns of its file, and dealt shapes are a hundred times their size.
    b = b.hint("merge")
    br, bs = _boxes()
    wide = {c: br[c] - margin if c.endswith("min") else br[c] + margin for c in BOX} if margin else br
    pairs = a.join(b, "cell").where(g.overlap(wide, bs) & (F.col("cell") == grid.kept_in("_r", "_s")))
    return pairs.where(prefilter(br, bs)) if prefilter else pairs


def _closed_form(r: Geometries, s: Geometries) -> bool:
    return r.kind == s.kind == DataType.BOX


_PREFILTERS = {
    "inside": lambda r, s: g.within(r, s), "covered_by": lambda r, s: g.within(r, s),
    "contains": lambda r, s: g.within(s, r), "covers": lambda r, s: g.within(s, r),
    "equal": lambda r, s: g.mbr_case(r, s) == "EQUAL",
}


def _with_april(r: Geometries, s: Geometries, grid: Grid, order: int) -> tuple[Geometries, Geometries]:
    """Both with intervals of the order over the same bounds; those that they have already are used if they fit."""
    if not 1 <= order <= 16:
        raise InvalidParameter("an order is from 1 to 16")
    bounds = r.april[1] if r.april and r.april == s.april and r.april[0] == order else grid.bounds
    made = [x if x.april == (order, bounds) else intervals(x, order, bounds, False) for x in ((r,) if r is s else (r, s))]
    return made[0], made[-1]  # a set that meets itself is rastered once


def intervals(x: Geometries, order: int, bounds, lists: bool = True) -> Geometries:
    """x with raster intervals of the order over the bounds, which hold x. lists: as in with_intervals."""
    return replace(x, df=with_intervals(x.df.drop("april"), bounds, order, lists), april=(order, bounds), cells=None, grid=None)


def _shapes(r: Geometries, s: Geometries) -> list:
    return [r.kind.value, F.col("flat_r"), s.kind.value, F.col("flat_s")]


def predicate_join(r: Geometries, s: Geometries, predicate, n: int | None = None, scope: str = "candidates", april_order: int | None = None) -> DataFrame:
    """id_r, id_s of pairs for which the predicate holds. predicate: intersect, inside, disjoint, equal, meet, contains, covers, covered_by.

    disjoint is asked of pairs whose boxes overlap; with scope "all", of all pairs, and the result is quadratic (disjoint_count()
    counts it without). april_order: also
    filter by raster intervals of this order before the exact test; results are the same.
    """
    name = _named(predicate)
    if name == "disjoint" and scope == "all":
        near = predicate_join(r, s, "intersect", n, april_order=april_order)
        every = r.df.select(F.col("rec_id").alias("id_r")).crossJoin(s.df.select(F.col("rec_id").alias("id_s")))
        return every.join(near, ["id_r", "id_s"], "left_anti")
    if scope not in ("candidates", "all"):
        raise InvalidParameter(f"scope {scope!r}")
    br, bs = _boxes()
    if _closed_form(r, s):
        pairs = mbr_pairs(r, s, n, shape=False).where(g.box_predicate(name, br, bs))
    else:
        kinds = {r.kind, s.kind}
        grid = _grid(r, s, n, shapes=not april_order and DataType.POINT not in kinds and kinds != {DataType.LINESTRING})
        if april_order:
            r, s = _with_april(r, s, grid, april_order)
            found = by_cell(_side(r, grid, "r", True, april=True), _side(s, grid, "s", True, april=True), _tasks(r, s, grid), name, r.kind.value, s.kind.value, april_order)
            return found.select("id_r", "id_s")
        if points := kinds == {DataType.POINT, DataType.POLYGON} and name in ("intersect", "inside", "contains"):
            r, s = (replace(x, df=g.computed(x.df, edges=g.edges(F.col("pts")))) if x.kind == DataType.POLYGON else x for x in (r, s))
        pairs = mbr_pairs(r, s, grid=grid, shape=not points, prefilter=_PREFILTERS.get(name), corners=grid.sure)
        if grid.sure:
            pairs = pairs.where(g.convex_predicate(name, r.kind == DataType.LINESTRING, s.kind == DataType.LINESTRING))
        elif points:
            p, q = ("r", "s") if r.kind == DataType.POINT else ("s", "r")
            test = g.point_meets_ring if name == "intersect" else g.point_inside_ring
            possible = name == "intersect" or (name == "inside") == (p == "r")
            pairs = pairs.where(test(F.col(f"xmin_{p}"), F.col(f"ymin_{p}"), F.col(f"edges_{q}")) if possible else F.lit(False))
        else:
            pairs = pairs.where(predicate_column(name, *_shapes(r, s)))
    return pairs.select(F.col("rec_id_r").alias("id_r"), F.col("rec_id_s").alias("id_s"))


def disjoint_count(r: Geometries, s: Geometries, n: int | None = None, april_order: int | None = None) -> DataFrame:
    """n: pairs of all rows that share no point, as all pairs less those that do; no pair is made that shares none."""
    both = r.df.agg(F.count(F.lit(1)).alias("a")).crossJoin(s.df.agg(F.count(F.lit(1)).alias("b")))  # a row each
    meet = predicate_join(r, s, "intersect", n, april_order=april_order).agg(F.count(F.lit(1)).alias("c"))
    return both.crossJoin(meet).select((F.col("a") * F.col("b") - F.col("c")).alias("n"))


def find_relation(r: Geometries, s: Geometries, n: int | None = None, april_order: int | None = None) -> DataFrame:
    """relation (code), id_r, id_s for each pair whose boxes overlap. april_order: as in predicate_join."""
    br, bs = _boxes()
    if _closed_form(r, s):
        pairs = mbr_pairs(r, s, n, shape=False).withColumn("relation", g.box_relation(br, bs))
    else:
        grid = _grid(r, s, n, shapes=not april_order and {r.kind, s.kind} <= {DataType.POLYGON, DataType.BOX})
        if april_order:
            r, s = _with_april(r, s, grid, april_order)
            return by_cell(_side(r, grid, "r", True, april=True), _side(s, grid, "s", True, april=True), _tasks(r, s, grid), None, r.kind.value, s.kind.value, april_order)
        pairs = mbr_pairs(r, s, grid=grid, corners=grid.sure)
        pairs = g.convex_relations(pairs) if grid.sure else pairs.withColumn("relation", relation_column(*_shapes(r, s)))
    return pairs.select(F.col("relation").cast("int").alias("relation"), F.col("rec_id_r").alias("id_r"), F.col("rec_id_s").alias("id_s"))


def relation_counts(relations: DataFrame) -> DataFrame:
    """relation, n for all eight codes, zeros too."""
    codes = relations.sparkSession.range(len(Relation)).select(F.col("id").cast("int").alias("relation"))
    found = relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return codes.join(found, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n"))


def distance_join(r: Geometries, s: Geometries, d: float, n: int | None = None) -> DataFrame:
    """id_r, id_s of points at most d apart (planar). R is dealt to all cells within d, S to its own, so a pair meets once."""
    if not d > 0:
        raise InvalidParameter("a distance is above 0")
    if r.kind != DataType.POINT or s.kind != DataType.POINT:
        raise UnsupportedFeature("distance joins are of points; shape_distances() takes others")
    grid = grid_for(r, s, n=n)
    b = grid.bounds
    grid = Grid(b, grid.n, grid.ny)
    if n is None:  # cells not under d
        grid = Grid(b, max(1, min(grid.n, int((b.xmax - b.xmin) / d))), max(1, min(grid.ny, int((b.ymax - b.ymin) / d))))
    a = grid.exploded(r.df.select("rec_id", *BOX), d).select("cell", F.col("rec_id").alias("id_r"), F.col("xmin").alias("xr"), F.col("ymin").alias("yr"))
    c = s.df.select(grid.cell(grid.index(F.col("xmin"), "x"), grid.index(F.col("ymin"), "y")).alias("cell"), F.col("rec_id").alias("id_s"), F.col("xmin").alias("xs"), F.col("ymin").alias("ys"))
    dx, dy = F.col("xr") - F.col("xs"), F.col("yr") - F.col("ys")
    return a.join(c, "cell").where(dx * dx + dy * dy <= d * d).select("id_r", "id_s")


def shape_distances(r: Geometries, s: Geometries, d: float, n: int | None = None) -> DataFrame:
    """id_r, id_s, dist of geometries of any type at most d apart; 0 if they share a point. Boxes and points are measured in closed form."""
    if not d > 0:
        raise InvalidParameter("a distance is above 0")
    br, bs = _boxes()
    flat = {r.kind, s.kind} <= {DataType.POINT, DataType.BOX}
    grid = grid_for(r, s, n=n)
    pairs = mbr_pairs(r, s, grid=grid, shape=not flat, margin=d).where(g.box_distance(br, bs) <= d)
    found = pairs.withColumn("dist", g.box_distance(br, bs) if flat else distance_column(*_shapes(r, s)))
    return found.where(F.col("dist") <= d).select(F.col("rec_id_r").alias("id_r"), F.col("rec_id_s").alias("id_s"), "dist")
