"""The uniform grid over which joins are dealt, and its two-layer classes.

Boxes far larger than a cell would touch very many. Where there are such, the grid has levels: at level v, 2 ** v by 2 ** v cells
are one. A box is dealt at the first level where it is at most FEW_CELLS cells wide and high, its own, and at every coarser one,
so that two boxes meet at the coarser of their own levels, and there only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import convex
from quadrille.sources.geometry import BOX, Geometries
from quadrille.types import Bounds, DataType, InvalidParameter

ROWS_A_CELL = 50
#: Cells a side at most; both sides together have no more cells than rows / ROWS_A_CELL.
MAX_CELLS_PER_DIM = 1 << 16
FEW_CELLS = 4
#: Steps between levels.
LEVEL_STEP = 2


@dataclass(frozen=True)
class Grid:
    """n cells from left to right, ny from bottom to top (n of them if not given), and its levels, rising from 0."""

    bounds: Bounds
    n: int
    ny: int | None = None
    levels: tuple[int, ...] = (0,)
    #: Rows of the sets that it was made for, as far as they were counted.
    rows: int = field(default=0, compare=False)
    #: All their shapes are sure in the sense of geometry.convex(), as far as that was asked.
    sure: bool = field(default=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "ny", self.n if self.ny is None else self.ny)
        if self.n < 1 or self.ny < 1:
            raise InvalidParameter("a grid has a cell at least")

    def index(self, v: Column, axis: str) -> Column:
        """Cell number along an axis; what lies outside belongs to the outermost cells."""
        lo, hi, n = (self.bounds.xmin, self.bounds.xmax, self.n) if axis == "x" else (self.bounds.ymin, self.bounds.ymax, self.ny)
        step = (hi - lo) / n
        if step <= 0:
            return F.lit(0)
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - lo) / step))).cast("int")

    def cell(self, ix: Column, iy: Column) -> Column:
        return ix.cast("long") + iy.cast("long") * self.n

    def sides(self) -> tuple[float, float]:
        return (self.bounds.xmax - self.bounds.xmin) / self.n, (self.bounds.ymax - self.bounds.ymin) / self.ny

    def _own(self, margin: float) -> Column:
        out = F.lit(self.levels[-1])
        (wx, wy), width, height = self.sides(), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
        for v in reversed(self.levels[:-1]):
            most = FEW_CELLS * (1 << v)
            out = F.when((width <= most * wx - 2 * margin) & (height <= most * wy - 2 * margin), F.lit(v)).otherwise(out)
        return out

    def exploded(self, df: DataFrame, margin: float = 0.0) -> DataFrame:
        """A row for each cell that a row's box, widened by margin, touches: ix, iy, ix0, iy0, level, own (level), cell added."""
        low = df.withColumns({"ix0": self.index(F.col("xmin") - margin, "x"), "iy0": self.index(F.col("ymin") - margin, "y"),
                              "ix1": self.index(F.col("xmax") + margin, "x"), "iy1": self.index(F.col("ymax") + margin, "y"), "own": self._own(margin)})
        if len(self.levels) > 1:
            every = F.array(*[F.lit(v) for v in self.levels])
            low = low.withColumn("level", F.explode(F.filter(every, lambda v: v >= F.col("own"))))
            low = low.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))).cast("int") for c in ("ix0", "iy0", "ix1", "iy1")})
        else:
            low = low.withColumn("level", F.lit(self.levels[0]))
        wide = low.withColumn("ix", F.explode(F.sequence("ix0", "ix1"))).withColumn("iy", F.explode(F.sequence("iy0", "iy1")))
        cell = self.cell(F.col("ix"), F.col("iy"))
        return wide.withColumn("cell", cell * 64 + F.col("level") if len(self.levels) > 1 else cell).drop("ix1", "iy1")

    def kept_in(self, a: str, b: str) -> Column:
        """meets_once() of two sides that carry their cell alone: the number of the one cell in which a pair is kept."""
        cell = self.cell(F.greatest(f"ix0{a}", f"ix0{b}"), F.greatest(f"iy0{a}", f"iy0{b}"))
        return cell * 64 + F.greatest(f"own{a}", f"own{b}") if len(self.levels) > 1 else cell


def meets_once(a: str, b: str) -> Column:
    """Whether ix, iy, level is the one cell in which a pair is kept; the columns ix0, iy0 and own of its two sides end in a and b."""
    return ((F.col("ix") == F.greatest(f"ix0{a}", f"ix0{b}")) & (F.col("iy") == F.greatest(f"iy0{a}", f"iy0{b}")) & (F.col("level") == F.greatest(f"own{a}", f"own{b}")))


def layer_class() -> Column:
    """A: the box begins in the cell; B: in its column, C: in its row; D: in neither."""
    column, row = F.col("ix") == F.col("ix0"), F.col("iy") == F.col("iy0")
    return F.when(column & row, "A").when(column, "B").when(row, "C").otherwise("D")


def _levels(largest: list[tuple[float, float]], sides: tuple[float, float]) -> tuple[int, ...]:
    """Levels such that boxes of the largest widths and heights touch few cells of the coarsest."""
    out = [0]
    while out[-1] < 16 and any(m > FEW_CELLS * (1 << out[-1]) * side > 0 for box in largest for m, side in zip(box, sides)):
        out.append(out[-1] + LEVEL_STEP)
    return tuple(out)


def grid_for(*sets: Geometries, n: int | None = None, bounds: Bounds | None = None, windows: DataFrame | None = None, shapes: bool = False) -> Grid:
    """A grid over the union of the sets' bounds. Without n: about ROWS_A_CELL rows a cell, cells not under twice the mean side
    of the rows' boxes, so that a plane far wider than high has more cells that way.

    Bounds that are given are used as they are; with n, nothing is read then. windows: other boxes that are to be dealt over it;
    cells are not under half their mean side either, or a plane of another aspect would have them touch very many, or need
    coarse levels where each meets far more rows than it overlaps. shapes: see also whether all shapes are sure.
    """
    known = [s.bounds for s in sets]
    if bounds is None and all(known):
        bounds = known[0]
        for b in known[1:]:
            bounds = bounds.union(b)
    if bounds is not None and n:
        return Grid(bounds, n)
    stats = None
    for s in sets:
        df, sure = s.df, F.lit(False)
        if shapes:  # of rows that have a box, as others meet nothing
            df, sure = convex(df.select(*BOX, "pts"), s.kind == DataType.LINESTRING), F.min(F.when(reduce(and_, [F.col(c).isNotNull() for c in BOX]), F.coalesce("sure", F.lit(False))))
        part = df.agg(sure.alias("sure"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n"),
                        F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.lit(0.0))).alias("w"), F.avg(F.col("ymax") - F.col("ymin")).alias("h"),
                        F.max(F.col("xmax") - F.col("xmin")).alias("most_w"), F.max(F.col("ymax") - F.col("ymin")).alias("most_h"))
        stats = part if stats is None else stats.unionByName(part)
    rows = [r for r in stats.collect() if r["n"]]  # a row a set
    if not rows:
        return Grid(bounds or Bounds(0, 0, 1, 1), n or 1)
    if bounds is None:
        bounds = Bounds(min(r["xmin"] for r in rows), min(r["ymin"] for r in rows), max(r["xmax"] for r in rows), max(r["ymax"] for r in rows))
    counted, sure = sum(r["n"] for r in rows), all(r["sure"] for r in rows)
    largest, sides = [(r["most_w"], r["most_h"]) for r in rows], [(r["w"], r["h"]) for r in rows]
    if windows is not None:
        width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
        w = windows.agg(F.max(width).alias("w"), F.max(height).alias("h"), F.avg(width).alias("mean_w"), F.avg(height).alias("mean_h")).head()
        if w["w"] is not None:
            largest.append((w["w"], w["h"]))
            sides.append((w["mean_w"] / 4, w["mean_h"] / 4))
    levelled = lambda g: replace(g, levels=_levels(largest, g.sides()))
    if n is not None:
        return levelled(Grid(bounds, n, rows=counted, sure=sure))
    cells = max(r["n"] for r in rows) / ROWS_A_CELL
    most_x = min([MAX_CELLS_PER_DIM, *[(bounds.xmax - bounds.xmin) / (2 * w) for w, _ in sides if w]])
    most_y = min([MAX_CELLS_PER_DIM, *[(bounds.ymax - bounds.ymin) / (2 * h) for _, h in sides if h]])
    ny = max(1.0, min(cells**0.5, most_y))
    nx = max(1.0, min(cells / ny, most_x))
    return levelled(Grid(bounds, int(nx), int(max(1.0, min(cells / nx, most_y))), rows=counted, sure=sure))
