"""Raster intervals: which cells of a fine raster a shape touches (all) and which it fills (full), along a Hilbert curve.

Only an accelerator: two shapes whose `all` lists do not meet share no point; where one's `all` list meets the
other's `full` list they do.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quadrille.functions import geometry as g
from quadrille.functions.kernels import EQUAL_BOXES, OTHER_BOXES, R_IN_S_BOX, S_IN_R_BOX, _lists, box_case, decide_predicate, decide_relation, laid_flat
from quadrille.sources.geometry import BOX
from quadrille.types import Bounds

#: Intervals of a batch of shapes, beyond which it is passed on.
MOST_HELD = 1 << 18
#: Cells of the raster that shapes rastered together take; one shape may take more.
MOST_CELLS = 1 << 19
INTERVALS = "array<struct<s:bigint,e:bigint>>"


def hilbert(order: int, x, y):
    """Place on the Hilbert curve of 2**order cells a side; x and y are arrays of integers."""
    x, y = np.array(x, np.int64), np.array(y, np.int64)
    d, s = np.zeros_like(x), 1 << (order - 1)
    while s:
        rx, ry = ((x & s) > 0).astype(np.int64), ((y & s) > 0).astype(np.int64)
        d += s * s * ((3 * rx) ^ ry)
        turn = ry == 0
        flip = turn & (rx == 1)
        x, y = np.where(flip, s - 1 - (x & (s - 1)), x & (s - 1)), np.where(flip, s - 1 - (y & (s - 1)), y & (s - 1))
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        s >>= 1
    return d


#: Orders up to which a worker keeps the places of all cells (4 MB at most).
MOST_TABLE_ORDER = 10


@lru_cache(1)
def _table(order: int) -> np.ndarray:
    every = np.arange(1 << (2 * order))
    return hilbert(order, every >> order, every & ((1 << order) - 1)).astype(np.int32)


def _places(order: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _table(order)[x << order | y].astype(np.int64) if order <= MOST_TABLE_ORDER else hilbert(order, x, y)


def hilbert_column(order: int, x: Column, y: Column) -> Column:
    """The same as an expression over integer columns."""
    x, y, d = x.cast("long"), y.cast("long"), F.lit(0).cast("long")
    state = F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(st, k):
        s = F.lit(1).cast("long") * F.pow(F.lit(2), k).cast("long")
        mask = s - 1
        rx, ry = F.when(st["x"].bitwiseAND(s) > 0, 1).otherwise(0), F.when(st["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        lx, ly = st["x"].bitwiseAND(mask), st["y"].bitwiseAND(mask)
        fx, fy = F.when(rx == 1, mask - lx).otherwise(lx), F.when(rx == 1, mask - ly).otherwise(ly)
        return F.struct(F.when(ry == 0, fy).otherwise(lx).alias("x"), F.when(ry == 0, fx).otherwise(ly).alias("y"),
                        (st["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), state, step)["d"]


def raster(kind: str, flat_pts: np.ndarray, bounds: Bounds, order: int) -> tuple[list[dict], list[dict]]:
    """(all, full) intervals. `all` may hold a cell more at the outline, `full` never holds one that is not inside."""
    return tuple([{"s": int(a), "e": int(b)} for a, b in runs.T] for runs in raster_runs(kind, flat_pts, bounds, order))


def raster_runs(kind: str, flat_pts: np.ndarray, bounds: Bounds, order: int) -> tuple[np.ndarray, np.ndarray]:
    """raster() as rows of starts and ends."""
    every, full = rasters(kind, flat_pts[None], bounds, order)
    return every[0].T, full[0].T


def _placed(pts: np.ndarray, bounds: Bounds, order: int):
    """Coordinates of shapes of as many points, a row a shape, in cells of the raster; the lowest and highest cells they may touch."""
    side = 1 << order
    sx, sy = (side - 1) / max(bounds.xmax - bounds.xmin, 1e-300), (side - 1) / max(bounds.ymax - bounds.ymin, 1e-300)
    gx, gy = (pts[:, ::2] - bounds.xmin) * sx, (pts[:, 1::2] - bounds.ymin) * sy
    lo = np.maximum(np.floor([gx.min(axis=1), gy.min(axis=1)]).astype(int) - 1, 0)
    hi = np.minimum(np.floor([gx.max(axis=1), gy.max(axis=1)]).astype(int) + 1, side - 1)
    return gx, gy, lo, hi


def raster_cells(pts: np.ndarray, bounds: Bounds, order: int) -> np.ndarray:
    """Cells of the raster that each shape's box takes, as rasters() lays them out."""
    _, _, lo, hi = _placed(pts, bounds, order)
    return (hi[0] - lo[0] + 2) * (hi[1] - lo[1] + 1)


def rasters(kind: str, pts: np.ndarray, bounds: Bounds, order: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """raster() of shapes of as many points, a row of coordinates a shape: for all and for full, a row of start and end an interval, and
    where each shape's intervals begin."""
    gx, gy, lo, hi = _placed(pts, bounds, order)
    n, width = len(pts), hi[0] - lo[0] + 1
    sizes = (width + 1) * (hi[1] - lo[1] + 1)  # rows of cells one after the other, each with a place past its end
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    # Rows of cells that the edges cross, with the span of x in each, a little wider than exact.
    x0, y0, x1, y1 = (np.ascontiguousarray(v).ravel() for v in ((gx, gy, gx, gy) if gx.shape[1] == 1 else (gx[:, :-1], gy[:, :-1], gx[:, 1:], gy[:, 1:])))
    shape = np.repeat(np.arange(n), len(x0) // n)
    start = np.maximum((np.minimum(y0, y1) - 1e-6).astype(int), lo[1][shape])
    rows = np.maximum(np.minimum((np.maximum(y0, y1) + 1e-6).astype(int), hi[1][shape]) - start + 1, 0)
    row = np.arange(rows.sum()) + np.repeat(start - (np.cumsum(rows) - rows), rows)
    x0, y0, x1, y1, shape = (np.repeat(v, rows) for v in (x0, y0, x1, y1, shape))
    left, wide = lo[0][shape], width[shape]
    line = first[shape] + (row - lo[1][shape]) * (wide + 1)
    level = y0 == y1
    rise, run = np.where(level, 1.0, y1 - y0), x1 - x0
    xs = [np.where(level, x, x0 + np.clip((v - y0) / rise, 0, 1) * run) for x, v in ((x0, row - 1e-6), (x1, row + 1 + 1e-6))]
    a = np.maximum(np.maximum(np.minimum(*xs) - 1e-6, 0).astype(int) - left, 0)
    b = np.minimum((np.maximum(*xs) + 1e-6).astype(int) - left + 1, wide)
    some = np.cumsum(np.bincount(line + a, minlength=total) - np.bincount(line + b, minlength=total)) > 0
    edge = some
    if kind in ("POLYGON", "BOX"):
        middle = row + 0.5
        across = ~level & ((y0 > middle) != (y1 > middle))
        line, left, wide = line[across], left[across], wide[across]
        x = x0[across] + (middle[across] - y0[across]) / rise[across] * run[across]
        past = np.clip(np.ceil(x - 0.5).astype(int) - left, 0, wide)  # cells whose middle is left of x
        odd = np.cumsum(np.bincount(line, minlength=total) - np.bincount(line + past, minlength=total)) & 1 > 0
        some = edge | odd
    at = np.flatnonzero(some)
    shape = np.searchsorted(first, at, side="right") - 1
    row, column = np.divmod(at - first[shape], width[shape] + 1)
    keys = shape << (2 * order + 1) | _places(order, column + lo[0][shape], row + lo[1][shape])
    return _runs(keys, n, order), _runs(keys[~edge[at]], n, order)


def _runs(keys: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places of n shapes, whose numbers stand before the places: start and end of each, and where each shape's begin."""
    if not len(keys):
        return np.zeros((0, 2), np.int64), np.zeros(n + 1, np.int64)
    keys = np.sort(keys)
    cut = np.flatnonzero(np.diff(keys) > 1)
    start, end = keys[np.concatenate([[0], cut + 1])], keys[np.concatenate([cut, [len(keys) - 1]])] + 1
    shape = start >> (2 * order + 1)
    before = shape << (2 * order + 1)
    return np.stack([start - before, end - before], axis=1), np.concatenate([[0], np.cumsum(np.bincount(shape, minlength=n))])


def _bytes_of(order: int) -> str:
    """Starts and ends of an order's intervals as little-endian integers."""
    return "<u4" if order < 16 else "<i8"


def _intervals_type() -> pa.DataType:
    item = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    return pa.struct([("all_", item), ("full_", item), ("all_b", pa.binary()), ("full_b", pa.binary())])


def _as_lists(runs: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(runs, axis=1) if runs else np.zeros((2, 0), np.int64)
    offsets = np.concatenate([[0], np.cumsum([r.shape[1] for r in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], names=["s", "e"]))


def _rastered(kinds: list[str], flat: list[np.ndarray], bounds: Bounds, order: int):
    """(all, full) intervals of each shape in turn, a row of start and end an interval; shapes alike in type and size are rastered together."""
    alike: dict = {}
    for i, (kind, pts) in enumerate(zip(kinds, flat)):
        alike.setdefault((kind, len(pts)), []).append(i)
    cells = np.zeros(len(flat), np.int64)
    for members in alike.values():
        cells[members] = raster_cells(np.array([flat[i] for i in members]), bounds, order)
    part = (np.cumsum(cells) - cells) // MOST_CELLS
    for at in np.split(np.arange(len(flat)), np.flatnonzero(np.diff(part)) + 1):
        found = [None] * len(at)
        for (kind, _), members in alike.items():
            some = members[bisect_left(members, at[0]) : bisect_right(members, at[-1])]
            if some:
                (every, at_every), (full, at_full) = rasters(kind, np.array([flat[i] for i in some]), bounds, order)
                for k, i in enumerate(some):
                    found[i - at[0]] = every[at_every[k] : at_every[k + 1]], full[at_full[k] : at_full[k + 1]]
        yield from found


def interval_batches(batches, bounds: Bounds, order: int, lists: bool = True):
    """Arrow batches with april added, each of few enough intervals that it stays small whatever the shapes. lists: as lists too."""
    fields = list(_intervals_type())[0 if lists else 2 :]
    for batch in batches:
        flat, at, done, held = _lists(batch.column("flat_")), 0, [], 0
        kept = batch.drop_columns("flat_")
        for i, found in enumerate(_rastered(batch.column("gtype").to_pylist(), flat, bounds, order) if flat else (), 1):
            done.append(found)
            held += len(found[0]) + len(found[1])
            if held >= MOST_HELD or i == len(flat):
                made = [_as_lists([d[k].T for d in done]) for k in (0, 1)] if lists else []
                made += [pa.array([d[k].astype(_bytes_of(order)).tobytes() for d in done], pa.binary()) for k in (0, 1)]
                april = pa.StructArray.from_arrays(made, fields=fields)
                part = kept.slice(at, i - at)
                yield pa.RecordBatch.from_arrays([*part.columns, april], names=[*part.schema.names, "april"])
                at, done, held = i, [], 0


def with_intervals(df: DataFrame, bounds: Bounds, order: int, lists: bool = True) -> DataFrame:
    """Adds april, a struct of the two lists, and of both as bytes, in which joins compare them; without lists, of the bytes alone.

    Rows are dealt evenly first, as a shape costs far more to raster than to move.
    """
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)
    parts = (f"all_: {INTERVALS}, full_: {INTERVALS}, " if lists else "") + "all_b: binary, full_b: binary"
    schema = StructType([*df.schema.fields, StructField("april", _parse_datatype_string(parts))])
    return spread.withColumn("flat_", g.flat(F.col("pts"))).mapInArrow(lambda batches: interval_batches(batches, bounds, order, lists), schema)


# ---------------------------------------------------------------- joins, cell by cell

#: Pairs of a cell whose boxes are compared at once, and places of the curve that its intervals are laid over at once.
MOST_PAIRS, MOST_PLACES = 1 << 20, 4096


def _laid(lists: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every interval of lists as bytes."""
    flat = np.frombuffer(b"".join(lists), _bytes_of(order)).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(x) // (2 * np.dtype(_bytes_of(order)).itemsize) for x in lists])
    return rows, flat[::2], flat[1::2]


def _covered(laid, n: int, places: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row a list: 1 for each stretch between neighbouring places, from the first to the last, that one of its intervals covers."""
    rows, start, end = laid
    out = np.zeros((n, last - first + 1), np.float32)
    a, b = (np.clip(np.searchsorted(places, v) - first, 0, last - first) for v in (start, end))
    some = a < b
    np.add.at(out, (rows[some], a[some]), 1)
    np.add.at(out, (rows[some], b[some]), -1)
    return np.cumsum(out, axis=1)[:, :-1]


def shared(all_r: list[bytes], full_r: list[bytes], all_s: list[bytes], full_s: list[bytes], order: int) -> dict[str, np.ndarray]:
    """Stretches of the curve that lists of r and s share, for each r and s: aa (all with all), af, fa; and how many each has: ra, rf, sa, sf."""
    laid = {"ra": _laid(all_r, order), "rf": _laid(full_r, order), "sa": _laid(all_s, order), "sf": _laid(full_s, order)}
    places = np.unique(np.concatenate([v for x in laid.values() for v in x[1:]]))
    n, m = len(all_r), len(all_s)
    out = {k: np.zeros((n, m), np.float32) for k in ("aa", "af", "fa")} | {k: np.zeros(n if k[0] == "r" else m, np.float32) for k in laid}
    for first in range(0, len(places) - 1, MOST_PLACES):
        last = min(first + MOST_PLACES, len(places) - 1)
        on = {k: _covered(x, n if k[0] == "r" else m, places, first, last) for k, x in laid.items() if len(x[0])}
        for k in ("aa", "af", "fa"):
            if (a := f"r{k[0]}") in on and (b := f"s{k[1]}") in on:
                out[k] += on[a] @ on[b].T
        for k, x in on.items():
            out[k] += x.sum(axis=1)
    return out


def predicate_codes(name: str, x: dict[str, np.ndarray]) -> np.ndarray:
    """For each r and s 1, 0, or -1 where the intervals do not tell.

    A filled cell that the other does not touch lies outside of the other; a shape whose every touched cell is filled by the
    other lies in its interior.
    """
    miss, hit = x["aa"] == 0, (x["af"] > 0) | (x["fa"] > 0)
    r_deep, s_deep = x["af"] == x["ra"][:, None], x["fa"] == x["sa"][None]
    r_out, s_out = x["fa"] < x["rf"][:, None], x["af"] < x["sf"][None]
    yes, no = {
        "intersect": (hit, miss), "disjoint": (miss, hit), "meet": (miss & hit, miss | hit), "equal": (miss & hit, r_out | s_out),
        "inside": (r_deep, r_out | miss), "covered_by": (r_deep, r_out | miss), "contains": (s_deep, s_out | miss), "covers": (s_deep, s_out | miss),
    }[name]
    return np.select([yes, no], [1, 0], -1)


def relation_codes(x: dict[str, np.ndarray], plain: np.ndarray) -> np.ndarray:
    """Relation code for each r and s, or -1 where the intervals do not tell. plain: their boxes lie neither way in one another."""
    hit = (x["af"] > 0) | (x["fa"] > 0)
    return np.select([x["aa"] == 0, x["af"] == x["ra"][:, None], x["fa"] == x["sa"][None], hit & plain], [0, 2, 3, 1], -1)


_BOX_TESTS = {"inside": (R_IN_S_BOX,), "covered_by": (R_IN_S_BOX,), "contains": (S_IN_R_BOX,), "covers": (S_IN_R_BOX,), "equal": ()}


def _cell_pairs(left: pa.Table, right: pa.Table, name: str | None, kr: str, ks: str, order: int):
    """relation (1 where it is a predicate that holds), id_r, id_s of a cell's pairs, by blocks."""
    column = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    r, s = ({c: column(t, f"{c}_{k}") for c in (*BOX, "rec_id", "ix0", "iy0", "own")} for t, k in ((left, "r"), (right, "s")))
    flat_r, flat_s = (laid_flat(t.column(f"flat_{k}").combine_chunks()) for t, k in ((left, "r"), (right, "s")))
    lists = {f"{k}{v[0]}": t.column(f"april_{k}").combine_chunks().field(v).to_pylist() for t, k in ((left, "r"), (right, "s")) for v in ("all_b", "full_b")}
    ix, iy, level = (column(left, c)[0] for c in ("ix", "iy", "level"))
    side = max(1, int(MOST_PAIRS**0.5))
    for i in range(0, left.num_rows, side):
        for j in range(0, right.num_rows, side):
            a, b = {c: v[i : i + side, None] for c, v in r.items()}, {c: v[None, j : j + side] for c, v in s.items()}
            near = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
            near &= (np.maximum(a["ix0"], b["ix0"]) == ix) & (np.maximum(a["iy0"], b["iy0"]) == iy) & (np.maximum(a["own"], b["own"]) == level)
            case = box_case(*([x[c] for c in BOX] for x in (a, b)))
            if name in _BOX_TESTS:
                near &= np.isin(case, [EQUAL_BOXES, *_BOX_TESTS[name]])
            x, y = np.nonzero(near)
            if not len(x):
                continue
            some_r, at_x = np.unique(x, return_inverse=True)
            some_s, at_y = np.unique(y, return_inverse=True)
            seen = shared(*([lists[k][i + v] for v in some_r] for k in ("ra", "rf")), *([lists[k][j + v] for v in some_s] for k in ("sa", "sf")), order)
            codes = predicate_codes(name, seen) if name else relation_codes(seen, case[np.ix_(some_r, some_s)] == OTHER_BOXES)
            known = codes[at_x, at_y].astype(np.int8)
            took_r, took_s = _taken(flat_r, i + x, known < 0), _taken(flat_s, j + y, known < 0)
            left_open = known < 0
            if left_open.any():  # what the intervals decide does not reach the kernel
                known[left_open] = decide_predicate(name, kr, took_r, ks, took_s) if name else decide_relation(kr, took_r, ks, took_s)
            keep = known == 1 if name else np.ones(len(x), bool)
            yield pa.table({"relation": known[keep].astype(np.int32), "id_r": r["rec_id"][i + x[keep]], "id_s": s["rec_id"][j + y[keep]]})


def _taken(flat: tuple[np.ndarray, np.ndarray], rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and offsets of some of the rows."""
    values, at = flat
    rows = rows[which]
    sizes = at[rows + 1] - at[rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(at[rows] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def by_cell(a: DataFrame, b: DataFrame, tasks: int | None, name: str | None, kr: str, ks: str, order: int) -> DataFrame:
    """relation, id_r, id_s of pairs of dealt sides with intervals: of those for which a predicate holds (relation 1), or of all.

    A cell's shapes meet in one place, each with its lists once: pairs are made there, and hold nothing but their ids.
    """
    if tasks:
        a, b = a.repartition(tasks, "cell"), b.repartition(tasks, "cell")
    schema = "relation int, id_r long, id_s long"
    empty = pa.table({"relation": pa.array([], pa.int32()), "id_r": pa.array([], pa.int64()), "id_s": pa.array([], pa.int64())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return pa.concat_tables([empty, *_cell_pairs(left, right, name, kr, ks, order)])

    return a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(run, schema)
