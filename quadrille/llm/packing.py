"""Packing of token sequences: patterns of few documents fitted by non-negative least squares, the rest by best fit.

Only the histogram of piece lengths, at most `capacity` numbers, reaches the driver. Patterns of one to eight lengths that
fill a sequence are enumerated; their repeat counts are fitted to the histogram by non-negative least squares and rounded
within the pieces that there are. What is left is packed by best fit decreasing over the histogram, many sequences at a
step. Of the fitted counts, the largest of a few shares is taken that costs no sequence more than best fit alone. The plan is a list of slot ranges for each length, bounded by
the capacity and not by the documents; each piece finds its slot from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import col, staged, table
from quadrille.llm.tokens import END_ID, encoder, public_path

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
ROUNDS = 300
#: Pieces a pattern has at most, draws of patterns for each number of pieces, shares of the fitted counts that are tried in turn.
MOST_PIECES, DRAWS, SHARES = 8, 4096, (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3)
#: Counts by task and length are broadcast up to so many rows (about 12 MB); beyond it, pieces meet them by a sorted shuffle.
MOST_BROADCAST_COUNTS = 100_000


# ---------------------------------------------------------------- tokens to pieces


def pieces_of(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """A row for each piece of each document: at most capacity ids, the document's end id included."""

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, step, end = encoder(vocabulary), 4 * capacity, END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(cut, PIECE_SCHEMA)


# ---------------------------------------------------------------- the plan


def patterns(hist: np.ndarray, capacity: int, most: int = MOST_PIECES, draws: int = DRAWS) -> np.ndarray:
    """Rows of up to `most` lengths (0: none), in falling order, of sum `capacity`, all of them present in hist.

    Of one and two lengths, all; of more, as many draws for each number of pieces: all lengths but two follow the histogram,
    the first going through the lengths in turn, and a pair that is present fills what is left. The draws are the same each time.
    """
    have = hist > 0
    have[0] = False
    present = np.flatnonzero(have)
    if not len(present):
        return np.zeros((0, most), np.int64)
    rng, found = np.random.default_rng(7), []
    pad = lambda rows: np.pad(rows, ((0, 0), (0, most - rows.shape[1])))
    if have[capacity]:
        found.append(pad(np.array([[capacity]])))
    pairs: dict[int, np.ndarray] = {}

    def larger(rest: int) -> np.ndarray:
        """Lengths that fill `rest` together with another that is not longer."""
        if rest not in pairs:
            c = np.arange(-(-rest // 2), rest)
            pairs[rest] = c[have[c] & have[rest - c]]
        return pairs[rest]

    two = larger(capacity)
    found.append(pad(np.stack([two, capacity - two], 1)))
    weight = hist[present] / hist[present].sum()
    for k in range(3, most + 1):
        picked = rng.choice(present, (draws, k - 2), p=weight)
        picked[:, 0] = present[np.arange(draws) % len(present)]
        rest, turn = capacity - picked.sum(1), rng.random(draws)
        rows = []
        for i in np.flatnonzero(rest > 1).tolist():
            if len(c := larger(int(rest[i]))):
                last = int(c[int(turn[i] * len(c))])
                rows.append([*picked[i].tolist(), last, int(rest[i]) - last])
        if rows:
            found.append(pad(np.array(rows)))
    return np.unique(-np.sort(-np.concatenate(found), axis=1), axis=0)


def fit_counts(hist: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS, stop: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns by least squares of (lengths used - hist), until the error falls by under `stop` in ten rounds."""
    live, size = rows > 0, len(hist)
    uses = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]) * live.ravel(), size)
    back = lambda v: (v[rows] * live).sum(1)
    goal = hist.astype(float)
    goal[0] = 0
    x = np.full(len(rows), goal.sum() / max(1, live.sum()))
    wanted, before = back(goal), np.inf
    for k in range(rounds):  # multiplicative steps keep x non-negative and never raise the squared error
        used = uses(x)
        if k % 10 == 0:
            error = float(((used - goal) ** 2).sum())
            if before - error < stop * max(before, 1e-12) and np.isfinite(before):
                break
            before = error
        x *= wanted / np.maximum(back(used), 1e-12)
    return x


def rounded(hist: np.ndarray, rows: np.ndarray, x: np.ndarray, share: float) -> np.ndarray:
    """Whole counts near share * x that ask for no more pieces than there are: whole parts first, then one more each, largest fraction first."""
    left, out = hist.tolist(), np.zeros(len(rows), np.int64)
    wanted = share * x
    base, room = np.floor(wanted), share * float((x[:, None] * rows).sum()) / max(1, int(rows[0].sum()))
    for whole in (True, False):
        size = base if whole else wanted - base
        for i in np.argsort(-size, kind="stable").tolist():
            if size[i] <= 0 or room < 1:
                break
            need = Counter(v for v in rows[i].tolist() if v)
            n = min([int(size[i]) if whole else 1, int(room), *(left[v] // m for v, m in need.items())])
            if n > 0:
                out[i] += n
                room -= n
                for v, m in need.items():
                    left[v] -= m * n
    return out


def best_fit(hist: np.ndarray, capacity: int):
    """Best fit decreasing over a histogram: (groups, slots).

    groups: the number of sequences in each. slots: (length, group, first sequence in it, sequences, offset, pieces a
    sequence).
    """
    groups: list[int] = []
    slots: list[tuple] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # free ids -> [(group, first, sequences)]
    spaces = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(hist[length])
        while left:
            fitting = np.flatnonzero(spaces[length:])
            if len(fitting):
                space = length + int(fitting[0])
                group, first, n = room[space].pop()
                if not room[space]:
                    spaces[space] = False
            else:
                space, each = capacity, capacity // length
                n, first, group = max(1, left // each), 0, len(groups)
                groups.append(n)
            each = space // length
            full = min(n, left // each)
            parts = [(first, full, each)] if full else []
            if full < n and left - full * each:
                part = min(each, left - full * each)
                if not full or part < each:
                    parts.append((first + full, 1, part))
            took = 0
            for at, m, q in parts:
                slots.append((length, group, at, m, capacity - space, q))
                left -= m * q
                took += m
                if space - q * length:
                    room.setdefault(space - q * length, []).append((group, at, m))
                    spaces[space - q * length] = True
            if took < n:
                room.setdefault(space, []).append((group, first + took, n - took))
                spaces[space] = True
    return groups, slots


def make_plan(hist: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Slot ranges sorted by (length, number of their first piece among those of the length)."""
    hist = np.asarray(hist, np.int64).copy()
    rows = patterns(hist, capacity)
    x = fit_counts(hist, rows)
    plain, counts = sum(best_fit(hist, capacity)[0]), np.zeros(len(rows), np.int64)
    for share in SHARES if len(rows) else ():  # as much by patterns as costs no sequence more than best fit alone
        tried = rounded(hist, rows, x, share)
        left = hist - np.bincount(rows.ravel(), np.repeat(tried, rows.shape[1]) * (rows > 0).ravel(), len(hist)).astype(np.int64)
        if tried.sum() + sum(best_fit(left, capacity)[0]) <= plain:
            counts = tried
            break
    slots: list[tuple] = []  # length, first sequence, sequences, offset, pieces a sequence
    n_sequences = 0
    for pattern, x in zip(rows[counts > 0].tolist(), counts[counts > 0].tolist()):
        at = 0
        for length in filter(None, pattern):
            slots.append((length, n_sequences, x, at, 1))
            hist[length] -= x
            at += length
        n_sequences += x
    fitted = n_sequences
    groups, rest = best_fit(hist, capacity)
    starts = n_sequences + np.concatenate([[0], np.cumsum(groups)]).astype(np.int64)
    slots += [(length, int(starts[g]) + first, n, at, q) for length, g, first, n, at, q in rest]
    table_ = np.array(slots, np.int64).reshape(-1, 5)
    table_ = table_[np.argsort(table_[:, 0], kind="stable")]
    took = table_[:, 2] * table_[:, 4]
    before = np.cumsum(took) - took
    first_of = np.zeros(capacity + 2, np.int64)
    lengths, at = np.unique(table_[:, 0], return_index=True)
    first_of[lengths] = before[at] if len(at) else 0
    return {"length": table_[:, 0], "nth": before - first_of[table_[:, 0]], "sequence": table_[:, 1], "offset": table_[:, 3],
            "each": table_[:, 4], "sequences": np.int64(starts[-1]), "fitted": np.int64(fitted)}


# ---------------------------------------------------------------- pieces to slots


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    A null or empty text is the end id alone. Repeated rows and ids are packed row by row. Other columns are not read,
    so their names do not matter. A null id stays null. No rows in, none out. Documents longer than capacity are cut; nothing else is.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = staged(pieces_of(docs, vocabulary or public_path(VOCABULARY), id_col, text_col, capacity), "pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    hist, n_counts = np.zeros(capacity + 1, np.int64), 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
        n_counts += r["rows"]
    plan = make_plan(hist, capacity)
    by_task = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("base"))
    shift = np.int64(1) << 44
    keys = plan["length"] * shift + plan["nth"]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            slot = np.searchsorted(keys, length * shift + nth, "right") - 1
            t = nth - plan["nth"][slot] if len(keys) else nth
            each = plan["each"][slot] if len(keys) else nth
            sequence = plan["sequence"][slot] + t // each if len(keys) else nth
            offset = plan["offset"][slot] + t % each * length if len(keys) else nth
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    base = F.broadcast(base) if n_counts <= MOST_BROADCAST_COUNTS else base.hint("merge")
    placed = pieces.join(base, ["task", "length"]).select(*names, "nth", "base")
    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_pack(spark, sf_dir) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
