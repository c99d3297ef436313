"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints are made once for each document and written; equal ones are one node. The 64 bits are cut into B blocks: two
fingerprints that differ in at most R bits agree in at least B - R of them, so that they meet under at least one of the
C(B, R) choices of B - R blocks. B follows from the number of fingerprints alone, so that a key's bits keep up with it;
the links found are the same for every B. Fingerprints under one key are compared in vertical form: a bit plane for each
of the 64 places, many distances in one machine word, carry-save counters for the distances, and a block given up once
all its distances exceed the radius. A task emits a spanning set of the links it found, never all pairs. Keys with more
than CHUNK fingerprints are dealt out as pairs of chunks. Components come from rounds of star contraction on tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import col, new_dir, remove_dir, staged, table

RADIUS = 4
MAX_RADIUS = 8
SHINGLE = 4
SEED = 42
CHUNK = 4096
SHORT_RUN = 128


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit k is 1 if set in over half of the shingles' XXH64."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # 255 at a time, summed in bytes
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id, fp (signed 64 bits). bytes.lower() touches A-Z only; bytes.split() knows the six ASCII spaces only."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(make, "id long, fp long")


# ---------------------------------------------------------------- comparison


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) of uint64: plane k holds bit k of every fingerprint, 64 fingerprints a word."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    width = -(-n // 64) * 64
    wide = np.zeros((64, width), np.uint8)
    wide[:, :n] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters: as many bit slices as the radius needs, and a slice that remembers a count beyond them."""

    def __init__(self, shape, radius: int):
        self.slices = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.past, self.radius = np.zeros(shape, np.uint64), radius

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for k, s in enumerate(self.slices):
            self.slices[k], carry = s ^ carry, s & carry
        self.past |= carry

    def over(self) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        out = self.past.copy()
        equal = ~np.zeros_like(out)
        for k in reversed(range(len(self.slices))):
            if self.radius >> k & 1:
                equal &= self.slices[k]
            else:
                out |= equal & self.slices[k]
                equal &= ~self.slices[k]
        return out


def _close(differ, shape, idle: np.ndarray, radius: int) -> np.ndarray:
    """Lanes not idle whose distance is at most radius. differ(k): plane k of the differences."""
    counters = Counters(shape, radius)
    for k in range(64):
        counters.add(differ(k))
        if k % 8 == 7:
            far = counters.over()
            if not (~(far | idle)).any():  # the whole block is beyond the radius
                return np.zeros(shape, np.uint64)
    return ~(far | idle)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def links_by_shift(fps: np.ndarray, run: np.ndarray, radius: int = RADIUS):
    """Links between fingerprints of the same run number (runs lie together): each is compared with its d-th successor."""
    n, found = len(fps), []
    planes = np.concatenate([_planes(fps), np.zeros((64, 2), np.uint64)], axis=1)
    width = planes.shape[1] - 2
    d = 1
    while d < n and (same := run[d:] == run[:-d]).any():
        q, r = divmod(d, 64)
        idle = np.ones(width * 64, np.uint8)
        idle[: n - d] = ~same
        idle = np.packbits(idle, bitorder="little").view(np.uint64)
        shifted = np.zeros((64, width), np.uint64)
        m = width - q
        shifted[:, :m] = planes[:, q : q + m] >> np.uint64(r)
        if r:
            shifted[:, :m] |= planes[:, q + 1 : q + 1 + m] << np.uint64(64 - r)
        shifted ^= planes[:, :width]
        near = _lanes(_close(shifted.__getitem__, width, idle, radius), n)
        if len(near):
            found.append(np.stack([near, near + d]))
        d += 1
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def links_between(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, rows: int = 64):
    """Links from each of a to any of b, some at a time: yields (places in a, places in b)."""
    planes, idle = _planes(b), np.ones(-(-len(b) // 64) * 64, np.uint8)
    idle[: len(b)] = 0
    idle = np.packbits(idle, bitorder="little").view(np.uint64)[None, :]
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        bits = [np.where(part >> np.uint64(k) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for k in range(64)]
        near = _close(lambda k: bits[k] ^ planes[k][None, :], (len(part), planes.shape[1]), idle, radius)  # noqa: B023
        if near.any():
            i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(b)])
            yield i + at, j


def roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest place reachable from each of n places over the links."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def _run_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links in one long run."""
    label = np.arange(len(fps))
    for at in range(0, len(fps), CHUNK):
        for i, j in links_between(fps[at : at + CHUNK], fps[at:], radius):
            label = roots(len(fps), i + at, j + at, label)
    child = np.flatnonzero(label != np.arange(len(fps)))
    return child, label[child]


def spanning_links(key: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int):
    """(rep, rep) links that span what is linked inside each run of equal keys; the arrays are sorted by key."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run]
    u, v = [], []
    short = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
    for at in range(0, len(short), 65536):
        part = short[max(0, at - SHORT_RUN) : at + 65536]  # overlaps, so that a run cut here is whole in one of both
        i, j = links_by_shift(fps[part], run[part], radius)
        label = roots(len(part), i, j)
        child = np.flatnonzero(label != np.arange(len(part)))
        u.append(part[child])
        v.append(part[label[child]])
    long = np.flatnonzero(size > SHORT_RUN)
    for members in np.split(long, np.flatnonzero(np.diff(run[long])) + 1) if len(long) else []:
        child, parent = _run_links(fps[members], radius)
        u.append(members[child])
        v.append(members[parent])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return reps[u], reps[v]


# ---------------------------------------------------------------- keys and tasks


def n_blocks(n: int, radius: int) -> int:
    """Blocks such that a key has about as many bits as log2(n); the work for each key then stays in proportion."""
    need = np.log2(max(n, 2)) + 2
    for b in range(radius + 1, 2 * radius + 3):
        if 64 * (b - radius) / b >= need:
            return b
    return 2 * radius + 2


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(mask[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def fingerprint_links(nodes: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """a, b: representatives whose fingerprints are within the radius, enough links to span every component."""
    masks = block_masks(n_blocks(n, radius), radius)
    keys = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("key")) for k, m in enumerate(masks)]))
    keyed = nodes.select("fp", "rep", keys.alias("k")).select("k.key", "fp", "rep")
    large = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk), "large-keys")
    if large.isEmpty():
        pairs = keyed.select("key", F.lit(0).alias("side"), "fp", "rep")
    else:  # a large key's chunks meet pairwise, each pair under a key of its own
        m = F.ceil(F.col("n") / chunk).cast("int")
        mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), m).cast("int")
        tagged = keyed.join(large, "key", "left").withColumn("m", F.coalesce(m, F.lit(1))).withColumn("c", F.coalesce(mine, F.lit(0)))
        other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")
        tagged = tagged.select("key", "fp", "rep", "m", "c", other)
        lo, hi = F.least("c", "o"), F.greatest("c", "o")
        pairs = tagged.select(F.when(F.col("m") > 1, F.xxhash64("key", lo, hi)).otherwise(F.col("key")).alias("key"), F.lit(0).alias("side"), "fp", "rep")

    def compare(batches):
        held, limit = [], 1 << 17
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "fp", "rep")])
            if sum(len(x[0]) for x in held) < limit:
                continue
            key, fp, rep = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            if cut:
                yield emit(key[:cut], fp[:cut], rep[:cut])
            held, limit = [[key[cut:], fp[cut:], rep[cut:]]], max(1 << 17, 2 * (len(key) - cut))
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held)))

    def emit(key, fp, rep):
        a, b = spanning_links(key, np.ascontiguousarray(fp).view(np.uint64), rep, radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spread = pairs.repartition("key").sortWithinPartitions("key")
    return spread.select("key", "fp", "rep").mapInArrow(compare, "a long, b long")


# ---------------------------------------------------------------- components


def components(links: DataFrame, label: str = "star") -> DataFrame:
    """node, root: the smallest node reachable, for every node in a link; rounds of large-star and small-star.

    Each round's tables are written; those of the round before are then deleted.
    """
    spark, made = links.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(new_dir(spark, f"{label}-{name}"))
        return staged(df, name, made[-1])

    edges = kept(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "0")
    k = 0
    while True:
        both = edges.select("lo", "hi").union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(kept(low, "low"), "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = kept(large.where("lo <> hi").distinct(), "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(kept(low, "low"), "hi").select("lo", "hi", "m")
        small = small.select(F.col("m").alias("lo"), "hi").union(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        k += 1
        edges = kept(small.where("lo <> hi").distinct(), str(k))
        for path in made[:-1]:
            remove_dir(spark, path)
        del made[:-1]
        # A forest of stars: no centre is anyone's leaf, and no leaf has two centres.
        leaves = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        if leaves.where("n > 1").isEmpty() and edges.select(F.col("lo").alias("hi")).join(edges.select("hi"), "hi", "left_semi").isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of df.

    radius: from 0 to 8 bits; the choices of blocks grow fast with it, and what is wanted beyond is near_copies() with its exact
    check. Texts of any length are read whole. Texts without words (null ones too) have fingerprint zero and are linked like others. Rows with a null id are linked to
    none; they get the component of their fingerprint, null if no row with an id has it. Repeated rows give repeated
    rows. Other columns are not read. An empty table gives an empty result.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"a radius of {radius} bits")
    marks = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = staged(marks.groupBy("fp").agg(F.min("id").alias("rep")).where(F.col("rep").isNotNull()), "nodes")
    links = fingerprint_links(nodes, nodes.count(), radius)
    found = components(links)
    whole = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    whole = staged(whole, "components")
    return marks.join(whole, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
