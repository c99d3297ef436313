"""SimHash near-dedup at a similarity: which texts share so much of their word shingles.

A radius of a few bits, as simhash_dedup() takes it, reaches few texts of Jaccard similarity 0.8, whose fingerprints differ in
ten bits of 64 on average; for a radius that does reach them no choice of blocks leaves keys of use. Here rows meet under MinHash keys, of
least shingle hashes, instead (30 keys of five; a pair of similarity 0.8 meets under none with odds of 7 in a million).
What meets is compared by SimHash as in simhash_dedup(): bit planes, carry-save counters, blocks given up beyond the
radius. Pairs within the radius are confirmed by their whole sets of shingles, but for those that are linked already. What meets
is gathered by components of the keys' stars. A large component is cut into chunks that first meet chunk 0 alone, which links most
of a group of copies; then what is not in the component's largest group found meets all of the component, so that no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checked, col, staged
from quadrille.llm.simhash import SEED, SHORT_RUN, components, links_between, links_by_shift, majority

SHINGLE = 5
PERCENT = 80
#: Of texts of similarity 0.8, about 1 in 4000 differ in more bits than this (mean 9.7, deviation 2.9).
RADIUS = 20
BANDS, ROWS = 30, 5
#: Rows, and characters, of a chunk of a component; a task meets two chunks at a time.
CHUNK = 1024
CHUNK_CHARS = 8_000_000
HELD = 4096
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _FACTORS.reshape(BANDS, ROWS)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of words, sorted, each once; a shorter text is one run. Words as fingerprints take them."""
    import xxhash

    words = text.encode().lower().split() if text else []
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; one factor a hash, so that the least product falls to another shingle each time."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] * _FACTORS
        least = np.minimum(least, (part ^ part >> np.uint64(29)).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (low + high - both)


def near_pairs(fps: np.ndarray, run: np.ndarray, radius: int):
    """Pairs (places) of fingerprints within the radius in each run of equal run numbers, some at a time."""
    size = np.bincount(run)[run]
    short = np.flatnonzero(size <= SHORT_RUN)
    if len(short) > 1:
        i, j = links_by_shift(fps[short], run[short], radius)
        yield short[i], short[j]
    long = np.flatnonzero(size > SHORT_RUN)
    for members in np.split(long, np.flatnonzero(np.diff(run[long])) + 1) if len(long) else []:
        for at in range(0, len(members), 64):
            for i, j in links_between(fps[members[at : at + 64]], fps[members[at:]], radius):
                ahead = j > i
                yield members[at + i[ahead]], members[at + j[ahead]]


def confirmed(sets: list[np.ndarray], run: np.ndarray, percent: int, radius: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places) that span what is similar in each run; known: numbers of groups that are linked already."""
    label, found = np.arange(len(sets)) if known is None else known.copy(), []
    for i, j in near_pairs(np.array([majority(s) for s in sets], np.uint64), run, radius):
        open_ = label[i] != label[j]
        for p, q in zip(i[open_].tolist(), j[open_].tolist()):
            if label[p] != label[q] and similar(sets[p], sets[q], percent):
                found.append((p, q))
                label[label == label[q]] = label[p]
    return found


def near_copies(df: DataFrame, id_col: str, content: Column, text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
                radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """id, content, root_id, root_content of each distinct row that is not the least of its component of similar texts.

    A row is known by id and content (a hash of what tells rows of one id apart), so that two texts of one id are two nodes, and
    repeated rows are one. Rows without an id take no part. Null and empty texts are alike, one empty run of words each. Texts of
    any length are read whole. Only the columns named are read. No rows in, none out.
    """
    rows = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), content.cast("long").alias("content"), col(text_col).cast("string").alias("text"))

    def compared(rows: DataFrame, dealt: DataFrame) -> DataFrame:
        """Links among rows dealt to one key (node, known: the group it is in already, key); none within a known group."""
        dealt = staged(dealt.select("node.id", "node.content", F.col("known.id").alias("gi"), F.col("known.content").alias("gc"), "key"), "dealt")
        texts = rows.join(checked(dealt), ["id", "content"]).select("key", "id", "content", "gi", "gc", "text")
        spread = texts.repartition("key").sortWithinPartitions("key")
        links = spread.mapInArrow(compare, "ai long, ac long, bi long, bc long")
        pair = lambda i, c: F.struct(F.col(i).alias("id"), F.col(c).alias("content"))
        return links.select(pair("ai", "ac").alias("a"), pair("bi", "bc").alias("b"))

    def compare(batches):
        held: list[tuple] = []
        for batch in batches:
            for key, *node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= HELD and held[-1][0] != key:
                    yield from emit(held)
                    held = []
                held.append((key, *node, shingles(text, shingle)))
        if held:
            yield from emit(held)

    def emit(held):
        run = np.unique(np.array([h[0] for h in held], np.int64), return_inverse=True)[1]
        known = np.unique(np.array([h[3:5] for h in held], np.int64), axis=0, return_inverse=True)[1].reshape(-1)
        found = confirmed([h[5] for h in held], run, percent, radius, known)
        if found:
            a, b = ([held[i] for i in side] for side in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in side], pa.int64()) for side in (a, b) for c in (1, 2)], names=["ai", "ac", "bi", "bc"])

    def sign(batches):
        for batch in batches:
            keys = [bands(shingles(t.as_py(), shingle)) for t in batch.column(2)]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            chars = pa.array([len(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), chars, pa.ListArray.from_arrays(at, flat)], names=["id", "content", "chars", "bands"])

    node = F.struct("id", "content")
    marks = staged(rows.mapInArrow(sign, "id long, content long, chars long, bands array<long>"), "bands")
    keyed = marks.select(node.alias("node"), F.explode("bands").alias("key"))
    least = staged(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least"), "shared-bands")
    stars = keyed.join(checked(least), "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    near = components(stars, "candidates")
    near = near.select("node", "root").union(near.select(F.col("root").alias("node"), "root").distinct())
    near = staged(near.join(marks.select(node.alias("node"), "chars").groupBy("node").agg(F.max("chars").alias("chars")), "node"), "candidates")

    def parted(of: DataFrame, m: str) -> DataFrame:
        """With the number of chunks that a row's component goes into. Only those of large ones are joined, so that no component meets in a task."""
        count = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("chars") / CHUNK_CHARS)).cast("int").alias(m)
        many = staged(of.groupBy("root").agg(count).where(F.col(m) > 1), "sizes")
        return of.join(checked(many), "root", "left").withColumn(m, F.coalesce(m, F.lit(1)))

    place = lambda m, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(m)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    near = staged(parted(near, "m").withColumn("c", place("m", 7)), "chunks")

    # First each chunk with the chunk 0 of its component: similar texts are mostly linked by way of that. Chunk 0 meets itself beside chunk 1.
    others = F.sequence(F.least(F.lit(1), F.col("m") - 1), F.col("m") - 1)
    first = near.withColumn("o", F.explode(F.when(F.col("c") == 0, others).otherwise(F.array("c"))))
    links = staged(compared(rows, first.select("node", F.col("node").alias("known"), F.xxhash64("root", "o").alias("key"))), "links")
    out = components(links, "near")

    # Then whatever is not in the largest group found of a component, with all of the component.
    large = near.where("m > 1")
    if not large.isEmpty():
        large = large.join(out.withColumnRenamed("root", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
        large = staged(large, "known")
        counts = large.groupBy("root", "known").agg(F.count(F.lit(1)).alias("n"))
        main = staged(counts.groupBy("root").agg(F.max(F.struct("n", "known"))["known"].alias("main")), "main")
        rest = staged(large.join(checked(main), "root").where("known <> main").drop("main"), "others")
        rest = staged(parted(rest, "m_r").withColumn("r", place("m_r", 11)), "rest")
        if not rest.isEmpty():
            ask = rest.withColumn("o", numbers("m")).select("node", "known", F.xxhash64("root", "r", "o").alias("key"))
            asked = staged(rest.select("root", "m_r").distinct(), "asked")
            each = large.join(checked(asked), "root").withColumn("r", numbers("m_r"))
            each = each.select("node", "known", F.xxhash64("root", "r", F.col("c")).alias("key"))
            out = components(links.union(compared(rows, ask.union(each).distinct())), "near")
    return out.select("node.id", "node.content", F.col("root.id").alias("root_id"), F.col("root.content").alias("root_content"))
