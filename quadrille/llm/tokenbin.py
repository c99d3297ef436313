"""Token ids in binary shards with a minimal perfect hash index.

A shard is three files. `.ids`: a 16-byte header with the width of an id, then raw little-endian ids (2 bytes where the
vocabulary fits, else 4). `.keys`: the documents' keys in order and their lengths, for whole scans. `.mph`: the index. Its
hash is built level by level: a key that has a cell of the level's bit array to itself is placed there, the others go to the
next level; a key's number is the rank of its bit, so that n keys have the numbers 0 to n - 1. Ranks are stored with the bits,
a block of 64 bytes each. For each number the index stores a 32-bit fingerprint of the key, and where its ids lie; a key that
is not there fails the fingerprint. A lookup reads the header, a block for each level tried (two or three), one entry and the
ids, whatever the shard's size.
Files of a task carry its attempt's number and count only once its manifest row is committed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import col, filesystem, new_dir, staged, table
from quadrille.llm.tokens import END_ID, encoder, public_path

VOCABULARY = "word_bpe_49k.json"
MAGIC = b"QIDS"
VERSION = 2
GAMMA = 1.5
MAX_LEVELS = 40
#: A block of a level's bits: a rank of 8 bytes and 448 bits.
BLOCK = 64
BLOCK_BITS = 8 * (BLOCK - 8)
HEAD, LEVEL, IDS_HEAD = struct.Struct("<HHq"), struct.Struct("<qq"), struct.Struct("<HHq")
ENTRY = np.dtype([("mark", "<u4"), ("count", "<u4"), ("start", "<i8"), ("length", "<i8")])


# ---------------------------------------------------------------- minimal perfect hash


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of keys (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit integers: a bit array for each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ones - 1 + before)
            before += int(ones[-1]) if len(ones) else 0
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(len(left) * GAMMA))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 where no level has a bit."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (mixed(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


def pack_index(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> bytes:
    """Index file of distinct keys: where the first document of each lies, ids in it, documents that share the key.

    Header; size and first block of each level; blocks of BLOCK bytes, each the rank before it and BLOCK_BITS bits of a
    level; entries. Every part has a place that the header gives, so that one key is found by a few short reads.
    """
    mph = PerfectHash.build(keys)
    place = mph(keys)
    entry = np.zeros(len(keys), ENTRY)
    entry["mark"][place] = marks_of(keys)
    for name, x in (("count", counts), ("start", starts), ("length", lengths)):
        entry[name][place] = x
    head, blocks, first, rank = [], [], 0, 0
    for bits in mph.levels:
        n = -(-len(bits) // BLOCK_BITS)
        wide = np.zeros(n * BLOCK_BITS, bool)
        wide[: len(bits)] = bits
        ones = wide.reshape(n, BLOCK_BITS).sum(1)
        part = np.zeros(n, [("rank", "<i8"), ("bits", "u1", BLOCK_BITS // 8)])
        part["rank"] = rank + np.cumsum(ones) - ones
        part["bits"] = np.packbits(wide.reshape(n, BLOCK_BITS), axis=1, bitorder="little")
        head.append(LEVEL.pack(len(bits), first))
        blocks.append(part.tobytes())
        first, rank = first + n, rank + int(ones.sum())
    return b"".join([MAGIC, HEAD.pack(VERSION, len(mph.levels), len(keys)), *head, *blocks, entry.tobytes()])


def marks_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Finds a key's place in an open index file: the header once, then a block for each level tried and one entry."""

    def __init__(self, file):
        self.file = file
        if self._read(0, 4) != MAGIC:
            raise ValueError("not an index")
        version, n_levels, self.n = HEAD.unpack(self._read(4, HEAD.size))
        if version != VERSION:
            raise ValueError(f"index version {version}")
        data = self._read(4 + HEAD.size, LEVEL.size * n_levels)
        self.levels = [LEVEL.unpack_from(data, LEVEL.size * k) for k in range(n_levels)]
        self.blocks_at = 4 + HEAD.size + len(data)
        self.entries_at = self.blocks_at + BLOCK * sum(-(-size // BLOCK_BITS) for size, _ in self.levels)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def find(self, key: int) -> tuple[int, int, int] | None:
        """start, length, documents of the key; None for a key that is not there (but for 1 in 2**32 of those)."""
        one = np.array([key], np.int64)
        for k, (size, first) in enumerate(self.levels):
            block, bit = divmod(int(mixed(one, k)[0]) % size, BLOCK_BITS)
            data = self._read(self.blocks_at + BLOCK * (first + block), BLOCK)
            bits = int.from_bytes(data[8:], "little")
            if bits >> bit & 1:
                number = int.from_bytes(data[:8], "little") + (bits & ((1 << bit) - 1)).bit_count()
                (e,) = np.frombuffer(self._read(self.entries_at + ENTRY.itemsize * number, ENTRY.itemsize), ENTRY)
                return (int(e["start"]), int(e["length"]), int(e["count"])) if e["mark"] == marks_of(one)[0] else None
        return None

    def find_all(self, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts (-1: not there), lengths and documents of many keys; reads the file once."""
        keys = np.asarray(keys, np.int64)
        levels = []
        for size, first in self.levels:
            n = -(-size // BLOCK_BITS)
            data = np.frombuffer(self._read(self.blocks_at + BLOCK * first, BLOCK * n), [("rank", "<i8"), ("bits", "u1", BLOCK_BITS // 8)])
            levels.append(np.unpackbits(data["bits"].ravel(), bitorder="little")[:size].astype(bool))
        place = PerfectHash(levels)(keys)
        if not self.n:
            return place, place * 0, place * 0
        e = np.frombuffer(self._read(self.entries_at, ENTRY.itemsize * self.n), ENTRY)[np.maximum(place, 0)]
        ok = (place >= 0) & (e["mark"] == marks_of(keys))
        return np.where(ok, e["start"], -1), np.where(ok, e["length"], 0), np.where(ok, e["count"], 0)


# ---------------------------------------------------------------- shards


def ids_header(width: int) -> bytes:
    """Magic, version, width, eight bytes that are zero; the number of documents is in `.keys`."""
    return MAGIC + IDS_HEAD.pack(VERSION, width, 0)


def open_ids(file) -> int:
    """Checks an id file's header; the width of an id in bytes."""
    if file.read(4) != MAGIC:
        raise ValueError("not an id file")
    version, width, _ = IDS_HEAD.unpack(file.read(IDS_HEAD.size))
    if version != VERSION or width not in (2, 4):
        raise ValueError(f"id file of version {version}, width {width}")
    return width


def read_ids(file, width: int, start: int, n: int) -> np.ndarray:
    file.seek(4 + IDS_HEAD.size + width * start)
    return np.frombuffer(file.read(width * n), f"<u{width}")


def write_shards(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards, in ascending order of keys; a manifest row for each: shard, path, docs, ids."""

    width = encoder(vocabulary).width()

    def write(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        at, enc, end = TaskContext.get(), encoder(vocabulary), END_ID.to_bytes(4, "little")
        name = f"{root}/shard-{at.partitionId():06d}-{at.taskAttemptId()}"
        keys, lengths, total = [], [], 0
        out = fs.open_output_stream(f"{name}.ids")
        out.write(ids_header(width))
        for batch in batches:
            parts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                keys.append(key)
                lengths.append(len(ids) // 4)
                parts.append(ids)
            ids = np.frombuffer(b"".join(parts), "<u4")
            total += len(ids)
            out.write(ids.astype(f"<u{width}").tobytes())
        out.close()
        if not keys:
            fs.delete_file(f"{name}.ids")
            return
        nulls = sum(k is None for k in keys)  # they come first in ascending order; only whole scans reach them
        n, known = np.array(lengths, np.int64), np.array(keys[nulls:], np.int64)
        starts = np.cumsum(n) - n
        with fs.open_output_stream(f"{name}.keys") as f:
            f.write(struct.pack("<qq", len(keys), nulls) + known.astype("<i8").tobytes() + n.astype("<i8").tobytes())
        distinct, first, count = np.unique(known, return_index=True, return_counts=True)
        with fs.open_output_stream(f"{name}.mph") as f:
            f.write(pack_index(distinct, starts[nulls:][first], n[nulls:][first], count))
        yield pa.RecordBatch.from_pydict({"shard": [at.partitionId()], "path": [name], "docs": [len(keys)], "ids": [total]},
                                         schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    salt = F.when(F.col("id").isNull(), F.xxhash64("text"))  # rows without a key are many or few; those with one stay together
    ordered = rows.withColumn("salt", salt).repartitionByRange(F.col("id").asc_nulls_first(), F.col("salt")).sortWithinPartitions(F.col("id").asc_nulls_first(), "salt")
    return staged(ordered.select("id", "text").mapInArrow(write, "shard long, path string, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, its ids looked up by key in the index."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))  # a row a shard

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_stream(f"{path}.keys") as f:
                    data = f.read()
                n, nulls = struct.unpack_from("<qq", data)
                keys = np.frombuffer(data, "<i8", n - nulls, 16)
                lengths = np.frombuffer(data, "<i8", n, 16 + 8 * (n - nulls))
                with fs.open_input_file(f"{path}.mph") as f:
                    starts, first_lengths, _ = Index(f).find_all(keys)
                if (starts < 0).any():
                    raise ValueError(f"{path}: a key is not in the index")
                # Documents that share a key lie together, from the indexed one on.
                scan = np.cumsum(lengths) - lengths
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                if (starts[new] != scan[nulls:][new]).any() or (first_lengths[new] != lengths[nulls:][new]).any():
                    raise ValueError(f"{path}: index and keys disagree")
                at = np.where(np.concatenate([np.zeros(nulls, bool), new]), np.concatenate([scan[:nulls], starts]), scan)
                with fs.open_input_file(f"{path}.ids") as f:
                    width = open_ids(f)
                    for lo in range(0, n, 4096):
                        hi = min(n, lo + 4096)
                        ids = read_ids(f, width, int(at[lo]), int(lengths[lo:hi].sum())).astype("<u4")
                        raw, offs = memoryview(ids.tobytes()), (at[lo:hi] - at[lo]) * 4
                        crc = [zlib.crc32(raw[o : o + 4 * m]) for o, m in zip(offs.tolist(), lengths[lo:hi].tolist())]
                        named = [None] * max(0, nulls - lo) + keys[max(0, lo - nulls) : max(0, hi - nulls)].tolist()
                        yield pa.RecordBatch.from_arrays([pa.array(named[: hi - lo], pa.int64()), pa.array(at[lo:hi] + base, pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array(crc, pa.int64())],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.select("path", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shard_path: str, keys) -> list[np.ndarray | None]:
    """Ids of single documents of one shard, by key; None for a key that is not there."""
    fs, at = filesystem(shard_path)
    out = []
    with fs.open_input_file(f"{at}.mph") as marks, fs.open_input_file(f"{at}.ids") as f:
        index, width = Index(marks), open_ids(f)
        for found in map(index.find, keys):
            out.append(None if found is None else read_ids(f, width, *found[:2]))
    return out


def token_shards(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes df's ids as shards and reads them back: doc_id, start, n_tokens, ids_crc32, a row for each row of df.

    Null and empty texts are the end id alone. Null keys come first and are reached by scans only. Rows that repeat a key
    lie together; the index leads to the first. Other columns are not read, so their names do not matter. Texts of any length
    are encoded whole. An empty table writes nothing.
    """
    folder = folder or new_dir(df.sparkSession, "ids")
    return read_shards(write_shards(df, folder, vocabulary or public_path(VOCABULARY), id_col, text_col), folder)


def op7_token_ids(spark, sf_dir) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))
