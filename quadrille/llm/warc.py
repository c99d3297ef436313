"""WARC archives: writing, normalising of monolithic gzip files, and reading by offset.

Writers often compress an archive as one gzip stream, which can be read from its start only. The normaliser inflates such
a stream once, in small blocks, and writes each record as a gzip member of its own, with a sidecar of offsets, lengths,
ids and types (a JSON line a record). Readers then take single records, or any share of a file, by their offsets. Payloads
that others repeat are kept once: later pages revisit the page with the smallest id.
Files of a task carry its attempt's number and count only once its manifest row is committed.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import col, filesystem, new_dir, staged, table

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 20
LEVEL = 3
END = b"\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
NORMAL = "path string, sidecar string, at long, records long"


# ---------------------------------------------------------------- records


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode()]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        head.append(b"WARC-Target-URI: " + safe.encode())
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {size}".encode()]
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(head) + END + payload + END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}


class Inflated:
    """A gzip file of one or many members as one stream of bytes, inflated once, a block at a time.

    A file that ends before its last member does is an error: zlib then never saw the member's checksum and length.
    """

    def __init__(self, source):
        self.source, self.inflate, self.data, self.at, self.rest = source, zlib.decompressobj(31), b"", 0, b""
        self.begun = False

    def more(self) -> bool:
        while True:
            raw = self.rest or self.source.read(BLOCK)
            self.rest = b""
            if not raw:
                if self.begun and not self.inflate.eof:
                    raise ValueError("the archive ends within a gzip member")
                return False
            self.begun = True
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(raw, 4 * BLOCK)
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            if out:
                self.data, self.at = self.data[self.at :] + out, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What lies before the next mark, which is passed over; None at the end."""
        while (k := self.data.find(mark, self.at)) < 0:
            if not self.more():
                if self.at < len(self.data):
                    raise ValueError("the archive ends within a record")
                return None
        out, self.at = self.data[self.at : k], k + len(mark)
        return out

    def take(self, n: int):
        """The next n bytes, in blocks."""
        while n:
            if self.at == len(self.data) and not self.more():
                raise ValueError("the archive ends within a record")
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


# ---------------------------------------------------------------- writing


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, kind, refers_to; payloads that are repeated are found by digest.

    Null payloads are empty. Only digests that occur more than once take part in the join, a row each.
    """
    payload = F.encode(F.coalesce(col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    long_ = F.col("size") >= MIN_REVISIT_BYTES
    again = rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = staged(again.select("digest", "first"), "repeated")
    rows = rows.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
                       F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Each task writes its records as monolithic gzip files of about archive_bytes before compression; returns the manifest."""

    def write(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        at = TaskContext.get()
        made, out, packer, n, size = [], None, None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.write(packer.flush())
                out.close()
                made.append((path, n, size))
                out = None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "kind", "refers_to")]
            for (page_id, url, digest, length, kind, refers), payload in zip(zip(*columns), batch.column("payload")):
                if out is None or size >= archive_bytes:
                    close()
                    path = f"{root}/raw-{at.partitionId():06d}-{len(made):04d}-{at.taskAttemptId()}.warc.gz"
                    out, packer, n, size = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record_bytes(page_id, url, payload.as_buffer().to_pybytes(), digest, length, kind, refers)
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
        close()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*made)))))

    return staged(records.mapInArrow(write, MANIFEST), "archives")


# ---------------------------------------------------------------- normalising


def normalise_stream(source, out, sidecar) -> int:
    """Rewrites the records of a gzip WARC as one member each; a JSON line a record goes to the sidecar. Bounded memory."""
    stream, at, n = Inflated(source), 0, 0
    while (head := stream.until(END)) is not None:
        fields = parse_head(head)
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        parts = [packer.compress(head + END)]
        size = 0
        for block in stream.take(int(fields["content-length"])):
            parts.append(packer.compress(block))
            if sum(map(len, parts)) > BLOCK:
                size += sum(map(len, parts))
                out.write(b"".join(parts))
                parts = []
        if b"".join(stream.take(4)) != END:
            raise ValueError("a record does not end where its length says")
        parts += [packer.compress(END), packer.flush()]
        last = b"".join(parts)
        out.write(last)
        size += len(last)
        sidecar.write((json.dumps({"offset": at, "length": size, "id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n").encode())
        at, n = at + size, n + 1
    return n


def normalise(manifest: DataFrame, folder: str, share: int = 4096) -> DataFrame:
    """Normalises the archives of a manifest. A row for each share of records: path, sidecar, at (first), records.

    An archive that ends early, or that has another number of records than its manifest says, is an error.
    """

    def run(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                stem = f"{root}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}"
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{stem}.norm.warc.gz", compression=None) as out, fs.open_output_stream(f"{stem}.idx", compression=None) as sidecar:
                    n = normalise_stream(source, out, sidecar)
                if n != expected:
                    raise ValueError(f"{path}: {n} records, and {expected} in the manifest")
                first = list(range(0, n, share))
                yield pa.RecordBatch.from_pydict({"path": [f"{stem}.norm.warc.gz"] * len(first), "sidecar": [f"{stem}.idx"] * len(first),
                                                  "at": first, "records": [min(share, n - k) for k in first]},
                                                 schema=pa.schema([("path", pa.string()), ("sidecar", pa.string()), ("at", pa.int64()), ("records", pa.int64())]))

    n = manifest.sparkSession.sparkContext.defaultParallelism * 8
    return staged(manifest.select("path", "records").repartition(n).mapInArrow(run, NORMAL), "normalised")


# ---------------------------------------------------------------- reading


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive (an open random access file), by its place in the sidecar."""
    file.seek(offset)
    head, _, rest = zlib.decompress(file.read(length), 31).partition(END)
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


def read_archives(shares: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; digests of responses are verified."""

    def number(x: str | None):
        x = x[len("<urn:page:") : -1] if x else ""
        return int(x) if x else None

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, sidecar, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "sidecar", "at", "records"))):
                rows = []
                with fs.open_input_stream(sidecar, compression=None) as f:
                    places = f.read().decode().splitlines()[at : at + n]
                with fs.open_input_file(path) as file:
                    for place in map(json.loads, places):
                        fields, payload = read_record(file, place["offset"], place["length"])
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        if fields["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{path}: the record at {place['offset']} does not match its digest")
                        rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = shares.sparkSession.sparkContext.defaultParallelism * 8
    return shares.repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row, normalises the archives and reads them back, a row for each row of pages.

    Null payloads are empty; null ids are written as such and are response, unless a page with an id has the same payload.
    Rows that repeat the smallest id of a payload are all response. Other columns are not read, so their names
    do not matter. Payloads of any length are one record. An empty table writes nothing.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    manifest = write_archives(page_records(pages, id_col, url_col, payload_col), folder)
    return read_archives(normalise(manifest, folder), folder)


def op1_warc(spark, sf_dir) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""
