"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writing, each task makes one archive; equal payloads are stored once and revisited. Reading, archives are cut into
byte ranges. A task scans its range for gzip magic, validates each candidate by decoding the start of a WARC header
from it, and owns the records whose members start inside the range, reading past its end for the last one. Paths are
URIs of any file system that pyarrow knows, such as file, hdfs or s3; both sides must see them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, file_system, id_key, map_batches, renamed, shared_dir, table, text_of

MIN_REVISIT = 1000
RANGE = 8 << 20
BUFFER = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."


def _record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, original: str | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of the page `original`."""
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if original is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    head += [f"X-Page-Id: {quote(str(page), safe='')}"] * (page is not None) + [f"WARC-Target-URI: {target}"] * bool(target)
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(original)}",
            f"X-Refers-To-Page: {quote(str(original), safe='')}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(page, url, html, digest, original), ids as text: original is the page that a revisit refers to, null for responses.

    Of equal payloads of at least `least` bytes, the one with the largest id is the response; rows that share that id
    all are. Ids are of any type that sorts and can be text; null ids come below all others and null html is empty. Only
    digests that occur twice or more are joined back, and a digest that many pages share arrives as one row.
    """
    slim = renamed(pages, page=id_col, url=url_col, html=html_col).select("page", "url", text_of(F.col("html")).alias("html"))
    slim = slim.withColumn("key", id_key(F.col("page"), dict(slim.dtypes)["page"])).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    known = slim.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("key", "page")).alias("first"))
    # Written down, so that the join shuffles both of its sides and Spark can split a digest that many pages share.
    known = cut(known.where("n > 1").select(F.col("digest").alias("known_digest"), "first"))
    joined = slim.join(known, F.col("digest") == F.col("known_digest"), "left")
    original = F.when(F.col("key") < F.col("first.key"), F.col("first.page"))
    return joined.select(F.col("page").cast("string").alias("page"), F.col("url").cast("string").alias("url"), "html", "digest",
        original.cast("string").alias("original"))


def write(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Writes the archives and returns (path, bytes, records), one row an archive.

    Each attempt of a task writes a file of its own name, and only the rows of attempts that succeeded name archives,
    so a task that is lost and run again leaves no record twice: read what this returns, as a listing of the folder
    has the files of lost attempts too. The result is written down before it is returned. Null html is an empty payload,
    a null id or address has no header; repeated rows are records each; of no rows, no archive comes.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = file_system(folder)
        path, out, size, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, html, digest, original in zip(*(batch.column(c) for c in ("page", "url", "html", "digest", "original"))):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                member = record(page.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), digest.as_py(), original.as_py())
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [n]})

    return cut(map_batches(with_originals(pages, **columns), run, "path string, bytes long, records long"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of all archives of a folder, for archives from elsewhere."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


class Window:
    """A forward view of a file from an offset, of which only what is still needed is held."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""
        file.seek(at)

    def fill(self) -> bool:
        more = self.file.read(min(BUFFER, self.size - self.at - len(self.held))) if self.at + len(self.held) < self.size else b""
        self.held += more
        return bool(more)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _starts_record(window: Window) -> bool:
    """Whether what the window begins with decodes to a WARC header."""
    while True:
        try:
            start = zlib.decompressobj(31).decompress(window.held[:4096], len(VERSION))
        except zlib.error:
            return False
        if len(start) >= len(VERSION) or len(window.held) >= 4096 or not window.fill():
            return start.startswith(VERSION)


def read_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded records whose members start in [start, end)."""
    window = Window(file, start, size)
    while window.at < end:
        found = window.held.find(MAGIC)
        if found < 0:
            keep = min(len(window.held), len(MAGIC) - 1)
            window.drop(len(window.held) - keep)
            if not window.fill():
                return
            continue
        window.drop(found)
        if window.at >= end:
            return
        if not _starts_record(window):
            window.drop(1)
            continue
        decoder, parts, at = zlib.decompressobj(31), [], window.at
        try:
            while not decoder.eof:
                if not window.held and not window.fill():
                    break
                piece = window.held
                parts.append(decoder.decompress(piece))
                window.drop(len(piece) - len(decoder.unused_data))
        except zlib.error:
            window = Window(file, at + 1, size)  # damaged: look for the next member behind its start
            continue
        if decoder.eof:
            yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The record's headers, names in lower case, and its payload under `payload` (without the HTTP header)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    block = block[: int(out.get("content-length") or 0)]
    if out.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return out | {"payload": block}


TASKS = 100_000
READ = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, stored_digest string, payload binary"


def read(found: DataFrame, range_bytes: int = RANGE, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """The records of archives (path, bytes), read by ranges; digests and sizes are those of the payloads read.

    A revisit stores no payload: its size and digest are those that it declares, its payload is null. A member that
    does not decode to its end is left out, and reading goes on behind its start. Ids are cast to id_type. Of no archives,
    and of empty ones, no rows come. A record is held whole, however long, and one that decodes is never cut; other columns
    of `found` may have any names. Each range is a task's work, up to TASKS of them: a range is many megabytes to read but
    few bytes as a row, by which partitions would be merged.
    """
    n = found.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = found.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)),
        F.lit(range_bytes).cast("long"))).alias("start")).where("bytes > 0")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for raw in read_range(file, size, start, min(start + range_bytes, size)):
                        r = parse_record(raw)
                        own = r["warc-type"] == "response"
                        number = lambda k, r=r: int(r[k]) if r.get(k) else None
                        stored = r.get("warc-payload-digest", "").removeprefix("sha1:")
                        name = lambda k, r=r: unquote(r[k]) if k in r else None
                        rows.append((name("x-page-id"), r.get("warc-target-uri"), r["warc-type"], name("x-refers-to-page"),
                                     len(r["payload"]) if own else number("x-payload-length"), hashlib.sha1(r["payload"]).hexdigest() if own else stored,
                                         stored, r["payload"] if own and payloads else None))
                        held += len(raw)
                        if held > 16 << 20 or len(rows) >= 1000:
                            yield make(rows)
                            rows, held = [], 0
                if rows:
                    yield make(rows)

    rows = map_batches(ranges.repartition(min(int(n), TASKS)), run, READ)
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write(table(spark, sf_dir, "pages"), folder)
    return read(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN k.first > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k.first > page_id THEN k.first END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html AND p.n >= 1000
"""
