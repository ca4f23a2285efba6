"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: one record per page, its payload the html in UTF-8 (null: empty). Among equal payloads of at least `min_bytes`
the one with the smallest page_id is a response, others are revisits that refer to it; rows that share that page_id are
all responses, as are all rows of a group without any page_id.

Reading: an archive is dealt out in byte ranges of `CHUNK`, of which a task opens only its own. It emits every offset where a
record might begin, with the offset of its successor; magic inside a payload is such a candidate too. Within a range each
candidate is followed to the offset where its chain leaves the range; pointer jumping over these exits, from offset 0 of
each file, finds the entry of each range, and only records on the chain from there are kept and their payloads read. A
header may have any length, and is read on beyond its range as long as its lines are fields; an archive whose chain
doesn't end at its last byte is an error. Archives are opened through pyarrow's file systems (local, HDFS, S3, GCS).

page_id may be of any type that a text can be cast back to; it is percent-encoded in the record's id, and an id that can't
be read back is an error. Null page_ids and urls become urn:page and urn:none; control characters and spaces in urls are
percent-encoded, each as itself. Empty tables give none. Repeated rows are written and read back each.

Memory: a task holds one range, a header, or a piece of a payload, which is hashed piece by piece; archives may have any size.
The writer begins a new file after as many records as make FILE_BYTES on average, and doesn't shuffle pages for it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import narrow_join
from quillspar.session import drop_path, drop_table, scratch_root, write_table

MAGIC = b"WARC/1."
CHUNK = 4 << 20
#: Ranges of a task, and bytes of a payload that are held at a time.
RANGES, PIECE = 8, 1 << 20
FILE_BYTES = 256 << 20
#: Bytes of a record's header, without its url, as far as the number of files goes.
HEAD_BYTES = 500
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes at a time as eight digits of base 32, in the RFC 4648 alphabet."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def plain_url(url: Column) -> Column:
    """The url with its control characters and spaces percent-encoded; a null one is urn:none."""
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(url, F.lit("urn:none"))


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, the text of each page's record without the four bytes that end it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": base32_sha1(F.encode("html", "UTF-8"))})
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    groups = write_table(groups.filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "copies")
    rows = narrow_join(rows, groups, ["digest"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("size") >= min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("first_id"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain_url(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    return rows.select(F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write archives with Spark's own committer, so that lost executors' tasks are simply run again."""
    size, n = pages.select(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))), F.count("*")).first()
    most = max(1, n * file_bytes // ((size or 0) + n * HEAD_BYTES + 1))
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
_VERSION = re.compile(rb"WARC/1\.\d+\r\n")
_BREAK = END.encode()


class Archive:
    """One archive, read by ranges; the range last read is kept."""

    def __init__(self, path: str, length: int):
        system, at = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        self.file, self.length, self.start, self.data = system.open_input_file(at), length, 0, b""

    def hold(self, start: int, stop: int) -> None:
        self.start = max(0, start)
        self.data = self.file.read_at(min(stop, self.length) - self.start, self.start)

    def bytes(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.length)
        if self.start <= start and stop <= self.start + len(self.data):
            return self.data[start - self.start : stop - self.start]
        return self.file.read_at(max(0, stop - start), start)

    def header(self, at: int) -> bytes | None:
        """The header that begins at `at`, the blank line after it included; None if what stands there is none."""
        inside = self.data.find(_BREAK, at - self.start)
        if inside >= 0:
            return self.data[at - self.start : inside + 4]
        size, seen, line = 1 << 16, b"", 0
        while True:
            seen = self.bytes(at, at + size)
            stop = seen.find(_BREAK)
            ended = at + len(seen) >= self.length
            whole = seen if stop < 0 else seen[: stop + 2]
            while (end := whole.find(b"\n", line)) >= 0:  # lines must be fields, so a payload isn't read to its end
                now = whole[line:end]
                if not (_VERSION.fullmatch(now + b"\n") if line == 0 else b":" in now or now[:1] in (b" ", b"\t")):
                    return None
                line = end + 1
            if stop >= 0:
                return seen[: stop + 4]
            if ended:
                return None
            size *= 2

    def payload(self, body: int, end: int) -> tuple[int, str]:
        """Bytes and digest of what follows the first blank line of a body, of the whole body if it has none."""
        begins, tail = body, b""
        for at in range(body, end, PIECE):
            piece = tail + self.bytes(at, min(at + PIECE, end))
            if (k := piece.find(_BREAK)) >= 0:
                begins = at - len(tail) + k + 4
                break
            tail = piece[-3:]
        digest = hashlib.sha1()
        for at in range(begins, end, PIECE):
            digest.update(self.bytes(at, min(at + PIECE, end)))
        return end - begins, base64.b32encode(digest.digest()).decode()


def parse_candidate(archive: Archive, at: int) -> tuple[int, int, dict] | None:
    """The body, the successor and the fields of the record that might begin at `at`, or None if it can't be one."""
    if at and archive.bytes(at - 4, at) != _BREAK:
        return None
    header = archive.header(at)
    if header is None:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(header)}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    body = at + len(header)
    after = body + int(length) + 4
    if after > archive.length or after == archive.length and archive.bytes(after - 4, after) != _BREAK:
        return None  # what ends other records is seen before their successors
    return body, after, fields


def _page(urn: bytes | None) -> str | None:
    """The page_id in a record's id; an id of another kind as it stands."""
    text = (urn or b"").decode("latin1")
    found = re.fullmatch(r"<urn:page(?::(.*))?>", text)
    return (found[1] if found[1] is None else unquote_plus(found[1])) if found else text


RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_RECORD = pa.struct([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
_FOUND = pa.struct([*_RECORD, ("body", pa.int64())])
_CHUNK = pa.schema([("path", pa.string()), ("length", pa.int64()), ("chunk", pa.int64()), ("offs", pa.list_(pa.int64())), ("nexts", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64())), ("found", pa.list_(_FOUND))])
CHUNKS = f"path string, length long, chunk long, offs array<long>, nexts array<long>, exits array<long>, found array<struct<{RECORD.replace(' ', ':').replace(',:', ',')},body:long>>"


def _candidates(chunk: int):
    """Per range of an archive: its candidates, their successors, and where each one's chain leaves the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, k in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "chunk")), strict=True):
                archive = Archive(path, length)
                first, stop = k * chunk, min((k + 1) * chunk, length)
                archive.hold(first - 4, stop + len(MAGIC) - 1)
                offs, nexts, found = [], [], []
                at = archive.data.find(MAGIC, first - archive.start)
                while at >= 0:
                    off = archive.start + at
                    if got := parse_candidate(archive, off):
                        body, after, fields = got
                        kind = fields[b"warc-type"].decode("latin1")
                        stated = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin1")
                        refers = _page(fields.get(b"warc-refers-to")) if kind == "revisit" else None
                        offs.append(off)
                        nexts.append(after)
                        found.append((_page(fields.get(b"warc-record-id")), int(fields.get(b"x-payload-length", b"0") or 0), stated, kind, refers, body))
                    at = archive.data.find(MAGIC, at + 1)
                if offs:
                    exits: dict[int, int] = {}
                    for off, after in zip(reversed(offs), reversed(nexts), strict=True):
                        exits[off] = after if after // chunk != k else exits.get(after, after)
                    rows = {"path": [path], "length": [length], "chunk": [k], "offs": [offs], "nexts": [nexts], "exits": [[exits[o] for o in offs]], "found": [[dict(zip((f.name for f in _FOUND), r, strict=True)) for r in found]]}
                    yield from pa.table(rows, schema=_CHUNK).to_batches()

    return run


def _walked(chunk: int):
    """The records on the chain from a range's entry; the payloads of responses are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                archive, rows = Archive(r["path"], r["length"]), []
                archive.hold(r["chunk"] * chunk, (r["chunk"] + 1) * chunk)
                where = {o: k for k, o in enumerate(r["offs"])}
                at = r["entry"]
                while at in where:
                    record = r["found"][where[at]]
                    body, at = record.pop("body"), r["nexts"][where[at]]
                    if record["record_type"] == "response":
                        record["payload_bytes"], record["payload_digest"] = archive.payload(body, at - 4)
                    rows.append(record)
                yield pa.RecordBatch.from_struct_array(pa.array(rows, _RECORD))

    return run


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """(path, entry) of each chunk on a file's chain, by pointer jumping from offset 0 over the candidates' exits."""
    jumps = chunks.select("path", F.explode(F.arrays_zip("offs", "exits")).alias("x")).select("path", F.col("x.offs").alias("entry"), F.col("x.exits").alias("to"))
    jumps = write_table(jumps, "jumps")
    reached = write_table(jumps.filter("entry = 0").select("path", "entry"), "reached")
    n = reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "entry"]).select("path", F.col("to").alias("entry"))
        wider = write_table(reached.union(ahead).distinct(), "reached")
        m = wider.count()
        drop_table(reached)
        reached = wider
        if m == n:
            drop_table(jumps)
            return reached
        n = m
        second = jumps.select("path", F.col("entry").alias("to"), F.col("to").alias("then"))
        doubled = write_table(jumps.join(second, ["path", "to"], "left").select("path", "entry", F.coalesce("then", "to").alias("to")), "jumps")
        drop_table(jumps)
        jumps = doubled


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`: page_id, payload_bytes, payload_digest, record_type, refers_to; ids as text."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / CHUNK))).alias("chunk"))
    tasks = 1 + ranges.count() // RANGES
    chunks = write_table(ranges.repartition(tasks, "path", "chunk").mapInArrow(_candidates(CHUNK), CHUNKS), "chunks")
    entries = chunk_entries(chunks)
    ends = files.select("path", F.col("length").alias("entry"))
    if broken := ends.join(entries, ["path", "entry"], "left_anti").first():
        raise ValueError(f"archive of {broken.entry} bytes whose records don't reach its end: {broken.path}")
    entries = entries.withColumn("chunk", F.floor(F.col("entry") / CHUNK).cast("long"))
    reached = chunks.join(entries, ["path", "chunk"]).select("path", "length", "chunk", "offs", "nexts", "found", "entry")
    return reached.repartition(tasks, "path", "chunk").mapInArrow(_walked(CHUNK), RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive the pages in the scratch folder and return what reading the archives gives."""
    spark = pages.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/quillspar/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    found = write_table(read_archives(spark, path), "records")
    drop_path(spark, path)
    kind = pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


_DIGITS = " || ".join(f"to_base(('0x' || substr(sha1(coalesce(html, '')), {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4))
ORACLE = f"""
WITH hashed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM firsts
"""
