"""WARC archives: a writer of gzip members with revisits for repeated payloads, and a reader that salvages what it can.

The reader checks each record (version line, headers, lengths, CRC of the member, block digest). After a failed check it
searches for the next gzip member or version line that passes, goes on from there, and reports the bytes between as a gap.
A record whose headers are longer than HEAD_BYTES fails its checks.

Edge cases: a null payload is empty. Records with equal payloads of REVISIT_BYTES or more: those with the smallest id are
responses, the others revisit; a row that repeats id and payload is a response each time; a null id is never the smallest
unless all are null. An empty table writes no archive and reads back no rows. Null URLs are left out of the headers; line
ends in URLs are percent-encoded. Columns other than id, url and payload are not read.
"""

from __future__ import annotations

import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import HOT_PART, scratch_path, written

LOG = logging.getLogger(__name__)
SHOWN_GAPS = 20  # in the log's text; all are in the table

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20  # an archive is closed at the first record beyond; a task writes as many as it needs
READ_BYTES = 1 << 20
HEAD_STEP, HEAD_BYTES = 1 << 14, 1 << 28  # headers are looked for in steps, as far as this
FLUSH_BYTES = 8 << 20  # of found records that a task holds
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "archive string, offset long, record_id string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to_id string"


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None, is_response: bool) -> bytes:
    """One record, not compressed. first: the id of the page whose record a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if not is_response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compress: bool = True) -> DataFrame:
    """Writes archives into folder and returns their list (archive, bytes, records), itself a written table.

    A task names its archives anew at each attempt and the list comes from Spark's committed output, so what a lost
    executor has half written is never read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_BYTES
    counts = rows.groupBy("digest").agg(F.min(F.when(long, F.col("id"))).alias("first"), F.count(F.lit(1)).alias("n"), F.max(long).alias("again"))
    counts = written(counts.where("n > 1").select(F.col("digest").alias("d"), "first", "n", "again"), "repeated")
    # A payload that more than one in HOT_PART pages has goes to every task with its first page, so no task gets all of its
    # pages: HOT_PART rows at most. Pages of other repeated payloads meet in a shuffle, those of single ones don't matter.
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT_PART > total).drop("n"))
    cold = counts.where(F.col("n") * HOT_PART <= total).drop("n")
    told = rows.join(hot, F.col("digest") == F.col("d"))
    told = told.unionByName(rows.join(hot, F.col("digest") == F.col("d"), "left_anti").join(cold, F.col("digest") == F.col("d"), "left"))
    is_response = ~F.coalesce("again", F.lit(False)) | F.col("id").eqNullSafe(F.col("first"))
    told = told.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"), is_response.alias("is_response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["archive", "bytes", "records"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                data = record(*(x.as_py() for x in row))
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(data) if compress else data
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(told.mapInArrow(run, "archive string, bytes long, records long"), "archives").select(F.concat(F.lit(folder.rstrip("/") + "/"), "archive").alias("archive"), "bytes", "records")


class Tape:
    """An archive's bytes from any position on, held only as far as they are needed."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size, self.at, self.held = stream, size, 0, bytearray()

    def need(self, n: int) -> int:
        """Holds n bytes from here on, fewer at the end; returns how many there are."""
        while len(self.held) < n and (got := self.stream.read(max(READ_BYTES, n - len(self.held)))):
            self.held += got
        return min(n, len(self.held))

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n


class Bad(ValueError):
    pass


def parse(data: bytes | bytearray, more: Callable[[int], int] | None = None) -> tuple[dict[str, str], int, int]:
    """Headers, block's place and length of the record at the start of data. more(n): makes data hold n bytes and returns
    how many there are; without it data is all there is. Headers may be as long as HEAD_BYTES."""
    if more is not None:
        more(len("WARC/1.1\r\n"))
    if not VERSION.match(data):
        raise Bad("no version line")
    seen, want = 0, HEAD_STEP
    while True:
        there = more(want) if more is not None else len(data)
        end = data.find(b"\r\n\r\n", max(0, seen - 3), min(there, HEAD_BYTES))
        if end >= 0:
            break
        if more is None or there < want or there >= HEAD_BYTES:
            raise Bad("headers do not end")
        seen, want = there, 4 * want
    headers: dict[str, str] = {}
    for line in bytes(data[:end]).split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header without a colon")
        name = key.strip().lower().decode("utf-8", "replace")
        if name in headers and name != "warc-concurrent-to":
            raise Bad("a header repeats")  # a record cut inside its headers, and the next one's behind them
        headers[name] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Bad("no length")
    return headers, end + 4, int(headers["content-length"])


def checked(whole: bytes, headers: dict[str, str], start: int, length: int) -> bytes:
    """The block, if the record ends as it should and its digest holds."""
    block = whole[start : start + length]
    if len(block) < length or whole[start + length : start + length + 4] != b"\r\n\r\n":
        raise Bad("the record is cut or its length is wrong")
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise Bad("the block's digest differs")
    return block


def at_member(tape: Tape) -> tuple[dict[str, str], bytes, int]:
    """The gzip member at the tape's place: headers, block, bytes on the tape. It is inflated step by step, and no further
    than its record's own length says, so a small member can't fill the memory."""
    z, out, used, head = zlib.decompressobj(31), bytearray(), 0, None
    while not z.eof:
        part = z.unconsumed_tail
        if not part:
            if tape.need(used + 1) <= used:
                raise Bad("the member is cut")
            part = bytes(tape.held[used : used + READ_BYTES])
            used += len(part)
        try:
            out += z.decompress(part, READ_BYTES)
        except zlib.error as e:
            raise Bad("the member is damaged") from e
        if head is None and (out.find(b"\r\n\r\n") >= 0 or len(out) > HEAD_BYTES):
            head = parse(out)
        if head is not None and len(out) > head[1] + head[2] + 4:
            raise Bad("the member's length is wrong")
    used -= len(z.unused_data)
    headers, start, length = head or parse(out)
    if len(out) != start + length + 4:
        raise Bad("the member's length is wrong")
    return headers, checked(bytes(out), headers, start, length), used


def at_line(tape: Tape) -> tuple[dict[str, str], bytes, int]:
    """The record in plain bytes at the tape's place."""
    headers, start, length = parse(tape.held, tape.need)
    whole = start + length + 4
    if tape.at + whole > tape.size or tape.need(whole) < whole:
        raise Bad("the record is cut or its length is wrong")
    return headers, checked(bytes(tape.held[:whole]), headers, start, length), whole


def salvage(stream, size: int) -> Iterator[tuple]:
    """("record", offset, headers, block) and ("gap", offset, bytes, reason) of one archive, in order, covering all of it."""
    tape, gap, reason = Tape(stream, size), None, ""
    while tape.need(len(MEMBER)) > 0:
        try:
            found = at_member(tape) if tape.held[: len(MEMBER)] == MEMBER else at_line(tape)
        except Bad as e:
            if gap is None:
                gap, reason = tape.at, str(e)
            tape.skip(1)
            while True:  # to the next place that looks like a start
                n = tape.need(READ_BYTES)
                view = bytes(tape.held[:n])
                places = [p for p in (view.find(MEMBER), view.find(b"WARC/1.")) if p >= 0]
                if places:
                    tape.skip(min(places))
                    break
                tape.skip(n if n < READ_BYTES else n - 8)
                if n < READ_BYTES:
                    break
            continue
        if gap is not None:
            yield "gap", gap, tape.at - gap, reason
            gap = None
        headers, block, used = found
        yield "record", tape.at, headers, block
        tape.skip(used)
    if gap is not None:
        yield "gap", gap, tape.at - gap, reason


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers."""
    return block.partition(b"\r\n\r\n")[2]


def told_of(offset: int, headers: dict[str, str], block: bytes) -> tuple:
    """A record's fields of ENTRY behind the archive, and its payload."""
    payload = payload_of(block)
    kind = headers.get("warc-type")
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers.get("warc-payload-digest", "").partition(":")[2]
    size = len(payload) if kind == "response" else None
    return offset, headers.get("warc-record-id"), kind, headers.get("x-page-id"), headers.get("warc-target-uri"), size, digest, headers.get("warc-refers-to"), payload


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of archives (archive, bytes) in one pass: the columns of ENTRY[, payload] of a record that passes its
    checks, gap_bytes and reason null; or, for a run of quarantined bytes, archive, offset, gap_bytes and reason alone."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ENTRY + ", payload binary" * with_payload + ", gap_bytes long, reason string"
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary() if c.endswith("binary") else pa.string()) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for found, *rest in salvage(stream, size):
                        if found == "gap":
                            rows.append({"archive": uri} | dict(zip(("offset", "gap_bytes", "reason"), rest)))
                        else:
                            rows.append(dict(zip(names, (uri, *told_of(*rest)[: None if with_payload else -1]))))
                        held += sum(len(x) for x in rows[-1].values() if isinstance(x, (str, bytes))) + 200
                        if held >= FLUSH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.select("archive", "bytes").repartition(n).mapInArrow(run, schema)


def records_of(read: DataFrame) -> DataFrame:
    return read.where("gap_bytes IS NULL").drop("gap_bytes", "reason")


def gaps_of(read: DataFrame) -> DataFrame:
    """Runs of quarantined bytes: archive, gap_start, gap_bytes, reason."""
    return read.where("gap_bytes IS NOT NULL").select("archive", F.col("offset").alias("gap_start"), "gap_bytes", "reason")


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record that passes its checks; payload_bytes and payload_digest are of the bytes read. archives: (archive, bytes)."""
    return records_of(read_archives(archives, with_payload))


def read_gaps(archives: DataFrame) -> DataFrame:
    """A row per run of quarantined bytes: archive, gap_start, gap_bytes, reason."""
    return gaps_of(read_archives(archives))


def logged(gaps: DataFrame) -> DataFrame:
    """gaps, after a warning for each of the first few; the table itself is the whole log."""
    first = gaps.limit(SHOWN_GAPS + 1).collect()
    for r in first[:SHOWN_GAPS]:
        LOG.warning("%s: %d bytes from %d on quarantined: %s", r["archive"], r["gap_bytes"], r["gap_start"], r["reason"])
    if len(first) > SHOWN_GAPS:
        LOG.warning("and %d further gaps", gaps.count() - SHOWN_GAPS)
    return gaps


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, bytes) of the archives that others have put into folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def resolved(records: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with the size of the payload that
    they refer to and its page. records is read twice, so pass a written one."""
    to = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("to_id")).agg(F.min("payload_bytes").alias("to_bytes"), F.min("page_id").alias("to_page"))
    found = records.join(to, records["refers_to_id"] == to["to_id"], "left")
    is_revisit = F.col("record_type") == "revisit"
    return found.select("page_id", F.when(is_revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(is_revisit, F.col("to_page")).alias("refers_to"), "url")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder, read back in one pass; what of them can't be read is logged, and the pages of
    those records are missing from the result."""
    spark = pages.sparkSession
    read = written(read_archives(write_archives(pages, scratch_path(spark, "warc"))), "records")
    logged(gaps_of(read))
    kind = pages.schema["page_id"].dataType
    back = resolved(records_of(read))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
