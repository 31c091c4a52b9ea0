"""WARC archives: a writer of gzip members, one per record, and a salvage reader.

Archives are files of the shared folder, named by part and attempt; the manifest (a Parquet table) names those that
were committed, so a task that is lost leaves only files that nobody reads. The reader checks each record: version
line, lengths, end, payload digest. After a failed check it searches for the next gzip member or version line
that begins a valid record, within an inflated member too, goes on from there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import lookup, parts_for, work_dir, written

#: Payloads from this size on are stored once; an archive is closed when it has so many bytes.
REVISIT_FROM, ARCHIVE_BYTES = 1000, 32 << 20
PART_MB = 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")
VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
#: A record's header block is no longer than this; what is longer isn't one.
MOST_HEADER = 1 << 20
#: Bytes inflated at a time; what the reason of a gzip error begins with after which inflated bytes may be wrong.
PIECE, DAMAGED = 1 << 16, "gzip: "


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of refers_to: the same HTTP head, without the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]+', '%20', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block + END


def member(raw: bytes) -> bytes:
    """One gzip member, the same bytes for the same record."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Bad(Exception):
    """A record that fails a check."""


def stated_sha1(field: str) -> str | None:
    """The SHA-1 that a digest field states, in base32 or hex of either case, as lower-case hex; None for other algorithms or none. Raises Bad."""
    kind, _, value = field.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    try:
        found = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        raise Bad("digest isn't one") from None
    if len(found) != 20:
        raise Bad("digest isn't one")
    return found.hex()


def parse(buf: memoryview | bytes, at: int) -> tuple[dict, int]:
    """The record that begins at `at`, and where it ends. Raises Bad."""
    head = bytes(buf[at : at + 4096])
    if not VERSION.match(head):
        raise Bad("no version line")
    if (cut := head.find(END)) < 0 and (cut := (head := bytes(buf[at : at + MOST_HEADER])).find(END)) < 0:
        raise Bad("header without end")
    fields: dict[str, str] = {}
    for line in head[:cut].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Bad("header line without colon")
        fields[name.strip().lower()] = value.strip()
    if not (size := fields.get("content-length", "")).isdecimal() or len(size) > 18 or "warc-type" not in fields:
        raise Bad("no length or type")
    start = at + cut + 4
    end = start + int(size)
    if bytes(buf[end : end + 4]) != END:
        raise Bad("record without end")
    block = bytes(buf[start:end])
    if (want := stated_sha1(fields.get("warc-block-digest", ""))) and want != hashlib.sha1(block).hexdigest():
        raise Bad("block digest differs")
    kind = fields["warc-type"]
    http, cut2, payload = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
    length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
    digest = hashlib.sha1(payload).hexdigest()
    stated = stated_sha1(fields.get("warc-payload-digest", ""))
    if kind == "revisit":
        digest = stated
    elif stated and stated != digest:
        raise Bad("payload digest differs")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest, "payload_bytes": int(length[1]) if kind == "revisit" and length else len(payload), "payload": payload,
        "digested": bool(want or kind != "revisit" and stated),
    }, end + 4


def inflate(buf: memoryview | bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, where it ends, and "". Of a damaged member the bytes before the error, where it was met, and what it is."""
    z, out, k = zlib.decompressobj(31), [], at
    while not z.eof and k < len(buf):
        piece = bytes(buf[k : k + PIECE])
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            # What the call gave before the error is lost with it: the member is read anew, this piece byte by byte.
            z = zlib.decompressobj(31)
            out, p = [z.decompress(bytes(buf[p : p + PIECE])) for p in range(at, k, PIECE)], k
            try:
                for p in range(k, k + len(piece)):
                    out.append(z.decompress(piece[p - k : p - k + 1]))
            except zlib.error:
                pass
            return b"".join(out), p, f"{DAMAGED}{e}"
        k += len(piece)
    if not z.eof:
        return b"".join(out), k, "gzip member is cut off"
    return b"".join(out), k - len(z.unused_data), ""


def search(raw: bytes, digests: bool) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of an inflated member, and (start, end, reason) of what is between: after a failed check the next valid version line is searched for.

    With digests only records count that state one: others can't be told from damaged ones.
    """
    found, lost, k = [], [], 0
    while k < len(raw):
        try:
            rec, end = parse(raw, k)
            if digests and not rec["digested"]:
                raise Bad("no digest in a damaged member")
            found.append(rec)
        except Bad as e:
            after = VERSION.search(raw, k + 1)
            end = after.start() if after else len(raw)
            if lost and lost[-1][1] == k:
                lost[-1] = (lost[-1][0], end, lost[-1][2])
            else:
                lost.append((k, end, str(e)))
        k = end
    return found, lost


def salvage(buf: memoryview | bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record, start, end, "") of valid records and (None, start, end, reason) of quarantined gaps; every byte is in one of them.

    A member may hold several records. All valid ones are kept, those after a failed one too; each gap between them has
    the member's start and end, and its reason names the inflated bytes. Of a member with a gzip error the bytes before
    the error are searched, and the gap ends at the next valid member; where they may be wrong (not just cut off),
    records must state a digest. An empty file yields nothing.
    """
    at, gap, reason, stop, size = 0, None, "", 0, len(buf)
    held: list[dict] = []  # records of the damaged member that begins the gap
    lost: list[tuple[int, int, str]] = []

    def of_member(start: int, end: int) -> Iterator[tuple[dict | None, int, int, str]]:
        for rec in held:
            yield rec, start, end, ""
        for a, z, why in lost:
            yield None, start, end, f"{why}: inflated bytes {a} to {z}"

    while at < size:
        wrong, some, rest = "", [], []
        try:
            if bytes(buf[at : at + 2]) == b"\x1f\x8b":
                raw, end, wrong = inflate(buf, at)
                some, rest = search(raw, wrong.startswith(DAMAGED))
                if (wrong or rest) and not some:
                    raise Bad(wrong or rest[0][2])
            else:
                rec, end = parse(buf, at)
                some = [rec]
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            if rest and not wrong:  # a sound member without a valid record
                at = end
            else:
                at = next((m.start() for m in START.finditer(buf, at + 1) if m.start() >= stop or m[0][:1] == b"\x1f"), size)
            continue
        if gap is not None:
            yield from of_member(gap, at)
            yield None, gap, at, reason
            gap = None
        held, lost = some, rest
        if wrong:
            # An error can run past the member's end, so members are looked for from its start on; but a version line
            # before the error is one of stored text, which was searched as inflated.
            gap, reason, stop = at, wrong, max(stop, end)
            at = next((m.start() for m in START.finditer(buf, at + 1) if m.start() >= stop or m[0][:1] == b"\x1f"), size)
            continue
        yield from of_member(at, end)
        held, lost, at = [], [], end
    if gap is not None:
        yield from of_member(gap, size)
        yield None, gap, size, reason


def references(rows: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Of rows(page_id, digest, n_bytes), the (page_id, digest, refers_to) that revisit the largest page_id of equal payloads from `least` bytes on.

    Pages that repeat the largest id with the same payload are responses too; a null id refers to the largest id, if any.
    """
    large = rows.where(F.col("n_bytes") >= least)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    several = groups.where("copies > 1")
    n = rows.count()
    # Most payloads are alone: only members of groups go through the look-up.
    found = lookup(large, "digest", several, "copies", n).where(~F.col("page_id").eqNullSafe(F.col("last")))
    return found.select("page_id", "digest", F.col("last").alias("refers_to")).distinct()


ID = "<urn:fathom:page:{}>"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Writes a record per row of pages; returns the manifest (file, records, bytes).

    Null payloads are empty, null urls about:blank; rows that repeat an id are records with one record id, each of
    which is a response or revisit by its own payload. An empty table writes no archives. Other columns are ignored.
    """
    spark = pages.sparkSession
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload"))
    slim = written(page.select("page_id", "digest", F.octet_length("payload").alias("n_bytes")), "digests")
    revisits = written(references(slim, least), "revisits").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to")
    rows = page.join(revisits, page["page_id"].eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        part, attempt, seq, out, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, []
        for b in batches:
            for at in range(b.num_rows):  # a row at a time: payloads aren't copied as a batch
                page_id, url, payload, digest, refers = (c[at].as_py() for c in b.columns)
                if out is None:
                    name = f"pages-{part:06d}-{seq:04d}-{attempt}.warc.gz"
                    seq, out, n, size = seq + 1, fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                raw = member(record(ID.format("" if page_id is None else page_id), url, payload, digest, None if refers is None else ID.format(refers)))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out, made = None, [*made, (name, n, size)]
        if out is not None:
            out.close()
            made.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    made = rows.mapInArrow(run, "file string, records long, bytes long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


RECORDS = "file string, start long, end long, gap string, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long"


def read_archives(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """All records of the archives files(file) and the quarantined gaps (gap is then the reason, and record_type null).

    An archive is memory-mapped where its folder is a mounted one, else read whole; its payloads leave the task only if asked for.
    """
    schema = RECORDS + (", payload binary" if payload else "")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[f.strip().split(" ")[1]]) for n, f in zip(names, schema.split(","), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                if isinstance(fs, pafs.LocalFileSystem):
                    buf = memoryview(pa.memory_map(f"{root}/{name}").read_buffer())
                else:
                    with fs.open_input_file(f"{root}/{name}") as f:
                        buf = memoryview(f.read())
                rows, size = [], 0
                for rec, start, end, gap in salvage(buf):
                    rows.append({"file": name, "start": start, "end": end, "gap": gap or None} | ({k: rec[k] for k in names[4:]} if rec else {}))
                    size += len(rec["payload"]) if rec and payload else 0
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("file").repartition(parts_for(files, 1), "file").mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    page = lambda c: F.regexp_extract(c, "^<urn:fathom:page:(-?[0-9]+)>$", 1).try_cast("long")
    found = read_archives(files, folder).where("record_type IS NOT NULL")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> last THEN last END AS refers_to
FROM m
""",
}
