"""WARC archives: a writer, and a splittable reader.

The writer puts each record into a gzip member of its own, one archive for each task, under a name of its own for each
attempt; a table with the committed names is written through Spark, so that files of lost or repeated attempts are never read.
The reader's tasks each take a byte range of an archive, look for gzip magic in it, take a place for a member if it decodes to
a WARC version line, and own the records that start inside the range, reading on past its end to finish the last one. A member
that starts with that line and then can't be decoded, ends early or fails its checksum is damaged: an error, never a skipped record.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is a response and others revisit it;
rows with its very id are responses too. Null html counts as empty, a null url leaves the target header out, and a null id is
kept as null: such a row revisits if a row with an id has its payload. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.common import cut, fresh_path

MIN_REVISIT = 100
SPLIT_BYTES = 4 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
_ID = re.compile(r"<urn:page:(-?\d+|null)>")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    body = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple:
    """(page_id, record_type, url, payload_digest, refers_to, payload or None) of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda k: None if (m := _ID.fullmatch(fields.get(k, ""))) is None or m[1] == "null" else int(m[1])
    url, digest = fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), "revisit", url, digest, number("WARC-Refers-To"), None
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    return number("WARC-Record-ID"), "response", url, digest, None, payload


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Unpacked records whose gzip member starts in [start, end) of a seekable file of that size."""
    file.seek(start)
    buf, at = file.read(min(size, end + len(MAGIC) - 1) - start), 0
    while (at := buf.find(MAGIC, at)) >= 0 and start + at < end:
        # the version line alone tells a record from magic that came up by chance
        probe, ahead, head = zlib.decompressobj(31), at, b""
        try:
            while VERSION.startswith(head) and len(head) < len(VERSION) and not probe.eof:
                if ahead >= len(buf):
                    if not (more := file.read(1 << 16)):
                        break
                    buf += more
                head += probe.decompress(probe.unconsumed_tail + buf[ahead : ahead + 512], len(VERSION) - len(head))
                ahead = min(ahead + 512, len(buf))
        except zlib.error:
            head = b""
        if head != VERSION:
            if head and VERSION.startswith(head) and not probe.eof:
                raise EOFError(f"an archive ends inside the record at {start + at}")
            at += 1
            continue
        unpack, ahead, out = zlib.decompressobj(31), at, []
        try:
            while not unpack.eof:
                if ahead >= len(buf):
                    if not (more := file.read(1 << 20)):
                        raise EOFError(f"an archive ends inside the record at {start + at}")
                    buf += more
                out.append(unpack.decompress(buf[ahead : ahead + 65536]))
                ahead = min(ahead + 65536, len(buf))
        except zlib.error as e:
            raise ValueError(f"the record at {start + at} is damaged: {e}") from e
        yield b"".join(out)
        at = ahead - len(unpack.unused_data)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def digests(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pages with payload_bytes, payload_digest, and refers_to for revisits.

    Only ids and digests are aggregated. What is joined is the table of digests that several pages have, and it is written first,
    so that the adaptive planner broadcasts it if it is small and else can split the pages of one digest. Short payloads take no
    part in the join: they are dealt by their number.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    with_digest = pages.withColumns({"payload_bytes": F.octet_length(binary).cast("long"), "payload_digest": F.sha2(binary, 256)})
    shared = with_digest.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select(F.col("payload_digest").alias("key"), "first_id"), "warc-digests")
    key = F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest")).otherwise(F.monotonically_increasing_id().cast("string"))
    return with_digest.withColumn("key", key).join(shared, "key", "left").withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id", "key")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes the archives and returns the table of them: path, size, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        task = TaskContext.get()
        path, size, n, sink = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                data = record(page_id, url, (html or "").encode(), digest, refers_to, refers_to is not None)
                sink.write(data)
                size, n = size + len(data), n + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "n_records": [n]})

    rows = digests(pages.select(id_col, url_col, text_col), id_col, text_col).select(id_col, url_col, text_col, "payload_digest", "refers_to")
    return cut(rows.mapInArrow(run, "path string, size long, n_records long"), "warc-files")


def read_warc(spark: SparkSession, files: DataFrame, folder: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (path, size): page_id, record_type, url, payload_digest, refers_to, payload_bytes (null for revisits) and, if asked for, the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    found, n = [], 0
                    for data in members(file, size, start, min(size, start + split_bytes)):
                        *fields, body = parse(data)
                        found.append((*fields, None if body is None else len(body), body if payload else None))
                        if (n := n + len(data)) > 8 << 20:
                            yield as_batch(found)
                            found, n = [], 0
                    if found:
                        yield as_batch(found)

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())[: 6 + payload]
        names = ("page_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes", "payload")[: 6 + payload]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=list(names))

    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = ranges.count()  # one number; a task for each range
    schema = "page_id long, record_type string, url string, payload_digest string, refers_to long, payload_bytes long" + ", payload binary" * payload
    return ranges.repartition(max(1, n)).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit takes its length from the response that it refers to."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    files = write_warc(pages, folder)
    back = cut(read_warc(spark, files, folder, payload=False), "warc-records")
    responses = back.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("their_bytes"))
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = back.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("their_bytes"))
    return back.where("record_type = 'response'").select(*out).unionByName(revisits.select(*out))
