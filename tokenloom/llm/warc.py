"""WARC archives: a writer with one gzip member per record and a splittable reader.

Reading: each task takes byte ranges of archives.  It looks for the gzip magic from the start of its range,
takes a candidate for a member only if it decodes to the header of a WARC record, and owns every record
that starts inside its range, also if it ends beyond.  A record is checked against its lengths and, where
it carries the payload, its digest.

Files are opened through pyarrow's file systems by the URI of the shared folder, so any store that executors
reach will do.  A task writes under a name of its attempt and renames the file when it is complete: a
repeated task leaves one archive with the same records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ready
from tokenloom.session import materialise, scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20     # bytes of one range
READERS = 100_000   # reading tasks at most; beyond that a task takes several ranges
READ = 1 << 18      # bytes of one read
HEADER = 1 << 16    # decoded bytes in which a record's header has to end
LEVEL = 3           # gzip level

RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: " ".join(str(v).split())
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def encode_record(page_id, url, refers_to, digest: str, length: int, payload: bytes | None) -> bytes:
    """One gzip member; ``payload`` is None for a revisit, which stores none."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    kind = "response" if payload is not None else "revisit"
    block = payload or b""
    head = _header([
        ("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id), ("X-Payload-Length", length),
        ("WARC-Refers-To", name(refers_to) if payload is None else None), ("X-Refers-To-Page", refers_to),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None),
        ("Content-Type", "text/html"), ("Content-Length", len(block))])
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return coder.compress(head) + coder.compress(block) + coder.compress(b"\r\n\r\n") + coder.flush()


def _writer(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        at = TaskContext.get()
        final = f"{root}/part-{at.partitionId():05d}.warc.gz"
        draft = f"{root}/.attempt-{at.taskAttemptId()}-{uuid.uuid4().hex}"
        size = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for record in _records(batch):
                    size += out.write(record)
        store.move(draft, final)
        yield pa.record_batch({"path": pa.array([final]), "size": pa.array([size], pa.int64())})
    return task


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id, url, html``) and returns ``(path, size)`` of the archives.

    Rows with equal payloads of ``least`` bytes or more are one response, that of the largest page id, and
    revisits to it; of rows that tie, any one.  Null html is an empty payload.  A null page id is smaller than any other.
    """
    ready(pages)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("bytes"), F.sha1(payload).alias("sha1"))
    # Settled on ids and digests; payloads move once.  Exact repeats of a head are one row with a count.
    heads = materialise(rows.groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
                        .where((F.col("n") > 1)), "payloads")
    joined = rows.join(heads, "sha1", "left")
    alone = F.col("n").isNull() | (F.col("bytes") < least)
    head = ~alone & F.col("page_id").eqNullSafe(F.col("head"))
    rest = joined.where(~head).withColumn("payload", F.when(alone, F.col("payload"))).withColumn("copies", F.lit(1).cast("bigint"))
    tops = (joined.where(head).groupBy("sha1", "page_id", "head", "n", "bytes")
            .agg(F.first("payload").alias("payload"), F.first("url").alias("url"), F.count("*").alias("copies")))
    columns = ["page_id", "url", "head", "sha1", "bytes", "payload", "copies"]
    records = rest.select(*columns).union(tops.select(*columns))
    return materialise(records.mapInArrow(_writer(uri_of(folder)), "path string, size long"), "archives")


def _records(batch: pa.RecordBatch) -> Iterator[bytes]:
    for r in batch.to_pylist():
        digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
        for k in range(r["copies"]):
            payload = r["payload"] if k == 0 else None
            yield encode_record(r["page_id"], r["url"], None if payload is not None else r["head"], digest, r["bytes"], payload)


def uri_of(folder: str) -> str:
    return folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"


def parse_header(text: bytes) -> dict[str, str] | None:
    """Fields of a WARC header (names in lower case), or None if it isn't one."""
    head, end, _ = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields if fields.get("warc-type") and fields.get("content-length", "").isdigit() else None


def _member(source, data: bytearray, at: int) -> tuple[dict, bytes, int] | None:
    """Header, block and end of the member at ``data[at]``, read on from ``source`` as needed; None if it is no record."""
    coder, out, used, fields = zlib.decompressobj(31), bytearray(), at, None
    while not coder.eof:
        if used == len(data):
            more = source.read(READ)
            if not more:
                return None
            data += more
        piece = bytes(data[used:used + READ])
        try:
            out += coder.decompress(piece)
        except zlib.error:
            return None
        used += len(piece) - len(coder.unused_data)
        if fields is None and (b"\r\n\r\n" in out or coder.eof or len(out) > HEADER):
            fields = parse_header(bytes(out))
            if fields is None:
                return None
    begin = out.find(b"\r\n\r\n") + 4
    size = int(fields["content-length"])
    if len(out) != begin + size + 4 or out[-4:] != b"\r\n\r\n":
        return None
    return fields, bytes(out[begin:begin + size]), used


def records_of(source, start: int, end: int) -> Iterator[tuple[dict, bytes]]:
    """Records that start in ``[start, end)`` of an open archive."""
    source.seek(start)
    data, base, at = bytearray(), start, 0   # data[0] is byte ``base`` of the archive
    while base + at < end:
        while len(data) - at < len(MAGIC):
            more = source.read(READ)
            if not more:
                return
            data += more
        found = data.find(MAGIC, at)
        if found < 0:
            at = len(data) - len(MAGIC) + 1   # a magic may begin in the last bytes
            del data[:at]
            base, at = base + at, 0
            data += source.read(READ) or b""
            if len(data) < len(MAGIC):
                return
            continue
        if base + found >= end:
            return
        member = _member(source, data, found)
        if member is None:
            at = found + 1
            continue
        yield member[0], member[1]
        del data[:member[2]]
        base, at = base + member[2], 0


def _reader(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(folder)[0]
        number = lambda v: int(v) if v not in (None, "") else None
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(split["path"]) as source:
                    for fields, block in records_of(source, split["start"], split["end"]):
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        if fields["warc-type"] == "response" and payload_digest(block) != digest:
                            raise ValueError(f"damaged payload in {split['path']}, page {fields.get('x-page-id')}")
                        rows.append({
                            "page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
                            "refers_to": number(fields.get("x-refers-to-page")), "payload_digest": digest,
                            "payload_bytes": len(block) if fields["warc-type"] == "response" else int(fields["x-payload-length"]),
                            "payload": block if fields["warc-type"] == "response" else None})
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
    return task


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Records of ``archives`` (``path, size``) below ``folder``; an archive is read by as many tasks as it has ranges.

    Returns ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``; a revisit has no
    payload, its length is that of the payload it stands for.
    """
    ready(archives)
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end"))
    # The rows are tiny, the work is not: a given number of partitions, which adaptive execution leaves as it is,
    # and dealt in turn, since few keys of a hash would share some of them.
    tasks = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    return ranges.repartition(min(int(tasks), READERS)).mapInArrow(_reader(uri_of(folder)), RECORDS)


def round_trip(pages: DataFrame, least: int = 0, split: int = SPLIT) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least), folder, split)
