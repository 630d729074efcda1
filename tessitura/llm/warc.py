"""WARC archives with an index that comes first.

Writers put records into archives in a shared folder and return one index row
per record: archive, offset, length, URL and digest. Readers select from the
index, coalesce neighbouring byte ranges of an archive and fetch each range
with one read.

Of equal payloads of ``REVISIT_BYTES`` or more one record is a response and
the others are revisits: headers alone, that name the response, the payload's
digest and its length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbers, shared_dir, slices

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: Ranges that lie no farther apart are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2020-01-01T00:00:00Z"


def classify(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload, digest, record_type and refers_to to pages.

    Of the pages with one payload of ``least`` bytes or more, that with the
    largest page_id is the response. A null payload counts as empty. Null ids
    are never the largest unless all are null; rows that repeat the largest
    id are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = first.where("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= least)
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def _plain(value: str) -> str:
    """A header's value in one line."""
    return re.sub(r"[\r\n]+", " ", value)


def _urn(page_id) -> str:
    """The name of a page's record. Every sign that a header can't hold is escaped, so the id can be read back."""
    return f"<urn:x-page:{quote('' if page_id is None else str(page_id), safe='')}>"


def _id(urn: str) -> str | None:
    return unquote(urn[len("<urn:x-page:") : -1]) if urn else None


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP header alone as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        *([] if url is None else [("WARC-Target-URI", _plain(url))]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of the record that ``data`` holds."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and their index; returns the index as read back.

    Every attempt of a task names its archives anew and the index holds those
    of the attempts that counted, so a task that is run again leaves archives
    that nothing refers to, and no wrong rows.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"archive string, offset long, length long, url string, digest string, page_id {kind}, record_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, offset, rows = None, "", 0, []
        arrow = pa.int64()

        def index() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), arrow, pa.string()]
            names = ["archive", "offset", "length", "url", "digest", "page_id", "record_type"]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, types, strict=True)], names=names)

        for batch in slices(batches, "payload"):
            arrow = batch.schema.field("page_id").type
            columns = [numbers(batch, x) for x in ("page_id", "url", "payload", "digest", "record_type", "refers_to")]
            for page, url, payload, digest, what, refers in zip(*columns, strict=True):
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # members are gzipped already
                data = record(page, url, payload, digest, what, refers)
                out.write(data)
                rows.append((name, offset, len(data), url, digest, page, what))
                offset += len(data)
                if offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield index()
        if out is not None:
            out.close()
        if rows:
            yield index()

    found = classify(pages).mapInArrow(run, schema)
    return materialise(found.withColumn("folder", F.lit(folder)), "warc-index")


def ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Coalesces the selected records of each archive into sorted byte ranges.

    A range starts where the gap to the record before is over ``gap``, and in
    each stretch of ``most`` bytes.
    """
    order = Window.partitionBy("folder", "archive").orderBy("offset")
    ends = F.lag(F.col("offset") + F.col("length")).over(order)
    stretch = F.floor(F.col("offset") / most)
    starts = ends.isNull() | (F.col("offset") - ends > gap) | (stretch != F.lag(stretch).over(order))
    numbered = selected.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    return numbered.groupBy("folder", "archive", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length", "page_id"))).alias("records")
    )


def read(selected: DataFrame) -> DataFrame:
    """Fetches and parses the selected records: one row per record.

    Returns page_id, url, record_type, refers_to, digest, payload_bytes (of the
    full payload, for revisits from their HTTP header), payload (null for
    revisits) and ``intact``: whether the payload has the digest. A page
    without a URL has none here either; line breaks in a URL become blanks;
    ids may hold any signs. Nothing selected gives no rows.
    """
    kind = selected.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, record_type string, refers_to {kind}, digest string, payload_bytes long, payload binary, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None, "")
        for batch in batches:
            arrow = batch.schema.field("records").type.value_type.field("page_id").type
            columns = [numbers(batch, x) for x in ("folder", "archive", "start", "stop", "records")]
            for folder, archive, start, stop, records in zip(*columns, strict=True):
                if opened[0] != folder:
                    opened = (folder, *pafs.FileSystem.from_uri(folder))
                with opened[1].open_input_file(f"{opened[2]}/{archive}") as source:
                    source.seek(start)
                    data = source.read(stop - start)
                rows = []
                for r in records:
                    at = r["offset"] - start
                    fields, http, payload = parse(data[at : at + r["length"]])
                    digest, what = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    own = what != "revisit"
                    rows.append((r["page_id"], fields.get("WARC-Target-URI"), what, _id(fields.get("WARC-Refers-To", "")), digest, size, payload if own else None, hashlib.sha1(payload).hexdigest() == digest and len(payload) == size if own else None))
                got = list(zip(*rows, strict=True))
                refers = pa.array(got[3], type=pa.string()).cast(arrow)
                types = [arrow, pa.string(), pa.string(), None, pa.string(), pa.int64(), pa.binary(), pa.bool_()]
                arrays = [refers if t is None else pa.array(x, type=t) for x, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload", "intact"])

    tasks = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows name many bytes, so tasks aren't merged by their size
    spread = ranges(selected).repartition(tasks, "folder", "archive", "run")
    return spread.mapInArrow(run, schema)
