"""WARC archives, index first: offset, length, URL and digest of each record, then coalesced range reads.

``write_archives`` writes a record per page, each a gzip member of its own, and
the index as a Parquet table. Of pages with equal payloads, the one with the
largest page_id is a ``response`` record with the payload and the others are
``revisit`` records that refer to it; payloads below ``min_bytes`` are all
responses. That is decided on digests alone: the copies of a payload are counted
in SALTS parts first, and only a page's own decision meets its body, by (page_id,
digest), so no task gets all copies of one payload. ``read_records`` sorts the
wanted index rows by file and offset, joins neighbouring byte ranges into reads
of bounded size, and parses one record at a time. Archives are written and read
with pyarrow's file systems, so any store that Spark and pyarrow share will do.

Memory: a writer holds WRITE bytes of bodies, a reader READ compressed and YIELD
inflated bytes, and either at least one record. An archive's name carries its
task attempt; the index lists only what committed attempts wrote, so lost
executors and repeated tasks leave unlisted files and no wrong rows.

Null html is an empty payload, very long html one record, an empty table no
record. Rows that repeat a page_id with the same payload are all responses
(there is no other page to refer to). A null page_id counts as the smallest: it
refers to the page with the largest id, and is a response if no page has one.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import pieces, scratch

#: Ranges nearer than GAP are read together, up to READ bytes at once; an archive ends after FILE bytes.
GAP, READ, FILE = 64 << 10, 4 << 20, 256 << 20
#: Bytes of bodies that a writer turns into records at once, and of payloads in a batch that a reader returns.
WRITE, YIELD = 1 << 20, 4 << 20
#: Compressed bytes for a reading task; parts in which the copies of a payload are counted.
TASK, SALTS = 16 << 20, 16


def record_id(page_id: int | None) -> str:
    """A urn:uuid that holds the id: its low 64 bits, with a bit above them unless it is null."""
    return f"<urn:uuid:{uuid.UUID(int=0 if page_id is None else 1 << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    low = n & (1 << 64) - 1
    return None if n >> 64 == 0 else low - (1 << 64) if low >> 63 else low


def open_store(url: str):
    """pyarrow's file system for a URL, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return whole if "://" in whole else whole.replace("file:/", "file:///", 1)


def clean_header(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; payload None: a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean_header(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """Headers and payload of one uncompressed record; raises ValueError if its lengths or digest don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": n, "payload_digest": digest,
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def revisits(slim: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages (page_id, sha1, n) that repeat a payload of a page with a larger id."""
    long = slim.where(F.col("n") >= min_bytes).select("page_id", "sha1", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = long.groupBy("sha1", "salt").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("least"), F.max(F.col("page_id").isNull()).alias("unnamed"))
    shared = parts.groupBy("sha1").agg(F.max("keep").alias("refers_to"), F.min("least").alias("least"), F.max("unnamed").alias("unnamed"))
    shared = shared.where((F.col("least") < F.col("refers_to")) | (F.col("unnamed") & F.col("refers_to").isNotNull()))
    each = shared.select("sha1", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = long.join(each, ["sha1", "salt"])
    return named.where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives and their index under ``path``; returns the index."""
    spark = pages.sparkSession
    store = qualified(spark, path or scratch(spark, "warc"))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("n", F.octet_length("html").cast("long"))
    again = revisits(rows.select("page_id", "sha1", "n"), min_bytes).withColumnsRenamed({"page_id": "page", "sha1": "digest"})
    decided = rows.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("sha1") == F.col("digest")), "left")
    slim = decided.select("page_id", "url", "n", "sha1", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = open_store(f"{store}/archives")
        out, made, offset, name = None, 0, 0, ""
        try:
            for part in (part for batch in batches for part in pieces(batch, "html", WRITE)):
                index = []
                for page, url, n, sha1, keep, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "n", "sha1", "refers_to", "html")), strict=True):
                    if out is None or offset >= FILE:
                        if out is not None:
                            out.close()
                        if not made:
                            fs.create_dir(root, recursive=True)
                        name, offset, made = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:03d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, made + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(sha1).decode()
                    member = gzip_member(record(page, url, None if html is None else html.encode(), n, digest, keep))
                    out.write(member)
                    index.append((page, clean_header(url), name, offset, len(member), digest, "response" if html is not None else "revisit"))
                    offset += len(member)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    slim.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{store}/index")
    return spark.read.schema(INDEX).parquet(f"{store}/index").withColumn("file", F.concat(F.lit(f"{store}/archives/"), "file"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(f.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the given index rows (any subset of an index)."""
    schema = RECORD + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        current, source = None, None

        def read() -> Iterator[pa.RecordBatch]:
            base, end = held[0][0], held[-1][0] + held[-1][1]
            source.seek(base)
            data = memoryview(source.read(end - base))
            found, size = [], 0
            for o, n in held:
                r = parse_record(zlib.decompress(data[o - base : o - base + n], 31))
                found.append(tuple(r[k] for k in names))
                size += len(r["payload"] or b"") if payload else 0
                if size >= YIELD:
                    yield _batch(found, schema)
                    found, size = [], 0
            yield _batch(found, schema)

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if held and (file != current or offset - held[-1][0] - held[-1][1] > GAP or offset + length - held[0][0] > READ):
                    yield from read()
                    held = []
                if file != current:
                    if source is not None:
                        source.close()
                    fs, where = open_store(file)
                    current, source = file, fs.open_input_file(where)
                held.append((offset, length))
        if held:
            yield from read()
        if source is not None:
            source.close()

    # neighbouring ranges go to one task, and a large archive to several
    size = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartitionByRange(max(1, -(-size // TASK)), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)
