"""WARC archives with an index, and reads of selected records by byte range.

Every record is one gzip member, so that a record can be read alone. The index has
offset, length, URL and payload digest of every record. Selected records are read
from the sorted ranges of their file, neighbouring ranges at once.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.stores import own_file, read_ranges
from caselog.llm.tables import batch_of, with_group
from caselog.session import cut, scratch_table

LEAST_BYTES = 100          # a payload of fewer bytes is always a response
FILE_BYTES = 1 << 28       # a file is closed at the record that reaches this
SPAN_BYTES = 1 << 22       # records that begin in one span of a file are read by one task
TASK_BYTES = 1 << 25       # about what one task reads
MOST_TASKS = 10_000        # of a read

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = ("page_id long, file string, offset long, length long, url string, payload_digest string,"
          " record_type string")
_RECORD = ("page_id long, url string, record_type string, payload binary, payload_bytes long,"
           " payload_digest string, refers_to long")


@dataclass
class Archive:
    """Written archives: the folder of their files, and the stored index."""

    folder: str
    index: DataFrame


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, refers_to of every row of `pages`.

    Of the rows with equal payloads of at least `LEAST_BYTES` bytes those with the
    smallest page_id are responses (refers_to null) and the others refer to it. A
    row without a page_id comes after all others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "payload_digest")
    digests = cut(long, "digests")
    groups = cut(digests.groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    later = with_group(digests, groups, ["payload_digest"], digests.count()).filter(
        "first is not null and not (page_id <=> first)")
    later = cut(later.select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"),
                             F.col("first").alias("refers_to")).distinct(), "revisits")
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("__id"))
                     & (F.col("payload_digest") == F.col("__digest")), "left").drop("__id", "__digest")


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    name = "null" if page_id is None else str(page_id)
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", name), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one stored record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    return fields, rest[:int(fields["Content-Length"])]


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Write a record per row of `pages` (page_id, url, html); null html is empty.

    Each task writes its own files in the shared folder. The index is stored with
    the files; only what it names is read. A revisit has no block. Null urls have
    no target field. Other columns are ignored. An empty table writes no record.
    """
    spark = pages.sparkSession
    folder = folder or scratch_table(spark, "warc")

    def run(batches):
        stream = name = None
        offset, made, files = 0, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None or offset >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    stream, name = own_file(folder, f"-{files}.warc.gz")
                    offset, files = 0, files + 1
                data = gzip.compress(_record(row["page_id"], row["url"], row["payload"], row["payload_digest"],
                                             row["refers_to"]), 5, mtime=0)
                stream.write(data)
                made.append((row["page_id"], name, offset, len(data), row["url"], row["payload_digest"],
                             "response" if row["refers_to"] is None else "revisit"))
                offset += len(data)
                if len(made) >= 50_000:  # a file's rows leave the task after it is closed
                    stream.close()
                    stream = None
                    yield _index_batch(made)
                    made = []
        if stream is not None:
            stream.close()
        if made:
            yield _index_batch(made)

    return Archive(folder, cut(with_responses(pages).mapInArrow(run, _INDEX), "warc_index"))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ("page_id", "file", "offset", "length", "url", "payload_digest", "record_type")
    return batch_of(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def read_records(archive: Archive, selected: DataFrame | None = None) -> DataFrame:
    """The selected rows of the index (all by default), read from their byte ranges.

    The rows of one span of a file come to one task sorted by offset, so it reads
    few long ranges; spans bound what a task holds. A revisit has a null payload,
    and length, digest and the page it refers to from its header.
    """
    folder = archive.folder
    wanted = (archive.index if selected is None else selected).select(
        "file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("span"))
    # A stated number of tasks: the rows are few bytes each, what they name is not.
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(max(1, -(-size // TASK_BYTES)), MOST_TASKS)
    spread = wanted.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset")

    def run(batches):
        for batch in batches:
            place, found = batch.to_pylist(), []
            begin = 0
            while begin < len(place):
                end = begin
                while end < len(place) and place[end]["file"] == place[begin]["file"]:
                    end += 1
                ranges = [(r["offset"], r["length"]) for r in place[begin:end]]
                for data in read_ranges(folder, place[begin]["file"], ranges):
                    found.append(_read(bytes(data)))
                    if len(found) >= 2_000:
                        yield _record_batch(found)
                        found = []
                begin = end
            if found:
                yield _record_batch(found)

    return spread.mapInArrow(run, _RECORD)


def _read(data: bytes) -> tuple:
    fields, block = parse(data)
    page = fields["X-Page-ID"]
    page_id, url = None if page == "null" else int(page), fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "revisit":
        return (page_id, url, "revisit", None, int(fields["X-Payload-Length"]),
                fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Refers-To-Page-ID"]))
    return page_id, url, "response", block, len(block), hashlib.sha256(block).hexdigest(), None


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")
    return batch_of(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})
