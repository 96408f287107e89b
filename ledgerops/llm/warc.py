"""WARC archives: written with an index of every record, and read back by byte ranges.

Each record is a gzip member of its own, as the format allows, so that it can be read alone. The index (archive, offset, length, URL, digest) is made from the
members' lengths and stored before any archive is written. Archives are written by Spark's text writer, so any file system Spark writes to will do and lost
executors do no harm: a member ends in the highest byte of its size, which is zero below 16 MB, and that zero is the writer's line separator. A longer record is
followed by an empty member, which ends in zero too and adds nothing. Members depend on their records alone (no time, one level), so both passes make the same.

Which records are revisits is decided from ids and digests. Texts are shuffled once, to their archives, however many copies there are.
Readers take index rows, sort them by archive and offset, and join ranges that lie close together into one read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerops.llm.tables import slices, written

#: Bytes of one archive, about; least payload that may be stored as a revisit; ranges with smaller gaps are read at once, up to a most.
ARCHIVE_BYTES, LEAST_REVISIT, GAP, READ = 64 << 20, 100, 64 << 10, 4 << 20
#: Bytes of text that are packed at once.
_PIECE = 4 << 20
#: Bytes of a record besides its payload, about; order of the records of an archive.
_HEAD_BYTES, _ORDER = 512, ["page_id", "digest", "url"]
_BLANK, _END = "\r\n\r\n", "\0"
_DATE = "2001-01-01T00:00:00Z"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def _clean(column):
    """A header value without line ends."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), "[\r\n]+", " ")


def _name(column):
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))


def _record(kind: str, payload: Column, refers_to: Column | None = None) -> Column:
    """The text of a record, from the columns of its row."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), payload)
    profile = "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), _name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), _clean(F.col("url")),
        F.lit("") if refers_to is None else F.concat(F.lit(profile), _name(refers_to)),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_BLANK), body, F.lit(_BLANK),
    )


def _member(text: pa.Buffer) -> bytes:
    """A record as a gzip member without its last byte, which is zero."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = made.compress(text) + made.flush()
    return (out + _EMPTY if out[-1] else out)[:-1]


def _members(batches):
    for piece in slices(batches, 64, _PIECE, text=4):
        packed = pa.array([_member(text.as_buffer()) for text in piece.column(4)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([*piece.columns[:4], packed], names=[*piece.schema.names[:4], "member"])


def stage(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, int]:
    """(page_id, digest, url, again, member) of every page as a response and of every revisit, and the number of archives.

    Members are not stored: ``index`` and ``write`` make them anew from ``pages``, which should be a stored table. Only ids and digests of revisits are.
    """
    raw = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    light = rows.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).drop("payload")
    copies = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    again = light.join(written(copies, "copies"), F.col("digest") == F.col("_digest")).where("page_id > first").drop("_digest")
    again = written(again, "revisits")
    kind = dict(rows.dtypes)["page_id"]
    columns = lambda text, flag: ["page_id", "digest", "url", F.lit(flag).alias("again"), text.alias("record")]
    texts = rows.select(*columns(_record("response", F.col("payload")), 0)).unionByName(again.select(*columns(_record("revisit", F.lit(""), F.col("first")), 1)))
    total = pages.agg(F.sum(F.octet_length(raw) + _HEAD_BYTES)).first()[0] or 0
    archives = 1 + total // ARCHIVE_BYTES
    members = texts.mapInArrow(_members, f"page_id {kind}, digest string, url string, again int, member binary")
    return members, archives


def _told(rows: DataFrame, archives: int) -> DataFrame:
    """``rows`` dealt to their archives, and of a page that is a revisit only that record.

    An archive is a partition by id and digest, so a task has one archive; equal partitionings give equal numbers in both passes.
    """
    same = Window.partitionBy("page_id", "digest")
    rows = rows.repartition(archives, "page_id", "digest").withColumn("_again", F.max("again").over(same)).where("again = _again").drop("_again")
    return rows.withColumn("archive", F.spark_partition_id().cast("long"))


def index(staged: tuple[DataFrame, int]) -> DataFrame:
    """(archive, offset, length, url, digest, page_id) of every record, written before any archive is.

    Only lengths are shuffled and summed, no texts. Rows that tie in the order have equal records, so either order gives the same offsets.
    """
    rows, archives = staged
    rows = _told(rows.select(*_ORDER, "again", (F.octet_length("member") + len(_END)).cast("long").alias("length")), archives)
    before = Window.partitionBy("archive").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return written(rows.select("archive", offset.alias("offset"), "length", "url", "digest", "page_id"), "warc-index")


def write(staged: tuple[DataFrame, int], path: str) -> None:
    """One file per archive below ``path``, records in the order of their offsets."""
    rows = _told(staged[0], staged[1]).sortWithinPartitions("archive", *_ORDER)
    # the bytes of a member as they are; the writer does not look at them
    rows.select("archive", F.col("member").cast("string").alias("value")).write.option("lineSep", _END).partitionBy("archive").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, file) of the archives below ``path``; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path")
    return listed.select(F.regexp_extract("path", "archive=([0-9]+)", 1).cast("long").alias("archive"), F.col("path").alias("file"))


def _ranges(offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each run of records, sorted by offset, that one read covers."""
    at = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP or offsets[i] + lengths[i] - offsets[at] > READ:
            yield at, i
            at = i


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode().split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.lower()] = value.strip()
    return out


def _opened(data: bytes) -> bytes:
    """The content of the gzip members that ``data`` holds; empty if it holds none."""
    out = b""
    try:
        while data:
            member = zlib.decompressobj(31)
            out += member.decompress(data)
            if not member.eof:
                return b""
            data = member.unused_data
    except zlib.error:
        return b""
    return out


_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def _read_records(batches):
    opened: tuple[str, object] = ("", None)
    for batch in batches:
        files = batch.column(0).to_pylist()
        offsets, lengths = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
        cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if opened[0] != files[lo]:
                if opened[1] is not None:
                    opened[1].close()
                system, path = fs.FileSystem.from_uri(files[lo])
                opened = (files[lo], system.open_input_file(path))
            for a, b in _ranges(offsets[lo:hi], lengths[lo:hi]):
                start = int(offsets[lo + a])
                size = int(offsets[lo + b - 1] + lengths[lo + b - 1]) - start
                data = opened[1].read_at(size, start)
                if len(data) != size:
                    raise EOFError(f"{files[lo]}: {len(data)} of {size} bytes at {start}")
                out = []
                for i in range(lo + a, lo + b):
                    record = _opened(data[int(offsets[i]) - start : int(offsets[i] + lengths[i]) - start])
                    head, _, block = record.partition(b"\r\n\r\n")
                    h = _headers(head) if head.startswith(b"WARC/") else {}
                    block, end = block[:-4], block[-4:]
                    if not h or end != b"\r\n\r\n" or len(block) != int(h["content-length"]):
                        raise ValueError(f"{files[lo]}: no record of {lengths[i]} bytes at {offsets[i]}")
                    _, _, payload = block.partition(b"\r\n\r\n")
                    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
                    found = hashlib.sha256(payload).hexdigest()
                    declared = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and found != declared:
                        raise ValueError(f"{files[lo]}: digest differs at {offsets[i]}")
                    seen = (len(payload), found, payload.decode()) if h["warc-type"] == "response" else (int(h["x-payload-length"]), declared, None)
                    out.append((number(h["warc-record-id"]), h["warc-target-uri"], seen[0], seen[1], h["warc-type"], number(h.get("warc-refers-to", "")), seen[2]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)
    if opened[1] is not None:
        opened[1].close()


def read(spark: SparkSession, path: str, selected: DataFrame) -> DataFrame:
    """Records of the selected index rows, as (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    A response's size and digest are taken from the bytes read, and checked; a revisit has no payload, and its header's size and digest are those of
    the payload it refers to. A range that does not hold the record the index names is an error.
    """
    rows = selected.select("archive", "offset", "length").join(_files(spark, path), "archive").select("file", "offset", "length")
    rows = rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read_records, _READ)


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives at ``path`` and read every record back through the index.

    Null payloads are empty ones, null URLs are empty in the header. Of records with equal payloads of at least 100 bytes those with the least id are responses, all others
    revisits of it; rows that repeat the least id are responses each. A row without an id is a response.
    """
    staged = stage(pages, id_col, url_col, payload_col)
    indexed = index(staged)
    write(staged, path)
    return read(pages.sparkSession, path, indexed)
