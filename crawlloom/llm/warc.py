"""WARC archives and a Merkle fixity audit of their replicas.

write_warc() lays records out in ascending order over files, one gzip member a record, so that an offset is a place in
the stored bytes and a damaged byte spoils one record. copy_replica() copies an archive file by file, byte for byte.
read_warc() hashes each record of a replica as it lies there. tree() hashes the records of each range of offsets, in
order, into a leaf node, and FAN nodes into one above, up to a root. audit() compares the roots of two replicas and goes
down only where nodes differ, so that records are compared in damaged ranges alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, once

#: Bytes of records in one file, in the mean, before they are compressed; and records in one file at most.
FILE_BYTES, FILE_RECORDS = 1 << 25, 1 << 16
#: Bytes of a leaf's range of offsets.
RANGE = 1 << 16
#: Children of a node.
FAN = 64
#: Leaf numbers kept for one file, and files for one task. Where a file is larger than RANGE * FILE_LEAVES, or a task
#: has written more files, some leaves hold ranges of two files, which is as good.
FILE_LEAVES, TASK_FILES = 1 << 14, 1000
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"

_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\n")
_MARK = VERSION.encode() + b"\r\n"
_END = b"\r\n\r\n"
_GZIP = 31  # zlib's code for gzip members with the largest window
_MAGIC = b"\x1f\x8b\x08"
#: Stored bytes that are given to the decompressor at once.
_CHUNK = 1 << 14


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A resource record without the blank lines that end it. Nulls are empty."""
    url, body = (F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " "), F.coalesce(body, F.lit("")))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def _member(data: bytes) -> bytes:
    code = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
    return code.compress(data) + code.flush()


#: Follows a member that doesn't end with a zero byte (its record has 16 MB or more): the writer below needs one there.
_EMPTY = _member(b"")


def member_of(data: bytes) -> bytes:
    own = _member(data + _END)
    return own if own[-1] == 0 else own + _EMPTY


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Write a binary column `value` as it is: each ends with a zero byte, which serves as the text writer's separator."""
    short = F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value")
    writer = rows.select(short, *by).write.mode("overwrite").options(lineSep="\0", maxRecordsPerFile=str(FILE_RECORDS))
    with once(rows.sparkSession):
        (writer.partitionBy(*by) if by else writer).text(path)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) in ascending order, a gzip member a record; file names ascend with the identifiers.

    Rows with one page_id are ordered by their records, a null page_id comes first, and repeated rows are records each.
    Null urls and bodies are empty; other columns are ignored. An empty table makes an archive without records.
    """
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    size = rows.agg(F.sum(F.octet_length("value").cast("long"))).first()[0] or 0
    rows = rows.repartitionByRange(int(size // FILE_BYTES + 1), "page_id").sortWithinPartitions("page_id", "value").select("value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("value"):
                yield pa.RecordBatch.from_arrays([pa.array([member_of(text.as_buffer().to_pybytes())], pa.binary())], names=["value"])

    _write(rows.mapInArrow(run, "value binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of an archive; file is a name that copies share: number of the task, and of its file."""
    own = F.concat(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1), F.lit("-"), F.regexp_extract("path", r"-c(\d+)\.[^/]*$", 1))
    copied = F.regexp_extract("path", r"/file=([^/]*)/[^/]*$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.when(copied == "", own).otherwise(copied).alias("file"), "content")


def copy_replica(spark: SparkSession, source: str, path: str, change: Callable[[bytes], bytes] | None = None) -> None:
    """Copy an archive's files, byte for byte; change may alter a file's bytes on the way (to try out an audit)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                content = b.column("content")[k].as_py()
                content = change(content) if change else content
                yield pa.RecordBatch.from_arrays([b.column("file").slice(k, 1), pa.array([content], pa.binary())], names=["file", "value"])

    _write(_files(spark, source).mapInArrow(run, "file string, value binary").where("octet_length(value) > 0"), path, "file")


def _unpack(data: memoryview, at: int) -> tuple[int, bytes]:
    """(end of the member that begins at a place, its record); zlib.error if there is none, or it is damaged."""
    code, parts, pos = zlib.decompressobj(_GZIP), [], at
    while pos < len(data) and not code.eof:
        piece = data[pos : pos + _CHUNK]
        parts.append(code.decompress(piece))
        pos += len(piece)
    out = b"".join(parts)
    if not code.eof or not out.startswith(_MARK):
        raise zlib.error("not a record")
    return pos - len(code.unused_data), out[: -len(_END)] if out.endswith(_END) else out


def records_of(content: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(from, to, record) of a file's stored bytes. Where none can be read the record is None, as far as the next one."""
    data, at = memoryview(content), 0
    while at < len(content):
        try:
            end, own = _unpack(data, at)
        except zlib.error:
            end, own = content.find(_MAGIC, at + 1), None
            while end >= 0:
                try:
                    _unpack(data, end)
                    break
                except zlib.error:
                    end = content.find(_MAGIC, end + 1)
            end = end if end >= 0 else len(content)
        if content.startswith(_EMPTY, end):
            end += len(_EMPTY)
        yield at, end, own
        at = end


def page_of(own: bytes) -> int | None:
    found = _ID.search(own, 0, 4096)
    return int(found[1]) if found and found[1] else None


RECORDS = "file string, offset long, stored long, stored_sha256 string, length long, page_id long, sha256 string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS: each record of a replica by its place and size in the stored bytes and their digest, and the record's own
    length, identifier and digest, from its version line to its last byte.

    Where stored bytes can't be read as a record, length, page_id and sha256 are null, and reading goes on at the next
    record. A file is held whole, as stored, and a record at a time of it uncompressed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in RECORDS.split(", ")]
        for b in batches:
            for k in range(b.num_rows):
                content, file, out = b.column("content")[k].as_py(), b.column("file")[k].as_py(), []
                for at, end, own in records_of(content):
                    raw = hashlib.sha256(memoryview(content)[at:end]).hexdigest()
                    out.append((file, at, end - at, raw, *((None, None, None) if own is None else (len(own), page_of(own), hashlib.sha256(own).hexdigest()))))
                cols = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, RECORDS)


def leaf() -> Column:
    """The number of a record's leaf: files follow each other as their records do."""
    file = F.split("file", "-")
    number = file[0].cast("long") * TASK_FILES + file[1].cast("long")
    return number * FILE_LEAVES + F.floor(F.col("offset") / RANGE)


def tree(records: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, int]:
    """(nodes, number of levels): nodes (level, node, hash) of a replica; the root is node 0 of the last level.

    A leaf hashes file, offset, size and digest of the records that begin in its range, in order of offset. A file's
    leaves have numbers of their own, so a shift in one file leaves the other files' ranges as they are.
    """
    line = F.struct("offset", F.concat_ws(":", F.col("file"), F.col("offset"), F.col("stored"), F.col("stored_sha256")).alias("line"))
    level = records.select(leaf().alias("node"), line.alias("line")).groupBy("node").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    level = level.select(F.lit(0).alias("level"), "node", F.sha2(F.array_join(F.col("lines.line"), "\n"), 256).alias("hash"))
    level = ws.save(level, f"{name}-0")
    nodes, k = level, 0
    while level.where("node > 0").limit(1).count():
        k += 1
        up = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below"))
        up = up.select(F.lit(k).alias("level"), "node", F.sha2(F.array_join(F.transform("below", lambda c: F.concat_ws(":", c["node"], c["hash"])), "\n"), 256).alias("hash"))
        level = ws.save(up, f"{name}-{k}")
        nodes = nodes.unionByName(level)
    return nodes, k


def audit(left: DataFrame, right: DataFrame, ws: Workspace) -> DataFrame:
    """Damage of the replica `right` against `left`, both tables of read_warc(); rows only where they differ.

    (file, left_offset, right_offset, page_id, status): corrupt (other bytes in the record's place, or other bytes under
    its page_id where a shift has moved it), missing (only in left) or extra (only in right). Records that a shift has
    moved within their file, bytes unchanged, are no damage. Equal roots end the audit at once. Records that repeat a
    page_id are told apart by their places; empty replicas are equal, and against an empty one all is missing or extra.
    """
    (a, ka), (b, kb) = tree(left, ws, "left"), tree(right, ws, "right")
    top = max(ka, kb)

    def differing(level: int, under: DataFrame | None) -> DataFrame:
        x, y = (t.where(F.col("level") == level).select("node", F.col("hash").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if under is not None:
            parents = under.select(F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / FAN)).join(parents, "up", "left_semi").drop("up") for t in (x, y))
        return ws.save(x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), f"differ-{level}")

    under = differing(top, None) if ka == kb else None
    for level in range(top - (ka == kb), -1, -1):
        if under is not None and under.isEmpty():
            break
        under = differing(level, under)

    def suspects(records: DataFrame, side: str) -> DataFrame:
        rows = records.withColumn("node", leaf()).join(under, "node", "left_semi")
        return rows.select("file", "offset", "page_id", "stored_sha256", F.lit(side).alias("side"))

    rows = ws.save(suspects(left, "x").unionByName(suspects(right, "y")), "suspects")
    # The n-th record with some bytes in a file stands for the n-th of the other replica with them.
    number = F.expr("row_number() over (partition by side, file, stored_sha256 order by offset)")
    alone = rows.withColumn("n", number).groupBy("file", "stored_sha256", "n").agg(F.count(F.lit(1)).alias("sides"), F.first("side").alias("side"), F.first("offset").alias("offset"), F.first("page_id").alias("page_id"))
    alone = ws.save(alone.where("sides = 1").select("file", "offset", "page_id", "side"), "alone")
    x, y = (alone.where(F.col("side") == s).select("file", "offset", F.col("offset").alias(f"{s}_at"), F.col("page_id").alias(f"{s}_id")) for s in "xy")
    both = ws.save(x.join(y, ["file", "offset"], "full"), "paired")
    moved = F.expr("row_number() over (partition by file, page_id order by at)")
    x, y = (both.where(f"{t}_at is null").select("file", F.col(f"{s}_id").alias("page_id"), F.col(f"{s}_at").alias("at")).withColumn("n", moved) for s, t in ("xy", "yx"))
    rest = x.withColumnRenamed("at", "x_at").join(y.withColumnRenamed("at", "y_at"), ["file", "page_id", "n"], "full")
    found = both.where("x_at is not null and y_at is not null").select("file", "x_at", "y_at", F.coalesce("x_id", "y_id").alias("page_id"))
    found = found.unionByName(rest.select("file", "x_at", "y_at", "page_id"))
    status = F.when(F.col("y_at").isNull(), "missing").when(F.col("x_at").isNull(), "extra").otherwise("corrupt")
    return found.select("file", F.col("x_at").alias("left_offset"), F.col("y_at").alias("right_offset"), "page_id", status.alias("status"))
