"""Sitemaps: entries into files of bounded number and size, and their XML with an index."""

from __future__ import annotations

import os
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# The protocol's name space and limits, and the bytes that an entry takes besides its address.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_URLS, MAX_BYTES, ENTRY_BYTES = 50_000, 50 * 1024 * 1024, 96


class SitemapError(ValueError):
    """Entries that no sitemap can be made of."""


def byte_estimate(loc: Column) -> Column:
    return F.octet_length(loc) + ENTRY_BYTES


def ranked(entries: DataFrame, by: str = "loc") -> DataFrame:
    """entries with `rank` from 0 in the order of a column, without bringing all rows together.

    Rows are dealt by ranges and numbered within each; the ranges' sizes, one row each, give what comes before.
    """
    from ..sources.shared import checkpointed

    dealt = checkpointed(entries.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_inside") + F.col("_before")).cast("long")).drop("_part", "_inside", "_before")


def chunk_by_count(entries: DataFrame, max_urls: int = MAX_URLS, by: str = "loc") -> DataFrame:
    """entries with the number of their file, where only the count is bounded."""
    return ranked(entries, by).withColumn("chunk", F.floor(F.col("rank") / max_urls).cast("long"))


def chunk_by_size(entries: DataFrame, max_urls: int = MAX_URLS, max_bytes: int = MAX_BYTES, site: str = "site", by: str = "loc") -> DataFrame:
    """(site, loc, chunk): files of each site filled in order, a new one where an entry would pass either bound.

    A file's end depends on all before it, so a site's entries are folded one after another; they reach the fold sorted
    and in batches, so that what is held is a batch, not a site.
    """
    sized = entries.select(F.col(site).alias("site"), F.col(by).alias("loc"), byte_estimate(F.col(by)).cast("long").alias("size"))
    rows = sized.repartition("site").sortWithinPartitions("site", "loc")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, n, held = None, 0, 0, 0
        for pdf in batches:
            out = []
            for own, size in zip(pdf["site"], pdf["size"], strict=True):
                if own != now:
                    now, chunk, n, held = own, 0, 0, 0
                if n and (n >= max_urls or held + size > max_bytes):
                    chunk, n, held = chunk + 1, 0, 0
                n, held = n + 1, held + size
                out.append(chunk)
            yield pdf[["site", "loc"]].assign(chunk=out)

    return rows.mapInPandas(fold, "site string, loc string, chunk long")


@dataclass(frozen=True)
class Written:
    """The files of a sitemap, its index where there are several, and how many addresses they hold."""

    files: tuple[str, ...]
    index: str | None
    url_count: int


def _put(root: ET.Element, path: str) -> None:
    """Write a tree under another name, and give it its own when it is complete."""
    ET.indent(root, "  ")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            ET.ElementTree(root).write(f, encoding="utf-8", xml_declaration=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def _tree(tag: str, item: str, rows: list[tuple[str, date | None]]) -> ET.Element:
    root = ET.Element(tag, xmlns=NAMESPACE)
    for loc, day in rows:
        own = ET.SubElement(root, item)
        ET.SubElement(own, "loc").text = loc
        if day is not None:
            ET.SubElement(own, "lastmod").text = day.isoformat()
    return root


def write_sitemap(entries: DataFrame, path: str, base_url: str | None = None, max_urls: int = MAX_URLS, max_bytes: int = MAX_BYTES, today: date | None = None, allow_empty: bool = False) -> Written:
    """Write one site's entries (loc, lastmod) as sitemap files, byte for byte as the protocol has them.

    Entries come to the driver sorted, a file at a time. One file is written to path; several to path with -1, -2, …
    before its suffix, and path is their index, with addresses at the root of base_url (else of the first entry).
    """
    stem, suffix = os.path.splitext(path)
    files: list[str] = []
    held: list[tuple[str, date | None]] = []
    total, size, first = 0, 0, None

    def close() -> None:
        files.append(f"{stem}-{len(files) + 1}{suffix}")
        _put(_tree("urlset", "url", held), files[-1])
        held.clear()

    for row in entries.select("loc", "lastmod").orderBy("loc").toLocalIterator(prefetchPartitions=True):
        n = len(row["loc"].encode()) + ENTRY_BYTES
        if held and (len(held) >= max_urls or size + n > max_bytes):
            close()
            size = 0
        first = first or row["loc"]
        held.append((row["loc"], row["lastmod"]))
        total, size = total + 1, size + n
    if not total and not allow_empty:
        raise SitemapError("there are no pages to list")
    if not files:
        _put(_tree("urlset", "url", held), path)
        return Written((path,), None, total)
    close()
    origin = "/".join((base_url or first).split("/", 3)[:3])
    if "://" not in origin:
        raise SitemapError(f"an index needs an absolute address, not {base_url or first!r}")
    _put(_tree("sitemapindex", "sitemap", [(f"{origin}/{os.path.basename(f)}", today or date.today()) for f in files]), path)
    return Written(tuple(files), path, total)


#: Bytes that Spark's XML writer puts around an entry, at most; and that & and < take instead of one.
PART_ENTRY_BYTES, ESCAPED = 160, 5


def write_sitemap_parts(entries: DataFrame, path: str, base_url: str, max_urls: int = MAX_URLS, max_bytes: int = MAX_BYTES, today: date | None = None) -> int:
    """Entries (loc, lastmod) as XML through Spark's own writer, for sites beyond what one process writes: files of
    path/files/chunk=k, each within both limits, and their index, path/index, with addresses under base_url. Gives the
    number of files.

    Every file has so many entries that even the longest ones would fit, so that no file depends on those before it.
    """
    special = F.length(F.regexp_replace("loc", "[^&<>]", ""))
    longest = entries.agg(F.max(F.octet_length("loc") + special * (ESCAPED - 1))).first()[0]
    if longest is None:
        raise SitemapError("there are no pages to list")
    most = min(max_urls, (max_bytes - len(NAMESPACE) - 200) // (longest + PART_ENTRY_BYTES))
    if most < 1:
        raise SitemapError("an entry is larger than a file may be")
    rows = chunk_by_count(entries.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod")), most)
    rows = rows.select("chunk", "loc", "lastmod").repartition("chunk").sortWithinPartitions("chunk", "loc")
    tag = lambda name: f'{name} xmlns="{NAMESPACE}"'
    xml = lambda df, root, row: df.write.mode("overwrite").format("xml").option("rootTag", tag(root)).option("rowTag", row).option("declaration", "version='1.0' encoding='utf-8'")
    xml(rows, "urlset", "url").partitionBy("chunk").save(f"{path}/files")
    spark = entries.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/files").select("path")
    loc = F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_extract("path", r"(files/chunk=[^/]*/[^/]*)$", 1))
    xml(files.select(loc.alias("loc"), F.lit((today or date.today()).isoformat()).alias("lastmod")).orderBy("loc").coalesce(1), "sitemapindex", "sitemap").save(f"{path}/index")
    return files.count()
