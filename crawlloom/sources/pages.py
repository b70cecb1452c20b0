"""Page snapshots as a source: links and canonical out of raw HTML, responses out of browser logs, site listings."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

# Content types of responses that are pages.
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "")

#: An opening tag's attributes, as far as its end; quoted values may hold a >.
_ATTRS = r"""((?:[^>"']|"[^"]*"|'[^']*')*)"""
_HREF = r"""(?is)(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REL = r"""(?is)(?:^|[\s"'/])rel\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _attribute(attrs: Column, pattern: str) -> Column:
    """An attribute's value; null without the attribute."""
    parts = [F.nullif(F.regexp_extract(attrs, pattern, k), F.lit("")) for k in (1, 2, 3)]
    return F.when(attrs.rlike(pattern), F.coalesce(*parts, F.lit("")))


_NAMES = sorted(k[:-1] for k in html5 if k.endswith(";"))


def _reference(piece: Column) -> Column:
    """A piece of text that began after an &, with the reference that it begins with, if any, put in its place."""
    number = F.regexp_extract(piece, r"^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", 0)
    digits = F.regexp_extract(number, r"([0-9A-Fa-f]+);?$", 1)
    code = F.when(number.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.regexp_extract(number, "([0-9]+)", 1)).cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    named = F.element_at(F.map_from_arrays(F.lit(_NAMES), F.lit([html5[f"{n};"] for n in _NAMES])), name)
    return (
        F.when(number != "", F.concat(char, F.substring(piece, F.length(number) + 1, F.length(piece))))
        .when((name != "") & named.isNotNull(), F.concat(named, F.substring(piece, F.length(name) + 2, F.length(piece))))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column) -> Column:
    """Text with its character references replaced, each once: numeric ones, and HTML's names with their semicolon."""
    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _reference)
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)


def visible(html: Column) -> Column:
    """Without comments, scripts and styles, whose text may look like tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def hrefs(html: Column) -> Column:
    """The href of every anchor that has one, in the order of the page."""
    anchors = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<a(?=[\s/>]){_ATTRS}>"), 1)
    found = F.transform(anchors, lambda a: unescape(_attribute(a, _HREF)))
    return F.filter(found, lambda h: h.isNotNull())


def canonical_link(html: Column) -> Column:
    """The href of the first link element whose rel holds the word canonical; null without one."""
    links = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<link(?=[\s/>]){_ATTRS}>"), 1)
    own = F.filter(links, lambda a: F.concat(F.lit(" "), F.lower(_attribute(a, _REL)), F.lit(" ")).rlike(r"\scanonical\s") & a.rlike(_HREF))
    return F.get(F.transform(own, lambda a: unescape(_attribute(a, _HREF))), F.lit(0))


def base_href(html: Column) -> Column:
    """The href of the first base element that has one; null without one."""
    bases = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<base(?=[\s/>]){_ATTRS}>"), 1)
    return F.get(F.filter(F.transform(bases, lambda a: unescape(_attribute(a, _HREF))), lambda h: h.isNotNull()), F.lit(0))


def rendered(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, links, canonical): one pass over each page's HTML. base is what links are relative to: the
    page's URL, or what its base element makes of it."""
    html = F.col("html")
    own = base_href(html)
    base = F.when(F.contains(F.lower(html), F.lit("<base")), F.coalesce(urls.absolute(own, F.col("url")), F.col("url"))).otherwise(F.col("url"))
    return pages.select("page_id", "url", base.alias("base"), hrefs(html).alias("links"), canonical_link(html).alias("canonical"))


def has_tag(html: Column, tag: str) -> Column:
    """Whether a snapshot holds an element: what waiting for a selector comes to for a static page."""
    return visible(html).rlike(rf"(?i)<{tag}[\s/>]")


def not_navigated(before: Column, after: Column) -> Column:
    """A navigation that leaves the browser where it was is a download and not a page."""
    return before.eqNullSafe(after)


def main_responses(log: DataFrame) -> DataFrame:
    """(navigation, status, mime): the main document's last response in browser logs (navigation, seq, message).

    message is a JSON text of an entry; entries that can't be read are left out. The main document is the first request
    of type Document in a navigation; without one, or without a response to it, both columns are null.
    """
    entry = "struct<message: struct<method: string, params: struct<requestId: string, type: string, response: struct<status: double, mimeType: string>>>>"
    rows = log.select("navigation", "seq", F.from_json("message", entry)["message"].alias("m"))
    sent = (F.col("m.method") == "Network.requestWillBeSent") & (F.col("m.params.type") == "Document")
    main = rows.groupBy("navigation").agg(F.min_by(F.when(sent, F.col("m.params.requestId")), F.when(sent, F.col("seq"))).alias("main"))
    got = rows.where(F.col("m.method") == "Network.responseReceived").select("navigation", "seq", F.col("m.params.requestId").alias("main"), "m.params.response")
    last = got.groupBy("navigation", "main").agg(F.max_by("response", "seq").alias("response"))
    return main.join(last, ["navigation", "main"], "left").select("navigation", F.col("response.status").cast("int").alias("status"), F.col("response.mimeType").alias("mime"))


def response_kind(status: Column, mime: Column) -> Column:
    """'error' for a status of 400 or more, 'not-html' for another type of content, else 'page'; nulls count as pages."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    return F.when(status >= 400, "error").when(~kind.isin(*HTML_TYPES), "not-html").otherwise("page")


def sites(state: DataFrame) -> DataFrame:
    """The sites that have a frontier, in order."""
    return state.select("site").distinct().orderBy("site")
