"""The engine's queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.urls import Parts, ScopeColumns
from ..operators import crawl, frontier, report, retry, sitemap
from ..operators.robots import Robots, effective_delay
from ..operators.scope import LinkRules
from ..sources import pages as source
from ..sources.shared import checkpointed
from ..streaming import retries
from . import golden

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_scope(url: str = "url") -> ScopeColumns:
    """The whole host that a page is on."""
    return ScopeColumns.of(F.col(url), restrict_to_path=False)


def _text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


# -- URLs ------------------------------------------------------------------------------------------------------------

_PARTS = """SELECT page_id, url, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"""
_TRACKING = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
_CLEAN = f"array_to_string(list_sort([CASE WHEN contains(x, '=') THEN x ELSE x || '=' END FOR x IN string_split(query, '&') IF x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACKING})]), '&')"
_SUFFIX = "lower(regexp_extract(path, '[^/]+([.][^./]*)$', 1))"
_ASSETS = ", ".join(f"'{s}'" for s in urls.ASSET_SUFFIXES)
_CANONICAL = f"""SELECT page_id, scheme || '://' || lower(netloc) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN cleaned <> '' THEN '?' || cleaned ELSE '' END AS canonical_url
  FROM (SELECT *, {_CLEAN} AS cleaned FROM ({_PARTS})) WHERE {_SUFFIX} NOT IN ({_ASSETS})"""


@query(_PARTS.replace("page_id, url,", "page_id,"))
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Parts.of(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", p.scheme.alias("scheme"), p.netloc.alias("netloc"), p.path.alias("path"), p.query.alias("query"), p.fragment.alias("fragment"))


def _canonical(pages: DataFrame) -> DataFrame:
    out = pages.select("page_id", urls.canonical(F.col("url"), F.col("url"), _own_scope()).alias("canonical_url"))
    return out.where("canonical_url is not null")


@query(_CANONICAL)
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each page's URL in the scope of its own host."""
    return _canonical(_table(spark, sf_dir, "pages"))


@query(
    f"""SELECT page_id, 'https://' || lower(netloc) || path || CASE WHEN cleaned <> '' THEN '?' || cleaned ELSE '' END AS canonical_url
    FROM (SELECT *, {_CLEAN} AS cleaned FROM ({_PARTS}))
    WHERE (lower(netloc) = 'example.com' OR ends_with(lower(netloc), '.example.com')) AND starts_with(path, '/en/') AND {_SUFFIX} NOT IN ({_ASSETS})"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in a scope of one host with its subdomains and a path prefix; http becomes the scope's https."""
    rules = LinkRules.at("https://example.com/en/", include_subdomains=True)
    out = _table(spark, sf_dir, "pages").select("page_id", rules.canonical(F.col("url"), F.col("url")).alias("canonical_url"))
    return out.where("canonical_url is not null")


_MADE = """(SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '.PDF' ELSE regexp_replace(url, '[?#].*$', '') || '/a.b.Js?x=1' END AS url FROM pages)"""


@query(f"SELECT page_id, {_SUFFIX} AS suffix, {_SUFFIX} IN ({_ASSETS}) AS is_asset FROM ({_PARTS.replace('pages', _MADE)})")
def asset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset test, on the pages' URLs and on ones made of them with suffixes of files."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    made = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(bare, F.lit(".PDF"))).otherwise(F.concat(bare, F.lit("/a.b.Js?x=1")))
    path = Parts.of(made).path
    return _table(spark, sf_dir, "pages").select("page_id", urls.asset_suffix(path).alias("suffix"), urls.is_asset(path).alias("is_asset"))


_LONGER = """(SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'z=1&&UTM_Medium=x&b=2&flag&a=9' AS url FROM pages)"""


@query(f"SELECT page_id, query, {_CLEAN} AS cleaned FROM ({_PARTS.replace('pages', _LONGER)})")
def query_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without tracking parameters, sorted."""
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("z=1&&UTM_Medium=x&b=2&flag&a=9"))
    q = Parts.of(url).query
    return _table(spark, sf_dir, "pages").select("page_id", q.alias("query"), urls.clean_query(q).alias("cleaned"))


@query(
    f"""SELECT page_id, regexp_replace(regexp_replace(lower(netloc || CASE WHEN dir <> '/' THEN '_' || replace(trim(dir, '/'), '/', '_') ELSE '' END), '[^a-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug
    FROM (SELECT *, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir FROM ({_PARTS}))"""
)
def site_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", ScopeColumns.of(F.col("url")).slug.alias("slug"))


@query("SELECT * FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, TRUE), (4, FALSE), (5, FALSE), (6, FALSE), (7, FALSE), (8, FALSE), (9, FALSE)) t(case_id, same)")
def same_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two base URLs have one scope, by structs of columns."""
    base = "https://example.com/"
    others = ["https://example.com", "https://EXAMPLE.com/", "https://example.com:443/", "https://example.com/index.html", "https://other.test/", "https://sub.example.com/", "http://example.com/", "https://example.com:8080/", "https://example.com/blog/", "not a url"]
    rows = spark.createDataFrame([(k, base, x) for k, x in enumerate(others)], "case_id int, one string, other string")
    one, other = (F.struct(s.scheme, s.host, F.coalesce(s.port, F.lit(0)), s.prefix) for s in (ScopeColumns.of(F.col("one")), ScopeColumns.of(F.col("other"))))
    valid = ScopeColumns.of(F.col("one")).host.isNotNull() & ScopeColumns.of(F.col("other")).host.isNotNull()
    return rows.select("case_id", (valid & (one == other)).alias("same"))


# -- links -----------------------------------------------------------------------------------------------------------

_LINKS = "SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)"
_TARGET = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href"
_SUFFIX_OK = f"lower(regexp_extract(href, '[^/]+([.][^./]*)$', 1)) NOT IN ({_ASSETS})"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.rendered(_table(spark, sf_dir, "pages")).withColumn("targets", urls.canonical_all(F.col("links"), F.col("base"), _own_scope()))


@query(f"SELECT page_id, pos, href FROM ({_LINKS})")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's href, by page and place."""
    rows = source.rendered(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.posexplode("links").alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, pos, {_TARGET} AS target FROM ({_LINKS}) WHERE {_SUFFIX_OK}")
def link_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.rendered(_table(spark, sf_dir, "pages")).select("page_id", "url", "base", F.posexplode("links").alias("pos", "href"))
    out = rows.select("page_id", F.col("pos").cast("long").alias("pos"), urls.canonical(F.col("href"), F.col("base"), _own_scope()).alias("target"))
    return out.where("target is not null")


@query(f"SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS rank FROM (SELECT page_id, pos, {_TARGET} AS target FROM ({_LINKS}) WHERE {_SUFFIX_OK}) GROUP BY page_id, target")
def link_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's distinct targets in the order of first sight."""
    return _links(spark, sf_dir).select("page_id", F.posexplode("targets").alias("rank", "target")).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT p.page_id, count(DISTINCT CASE WHEN {_SUFFIX_OK} THEN {_TARGET} END) AS link_count FROM (SELECT page_id FROM pages) p LEFT JOIN ({_LINKS}) l USING (page_id) GROUP BY p.page_id")
def link_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", F.size("targets").cast("long").alias("link_count"))


@query(f"SELECT target, count(*) AS n_pages FROM (SELECT DISTINCT page_id, {_TARGET} AS target FROM ({_LINKS}) WHERE {_SUFFIX_OK}) GROUP BY target ORDER BY n_pages DESC, target LIMIT 50")
def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 URLs that most pages link to."""
    rows = _links(spark, sf_dir).select(F.explode("targets").alias("target"))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n_pages")).orderBy(F.desc("n_pages"), "target").limit(50)


_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@query(
    f"""SELECT page_id, pos, {_ORIGIN} || CASE pos WHEN 0 THEN '/b/' || (page_id % 5) || '/x/y' || page_id || 'é' ELSE '/q?amp%3B=&k=' || page_id END AS target
    FROM pages CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) k(pos)"""
)
def link_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that have a base element, with character references in them."""
    head = F.concat(F.lit('<base target="_top"><base href="/b/'), F.col("page_id") % 5, F.lit('/z">'))
    body = F.concat(F.lit('<a href="x&#x2F;y'), F.col("page_id"), F.lit('&eacute;">x</a><a href="&#47;q&quest;k&equals;'), F.col("page_id"), F.lit('&amp;amp;">y</a>'))
    rows = source.rendered(_table(spark, sf_dir, "pages").withColumn("html", F.concat(head, body)))
    rows = rows.select("page_id", "url", "base", F.posexplode("links").alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), urls.canonical(F.col("href"), F.col("base"), _own_scope()).alias("target"))


# Links on a page at /d/e/f?x=1, and what they come to on its site; None for those that aren't followed.
RELATIVE = (
    ("../x", "/d/x"), ("./y", "/d/e/y"), ("z?b=2&a=1", "/d/e/z?a=1&b=2"), ("?q=1", "/d/e/f?q=1"), ("#top", "/d/e/f?x=1"), ("../../../up", "/up"), ("/a/./b/../c", "/a/c"), ("g;", "/d/e/g"),
    ("mailto:a@b.c", None), ("   ", None), ("", None), ("javascript:void(0)", None), ("http://[::1/x", None), ("tel:+1", None), ("ftp://h/x", None), ("https://elsewhere.test/x", None), ("/data.CSV", None),
)
_RELATIVE = ", ".join(f"({k}, '{to}')" for k, (_, to) in enumerate(RELATIVE) if to)


@query(f"SELECT page_id, k, {_ORIGIN} || path AS target FROM pages CROSS JOIN (VALUES {_RELATIVE}) r(k, path)")
def link_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative links, and ones that no crawl follows, on a page of every page's site."""
    own = _own_scope()
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.lit([href for href, _ in RELATIVE])).alias("k", "href"))
    target = urls.canonical(F.col("href"), F.concat(own.origin, F.lit("/d/e/f?x=1")), own)
    return rows.select("page_id", "k", target.alias("target")).where("target is not null")


_PORTS = ("", ":80", ":443", ":8080")


@query(
    f"""SELECT page_id, CASE WHEN port = '' OR usual THEN NULL ELSE substr(port, 2)::INT END AS port, CASE WHEN port = '' OR usual THEN {_ORIGIN} || '/p' END AS target
    FROM (SELECT *, (scheme = 'http' AND port = ':80') OR (scheme = 'https' AND port = ':443') AS usual
    FROM (SELECT page_id, url, regexp_extract(url, '^([^:]+)', 1) AS scheme, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':80' WHEN 2 THEN ':443' ELSE ':8080' END AS port FROM pages))"""
)
def port_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with ports: the scheme's own is none, any other is another site."""
    p, own = Parts.of(F.col("url")), _own_scope()
    made = F.concat(p.scheme, F.lit("://"), p.netloc, F.element_at(F.lit(list(_PORTS)), (F.col("page_id") % 4 + 1).cast("int")), F.lit("/p"))
    return _table(spark, sf_dir, "pages").select("page_id", ScopeColumns.of(made).port.alias("port"), urls.canonical(made, F.col("url"), own).alias("target"))


# Links and what they come to with hash routing and an exclude pattern.
ROUTED = (("/a#/r/1", "/a#/r/1"), ("/a#!/r", "/a#!/r"), ("/a#top", "/a"), ("/logout?x=1", None), ("/logouts", "/logouts"), ("/b/logout", None), ("/a?ref=x#/logout", None))
_ROUTED = ", ".join(f"({k}, '{to}')" for k, (_, to) in enumerate(ROUTED) if to)


@query(f"SELECT page_id, k, {_ORIGIN} || path AS target FROM pages CROSS JOIN (VALUES {_ROUTED}) r(k, path)")
def link_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that are routes, and links that an exclude pattern keeps out."""
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.lit([href for href, _ in ROUTED])).alias("k", "href"))
    return rows.select("page_id", "k", urls.canonical(F.col("href"), F.col("url"), _own_scope(), hash_routing=True, exclude=(r"/logout\b",)).alias("target")).where("target is not null")


# -- frontier --------------------------------------------------------------------------------------------------------

NOW = "2024-02-01 00:00:00"


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical pages as queued URLs, at the depth of their path."""
    rows = _canonical(_table(spark, sf_dir, "pages"))
    depth = F.length("canonical_url") - F.length(F.replace("canonical_url", F.lit("/"), F.lit(""))) - 3
    return frontier.fresh(rows.select(F.col("canonical_url").alias("url"), depth.alias("depth")), NOW)


_DEPTH = "length(canonical_url) - length(replace(canonical_url, '/', '')) - 3"


@query(
    f"""WITH c AS ({_CANONICAL}), known AS (SELECT DISTINCT canonical_url FROM c WHERE page_id % 2 = 0)
    SELECT canonical_url AS url, 'queued' AS status, min(1)::INT AS depth, 0 AS attempts FROM c WHERE canonical_url NOT IN (SELECT canonical_url FROM known) GROUP BY 1"""
)
def enqueue_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enqueueing all pages adds to a frontier that knows every other one."""
    rows = _canonical(_table(spark, sf_dir, "pages"))
    known = frontier.fresh(rows.where("page_id % 2 = 0").select(F.col("canonical_url").alias("url"), F.lit(0).alias("depth")), NOW)
    return frontier.unknown(known, rows.select(F.col("canonical_url").alias("url"), F.lit(1).alias("depth")), NOW).select("url", "status", "depth", "attempts")


@query(f"SELECT canonical_url AS url, min({_DEPTH})::INT AS depth, 1 AS attempts FROM ({_CANONICAL}) GROUP BY 1 ORDER BY depth, url LIMIT 25")
def claim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 URLs of the frontier."""
    return frontier.claim(_frontier(spark, sf_dir), NOW, most=25)


@query(f"SELECT regexp_extract(canonical_url, '^[^:]+://([^/]*)', 1) AS host, count(*) AS n_pages, count(DISTINCT canonical_url) AS n_urls FROM ({_CANONICAL}) GROUP BY 1")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _canonical(_table(spark, sf_dir, "pages")).withColumn("host", Parts.of(F.col("canonical_url")).host)
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("canonical_url").alias("n_urls"))


# -- attempts --------------------------------------------------------------------------------------------------------
# A log of attempts: an event of a user on a day is an attempt at that URL; an error is a failure, a sign-up an answer
# that is no page.

_LOG = "SELECT '/u' || user_id || '/' || strftime(ts, '%Y-%m-%d') AS url, date_trunc('second', ts) AS tried_at, event_id, event_type FROM events"
_TRIED = f"SELECT * FROM (SELECT *, row_number() OVER w AS attempt, coalesce(sum((event_type <> 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM ({_LOG}) WINDOW w AS (PARTITION BY url ORDER BY tried_at, event_id)) WHERE ended = 0 AND attempt <= 3"
_STATE = f"""SELECT url, count(*) AS attempts, max(tried_at) AS last_at,
  CASE WHEN arg_max(event_type, attempt) = 'signup' THEN 'skipped' WHEN arg_max(event_type, attempt) <> 'error' THEN 'done' WHEN count(*) >= 3 THEN 'failed' ELSE 'queued' END AS status
  FROM ({_TRIED}) GROUP BY url"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("SECOND", F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("/u"), F.col("user_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("url"), at.alias("at"), "event_id", "event_type")


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts that a crawl would have made: up to the first answer, three at most."""
    log = retry.attempt_numbers(_log(spark, sf_dir), "url", ["at", "event_id"])
    before = Window.partitionBy("url").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum((F.col("event_type") != "error").cast("int")).over(before), F.lit(0))
    return log.withColumn("ended", ended).where("ended = 0 and attempt <= 3")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("event_type", "attempt")
    rows = _tried(spark, sf_dir).groupBy("url").agg(F.count(F.lit(1)).cast("int").alias("attempts"), F.max("at").alias("last_at"), last.alias("last"))
    status = F.when(F.col("last") == "signup", "skipped").when(F.col("last") != "error", "done").when(F.col("attempts") >= 3, "failed").otherwise("queued")
    held = F.col("last_at") + F.make_dt_interval(secs=retry.Backoff().delay(F.col("attempts")))
    out = rows.withColumn("status", status)
    return out.select(
        "url", "status", F.lit(0).alias("depth"), "attempts", F.lit(None).cast("int").alias("link_count"), F.when(F.col("status") == "failed", "error").alias("note"), F.col("last_at").alias("discovered_at"),
        F.when(F.col("status") != "queued", F.col("last_at")).alias("visited_at"), F.when(F.col("status") == "queued", held).alias("next_attempt_at"),
    )


@query(f"SELECT s.status, count(x.url) AS n FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in frontier.STATUSES)}) s(status) LEFT JOIN ({_STATE}) x USING (status) GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.counts(_state(spark, sf_dir))


@query(f"SELECT status, url, CASE WHEN status = 'failed' THEN 'error' ELSE '' END AS note FROM ({_STATE}) WHERE status IN ('failed', 'skipped') ORDER BY status, url LIMIT 20")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.problems(_state(spark, sf_dir))


@query(f"SELECT greatest(epoch(min(last_at + to_seconds(CASE attempts WHEN 1 THEN 2 ELSE 8 END)))::BIGINT - epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT, 0) AS seconds FROM ({_STATE}) WHERE status = 'queued'")
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.until_due(_state(spark, sf_dir), "2024-01-15 00:00:00")


@query(f"SELECT url, attempts, strftime(last_at + to_seconds(CASE attempts WHEN 1 THEN 2 ELSE 8 END), '%Y-%m-%d %H:%M:%S') AS due FROM ({_STATE}) WHERE status = 'queued'")
def held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that wait for their next attempt, and until when."""
    return _state(spark, sf_dir).where("status = 'queued'").select("url", F.col("attempts").cast("long").alias("attempts"), _text(F.col("next_attempt_at")).alias("due"))


@query(f"SELECT url, attempt, event_type, strftime(tried_at, '%Y-%m-%d %H:%M:%S') AS tried_at FROM ({_TRIED})")
def attempts_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tried(spark, sf_dir).select("url", F.col("attempt").cast("long").alias("attempt"), "event_type", _text(F.col("at")).alias("tried_at"))


@query(
    """WITH m AS (SELECT user_id, event_id, ts, (event_type = 'error')::INT AS bad FROM events),
    i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
    r AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run_length FROM i)
    SELECT user_id, event_id, run_length::BIGINT AS run_length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r WHERE run_length >= 3) WHERE n = 1"""
)
def breaker_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three failures in a row end each user's run."""
    trips = retry.breaker_trips(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", limit=3)
    return trips.select("user_id", "event_id", F.col("run_length").cast("long").alias("run_length"))


@query(f"SELECT url, attempt, round(least(2.0 * power(4.0, greatest(attempt - 1, 0)), 300.0) * (1 + 0.25 * (2 * ((event_id % 11) / 10.0) - 1)), 6) AS delay FROM ({_TRIED}) WHERE event_type = 'error'")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait after each failure, with a given place in the jitter's range."""
    delay = retry.Backoff().delay(F.col("attempt"), (F.col("event_id") % 11) / 10.0)
    return _tried(spark, sf_dir).where("event_type = 'error'").select("url", F.col("attempt").cast("long").alias("attempt"), F.round(delay, 6).alias("delay"))


MESSAGES = (
    "invalid session id: session deleted as the browser has closed the connection", "disconnected: not connected to DevTools", "unknown error: net::ERR_CONNECTION_REFUSED", "ERR_NAME_NOT_RESOLVED at http://x",
    "Timed out receiving message from renderer", "chrome not reachable after net::ERR_CONNECTION_RESET", "HTTP 404", "tab crashed\n  (Session info: chrome=120)", "net::ERR_CERT_DATE_INVALID\nmore", "",
)
_VALUES = ", ".join("({}, '{}')".format(k, m.replace("'", "''")) for k, m in enumerate(MESSAGES))
_SAID = lambda phrases: " OR ".join(f"contains(lower(message), '{p}')" for p in phrases)


@query(f"SELECT message_id, split_part(trim(message), chr(10), 1) AS brief, CASE WHEN {_SAID(retry.BROWSER_PHRASES)} THEN 'browser' WHEN {_SAID(retry.SITE_PHRASES)} THEN 'site' ELSE 'url' END AS fault FROM (VALUES {_VALUES}) m(message_id, message)")
def failure_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(MESSAGES)), "message_id int, message string")
    return rows.select("message_id", retry.brief(F.col("message")).alias("brief"), retry.fault(F.col("message")).alias("fault"))


@query("SELECT event_id, status, status IN (408, 425, 429) OR status >= 500 AS retryable FROM (SELECT event_id, (400 + event_id % 130)::INT AS status FROM events)")
def http_retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", (F.lit(400) + F.col("event_id") % 130).cast("int").alias("status"))
    return rows.select("event_id", "status", retry.is_retryable(F.col("status")).alias("retryable"))


@query("SELECT * FROM (VALUES ('a', 200, 'text/html', 'page'), ('b', 404, 'text/html', 'error'), ('c', 200, 'application/pdf', 'not-html'), ('d', 0, '', 'page'), ('e', 503, 'text/html', 'error')) t(navigation, status, mime, kind)")
def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main document's answer out of browser logs, and what it means."""
    sent = lambda r, t: '{"message": {"method": "Network.requestWillBeSent", "params": {"requestId": "%s", "type": "%s"}}}' % (r, t)
    got = lambda r, s, m: '{"message": {"method": "Network.responseReceived", "params": {"requestId": "%s", "response": {"status": %d, "mimeType": "%s"}}}}' % (r, s, m)
    logs = {
        "a": [sent(1, "Document"), got(2, 500, "text/css"), got(1, 301, ""), got(1, 200, "text/html"), "{broken"],
        "b": [sent(9, "Script"), sent(1, "Document"), sent(2, "Document"), got(2, 200, "text/html"), got(1, 404, "text/html")],
        "c": [sent(1, "Document"), got(1, 200, "application/pdf")], "d": [sent(1, "Document"), got(3, 200, "text/html")], "e": [sent(1, "Document"), got(1, 503, "text/html")],
    }
    rows = spark.createDataFrame([(n, k, m) for n, own in logs.items() for k, m in enumerate(own)], "navigation string, seq int, message string")
    out = source.main_responses(rows)
    return out.select("navigation", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("mime", F.lit("")).alias("mime"), source.response_kind(F.col("status"), F.col("mime")).alias("kind"))


@query("SELECT page_id, regexp_matches(html, '(?i)<article[ />]') AS has_article, regexp_matches(html, '(?i)<table[ />]') AS has_table FROM pages")
def selector_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the element that a crawl would wait for is in each snapshot."""
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", source.has_tag(html, "article").alias("has_article"), source.has_tag(html, "table").alias("has_table"))


@query("SELECT event_id, coalesce(lag(event_type) OVER w = event_type, FALSE) AS is_download FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def download_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigations that left the browser where it was; an event's type stands for the place."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select("event_id", source.not_navigated(before, F.col("event_type")).alias("is_download"))


# -- robots, redirects, canonicals -----------------------------------------------------------------------------------

ROBOTS = "User-agent: *\nAllow: /en/4\nDisallow: /en/\nDisallow: /de/5\nAllow: /\nDisallow: /fr/"


@query(f"SELECT page_id, CASE WHEN starts_with(path, '/en/4') THEN TRUE WHEN starts_with(path, '/en/') THEN FALSE WHEN starts_with(path, '/de/5') THEN FALSE ELSE TRUE END AS allowed FROM ({_PARTS})")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule in order decides, so the last one never does."""
    return _table(spark, sf_dir, "pages").select("page_id", Robots.parse(ROBOTS, "loom/1.0").allowed(F.col("url")).alias("allowed"))


@query(
    f"""SELECT p.page_id, CASE WHEN p.page_id % 6 = 3 THEN nullif(c.canonical_url, p.url) WHEN p.page_id % 3 = 1 THEN regexp_extract(p.url, '^([^:/?#]+://[^/?#]*)', 1) || '/moved/' || p.page_id END AS target,
    CASE WHEN p.page_id % 3 = 0 THEN 'done' ELSE 'redirected' END AS status FROM pages p LEFT JOIN ({_CANONICAL}) c USING (page_id)"""
)
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose browser stayed, ended at another place of the page, elsewhere on the site, or left it."""
    url, case = F.col("url"), F.col("page_id") % 6
    home = _own_scope()
    final = (
        F.when(case == 0, url).when(case == 3, F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#again")))
        .when(case.isin(1, 4), F.concat(home.origin, F.lit("/moved/"), F.col("page_id"), F.lit("?utm_source=x#top"))).otherwise(F.lit("https://elsewhere.test/"))
    )
    rows = _table(spark, sf_dir, "pages").withColumn("final", final)
    return rows.select("page_id", crawl.redirect_target(url, F.col("final"), home).alias("target"), F.when(case.isin(0, 3), "done").otherwise("redirected").alias("status"))


@query(
    f"""SELECT p.page_id, CASE WHEN p.page_id % 3 = 0 THEN regexp_extract(p.url, '^([^:/?#]+://[^/?#]*)', 1) || '/c/' || p.page_id WHEN p.page_id % 3 = 1 THEN nullif(c.canonical_url, p.url) END AS canonical
    FROM pages p LEFT JOIN ({_CANONICAL}) c USING (page_id)"""
)
def canonical_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical link in a page's HTML: another page of the site, the page itself, or one elsewhere."""
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<head><link href='/c/"), F.col("page_id"), F.lit("' rel='alternate CANONICAL'>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<head><link rel="canonical" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'))).otherwise(F.lit('<head><link rel="canonical" href="https://elsewhere.test/">'))
    rows = _table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<head>"), head))
    return source.rendered(rows).select("page_id", crawl.canonical_target(F.col("url"), F.col("canonical"), _own_scope()).alias("canonical"))


# robots.txt texts, the agent, the delay that they ask for, and the one that holds where 1.5 s are configured.
DELAYS = (
    ("User-agent: *\nCrawl-delay: 7", "loom/1.0", 7.0, 7.0), ("User-agent: *\nCrawl-delay: 1", "loom/1.0", 1.0, 1.5), ("User-agent: *\nCrawl-delay: soon", "loom/1.0", None, 1.5),
    ("User-agent: other\nCrawl-delay: 9", "loom/1.0", None, 1.5), ("User-agent: loom\nCrawl-delay: 4\n\nUser-agent: *\nCrawl-delay: 2", "loom/1.0", 4.0, 4.0), ("", "loom/1.0", None, 1.5),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if own is None else own}::DOUBLE, {held}::DOUBLE)" for k, (_, _, own, held) in enumerate(DELAYS)) + ") t(case_id, crawl_delay, effective)")
def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waits that robots.txt files ask for."""
    read = [(k, Robots.parse(text, agent)) for k, (text, agent, _, _) in enumerate(DELAYS)]
    return spark.createDataFrame([(k, r.crawl_delay, effective_delay(1.5, r)) for k, r in read], "case_id int, crawl_delay double, effective double")


@query(golden.SQL_FAULTS)
def crawl_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that fail in different ways: whose fault it is decides what becomes of the page and of the crawl."""
    out = golden.faulty(spark)
    return out.select("site", "kind", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("status", "stop_reason").alias("status"), F.coalesce("attempts", "exit_code").alias("n"))


@query(golden.SQL_STATE)
def crawl_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small site crawled three pages at a time, each run going on with the state that the one before has left."""
    return golden.in_rounds(spark, 3).select("url", "status", "depth", "attempts", F.coalesce("link_count", F.lit(-1)).alias("link_count"))


@query("SELECT 'max-pages' AS stop_reason, 3::BIGINT AS visited, 0 AS exit_code")
def crawl_page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.crawled(spark, max_pages=3).where("kind = 'stats'").select("stop_reason", "visited", "exit_code")


# -- graph -----------------------------------------------------------------------------------------------------------

_GRAPH = "SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem"
_BFS = "WITH RECURSIVE e AS ({g}), x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(url, depth) AS (SELECT 's1', 0 UNION SELECT x.b, r.depth + 1 FROM r JOIN x ON x.a = r.url WHERE r.depth < {d}) SELECT url, min(depth)::INT AS depth FROM r GROUP BY url"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    rows = checkpointed(rows)
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(_BFS.format(g=_GRAPH, d=16))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's distance from a supplier in the graph of suppliers and parts."""
    return crawl.breadth_first(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "url string"))


@query(_BFS.format(g=_GRAPH, d=2))
def bfs_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.breadth_first(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "url string"), max_depth=2)


@query(golden.SQL_STATE)
def fixture_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small site's crawl in its exact order, with redirects, a canonical link and a missing page."""
    return golden.crawled(spark).where("kind = 'page'").select("url", "status", "depth", "attempts", F.coalesce("link_count", F.lit(-1)).alias("link_count"))


@query(golden.SQL_STATS)
def fixture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.crawled(spark).where("kind = 'stats'").select("discovered", "visited", "failed", "redirected", "duplicates", "skipped", "stop_reason", "exit_code")


@query(
    f"""WITH c AS ({_CANONICAL}), h AS (SELECT min(page_id) AS page_id, regexp_extract(canonical_url, '^[^:]+://([^/]*)', 1) AS site, canonical_url FROM c GROUP BY canonical_url),
    t AS (SELECT h.site, count(DISTINCT {_TARGET}) AS found FROM h JOIN ({_LINKS}) l USING (page_id) WHERE {_SUFFIX_OK} AND {_TARGET} NOT IN (SELECT canonical_url FROM c) GROUP BY 1)
    SELECT h.site, count(DISTINCT h.canonical_url) AS visited, coalesce(max(t.found), 0) AS failed FROM h LEFT JOIN t USING (site) GROUP BY 1"""
)
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites of the pages crawled side by side from their recorded pages; links lead to pages without a record."""
    pages = _table(spark, sf_dir, "pages")
    own = _own_scope()
    rows = source.rendered(pages).withColumn("own", urls.canonical(F.col("url"), F.col("url"), own)).where("own is not null")
    one = rows.groupBy("own").agg(F.min_by(F.struct("url", "base", "links", "canonical"), "page_id").alias("r")).select(Parts.of(F.col("own")).host.alias("site"), F.col("own").alias("url"), F.lit(1).alias("attempt"), F.col("own").alias("final_url"), "r.links", "r.canonical", "r.base", F.lit(None).cast("string").alias("fault"), F.lit(True).alias("retryable"), F.lit("").alias("message"))
    log = crawl.fetch_log(one, ScopeColumns.of(F.col("url"), restrict_to_path=False))
    out = crawl.crawl_sites(one.select("site", "url"), log, crawl.Limits(max_consecutive_failures=None))
    return out.where("kind = 'stats'").select("site", "visited", "failed")


# -- sitemaps and reports --------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(_table(spark, sf_dir, "pages")).select(F.col("canonical_url").alias("loc")).distinct()


@query(f"SELECT DISTINCT canonical_url AS loc, strlen(canonical_url) + 96 AS byte_estimate FROM ({_CANONICAL}) ORDER BY loc")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("loc", sitemap.byte_estimate(F.col("loc")).cast("long").alias("byte_estimate")).orderBy("loc")


@query(f"SELECT loc, (row_number() OVER (ORDER BY loc) - 1) // 40 AS chunk FROM (SELECT DISTINCT canonical_url AS loc FROM ({_CANONICAL}))")
def sitemap_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.chunk_by_count(_entries(spark, sf_dir), 40).select("loc", "chunk")


@query(
    f"""SELECT chunk, count(*) AS n_urls, 'https://example.com/sitemap-' || (chunk + 1) || '.xml' AS loc
    FROM (SELECT (row_number() OVER (ORDER BY loc) - 1) // 40 AS chunk FROM (SELECT DISTINCT canonical_url AS loc FROM ({_CANONICAL}))) GROUP BY chunk"""
)
def sitemap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a split sitemap, as its index lists them."""
    files = sitemap.chunk_by_count(_entries(spark, sf_dir), 40).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_urls"))
    return files.withColumn("loc", F.concat(F.lit("https://example.com/sitemap-"), F.col("chunk") + 1, F.lit(".xml")))


@query(
    f"""WITH RECURSIVE s AS (SELECT loc, strlen(loc) + 96 AS size, row_number() OVER (ORDER BY loc) AS n FROM (SELECT DISTINCT canonical_url AS loc FROM ({_CANONICAL}))),
    f(n, loc, chunk, held, k) AS (
      SELECT n, loc, 0, size, 1 FROM s WHERE n = 1
      UNION ALL
      SELECT s.n, s.loc, f.chunk + CASE WHEN f.k >= 9 OR f.held + s.size > 1200 THEN 1 ELSE 0 END, CASE WHEN f.k >= 9 OR f.held + s.size > 1200 THEN s.size ELSE f.held + s.size END,
             CASE WHEN f.k >= 9 OR f.held + s.size > 1200 THEN 1 ELSE f.k + 1 END
      FROM f JOIN s ON s.n = f.n + 1)
    SELECT loc, chunk::BIGINT AS chunk FROM f"""
)
def sitemap_chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).withColumn("site", F.lit("all"))
    return sitemap.chunk_by_size(rows, max_urls=9, max_bytes=1200).select("loc", "chunk")


def _sitemap_files(spark: SparkSession, sf_dir: str) -> str:
    folder = retries.folder(spark)
    sitemap.write_sitemap_parts(_entries(spark, sf_dir).withColumn("lastmod", F.lit(date(2024, 5, 6))), folder, "https://example.com/maps", max_urls=40, today=date(2024, 5, 7))
    return folder


@query(f"SELECT loc, DATE '2024-05-06' AS lastmod, (row_number() OVER (ORDER BY loc) - 1) // 40 AS chunk FROM (SELECT DISTINCT canonical_url AS loc FROM ({_CANONICAL}))")
def sitemap_urlset_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a split sitemap, read back from its XML files."""
    folder = _sitemap_files(spark, sf_dir)
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod date, chunk long").load(f"{folder}/files")


@query(
    f"""SELECT chunk, DATE '2024-05-07' AS lastmod, 'https://example.com/maps/files/chunk=' || chunk || '/' AS folder
    FROM (SELECT DISTINCT (row_number() OVER (ORDER BY loc) - 1) // 40 AS chunk FROM (SELECT DISTINCT canonical_url AS loc FROM ({_CANONICAL})))"""
)
def sitemap_index_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a split sitemap's index lists, read back from its XML."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod date").load(f"{_sitemap_files(spark, sf_dir)}/index")
    return rows.select(F.regexp_extract("loc", "chunk=([0-9]+)/", 1).cast("long").alias("chunk"), "lastmod", F.regexp_extract("loc", "^(.*/)", 1).alias("folder"))


@query("SELECT '/o/' || o_orderkey AS loc, strftime(o_orderdate, '%Y-%m-%d') AS lastmod FROM orders WHERE o_orderstatus = 'F' ORDER BY loc")
def sitemap_lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each finished URL's visit, as a sitemap lists it."""
    o = _table(spark, sf_dir, "orders")
    state = o.select(F.concat(F.lit("/o/"), F.col("o_orderkey")).alias("url"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), F.col("o_orderdate").cast("timestamp").alias("visited_at"))
    return frontier.visited(state).select(F.col("url").alias("loc"), F.date_format("visited_on", "yyyy-MM-dd").alias("lastmod"))


@query("SELECT 'c' || o_custkey % 50 AS site, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued FROM orders GROUP BY 1")
def sites_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return report.sites_report(o.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("site"), status.alias("status")))


@query(f"SELECT DISTINCT lower(netloc) AS site FROM ({_PARTS}) ORDER BY site")
def site_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites that have pages, in order."""
    return source.sites(_table(spark, sf_dir, "pages").select(Parts.of(F.col("url")).host.alias("site")))


@query("SELECT * FROM (VALUES ('base_url', 'https://b.test/'), ('schema_version', '2'), ('note', 'kept')) t(key, value)")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([("base_url", "https://a.test/"), ("note", "kept")], "key string, value string")
    return frontier.set_meta(meta, spark.createDataFrame([("base_url", "https://b.test/"), ("schema_version", "2")], "key string, value string"))


@query(
    f"""SELECT url, CASE WHEN depth % 4 = 0 THEN 'done' WHEN depth % 4 = 1 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN depth % 4 = 3 THEN 0 ELSE 1 END AS attempts,
    CASE WHEN depth % 4 = 2 THEN '2024-02-01 00:00:08' END AS due, CASE WHEN depth % 4 > 0 THEN 'x' END AS note
    FROM (SELECT canonical_url AS url, min({_DEPTH} + page_id % 4)::INT AS depth FROM ({_CANONICAL}) GROUP BY 1)"""
)
def outcome_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs of a frontier claimed, and their outcomes put into it."""
    rows = _canonical(_table(spark, sf_dir, "pages"))
    depth = F.length("canonical_url") - F.length(F.replace("canonical_url", F.lit("/"), F.lit(""))) - 3 + F.col("page_id") % 4
    state = checkpointed(frontier.fresh(rows.select(F.col("canonical_url").alias("url"), depth.alias("depth")), NOW))
    state = frontier.charge(state, frontier.claim(state, NOW, most=None))
    event = F.element_at(F.lit(["done", "failed", "defer", "release"]), (F.col("depth") % 4 + 1).cast("int"))
    outcomes = state.select("url", event.alias("event"), F.lit("x").alias("note"), F.lit(3).alias("link_count"), F.lit(8.0).alias("delay"))
    return frontier.apply(state, outcomes, NOW).select("url", "status", "attempts", _text(F.col("next_attempt_at")).alias("due"), "note")


@query(f"""SELECT url, status, attempts FROM ({_STATE.replace("THEN 'skipped'", "THEN 'done'")})""")
def retry_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each URL's last state in the stream of attempts."""
    folder = retries.folder(spark)
    log = _log(spark, sf_dir).select("url", F.col("event_id").alias("seq"), "at", (F.col("event_type") != "error").alias("ok"), F.lit(True).alias("retryable"))
    log.write.parquet(f"{folder}/log")
    session = retries.stream_session(spark)
    stream = session.readStream.schema("url string, seq long, at timestamp, ok boolean, retryable boolean").parquet(f"{folder}/log")
    states = retries.drain(session, retries.retry_states(stream), folder)
    last = spark.read.schema(states.schema).parquet(*{f.rsplit("/", 1)[0] for f in states.inputFiles()}).groupBy("url").agg(F.max_by(F.struct("status", "attempts"), F.struct("at", "seq")).alias("s"))
    return last.select("url", "s.status", F.col("s.attempts").cast("long").alias("attempts"))
