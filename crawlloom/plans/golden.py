"""A small recorded site, and what a crawl of it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import crawl
from ..operators.scope import Scope
from ..sources.shared import checkpointed

BASE = "https://site.test/"
# The site's links, redirects, canonical link and missing page.
LINKS = {
    "/index.html": ["/about.html", "/products/index.html", "/contact.html", "/missing.html", "/about.html#top", "/brochure.pdf", "https://elsewhere.test/", "/index.html"],
    "/about.html": ["/index.html", "/contact.html", "/moved.html", "/products", "/deep/1.html"],
    "/contact.html": ["/index.html", "mailto:a@b.c"],
    "/products/index.html": ["/products/a.html", "/products/b.html", "/index.html"],
    "/products/a.html": ["/products/b.html", "/products/"],
    "/products/b.html": ["/products/a.html"],
    "/deep/1.html": ["/deep/2.html"],
    "/deep/2.html": ["/deep/3.html"],
    "/deep/3.html": ["/index.html"],
}
REDIRECTS = {"/moved.html": "/about.html", "/products": "/products/index.html"}
CANONICAL = {"/products/index.html": "/products/"}
MISSING = ["/missing.html"]

# Url, status, depth, attempts, links.
STATE = [
    ("/index.html", "done", 0, 1, 5), ("/about.html", "done", 1, 1, 5), ("/contact.html", "done", 1, 1, 1), ("/missing.html", "failed", 1, 1, None), ("/products/index.html", "duplicate", 1, 1, None),
    ("/products/", "done", 1, 0, 3), ("/products/a.html", "done", 2, 1, 2), ("/products/b.html", "done", 2, 1, 1), ("/deep/1.html", "done", 2, 1, 1), ("/moved.html", "redirected", 2, 1, None),
    ("/products", "redirected", 2, 1, None), ("/deep/2.html", "done", 3, 1, 1), ("/deep/3.html", "done", 4, 1, 1),
]
SQL_STATE = "SELECT url, status, depth::INT AS depth, attempts::INT AS attempts, link_count::INT AS link_count FROM (VALUES " + ", ".join(f"('{BASE[:-1]}{u}', '{s}', {d}, {a}, {-1 if k is None else k})" for u, s, d, a, k in STATE) + ") t(url, status, depth, attempts, link_count)"
SQL_STATS = "SELECT 12::BIGINT AS discovered, 9::BIGINT AS visited, 1::BIGINT AS failed, 2::BIGINT AS redirected, 2::BIGINT AS duplicates, 0::BIGINT AS skipped, 'frontier-empty' AS stop_reason, 0 AS exit_code"


def fetches(spark: SparkSession) -> DataFrame:
    rows = []
    for path in [*LINKS, *REDIRECTS, *MISSING]:
        final = REDIRECTS.get(path, path)
        fault = "url" if path in MISSING else None
        canonical = CANONICAL.get(final)
        rows.append(("site", BASE[:-1] + path, 1, BASE[:-1] + final, LINKS.get(final), canonical, fault, False, "HTTP 404" if fault else None))
    return spark.createDataFrame(rows, "site string, url string, attempt int, final_url string, links array<string>, canonical string, fault string, retryable boolean, message string")


def crawled(spark: SparkSession, max_pages: int | None = None, state: DataFrame | None = None) -> DataFrame:
    seeds = state if state is not None else spark.createDataFrame([("site", BASE + "index.html")], "site string, url string")
    log = crawl.fetch_log(fetches(spark), Scope.from_url(BASE).columns())
    return crawl.crawl_sites(seeds, log, crawl.Limits(max_attempts=1, max_pages=max_pages))


def in_rounds(spark: SparkSession, pages: int) -> DataFrame:
    """The state after runs of so many pages each, until nothing is queued."""
    state = None
    while state is None or not state.where("status = 'queued'").isEmpty():
        state = checkpointed(crawled(spark, pages, state).where("kind = 'page'").select("site", "url", "status", "depth", "attempts", "link_count", "note"))
    return state


# Sites and the answers of their pages, try by try: (site, url, links or None, fault, retryable).
FAULTS = [
    ("flaky", "a", ["b", "c"], None, True), ("flaky", "b", None, "url", True), ("flaky", "b", [], None, True), ("flaky", "c", None, "not-html", False),
    ("down", "a", ["b", "c", "d"], None, True), ("down", "b", None, "site", True), ("down", "c", None, "site", True), ("down", "d", None, "site", True),
    ("nobrowser", "a", None, "browser", True), ("gone", "a", None, "url", False), ("stuck", "a", ["b"], None, True), ("stuck", "b", None, "url", True),
]
# What becomes of them: (site, url, status, attempts) of pages, and (site, '', why it stopped, exit code) of crawls.
OUTCOMES = [
    ("flaky", "a", "done", 1), ("flaky", "b", "done", 2), ("flaky", "c", "skipped", 1), ("flaky", "", "frontier-empty", 0),
    ("down", "a", "done", 1), ("down", "b", "queued", 0), ("down", "c", "queued", 0), ("down", "d", "queued", 0), ("down", "", "site-unreachable", 1),
    ("nobrowser", "a", "queued", 0), ("nobrowser", "", "renderer-unavailable", 1), ("gone", "a", "failed", 1), ("gone", "", "frontier-empty", 1),
    ("stuck", "a", "done", 1), ("stuck", "b", "failed", 3), ("stuck", "", "frontier-empty", 0),
]
SQL_FAULTS = "SELECT site, CASE WHEN url = '' THEN 'stats' ELSE 'page' END AS kind, url, status, n FROM (VALUES " + ", ".join(f"('{s}', '{u}', '{x}', {n}::INT)" for s, u, x, n in OUTCOMES) + ") t(site, url, status, n)"


def faulty(spark: SparkSession) -> DataFrame:
    tries: dict[tuple[str, str], int] = {}
    rows = []
    for site, url, links, fault, retryable in FAULTS:
        k = tries[site, url] = tries.get((site, url), 0) + 1
        rows.append((site, url, k, url, None, links, None, fault, retryable, "m", True))
    log = spark.createDataFrame(rows, "site string, url string, attempt int, final string, target string, links array<string>, canonical_target string, fault string, retryable boolean, message string, allowed boolean")
    seeds = spark.createDataFrame([(s, "a") for s in dict.fromkeys(x[0] for x in FAULTS)], "site string, url string")
    return crawl.crawl_sites(seeds, log, crawl.Limits(max_consecutive_failures=3, max_restarts=2))
