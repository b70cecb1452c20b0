import random
import xml.etree.ElementTree as ET
from collections import deque
from datetime import date, datetime
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from crawlloom.operators import crawl, frontier, report, retry, sitemap
from crawlloom.operators.robots import Robots, effective_delay, filter_allowed
from crawlloom.sources import pages as source

NOW = "2024-01-01 00:00:00"


def frontier_of(spark, *urls, depth=0):
    return frontier.fresh(spark.createDataFrame([(u, depth) for u in urls], "url string, depth int"), NOW)


def test_enqueue_keeps_what_is_known(spark):
    state = frontier_of(spark, "b", "a", "a")
    more = spark.createDataFrame([("a", 5), ("c", 2), ("c", 1), (None, 0)], "url string, depth int")
    assert sorted((r.url, r.depth) for r in frontier.enqueue(state, more, NOW).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert frontier.unknown(state, more, NOW).count() == 1


def test_claim_order_and_charge(spark):
    state = frontier.enqueue(frontier_of(spark, "z", depth=1), spark.createDataFrame([("y", 0), ("x", 0)], "url string, depth int"), NOW)
    claimed = frontier.claim(state, NOW, most=2)
    assert [(r.url, r.attempts) for r in claimed.collect()] == [("x", 1), ("y", 1)]
    charged = frontier.charge(state, claimed)
    assert {r.url: r.attempts for r in charged.collect()} == {"x": 1, "y": 1, "z": 0}
    assert [r.url for r in frontier.claim(charged, NOW, max_attempts=1, most=None).collect()] == ["z"]


def test_outcomes(spark):
    state = frontier.charge(frontier_of(spark, *"abcdefgh"), frontier.claim(frontier_of(spark, *"abcdefgh"), NOW, most=None))
    events = [("a", "done", None, 3, None), ("b", "failed", "x", None, None), ("c", "defer", "later", None, 8.0), ("d", "defer", "now", None, 0.0), ("e", "release", "r", None, None), ("f", "redirected", "-> a", None, None), ("g", "requeue", "q", None, None)]
    after = frontier.apply(state, spark.createDataFrame(events, "url string, event string, note string, link_count int, delay double"), NOW)
    rows = {r.url: r for r in after.collect()}
    assert (rows["a"].status, rows["a"].link_count, rows["a"].visited_at) == ("done", 3, datetime(2024, 1, 1))
    assert (rows["b"].status, rows["b"].note) == ("failed", "x") and (rows["f"].status, rows["f"].note) == ("redirected", "-> a")
    assert (rows["c"].status, rows["c"].next_attempt_at) == ("queued", datetime(2024, 1, 1, 0, 0, 8)) and rows["d"].next_attempt_at is None
    assert rows["e"].attempts == 0 and rows["g"].attempts == 1 and rows["h"].status == "queued"
    again = frontier.apply(after, spark.createDataFrame([("a", "done", None, 9, None)], "url string, event string, note string, link_count int, delay double"), "2024-01-02 00:00:00")
    assert {r.url: r.link_count for r in again.collect()}["a"] == 3
    assert frontier.until_due(after, NOW).first().seconds == 8 and frontier.until_due(after, "2024-01-03 00:00:00").first().seconds == 0
    assert frontier.until_due(frontier_of(spark, "q"), NOW).first().seconds is None
    assert {r.status: r.n for r in frontier.counts(after).collect()} == {"queued": 5, "done": 1, "failed": 1, "skipped": 0, "redirected": 1, "duplicate": 0}
    assert [tuple(r) for r in frontier.problems(after).collect()] == [("failed", "b", "x")]
    assert [tuple(r) for r in frontier.visited(after).collect()] == [("a", date(2024, 1, 1))]
    assert frontier.has_pending(after) and not frontier.has_pending(frontier.empty(spark))
    assert "failed: 1" in report.status_text(after, "https://h/")


def test_meta_and_migration(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in frontier.set_meta(meta, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    old = frontier_of(spark, "a").drop("next_attempt_at")
    assert frontier.migrate(old, 1).columns == frontier.SCHEMA.names
    for bad in (3, "x"):
        with pytest.raises(ValueError):
            frontier.migrate(old, bad)


def test_backoff(spark):
    delay = lambda n, spread=0.5, **k: spark.range(1).select(retry.Backoff(**k).delay(F.lit(n), spread).alias("d")).first().d
    assert [delay(n) for n in (0, 1, 2, 3, 4, 9)] == [2, 2, 8, 32, 128, 300]
    assert delay(1, 0.0) == 1.5 and delay(1, 1.0) == 2.5 and delay(3, base=0) == 0


@pytest.mark.parametrize(("message", "kind"), [("Tab Crashed\nmore", "browser"), ("net::ERR_CONNECTION_REFUSED", "site"), ("chrome not reachable: err_connection_reset", "browser"), ("timeout", "url"), ("", "url")])
def test_faults(spark, message, kind):
    r = spark.range(1).select(retry.fault(F.lit(message)).alias("k"), retry.brief(F.lit(message)).alias("b")).first()
    assert r.k == kind and r.b == message.split("\n")[0]


def test_breaker(spark):
    log = spark.createDataFrame([("u", k, c) for k, c in enumerate("xx.xxx.xxxx")] + [("v", k, "x") for k in range(2)], "k string, n int, c string")
    runs = {(r.k, r.n): r.run_length for r in retry.failure_runs(log, "k", ["n"], F.col("c") == "x").collect()}
    assert [runs["u", k] for k in range(11)] == [1, 2, 0, 1, 2, 3, 0, 1, 2, 3, 4]
    assert [(r.k, r.n) for r in retry.breaker_trips(log, "k", ["n"], F.col("c") == "x", 3).collect()] == [("u", 5)]


ROBOTS = """User-agent: other
User-agent: loom
Disallow: /private/
Allow: /private/open
Disallow: /a%3cb
Crawl-delay: 7

User-agent: *
Disallow:
Crawl-delay: 2.5
"""


@pytest.mark.parametrize("agent", ["loom/1.0", "Mozilla", "otherbot"])
def test_robots_as_the_standard_library_reads_them(spark, agent):
    plain = RobotFileParser()
    plain.parse(ROBOTS.splitlines())
    robots = Robots.parse(ROBOTS, agent)
    paths = ["/", "", "/private/x", "/private/open", "/privat", "/a<b/c", "/a%3Cb", "/é?x=1&y=2", "/q?a=b c"]
    rows = spark.createDataFrame([("https://h" + p,) for p in paths], "url string").withColumn("ok", robots.allowed(F.col("url"))).collect()
    want = {"https://h" + p: plain.can_fetch(agent, "https://h" + p) for p in paths}
    assert {r.url: r.ok for r in rows} == want and {u: robots.allows(u) for u in want} == want
    assert robots.crawl_delay == (7.0 if agent != "Mozilla" else None)


def test_robots_tables_and_failures(spark):
    rules = spark.createDataFrame([("s", 1, "/x", False), ("s", 0, "/x/y", True)], "site string, seq int, prefix string, allow boolean")
    urls = spark.createDataFrame([("s", "https://h/x/y/z"), ("s", "https://h/x"), ("t", "https://h/x")], "site string, url string")
    assert sorted((r.site, r.url, r.allowed) for r in filter_allowed(urls, rules).collect()) == [("s", "https://h/x", False), ("s", "https://h/x/y/z", True), ("t", "https://h/x", True)]

    def broken(url):
        raise OSError

    assert Robots.load("https://h/a", "loom", broken).allows("https://h/x") and not Robots.load("https://h/a", "loom", lambda u: "User-agent: *\nDisallow: /").allows("https://h/x")
    assert effective_delay(1.0, Robots((), 3.0)) == 3.0


def test_html(spark):
    html = """<!-- <a href="/no"> --><script>var x = '<a href="/no">'</script><A class=x HREF='/one?a=1&amp;b=2'>t</A><a href=/two>u</a><a name="n">v</a><abbr href="/no">w</abbr><a
      title="a > b" href="">x</a><link rel="stylesheet" href="/s.css"><link href="/c" rel="Alternate Canonical"><link rel=canonical href=/d>"""
    r = source.rendered(spark.createDataFrame([(1, "u", html), (2, "v", None), (3, "w", "")], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert r[0].links == ["/one?a=1&b=2", "/two", ""] and r[0].canonical == "/c" and not r[1].links and r[2].links == [] and r[2].canonical is None


def test_sitemap_files(spark, tmp_path):
    rows = [(f"https://h/{k:03}?a=1&b=<é>", date(2024, 1, 1) if k % 2 else None) for k in range(25)]
    entries = spark.createDataFrame(rows, "loc string, lastmod date")
    one = sitemap.write_sitemap(entries, str(tmp_path / "s.xml"))
    text = (tmp_path / "s.xml").read_text(encoding="utf-8")
    assert one.url_count == 25 and one.index is None and text.startswith("<?xml version='1.0' encoding='utf-8'?>\n<urlset xmlns=") and "\n  <url>\n    <loc>https://h/000?a=1&amp;b=&lt;é&gt;</loc>\n  </url>" in text
    many = sitemap.write_sitemap(entries, str(tmp_path / "m.xml"), "https://h/x/", max_urls=10, today=date(2024, 2, 3))
    assert [f.rsplit("/", 1)[1] for f in many.files] == ["m-1.xml", "m-2.xml", "m-3.xml"] and many.url_count == 25
    assert "<loc>https://h/m-2.xml</loc>" in (tmp_path / "m.xml").read_text() and "2024-02-03" in (tmp_path / "m.xml").read_text()
    with pytest.raises(sitemap.SitemapError):
        sitemap.write_sitemap(entries.limit(0), str(tmp_path / "e.xml"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m-1.xml", "m-2.xml", "m-3.xml", "m.xml", "s.xml"]
    empty = sitemap.write_sitemap(entries.limit(0), str(tmp_path / "e.xml"), allow_empty=True)
    assert empty.url_count == 0 and "<urlset" in (tmp_path / "e.xml").read_text()


def test_sitemap_parts_keep_both_limits(spark, tmp_path):
    rows = [(f"https://h/{k:03}?a=1&b=" + "<&é" * (k % 40), date(2024, 1, 1) if k % 2 else None) for k in range(300)]
    entries = spark.createDataFrame(rows, "loc string, lastmod date")
    for limits in ({"max_urls": 70}, {"max_bytes": 20_000}):
        path = str(tmp_path / "-".join(limits))
        n = sitemap.write_sitemap_parts(entries, path, "https://h/maps/", today=date(2024, 2, 3), **limits)
        files = sorted((tmp_path / "-".join(limits) / "files").rglob("part-*"))
        assert len(files) == n > 3 and all(f.stat().st_size <= limits.get("max_bytes", 1 << 30) for f in files)
        trees = [ET.fromstring(f.read_bytes()) for f in files]
        assert all(t.tag.endswith("urlset") and len(t) <= limits.get("max_urls", 1 << 30) for t in trees)
        locs = [u[0].text for t in trees for u in t]
        assert sorted(locs) == sorted(x for x, _ in rows)
        (index,) = (tmp_path / "-".join(limits) / "index").rglob("part-*")
        listed = [u[0].text for u in ET.fromstring(index.read_bytes())]
        assert sorted(listed) == sorted("https://h/maps/" + str(f.relative_to(path)) for f in files)
    for bad in ({"max_bytes": 100}, {}):
        with pytest.raises(sitemap.SitemapError):
            sitemap.write_sitemap_parts(entries.limit(1 if bad else 0), str(tmp_path / "bad"), "https://h/", **bad)


def test_character_references(spark):
    cases = {"a&amp;b": "a&b", "&amp;amp;": "&amp;", "&#38;#38;": "&#38;", "x&#x2F;y&eacute;": "x/yé", "?a=1&copy=2": "?a=1&copy=2", "&#128512;&#x1F600;": "😀😀", "&#0;&#xD800;&#9999999;": "\ufffd" * 3, "&nosuch;&": "&nosuch;&", "&quot;&nbsp;": '"\xa0', "plain": "plain", "": "", None: None}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").withColumn("u", source.unescape(F.col("t"))).orderBy("k").collect()
    assert [r.u for r in rows] == list(cases.values())


def test_base_element(spark):
    html = ['<base href="/b/"><base href="/c/">', "<BASE target=x><base href='https://o.test/p/q'>", "<base href=''>", "<!-- <base href='/no/'> -->", None]
    rows = spark.createDataFrame([(k, "https://h/d/e?f", h) for k, h in enumerate(html)], "page_id int, url string, html string")
    assert [r.base for r in source.rendered(rows).orderBy("page_id").collect()] == ["https://h/b/", "https://o.test/p/q", "https://h/d/e?f", "https://h/d/e?f", "https://h/d/e?f"]


def test_backoff_refuses(spark):
    for bad in ({"base": -1}, {"cap": -1}, {"factor": 0.5}, {"jitter": 1}, {"jitter": -0.1}):
        with pytest.raises(ValueError):
            retry.Backoff(**bad)


def test_chunks(spark):
    r = random.Random(1)
    locs = sorted({"".join(r.choice("abc/é") for _ in range(r.randrange(1, 60))) for _ in range(200)})
    want, n, held, chunk = {}, 0, 0, 0
    for loc in sorted(locs, key=lambda x: x.encode()):
        size = len(loc.encode()) + 96
        if n and (n >= 9 or held + size > 1000):
            chunk, n, held = chunk + 1, 0, 0
        want[loc], n, held = chunk, n + 1, held + size
    frame = spark.createDataFrame([("s", x) for x in locs] + [("t", x) for x in locs], "site string, loc string")
    for site in "st":
        assert {x.loc: x.chunk for x in sitemap.chunk_by_size(frame, 9, 1000).where(F.col("site") == site).collect()} == want
    rows = sitemap.chunk_by_count(frame.where("site = 's'").select("loc"), 7).collect()
    assert {x.loc: x.chunk for x in rows} == {x: k // 7 for k, x in enumerate(sorted(locs, key=lambda x: x.encode()))}


@pytest.mark.parametrize("seed", range(3))
def test_breadth_first_against_a_queue(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(90)] + [("n0", None)]
    depth, todo = {"n0": 0}, deque(["n0"])
    while todo:
        u = todo.popleft()
        for a, b in edges:
            if a == u and b is not None and b not in depth:
                depth[b] = depth[u] + 1
                todo.append(b)
    links, seeds = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",), ("n0",), (None,)], "url string")
    assert {x.url: x.depth for x in crawl.breadth_first(links, seeds).collect()} == depth
    assert {x.url: x.depth for x in crawl.breadth_first(links, seeds, 2).collect()} == {u: d for u, d in depth.items() if d <= 2}


LOG = "site string, url string, attempt int, final string, target string, links array<string>, canonical_target string, fault string, retryable boolean, message string, allowed boolean"


def crawled(spark, log, seeds=("a",), limits=crawl.Limits(), **how):
    rows = [("s", u, k, u, None, links, None, fault, retry_, "m", True) for u, k, links, fault, retry_ in log]
    seeds = spark.createDataFrame([("s", x) for x in seeds], "site string, url string")
    out = crawl.crawl_sites(seeds, spark.createDataFrame(rows, LOG), limits, **how).collect()
    return {r.url: (r.status, r.attempts) for r in out if r.kind == "page"}, next(r for r in out if r.kind == "stats")


def test_retries_and_failures(spark):
    log = [("a", 1, ["b", "c", "d", "e"], None, True), ("b", 1, None, "url", True), ("b", 2, [], None, True), ("c", 1, None, "url", True), ("d", 1, None, "url", False), ("e", 1, None, "not-html", False)]
    pages, stats = crawled(spark, log)
    assert pages == {"a": ("done", 1), "b": ("done", 2), "c": ("failed", 3), "d": ("failed", 1), "e": ("skipped", 1)}
    assert (stats.visited, stats.failed, stats.skipped, stats.stop_reason, stats.exit_code) == (2, 2, 1, "still-backing-off", 1) or stats.stop_reason == "frontier-empty"


def test_breaker_and_browser(spark):
    log = [("a", 1, list("bcdef"), None, True)] + [(u, 1, None, "site", True) for u in "bcdef"]
    pages, stats = crawled(spark, log, limits=crawl.Limits(max_consecutive_failures=3))
    assert stats.stop_reason == "site-unreachable" and stats.exit_code == 1 and all(pages[u] == ("queued", 0) for u in "bcdef")
    pages, stats = crawled(spark, [("a", 1, None, "browser", True)], limits=crawl.Limits(max_restarts=2))
    assert (stats.stop_reason, stats.restarts) == ("renderer-unavailable", 2) and pages == {"a": ("queued", 0)}
    pages, stats = crawled(spark, [("a", 1, list("bc"), None, True), ("b", 1, [], None, True), ("c", 1, [], None, True)], limits=crawl.Limits(max_pages=2))
    assert stats.stop_reason == "max-pages" and pages["c"] == ("queued", 0)
    assert crawled(spark, [("a", 1, None, "url", False)])[1].exit_code == 1
    with pytest.raises(ValueError):
        crawl.Limits(max_attempts=0)
