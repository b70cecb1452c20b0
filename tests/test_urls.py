import random
from pathlib import Path
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.operators.scope import LinkRules, Scope, ScopeError, same_site

BASE = "https://example.com/"
# A link is put together of one part of each kind, so that every step of the canonical form meets every other.
SCHEMES = ["", "", "", "https:", "http:", "HTTPS:", "mailto:", "javascript:", "ftp:"]
HOSTS = ["", "", "", "//example.com", "//EXAMPLE.com", "//www.example.com", "//notexample.com", "//example.com.test", "//me:pw@example.com", "//example.com:443", "//example.com:80", "//example.com:8443", "//example.com:x", "//[::1", "//"]
PATHS = ["", "", "/", "/a", "a", "./a", "../a", "../../../a", "/a/../b", "/a/./b", "/a//b", "a//./b/..", "..", ".", "/..", "/d/", "/.pdf", "/a.PDF", "/a.pdf/", "/a.html", "/a;", ";", "/2//", "/a b", " /a ", "/a\tb"]
QUERIES_ = ["", "", "", "?", "?b=2&a=1", "?flag", "?flag=", "?utm_source=x&k=%C3%A9", "?REF=x", "?a=%zz&b=x+y&&c=*~é", "?f=a.pdf"]
FRAGMENTS = ["", "", "#", "#top", "#/x"]
PAGES = [BASE, BASE + "p", BASE + "p/q/", BASE + "p/q/r?s=1#t"]
PORTS = {"http": 80, "https": 443}


def mixed_links(n, seed):
    r = random.Random(seed)
    fixed = [(x, BASE) for x in (None, "", "  ", "\t")]
    return fixed + [("".join(map(r.choice, (SCHEMES, HOSTS, PATHS, QUERIES_, FRAGMENTS))), r.choice(PAGES)) for _ in range(n)]


def plainly(href, page):
    """The canonical form by the standard library, in the scope of BASE."""
    text = (href or "").strip()
    try:
        whole = urljoin(page, text)
        u = urlsplit(whole)
        usual = u.port in (None, PORTS.get(u.scheme))
    except ValueError:
        return None
    stem, dot, suffix = u.path.rpartition("/")[2].rpartition(".")
    inside = u.scheme in PORTS and usual and u.hostname == urlsplit(BASE).hostname
    if not text or not inside or (stem and dot + suffix.lower() in urls.ASSET_SUFFIXES):
        return None
    pairs = [kv for kv in parse_qsl(u.query, keep_blank_values=True) if kv[0].lower() not in urls.TRACKING_PARAMS]
    return BASE.rstrip("/") + (u.path or "/") + ("?" + urlencode(sorted(pairs)) if pairs else "")


def canonical(spark, cases, policy):
    rows = spark.createDataFrame([(k, h, p) for k, (h, p) in enumerate(cases)], "k int, href string, page string")
    return [r.u for r in rows.withColumn("u", policy.canonical(F.col("href"), F.col("page"))).orderBy("k").collect()]


def test_canonical_as_the_standard_library_has_it(spark):
    cases = mixed_links(1500, 1)
    got, want = canonical(spark, cases, LinkRules.at(BASE)), [plainly(*c) for c in cases]
    assert [(c, g, w) for c, g, w in zip(cases, got, want, strict=True) if g != w] == [] and 200 < sum(w is not None for w in want) < 1400


@settings(max_examples=8, deadline=None, derandomize=True, database=None)
@given(st.lists(st.text("ab./?&=#%:;+~ *é2F", max_size=14), min_size=30, max_size=30))
def test_canonical_of_odd_links(spark, hrefs):
    cases = [(h, BASE + "d/e/f?q=1") for h in hrefs]
    assert canonical(spark, cases, LinkRules.at(BASE)) == [plainly(*c) for c in cases]


def test_policies(spark):
    one = lambda href, page=BASE, **how: canonical(spark, [(href, page)], LinkRules.at(how.pop("base", BASE), **how))[0]
    assert one("#/products", hash_routing=True) == BASE + "#/products"
    assert one("/#!/p/1", hash_routing=True) == BASE + "#!/p/1"
    assert one("#top", hash_routing=True) == BASE
    assert one("/blog/post", base=BASE + "docs/") is None and one("/docs/x", base=BASE + "docs/") == BASE + "docs/x"
    assert one("https://sub.example.com/a", include_subdomains=True) == "https://sub.example.com/a"
    assert one("https://evil-example.com/a", include_subdomains=True) is None
    assert one("/logout", exclude=(r"/logout\b",)) is None and one("/login", exclude=(r"/logout\b",)) == BASE + "login"
    assert one("/c?page=2", keep_query=False) == BASE + "c"
    assert one("/c?sid=1&utm_source=x", strip_params=("sid",)) == BASE + "c?utm_source=x"
    assert canonical(spark, [("http://h:8080/x", "http://h:8080/")], LinkRules.at("http://h:8080/")) == ["http://h:8080/x"]


def test_all_links_of_a_page(spark):
    hrefs = ["/b", "/a", "/b", "/a?utm_source=x", "mailto:x@y.z", None, "#top", "https://other.example/z"]
    rows = spark.createDataFrame([(hrefs,), ([],)], "links array<string>")
    got = rows.select(LinkRules.at(BASE).canonical_all(F.col("links"), F.lit(BASE + "a")).alias("x")).collect()
    assert [r.x for r in got] == [[BASE + "b", BASE + "a"], []]


@pytest.mark.parametrize(("url", "slug"), [(BASE, "example.com"), ("https://example.com:8080/", "example.com_8080"), ("https://example.com:443/", "example.com"), ("http://127.0.0.1:48801/index.html", "127.0.0.1_48801"), (BASE + "docs/", "example.com_docs"), (BASE + "blog/g.html", "example.com_blog"), (BASE + "a/b/", "example.com_a_b")])
def test_slugs(spark, url, slug):
    assert Scope.from_url(url).slug == slug
    assert spark.range(1).select(urls.ScopeColumns.of(F.lit(url)).slug.alias("s")).first().s == slug


@pytest.mark.parametrize("url", [BASE + "../x/", BASE + ".hidden/", BASE + "..%2F..%2F/", BASE + "a b/c'd/", "https://xn--/", "https://приклад.укр/"])
def test_slugs_are_one_folder(url):
    slug = Scope.from_url(url).slug
    assert Path(slug).parts == (slug,) and not slug.startswith(".")


def test_scopes():
    assert Scope.from_url(BASE + "docs/guide.html").path_prefix == "/docs/" and Scope.from_url(BASE + "docs/", restrict_to_path=False).path_prefix == "/"
    for bad in ("ftp://example.com", "mailto:a@b.c", "not a url", "/relative", "https://h:notaport/", "https://"):
        with pytest.raises(ScopeError):
            Scope.from_url(bad)
    assert same_site(BASE, "https://EXAMPLE.com:443") and not same_site(BASE, "http://example.com/") and not same_site("not a url", "not a url")


def test_plain_links_take_the_short_way_to_the_same_end(spark, monkeypatch):
    cases = mixed_links(400, 2)
    rules = [LinkRules.at(BASE), LinkRules.at(BASE + "p/", include_subdomains=True, hash_routing=True, exclude=("b$",)), LinkRules.at(BASE, keep_query=False, strip_params=("b",))]
    fast = [canonical(spark, cases, r) for r in rules]
    monkeypatch.setattr(urls, "_PLAIN_LINK", r"(?!)()()()()")
    monkeypatch.setattr(urls, "_PLAIN_PAGE", r"(?!)()()()")
    assert [canonical(spark, cases, r) for r in rules] == fast


def test_absolute_urls(spark):
    cases = [("/x?y=1#z", BASE + "a/b"), ("x/../y", BASE + "a/b"), ("https://other.test:81/p", BASE), ("//h/x", BASE), ("", BASE + "a?b=1"), ("?q", BASE + "a?b=1")]
    rows = spark.createDataFrame([(k, h, p) for k, (h, p) in enumerate(cases)], "k int, href string, page string")
    got = [r.u for r in rows.withColumn("u", urls.absolute(F.col("href"), F.col("page"))).orderBy("k").collect()]
    assert got == [urljoin(p, h) for h, p in cases]


def test_dots_above_the_root(spark):
    cases = [(h, BASE + p) for h in ("../../../up", "../../../../up/x", "/../x", "/../../a/../../b/", "/..//x", "../../../..", "../../../a/..", "https:../../../a?flag#") for p in ("", "p", "d/e/f?x=1", "d/e/")]
    want = [plainly(*c) for c in cases]
    assert canonical(spark, cases, LinkRules.at(BASE)) == want and None not in want
    rows = spark.createDataFrame([(k, h, p) for k, (h, p) in enumerate(cases)], "k int, href string, page string")
    assert [r.u for r in rows.withColumn("u", urls.absolute(F.col("href"), F.col("page"))).orderBy("k").collect()] == [urljoin(p, h).removesuffix("#") for h, p in cases]
