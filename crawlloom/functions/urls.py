"""URL functions as Column builders: split, resolve, scope, clean and canonicalise, all inside the JVM.

A URL that can't be read is null. White space, ports, dots and queries are treated as Python's urllib treats them.

Most links of a site are plain: an absolute path, or a whole URL, of ordinary characters without dot segments, ports or
escapes. Those are taken apart by a few expressions that Spark compiles; only the others go through the general steps,
whose lambdas it interprets. Both give the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name a visit and not a page.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid", "dclid", "fbclid",
    "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "spm",
)
# Suffixes of files that are never pages.
ASSET_SUFFIXES = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".rtf", ".csv", ".txt", ".epub", ".zip", ".gz", ".tgz", ".bz2", ".xz",
    ".7z", ".rar", ".tar", ".dmg", ".iso", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".avif", ".ico", ".tif", ".tiff", ".psd", ".mp3",
    ".mp4", ".m4a", ".m4v", ".avi", ".mov", ".mkv", ".webm", ".wav", ".ogg", ".flac", ".wmv", ".js", ".mjs", ".css", ".map", ".json", ".xml", ".rss",
    ".atom", ".wasm", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".exe", ".msi", ".apk", ".deb", ".rpm", ".pkg", ".bin",
)

_BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]+"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_PLAIN_HOST = r"([a-z0-9.\-]+)"
_PLAIN_PATH = r"(/(?:[A-Za-z0-9_~\-]+/)*(?:[A-Za-z0-9_~\-]+(?:\.[A-Za-z0-9]+)?)?)"
_PLAIN_END = r"(?:\?([\x21\x22\x24-\x7e]*))?(?:#[\x21-\x7e]*)?\z"
#: Groups: scheme, host, path, query. Of a link, with a host or a path; and of a page, whose path may be any.
_PLAIN_LINK = rf"^(?=[h/])(?:(https?)://{_PLAIN_HOST})?(?:{_PLAIN_PATH}|(?=[?#]|\z)){_PLAIN_END}"
_PLAIN_PAGE = rf"^(https?)://{_PLAIN_HOST}((?:/[\x21\x22\x24-\x3e\x40-\x7e]*)?)(?:[?#][\x21-\x7e]*)?\z"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def tidy(url: Column) -> Column:
    """Without white space and control characters around it, nor tabs and line ends inside."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


@dataclass(frozen=True)
class Parts:
    """The parts of a URL as columns: scheme in lower case, everything else as it stands; '' where there is none."""

    scheme: Column
    netloc: Column
    has_netloc: Column
    path: Column
    query: Column
    fragment: Column

    @staticmethod
    def of(url: Column) -> Parts:
        scheme = F.translate(F.regexp_extract(url, _SCHEME, 1), _UPPER, _LOWER)
        rest = F.regexp_replace(url, _SCHEME, "")
        return Parts(
            scheme,
            F.regexp_extract(rest, r"^//([^/?#]*)", 1),
            rest.startswith("//"),
            F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1),
            F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
            F.regexp_extract(rest, r"^[^#]*#([\s\S]*)$", 1),
        )

    def struct(self) -> Column:
        return F.struct(*[getattr(self, f).alias(f) for f in _FIELDS])

    @staticmethod
    def at(struct: Column) -> Parts:
        return Parts(*[struct[f] for f in _FIELDS])

    @property
    def host(self) -> Column:
        """Lower-case host without user, port and brackets."""
        inner = F.nullif(F.regexp_extract(self.netloc, r"^(?:.*@)?\[([^\[\]]*)\]", 1), F.lit(""))
        return F.lower(F.coalesce(inner, F.regexp_extract(self.netloc, r"^(?:.*@)?([^:@]*)(?::.*)?$", 1)))

    @property
    def port(self) -> Column:
        """The port; null for none or the scheme's own, -1 for one that is no port."""
        text = F.regexp_extract(self.netloc, r"^(?:.*@)?(?:\[[^\[\]]*\]|[^:@]*):([^@]*)$", 1)
        number = F.when(text.rlike(r"^[0-9]{1,9}$"), text.cast("int"))
        number = F.when(number <= 65535, number).otherwise(F.lit(-1))
        own = ((self.scheme == "http") & (number == 80)) | ((self.scheme == "https") & (number == 443))
        return F.when((text != "") & ~own, number)

    @property
    def readable(self) -> Column:
        """Whether brackets in the host, if any, pair up."""
        return self.netloc.rlike(r"^[^\[\]]*$") | self.netloc.rlike(r"^(?:.*@)?\[[0-9A-Fa-f:.v]+\](?::.*)?$")


_FIELDS = ("scheme", "netloc", "has_netloc", "path", "query", "fragment")


def _path_joined(base: Column, path: Column) -> Column:
    """A relative path put in place of the last segment of base, with its dots resolved."""
    own, before = F.split(path, "/"), F.split(base, "/")
    kept = F.when(F.element_at(before, -1) == "", before).otherwise(F.slice(before, F.lit(1), F.size(before) - 1))
    # only a path that is joined to the page's own loses its empty segments
    joined = let(F.concat(kept, own), lambda w: F.filter(w, lambda s, k: (k == 0) | (k == F.size(w) - 1) | (s != "")))
    whole = F.when(path.startswith("/"), own).otherwise(joined)

    def step(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def walk(w: Column) -> Column:
        walked = F.aggregate(w, F.array().cast("array<string>"), step)
        return F.array_join(F.concat(walked, F.when(F.element_at(w, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    return let(let(whole, walk), lambda out: F.when(out == "", F.lit("/")).otherwise(out))


def resolved(link: Parts, at: Parts) -> tuple[Parts, Column]:
    """The parts of a link on a page, from the parts of both, and whether they can be read."""
    scheme = F.when(link.scheme == "", at.scheme).otherwise(link.scheme)
    relative = (scheme == at.scheme) & ~(link.has_netloc & (link.netloc != ""))
    # empty parameters at the end of a path are none, where the schemes agree
    path = F.when(scheme == at.scheme, F.regexp_replace(link.path, r"^((?:.*/)?[^/;]*);$", "$1")).otherwise(link.path)
    here = relative & (path == "")
    own = F.regexp_replace(at.path, r"^((?:.*/)?[^/;]*);$", "$1")
    # dots that go above the root take its slash away; below a host it comes back
    joined = let(_path_joined(at.path, path), lambda p: F.when((at.netloc != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p))
    dotted = F.when(here, own).when(relative, F.when(path.rlike(r"^/(?!.*(?://|/\.))[^.]*$"), path).otherwise(joined)).otherwise(path)
    out = Parts(
        scheme,
        F.when(relative, at.netloc).otherwise(link.netloc),
        link.has_netloc | relative,
        dotted,
        F.when(here & (link.query == ""), at.query).otherwise(link.query),
        link.fragment,
    )
    return out, link.readable & at.readable


def asset_suffix(path: Column) -> Column:
    """The last segment's suffix in lower case with its dot; '' without one, and for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]*)$", 1))


def is_asset(path: Column, suffixes: tuple[str, ...] = ASSET_SUFFIXES) -> Column:
    return asset_suffix(path).isin(*suffixes)


def quoted(text: Column) -> Column:
    """Form encoding: letters, digits and _.-~ stay, a space becomes +, all else its bytes."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquoted(text: Column) -> Column:
    """Form decoding; a % that no two hex digits follow stays."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), F.replace(text, F.lit("+"), F.lit(" ")))


def clean_query(query: Column, strip_params: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """The query's parameters without those that are stripped, sorted by decoded name and value, and encoded anew."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(unquoted(F.substring_index(p, "=", 1)).alias("k"), unquoted(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("v")))
    stripped = [p.lower() for p in strip_params]
    kept = F.filter(pairs, lambda q: ~F.lower(q["k"]).isin(*stripped)) if stripped else pairs
    return F.array_join(F.transform(F.array_sort(kept), lambda q: F.concat(quoted(q["k"]), F.lit("="), quoted(q["v"]))), "&")


@dataclass(frozen=True)
class ScopeColumns:
    """The boundary of a site, as columns: null host where the base URL can't anchor one."""

    scheme: Column
    host: Column
    port: Column
    prefix: Column
    subdomains: bool = False

    @staticmethod
    def of(url: Column, subdomains: bool = False, restrict_to_path: bool = True) -> ScopeColumns:
        def read(x: Column) -> Column:
            p = Parts.at(x)
            good = p.scheme.isin("http", "https") & (p.host != "") & p.readable & ~p.port.eqNullSafe(-1)
            path = F.when(p.path == "", F.lit("/")).otherwise(p.path)
            prefix = F.regexp_extract(path, r"^(.*/)[^/]*$", 1) if restrict_to_path else F.lit("/")
            return F.struct(p.scheme.alias("scheme"), F.when(good, p.host).alias("host"), p.port.alias("port"), prefix.alias("prefix"))

        slow, plain = let(let(tidy(url), lambda u: Parts.of(u).struct()), read), url.rlike(_PLAIN_PAGE)
        path = F.regexp_extract(url, _PLAIN_PAGE, 3)
        prefix = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)[^/]*$", 1)) if restrict_to_path else F.lit("/")
        fast = (F.regexp_extract(url, _PLAIN_PAGE, 1), F.regexp_extract(url, _PLAIN_PAGE, 2), F.lit(None).cast("int"), prefix)
        return ScopeColumns(*[F.when(plain, x).otherwise(slow[n]) for x, n in zip(fast, ("scheme", "host", "port", "prefix"), strict=True)], subdomains)

    def struct(self) -> Column:
        return F.struct(self.scheme.alias("scheme"), self.host.alias("host"), self.port.alias("port"), self.prefix.alias("prefix"))

    @staticmethod
    def at(struct: Column, subdomains: bool = False) -> ScopeColumns:
        return ScopeColumns(struct["scheme"], struct["host"], struct["port"], struct["prefix"], subdomains)

    def holds_host(self, host: Column) -> Column:
        same = host == self.host
        return same | host.endswith(F.concat(F.lit("."), self.host)) if self.subdomains else same

    @property
    def netloc(self) -> Column:
        return F.concat(self.host, F.when(self.port.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), self.port.cast("string"))))

    @property
    def origin(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.netloc)

    @property
    def slug(self) -> Column:
        """A folder's name for the scope; hosts outside ASCII are not put into punycode here (Scope.slug does that)."""
        path = F.regexp_replace(F.regexp_replace(self.prefix, r"^/+|/+$", ""), "/", "_")
        parts = F.concat_ws("_", self.host, self.port.cast("string"), F.when(self.prefix != "/", path))
        slug = F.regexp_replace(F.regexp_replace(F.lower(parts), r"[^a-z0-9._\-]+", "-"), r"^[._\-]+|[._\-]+$", "")
        return F.when(slug == "", F.lit("site")).otherwise(slug)


def _context(page: Column, scope: ScopeColumns) -> Column:
    """What links of a page have in common: the page's parts, and its scope."""
    return F.struct(let(tidy(page), lambda p: Parts.of(p).struct()).alias("at"), scope.struct().alias("scope"))


def _in_context(
    href: Column, context: Column, subdomains: bool, strip_params: tuple[str, ...] = TRACKING_PARAMS, keep_query: bool = True,
    hash_routing: bool = False, assets: tuple[str, ...] = ASSET_SUFFIXES,
) -> Column:
    scope = ScopeColumns.at(context["scope"], subdomains)

    def resolve(link: Column) -> Column:
        p, readable = resolved(Parts.at(link), Parts.at(context["at"]))
        return F.struct(p.struct().alias("p"), readable.alias("some"))

    def clean(x: Column) -> Column:
        p = Parts.at(x["p"])
        return F.struct(
            p.host.alias("host"), p.port.alias("port"), F.when(p.path == "", F.lit("/")).otherwise(p.path).alias("path"), (clean_query(p.query, strip_params) if keep_query else F.lit("")).alias("query"),
            F.when(p.fragment.rlike("^[/!]"), p.fragment).alias("fragment"), (x["some"] & p.scheme.isin("http", "https")).alias("some"),
        )

    def join(x: Column) -> Column:
        out = F.concat(
            scope.scheme, F.lit("://"), x["host"], F.when(x["port"].isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), x["port"].cast("string"))), x["path"],
            F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise(F.lit("")),
            F.coalesce(F.concat(F.lit("#"), x["fragment"]), F.lit("")) if hash_routing else F.lit(""),
        )
        keep = x["some"] & scope.holds_host(x["host"]) & x["port"].eqNullSafe(scope.port) & x["path"].startswith(scope.prefix) & ~is_asset(x["path"], assets)
        return F.when(keep, out)

    out = F.when(strip(href) != "", tidy(href))
    for step in (lambda link: Parts.of(link).struct(), resolve, clean, join):
        out = let(out, step)
    return out


def _plainly(href: Column, page: Column, scope: ScopeColumns, strip_params: tuple[str, ...], keep_query: bool, assets: tuple[str, ...]) -> Column:
    """As the general steps, for a plain link on a plain page."""
    part = lambda k: F.regexp_extract(href, _PLAIN_LINK, k)
    host = F.when(part(1) == "", F.regexp_extract(page, _PLAIN_PAGE, 2)).otherwise(part(2))
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    query = F.when(part(4) == "", F.lit("")).otherwise(clean_query(part(4), strip_params)) if keep_query else F.lit("")
    query = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(scope.holds_host(host) & scope.port.isNull() & path.startswith(scope.prefix) & ~is_asset(path, assets), F.concat(scope.scheme, F.lit("://"), host, path, query))


def canonical(href: Column, page: Column, scope: ScopeColumns, **how) -> Column:
    """The canonical URL of a link on a page inside a scope, or null for one that isn't followed.

    Dropped are blank and unreadable links, other schemes than http(s), other hosts, ports and paths, files that are no
    pages, and results that an exclude pattern (a Java regular expression) finds itself in. The scope's scheme replaces
    the link's. A fragment stays only with hash_routing, where it begins with / or !.
    """
    return _either(href, page, scope, let(_context(page, scope), lambda context: _in_context(href, context, scope.subdomains, **_general(how))), **how)


def _general(how: dict) -> dict:
    return {k: x for k, x in how.items() if k != "exclude"}


def _either(
    href: Column, page: Column, scope: ScopeColumns, slow: Column, strip_params: tuple[str, ...] = TRACKING_PARAMS, keep_query: bool = True,
    hash_routing: bool = False, assets: tuple[str, ...] = ASSET_SUFFIXES, exclude: tuple[str, ...] = (),
) -> Column:
    plain = href.rlike(_PLAIN_LINK) & page.rlike(_PLAIN_PAGE)
    if hash_routing:
        plain &= ~F.contains(href, F.lit("#"))
    out = F.when(plain, _plainly(href, page, scope, strip_params, keep_query, assets)).otherwise(slow)
    for pattern in exclude:
        out = let(out, _unless(pattern))
    return out


def _unless(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.when(~x.rlike(pattern), x)


def canonical_all(hrefs: Column, page: Column, scope: ScopeColumns, **how) -> Column:
    """The distinct canonical URLs of an array of links, in the order in which they are first met."""

    def follow(context: Column) -> Column:
        own = ScopeColumns.at(context["scope"], scope.subdomains)
        targets = F.transform(hrefs, lambda h: _either(h, page, own, _in_context(h, context, scope.subdomains, **_general(how)), **how))
        return F.array_distinct(F.filter(targets, lambda u: u.isNotNull()))

    return let(_context(page, scope), follow)


def absolute(href: Column, page: Column) -> Column:
    """The whole URL that a reference on a page stands for, as it is written; null for one that can't be read."""

    def whole(x: Column) -> Column:
        p, readable = resolved(Parts.at(x["link"]), Parts.at(x["at"]))
        tail = F.concat(F.when(p.query != "", F.concat(F.lit("?"), p.query)).otherwise(F.lit("")), F.when(p.fragment != "", F.concat(F.lit("#"), p.fragment)).otherwise(F.lit("")))
        start = F.concat(F.when(p.scheme != "", F.concat(p.scheme, F.lit(":"))).otherwise(F.lit("")), F.when(p.has_netloc, F.concat(F.lit("//"), p.netloc)).otherwise(F.lit("")))
        return F.when(readable, F.concat(start, p.path, tail))

    both = F.struct(let(tidy(href), lambda u: Parts.of(u).struct()).alias("link"), let(tidy(page), lambda u: Parts.of(u).struct()).alias("at"))
    return let(both, whole)
