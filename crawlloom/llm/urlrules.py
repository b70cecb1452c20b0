"""URL rules that are looked up by their rarest literal token; only candidates run a regular expression.

A rule is a host with a path prefix, or a pattern in the syntax of common filter lists (`||` the start of a host label,
`^` a separator, `*` anything). A rule's tokens are the runs of letters and digits in it that a match is certain to hold
as whole tokens. Each rule is filed under the token of it that is rarest in the URLs at hand, and a URL's tokens fetch
the rules that it is tried against; rules without a token are tried on every URL.

The lookup is local to a row: no shuffle, so hosts that a third of the rows share make no task larger. The index goes to
the executors in blocks of a bounded number of rules; with more rules the URLs are taken past one block after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one block, which is what the executors hold at once.
BLOCK_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block'. host and path: fits the host and its subdomains where the URL's path begins with
    path. Else pattern, over host and path together."""

    verdict: str
    host: str | None = None
    path: str = "/"
    pattern: str | None = None
    regex: str = field(init=False)
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if self.host is not None:
            body, regex = f"||{self.host}{self.path}", rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"
        else:
            body, regex = self.pattern, "".join({"||": r"(?:[^/]*\.)?", "^": r"(?:[^a-z0-9]|\Z)", "*": r"(?s:.*)"}.get(x, re.escape(x)) for x in re.split(r"(\A\|\||\^|\*)", self.pattern))
            regex = regex if self.pattern.startswith("||") else "(?s:.*?)" + regex
        found, own, body = [], body, body.translate(_LOWER)  # tokens are compared in lower case, expressions as they stand
        for m in _TOKEN.finditer(body):
            before, after = body[: m.start()], body[m.end() :]
            # Whole in every match: something that isn't a letter or digit stands on either side.
            # A ^ also fits a capital, so beside it only a token without capitals is found whole.
            if before and before[-1] not in "*" and after and after[0] != "*" and (own[m.start() : m.end()] == m[0] or "^" not in before[-1] + after[0]):
                found.append(m[0])
        object.__setattr__(self, "regex", regex)
        object.__setattr__(self, "tokens", tuple(dict.fromkeys(found)))

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}" if self.host is not None else self.pattern


#: Rules of host and path: the longest that fits decides.
HOST_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: The method's own patterns, for URLs that no rule of host and path fits: block, unless an allow pattern fits too.
PATTERNS = (
    Rule("block", pattern="||casino-"),
    Rule("block", pattern="||cheap-pills."),
    Rule("block", pattern="||free-bets."),
    Rule("block", pattern="||ads-track."),
    Rule("block", pattern="/adserver^"),
    Rule("block", pattern="/banner*.html"),
    Rule("allow", pattern="||casino-law."),
    Rule("allow", pattern="^about^"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def parse_rules(lines: Iterable[str]) -> Iterator[Rule]:
    """Rules of a list, one a line: `host/path` or a pattern, which block, or allow with `@@` before them. Blank lines and
    comments (`!`) are left out."""
    for line in lines:
        line = line.strip()
        if not line or line.startswith("!"):
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        host, slash, path = body.partition("/")
        if slash and host and not set(host) & set("|^*"):
            yield Rule(verdict, host.translate(_LOWER), f"/{path}")
        else:
            yield Rule(verdict, pattern=body)


class Expressions:
    """Regular expressions by number, each compiled when it is first asked for."""

    def __init__(self, sources: list[str]):
        self.sources, self.ready = sources, {}

    def __getitem__(self, k: int) -> re.Pattern:
        if k not in self.ready:
            self.ready[k] = re.compile(self.sources[k])
        return self.ready[k]

    def __getstate__(self) -> dict:
        return {"sources": self.sources, "ready": {}}


class RuleIndex:
    """Rules by their rarest token. counts: how many URLs hold each token (missing: none)."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.always: list[int] = []
        self.by_token: dict[str, list[int]] = {}
        self.rules = rules
        self.regex = Expressions([r.regex for r in rules])
        for k, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def fitting(self, host: str, path: str) -> list[Rule]:
        text = host + path
        low = text.translate(_LOWER)
        near = list(self.always)
        for token in {*_TOKEN.findall(low), *_TOKEN.findall(text)}:  # to an expression, a capital is a separator
            near += self.by_token.get(token, ())
        return [self.rules[k] for k in near if self.regex[k].match(text)]


def decide(fitting: list[Rule]) -> tuple[int, str, str | None, str | None]:
    """(length of the deciding rule of host and path or -1, verdict, that rule, the deciding pattern)."""
    own = [r for r in fitting if r.host is not None]
    if own:  # of equally long ones, an allowing one
        best = max(own, key=lambda r: (len(r.name), r.verdict == "allow", r.name))
        return len(best.name), best.verdict, best.name, None
    patterns = sorted((r.verdict != "allow", r.name) for r in fitting)
    if patterns:
        return -1, "block" if patterns[0][0] else "allow", None, patterns[0][1]
    return -1, "allow", None, None


def token_counts(pages: DataFrame, rules: list[Rule], url_column: str = "url") -> dict[str, int]:
    """How many of the URLs hold each of the rules' tokens, over all rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    url = F.col(url_column)
    tokens = F.array_distinct(F.split(F.lower(F.concat(host_of(url), path_of(url))), "[^a-z0-9]+"))
    known = pages.sparkSession.createDataFrame(pd.DataFrame({"token": wanted}), "token string")  # those of a block of rules
    rows = pages.select(F.explode(tokens).alias("token")).join(F.broadcast(known), "token")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a token of the block


def judge(pages: DataFrame, rules: Iterable[Rule] = (*HOST_RULES, *PATTERNS), url_column: str = "url") -> DataFrame:
    """pages with host, path, rule, pattern and verdict added; a column of theirs with such a name is replaced.

    The longest rule of host and path that fits decides (of equally long ones, an allowing one); without one, an allow
    pattern, then a block pattern; without any, the URL is allowed. A null URL, or one without `://`, has an empty host
    and path, which no such rule fits. Rows are judged one by one, so repeated rows are alike.
    """
    every = list(rules)
    names = ("host", "path", "rule", "pattern", "verdict")
    kept = [c for c in pages.columns if c not in names]
    own = "_" * (1 + max((len(c) for c in pages.columns), default=0))  # no column of theirs
    url = F.col(url_column)
    out = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"), F.lit(-1).alias(own), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit("allow").alias("verdict"))
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    schema = out.schema
    for at in range(0, len(every), BLOCK_RULES):
        index = RuleIndex(every[at : at + BLOCK_RULES], token_counts(pages, every[at : at + BLOCK_RULES], url_column))
        shared = pages.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                size, rule, pattern, verdict = (b.column(c).to_pylist() for c in (own, "rule", "pattern", "verdict"))
                for k, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                    n, v, r, p = decide(index.fitting(host, path))
                    if n >= 0:  # against what the blocks before have found
                        better = (n, v == "allow", r) > (size[k], verdict[k] == "allow", rule[k] or "")
                    else:
                        better = size[k] < 0 and p is not None and (pattern[k] is None or (v == "allow" and verdict[k] != "allow"))
                    if better:
                        size[k], verdict[k], rule[k], pattern[k] = n, v, r, p
                new = {own: pa.array(size, pa.int32()), "rule": pa.array(rule, pa.string()), "pattern": pa.array(pattern, pa.string()), "verdict": pa.array(verdict, pa.string())}
                yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out.drop(own)
