"""Rules of robots.txt: the first rule in the file's order that a path begins with decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import Parts, quoted, tidy, unquoted


def robots_path(url: Column) -> Column:
    """What rules are compared with: path and query, with escapes in their usual form."""
    plain = unquoted(F.replace(tidy(url), F.lit("+"), F.lit("%2B")))
    p = Parts.of(plain)
    whole = F.concat(p.path, F.when(p.query != "", F.concat(F.lit("?"), p.query)).otherwise(F.lit("")), F.when(p.fragment != "", F.concat(F.lit("#"), p.fragment)).otherwise(F.lit("")))
    path = F.replace(F.replace(quoted(whole), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(path == "", F.lit("/")).otherwise(path)


@dataclass(frozen=True)
class Robots:
    """The rules that hold for one agent, in order, as (path prefix, allowed); and the seconds between requests."""

    rules: tuple[tuple[str, bool], ...] = ()
    crawl_delay: float | None = None

    @staticmethod
    def parse(text: str, agent: str = "*") -> Robots:
        """The group that names the agent, else the one of `*`; only whole numbers count as a delay."""
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        group = next((g for g in parser.entries if g.applies_to(agent)), parser.default_entry)
        if group is None:
            return Robots()
        return Robots(tuple((r.path, r.allowance) for r in group.rulelines), None if group.delay is None else float(group.delay))

    @staticmethod
    def load(base_url: str, agent: str, fetch: Callable[[str], str]) -> Robots:
        """The rules that fetch() gives for a site; where it fails, all is allowed."""
        try:
            return Robots.parse(fetch(urljoin(base_url, "/robots.txt")), agent)
        except (OSError, ValueError):
            return Robots()

    def allows(self, url: str) -> bool:
        parts = urlsplit(unquote(url))
        path = quote(urlunsplit(("", "", parts.path, parts.query, parts.fragment))) or "/"
        return next((ok for prefix, ok in self.rules if prefix == "*" or path.startswith(prefix)), True)

    def allowed(self, url: Column) -> Column:
        """allows() as a column."""
        path = robots_path(url)
        rules = F.array(*[F.struct(F.lit(prefix).alias("prefix"), F.lit(ok).alias("allow")) for prefix, ok in self.rules])
        first = F.get(F.filter(rules, lambda r: path.startswith(r["prefix"])), F.lit(0))["allow"] if self.rules else F.lit(None).cast("boolean")
        return F.coalesce(first, F.lit(True))


def effective_delay(configured: float, robots: Robots) -> float:
    return max(configured, robots.crawl_delay or 0.0)


def filter_allowed(urls: DataFrame, rules: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """urls with `allowed` added, by a table of rules (site, seq, prefix, allow): of many sites at once.

    Rules meet URLs of their site only; of those that the path begins with, the one with the least seq decides. Rules of
    one site are gathered in one row, so a URL meets one row, whatever the number of rules.
    """
    own = rules.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("seq", "prefix", "allow"))).alias("_rules"))
    joined = urls.withColumn("_path", robots_path(F.col(url))).join(own, site, "left")
    first = F.get(F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"])), F.lit(0))["allow"]
    return joined.withColumn("allowed", F.coalesce(first, F.lit(True))).drop("_path", "_rules")
