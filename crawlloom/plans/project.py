"""Sites on disk: crawl recorded pages into a stored state, go on with it, list it as a sitemap, and report on it."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, frontier, report, sitemap
from ..operators.robots import Robots
from ..operators.scope import Scope, same_site
from ..sources.config import Config, ConfigError

STATE_COLUMNS = "site string, url string, status string, depth int, attempts int, link_count int, note string, visited_at timestamp, version long"
log_of = logging.getLogger("crawlloom")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")


_COUNTS = ("discovered", "visited", "failed", "skipped", "redirected", "duplicates", "restarts")


class SiteError(ValueError):
    """A site that isn't there, or that holds another scope's pages."""


@dataclass(frozen=True)
class Run:
    """What a crawl came to."""

    site: str
    counts: dict
    stop_reason: str
    exit_code: int
    rounds: int = 1


class Project:
    """The sites under one folder. A state is a table for each version of a site; the newest holds, so that a run that
    fails leaves the one before as it was."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- storage -----------------------------------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _all(self) -> DataFrame | None:
        path = f"{self.root}/state"
        return self.spark.read.option("basePath", path).schema(STATE_COLUMNS).parquet(path) if self._exists(path) else None

    def _version(self, site: str) -> int | None:
        every = self._all()
        return every and every.where(F.col("site") == site).agg(F.max("version").alias("v")).first()["v"]

    def state(self, site: str) -> DataFrame:
        version = self._version(site)
        if version is None:
            raise SiteError(f"there is no site {site!r}")
        return self._all().where((F.col("site") == site) & (F.col("version") == version)).drop("version")

    def meta(self, site: str) -> dict[str, str]:
        rows = self.spark.read.schema("site string, version long, key string, value string").parquet(f"{self.root}/meta").where(F.col("site") == site)
        return {r["key"]: r["value"] for r in rows.groupBy("key").agg(F.max_by("value", "version").alias("value")).collect()}

    def _store(self, site: str, state: DataFrame, base_url: str, version: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/state/site={site}/version={version}")
        meta = self.spark.createDataFrame([(site, version, "base_url", base_url), (site, version, "schema_version", str(frontier.SCHEMA_VERSION))], "site string, version long, key string, value string")
        meta.coalesce(1).write.mode("append").parquet(f"{self.root}/meta")

    def site_of(self, config: Config, name: str | None = None) -> str:
        """The named site, the one of the configured base URL, or the only one there is."""
        if name is not None:
            if not _NAME.fullmatch(name):
                raise SiteError(f"{name!r} can't be a site's name")
            return name
        if config.base_url is not None:
            return config.scope.slug
        names = [r["site"] for r in self.sites().collect()]
        if len(names) != 1:
            raise SiteError("say which site: " + (", ".join(names) or "there is none yet"))
        return names[0]

    # -- commands ----------------------------------------------------------------------------------------------------

    def known(self, config: Config, name: str | None = None) -> tuple[str, int]:
        """(a site's name, how many URLs are stored of it)."""
        site = self.site_of(config, name)
        return site, 0 if self._version(site) is None else self.state(site).count()

    def new(self, config: Config, log: DataFrame, robots: Robots | None = None, name: str | None = None, discard: bool = False, force: bool = False, **how) -> Run:
        """Crawl a site from its base URL. A stored site is replaced only with discard, and by another scope's only with
        force. how: see _crawl()."""
        scope = config.scope
        site = self.site_of(config, name)
        if (version := self._version(site)) is not None:
            stored = self.meta(site).get("base_url")
            if stored and not same_site(stored, config.base_url) and not force:
                raise SiteError(f"{site} holds {stored}, not {config.base_url}; without a name each site has a place of its own, and force overwrites this one")
            if not discard:
                raise SiteError(f"{site} is stored already; discard it or update it")
        seeds = self.spark.createDataFrame([(site, config.base_url)], "site string, url string")
        seeds = seeds.select("site", config.policy().canonical(F.col("url"), F.col("url")).alias("url")).where("url is not null")
        if seeds.isEmpty():
            log_of.warning("the seed %s is outside its own scope and is left out", config.base_url)
        return self._crawl(config, scope, site, seeds, log, robots, (version or 0) + 1, **how)

    def update(self, config: Config, log: DataFrame, robots: Robots | None = None, name: str | None = None, **how) -> Run | None:
        """Go on with a stored crawl; None where nothing is left to do. how: see _crawl()."""
        site = self.site_of(config, name)
        state, stored = self.state(site), self.meta(site).get("base_url")
        if config.base_url is None:
            config = replace(config, base_url=stored)
        elif stored and not same_site(stored, config.base_url):
            raise SiteError(f"{site} holds {stored}")
        if not frontier.has_pending(state, config.max_attempts):
            return None
        return self._crawl(config, config.scope, site, state, log, robots, self._version(site) + 1, **how)

    def _crawl(
        self, config: Config, scope: Scope, site: str, seeds: DataFrame, log: DataFrame, robots: Robots | None, version: int, round_pages: int | None = None,
        stop: Callable[[], bool] = lambda: False,
    ) -> Run:
        """Run a crawl and store what it comes to. round_pages: in rounds of so many pages, each stored before the next
        one begins; between rounds stop() is asked, and a crawl that it ends has kept all that was done."""
        robots = robots if robots is not None and config.respect_robots else Robots()
        own = log.withColumn("site", F.lit(site)).withColumn("allowed", robots.allowed(F.col("url")))
        how = {"strip_params": tuple(config.strip_query_params), "keep_query": config.keep_query, "hash_routing": config.hash_routing, "exclude": tuple(config.exclude_patterns)}
        fetches = crawl.fetch_log(own, scope.columns(), config.respect_canonical, **how)
        limits, counts, rounds, pace = config.limits(), dict.fromkeys(_COUNTS, 0), 0, max(config.delay, robots.crawl_delay or 0.0)
        while True:
            left = None if limits.max_pages is None else limits.max_pages - counts["visited"]
            most = round_pages if left is None or (round_pages is not None and round_pages < left) else left
            out = crawl.crawl_sites(seeds, fetches, replace(limits, max_pages=most), pace=pace)
            path = f"{self.root}/runs/{site}-{version}"
            out.write.mode("overwrite").parquet(path)
            out = self.spark.read.schema(out.schema).parquet(path)
            pages = out.where("kind = 'page'").select("url", "status", "depth", "attempts", "link_count", "note", F.when(F.col("status") != "queued", F.current_timestamp()).alias("visited_at"))
            self._store(site, pages, config.base_url, version)
            row = out.where("kind = 'stats'").first()  # one row a site; none without seeds
            rounds += 1
            if row is None:
                return Run(site, counts, "frontier-empty", 0, rounds)
            counts = {k: counts[k] + row[k] for k in _COUNTS}
            reason, done = row["stop_reason"], limits.max_pages is not None and counts["visited"] >= limits.max_pages
            if reason != "max-pages" or done or round_pages is None:
                return Run(site, counts, reason, crawl.exit_code(counts, reason), rounds)
            if stop():
                return Run(site, counts, "interrupted", crawl.exit_code(counts, "interrupted"), rounds)
            seeds, version = self.state(site), version + 1

    def export(self, config: Config, path: str, name: str | None = None, lastmod: str = "none", allow_empty: bool = False, **limits: int) -> sitemap.Written:
        """Write the site's finished pages as a sitemap. lastmod: none, visited, today, or a day as YYYY-MM-DD. A site
        without finished pages is an error, or with allow_empty an empty sitemap."""
        day = {"none": F.lit(None), "visited": F.col("visited_on"), "today": F.lit(date.today())}.get(lastmod)
        if day is None:
            try:
                day = F.lit(date.fromisoformat(lastmod))
            except ValueError as e:
                raise ConfigError(f"lastmod must be none, visited, today or a day, not {lastmod!r}") from e
        site = self.site_of(config, name)
        state = self.state(site)
        queued = state.where("status = 'queued'").count()
        if queued:
            log_of.warning("%d URLs are still queued, so this sitemap is incomplete; `update` goes on with the crawl", queued)
        entries = frontier.visited(state).select(F.col("url").alias("loc"), day.cast("date").alias("lastmod"))
        return sitemap.write_sitemap(entries, path, config.base_url or self.meta(site).get("base_url"), allow_empty=allow_empty, **limits)

    def status(self, config: Config, name: str | None = None) -> str:
        site = self.site_of(config, name)
        return report.status_text(self.state(site), self.meta(site).get("base_url", "?"))

    def sites(self) -> DataFrame:
        """(site, done, queued) of every stored site."""
        every = self._all()
        if every is None:
            return self.spark.createDataFrame([], "site string, done long, queued long")
        newest = every.groupBy("site").agg(F.max("version").alias("version"))
        return report.sites_report(every.join(newest, ["site", "version"], "left_semi"))
