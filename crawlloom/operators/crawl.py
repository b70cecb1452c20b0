"""Crawling recorded pages: breadth-first over link tables, and each site's exact order as a fold over its fetch log.

Pages arrive as tables (a fetch log); nothing here opens a browser.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import ScopeColumns, canonical, canonical_all, let
from ..sources.shared import checkpointed


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth) of all that links (src, dst) reach from seeds (url), each at its least depth.

    A round joins the newest URLs with the links, once and map-side distinct, and leaves out those that are known. Each
    round is checkpointed, so plans stay short and a lost executor costs one round.
    """
    known = checkpointed(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    newest, depth = known, 0
    rounds = [known]
    while (max_depth is None or depth < max_depth) and not newest.isEmpty():
        depth += 1
        found = newest.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).where("url is not null").distinct()
        for r in rounds:
            found = found.join(r.select("url"), "url", "left_anti")
        newest = checkpointed(found.withColumn("depth", F.lit(depth)))
        rounds.append(newest)
        if len(rounds) == 8:  # few tables to leave out
            merged = rounds[0]
            for r in rounds[1:]:
                merged = merged.unionByName(r)
            rounds = [checkpointed(merged)]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def redirect_target(url: Column, final: Column, scope: ScopeColumns, **how) -> Column:
    """Where a fetched URL's content belongs, if the browser ended elsewhere: null outside the scope or for itself."""
    return let(canonical(final, url, scope, **how), lambda target: F.when((final != url) & (target != url), target))


def canonical_target(owner: Column, link: Column, scope: ScopeColumns, base: Column | None = None, **how) -> Column:
    """The in-scope URL, other than owner, that a page names as canonical; else null. base: see fetch_log()."""
    return let(canonical(link, owner if base is None else base, scope, **how), lambda target: F.when(target != owner, target))


@dataclass(frozen=True)
class Limits:
    max_pages: int | None = None
    max_depth: int | None = None
    max_runtime: float | None = None
    max_attempts: int = 3
    max_consecutive_failures: int | None = 10
    max_restarts: int = 3

    def __post_init__(self):
        for name, value in asdict(self).items():
            least = 0 if name in ("max_depth", "max_restarts") else 1
            if value is not None and value < least:
                raise ValueError(f"{name} must be {least} at least")


#: A step may wait this long for the next URL, and so many times in a row.
IDLE_SECONDS, IDLE_WAITS = 5.0, 120

STATE = "site string, url string, status string, depth int, attempts int, link_count int, note string, next_attempt_s double"
STATS = "site string, discovered long, visited long, failed long, skipped long, redirected long, duplicates long, restarts long, stop_reason string, exit_code int"
FETCHES = "site, url, attempt, final, target, links, canonical_target, fault, retryable, message, allowed"


def fetch_log(log: DataFrame, scope: ScopeColumns, respect_canonical: bool = True, **how) -> DataFrame:
    """A log (site, url, attempt, final_url, links, canonical, fault, retryable, message[, base, allowed]) with all its
    URLs canonical, which is the part of a crawl that can be done for all pages at once.

    base is what links are relative to, where that isn't final_url (a page with a base element).
    fault is null for a page that was rendered; else 'url', 'site', 'browser' or 'not-html'.
    """
    url, final, target = F.col("url"), F.col("final"), F.col("target")
    log = log.withColumn("final", F.coalesce("final_url", "url"))
    log = log.withColumn("target", F.when(final != url, canonical(final, url, scope, **how)))
    owner = F.coalesce(F.when(target != url, target), url)
    base = F.coalesce("base", final) if "base" in log.columns else final
    allowed = F.coalesce("allowed", F.lit(True)) if "allowed" in log.columns else F.lit(True)
    return log.select(
        "site", "url", F.col("attempt").cast("int").alias("attempt"), "final", "target", canonical_all(F.col("links"), base, scope, **how).alias("links"),
        (canonical_target(owner, F.col("canonical"), scope, base=F.coalesce("base", owner) if "base" in log.columns else owner, **how) if respect_canonical else F.lit(None).cast("string")).alias("canonical_target"),
        "fault", F.coalesce("retryable", F.lit(True)).alias("retryable"), F.coalesce("message", F.lit("")).alias("message"), allowed.alias("allowed"),
    )


class _Site:
    """One site's crawl: rows by URL, a heap of what is due, a heap of what is held back, and a clock in seconds."""

    def __init__(self, limits: Limits, waits: tuple[float, float, float]):
        self.limits, self.waits = limits, waits
        self.rows: dict[str, dict] = {}
        self.due: list[tuple[int, int, str]] = []
        self.held: list[tuple[float, int, int, str]] = []
        self.clock, self.batch, self.streak = 0.0, 0, 0
        self.stats = dict.fromkeys(("discovered", "visited", "failed", "skipped", "redirected", "duplicates", "restarts"), 0)
        self.reason: str | None = None

    def add(self, urls: Iterable[str], depth: int) -> int:
        new = [u for u in dict.fromkeys(urls) if u not in self.rows]
        self.batch += 1
        for u in new:
            self.rows[u] = {"status": "queued", "depth": depth, "attempts": 0, "link_count": None, "note": None, "next": None, "batch": self.batch}
            heapq.heappush(self.due, (depth, self.batch, u))
        return len(new)

    def resume(self, rows: list[dict]) -> None:
        """Take up rows of an earlier run; its clock is at 0 again, so what it held back is due after what was left."""
        for r in sorted(rows, key=lambda r: r["url"]):
            self.rows[r["url"]] = {"status": r["status"], "depth": int(r["depth"] or 0), "attempts": int(r["attempts"] or 0), "link_count": r["link_count"], "note": r["note"], "next": None, "batch": 0}
            if r["status"] == "queued":
                heapq.heappush(self.due, (int(r["depth"] or 0), 0, r["url"]))

    def put_back(self, url: str, note: str, wait: float = 0.0, refund: bool = False) -> None:
        row = self.rows[url]
        row["status"], row["note"] = "queued", note
        row["attempts"] = max(0, row["attempts"] - refund)
        row["next"] = self.clock + wait if wait > 0 else None
        if wait > 0:
            heapq.heappush(self.held, (row["next"], row["depth"], row["batch"], url))
        else:
            heapq.heappush(self.due, (row["depth"], row["batch"], url))

    def end(self, url: str, status: str, note: str, counter: str | None = None) -> None:
        self.rows[url].update(status=status, note=note)
        if counter:
            self.stats[counter] += 1

    def take(self) -> str | None:
        """The next URL that is queued and has attempts left, with its attempt charged."""
        while self.held and self.held[0][0] <= self.clock:
            _, depth, batch, url = heapq.heappop(self.held)
            heapq.heappush(self.due, (depth, batch, url))
        while self.due:
            url = heapq.heappop(self.due)[2]
            row = self.rows[url]
            if row["status"] == "queued" and row["attempts"] < self.limits.max_attempts and (row["next"] is None or row["next"] <= self.clock):
                row["attempts"] += 1
                return url
        return None

    def backoff(self, attempt: int) -> float:
        base, factor, cap = self.waits
        return min(base * factor ** max(attempt - 1, 0), cap) if base > 0 else 0.0

    def rendered(self, url: str, fetch: dict) -> None:
        self.streak = 0
        depth, owner = self.rows[url]["depth"], url
        if fetch["final"] != url:
            owner = fetch["target"]
            self.end(url, "redirected", f"-> {owner or fetch['final']}", "redirected")
            if owner is None or owner == url:
                return
            self.add([owner], depth)
        links = list(fetch["links"]) if fetch["links"] is not None else []
        if self.limits.max_depth is None or depth < self.limits.max_depth:
            self.stats["discovered"] += self.add(links, depth + 1)
        named = fetch["canonical_target"]
        if named is not None and named != owner:
            self.end(owner, "duplicate", f"canonical -> {named}", "duplicates")
            self.add([named], depth)
            owner = named
        row = self.rows[owner]
        if row["status"] != "done":
            row.update(status="done", link_count=len(links), note=None)
            self.stats["visited"] += 1

    def broken(self, url: str, fetch: dict) -> None:
        kind, note, row = fetch["fault"], fetch["message"], self.rows[url]
        if kind == "not-html":
            self.end(url, "skipped", note, "skipped")
            return
        self.streak += kind != "browser"
        most = self.limits.max_consecutive_failures
        tripped = most is not None and self.streak >= most
        if kind == "browser":
            self.put_back(url, note, refund=True)
            if self.stats["restarts"] >= self.limits.max_restarts:
                self.reason = "renderer-unavailable"
            else:
                self.stats["restarts"] += 1
        elif kind == "site":
            self.put_back(url, note, self.backoff(1), refund=True)
        elif tripped:
            self.put_back(url, note)
        elif fetch["retryable"] and row["attempts"] < self.limits.max_attempts:
            self.put_back(url, note, self.backoff(row["attempts"]))
        else:
            self.end(url, "failed", note, "failed")
        if tripped:
            self.reason = "site-unreachable"

    def run(self, fetches: dict[str, list[dict]], pace: float) -> None:
        idle, first, tries = 0, True, {}
        while True:
            if self.reason is not None:
                return
            if self.limits.max_pages is not None and self.stats["visited"] >= self.limits.max_pages:
                self.reason = "max-pages"
                return
            if self.limits.max_runtime is not None and self.clock >= self.limits.max_runtime:
                self.reason = "max-runtime"
                return
            url = self.take()
            if url is None:
                if self.held and idle < IDLE_WAITS:
                    idle += 1
                    self.clock += min(max(self.held[0][0] - self.clock, 0.0), IDLE_SECONDS)
                    continue
                self.reason = "still-backing-off" if idle else "frontier-empty"
                return
            idle = 0
            log = fetches.get(url) or [{"fault": "url", "retryable": False, "message": "no record of this page", "allowed": True}]
            if not log[0]["allowed"]:
                self.end(url, "skipped", "disallowed by robots.txt", "skipped")
                continue
            self.clock += 0 if first else pace
            first = False
            k = tries[url] = tries.get(url, 0) + 1
            fetch = log[min(k, len(log)) - 1]
            self.broken(url, fetch) if fetch["fault"] is not None else self.rendered(url, fetch)


def exit_code(stats: dict, reason: str | None) -> int:
    """0 for a run that ended well, 1 for one that couldn't go on or saw only failures, 130 for an interrupted one."""
    if reason == "interrupted":
        return 130
    bad = reason in ("site-unreachable", "renderer-unavailable", "still-backing-off") or (stats["visited"] == 0 and stats["failed"] > 0)
    return int(bad)


def crawl_sites(seeds: DataFrame, fetches: DataFrame, limits: Limits = Limits(), backoff: tuple[float, float, float] = (2.0, 4.0, 300.0), pace: float = 0.0) -> DataFrame:
    """Each site's crawl in its exact order: seeds (site, url, in canonical form) and fetches as fetch_log() gives them.

    Rows of seeds that have a status (and depth, attempts, link_count, note) are those of an earlier run, which goes on.

    Returns state rows (kind 'page') and a row of counts a site (kind 'stats'), in the columns of STATE and STATS. Sites
    run side by side; one site's pages are one task's work, as its order asks for. Jitter is off and time is counted by
    the waits, so the result is a function of the log. A URL without a record fails for good; its k-th try reads the
    record of attempt k, or the last.
    """
    schema = "kind string, " + STATE + ", " + STATS.removeprefix("site string, ")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        site = _Site(limits, backoff)
        log: dict[str, list[dict]] = {}
        if len(right):
            right = right.sort_values(["url", "attempt"]).astype(object)
            for row in right.where(right.notna(), None).to_dict("records"):
                log.setdefault(row["url"], []).append(row)
        if len(left):
            left = left.astype(object)
            left = left.where(left.notna(), None)
            site.resume([r for r in left.to_dict("records") if r["status"] is not None])
            site.stats["discovered"] += site.add(sorted(r["url"] for r in left.to_dict("records") if r["status"] is None and r["url"] is not None), 0)
        site.run(log, pace)
        rows = [
            {"kind": "page", "site": key[0], "url": u, "status": r["status"], "depth": r["depth"], "attempts": r["attempts"], "link_count": r["link_count"], "note": r["note"], "next_attempt_s": r["next"] if r["status"] == "queued" else None}
            for u, r in site.rows.items()
        ]
        rows.append({"kind": "stats", "site": key[0], **site.stats, "stop_reason": site.reason, "exit_code": exit_code(site.stats, site.reason)})
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    # Columns of their own: where both sides come from one table, Spark would take a shared column from one of them only.
    kinds = {"status": "string", "depth": "int", "attempts": "int", "link_count": "int", "note": "string", "next_attempt_s": "double"}
    seeds = seeds.select(*[F.concat(c, F.lit("")).alias(c) for c in ("site", "url")], *[(F.col(c) if c in seeds.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    fetches = fetches.select(*FETCHES.split(", "))
    return seeds.groupBy("site").cogroup(fetches.groupBy("site")).applyInPandas(run, schema)
