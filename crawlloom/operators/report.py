"""Reports over crawl states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frontier


def sites_report(state: DataFrame) -> DataFrame:
    """(site, done, queued) of states with a site column, in order."""
    return state.groupBy("site").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "queued").alias("queued")).orderBy("site")


def status_text(state: DataFrame, base_url: str, most: int = 10) -> str:
    """A site's state in words: its totals, and the first pages that went wrong."""
    rows = frontier.counts(state).collect()  # a row a status
    lines = [f"base URL: {base_url}", f"total: {sum(r['n'] for r in rows)}", *[f"  {r['status']}: {r['n']}" for r in rows]]
    bad = frontier.problems(state, most).collect()
    return "\n".join(lines + (["problems:"] if bad else []) + [f"  [{r['status']}] {r['url']}  {r['note']}" for r in bad])
