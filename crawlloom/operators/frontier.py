"""The frontier: each URL's crawl state as a table, and the steps on it as functions from tables to tables.

A state has one row for each URL. Time is always given (`now`), so that steps can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("queued", "done", "failed", "skipped", "redirected", "duplicate")
SCHEMA_VERSION = 2
SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("link_count", T.IntegerType()),
        T.StructField("note", T.StringType()),
        T.StructField("discovered_at", T.TimestampType(), False),
        T.StructField("visited_at", T.TimestampType()),
        T.StructField("next_attempt_at", T.TimestampType()),
    ]
)


def second(at: Column | datetime | str) -> Column:
    """A time to the second, as the state keeps it."""
    return F.date_trunc("SECOND", (at if isinstance(at, Column) else F.lit(at)).cast("timestamp"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def fresh(urls: DataFrame, now: Column | datetime | str) -> DataFrame:
    """Queued rows for urls (url, depth): of a URL given several times, the least depth."""
    found = urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("depth").cast("int").alias("depth"))
    return found.select(
        "url", F.lit("queued").alias("status"), "depth", F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("link_count"), F.lit(None).cast("string").alias("note"),
        second(now).alias("discovered_at"), F.lit(None).cast("timestamp").alias("visited_at"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
    )


def unknown(state: DataFrame, urls: DataFrame, now: Column | datetime | str) -> DataFrame:
    """The rows that enqueueing urls would add; URLs that the state knows keep their row, depth included."""
    return fresh(urls, now).join(state.select("url"), "url", "left_anti")


def enqueue(state: DataFrame, urls: DataFrame, now: Column | datetime | str) -> DataFrame:
    return state.unionByName(unknown(state, urls, now))


def is_due(now: Column | datetime | str, max_attempts: int) -> Column:
    """Queued, with attempts left, and not held back."""
    return (F.col("status") == "queued") & (F.col("attempts") < max_attempts) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= second(now)))


def claim(state: DataFrame, now: Column | datetime | str, max_attempts: int = 3, most: int | None = 1) -> DataFrame:
    """(url, depth, attempts with this one) of the next URLs: by depth, then discovery, then URL. most None: all due."""
    due = state.where(is_due(now, max_attempts)).orderBy("depth", "discovered_at", "url")
    due = due if most is None else due.limit(most)
    return due.select("url", "depth", (F.col("attempts") + 1).alias("attempts"))


def charge(state: DataFrame, claimed: DataFrame) -> DataFrame:
    """The state with an attempt charged to each claimed URL."""
    mark = claimed.select("url", F.lit(1).alias("charged"))
    return state.join(mark, "url", "left").withColumn("attempts", F.col("attempts") + F.coalesce("charged", F.lit(0))).select(*state.columns)


def apply(state: DataFrame, outcomes: DataFrame, now: Column | datetime | str) -> DataFrame:
    """The state after outcomes (url, event, note, link_count, delay); one for a URL.

    done: finished with its number of links, unless it is done already. failed, skipped, redirected, duplicate: finished
    with a note. requeue: due at once. defer: due after `delay` seconds (at once for 0 or less). release: due at once,
    and the attempt is given back.
    """
    o = outcomes.select("url", F.col("event").alias("_event"), F.col("note").alias("_note"), F.col("link_count").alias("_links"), F.col("delay").alias("_delay"))
    e, when = F.col("_event"), second(now)
    finished = e.isin("failed", "skipped", "redirected", "duplicate")
    back = e.isin("requeue", "defer", "release")
    newly = (e == "done") & (F.col("status") != "done")
    due = second((now if isinstance(now, Column) else F.lit(now)).cast("timestamp") + F.make_dt_interval(secs=F.col("_delay")))
    columns = {
        "status": F.when(e == "done", "done").when(finished, e).when(back, "queued"),
        "attempts": F.when(e == "release", F.greatest(F.col("attempts") - 1, F.lit(0))),
        "link_count": F.when(newly, F.col("_links").cast("int")),
        "visited_at": F.when(newly | finished, when),
    }
    joined = state.join(o, "url", "left")
    note = F.when(newly, F.lit(None)).when(finished | back, F.col("_note")).otherwise(F.col("note"))
    held = F.when((e == "defer") & (F.col("_delay") > 0), due).when(back, F.lit(None)).otherwise(F.col("next_attempt_at"))
    out = joined.withColumns({**{c: F.coalesce(x, F.col(c)) for c, x in columns.items()}, "note": note, "next_attempt_at": held})
    return out.select(*state.columns)


def counts(state: DataFrame) -> DataFrame:
    """(status, n) for each status, also those that no row has."""
    every = state.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(state.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def has_pending(state: DataFrame, max_attempts: int = 3) -> bool:
    return not state.where((F.col("status") == "queued") & (F.col("attempts") < max_attempts)).isEmpty()


def until_due(state: DataFrame, now: Column | datetime | str, max_attempts: int = 3) -> DataFrame:
    """(seconds) until the first URL that is held back falls due: 0 at least, null where none is."""
    held = state.where((F.col("status") == "queued") & (F.col("attempts") < max_attempts)).agg(F.min("next_attempt_at").alias("due"))
    return held.select(F.when(F.col("due").isNotNull(), F.greatest(F.unix_timestamp("due") - F.unix_timestamp(second(now)), F.lit(0))).alias("seconds"))


def visited(state: DataFrame) -> DataFrame:
    """(url, visited_on) of the pages that are done, by URL."""
    return state.where(F.col("status") == "done").orderBy("url").select("url", F.to_date("visited_at").alias("visited_on"))


def problems(state: DataFrame, most: int = 20) -> DataFrame:
    """(status, url, note) of the first failed and skipped URLs."""
    bad = state.where(F.col("status").isin("failed", "skipped")).orderBy("status", "url").limit(most)
    return bad.select("status", "url", F.coalesce("note", F.lit("")).alias("note"))


def set_meta(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """Key-value rows with those of updates put over them."""
    return meta.alias("m").join(updates.alias("u"), "key", "full").select("key", F.coalesce("u.value", "m.value").alias("value"))


def migrate(state: DataFrame, version: int | str | None) -> DataFrame:
    """A state of an older version in the present form. A newer or unreadable version is refused."""
    try:
        found = int(version if version is not None else SCHEMA_VERSION)
    except ValueError as e:
        raise ValueError(f"unreadable schema version {version!r}") from e
    if found > SCHEMA_VERSION:
        raise ValueError(f"the state has version {found}, newer than {SCHEMA_VERSION}")
    if "next_attempt_at" not in state.columns:
        state = state.withColumn("next_attempt_at", F.lit(None).cast("timestamp"))
    return state.select(*SCHEMA.names)
