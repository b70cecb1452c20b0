"""Retry state as a stream: each URL's attempts fold into its status and the time of its next try."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "url string, seq long, at timestamp, status string, attempts int, next_attempt_at timestamp"
_STATE = "attempts int, status string, at timestamp"
#: URLs are dealt into so many groups by a hash. A group's rows of a batch are folded at once; each URL keeps a state of
#: its own. Stored states belong to the number that they were made with.
GROUPS = 4096


class RetryProcessor(StatefulProcessor):
    """Rows (url, seq, at, ok, retryable) of a group of URLs, each URL's in the order of at, then seq; a row out for each.

    A success ends a URL as done; a failure puts it back, due after the backoff of that attempt, or fails it for good
    when it isn't retryable or the attempts are used up. What comes after the end changes nothing. State has one row a
    URL and never expires, as a crawl's frontier doesn't.
    """

    def __init__(self, max_attempts: int = 3, base: float = 2.0, factor: float = 4.0, cap: float = 300.0):
        self.max_attempts, self.base, self.factor, self.cap = max_attempts, base, factor, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("retry", "url string", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        code, urls = pd.factorize(pdf["url"], use_na_sentinel=False)
        urls = [None if pd.isna(u) else u for u in urls]
        pdf = pdf.assign(code=code).sort_values(["code", "at", "seq"], ignore_index=True)
        code = pdf["code"].to_numpy()
        known = self.state.exists()  # a group that is new has no URL to ask for
        before = [(self.state.getValue((u,)) if known and self.state.containsKey((u,)) else None) or (0, "queued", None) for u in urls]
        start = np.searchsorted(code, np.arange(len(urls)))
        ok, again = (pdf[c].astype("boolean").fillna(False).to_numpy(bool) for c in ("ok", "retryable"))
        had = np.array([n for n, _, _ in before], np.int64)[code]
        open_ = np.array([s == "queued" for _, s, _ in before])[code]
        attempts = had + np.arange(len(code)) - start[code] + 1
        ends = np.flatnonzero(ok | ~again | (attempts >= self.max_attempts))
        end = np.full(len(urls), len(code))  # the row that ends a URL
        np.minimum.at(end, code[ends], ends)
        end = end[code]
        past = np.arange(len(code)) > end
        attempts = np.where(open_, np.where(past, attempts[np.minimum(end, len(code) - 1)], attempts), had)
        last = np.where(ok[np.minimum(end, len(code) - 1)], "done", "failed")
        status = np.where(open_, np.where(np.arange(len(code)) >= end, last, "queued"), np.array([s for _, s, _ in before], object)[code])
        wait = np.minimum(self.base * self.factor ** (np.clip(attempts, 1, self.max_attempts) - 1.0), self.cap)
        due = (pdf["at"].astype("datetime64[ns]") + pd.to_timedelta(wait, unit="s")).where(status == "queued")
        for u, k in zip(urls, np.append(start[1:], len(code)) - 1, strict=True):
            self.state.updateValue((u,), (int(attempts[k]), str(status[k]), None if pd.isna(due[k]) else due[k]))
        out = {"url": pd.Series(urls, dtype=object)[code].to_numpy(), "seq": pdf["seq"], "at": pdf["at"], "status": status, "attempts": attempts, "next_attempt_at": due}
        yield pd.DataFrame(out).astype({"at": "datetime64[ns]", "next_attempt_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def retry_states(attempts: DataFrame, processor: RetryProcessor | None = None) -> DataFrame:
    """The stream of states for a stream of attempts (url, seq, at, ok, retryable)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # also the process that prepares the state needs the class
    dealt = attempts.withColumn("own_group", F.pmod(F.xxhash64("url"), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("own_group").transformWithStateInPandas(processor or RetryProcessor(), OUT, "append", "none")


def drain(session: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what its source holds now, and read what it has written."""
    run = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return session.read.schema(stream.schema).parquet(f"{run}/out")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session whose state stores are RocksDB, which these processors ask for."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def folder(spark: SparkSession) -> str:
    """A folder of its own in the one that all executors share."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="crawlloom-")
    return f"{root.rstrip('/')}/crawlloom/retries-{uuid.uuid4().hex}"
