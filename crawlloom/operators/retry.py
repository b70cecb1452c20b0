"""Retries: backoff times, whom a failure is charged to, and the breaker that ends a run of failures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a browser that is gone says.
BROWSER_PHRASES = (
    "invalid session id", "no such window", "chrome not reachable", "not connected to devtools", "tab crashed", "target crashed", "session deleted",
    "unable to discover open pages", "chrome failed to start",
)
# What a browser says of a site that can't be reached.
SITE_PHRASES = (
    "err_name_not_resolved", "err_name_resolution_failed", "err_internet_disconnected", "err_network_changed", "err_network_io_suspended", "err_proxy_connection_failed",
    "err_connection_refused", "err_connection_reset", "err_connection_closed", "err_connection_aborted", "err_connection_timed_out", "err_connection_failed",
    "err_address_unreachable", "err_socket_not_connected", "err_empty_response", "err_ssl_protocol_error", "err_ssl_version_or_cipher_mismatch",
    "err_cert_authority_invalid", "err_cert_common_name_invalid", "err_cert_date_invalid", "err_cert_revoked", "err_cert_invalid",
)
# Statuses below 500 that may pass.
PASSING_STATUSES = (408, 425, 429)


@dataclass(frozen=True)
class Backoff:
    """Waits of base * factor ** (n - 1) seconds after attempt n, capped, with jitter of that share either way."""

    base: float = 2.0
    factor: float = 4.0
    cap: float = 300.0
    jitter: float = 0.25

    def __post_init__(self):
        if self.base < 0 or self.cap < 0:
            raise ValueError("waits can't be negative")
        if self.factor < 1 or not 0 <= self.jitter < 1:
            raise ValueError("factor must be 1 at least, and jitter from 0 to below 1")

    def delay(self, attempt: Column, spread: Column | float = 0.5) -> Column:
        """spread: from 0 to 1, where in the jitter's range; 0.5 is its middle."""
        if self.base <= 0:
            return F.lit(0.0)
        spread = spread if isinstance(spread, Column) else F.lit(float(spread))
        grown = F.lit(float(self.base)) * F.pow(F.lit(float(self.factor)), F.greatest(attempt - 1, F.lit(0)))
        return F.least(grown, F.lit(float(self.cap))) * (1 + F.lit(float(self.jitter)) * (2 * spread - 1))


def brief(message: Column) -> Column:
    """A message's first line."""
    return F.split_part(F.trim(message), F.lit("\n"), F.lit(1))


def fault(message: Column) -> Column:
    """Whose failure a message speaks of: 'browser', 'site' or 'url'."""
    low = F.lower(message)

    def said(phrases: tuple[str, ...]) -> Column:
        return F.exists(F.lit(list(phrases)), lambda p: F.contains(low, p))

    return F.when(said(BROWSER_PHRASES), "browser").when(said(SITE_PHRASES), "site").otherwise("url")


def is_retryable(status: Column) -> Column:
    return status.isin(*PASSING_STATUSES) | (status >= 500)


def attempt_numbers(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A log of attempts with each one's number by key."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def failure_runs(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """A log with run_length: failures in a row up to each attempt of a key, 0 for a success."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("_failed", failed.cast("int")).withColumn("_island", F.sum(F.lit(1) - F.col("_failed")).over(w))
    run = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run_length", F.sum("_failed").over(run)).drop("_failed", "_island")


def breaker_trips(log: DataFrame, key: str, order: list[str], failed: Column, limit: int = 10) -> DataFrame:
    """The first attempt of each key at which `limit` failures in a row are reached."""
    runs = failure_runs(log, key, order, failed).where(F.col("run_length") >= limit)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return runs.withColumn("_n", first).where("_n = 1").drop("_n")
