"""Leased work queues and throttling, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head_and_remaining(queue: DataFrame, record: str, urgent: Column, created: str) -> DataFrame:
    """Next record and number of waiting ones, by one aggregate."""
    return queue.agg(F.min_by(record, F.struct(~urgent, F.col(created), F.col(record))).alias("next_id"), F.count(F.lit(1)).alias("remaining"))


def live_claim(claimed_at: Column, lease_from: Column) -> Column:
    """A claim that has not run out."""
    return F.coalesce(claimed_at >= lease_from, F.lit(False))


def assign(queue: DataFrame, workers: DataFrame, record: str, order: list[Column], n_workers: int) -> DataFrame:
    """The k-th waiting worker gets the k-th free record.

    The head of the queue is a top-k of as many records as there are workers, so neither numbering sees more rows than that.
    """
    head = queue.orderBy(*order).limit(n_workers).withColumn("k", F.row_number().over(Window.orderBy(*order)))
    waiting = workers.orderBy("worker").limit(n_workers).withColumn("k", F.row_number().over(Window.orderBy("worker")))
    return waiting.join(F.broadcast(head), "k").select("worker", record, "k")


def release(claims: DataFrame, workers: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """Claims of the workers are dropped, those in `but` (worker, record) kept."""
    gone = claims.join(workers, "worker", "left_semi")
    if but is not None:
        gone = gone.join(but, but.columns, "left_anti")
    return claims.join(gone, claims.columns, "left_anti")


def failures_in_window(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Failures of the key in the seconds up to each failure."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds - 1), 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w))


def lock_seconds(recent: Column, most_failures: int = 5, base: int = 30, longest: int = 1800) -> Column:
    """30 * 2^(n - 5) seconds from the fifth failure, limited."""
    over = F.least(recent - most_failures, F.lit(20))
    return F.when(recent >= most_failures, F.least(F.lit(longest), (base * F.pow(F.lit(2), over)).cast("int"))).otherwise(0)
