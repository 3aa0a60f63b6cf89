"""Throttling as an ordered fold, in batch and as a stream, and the streaming duplicate gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the throttle: seconds of the window, failures until a lock, first lock, longest lock of an address and of a user.
WINDOW, MOST, BASE, LONGEST, LONGEST_USER = 900, 5, 30, 1800, 180


class ThrottleFold:
    """T05, exact: failures of one key in order.  Attempts while locked do not count; success resets.  longest: ceiling of a lock."""

    def __init__(self, fails: list[float] | None = None, locked_until: float = 0.0, longest: int = LONGEST):
        self.fails, self.locked_until, self.longest = fails or [], locked_until, longest

    def step(self, at: float, ok: bool) -> tuple[bool, int]:
        """Whether the attempt was refused, and the seconds of the lock that it causes."""
        if self.locked_until > at:
            return True, 0
        if ok:
            self.fails, self.locked_until = [], 0.0
            return False, 0
        self.fails = [t for t in self.fails if at - t < WINDOW] + [at]
        if len(self.fails) < MOST:
            return False, 0
        lock = min(self.longest, BASE * 2 ** min(len(self.fails) - MOST, 20))
        self.locked_until = at + lock
        return False, lock


_OUT = "key string, event_id long, at double, refused boolean, lock int"


def throttle_batch(attempts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Ordered fold per key over (key, event_id, at, ok): each group is sorted by Spark and read as a stream of batches, so a long group is not held in memory."""
    rows = attempts.select("key", "event_id", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, ThrottleFold(longest=longest)
        for b in batches:
            refused, lock = [], []
            for k, at, ok in zip(b.key, b["at"], b.ok, strict=True):
                if k != key:
                    key, fold = k, ThrottleFold(longest=longest)
                r, s = fold.step(float(at), bool(ok))
                refused.append(r)
                lock.append(s)
            yield pd.DataFrame({"key": b.key, "event_id": b.event_id, "at": b["at"], "refused": refused, "lock": lock})

    return rows.mapInPandas(run, _OUT)


def throttle_stream(attempts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The same fold as a streaming operator over (key, event_id, at, ok, ts) with a watermark on ts; keys that have been idle for the window and the longest lock are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, until = state.get if state.exists else ([], 0.0)
        fold = ThrottleFold(list(fails), until, longest)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        got = [fold.step(float(at), bool(ok)) for at, ok in zip(rows["at"], rows.ok, strict=True)]
        state.update((fold.fails, fold.locked_until))
        state.setTimeoutTimestamp(max(int(rows["at"].max() * 1000), state.getCurrentWatermarkMs()) + (WINDOW + longest) * 1000)
        yield pd.DataFrame({"key": rows.key, "event_id": rows.event_id, "at": rows["at"], "refused": [r for r, _ in got], "lock": [s for _, s in got]})

    return attempts.groupBy("key").applyInPandasWithState(run, _OUT, "fails array<double>, locked_until double", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen_stream(uploads: DataFrame, key: str, ts: str, late: str | None = "1 day") -> DataFrame:
    """The first upload of each hash.

    State is kept for `late` behind the watermark, and uploads that come later than that are dropped unseen.  With None
    nothing is dropped: the gate is exact, and its state grows with the number of different hashes.
    """
    return uploads.dropDuplicates([key]) if late is None else uploads.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_counts_stream(events: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """A04 as a stream: counts per day and type, emitted once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is into a Parquet folder and read it."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").option("path", f"{path}/data").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
