"""Requests under way on a stream, by state that is kept in buckets of requests and expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

START, FINISH, EXPIRED = "start", "finish", "expired"
BUCKETS = 1024
_FOUND = "request string, endpoint string, millis long, change int, reason string"
_OPEN = "requests array<string>, endpoints array<string>, started array<long>, finished array<long>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Row = tuple[float, bool, str | None]
Change = tuple[str | None, float, int, str]


def bucket_step(timeout_seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Changes of the gauge by a bucket of requests: +1 at a start, -1 at its finish or when its time is over.

    Only requests that are under way have state: their endpoint and start. A finish without a known start
    waits for it as long as a start waits for its finish, and changes nothing if it never comes. Later
    rows of a request that has ended begin another one. All requests of the bucket are taken at once, but for
    those with several starts or finishes, whose rows are followed one by one.
    """
    timeout = timeout_seconds * 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        rows = rows.iloc[:0] if state.hasTimedOut else rows
        requests, endpoints, starts, finishes = state.getOption or ([], [], [], [])

        # requests by number, those with state first; a time that is not known is NaN
        numbers, names = pd.factorize(np.array([*requests, *rows["request"]], object))
        known, n = len(requests), len(names)
        of, at, ended = numbers[known:], rows["millis"].to_numpy(float), rows["ended"].to_numpy(bool)
        name = rows["endpoint"].to_numpy(object)
        endpoint, started, finished = np.full(n, None, object), np.full(n, np.nan), np.full(n, np.nan)
        endpoint[:known], started[:known], finished[:known] = endpoints, starts, finishes
        shown = ~np.isnan(started)

        several = np.bincount(of[~ended], minlength=n) + shown > 1
        several |= np.bincount(of[ended], minlength=n) + ~np.isnan(finished) > 1
        begin, end = ~ended & ~several[of], ended & ~several[of]
        started[of[begin]], endpoint[of[begin]], finished[of[end]] = at[begin], name[begin], at[end]

        found = []
        places = np.flatnonzero(several[of])
        places = places[np.lexsort((ended[places], at[places], of[places]))]
        for i, group in groupby(places.tolist(), key=lambda place: of[place]):
            held = endpoint[i], started[i], finished[i]
            in_order = ((at[p], ended[p], name[p]) for p in group)
            changes, (endpoint[i], started[i], finished[i]) = _follow(held, in_order, timeout)
            shown[i] = True
            found.extend((names[i], *change) for change in changes)
        out = [pd.DataFrame(found, columns=["request", "endpoint", "millis", "change", "reason"])]

        def add(which: np.ndarray, millis: np.ndarray, change: int, reason: np.ndarray | str) -> None:
            out.append(pd.DataFrame(
                {"request": names[which], "endpoint": endpoint[which], "millis": millis, "change": change, "reason": reason}
            ))

        begun = ~np.isnan(started) & ~shown
        add(begun, started[begun], 1, START)
        both = ~np.isnan(started) & ~np.isnan(finished)
        over = finished[both] > started[both] + timeout
        add(both, np.where(over, started[both] + timeout, finished[both]), -1, np.where(over, EXPIRED, FINISH).astype(object))
        started[both] = finished[both] = np.nan
        limit = np.where(np.isnan(started), finished, started) + timeout
        lost = limit <= state.getCurrentWatermarkMs()
        add(lost & ~np.isnan(started), limit[lost & ~np.isnan(started)], -1, EXPIRED)

        open_ = ~np.isnan(limit) & ~lost
        if open_.any():
            state.update((names[open_].tolist(), endpoint[open_].tolist(), _millis(started[open_]), _millis(finished[open_])))
            # a timer goes off when the watermark is past it, a limit is reached when the watermark is
            state.setTimeoutTimestamp(max(1, int(limit[open_].min()) - 1))
        elif state.exists:
            state.remove()
        for part in out:
            if len(part):
                yield part.astype({"millis": np.int64, "change": np.int32})

    return step


def _follow(
    held: tuple[str | None, float, float], rows: Iterator[Row], timeout: int
) -> tuple[list[Change], tuple[str | None, float, float]]:
    """Changes by the rows of one request in order of time, and what is held of it after them."""
    endpoint, started, finished = held
    found: list[Change] = []
    for at, is_end, name in rows:
        if not is_end and at > started + timeout:
            found.append((endpoint, started + timeout, -1, EXPIRED))
            started = np.nan
        if is_end:
            finished = at if np.isnan(finished) else finished
        elif np.isnan(started):
            started, endpoint = at, name
            found.append((endpoint, started, 1, START))
        if not np.isnan(started) and not np.isnan(finished):
            over = finished > started + timeout
            found.append((endpoint, started + timeout, -1, EXPIRED) if over else (endpoint, finished, -1, FINISH))
            started = finished = np.nan
    return found, (endpoint, started, finished)


def _millis(times: np.ndarray) -> list[int | None]:
    return [None if np.isnan(t) else int(t) for t in times]


def gauge_changes(
    events: DataFrame, request: str, endpoint: str, phase: str, time: str, timeout_seconds: int, delay: str = "10 minutes",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Stream of changes of the number of requests under way.

    ``phase`` is ``start`` or ``finish``. State is kept by hashed buckets of requests and not by endpoint, so a busy endpoint is
    spread over all tasks; it goes with the request, at the latest ``timeout_seconds`` after its start by the watermark. A bucket's
    rows of one batch, and what is held of it, must fit a task: ``buckets`` grows with the batch, and stays for a checkpoint. For
    state that need not fit the executors' memory see :func:`use_rocks`.
    """
    rows = events.select(
        F.col(request).cast("string").alias("request"), F.col(endpoint).cast("string").alias("endpoint"),
        F.col(phase).alias("phase"), F.col(time).alias("at"),
    ).where(F.col("request").isNotNull() & F.col("at").isNotNull())
    millis = F.rint(F.unix_micros(F.col("at").cast("timestamp")) / 1000).cast("long")
    found = rows.withWatermark("at", delay).select(
        F.pmod(F.xxhash64("request"), F.lit(buckets)).cast("int").alias("bucket"), "request", "endpoint",
        (~F.col("phase").eqNullSafe(START)).alias("ended"), "at", millis.alias("millis"),
    ).groupBy("bucket").applyInPandasWithState(
        bucket_step(timeout_seconds), _FOUND, _OPEN, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("request", "endpoint", F.timestamp_millis("millis").alias("at"), "change", "reason")


class use_rocks:
    """State on the executors' disks instead of in their memory, for the queries started inside."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)

    def __exit__(self, *problem) -> None:
        if self.before is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.before)


def under_way(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Started, finished and expired requests and those still under way, per key."""
    def of(reason: str):
        return F.count_if(F.col("reason") == reason)

    return changes.groupBy(*keys).agg(
        of(START).alias("started"), of(FINISH).alias("finished"), of(EXPIRED).alias("expired"),
        F.sum("change").alias("in_flight"),
    )
