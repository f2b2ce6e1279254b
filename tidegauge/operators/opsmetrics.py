"""Request counters, latency histograms and sliding operational rates.

Every function takes one row per finished request; the same column expressions
serve batch and stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.ranking import quantile_within, running_sum_per_key

# Histogram bounds in seconds, by kind of request.
LATENCY_BOUNDS = {
    "predict": [0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0],
    "feature_lookup": [0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0],
    "model": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0],
    "chat": [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 45.0],
    "retrieval": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0],
}


def request_counts(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Requests per label combination."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests"))


def bucket_counts(latency: Column, bounds: Sequence[float]) -> list[Column]:
    """Cumulative histogram counts as aggregates ``le_0..le_n``; the last has no bound."""
    counts = [F.count_if(latency <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*counts, F.count(latency).alias(f"le_{len(bounds)}")]


def latency_histogram(
    events: DataFrame, bounds: Sequence[float], keys: Sequence[str] = (), latency: str = "latency_s"
) -> DataFrame:
    """Cumulative buckets in long form: ``(*keys, le, cumulative)``; ``le`` is +Inf at the end."""
    wide = events.groupBy(*keys).agg(*bucket_counts(F.col(latency), bounds))
    names = [*[str(float(b)) for b in bounds], "+Inf"]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("le"), F.col(f"le_{i}").alias("cumulative"))
            for i, n in enumerate(names)
        ]
    )
    return wide.select(*keys, F.inline(rows))


def bucket_quantile(counts: Sequence[Column], bounds: Sequence[float], q: float) -> Column:
    """Quantile interpolated inside the bucket that holds it; past the last bound, that bound."""
    total = counts[-1]
    target = F.lit(float(q)) * total
    found = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        below = counts[i - 1] if i else F.lit(0)
        inside = low + (F.lit(float(bounds[i])) - low) * F.try_divide(
            (target - below).cast("double"), (counts[i] - below).cast("double")
        )
        found = F.when(counts[i] >= target, inside).otherwise(found)
    return F.when(total > 0, found)


def sliding(time: str, length: str = "5 minutes", slide: str = "1 minute") -> Column:
    """Overlapping windows over an event time."""
    return F.window(F.col(time), length, slide)


def latency_p95(
    events: DataFrame,
    bounds: Sequence[float],
    keys: Sequence[str] = (),
    time: str = "ts",
    latency: str = "latency_s",
    length: str = "5 minutes",
    slide: str = "1 minute",
) -> DataFrame:
    """Bucket-interpolated p95 per sliding window."""
    names = [f"le_{i}" for i in range(len(bounds) + 1)]
    counted = events.groupBy(*keys, sliding(time, length, slide).alias("window")).agg(
        *bucket_counts(F.col(latency), bounds)
    )
    quantile = bucket_quantile([F.col(n) for n in names], bounds, 0.95)
    return counted.select(
        *keys,
        F.col("window.start").alias("window_start"),
        F.col(names[-1]).alias("requests"),
        quantile.alias("p95"),
    )


def latency_p95_exact(
    events: DataFrame,
    keys: Sequence[str] = (),
    time: str = "ts",
    latency: str = "latency_s",
    length: str = "1 hour",
) -> DataFrame:
    """Exact interpolated p95 per tumbling window."""
    stamped = events.select(
        *keys, F.window(F.col(time), length).getField("start").alias("window_start"), F.col(latency).alias("_value")
    )
    found = quantile_within(stamped, [*keys, "window_start"], "_value", 0.95, "p95")
    return found.select(*keys, "window_start", F.col("n").alias("requests"), "p95")


def request_rate(
    events: DataFrame,
    keys: Sequence[str] = (),
    time: str = "ts",
    length: str = "1 minute",
    slide: str | None = None,
) -> DataFrame:
    """Requests per minute and window."""
    window = F.window(F.col(time), length, slide or length).alias("window")
    minutes = F.timestamp_diff("SECOND", F.col("window.start"), F.col("window.end")) / F.lit(60.0)
    counted = events.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(
        *keys,
        F.col("window.start").alias("window_start"),
        "requests",
        (F.col("requests") / minutes).alias("per_minute"),
    )


def error_share(
    events: DataFrame,
    failed: Column,
    keys: Sequence[str] = (),
    time: str = "ts",
    length: str = "5 minutes",
    slide: str = "1 minute",
) -> DataFrame:
    """Share of failed requests per sliding window; a window without requests has no row."""
    counted = events.groupBy(*keys, sliding(time, length, slide).alias("window")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors")
    )
    return counted.select(
        *keys,
        F.col("window.start").alias("window_start"),
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_share"),
    )


def in_flight(events: DataFrame, key: str, time: str, row_id: str, delta: Column) -> DataFrame:
    """Requests under way per endpoint after each event (+1 start, -1 finish)."""
    return running_sum_per_key(events, [key], [F.col(time), F.col(row_id)], delta, "in_flight")


def stage_durations(events: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Count, mean and greatest elapsed seconds per stage."""
    seconds = (F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))) / F.lit(1_000_000.0)
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s")
    )
