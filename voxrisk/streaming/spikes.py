"""Spike watch on a stream: running sums per scope in Spark's state store, instead of a second look at the past."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FACTOR, LEAST_HOURS = 3.0, 3
STATE = "hours long, total double"


def spike_stream(
    hourly: DataFrame, scope: Sequence[str] = ("platform",), time: str = "hour_start", count: str = "n", factor: float = FACTOR, least_hours: int = LEAST_HOURS,
) -> DataFrame:
    """(scope, hour, n, mean, hours, is_spike) of closed hours (scope, time, count), each judged against the hours before it.

    The state of a scope is how many hours it has had and their sum, two numbers that Spark keeps and restores; the past is never read again. An
    hour is a spike if its count is over ``factor`` times the mean of at least ``least_hours`` earlier hours with rows. Hours of one batch are
    taken in the order of time; an hour that arrives after a later one, in another batch, is judged by all that came before it. Scopes
    with a null are scopes like others; hours without a time or a count are left out."""
    given = hourly.schema
    schema = ", ".join(f"{name} {given[name].dataType.simpleString()}" for name in scope) + ", hour timestamp, n long, mean double, hours long, is_spike boolean"

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values([time, count])  # a scope's hours that closed since the last batch
        out = []
        for hour, n in zip(rows[time], rows[count]):
            mean = total / seen if seen else None
            out.append((*key, hour, int(n), mean, seen, bool(seen >= least_hours and n > factor * mean)))
            seen, total = seen + 1, total + float(n)
        state.update((seen, total))
        yield pd.DataFrame(out, columns=[*scope, "hour", "n", "mean", "hours", "is_spike"])

    known = hourly.where(F.col(time).isNotNull() & F.col(count).isNotNull())
    return known.groupBy(*scope).applyInPandasWithState(judge, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def keep(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; run again on the same checkpoint to go on where it left off."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def watch(hourly: DataFrame, target: str, checkpoint: str, **given) -> StreamingQuery:
    """Judge all hours that have closed since the last run and stop."""
    return keep(spike_stream(hourly, **given), target, checkpoint)


def closing_row(comments: DataFrame, time: str, close: datetime | None) -> DataFrame:
    """The rows and one more, without anything but the time ``close``: the end of a feed. None adds nothing."""
    if close is None:
        return comments
    end = comments.sparkSession.range(1).select(
        *[F.lit(close if f.name == time else None).cast(f.dataType).alias(f.name) for f in comments.schema.fields])
    return comments.unionByName(end)


def hours_with_close(
    comments: DataFrame, close: datetime | None = None, scope: Sequence[str] = ("platform",), time: str = "publish_time", late: str = "2 hours",
) -> DataFrame:
    """Comments per hour and scope of a stream: (scope, hour_start, n).

    An hour comes out once the watermark has passed it, so the last hours of a feed that ends would stay open for good. A ``closing_row`` with a
    time well behind the last comment moves the watermark past them; its own hour is not counted."""
    counted = comments.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), *scope).agg(F.count("*").alias("n"))
    hours = counted.select(*scope, F.col("w.start").alias("hour_start"), "n")
    return hours if close is None else hours.where(F.col("hour_start") < F.date_trunc("hour", F.lit(close)))
