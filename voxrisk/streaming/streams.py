"""Live forms: cleaning of arriving files and hourly volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxrisk.functions import text as tx
from voxrisk.operators.anomalies import volume_spike
from voxrisk.sources.parsers import parse_lines
from voxrisk.sources.readers import platform_of_path, platform_of_record


def stream_lines(spark: SparkSession, path: str, platform: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Arriving lines. A record tells its own platform where the path does not."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
        .select(tx.strip(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("source_file"))
        .filter(F.col("line") != "")
    )
    told = F.coalesce(platform_of_path(F.col("source_file")), platform_of_record(F.col("line")))
    return lines.withColumns({
        "platform": F.lit(platform) if platform else told,
        "ord": F.lit(0).cast("bigint"),  # arrival has no line order; replies keep theirs
    })


def stream_clean(spark: SparkSession, path: str, platform: str | None = None, clean: bool = True) -> DataFrame:
    """Cleaned comments of arriving JSONL files; lines that do not parse are dropped."""
    return parse_lines(stream_lines(spark, path, platform), clean)


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; run again to continue where it left off."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_hourly_volume(comments: DataFrame, late: str = "2 hours", scope: tuple[str, ...] = ("platform",)) -> DataFrame:
    """Comments per hour and scope; an hour is given out once no later row can join it."""
    return (
        comments.withWatermark("publish_time", late)
        .groupBy(F.window("publish_time", "1 hour").alias("w"), *scope)
        .agg(F.count("*").alias("n"))
        .select(*scope, F.col("w.start").alias("hour_start"), "n")
    )


def watch_spikes(hourly: DataFrame, history: str, alerts: str, checkpoint: str, scope: tuple[str, ...] = ("platform",), factor: float = 3.0) -> StreamingQuery:
    """Keep closed hours in a table and report those that stand out against it.

    Each batch overwrites its own partition, so a repeated batch changes nothing.
    """
    def batch(closed: DataFrame, batch_id: int) -> None:
        spark = closed.sparkSession
        closed.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        known = spark.read.parquet(history)
        spikes = volume_spike(known.drop("batch"), scope, factor)
        fresh = known.filter(F.col("batch") == batch_id).select(
            *scope, F.date_format("hour_start", "yyyy-MM-dd HH:00").alias("time_window")
        )
        spikes.join(fresh, [*scope, "time_window"], "left_semi").write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")

    return (
        hourly.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
