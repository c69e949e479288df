"""Sinks. Each writes in parallel, one file per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrisk.plans import render


def sink_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def sink_json(df: DataFrame, path: str) -> None:
    """Rows or summaries as JSON, replacing what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV needs."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    texts = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)}
    return df.withColumns(texts) if texts else df


def sink_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def sink_report(reports: DataFrame, path: str, scope: Sequence[str], formats: Sequence[str] = ("md", "json")) -> None:
    """Reports in the chosen formats (md, json, html, txt), a folder per format.

    All texts are made in one job, so the analysis behind the reports runs once.
    """
    texts = F.array(*[
        F.struct(F.lit(kind).alias("format"), render.FORMATS[kind]().alias("report")) for kind in formats
    ])
    reports.select(*scope, F.inline(texts)).write.mode("overwrite").partitionBy("format").json(path)
