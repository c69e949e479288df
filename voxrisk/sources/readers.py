"""Reading raw feeds and generic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.sources.parsers import REPLY_BITS, parse_lines

# --- Fixed values: what a path or a record says about its platform ---------------
PATH_MARKS = (
    ("bilibili", ("bili",)),
    ("tieba", ("tieba", "tid_")),
    ("zhihu", ("zhihu",)),
    ("douyin", ("douyin", "tiktok")),
)
KEY_MARKS = (("bilibili", ("comment", "ctime")), ("tieba", ("pid", "floor")), ("zhihu", ("type", "content")))


def platform_of_path(path: Column) -> Column:
    """Platform named by the path, null when it names none."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for name, marks in reversed(PATH_MARKS):
        test = F.contains(low, F.lit(marks[0]))
        for mark in marks[1:]:
            test = test | F.contains(low, F.lit(mark))
        out = F.when(test, name).otherwise(out)
    return out


def platform_of_record(line: Column) -> Column:
    """Platform told by the keys of a JSON record, else ``unknown``."""
    keys = F.json_object_keys(line)
    out = F.lit("unknown")
    for name, marks in reversed(KEY_MARKS):
        test = F.array_contains(keys, marks[0]) & F.array_contains(keys, marks[1])
        out = F.when(test, name).otherwise(out)
    return out


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Non-blank lines (with a pattern: of all matching files below) with ``source_file`` and ``ord``, their order in the file.

    ``ord`` joins the place of the file block (in MiB, files up to 128 GB), the row number inside
    the task (a split of 128 MB has fewer than 2^26 lines) and 20 free bits for the replies of a record, so it needs
    neither a sort nor a single reader. It orders the lines of one file; a row is known by (source_file, ord).
    """
    reader = spark.read
    if pattern:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    block = F.shiftright(F.col("_metadata.file_block_start"), 20)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 26) - 1))
    lines = reader.text(path).select(
        tx.strip(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        (F.shiftleft(block, 26 + REPLY_BITS) + F.shiftleft(row, REPLY_BITS)).alias("ord"),
    )
    return lines.filter(F.col("line") != "")


def with_platform(lines: DataFrame, platform: str | None = None) -> DataFrame:
    """Platform per file: as given, else by path, else by the file's first record."""
    if platform is not None:
        return lines.withColumn("platform", F.lit(platform))
    named = lines.withColumn("platform", platform_of_path(F.col("source_file")))
    marks = [mark for _, group in PATH_MARKS for mark in group]
    if all(any(mark in path.lower() for mark in marks) for path in lines.inputFiles()):
        return named  # every file name tells; no file has to be looked into
    known = named.filter(F.col("platform").isNotNull())
    rest = named.filter(F.col("platform").isNull()).drop("platform")
    by_file = rest.groupBy("source_file").agg(platform_of_record(F.min_by("line", "ord")).alias("platform"))
    return known.unionByName(rest.join(by_file, "source_file"))


def scan_jsonl(spark: SparkSession, path: str, platform: str | None = None, clean: bool = True) -> DataFrame:
    """Comments of one JSONL file (or one folder level of files)."""
    return parse_lines(with_platform(read_lines(spark, path), platform), clean)


def scan_dir(
    spark: SparkSession, path: str, platform: str | None = None, clean: bool = True, pattern: str = "*.jsonl"
) -> DataFrame:
    """Comments of every matching file below a folder."""
    return parse_lines(with_platform(read_lines(spark, path, pattern), platform), clean)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def scan_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or one object) per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)
