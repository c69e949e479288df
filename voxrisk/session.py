"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
#: Methods of more bytes are not compiled by the JVM (its own limit), which then interprets them row by row.
COMPILED_BYTES = "8000"
#: Paths that ``settle`` has written inside the innermost ``scratch_tables``; none outside of any.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(master: str = "local[*]", app: str = "voxrisk", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``. Only where that is unset (tests, local runs) a
    private temporary folder is made and recorded for the session."""
    folder = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxrisk-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark)}/voxrisk/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result that should be small and read it back.

    The planner then knows its real size: a join broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles above, so the large side is not
    moved just to find out."""
    path = scratch_path(df.sparkSession, name)
    if (inside := _scratch.get()) is not None:
        inside.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are deleted at the end, so nothing that still has to be computed may read them then."""
    paths: list[str] = []
    outer = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(outer)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle_last(spark: SparkSession, build: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``settle`` of what ``build`` returns; the tables that it settled on its way are deleted as soon as the result is written."""
    kept = _scratch.get()
    with scratch_tables(spark):
        last = build()
        _scratch.set(kept)  # the result itself belongs to the caller
        return settle(last, name)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Steps that run inside are generated as methods small enough for the JVM to compile.

    Long expressions otherwise make one method of a whole stage, which stays interpreted and takes several times the time."""
    before = spark.conf.get(METHOD_CONF, None)
    spark.conf.set(METHOD_CONF, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(METHOD_CONF) if before is None else spark.conf.set(METHOD_CONF, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint storage and continue from there.

    Used where several branches read the same row features, so the text is
    scanned and scored once. The copy survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
