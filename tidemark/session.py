"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; a temporary one only in a
    local session where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Removes this application's intermediate tables. Call it when their results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes the frame as a table in the shared folder and reads it again. The lineage ends there
    and the files outlive any executor; ``sweep`` removes them. With ``by``, a column of few values, a
    filter on it reads its rows alone."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written inside is stored for good, so its shuffle files go as soon as the write has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def tidy(spark: SparkSession) -> None:
    """Frees what ended queries left in the driver: plans, generated classes, broadcasts and the heap they
    took. For loops of many queries; without it the driver grows to its limit before it collects."""
    gc.collect()  # frames that Python still holds keep their plans in the JVM
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored intermediate frames that nothing reads any more. Files outside this
    application's part of the shared folder stay."""
    for df in frames:
        spark = df.sparkSession
        inside = f"/tidemark/{spark.sparkContext.applicationId}/"
        for folder in {"/".join([a, inside.strip("/"), b.split("/")[0]]) for a, found, b in (f.partition(inside) for f in df.inputFiles()) if found}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
