"""New files as a stream: every micro-batch goes through the same diff, chunk and embed steps.

A stream only ever adds or replaces files; deletions need a full scan (``plans.pipeline.run``). A file
whose text cannot be extracted is kept with its error in the store, and ``retry`` reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..embedders import Embedder
from ..operators import merge
from ..plans.pipeline import RunReport, index
from ..session import materialize, shared_dir
from ..sources import files
from ..sources.store import Store

def _add(spark: SparkSession, config: Config, embedder: Embedder, extracted: DataFrame) -> RunReport:
    arrived = files.to_documents(extracted, config.document_version, config.document_id_mode)
    stored = Store(spark, config.output_dir).load("documents")
    return index(spark, config, merge.merge_documents(arrived, stored, arrived), embedder)


def retry(spark: SparkSession, config: Config, embedder: Embedder, extractor: files.Extractor = files.extract_text_from_bytes) -> RunReport | None:
    """Reads the files again that were kept as failed, which the stream's checkpoint never will; those that
    fail again stay kept. None if there are none."""
    store = Store(spark, config.output_dir)
    kept = materialize(store.failed().select("filePath").distinct(), "failed")
    if kept.isEmpty():
        return None
    there = files.read_files(spark, config.input_dir).join(kept, F.col("path") == F.col("filePath"), "left_semi")
    extracted = materialize(files.extract(there, extractor), "retried")
    report = _add(spark, config, embedder, extracted)
    store.keep_failed(files.quarantine(extracted), True)
    return report


BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, config: Config, embedder: Embedder, extractor: files.Extractor = files.extract_text_from_bytes) -> StreamingQuery:
    """Runs over the files that are there, then ends. The checkpoint keeps a file from being read twice;
    a repeated batch changes nothing because the diff finds its documents stored."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        extracted = materialize(files.extract(batch.select("path", "content"), extractor), "batch")
        Store(spark, config.output_dir).keep_failed(files.quarantine(extracted), False)
        _add(spark, config, embedder, extracted)

    source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.pdf").load(config.input_dir)
    checkpoint = f"{shared_dir(spark)}/tidemark/stream-{config.app_name}"
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
