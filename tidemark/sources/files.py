"""Scan of a directory of files into Document rows.

Errors of the scan itself raise. A file whose text cannot be extracted becomes a row of the
quarantine frame with its error and is never mistaken for a deleted file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_id_from_path, document_id_of_file, file_name_of, sha256_hex
from ..schemas import DOCUMENT, conform
from .pdf import extract_text_from_bytes

Extractor = Callable[[bytes], str]


def read_files(spark: SparkSession, input_dir: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, content`` of the files directly in the folder; an empty folder gives no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(input_dir).select("path", "content")


def extract(files: DataFrame, extractor: Extractor = extract_text_from_bytes) -> DataFrame:
    """``filePath, content, error``: exactly one of the last two is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for data in pdf.content:
                try:
                    texts.append(extractor(bytes(data)))
                    errors.append(None)
                except Exception as e:  # any reader may raise anything; the row carries it
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"filePath": pdf.path, "content": texts, "error": errors})

    return files.mapInPandas(run, "filePath string, content string, error string")


def to_documents(extracted: DataFrame, version: str = "v1", id_mode: str = "file_name", processed_at: Column | None = None) -> DataFrame:
    """Document rows of the extracted texts; the hash is of the text, not of the bytes."""
    name = file_name_of("filePath")
    made = extracted.filter("error is null").select(
        (document_id_of_file(name) if id_mode == "file_name" else document_id_from_path("filePath")).alias("documentId"),
        "filePath",
        name.alias("fileName"),
        "content",
        sha256_hex("content").alias("contentHash"),
        (processed_at if processed_at is not None else F.unix_millis(F.current_timestamp())).alias("processedAt"),
        F.lit(version).alias("version"),
    )
    return conform(made, DOCUMENT)


def quarantine(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is not null").select("filePath", "error")


def scan_documents(spark: SparkSession, input_dir: str, extractor: Extractor = extract_text_from_bytes, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine). Both come from one lazy extraction: store it once before using both."""
    extracted = extract(read_files(spark, input_dir), extractor)
    return to_documents(extracted, **options), quarantine(extracted)
