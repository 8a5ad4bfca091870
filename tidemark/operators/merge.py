"""Merging kept rows with newly made ones. Removal is always an anti-join on a frame of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without(rows: DataFrame, removed: DataFrame, key: str = "documentId") -> DataFrame:
    """Rows whose key is not in ``removed``; an empty ``removed`` returns all of them. Null keys stay."""
    return rows.join(removed.select(key).distinct(), key, "left_anti").select(*rows.columns)


def only(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return rows.join(kept.select(key).distinct(), key, "left_semi").select(*rows.columns)


def docs_to_process(new: DataFrame, changed: DataFrame) -> DataFrame:
    """By name: the order of the two sides' columns does not matter."""
    return new.unionByName(changed)


def merge_chunks(new: DataFrame, existing: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored chunks of documents that stayed, and the new chunks."""
    return without(existing, replaced).unionByName(new)


def delete_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return without(chunks, documents)


def merge_documents(processed: DataFrame, existing: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored documents but those replaced or deleted (by path), and the processed ones."""
    return without(existing, replaced, "filePath").unionByName(processed)


def merge_embeddings(kept: DataFrame, made: DataFrame) -> DataFrame:
    return kept.unionByName(made)


def distinct_documents(chunks: DataFrame) -> DataFrame:
    return chunks.select("documentId").distinct()
