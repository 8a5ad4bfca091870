"""What changed between the stored documents and a new scan.

One full outer join on the path and the two hashes decides every row; texts never enter the join.
A path must be unique on either side (``assert_unique``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED, DELETED = "new", "changed", "unchanged", "deleted"


def classify(current: DataFrame, previous: DataFrame, key: str = "filePath", hashed: str = "contentHash") -> DataFrame:
    """``key``, ``change_type``. Hashes compare null-safely; a null key is a key of its own."""
    cur = current.select(F.col(key).alias("_k"), F.col(hashed).alias("_h"), F.lit(True).alias("_c")).alias("c")
    old = previous.select(F.col(key).alias("_k"), F.col(hashed).alias("_h"), F.lit(True).alias("_p")).alias("p")
    joined = cur.join(old, F.col("c._k").eqNullSafe(F.col("p._k")), "full_outer")
    kind = (
        F.when(F.col("_p").isNull(), NEW)
        .when(F.col("_c").isNull(), DELETED)
        .when(F.col("c._h").eqNullSafe(F.col("p._h")), UNCHANGED)
        .otherwise(CHANGED)
    )
    return joined.select(F.coalesce("c._k", "p._k").alias(key), kind.alias("change_type"))


@dataclass(frozen=True)
class DocumentDelta:
    """Four views: new, changed and unchanged hold current rows, deleted holds stored rows."""

    new: DataFrame
    changed: DataFrame
    unchanged: DataFrame
    deleted: DataFrame


def detect_changes(current: DataFrame, previous: DataFrame, changes: DataFrame | None = None) -> DocumentDelta:
    """``changes`` may be a stored result of ``classify``, so the join runs once."""
    kinds = classify(current, previous) if changes is None else changes

    def rows(df: DataFrame, kind: str) -> DataFrame:
        wanted = kinds.filter(F.col("change_type") == kind).select(F.col("filePath").alias("_key"))
        return df.join(wanted, df["filePath"].eqNullSafe(F.col("_key")), "left_semi")

    return DocumentDelta(rows(current, NEW), rows(current, CHANGED), rows(current, UNCHANGED), rows(previous, DELETED))


def stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def dedup_ratio(changes: DataFrame) -> DataFrame:
    """One row: unchanged of current in percent, 0.0 for an empty scan."""
    kept = F.count_if(F.col("change_type") == UNCHANGED)
    current = F.count_if(F.col("change_type") != DELETED)
    return changes.agg(F.coalesce(F.try_divide(kept * F.lit(100.0), current), F.lit(0.0)).alias("dedup_ratio"))


def assert_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{key} occurs more than once: {twice[0][0]!r}")
