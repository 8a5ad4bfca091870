"""Near-duplicate pairs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import near


def pairs(records: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``space, key_a, key_b, similarity`` of ``space, key, text``: every pair of records at or above the
    threshold, key_a < key_b; records with equal sets have similarity 1. Repeated rows of a key count once."""
    who, found = near.links(records, threshold, width)
    copied = who.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = found.unionByName(copied.select(F.col("rid").alias("small"), F.col("rid").alias("large"), F.lit(1.0).alias("similarity")))
    a, b = (who.select("space", F.col("key").alias(f"key_{x}"), F.col("rid").alias(f"rid_{x}")) for x in "ab")
    two = linked.join(a, F.col("small") == F.col("rid_a")).join(b.withColumnRenamed("space", "space_b"), F.col("large") == F.col("rid_b"))
    two = two.filter((F.col("space") == F.col("space_b")) & ((F.col("small") != F.col("large")) | (F.col("key_a") < F.col("key_b"))))
    return two.select("space", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")


def groups(records: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``space, key, group_id, n_links``: one row per record with words enough. A group is a connected
    component of the links; n_links counts the other records of the same set and the linked sets."""
    who, found = near.links(records, threshold, width)
    who = materialize(who, "members")
    labels = components(found.select(F.col("small").alias("a"), F.col("large").alias("b")))
    copies = who.groupBy("rid").agg((F.count(F.lit(1)) - 1).alias("copies"))
    ends = found.select(F.explode(F.array("small", "large")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("ends"))
    out = who.join(copies, "rid").join(ends, "rid", "left").join(labels, "rid", "left")
    return out.select("space", "key", F.coalesce("label", "rid").alias("group_id"), (F.col("copies") + F.coalesce("ends", F.lit(0))).alias("n_links"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``rid, label``: the least id of each connected component of ``a, b``. Alternating large-star and
    small-star steps; the number of rounds grows with the logarithm of the size."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        # large star: every larger neighbour is linked to the least of the neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself are linked to the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = materialize(small, "edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("rid"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("rid"), F.col("b").alias("label")).distinct())
