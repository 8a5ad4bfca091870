"""Exact top-k by cosine for a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block.
BLOCK = 4096


def _unit(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """``<name>_id, _<name>, _<name>_norm`` of the vectors that are not null or of length zero."""
    numbers = df.select(F.col(key).alias(f"{name}_id"), F.transform(vector, lambda x: x.cast("double")).alias(f"_{name}"))
    length = F.sqrt(F.aggregate(f"_{name}", F.lit(0.0), lambda a, x: a + x * x))
    return numbers.withColumn(f"_{name}_norm", length).filter(F.col(f"_{name}_norm") > 0)


def topk_cosine(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``query_id, neighbour_id, cosine, rank``. The query itself is no neighbour; ties go to the
    smaller id. Vectors that are null or of length zero give nothing.

    Rows are hashed into blocks of about ``block``, every query visits every block by an equi-join, and
    the best of each block are ranked before the blocks' best are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-rows.count() // block))  # so that the product is spread however few the rows are
    r = _unit(rows, key, vector, "neighbour").withColumn("_block", F.pmod(F.xxhash64("neighbour_id"), F.lit(blocks)).cast("int"))
    q = _unit(queries, key, vector, "query").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dot = F.aggregate(F.zip_with("_query", "_neighbour", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = q.join(r, "_block").filter("query_id <> neighbour_id")
    pairs = pairs.select("query_id", "neighbour_id", "_block", F.round(dot / (F.col("_query_norm") * F.col("_neighbour_norm")), 6).alias("cosine"))
    best = Window.partitionBy("query_id", "_block").orderBy(F.desc("cosine"), "neighbour_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id")
    few = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_block")
    return few.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
