import pyarrow as pa

from tidemark.llm import _streams


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(-20, 400).select(F.col("id").cast("int").alias("i")).select("i", F.hash("i").alias("h")).collect()
    assert all(_streams._hash_int(r.i) == r.h for r in rows)


def test_labels_fill_partitions_evenly(spark):
    from pyspark.sql import functions as F

    for n, parts in ((7, 7), (12, 4), (30, 12)):
        labels = _streams.even_labels(n, parts)
        df = spark.createDataFrame([(x,) for x in labels], "b int").repartition(parts, "b").withColumn("p", F.spark_partition_id())
        sizes = sorted(r["count"] for r in df.groupBy("p").count().collect())
        assert len(set(labels)) == n and len(sizes) == parts and sizes[-1] - sizes[0] <= 1


def test_runs():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 3, 3], "v": list("abcde")})
    assert [(k, part.column("v").to_pylist()) for k, part in _streams.runs(batch, "k")] == [(1, ["a", "b"]), (2, ["c"]), (3, ["d", "e"])]
    assert list(_streams.runs(batch.slice(0, 0), "k")) == []
