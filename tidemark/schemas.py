"""Table schemas, column order and typed empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DOCUMENT = _struct(
    ("documentId", T.StringType()),
    ("filePath", T.StringType()),
    ("fileName", T.StringType()),
    ("content", T.StringType()),
    ("contentHash", T.StringType()),
    ("processedAt", T.LongType()),
    ("version", T.StringType()),
)
CHUNK = _struct(
    ("chunkId", T.StringType()),
    ("documentId", T.StringType()),
    ("chunkIndex", T.IntegerType()),
    ("chunkText", T.StringType()),
    ("chunkHash", T.StringType()),
    ("chunkTimestamp", T.TimestampType()),
    ("chunkingVersion", T.StringType()),
)
EMBEDDING = _struct(
    ("embeddingId", T.StringType()),
    ("chunkId", T.StringType()),
    ("documentId", T.StringType()),
    ("embeddingVector", T.ArrayType(T.DoubleType())),
    ("embeddingHash", T.StringType()),
    ("embeddingTimestamp", T.TimestampType()),
    ("embeddingModel", T.StringType()),
)
TABLES = {"documents": DOCUMENT, "chunks": CHUNK, "embeddings": EMBEDDING}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame without rows that still has its columns, so unions and joins stay valid."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, by name and in its order; further columns are left out."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
