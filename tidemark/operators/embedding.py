"""Embedding reuse: vectors of chunks that still exist stay, only missing ones are made.

The reuse key is chunkId, which holds the chunk's index and text hash; ``by_model`` adds the model.
Text, which a model needs, travels only for the chunks that lack a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..embedders import Embedder
from ..functions.text import embedding_id_by_vector, vector_hash
from ..schemas import EMBEDDING, conform
from .merge import only


def embeddings_kept(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return only(embeddings, chunks, "chunkId")


def chunks_to_embed(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each chunkId once, so that a repeated row is not embedded twice."""
    have = embeddings.select("chunkId").distinct()
    return chunks.join(have, "chunkId", "left_anti").dropDuplicates(["chunkId"]).select(*chunks.columns)


def embed_chunks(chunks: DataFrame, embedder: Embedder, stamp: Column | None = None) -> DataFrame:
    made = embedder.embed(chunks.select("chunkId", "documentId", "chunkText")).withColumn("embeddingHash", vector_hash("embeddingVector"))
    rows = made.select(
        embedding_id_by_vector("chunkId", "embeddingHash").alias("embeddingId"),
        "chunkId",
        "documentId",
        "embeddingVector",
        "embeddingHash",
        (stamp if stamp is not None else F.current_timestamp()).alias("embeddingTimestamp"),
        F.lit(embedder.model).alias("embeddingModel"),
    )
    return conform(rows, EMBEDDING)


def generate_embeddings(chunks: DataFrame, existing: DataFrame, embedder: Embedder, by_model: bool = False, stamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, made). The caller writes ``made`` once and unites the two."""
    usable = existing.filter(F.col("embeddingModel") == embedder.model) if by_model else existing
    kept = embeddings_kept(usable, chunks)
    return kept, embed_chunks(chunks_to_embed(chunks, usable), embedder, stamp)


def embedding_stats(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: kept, removed and to_embed, from one full outer join of ids."""
    have = embeddings.groupBy("chunkId").agg(F.count(F.lit(1)).alias("_rows"))
    wanted = chunks.select("chunkId").distinct().withColumn("_wanted", F.lit(True))
    both = have.join(wanted, "chunkId", "full_outer")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_rows"))), F.lit(0)).cast("long")
    return both.agg(
        total(F.col("_wanted").isNotNull()).alias("kept"),
        total(F.col("_wanted").isNull()).alias("removed"),
        F.count_if(F.col("_rows").isNull()).alias("to_embed"),
    )
