"""Fixed-size overlapping chunks.

Windows of ``size`` characters start every ``size - overlap`` characters of the trimmed text; each
piece is trimmed, empty ones go, and a last piece that only repeats the one before it goes too when
the window before it did not reach the end. Offsets are exploded first and text is cut afterwards,
so no array of texts is ever built and the cut stays in generated code. Length counts code points.

Null, empty and blank texts give no chunks; an invalid size or overlap gives no chunks either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRIMMED, chunk_id, java_trim, sha256_hex
from ..schemas import CHUNK, conform


def _valid(size: int, overlap: int) -> bool:
    return size > 0 and 0 <= overlap < size


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """The chunks of one string, on the driver."""
    if not text or not _valid(size, overlap):
        return []
    body, step = text.strip(TRIMMED), size - overlap
    cut = [body[at : at + size].strip(TRIMMED) for at in range(0, len(body), step)]
    if len(cut) > 1 and cut[-1] == cut[-2] and (len(cut) - 2) * step + size < len(body):
        cut.pop()
    return [piece for piece in cut if piece]


def chunk_with_index(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    return list(enumerate(chunk_text(text, size, overlap)))


def pieces(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """The input's columns but ``text``, with ``piece_no`` (gaps where blank pieces fell out) and ``piece``."""
    keep = [c for c in df.columns if c != text]
    if not _valid(size, overlap):
        return df.limit(0).select(*keep, F.lit(0).alias("piece_no"), F.lit("").alias("piece"))
    step = size - overlap
    body = df.select(*keep, java_trim(text).alias("_body")).filter(F.col("_body") != "")

    def cut(k: Column) -> Column:
        return java_trim(F.substring(F.col("_body"), (k * step + 1).cast("int"), F.lit(size)))

    count = F.ceil(F.length("_body") / F.lit(step)).cast("int")
    repeated = (count >= 2) & ((count - 2) * step + size < F.length("_body")) & (cut(count - 1) == cut(count - 2))
    offsets = body.withColumn("_n", F.when(repeated, count - 1).otherwise(count))
    exploded = offsets.select(*keep, "_body", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece_no"))
    return exploded.select(*keep, "piece_no", cut(F.col("piece_no")).alias("piece")).filter(F.col("piece") != "")


def indexed(cut: DataFrame, *key: str) -> DataFrame:
    """``pieces`` with ``chunk_index`` in place of ``piece_no``: the emitted chunks of each key, counted from 0."""
    index = F.row_number().over(Window.partitionBy(*key).orderBy("piece_no")) - 1
    return cut.withColumn("chunk_index", index).drop("piece_no")


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 100, version: str = "v1", stamp: Column | None = None) -> DataFrame:
    """Chunk rows of Document rows. ``chunkIndex`` counts the emitted chunks of a documentId. Texts are
    spread by documentId before they are cut, which the count needs too: one shuffle, before the overlap."""
    cut = pieces(docs.select("documentId", "content").repartition("documentId"), "content", size, overlap)
    rows = indexed(cut, "documentId").withColumnRenamed("chunk_index", "chunkIndex").withColumn("chunkHash", sha256_hex("piece"))
    made = rows.select(
        chunk_id("documentId", "chunkIndex", "chunkHash").alias("chunkId"),
        "documentId",
        "chunkIndex",
        F.col("piece").alias("chunkText"),
        "chunkHash",
        (stamp if stamp is not None else F.current_timestamp()).alias("chunkTimestamp"),
        F.lit(version).alias("chunkingVersion"),
    )
    return conform(made, CHUNK)
