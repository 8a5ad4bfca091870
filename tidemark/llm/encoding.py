"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: distinct-word table. Texts are split by the tokenizer's own pattern, every distinct word is
encoded once for the whole corpus, and the ids go back to the words' positions through the block
dictionary join. Decoding joins ids with the pieces of the vocabulary.

Defined cases: null and empty texts give the empty list; strings that look like special tokens are
ordinary text; a repeated key gives a row for each of its rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._streams import blockwise

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the rank file's tokenizer splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


def distinct_words(texts: list[str]) -> dict[str, list]:
    split, found = splitter().findall, set()
    for t in texts:
        found.update(split(t))
    return {"entry": list(found)}


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """``entry, ids`` of distinct ``entry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path).encode_ordinary
        for batch in batches:
            entries = batch.column("entry").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array([one(w) for w in entries], pa.list_(pa.int32()))], names=["entry", "ids"])

    return words.select("entry").distinct().mapInArrow(run, "entry string, ids array<int>")


def _lookup(path: str):
    def join(asked: DataFrame) -> DataFrame:
        each = asked.distinct()
        return each.join(word_ids(each, path), "entry").select("block", "entry", "ids")

    return join


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids``."""
    path, kind = os.path.join(folder, f"{tokenizer}.tiktoken"), docs.schema[key].dataType.simpleString()

    def apply(known: dict, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        split, ids = splitter().findall, []
        for t in texts:
            out: list[int] = []
            for w in split(t) if t else ():
                out += known[w][0]
            ids.append(np.array(out, np.int32))
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["key", "ids"])

    return blockwise(docs, key, text, distinct_words, "entry string", _lookup(path), apply, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, n_tokens``: as ``encode``, but only lengths travel."""
    path, kind = os.path.join(folder, f"{tokenizer}.tiktoken"), docs.schema[key].dataType.simpleString()

    def lookup(asked: DataFrame) -> DataFrame:
        return _lookup(path)(asked).select("block", "entry", F.size("ids").alias("n"))

    def apply(known: dict, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        split = splitter().findall
        sizes = [sum(known[w][0] for w in split(t)) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes, pa.int32())], names=["key", "n_tokens"])

    return blockwise(docs, key, text, distinct_words, "entry string", lookup, apply, f"key {kind}, n_tokens int").withColumnRenamed("key", key)


def pieces(spark, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The vocabulary: ``id, piece``. Its size is fixed by the tokenizer."""
    path = os.path.join(folder, f"{tokenizer}.tiktoken")
    lines = spark.read.text(f"file://{path}").select(F.split("value", " ").alias("v"))
    return lines.select(F.element_at("v", 2).cast("int").alias("id"), F.unbase64(F.element_at("v", 1)).alias("piece"))


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, text`` of ``key, ids``: an id-to-piece join. Ids that are no piece give nothing; the empty
    list and null give ''. The pieces of a text are put together in runs of 4,096 first, so that the
    aggregation of a very long text carries few values."""
    vocabulary = F.broadcast(pieces(encoded.sparkSession, tokenizer, folder))  # 50,256 rows at most
    each = encoded.select(key, F.posexplode("ids").alias("at", "id")).join(vocabulary, "id")
    hexed = each.withColumn("part", F.floor(F.col("at") / 4096)).groupBy(key, "part").agg(F.collect_list(F.struct("at", F.hex("piece").alias("h"))).alias("v"))
    joined = hexed.select(key, "part", F.array_join(F.transform(F.array_sort("v"), lambda x: x["h"]), "").alias("h"))
    whole = joined.groupBy(key).agg(F.collect_list(F.struct("part", "h")).alias("v"))
    texts = whole.select(F.col(key).alias("_k"), F.decode(F.unhex(F.array_join(F.transform(F.array_sort("v"), lambda x: x["h"]), "")), "utf-8").alias("text"))
    return encoded.select(key).join(texts, encoded[key].eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
