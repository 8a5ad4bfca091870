"""Grouped streams: rows sorted by group inside a partition, worked on batch by batch.

``blockwise`` is the join used wherever texts need a dictionary that grows with the corpus. Texts are
put into blocks of bounded size; each block asks for the keys that occur in it; the answers come back
to the block by a join; the block's texts then stream past its dictionary. A key that occurs in every
text costs one row per block, not one per occurrence, and no table is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

#: Code points of text in a block.
BLOCK = 8_000_000


def runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The batch cut where the (sorted) column changes."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    ends = pc.run_end_encode(values)
    at = 0
    for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
        yield value, batch.slice(at, end - at)
        at = end


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hash_int(x: int, seed: int = 42) -> int:
    """Spark's hash of an int (Murmur3, 32 bits, signed)."""
    m = 0xFFFFFFFF
    rotl = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    h = seed ^ (rotl((x & m) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m)
    h = ((rotl(h, 13) * 5 + 0xE6546B64) & m) ^ 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=32)
def even_labels(n: int, parts: int) -> tuple[int, ...]:
    """n ints that hash partitioning spreads evenly over ``parts`` partitions. A few blocks numbered
    0, 1, 2... would leave some partitions empty and others with three."""
    if n >= 32 * parts:
        return tuple(range(n))
    room = [n // parts + (i < n % parts) for i in range(parts)]
    out: list[int] = []
    x = 0
    while len(out) < n:
        if room[place := _hash_int(x) % parts]:
            room[place] -= 1
            out.append(x)
        x += 1
    return tuple(out)


def block_count(df: DataFrame, text: str, size: int = BLOCK) -> int:
    """As many blocks as keep each near ``size`` code points, one per shuffle partition at least."""
    total = df.agg(F.sum(F.length(text).cast("long"))).head()[0] or 0
    return max(partitions(df), -(-total // size))


def blockwise(
    docs: DataFrame,
    key: str,
    text: str,
    wanted: Callable[[list[str]], dict[str, list]],
    wanted_schema: str,
    lookup: Callable[[DataFrame], DataFrame],
    apply: Callable[[dict[str, tuple], list, list[str | None]], pa.RecordBatch],
    out_schema: str,
) -> DataFrame:
    """``wanted(texts)`` gives the entries a list of texts needs, as columns of ``wanted_schema`` whose
    first column ``entry`` (a string) is the dictionary key. ``lookup`` turns the distinct
    ``block, entry, ...`` rows into ``block, entry, value...``. ``apply(dictionary, keys, texts)`` makes
    the output of a batch of texts. Null texts pass through ``apply`` as None."""
    blocks = block_count(docs, text)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    if blocks <= 1000:  # beyond, hashing evens out by itself
        block = F.element_at(F.array(*map(F.lit, even_labels(blocks, blocks))), block + 1)
    base = docs.select(block.alias("block"), F.col(key).alias("key"), F.col(text).alias("text"))
    base = base.repartition(blocks, "block")
    ask_schema = T._parse_datatype_string(f"block int, {wanted_schema}")
    ask_arrow = to_arrow_schema(ask_schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.take(pc.sort_indices(batch.column("block")))
            for block, rows in runs(order, "block"):
                found = wanted([t for t in rows.column("text").to_pylist() if t])
                n = len(found["entry"])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), *(pa.array(found[f.name], f.type) for f in list(ask_arrow)[1:])], schema=ask_arrow)

    asked = materialize(base.mapInArrow(ask, ask_schema), "asked")  # read twice: for the totals and by block
    answers = lookup(asked)
    extra = [c for c in answers.columns if c not in ("block", "entry")]
    key_type, none = docs.schema[key].dataType, F.lit(None)
    left = answers.select("block", F.lit(0).alias("kind"), none.cast(key_type).alias("key"), F.col("entry").alias("text"), *extra)
    right = base.select("block", F.lit(1).alias("kind"), "key", "text", *[none.cast(answers.schema[c].dataType).alias(c) for c in extra])
    sorted_rows = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    out_struct = T._parse_datatype_string(out_schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for block, rows in runs(batch, "block"):
                if block != now:
                    now, known = block, {}
                for kind, part in runs(rows, "kind"):
                    if kind == 0:
                        known.update(zip(part.column("text").to_pylist(), zip(*(part.column(c).to_pylist() for c in extra), strict=True), strict=True))
                        continue
                    for at in range(0, part.num_rows, 512):
                        few = part.slice(at, 512)
                        yield apply(known, few.column("key").to_pylist(), few.column("text").to_pylist())

    return sorted_rows.mapInArrow(join, out_struct)
