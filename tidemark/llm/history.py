"""Deduplicating new batches against everything accepted before.

Method: a segment index for edit distance. A record's string is the sorted sequence of its word
sequences' hashes; inserting and deleting are its edits, so that the edit distance of two strings is the
symmetric difference of their sets, and a similarity of at least ``t`` bounds it by
(1 - t) / (1 + t) * (|A| + |B|). A string is cut into a number of segments fixed by its length: the
(1 - t) * length + COMMON rarest items are a segment each, the rest is one that is never looked up. Each
segment is stored with its value, the string's length and its position in the order. Two strings within
the bound agree in COMMON segments after which enough is left of both (``near``). A batch looks up only
its selected segments, candidates are verified by the bounded edit distance of the stored strings, and
what was accepted is appended.

The strings are not the texts themselves: the similarity asked for is Jaccard's, under which a reordered
copy is near although the edit distance of the texts is as large as the texts.

The index lies in folders by bucket of the segment's value, the set's id and the text's digest. A batch
reads the buckets it asks for and no text of the history. Within and between batches the order counts: a
record similar to a rejected one may be accepted. Inside a batch, acceptance is decided in rounds; a
record is accepted once nothing undecided before it concerns it, and rejected once something accepted
before it does.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, released, tidy
from . import _kernels as k
from . import near
from ._streams import even_labels, partitions, runs

SPACE = "all"
TABLES = {
    "segments": "cells binary, rids binary, sizes binary, ranks binary, bucket int",
    "strings": "rid long, items binary, bucket int",
    "values": "v long, w long, bucket int",
}
#: The arrays of a row of segments, and the most segments in one.
ARRAYS = {"cells": np.int64, "rids": np.int64, "sizes": np.int32, "ranks": np.int32}
ROW = 1 << 16
#: Segments of a bucket that a task sorts at a time.
SORTED = 1 << 21
#: A batch probes the stored buckets in so many turns, which bounds what is shuffled at a time.
TURNS = 2
#: Up to so many values and links that concern a batch's undecided records, one task decides on them in order.
ALONE = 300_000


def _values(rows: DataFrame, hashed: str, text: str, *keep: str) -> DataFrame:
    """``keep, v, w``: 128 bits for the lower-case hash and for the text of each row; nulls have none."""
    digest = lambda kind, c: F.when(c.isNotNull(), F.sha2(F.concat(F.lit(kind), c), 256))
    both = rows.select(*keep, F.explode(F.array(digest("h", F.lower(hashed)), digest("t", F.col(text)))).alias("d")).filter("d is not null")
    half = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("long")
    return both.select(*keep, half(1).alias("v"), half(16).alias("w")).distinct()


class Prepared(NamedTuple):
    """Of new records: ``number, rid, size, items, batch``; the arrays of segments with ``bucket, batch``;
    ``batch, number, v, w, bucket``; ``batch, number``; ``batch, small, large``. Stored."""

    strings: DataFrame
    segments: DataFrame
    values: DataFrame
    known: DataFrame
    inside: DataFrame


def _row(bucket: int, arrays: Sequence[np.ndarray], batch: int | None = None) -> pa.RecordBatch:
    columns = {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(ARRAYS, arrays, strict=True)} | {"bucket": pa.array([bucket], pa.int32())}
    return pa.RecordBatch.from_pydict(columns if batch is None else columns | {"batch": pa.array([batch], pa.int64())})


def _arrays(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in ARRAYS.items())


def _in_order(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The segments of all parts by value, each once."""
    cell, rid, size, rank = map(np.concatenate, zip(*parts, strict=True))
    by = np.lexsort((rid, cell))
    cell, rid = cell[by], rid[by]
    fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (rid[1:] != rid[:-1])]) if len(cell) else np.empty(0, bool)
    return cell[fresh], rid[fresh], size[by[fresh]], rank[by[fresh]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments that lie by bucket, sorted by value."""

    def rows(bucket: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole = _in_order(held)
        for at in range(0, len(whole[0]), ROW):
            yield _row(bucket, [x[at : at + ROW] for x in whole])

    now, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            bucket = one.column("bucket")[0].as_py()
            if held and (bucket != now or sum(len(x[0]) for x in held) > SORTED):
                yield from rows(now, held)
                held = []
            now = bucket
            held.append(_arrays(one))
    if held:
        yield from rows(now, held)


@dataclass(frozen=True)
class SegmentIndex:
    """An index stored under ``path``. Appends add files; ``rebuild`` orders the segments anew."""

    spark: SparkSession
    path: str
    threshold: float
    width: int
    buckets: int

    @staticmethod
    def create(history: DataFrame, text: str, hashed: str, path: str, threshold: float = 0.8, width: int = 5, buckets: int | None = None) -> SegmentIndex:
        """Reads the history's texts once for their strings and once for their digests."""
        spark = history.sparkSession
        index = SegmentIndex(spark, path, threshold, width, buckets or partitions(history))
        records = history.select(F.lit(SPACE).alias("space"), F.col(text).alias("text"))
        strings = near.set_rows(records, width).withColumn("bucket", index._bucket("rid"))
        # Copies met by several tasks meet again in their bucket: one shuffle for both.
        once = strings.repartition(index.buckets, "bucket").groupBy("bucket", "rid").agg(F.first("items").alias("items"))
        index._write("strings", once, placed=True)
        index._write("values", _values(history, hashed, text).withColumn("bucket", index._bucket("v")))
        return index.rebuild()

    @staticmethod
    def open(spark: SparkSession, path: str) -> SegmentIndex:
        head = spark.read.parquet(f"{path}/head").head()
        return SegmentIndex(spark, path, **json.loads(head.settings))

    def rebuild(self) -> SegmentIndex:
        """Orders the segments by what is stored now and cuts all strings anew; reads no text."""
        settings = json.dumps({"threshold": self.threshold, "width": self.width, "buckets": self.buckets})
        strings = self._load("strings").select("rid", (F.octet_length("items") / 8).cast("int").alias("size"), "items")
        order = near.sequence_order(near.counted(strings))
        blob = bytearray(zlib.compress(order.tobytes(), 1))
        self._write("segments", self._segments(strings, self.spark.sparkContext.broadcast(order)), "overwrite")
        self.spark.createDataFrame([(settings, blob)], "settings string, levels binary").write.mode("overwrite").parquet(f"{self.path}/head")
        return self

    def order(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.spark.read.parquet(f"{self.path}/head").head().levels), np.uint8)

    def levels(self) -> Broadcast:
        """The order, sent to all tasks."""
        return self.spark.sparkContext.broadcast(self.order())

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _by_bucket(self, rows: DataFrame, *by: str) -> DataFrame:
        """Rows of the index or of new segments, a bucket to a partition and sorted."""
        place = F.col("bucket")
        if self.buckets <= 1000:  # beyond, hashing evens out by itself
            place = F.element_at(F.array(*map(F.lit, even_labels(self.buckets, self.buckets))), place + 1)
        return rows.repartition(self.buckets, place).sortWithinPartitions(*by)

    def _segments(self, strings: DataFrame, levels: Broadcast) -> DataFrame:
        """``cells, rids, sizes, ranks, bucket, batch``: the segments of ``rid, size, items`` and, where there
        are batches, ``batch``. Many in a row, as they come."""
        threshold, buckets = self.threshold, self.buckets
        given = strings if "batch" in strings.columns else strings.withColumn("batch", F.lit(0).cast("long"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for batch, own in runs(rows.take(pc.sort_indices(rows.column("batch"))), "batch"):
                    made = list(near.cell_batches(own, levels.value, threshold))
                    arrays = [np.concatenate([one.column(c).to_numpy() for one in made]) for c in ("cell", "rid", "size", "rank")]
                    bucket = (k.mix(arrays[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    numbers, heads = np.unique(bucket[by], return_index=True)
                    for number, at in zip(numbers.tolist(), np.split(by, heads[1:]), strict=True):
                        yield _row(number, [x[at] for x in arrays], batch)

        return given.select("rid", "size", "items", "batch").mapInArrow(cut, f"{TABLES['segments']}, batch long")

    def _load(self, table: str, wanted: DataFrame | None = None) -> DataFrame:
        """A table, or its buckets in ``wanted.bucket``: at most ``buckets`` numbers."""
        rows = self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}")
        if wanted is None:
            return rows
        numbers = [r[0] for r in wanted.select("bucket").distinct().collect()]
        return rows.filter(F.col("bucket").isin(numbers)) if len(numbers) < self.buckets else rows

    def _write(self, table: str, rows: DataFrame, mode: str = "append", placed: bool = False) -> None:
        """Appends rows with their bucket. Segments lie sorted by value, many in a row of four arrays."""
        if table == "segments":
            rows = self._by_bucket(rows.drop("batch"), "bucket").mapInArrow(_merge, TABLES[table])
        else:
            rows = rows if placed else rows.repartition(self.buckets, "bucket")
            rows = rows.sortWithinPartitions("bucket", {"strings": "rid", "values": "v"}[table])
        with released(self.spark):
            rows.select(*[c.split()[0] for c in TABLES[table].split(", ")]).write.mode(mode).partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{table}")

    def prepare(self, arrivals: DataFrame, vectors: DataFrame, number: str, batch: str, chunk: str, hashed: str, text: str, levels: Broadcast | None = None) -> Prepared:
        """What the judgement needs of one or more new batches: strings, selected segments, values, records
        known by their id, and near strings inside each batch. Reads nothing of the index but the order."""
        rows = arrivals.select(_batch(batch).alias("batch"), F.col(number).cast("long").alias("number"), F.col(chunk).alias("chunk"), F.col(hashed).alias("hashed"), F.col(text).alias("text"))
        made = near.set_rows(rows.select(F.lit(SPACE).alias("space"), "text", "number"), self.width, "number")
        strings = materialize(made.join(rows.select("number", "batch"), "number"), "strings", "batch")
        once = strings.groupBy("rid").agg(F.first("size").alias("size"), F.first("items").alias("items"))
        segments = materialize(self._segments(strings, levels or self.levels()), "segments", "batch")
        values = materialize(_values(rows, "hashed", "text", "batch", "number").withColumn("bucket", self._bucket("v")), "values", "batch")
        ids = rows.select("batch", "number", "chunk", F.xxhash64("chunk").alias("mark")).filter("chunk is not null")
        there = near.sift(vectors.select(F.col(chunk).alias("chunk"), F.xxhash64(chunk).alias("mark")), "mark", ids.select("mark")).filter("hit")
        known = materialize(ids.join(there.select("chunk"), "chunk", "left_semi").select("batch", "number"), "known", "batch")
        met = materialize(_often(self._meet_inside(segments), "batch").filter(F.col("n") >= near.COMMON).drop("n"), "candidates")
        pairs = materialize(met.select("small", "large").distinct(), "pairs")
        found = near.verify(once.select("rid", "items"), pairs, self.threshold, once.select("rid", "size"))
        inside = materialize(met.join(found.select("small", "large"), ["small", "large"], "left_semi"), "inside", "batch")
        return Prepared(strings, segments, values, known, inside)

    def _meet_inside(self, segments: DataFrame) -> DataFrame:
        """``batch, small, large, n``: meetings of a batch's own segments."""
        threshold = self.threshold

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pairs(key: tuple[int, int], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
                own = _in_order(held)
                for small, large, n in near.meetings(own, own, threshold, True):
                    yield pa.RecordBatch.from_pydict({"batch": pa.array(np.full(len(n), key[0])), "small": small, "large": large, "n": n})

            now, held = None, []
            for rows in batches:
                for at in range(rows.num_rows):
                    one = rows.slice(at, 1)
                    key = (one.column("batch")[0].as_py(), one.column("bucket")[0].as_py())
                    if held and key != now:
                        yield from pairs(now, held)
                        held = []
                    now = key
                    held.append(_arrays(one))
            if held:
                yield from pairs(now, held)

        placed = segments.repartition(partitions(segments), "batch", "bucket").sortWithinPartitions("batch", "bucket")
        return placed.mapInArrow(find, "batch long, small long, large long, n int")

    def _meet_stored(self, segments: DataFrame, stored: DataFrame) -> DataFrame:
        """``small, large, n``: meetings of a batch's segments with stored ones."""
        threshold = self.threshold

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, own = None, [], None
            for rows in batches:
                for bucket, part in runs(rows, "bucket"):
                    for kind, few in runs(part, "kind"):
                        if kind == 0:
                            now, held, own = bucket, [*(held if bucket == now else []), _arrays(few)], None
                            continue
                        if bucket != now:  # nothing new is in it
                            continue
                        own = own or _in_order(held)
                        for small, large, n in near.meetings(own, _arrays(few), threshold):
                            yield pa.RecordBatch.from_pydict({"small": small, "large": large, "n": n})

        both = segments.select(*ARRAYS, "bucket", F.lit(0).alias("kind")).unionByName(stored.select(*ARRAYS, "bucket", F.lit(1).alias("kind")))
        return self._by_bucket(both, "bucket", "kind").mapInArrow(find, "small long, large long, n int")

    def probe(self, new: Prepared, batch: int) -> DataFrame:
        """``rid`` of the batch's strings that are stored or near a stored one."""
        segments = new.segments.filter(F.col("batch") == batch)
        stored, turns = self._load("segments", segments), min(TURNS, self.buckets)
        turn = lambda df, n: df.filter(F.col("bucket") % turns == n)
        met = [materialize(_often(self._meet_stored(turn(segments, n), turn(stored, n))), "met") for n in range(turns)]
        pairs = _often(functools.reduce(DataFrame.unionByName, met)).filter(F.col("n") >= near.COMMON)
        pairs = materialize(pairs.select("small", "large"), "candidates")
        discard(*met)
        known = pairs.filter("small <> large").select(F.col("large").alias("rid")).distinct().withColumn("bucket", self._bucket("rid"))
        there = near.sift(self._load("strings", known), "rid", known.select("rid"), 1 << 14).filter("hit").select("rid", "items")
        sets = there.unionByName(new.strings.filter(F.col("batch") == batch).select("rid", "items"))
        sizes = sets.groupBy("rid").agg(F.max(F.octet_length("items") / 8).alias("size"))
        found = near.verify(sets, pairs.filter("small <> large"), self.threshold, sizes)
        return found.select(F.col("small").alias("rid")).unionByName(pairs.filter("small = large").select(F.col("small").alias("rid"))).distinct()

    def judge(self, new: Prepared, batch: int, levels: Broadcast | None = None) -> DataFrame:
        """``number`` of the batch's cases; the others are appended. Stored."""
        strings, _, values, known, inside = (df.filter(F.col("batch") == batch).drop("batch") for df in new)
        stored = self._load("values", values)
        direct = (
            known.select("number")
            .unionByName(values.join(stored.select("v", "w"), ["v", "w"], "left_semi").select("number"))
            .unionByName(strings.join(self.probe(new, batch), "rid", "left_semi").select("number"))
        )
        direct = materialize(direct.distinct(), "direct")

        # What is left: values that several records share (a hash, a text, a set) and links of sets.
        name = lambda kind, *c: F.concat_ws("|", F.lit(kind), *[F.col(x).cast("string") for x in c])
        every = values.select("number", name("v", "v", "w").alias("v")).unionByName(strings.select("number", name("r", "rid").alias("v")))
        every = every.join(direct, "number", "left_anti")
        pairs = inside.select(name("r", "small").alias("v"), name("r", "large").alias("w"))
        edges = pairs.unionByName(pairs.select(F.col("w").alias("v"), F.col("v").alias("w")))
        busy = every.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v").unionByName(edges.select("v")).distinct()
        contested = materialize(every.join(busy, "v", "left_semi"), "contested")
        cases = materialize(direct.unionByName(_refuse(contested, edges)), "cases")

        kept = strings.join(cases, "number", "left_anti")
        self._write("strings", kept.select("rid", "items").dropDuplicates(["rid"]).withColumn("bucket", self._bucket("rid")))
        self._write("segments", self._segments(kept, levels or self.levels()))
        self._write("values", values.join(cases, "number", "left_anti").select("v", "w", "bucket").distinct())
        discard(contested)
        return cases


def _often(met: DataFrame, *keep: str) -> DataFrame:
    return met.groupBy(*keep, "small", "large").agg(F.sum("n").alias("n"))


def _batch(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(-(2**62)))


def already_known(
    arrivals: DataFrame, history: DataFrame, vectors: DataFrame, path: str, number: str = "arrivalNo", batch: str = "batchNo",
    chunk: str = "chunkId", hashed: str = "chunkHash", text: str = "chunkText", threshold: float = 0.6, width: int = 3,
) -> DataFrame:
    """``number`` of the arrivals that bring nothing new. The batches are judged one after another, each
    against the index of the history and of what was accepted before it.

    Defined cases: an arrival whose hash and text are null can only be a case by its id; texts of fewer
    than ``width`` words are compared as a whole only; null ids match nothing; a null batch number comes
    first; repeated history rows count once; empty tables are fine."""
    index = SegmentIndex.create(history, text, hashed, path, threshold, width)
    levels = index.levels()
    tidy(index.spark)
    new = index.prepare(arrivals, vectors, number, batch, chunk, hashed, text, levels)
    numbers = sorted(r[0] for r in arrivals.select(_batch(batch).alias("b")).distinct().collect())  # one row per delivery
    found = []
    for n in numbers:
        found.append(index.judge(new, n, levels))
        tidy(index.spark)
    discard(*new)
    none = arrivals.sparkSession.createDataFrame([], "number long")
    cases = functools.reduce(DataFrame.unionByName, found, none)
    return cases.select(F.col("number").cast(arrivals.schema[number].dataType).alias(number))


def _refuse(values: DataFrame, edges: DataFrame) -> DataFrame:
    """``number`` of the records that an accepted earlier one concerns. ``values``: number, v; two records
    concern each other if they share a value or hold the two values of an edge. One task goes through up to
    ALONE of them in order; more are decided in rounds."""
    none = F.lit(None)
    rows = values.filter("number is not null").select("number", "v", none.cast("string").alias("w")).unionByName(edges.select(none.cast("long").alias("number"), "v", "w"))
    return rows.repartition(1).mapInArrow(_in_turn, "number long") if rows.count() <= ALONE else _refuse_in_rounds(values, edges)


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[str]] = {}
    links: dict[str, list[str]] = {}
    for batch in batches:
        for number, v, w in zip(*(batch.column(c).to_pylist() for c in ("number", "v", "w")), strict=True):
            if number is None:
                links.setdefault(v, []).append(w)
            else:
                held.setdefault(number, []).append(v)
    taken, out = set(), []
    for number in sorted(held):
        if taken.isdisjoint(held[number]):
            taken.update(held[number], *(links.get(v, ()) for v in held[number]))
        else:
            out.append(number)
    yield pa.RecordBatch.from_pydict({"number": pa.array(out, pa.int64())})


def _refuse_in_rounds(values: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``_refuse``. Every record without an undecided one before it is decided in a round, and what it
    concerns with it, so the rounds are as many as the longest chain of records that wait for one another,
    halved."""

    def least(of: DataFrame, rows: DataFrame) -> DataFrame:
        """For each record of ``rows`` the least number in ``of`` that concerns it."""
        by_value = of.groupBy("v").agg(F.min("number").alias("m"))
        across = edges.join(by_value.withColumnRenamed("v", "w"), "w").select("v", "m")
        all_values = by_value.unionByName(across).groupBy("v").agg(F.min("m").alias("m"))
        return rows.join(all_values, "v").groupBy("number").agg(F.min("m").alias("m"))

    decided = []
    undecided = values
    while not undecided.isEmpty():
        first = least(undecided, undecided).filter("m >= number").select("number")
        fresh = undecided.join(first, "number", "left_semi")
        out = least(fresh, undecided).filter("m < number").select("number", F.lit(True).alias("out"))
        decided.append(materialize(out.unionByName(first.select("number", F.lit(False).alias("out"))), "decided"))
        undecided = values.join(functools.reduce(DataFrame.unionByName, decided), "number", "left_anti")
    none = values.sparkSession.createDataFrame([], "number long")
    return functools.reduce(DataFrame.unionByName, [d.filter("out").select("number") for d in decided], none)
