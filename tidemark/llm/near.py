"""The similarity join behind near-duplicate grouping and batch deduplication.

A record is the set of its word sequences; the similarity of two records is the Jaccard similarity of
their sets. At least ``t`` means a symmetric difference of at most (1 - t) / (1 + t) * (|A| + |B|).

Pairs are found in three steps, none of which loses one:

1. An equality join on rare word sequences (prefix filtering). Each set is put in a global order, rarest
   first. Two similar sets share at least ``need`` = ceil(t / (1 + t) * (|A| + |B|)) sequences, and the
   first COMMON of the shared ones (``need`` if that is less) stand among the first (1 - t) * size +
   COMMON places of both. A pair is kept if it meets that often, counting only meetings after which
   enough is left of both sets.
2. Segment popcounts. A set's fingerprint is a string of 2**64 bits cut into SEGMENTS; its embedding is
   the number of set bits in each segment. The Manhattan distance of two embeddings never exceeds the
   symmetric difference, so pairs further apart than the bound go.
3. The sets themselves, with their full 64-bit hashes.

A grid over the embeddings cannot replace the first step: at t = 0.6 the bound is a quarter of both
sizes, and unrelated records of 150 sequences are only 1.5 times as far apart over 64 segments.

The join on sequences is a plain join, so a sequence that very many records have is split by adaptive
execution. Sets are verified in blocks: a pair's place is the smallest neighbour of its smaller set, and
in a place with many sets a block of either side, so that a set travels once for a small group and once
per block for a large one. Copies of a set are one row before any join.

What is shared with all tasks is the table of sequence frequencies, ``2**ORDER_BITS`` bytes, and filters
of FILTER_WORDS rows, whatever the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import _kernels as k
from ._streams import partitions, runs

U64 = np.uint64
ORDER_BITS = 22
SLOTS = 64
#: Tables of counts that one task adds up.
FAN = 256
#: Segments of the fingerprint whose popcounts are compared.
SEGMENTS = 64
#: How often a pair must meet on rare sequences.
COMMON = 3
FILTER_WORDS = 1 << 17
#: Members of sets in a block of the verification.
BLOCK = 100_000
#: Meetings that are looked at together.
MEETINGS = 2_000_000
#: A cell is the upper 40 bits of a sequence's hash. Cells only choose candidates: two sequences in one cell
#: can add a pair, never lose one.
CELLS = "rid long, size int, rank int, cell long"
SETS = "rid long, size int, items binary"


def _salt(space: str) -> np.uint64:
    return U64(zlib.crc32((space or "").encode()) * 0x9E3779B97F4A7C15 % 2**64)


def sets_of(spaces: list[str], texts: list[str | None], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the texts: (from, to, hashes by owner, owners, sizes, record ids)."""
    for a, b in k.slices(texts):
        h, owner = k.shingles([t or "" for t in texts[a:b]], width)
        salts = np.array([_salt(s) for s in spaces[a:b]], U64)
        h = k.mix(h ^ salts[owner])
        size = np.bincount(owner, minlength=b - a)
        total = np.zeros(b - a, U64)
        heads = np.flatnonzero(size)
        if len(heads):
            total[heads] = np.add.reduceat(k.mix(h + U64(1)), np.concatenate([[0], np.cumsum(size[heads])[:-1]]))
        yield a, b, h, owner, size, k.mix(total + size.astype(U64)).view(np.int64)


def sift(rows: DataFrame, key: str, wanted: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` with ``hit``, false only where the long ``key`` is surely not in ``wanted``'s one column.
    The keys must be hashes. A bit for each wanted key in a table of ``words`` rows is sent along."""
    word = lambda c: F.pmod(F.col(c), F.lit(words)).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(`{c}`, {words.bit_length() - 1}), 64) as int))")
    table = wanted.toDF("_key").filter("_key is not null").groupBy(word("_key").alias("_word")).agg(F.bit_or(bit("_key")).alias("_bits"))
    joined = rows.withColumn("_at", word(key)).join(F.broadcast(table), F.col("_at") == F.col("_word"), "left")
    return joined.withColumn("hit", F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def bit_table(keys: DataFrame) -> np.ndarray:
    """The table of ``sift`` for Python: FILTER_WORDS words, a bit for each of the longs."""
    word = F.pmod(F.col("_key"), F.lit(FILTER_WORDS)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(_key, {FILTER_WORDS.bit_length() - 1}), 64) as int))")
    out = np.zeros(FILTER_WORDS, np.int64)
    found = keys.toDF("_key").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # FILTER_WORDS rows at most
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(U64)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are surely not in the table."""
    shift = (keys.view(U64) >> U64(FILTER_WORDS.bit_length() - 1)) % U64(64)
    return (table[keys % FILTER_WORDS] >> shift & U64(1)) == 1


# --- the order of the sequences ---------------------------------------------------------------------

PROFILE = "space string, key string, rid long, size int, slot int, blob binary"


def _slot_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    parts = np.split(counts.astype(np.uint32), SLOTS)
    return pa.array(range(SLOTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())


class _Counts:
    """How many sets have a sequence, by the upper ORDER_BITS of its hash."""

    def __init__(self) -> None:
        self.counts, self.pending, self.held = np.zeros(1 << ORDER_BITS, np.int32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.pending.append((h >> U64(64 - ORDER_BITS)).astype(np.int32))
        self.held += len(h)
        if self.held > 4_000_000:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=len(self.counts)).astype(np.int32)
        self.pending, self.held = [], 0
        return self.counts


def profile(records: DataFrame, width: int = 3) -> DataFrame:
    """Of ``space, key, text``: a row (space, key, rid, size) for each record with words enough, equal
    sets having equal rids, and rows (slot, blob) with the counts of sequences. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            spaces, keys, texts = (batch.column(c).to_pylist() for c in ("space", "key", "text"))
            for a, _, h, _, size, rid in sets_of(spaces, texts, width):
                counts.add(h)
                has = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([spaces[a + i] for i in has], pa.string()), pa.array([keys[a + i] for i in has], pa.string()), pa.array(rid[has]), pa.array(size[has], pa.int32()), pa.nulls(len(has), pa.int32()), pa.nulls(len(has), pa.binary())],
                    names=["space", "key", "rid", "size", "slot", "blob"],
                )
        if counts.settle().any():
            slot, blob = _slot_rows(counts.counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLOTS, pa.string()), pa.nulls(SLOTS, pa.string()), pa.nulls(SLOTS, pa.int64()), pa.nulls(SLOTS, pa.int32()), slot, blob], names=["space", "key", "rid", "size", "slot", "blob"])

    return materialize(records.select("space", "key", "text").mapInArrow(run, PROFILE), "profile")


def members(profiled: DataFrame) -> DataFrame:
    """``space, key, rid, size``, each record once."""
    return profiled.filter("slot is null").select("space", "key", "rid", "size").distinct()


def counted(sets: DataFrame) -> DataFrame:
    """``slot, blob`` of SETS: the counts of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for blob in batch.column("items").to_pylist():
                counts.add(np.frombuffer(blob, U64))
        if counts.settle().any():
            yield pa.RecordBatch.from_arrays(list(_slot_rows(counts.counts)), names=["slot", "blob"])

    return sets.select("items").mapInArrow(run, "slot int, blob binary")


def sequence_order(slots: DataFrame) -> np.ndarray:
    """A byte for each prefix of a hash that grows with the number of sets below it: 2**ORDER_BITS bytes.
    ``slots``: slot, blob. The tasks' counts are added in groups of at most FAN until one is left of each
    slot."""

    def added(rows: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(zlib.decompress(b), np.uint32).astype(np.int64) for b in rows.column("blob").to_pylist())

    def add(rows: pa.Table) -> pa.Table:
        total = np.minimum(added(rows), 2**32 - 1).astype(np.uint32)
        return pa.table({"slot": rows.column("slot").slice(0, 1), "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def level(rows: pa.Table) -> pa.Table:
        levels = np.minimum(255, np.round(8 * np.log2(1 + added(rows)))).astype(np.uint8)
        return pa.table({"slot": rows.column("slot").slice(0, 1), "blob": pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())})

    rows = slots.filter("slot is not null").select("slot", "blob")
    n = rows.count() // SLOTS
    while n > FAN:
        n = -(-n // FAN)
        rows = rows.groupBy("slot", F.pmod(F.xxhash64("blob"), F.lit(n)).alias("part")).applyInArrow(add, "slot int, blob binary")
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    step = len(out) // SLOTS
    for r in rows.groupBy("slot").applyInArrow(level, "slot int, blob binary").collect():  # SLOTS rows
        out[r.slot * step : (r.slot + 1) * step] = np.frombuffer(zlib.decompress(r.blob), np.uint8)
    return out


# --- sets and their first sequences -----------------------------------------------------------------


def set_rows(records: DataFrame, width: int, extra: str | None = None) -> DataFrame:
    """SETS of ``space, text``: the sorted hashes of each set. ``extra`` names a long column to keep; then
    every record has a row, otherwise a task emits a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = batch.column(extra).to_pylist() if extra else None
            for a, _, h, _, size, rid in sets_of(batch.column("space").to_pylist(), batch.column("text").to_pylist(), width):
                ends, use, blobs = np.cumsum(size), [], []
                for i in np.flatnonzero(size):
                    if own is None:
                        if int(rid[i]) in seen:
                            continue
                        seen.add(int(rid[i]))
                    use.append(i)
                    blobs.append(np.sort(h[ends[i] - size[i] : ends[i]]).tobytes())
                columns = [pa.array(rid[use], pa.int64()), pa.array(size[use], pa.int32()), pa.array(blobs, pa.binary())]
                names = ["rid", "size", "items"]
                if extra:
                    columns, names = [*columns, pa.array([own[a + i] for i in use], pa.int64())], [*names, extra]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return records.select("space", "text", *([extra] if extra else [])).mapInArrow(run, SETS + (f", {extra} long" if extra else ""))


def _first(h: np.ndarray, size: np.ndarray, level: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, set number, rank) of the first sequences of sets given one after another."""
    owner = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((h, level[(h >> U64(64 - ORDER_BITS)).astype(np.int64)], owner))
    h = h[by]
    rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    first = rank <= (size - np.ceil(threshold * size - 1e-9) + COMMON - 1)[owner]
    return h[first], owner[first], rank[first]


def _cell_batch(h: np.ndarray, size: np.ndarray, rid: np.ndarray, level: np.ndarray, threshold: float) -> pa.RecordBatch:
    cell, owner, rank = _first(h, size, level, threshold)
    return pa.RecordBatch.from_arrays([pa.array(rid[owner]), pa.array(size[owner], pa.int32()), pa.array(rank, pa.int32()), pa.array((cell >> U64(24)).view(np.int64))], names=["rid", "size", "rank", "cell"])


def cell_batches(sets: pa.RecordBatch, level: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """CELLS of a batch of SETS."""
    for at in range(0, sets.num_rows, 1024):
        few = sets.slice(at, 1024)
        h = np.frombuffer(b"".join(few.column("items").to_pylist()), U64)
        yield _cell_batch(h, few.column("size").to_numpy().astype(np.int64), few.column("rid").to_numpy(), level, threshold)


def cells_of_sets(sets: DataFrame, order: np.ndarray, threshold: float) -> DataFrame:
    """CELLS of SETS."""
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cell_batches(batch, shared.value, threshold)

    return sets.select("rid", "size", "items").mapInArrow(run, CELLS)


def cells(records: DataFrame, profiled: DataFrame, order: np.ndarray, threshold: float, width: int) -> DataFrame:
    """CELLS of ``space, key, text``: the first sequences of every distinct set, once. Records whose set
    others have too (and a few more) are reduced to one by a shuffle of their cells, the rest need none."""
    rows = profiled.filter("slot is null").select(F.xxhash64("space", "key").alias("mark"), "rid")
    many = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = sift(records.select("space", "text", F.xxhash64("space", "key").alias("mark")), "mark", rows.join(many, "rid", "left_semi").select("mark"))
    shared = records.sparkSession.sparkContext.broadcast(order)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _, size, rid in sets_of(batch.column("space").to_pylist(), batch.column("text").to_pylist(), width):
                yield _cell_batch(h, size, rid, shared.value, threshold)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for one in batches_of(batches):
            rid, size, cell = (one.column(c).to_numpy() for c in ("rid", "size", "cell"))
            heads = np.flatnonzero(one.column("rank").to_numpy() == 0)
            fresh = [i for i, (a, r) in enumerate(zip(heads, rid[heads].tolist(), strict=True)) if not (r in seen or seen.add(r))]
            blobs = [x.tobytes() for i, x in enumerate(np.split(cell, heads[1:])) if len(heads)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[heads[fresh]], pa.int64()), pa.array(size[heads[fresh]], pa.int32()), pa.array([blobs[i] for i in fresh], pa.binary())], names=["rid", "size", "cells"])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(b, np.int64) for b in batch.column("cells").to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            flat = np.concatenate([*each, np.empty(0, np.int64)])
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rid").to_numpy(), n)), pa.array(np.repeat(batch.column("size").to_numpy(), n), pa.int32()), pa.array(rank, pa.int32()), pa.array(flat)], names=["rid", "size", "rank", "cell"])

    single = marked.filter("not hit").select("space", "text").mapInArrow(batches_of, CELLS)
    copied = marked.filter("hit").select("space", "text").mapInArrow(fold, "rid long, size int, cells binary")
    return single.unionByName(copied.groupBy("rid").agg(F.first("size").alias("size"), F.first("cells").alias("cells")).mapInArrow(unfold, CELLS))


# --- pairs ------------------------------------------------------------------------------------------


def meet(a: DataFrame, b: DataFrame, threshold: float, own: bool, *keep: str) -> DataFrame:
    """``small, large``: the sets of CELLS ``a`` and ``b`` that meet often enough. With ``own`` the two are
    the same table and each pair comes once; otherwise ``small`` is of ``a``. Both have the columns
    ``keep`` too, and pairs agree in them."""
    side = lambda df, x: df.select(F.col("rid").alias(x), F.col("size").alias(f"s{x}"), F.col("rank").alias(f"r{x}"), *keep, "cell")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("sx") + F.col("sy")) - 1e-9)
    left = F.least(F.col("sx") - F.col("rx"), F.col("sy") - F.col("ry"))
    near: Column = (F.col("sx") >= threshold * F.col("sy") - 1e-9) & (F.col("sy") >= threshold * F.col("sx") - 1e-9) & (left >= need - (COMMON - 1))
    both = side(a, "x").join(side(b, "y"), ["cell", *keep]).filter(near & (F.col("x") < F.col("y")) if own else near)
    # A meeting weighs so much that the least of COMMON and ``need`` meetings weigh COMMON.
    weight = F.ceil(F.lit(COMMON) / F.least(F.lit(COMMON), need))
    seen = both.groupBy(*keep, "x", "y").agg(F.sum(weight).alias("n")).filter(F.col("n") >= COMMON)
    return seen.select(*keep, F.col("x").alias("small"), F.col("y").alias("large"))


def meetings(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The meetings of ``meet`` before they are summed up: (small, large, weight). ``a`` and ``b`` are arrays
    of cells, rids, sizes and ranks; ``a`` is sorted by cell."""
    (cell, x_rid, x_size, x_rank), (wanted, y_rid, y_size, y_rank) = a, b
    values, start, count = np.unique(cell, return_index=True, return_counts=True)
    if not len(values):
        return
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    hit = np.flatnonzero(values[at] == wanted)
    first, n = start[at[hit]], count[at[hit]]
    ends, low = np.cumsum(n), 0
    while low < len(hit):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + MEETINGS, "right")))
        few = n[low:high]
        y = np.repeat(hit[low:high], few)
        x = np.arange(len(y)) + np.repeat(first[low:high] - (np.cumsum(few) - few), few)
        low = high
        sx, sy = x_size[x].astype(np.int64), y_size[y].astype(np.int64)
        need = np.ceil(threshold / (1 + threshold) * (sx + sy) - 1e-9)
        near = (sx >= threshold * sy - 1e-9) & (sy >= threshold * sx - 1e-9) & (np.minimum(sx - x_rank[x], sy - y_rank[y]) >= need - (COMMON - 1))
        if own:
            near &= x_rid[x] < y_rid[y]
        yield x_rid[x[near]], y_rid[y[near]], np.ceil(COMMON / np.minimum(COMMON, need[near])).astype(np.int32)


def embedding(items: np.ndarray) -> np.ndarray:
    """The popcounts of the fingerprint's SEGMENTS."""
    return np.bincount((items % U64(SEGMENTS)).astype(np.int64), minlength=SEGMENTS)


class _Place:
    """The sets of a place, and its pairs against them."""

    def __init__(self, threshold: float) -> None:
        self.t, self.sets, self.counts = threshold, {}, {}

    def put(self, rids: list[int], blobs: list[bytes]) -> None:
        for rid, blob in zip(rids, blobs, strict=True):
            if rid not in self.sets:
                self.sets[rid] = np.frombuffer(blob, U64)
                self.counts[rid] = embedding(self.sets[rid])

    def compare(self, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pairs that reach the threshold, similarity); pairs sorted by ``small``."""
        keep, found = [], []
        heads = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]]))
        for a, b in zip(heads, [*heads[1:], len(small)], strict=True):
            one = self.sets[int(small[a])]
            others = [int(x) for x in large[a:b]]
            size = np.array([len(self.sets[x]) for x in others])
            apart = np.abs(np.stack([self.counts[x] for x in others]) - self.counts[int(small[a])]).sum(1)
            near = np.flatnonzero(apart <= (1 - self.t) / (1 + self.t) * (size + len(one)) + 1e-9)
            if not len(near):
                continue
            size = size[near]
            every = np.concatenate([self.sets[others[i]] for i in near])
            hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            share = both / (size + len(one) - both)
            ok = share >= self.t - 1e-12
            keep.append(a + near[ok])
            found.append(share[ok])
        return (np.concatenate(keep), np.concatenate(found)) if keep else (np.empty(0, np.int64), np.empty(0))


def verify(sets: DataFrame, pairs: DataFrame, threshold: float, sizes: DataFrame) -> DataFrame:
    """``small, large, similarity`` of the (stored) pairs that reach the threshold. ``sets``: ``rid, items``
    of all sets in a pair at least, a set possibly more than once; ``sizes``: ``rid, size`` of them, once."""
    ends = pairs.select(F.col("small").alias("rid"), F.col("large").alias("other")).unionByName(pairs.select(F.col("large").alias("rid"), F.col("small").alias("other")))
    least = ends.groupBy("rid").agg(F.least(F.min("other"), F.col("rid")).alias("group"))
    blocks = least.join(sizes, "rid").groupBy("group").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    placed = pairs.join(least.select(F.col("rid").alias("small"), "group"), "small").join(blocks, "group")
    placed = placed.select("small", "large", F.xxhash64("group", cut("small"), cut("large")).alias("place"))
    placed = materialize(placed, "placed")
    wanted = placed.select("place", F.col("small").alias("rid")).unionByName(placed.select("place", F.col("large").alias("rid"))).distinct()
    mine = wanted.join(sets, "rid").select("place", F.lit(0).alias("kind"), F.col("rid").alias("small"), F.lit(0).cast("long").alias("large"), "items")
    asked = placed.select("place", F.lit(1).alias("kind"), "small", "large", F.lit(None).cast("binary").alias("items"))
    stream = mine.unionByName(asked).repartition(partitions(pairs), "place").sortWithinPartitions("place", "kind", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, None
        for batch in batches:
            for place, rows in runs(batch, "place"):
                if place != now:
                    now, here = place, _Place(threshold)
                for kind, part in runs(rows, "kind"):
                    if kind == 0:
                        here.put(part.column("small").to_pylist(), part.column("items").to_pylist())
                        continue
                    which, share = here.compare(part.column("small").to_numpy(), part.column("large").to_numpy())
                    at = pa.array(which)
                    yield pa.RecordBatch.from_arrays([part.column("small").take(at), part.column("large").take(at), pa.array(share)], names=["small", "large", "similarity"])

    return stream.mapInArrow(run, "small long, large long, similarity double")


def links(records: DataFrame, threshold: float, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``space, key, text``. Links hold between distinct sets; records with equal sets
    share a rid. Both are stored.

    Null texts and texts of fewer words than ``width`` have no set and are in neither."""
    profiled = profile(records, width)
    order = sequence_order(profiled)
    first = cells(records, profiled, order, threshold, width)
    pairs = materialize(meet(first, first, threshold, True), "candidates")
    # One record of each set in a pair is read again.
    involved = pairs.select(F.explode(F.array("small", "large")).alias("rid")).distinct()
    who = materialize(members(profiled), "members")
    one = who.select("rid", F.xxhash64("space", "key").alias("mark")).join(involved, "rid", "left_semi").groupBy("rid").agg(F.min("mark").alias("mark"))
    again = sift(records.select("space", "text", F.xxhash64("space", "key").alias("mark")), "mark", one.select("mark")).filter("hit")
    sizes = who.groupBy("rid").agg(F.first("size").alias("size"))
    found = materialize(verify(set_rows(again, width).select("rid", "items"), pairs, threshold, sizes), "links")
    return who, found
