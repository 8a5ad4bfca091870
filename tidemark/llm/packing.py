"""Filling containers of fixed capacity.

Method: Martello-Toth dominance on the histogram of sizes. Sizes are whole numbers up to the
capacity, so the whole instance is a table of at most ``capacity`` counts, however many items there
are. For the largest size left, a small set that provably dominates every other way to fill its
container is fixed as often as the counts allow; what remains is filled by best fit. The plan is a
list of patterns with multiplicities, and items find their container through their rank among the
items of their size.

Defined cases: items of size 0 or null get no row; an item above the capacity is cut into full
containers and a last part; a repeated key is an item of its own (ranked after the first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._streams import partitions

PLAN = ("size", "first", "last", "container", "used", "place")


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest size up to ``most`` that is left, or 0."""
    left = np.flatnonzero(counts[: most + 1])
    return int(left[-1]) if len(left) else 0


def _best_pair(counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two sizes with the greatest sum up to the gap, or (0, 0)."""
    have = np.flatnonzero(counts[: gap + 1])
    if not len(have) or have[0] * 2 > gap:
        return 0, 0
    partner = np.searchsorted(have, gap - have, "right") - 1
    ok = partner >= 0
    a, b = have[ok], have[partner[ok]]
    twice = (a == b) & (counts[a] < 2)  # the same size needs two items; else the next smaller partner
    b = np.where(twice, np.where(partner[ok] > 0, have[partner[ok] - 1], 0), b)
    sums = np.where(b > 0, a + b, 0)
    best = int(np.argmax(sums))
    return (int(max(a[best], b[best])), int(min(a[best], b[best]))) if sums[best] else (0, 0)


def patterns(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int, bool]], int]:
    """((sizes, times, proven), ...) that use every item once, and the number of containers."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] += n
    out: list[tuple[tuple[int, ...], int, bool]] = []
    while (x := _largest(counts, capacity)) > 0:
        counts[x] -= 1
        gap = capacity - x
        y = _largest(counts, gap)
        a, b = _best_pair(counts, gap)
        if y == 0:
            fill, proven = [], True  # nothing else fits
        elif a + b <= y:
            fill, proven = [y], True  # whatever else shares this container fits in the place of y
        elif a + b == gap and _largest(counts, gap) == a:
            fill, proven = [a, b], False
        else:
            fill, proven = [], False
            while gap > 0 and (y := _largest(counts, gap)) > 0:
                a, b = (y, 0) if y == gap else _best_pair(counts, gap)
                take = [a, b] if a + b == gap and b else [y]
                for s in take:
                    fill.append(s)
                    counts[s] -= 1
                    gap -= s
            for s in fill:
                counts[s] += 1
        counts[x] += 1
        sizes, use = np.unique([x, *fill], return_counts=True)
        times = int((counts[sizes] // use).min())
        counts[sizes] -= use * times
        out.append((tuple(sorted([x, *fill], reverse=True)), times, proven))
    return out, sum(times for _, times, _ in out)


def plan_rows(found: list[tuple[tuple[int, ...], int, bool]]) -> np.ndarray:
    """Rows of PLAN, sorted by size and first rank: which ranks of a size go where."""
    rows, base, taken = [], 0, {}
    for sizes, times, _ in found:
        for size in dict.fromkeys(sizes):
            used, first = sizes.count(size), taken.get(size, 0)
            rows.append((size, first, first + used * times, base, used, sizes.index(size)))
            taken[size] = first + used * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN))


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``key, part_no, first_unit, n_units, container, place`` for each item or part of an item."""
    whole = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")).filter("n > 0")
    cut = whole.withColumn("part_no", F.explode(F.expr(f"sequence(0, cast((n - 1) div {capacity} as int))")))
    parts = cut.select("key", "part_no", F.least(F.lit(capacity), F.col("n") - F.col("part_no") * capacity).cast("int").alias("size"))
    buckets = max(64, partitions(items))
    parts = materialize(parts.withColumn("bucket", F.pmod(F.xxhash64("key", "part_no"), F.lit(buckets)).cast("int")), "parts")
    histogram = {r[0]: r[1] for r in parts.groupBy("size").count().collect()}  # at most `capacity` rows
    rows = plan_rows(patterns(histogram, capacity)[0])

    # Ranks within a size without gathering the size in one task: counts by bucket, then ranks in the bucket.
    heads = parts.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("size").orderBy("bucket")) - F.col("c")
    heads = heads.select("size", "bucket", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "part_no")) - 1
    ranked = parts.withColumn("local", local).join(heads, ["size", "bucket"]).select("key", "part_no", "size", (F.col("before") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, r = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(s), np.int64)
            for one in np.unique(s):
                lo, hi = np.searchsorted(rows[:, 0], [one, one + 1])
                mine = s == one
                at[mine] = lo + np.searchsorted(rows[lo:hi, 1], r[mine], "right") - 1
            _, first, _, container, used, slot = rows[at].T if len(at) else np.zeros((6, 0), np.int64)
            off = r - first
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part_no"), pa.array(batch.column("part_no").to_numpy() * capacity, pa.int32()), batch.column("size"), pa.array(container + off // np.maximum(used, 1)), pa.array(slot + off % np.maximum(used, 1), pa.int32())],
                names=["key", "part_no", "first_unit", "n_units", "container", "place"],
            )

    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"key {kind}, part_no int, first_unit int, n_units int, container long, place int").withColumnRenamed("key", key)
