"""Most similar vectors for every vector.

Method: an inverted file of coarse centroids with product-quantised residuals. Centroids and code
books are fitted on a bounded sample; every row is indexed under its nearest centroid. A query visits
the ``probes`` nearest lists, scores them asymmetrically (its own numbers against the quantised ones),
and the best ``rerank`` of a list are compared exactly. No distance tables are kept: the sum of a table's
entries is taken as one matrix product with the decoded codes, and vectors travel whole to every list.

Equal vectors are one class and are searched once; the answer for a class is its first k + 1 keys,
so a vector that a third of all rows share costs one query and a join spread over salts. Lists longer
than ``block`` rows are cut into blocks, each visited by the list's queries.

Defined cases: vectors that are null, of another length, with null, NaN or infinite entries or all
zero are not usable and give no rows; repeated rows of a key count once; ties go to the smaller key;
fewer than k neighbours at the least cosine give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._streams import partitions, runs

SALTS = 16


def usable(vectors: DataFrame, key: str, vector: str, space: str, dimension: int) -> DataFrame:
    """``space, key, vector``, one row per key."""
    v = F.col(vector)
    fine = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(key).isNotNull() & v.isNotNull()).filter(fine)
    return rows.groupBy(F.col(space).alias("space"), F.col(key).alias("key")).agg(F.first(v.cast("array<double>")).alias("vector"))


def _kmeans(x: np.ndarray, n: int, spherical: bool, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (0 if spherical else (c**2).sum(1) / 2), 1)
        order = np.argsort(near, kind="stable")
        heads, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], starts)
        c[heads] = sums / np.diff([*starts, len(x)])[:, None]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        gone = np.setdiff1d(np.arange(len(c)), heads)
        if len(gone):
            c[gone] = x[rng.integers(0, len(x), len(gone))]
    return c


class Index:
    """Centroids (lists, d) and code books (parts, 256, d / parts) of one space."""

    def __init__(self, sample: np.ndarray, rows: int, per_list: int, parts: int) -> None:
        unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
        self.parts = parts
        # lists of per_list rows; beyond per_list of them, as many as the square root of the rows
        self.centroids = _kmeans(unit, int(min(max(1, min(rows // per_list, max(rows**0.5, per_list))), len(unit))), True)
        rest = unit - self.centroids[np.argmax(unit @ self.centroids.T, 1)]
        cut = rest.reshape(len(unit), parts, -1)
        self.books = np.stack([_kmeans(cut[:, i], min(256, len(unit)), False) for i in range(parts)])

    def code(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        cut = (unit - self.centroids[lists]).reshape(len(unit), self.parts, -1)
        codes = np.empty((len(unit), self.parts), np.uint8)
        for i, book in enumerate(self.books):
            codes[:, i] = np.argmax(cut[:, i] @ book.T - (book**2).sum(1) / 2, 1)
        return codes

    def decode(self, number: int, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([self.books[i][codes[:, i]] for i in range(self.parts)], 1)
        return self.centroids[number] + rest


def _pack(v: np.ndarray) -> bytes:
    small = v.astype(np.float32)
    return small.tobytes() if (small == v).all() else v.tobytes()


def _unpack(blobs: list[bytes], dimension: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dimension else np.float64).astype(np.float64) for b in blobs])


def neighbours(
    vectors: DataFrame, key: str, vector: str, space: str, k: int = 5, least: float = -1.0, dimension: int = 64,
    probes: int = 12, rerank: int = 128, sample_rows: int = 20_000, per_list: int = 256, parts: int = 32, block: int = 4096,
) -> DataFrame:
    """``space, key, neighbour, cosine, rank``; the cosine is rounded to 6 decimals. There are at most
    ``sample_rows`` lists: beyond the square of that in rows, fit on a larger sample."""
    if dimension % parts:
        raise ValueError("parts must divide the dimension")
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, space, dimension).withColumn("cls", F.xxhash64("space", "vector"))
    rows = materialize(rows, "vectors")
    # The first k + 1 keys of each class, in two steps so that no task ranks a whole class.
    salted = rows.select("space", "cls", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    local = Window.partitionBy("space", "cls", "salt").orderBy("key")
    few = salted.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= k + 1)
    whole = Window.partitionBy("space", "cls").orderBy("key")
    heads = few.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1)
    heads = heads.groupBy("space", "cls").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    classes = rows.groupBy("space", "cls").agg(F.first("vector").alias("vector"), F.min("key").alias("least_key"))
    classes = materialize(classes, "classes")

    counts = {r[0]: r[1] for r in classes.groupBy("space").count().collect()}  # one row per model
    trained = {}
    for name, n in counts.items():
        mine = classes.filter(F.col("space").eqNullSafe(F.lit(name)))
        # A bounded sample to fit on, spread by hash; every row is indexed below.
        part = mine.filter(F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / n) + 1)).select("vector").limit(sample_rows)
        found = np.array([r[0] for r in part.collect()] or [r[0] for r in mine.select("vector").limit(1000).collect()])
        trained[name] = Index(found, n, per_list, parts)
    shared = spark.sparkContext.broadcast(trained)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                few = batch.slice(at, 2048)
                names = np.array(few.column("space").to_pylist(), object)
                v = few.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
                lists, codes = np.full((len(v), probes), -1, np.int32), [b""] * len(v)
                for name in set(names):
                    index, mine = shared.value[name], np.flatnonzero(names == name)
                    score = unit[mine] @ index.centroids.T
                    take = min(probes, score.shape[1])
                    near = np.argpartition(-score, take - 1, 1)[:, :take]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), 1, kind="stable"), 1)
                    lists[mine, :take] = near
                    coded = index.code(unit[mine], near[:, 0])
                    for i, c in zip(mine, coded, strict=True):
                        codes[i] = c.tobytes()
                ends = np.arange(0, (len(v) + 1) * probes, probes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [few.column("space"), few.column("cls"), few.column("least_key"), pa.array([_pack(x) for x in v], pa.binary()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel()))],
                    names=["space", "cls", "least_key", "packed", "codes", "lists"],
                )

    key_kind, space_kind = (rows.schema[c].dataType.simpleString() for c in ("key", "space"))
    assigned = materialize(classes.mapInArrow(assign, f"space {space_kind}, cls long, least_key {key_kind}, packed binary, codes binary, lists array<int>"), "assigned")
    home = assigned.withColumn("list", F.col("lists")[0])
    sizes = home.groupBy("space", "list").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).select("space", "list", "blocks")
    sizes = F.broadcast(sizes)  # sample_rows rows per model at most
    base = home.join(sizes, ["space", "list"]).select("space", "list", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("part"), F.lit(0).alias("kind"), "cls", "least_key", "packed", "codes")
    visits = assigned.select("space", "cls", "packed", F.explode("lists").alias("list")).filter("list >= 0").join(sizes, ["space", "list"])
    visits = visits.select("space", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("kind"), "cls", F.lit(None).cast(key_kind).alias("least_key"), "packed", F.lit(None).cast("binary").alias("codes"))
    stream = base.unionByName(visits).withColumn("place", F.xxhash64("space", "list", "part"))
    stream = stream.repartition(partitions(vectors), "place").sortWithinPartitions("place", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            for place, group in runs(batch, "place"):
                if place != now:
                    now, held, ready = place, [], None
                for kind, part in runs(group, "kind"):
                    if kind == 0:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if ready is None:
                        name, number = held[0].column("space")[0].as_py(), held[0].column("list")[0].as_py()
                        index = shared.value[name]
                        exact = _unpack([b for h in held for b in h.column("packed").to_pylist()], dimension)
                        codes = np.stack([np.frombuffer(b, np.uint8) for h in held for b in h.column("codes").to_pylist()])
                        cls = np.concatenate([h.column("cls").to_numpy() for h in held])
                        keys = [x for h in held for x in h.column("least_key").to_pylist()]
                        ready = (name, index.decode(number, codes).astype(np.float32), exact / np.linalg.norm(exact, axis=1, keepdims=True), cls, keys)
                    name, coarse, exact, cls, keys = ready
                    for at in range(0, part.num_rows, 512):
                        few = part.slice(at, 512)
                        q = _unpack(few.column("packed").to_pylist(), dimension)
                        q /= np.linalg.norm(q, axis=1, keepdims=True)
                        mine = few.column("cls").to_numpy()
                        score = q.astype(np.float32) @ coarse.T
                        take = min(rerank, score.shape[1])
                        top = np.argpartition(-score, take - 1, 1)[:, :take]
                        cosine = np.round(np.einsum("qd,qtd->qt", q, exact[top]), 6)
                        row, col = np.nonzero((cosine >= least) & (cls[top] != mine[:, None]))
                        near = top[row, col]
                        value = cosine[row, col]
                        order = sorted(range(len(row)), key=lambda i: (row[i], -value[i], keys[near[i]]))
                        kept, last, n = [], -1, 0
                        for i in order:
                            n = n + 1 if row[i] == last else 1
                            last = row[i]
                            if n <= k:
                                kept.append(i)
                        if kept:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([name] * len(kept)), pa.array(mine[row[kept]]), pa.array(cls[near[kept]]), pa.array(value[kept])], names=["space", "cls", "other", "cosine"]
                            )

    found = stream.mapInArrow(search, f"space {space_kind}, cls long, other long, cosine double")
    # The keys of the classes found, and the class's own keys at cosine 1; k + 1 of them are enough.
    near = found.join(heads.withColumnRenamed("cls", "other"), ["space", "other"]).select("space", "cls", "cosine", F.explode("keys").alias("neighbour"))
    own = heads.select("space", "cls", F.lit(1.0).alias("cosine"), F.explode("keys").alias("neighbour"))
    best = Window.partitionBy("space", "cls").orderBy(F.desc("cosine"), "neighbour")
    ranked = near.unionByName(own).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    answer = ranked.groupBy("space", "cls").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "cosine"))).alias("found"))
    answer = answer.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rows.select("space", "cls", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    each = asked.join(answer, ["space", "cls", "salt"]).select("space", "key", F.slice(F.filter("found", lambda x: x["neighbour"] != F.col("key")), 1, k).alias("found"))
    return each.select("space", "key", F.posexplode("found").alias("at", "n")).select("space", "key", F.col("n.neighbour").alias("neighbour"), F.col("n.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``chunk_a, chunk_b``: each unordered pair once."""
    return found.select(F.least("key", "neighbour").alias("chunk_a"), F.greatest("key", "neighbour").alias("chunk_b")).distinct()
