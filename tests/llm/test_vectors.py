import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import vectors
from tidemark.queries import table

SCHEMA = "model string, id string, v array<double>"


def brute(rows, k, least, d):
    spaces = {}
    for m, i, v in rows:
        if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v):
            spaces.setdefault(m, {})[i] = np.array(v)
    out = {}
    for m, found in spaces.items():
        keys = sorted(found)
        unit = np.stack([found[i] / np.linalg.norm(found[i]) for i in keys])
        cosine = np.round(unit @ unit.T, 6)
        for n, i in enumerate(keys):
            near = sorted((-c, keys[j]) for j, c in enumerate(cosine[n]) if j != n and c >= least)[:k]
            out[(m, i)] = [j for _, j in near]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("clash")).withColumn("space", F.lit(1))
    found = vectors.neighbours(df, "id", "v", "model", dimension=8, parts=4, **kw).orderBy("space", "key", "rank").collect()
    out = {}
    for r in found:
        out.setdefault((r.space, r.key), []).append(r.neighbour)
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8))
    rows = [("m" if i % 5 else "n", f"c{i:04}", (centres[i % 30] + 0.1 * rng.normal(size=8)).tolist()) for i in range(1500)]
    want = {key: near for key, near in brute(rows, 5, 0.8, 8).items() if near}
    got = run(spark, rows, k=5, least=0.8, per_list=64, block=200)
    hit = sum(len(set(near) & set(got.get(key, []))) for key, near in want.items())
    assert hit / sum(map(len, want.values())) >= 0.97


def test_defined_cases(spark):
    e = lambda *x: list(map(float, x)) + [0.0] * (8 - len(x))
    rows = [("m", f"s{i}", e(1, 1)) for i in range(9)]
    rows += [("m", "long", e(200, 200)), ("m", "near", e(1, 0.9)), ("m", "far", e(0, 0, 1)), ("m", "null", None), ("m", "short", [1.0]), ("m", "empty", []), ("m", "zero", e(0)), ("m", "nan", e(float("nan"))), ("m", "hole", [None] * 8), ("m", "near", e(1, 0.9)), ("o", "s0b", e(1, 1))]
    rows = [r for r in rows if r[1] != "hole"] + [("m", "hole", [None] * 8)]
    want = {key: near for key, near in brute(rows, 5, 0.5, 8).items() if near}
    assert run(spark, rows, k=5, least=0.5) == want
    assert run(spark, [], k=5) == {}


def test_lists_grow_with_the_square_root():
    rng = np.random.default_rng(3)
    lists = lambda rows: len(vectors.Index(rng.normal(size=(900, 8)), rows, 16, 4).centroids)
    assert [lists(n) for n in (10, 160, 256, 2500, 250_000)] == [1, 10, 16, 50, 500]


def test_recall_on_the_tables(spark):
    df = table(spark, SMALL, "chunk_vectors")
    rows = [(r.embeddingModel, r.chunkId, r.embeddingVector) for r in df.collect()]
    want = brute(rows, 5, 0.84, 64)
    got = {}
    for r in vectors.neighbours(df, "chunkId", "embeddingVector", "embeddingModel", least=0.84).collect():
        got.setdefault((r.space, r.key), set()).add(r.neighbour)
    hit = sum(len(set(near) & got.get(key, set())) for key, near in want.items())
    assert hit / sum(map(len, want.values())) >= 0.98
