import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spans

SCHEMA = "space string, key string, text string"


def brute(rows, length):
    texts = {(s, k): t for s, k, t in rows if t}
    where = {}
    for (s, k), t in texts.items():
        for i in range(len(t) - length + 1):
            where.setdefault((s, t[i : i + length]), set()).add(k)
    out = set()
    for (s, k), t in texts.items():
        mark = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if len(where[(s, t[i : i + length])]) > 1:
                mark[i : i + length] = b"\1" * length
        i = 0
        while i < len(t):
            j = i
            while mark[j]:
                j += 1
            if j > i:
                out.add((s, k, i, j))
            i = j + 1
    return out


def found(spark, rows, length, mer):
    return {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, SCHEMA), length, mer).collect()}


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefghijklmnop😀é"), (3, "ab"), (4, "abcdefgh")])
def test_spans_equal_brute_force(spark, seed, letters):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randint(15, 90)) for _ in range(8)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(10, 80)], text(rng.randint(0, 30))]
        rows.append((rng.choice("st"), f"k{i}", "".join(parts)))
    length, mer = (20, 8) if letters != "ab" else (24, 12)
    assert found(spark, rows, length, mer) == brute(rows, length)


def test_copies_periods_and_defined_cases(spark):
    same = "the very same text in several records"
    rows = [("s", "a", same), ("s", "b", same), ("s", "b", same), ("s", "p", "xy" * 40), ("s", "q", "z" + "xy" * 30), ("s", "n", None), ("s", "e", ""), ("s", "short", "abc"), ("s", "own", "repeat me once repeat me once "), ("t", "c", same)]
    assert found(spark, rows, 12, 6) == brute(rows, 12)
    assert found(spark, [], 12, 6) == set()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert spans.shared_spans(df, 12, 6).count() == len(brute(rows, 12))


def test_long_periodic_texts(spark):
    rows = [("s", "x", "ab" * 20_000), ("s", "y", "ab" * 3_000 + "c"), ("s", "z", "ba" * 40), ("s", "w", "a" * 30_000), ("s", "v", "a" * 200)]
    assert found(spark, rows, 60, 30) == {("s", "x", 0, 40_000), ("s", "y", 0, 6_000), ("s", "z", 0, 80), ("s", "w", 0, 30_000), ("s", "v", 0, 200)}


def test_long_texts_are_worked_on_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(spans, "STRETCH", 50)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [text(120) for _ in range(4)]
    rows = [("s", f"k{i}", text(70) + rng.choice(passages)[rng.randrange(30) :] + text(rng.randrange(200)) + rng.choice(passages)) for i in range(12)]
    assert found(spark, rows, 20, 8) == brute(rows, 20)


def test_places_beyond_two_to_the_24(spark):
    rng = random.Random(5)
    unit = "".join(rng.choice("abcdefghij") for _ in range(250))
    long = "".join(f"{i:07x} " for i in range(2_100_000))  # 16.8 million code points without a repetition
    rows = [("s", "x", long + unit), ("s", "y", "start " + unit)]
    assert {(k, b - a) for _, k, a, b in found(spark, rows, 200, 100)} == {("x", 251), ("y", 251)}


def test_passage_in_many_records(spark):
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdefghij") for _ in range(60))
    rows = [("s", f"k{i}", "".join(rng.choice("klmnop") for _ in range(20)) + hot + "".join(rng.choice("qrstuv") for _ in range(20))) for i in range(120)]
    assert found(spark, rows, 30, 15) == brute(rows, 30)


def test_passages_are_fuzzy_around_exact_runs(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghijkl") for _ in range(300))
    b = "zzz" + a[:120] + "#" + a[121:]
    _, found_passages = spans.passages(spark.createDataFrame([("s", "a", a), ("s", "b", b)], SCHEMA), 40, 20)
    row = found_passages.collect()
    assert len(row) == 1 and row[0].identity > 0.95
    assert sorted(r["n"] for r in row[0].runs) == [120, 179]


def test_chains_hold_every_match_in_order():
    rng = random.Random(3)
    a, b = [rng.randrange(200) for _ in range(60)], [rng.randrange(200) for _ in range(60)]
    chains = spans.chain(a, b, 20.0, 0.25, 60)
    assert sorted(i for c in chains for i in c) == list(range(60))
    for c in chains:
        assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(c, c[1:]))
    straight = spans.chain([0, 10, 20, 30], [5, 15, 25, 35], 20.0, 0.25, 60)
    assert straight == [[0, 1, 2, 3]]


def test_amount(spark):
    rows = [("s", "a", "0123456789" + "x"), ("s", "b", "0123456789" + "y"), ("s", "n", None)]
    got = {r.key: (r.n_chars, r.n_shared, round(r.share, 3)) for r in spans.shared_amount(spark.createDataFrame(rows, SCHEMA), 8, 4).collect()}
    assert got == {"a": (11, 10, 0.909), "b": (11, 10, 0.909), "n": (0, 0, 0.0)}
