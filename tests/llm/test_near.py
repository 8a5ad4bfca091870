import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _kernels as k
from tidemark.llm import duplicates, history, near

SCHEMA = "space string, key string, text string"


def words(text):
    out, now = [], []
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            now.append(c)
        elif now:
            out.append("".join(now).lower())
            now = []
    return out


def grams(text, width):
    w = words(text or "")
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(rows, threshold, width):
    sets = {(s, key): grams(t, width) for s, key, t in rows}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and jaccard(sets[a], sets[b]) >= threshold}


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(rng.randint(5, 80))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append(("s", f"k{i:03}", t))
        for j in range(rng.randrange(4)):
            w = t.split()
            for _ in range(rng.randrange(len(w) // 6 + 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [str(rng.randrange(9))] if rng.random() < 0.5 else []
                w = w or ["x"]
            if rng.random() < 0.4:
                h = len(w) // 2
                w = w[h:] + w[:h]
            rows.append(("s", f"k{i:03}e{j}", " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, threshold, width", [(1, 0.6, 3), (2, 0.8, 5), (3, 0.6, 3)])
def test_pairs_equal_brute_force(spark, seed, threshold, width):
    rows = corpus(seed, 60) + [("t", "k000", "a1 b2 c3 d4 e5 f6"), ("t", "other", "A1, b2 c3; d4 e5 F6!")]
    got = {(r.space, r.key_a, r.key_b) for r in duplicates.pairs(spark.createDataFrame(rows, SCHEMA), threshold, width).collect()}
    assert got == brute(rows, threshold, width)


def test_defined_cases(spark):
    rows = [("s", "null", None), ("s", "empty", ""), ("s", "short", "two words"), ("s", "a", "one two three four"), ("s", "a", "one two three four"), ("s", "b", "One  TWO-three four")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit(1)).withColumn("probe_x", F.lit(2)).withColumn("slot", F.lit(3))
    got = duplicates.pairs(df, 0.6, 3).collect()
    assert [(r.key_a, r.key_b, r.similarity) for r in got] == [("a", "b", 1.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert duplicates.pairs(empty, 0.6, 3).count() == 0 and duplicates.groups(empty, 0.6, 3).count() == 0


def test_very_long_text_and_many_copies(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(70_000))
    rows = [("s", "x", long), ("s", "y", long + " and more")] + [("s", f"c{i:03}", "the same short text again") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {r.key: (r.group_id, r.n_links) for r in duplicates.groups(df, 0.8, 3).collect()}
    assert groups["x"][0] == groups["y"][0] and groups["x"][1] == 1
    assert len({groups[f"c{i:03}"] for i in range(60)}) == 1 and groups["c000"][1] == 59


def test_groups_are_the_components(spark):
    rows = corpus(5, 40)
    got = {r.key: r.group_id for r in duplicates.groups(spark.createDataFrame(rows, SCHEMA), 0.6, 3).collect()}
    parent = {key: key for _, key, t in rows if grams(t, 3)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in brute(rows, 0.6, 3):
        parent[root(a)] = root(b)
    assert set(got) == set(parent)
    for a in parent:
        for b in parent:
            assert (got[a] == got[b]) == (root(a) == root(b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.rid: r.label for r in duplicates.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_words_are_letters_and_numbers():
    texts = ["Don't stop—ÉTÉ 3½ x_y", "กาแฟ ไทย", "", "ΣΟΦΟΣ"]
    _, owner, start = k.words(texts)
    for i, t in enumerate(texts):
        assert [w[:1] for w in words(t)] == [k.lowered(t)[s] for s in start[owner == i]]
    assert len(k.words(["A b A"])[0]) == 3 and len(np.unique(k.words(["A b a"])[0])) == 2


def judge(history_rows, arrivals, vectors, threshold=0.6, width=3):
    """The rule, arrival by arrival."""
    hashes, texts, sets, out = set(), set(), [], set()

    def accept(h, t):
        hashes.add(h.lower()) if h else None
        texts.add(t) if t is not None else None
        sets.append(grams(t, width))

    for _, h, t in history_rows:
        accept(h, t)
    for batch, number, chunk, h, t in sorted(arrivals):
        mine = grams(t, width)
        if chunk in vectors or (h and h.lower() in hashes) or (t is not None and t in texts) or any(jaccard(mine, s) >= threshold for s in sets):
            out.add(number)
        else:
            accept(h, t)
    return out


ARRIVALS = "batchNo int, arrivalNo bigint, chunkId string, chunkHash string, chunkText string"
CHUNKS = "chunkId string, chunkHash string, chunkText string"


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [t for _, _, t in corpus(seed + 10, 50)]
    rng.shuffle(rows)
    old = [(f"c{i}", f"H{i}", t) for i, t in enumerate(rows[:40])] + [("c0", "H0", rows[0]), ("n", None, None)]
    new = [(1 + i // 15, i, f"a{i}", f"h{rng.randrange(400)}" if rng.random() < 0.9 else None, t) for i, t in enumerate(rows[40:])]
    n = len(new)
    new += [(2, n, "c3", "zz", "nothing like it at all"), (3, n + 1, "a", None, None), (3, n + 2, "b", "ZZ", "two words"), (4, n + 3, "d", "yy", "two words"), (4, n + 4, "vec", None, "some text of its own")]
    vectors = spark.createDataFrame([("c3",), ("vec",), ("vec",), (None,)], "chunkId string")
    a, h = spark.createDataFrame(new, ARRIVALS).withColumn("ord", F.lit(0)).withColumn("rid", F.lit("x")), spark.createDataFrame(old, CHUNKS)
    got = {r[0] for r in history.already_known(a, h, vectors, str(tmp_path / "index")).collect()}
    assert got == judge(old, new, {"c3", "vec"})


def test_chain_of_edits_is_judged_in_order(spark, tmp_path):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base[: 30 - 4 * i] + [f"x{i}{j}" for j in range(4 * i)]) for i in range(6)]
    new = [(1, i, f"a{i}", f"h{i}", t) for i, t in enumerate(texts)] + [(2, 10 + i, f"b{i}", f"g{i}", texts[0]) for i in range(20)]
    none = spark.createDataFrame([], CHUNKS)
    got = {r[0] for r in history.already_known(spark.createDataFrame(new, ARRIVALS), none, none, str(tmp_path / "index")).collect()}
    assert got == judge([], new, set()) and len(got) > 20


def test_empty_batch(spark, tmp_path):
    h = spark.createDataFrame([("c", "h", "one two three four")], CHUNKS)
    assert history.already_known(spark.createDataFrame([], ARRIVALS), h, h, str(tmp_path / "index")).count() == 0


def test_a_second_batch_reads_no_text_and_no_other_bucket(spark, tmp_path):
    text = "one two three four five six seven eight"
    first = spark.createDataFrame([("a", "h1", text), ("b", "h2", "quite another text of some length stands here")], "k string, h string, t string")
    path = str(tmp_path / "index")
    history.SegmentIndex.create(first, "t", "h", path, 0.6, 3, buckets=50)
    index = history.SegmentIndex.open(spark, path)  # nothing but the stored index
    assert (index.buckets, index.threshold, index.width) == (50, 0.6, 3)
    none = spark.createDataFrame([], "k string")

    def ready(n, *r):
        rows = spark.createDataFrame([(n, i, f"x{i}", f"g{i}", t) for i, t in r], "b int, n long, k string, h string, t string")
        return index.prepare(rows, none, "n", "b", "k", "h", "t")

    judge = lambda n, *r: {x[0] for x in index.judge(ready(n, *r), n).collect()}
    assert judge(1, (1, text + " nine"), (2, "something else is written here today"), (3, None)) == {1}
    assert judge(2, (4, "something else is written here today again"), (5, "all new words stand in this one")) == {4}
    segments = ready(3, (6, "all new words stand in this one")).segments
    asked = {r[0] for r in segments.select("bucket").distinct().collect()}
    pruned = index._load("segments", segments)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(asked) < 20 and {r[0] for r in pruned.select("bucket").distinct().collect()} <= asked
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    size = lambda: index._load("segments").agg(F.sum(F.octet_length("cells"))).head()[0]
    before = size()
    index.rebuild()
    assert size() == before and judge(4, (7, "all new words stand in this one too")) == {7}


def test_no_pair_within_the_bound_is_lost(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for i, (n_both, n_own) in enumerate(((3, 1), (12, 4), (120, 40), (600, 200))):  # exactly 0.6
        both, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (n_both, n_own, n_own))
        for j, own in enumerate((a, b)):
            h = np.sort(np.array(both + own, np.uint64))
            rows.append((2 * i + j, len(h), h.tobytes()))
        want.add((2 * i, 2 * i + 1))
    x = np.array([rng.getrandbits(64) for _ in range(160)], np.uint64)
    rows += [(20, 160, np.sort(x).tobytes()), (21, 160, np.sort(np.concatenate([x[:119], x[:41] + np.uint64(1)])).tobytes())]  # just below
    sets = spark.createDataFrame([(r, n, bytearray(b)) for r, n, b in rows], near.SETS)
    for order in (np.zeros(1 << near.ORDER_BITS, np.uint8), np.random.default_rng(0).integers(0, 255, 1 << near.ORDER_BITS).astype(np.uint8)):
        cells = near.cells_of_sets(sets, order, 0.6)
        pairs = near.materialize(near.meet(cells, cells, 0.6, True), "pairs")
        assert {(r.small, r.large) for r in near.verify(sets, pairs, 0.6, sets).collect()} == want


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (rng.integers(0, 400, 150).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in "ab")
        x, y = np.unique(x), np.unique(y)
        assert np.abs(near.embedding(x) - near.embedding(y)).sum() <= len(np.setxor1d(x, y))


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 100)
    rng = random.Random(4)
    core = " ".join(f"w{i}" for i in range(60))
    rows = [("s", f"k{i:02}", f"{core} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    got = {(r.space, r.key_a, r.key_b) for r in duplicates.pairs(spark.createDataFrame(rows, SCHEMA), 0.8, 3).collect()}
    assert got == brute(rows, 0.8, 3) and len(got) > 300
    groups = duplicates.groups(spark.createDataFrame(rows, SCHEMA), 0.8, 3).collect()
    assert sum(r.n_links for r in groups) == 2 * len(got)


def test_counts_are_added_in_levels(spark, monkeypatch):
    rows = [("s", f"k{i}", f"a b c d{i}") for i in range(40)]
    profiled = near.profile(spark.createDataFrame(rows, SCHEMA).repartition(10), 3)
    flat = near.sequence_order(profiled)
    monkeypatch.setattr(near, "FAN", 2)
    assert (near.sequence_order(profiled) == flat).all()
    assert sorted(flat[flat > 0])[-1] == round(8 * np.log2(41)) and (flat > 0).sum() == 41


def test_meetings_of_arrays_are_those_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(near, "MEETINGS", 50)  # in many slices, some of one segment
    rng = np.random.default_rng(3)
    size = {r: int(rng.integers(1, 30)) for r in range(60)}
    rows = [(r, size[r], i, int(c)) for r in size for i, c in enumerate(rng.choice(40, min(size[r], 12), replace=False))]
    new, old = [x for x in rows if x[0] < 20], [x for x in rows if x[0] >= 10]

    def arrays(part):
        rid, n, rank, cell = (np.array(c, np.int64) for c in zip(*sorted(part, key=lambda x: x[3]), strict=True))
        return cell, rid, n, rank

    for own, a, b in ((False, new, old), (True, rows, rows)):
        seen = {}
        for small, large, n in near.meetings(arrays(a), arrays(b), 0.6, own):
            for x, y, w in zip(small.tolist(), large.tolist(), n.tolist(), strict=True):
                seen[x, y] = seen.get((x, y), 0) + w
        want = near.meet(*(spark.createDataFrame(x, near.CELLS) for x in (a, b)), 0.6, own).collect()
        assert want and {p for p, n in seen.items() if n >= near.COMMON} == {(r.small, r.large) for r in want}


def test_a_long_chain_takes_no_further_jobs(spark, monkeypatch):
    values = spark.createDataFrame([(i, v) for i in range(9) for v in (f"v{i}", f"v{i + 1}")] + [(20, "e"), (21, "f")], "number long, v string")
    edges = spark.createDataFrame([("e", "f"), ("f", "e")], "v string, w string")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        assert {r[0] for r in history._refuse(values, edges).collect()} == {1, 3, 5, 7, 21}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(history, "ALONE", 0)
    assert {r[0] for r in history._refuse(values, edges).collect()} == {1, 3, 5, 7, 21}
