from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest

from tidemark.embedders import HashEmbedder
from tidemark.operators import diff, embedding, merge
from tidemark.schemas import CHUNK, DOCUMENT, EMBEDDING, conform, empty


def docs(spark, rows):
    return spark.createDataFrame([(f"id{p}", p, p, f"text {h}", h, 0, "v1") for p, h in rows], DOCUMENT)


tables = st.dictionaries(st.sampled_from("abcdef"), st.sampled_from(["h1", "h2", None]), max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tables, tables)
def test_changes_partition_both_sides(spark, now, before):
    delta = diff.detect_changes(docs(spark, now.items()), docs(spark, before.items()))
    paths = {k: sorted(r.filePath for r in getattr(delta, k).collect()) for k in ("new", "changed", "unchanged", "deleted")}
    assert sorted(paths["new"] + paths["changed"] + paths["unchanged"]) == sorted(now)
    assert paths["deleted"] == sorted(set(before) - set(now))
    assert paths["unchanged"] == sorted(p for p in now if p in before and now[p] == before[p])
    assert paths["new"] == sorted(set(now) - set(before))


def test_columns_keep_their_order_through_the_union(spark):
    delta = diff.detect_changes(docs(spark, [("a", "1"), ("b", "2")]), docs(spark, [("b", "1")]))
    row = {r.filePath: r for r in merge.docs_to_process(delta.new, delta.changed).collect()}
    assert row["a"].documentId == "ida" and row["b"].documentId == "idb"


def test_ratio_of_nothing_is_zero(spark):
    none = empty(spark, DOCUMENT)
    assert diff.dedup_ratio(diff.classify(none, none)).head()[0] == 0.0
    both = docs(spark, [(c, "1") for c in "abcde"])
    assert round(diff.dedup_ratio(diff.classify(docs(spark, [(c, "1") for c in "abcdef"]), both)).head()[0], 2) == 83.33


def test_duplicates_are_refused(spark):
    with pytest.raises(ValueError, match="filePath"):
        diff.assert_unique(docs(spark, [("a", "1"), ("a", "2")]), "filePath")


def chunk(spark, *ids):
    return conform(spark.createDataFrame([(i, i[0], 0, f"text {i}", "h", None, "v1") for i in ids], CHUNK), CHUNK)


def test_removal_of_nothing_is_identity(spark):
    rows = chunk(spark, "a1", "b1")
    assert merge.delete_chunks(rows, empty(spark, CHUNK)).count() == 2
    assert [r.chunkId for r in merge.without(rows, chunk(spark, "a9")).collect()] == ["b1"]


def test_only_missing_vectors_are_made(spark):
    have = embedding.embed_chunks(chunk(spark, "a1", "b1", "c1"), HashEmbedder(4))
    now = chunk(spark, "a1", "b1", "d1", "d1")
    kept, made = embedding.generate_embeddings(now, have, HashEmbedder(4))
    assert sorted(r.chunkId for r in kept.collect()) == ["a1", "b1"]
    assert [r.chunkId for r in made.collect()] == ["d1"]
    assert embedding.embedding_stats(now, have).head().asDict() == {"kept": 2, "removed": 1, "to_embed": 1}
    other = embedding.generate_embeddings(now, have, HashEmbedder(4, "another"), by_model=True)
    assert other[0].count() == 0 and other[1].count() == 3
    first = embedding.generate_embeddings(now, empty(spark, EMBEDDING), HashEmbedder(4))
    assert first[0].count() == 0 and first[1].count() == 3


def test_topk_in_blocks(spark):
    import numpy as np

    from tidemark.operators.topk import topk_cosine

    rng = np.random.default_rng(0)
    v = rng.normal(size=(80, 4))
    v[3] = v[4] * 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(80, [0.0] * 4), (81, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {}
    for r in topk_cosine(df.filter("id % 20 = 0"), df, "id", "v", 5, block=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.neighbour_id
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 80, 20):
        cosine = np.round(unit @ unit[i], 6)
        want = sorted((j for j in range(80) if j != i), key=lambda j: (-cosine[j], j))[:5]
        assert [got[i][n] for n in range(1, 6)] == want
