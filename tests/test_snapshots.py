import pytest

from tidemark.operators.snapshots import canonical_path, snapshot_changes

SCHEMA = "snapshotNo int, filePath string, contentHash string, processedAt bigint, documentId string"


def changes(spark, rows, delivered=None):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    log = None if delivered is None else spark.createDataFrame([(n,) for n in delivered], "snapshotNo int")
    return sorted(tuple(r) for r in snapshot_changes(df, log).collect())


@pytest.mark.parametrize(
    "raw",
    ["/corpus/a b/é.pdf", "file:///corpus/a%20b/%C3%A9.pdf", "file:/corpus/a b/é.pdf", "\\corpus\\a b\\é.pdf", "/corpus//a%20b/é.pdf", "s3a://bucket/corpus/a b/é.pdf"],
)
def test_spellings_of_a_path(spark, raw):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(canonical_path("p")).head()[0] == "/corpus/a b/é.pdf"


def test_plus_and_stray_percent_stay(spark):
    df = spark.createDataFrame([("file:/corpus/a+b 5% x%20y.pdf",)], "p string")
    assert df.select(canonical_path("p")).head()[0] == "/corpus/a+b 5% x y.pdf"


def test_added_removed_changed_and_back(spark):
    rows = [(1, "/a", "H1", 1), (1, "/b", "h1", 1), (3, "/a", "h1", 1), (3, "/c", "h1", 1), (4, "/a", "h2", 1), (4, "/b", "h1", 1), (4, "/c", "h1", 1)]
    hexed = [(n, p, h.replace("h", "aa").replace("H", "AA") + "0", t) for n, p, h, t in rows]
    assert changes(spark, hexed) == [(3, "/b", "removed"), (3, "/c", "added"), (4, "/a", "changed"), (4, "/b", "added")]


def test_the_latest_row_of_a_path_counts(spark):
    rows = [(1, "/a", "aa", 1), (2, "/a", "bb", 5), (2, "file:/a", "AA", 9), (2, "/a", "bb", None)]
    assert changes(spark, rows) == []


def test_null_hash_keeps_what_was_known(spark):
    rows = [(1, "/a", None, 1), (2, "/a", "aa", 1), (3, "/a", None, 1), (4, "/a", "bb", 1), (1, "/z", "aa", 1), (2, "/z", "aa", 1), (3, "/z", "aa", 1), (4, "/z", "aa", 1)]
    assert changes(spark, rows) == [(4, "/a", "changed")]
    again = [(1, "/a", "aa", 1), (1, "/z", "aa", 1), (2, "/z", "aa", 1), (3, "/a", None, 1), (3, "/z", "aa", 1), (4, "/a", "bb", 1), (4, "/z", "aa", 1)]
    assert changes(spark, again) == [(2, "/a", "removed"), (3, "/a", "added")]


def test_empty_snapshot_and_empty_table(spark):
    assert changes(spark, [(1, "/a", "aa", 1), (3, "/a", "aa", 1)], [1, 2, 3]) == [(2, "/a", "removed"), (3, "/a", "added")]
    assert changes(spark, []) == []
    assert changes(spark, [(1, None, "aa", 1), (2, None, "bb", 1)]) == []
