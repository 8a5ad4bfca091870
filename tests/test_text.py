import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as fn


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).head()[0]


def test_sha256_is_deterministic_and_long(spark):
    a = one(spark, fn.sha256_hex("t"), t="Hello, World!")
    assert a == hashlib.sha256(b"Hello, World!").hexdigest() and len(a) == 64
    assert a != one(spark, fn.sha256_hex("t"), t="Hello, World")


def test_md5_length(spark):
    assert len(one(spark, fn.md5_hex("t"), t="Test content")) == 32


def test_chunk_id(spark):
    got = one(spark, fn.chunk_id("d", F.lit(0), fn.sha256_hex("t")), d="doc_123", t="This is a test chunk")
    assert got.startswith("doc_123_0_") and len(got) == len("doc_123_0_") + 8


def test_document_id_ignores_the_kind_of_slash(spark):
    a = one(spark, fn.document_id_from_path("p"), p="/path/to/document.pdf")
    assert a == one(spark, fn.document_id_from_path("p"), p="\\path\\to\\document.pdf") and len(a) == 20


@pytest.mark.parametrize(
    "text, trimmed",
    [("\t\n \x00a b\x1f ", "a b"), ("\u00a0x\u00a0", "\u00a0x\u00a0"), (" \n\t", ""), ("", "")],
)
def test_java_trim(spark, text, trimmed):
    assert one(spark, fn.java_trim("t"), t=text) == trimmed


@pytest.mark.parametrize("text, cleaned", [("a\x0b\x0c b", "a b"), ("a\x01b\x7f", "ab"), ("  ", ""), ("\u00a0a\u00a0 b ", "\u00a0a\u00a0 b")])
def test_clean_text(spark, text, cleaned):
    assert one(spark, fn.clean_text("t"), t=text) == cleaned


def test_clean_text_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(fn.clean_text("t")).head()[0] == ""


def test_file_names(spark):
    name = fn.file_name_of("p")
    assert one(spark, name, p="file:/a/b c.pdf") == "b c.pdf"
    assert one(spark, fn.document_id_of_file(name), p="/a/x.pdf") == "x"
    assert one(spark, fn.document_id_of_file(name), p="/a/x.PDF") == "x.PDF"


def test_embedding_ids(spark):
    assert one(spark, fn.embedding_id_by_model("c", "m"), c="k", m="mx-large:v1") == "k_mx_large_v1"
    df = spark.createDataFrame([("k", [1.0, 2.5])], "c string, v array<double>")
    want = "k_" + hashlib.md5(b"1.0,2.5").hexdigest()[:8]
    assert df.select(fn.embedding_id_by_vector("c", fn.vector_hash("v"))).head()[0] == want
