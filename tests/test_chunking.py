import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.text import TRIMMED
from tidemark.operators import chunking


def walk(text, size, overlap):
    """The chunk loop written out step by step."""
    if not text or size <= 0 or overlap < 0 or overlap >= size:
        return []
    t, step, out, at = text.strip(TRIMMED), size - overlap, [], 0
    while at < len(t):
        end = min(at + size, len(t))
        piece = t[at:end].strip(TRIMMED)
        if piece:
            out.append(piece)
        reached = end == len(t)
        last_piece, at = piece, at + step
        if at < len(t) and at + step >= len(t) and not reached:
            tail = t[at:].strip(TRIMMED)
            if tail and tail != last_piece:
                out.append(tail)
            break
    return out


@pytest.mark.parametrize(
    "text, size, overlap, lengths",
    [
        ("A" * 250, 100, 20, [100, 100, 90, 10]),
        ("A" * 200, 100, 0, [100]),
        ("A" * 150, 50, 10, [50, 50, 50, 30]),
        ("x" * 900, 1000, 100, [900]),
        ("x" * 901, 1000, 100, [901, 1]),
        ("x" * 1000, 1000, 100, [1000, 100]),
        ("x" * 2000, 1000, 100, [1000, 1000, 200]),
        ("Short text", 100, 10, [10]),
        ("", 100, 10, []),
        ("Test text", 0, 5, []),
        ("Test text", -10, 5, []),
        ("Test text", 100, -5, []),
        (" \n\t\x00", 10, 1, []),
    ],
)
def test_lengths(spark, text, size, overlap, lengths):
    assert [len(c) for c in chunking.chunk_text(text, size, overlap)] == lengths
    df = spark.createDataFrame([("d", text)], "documentId string, content string")
    rows = chunking.chunk_documents(df, size, overlap).orderBy("chunkIndex").collect()
    assert [len(r.chunkText) for r in rows] == lengths
    assert [r.chunkIndex for r in rows] == list(range(len(lengths)))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aab \n\x00.é"), max_size=60), st.integers(1, 15), st.integers(0, 14))
def test_closed_form_equals_the_loop(text, size, overlap):
    got = chunking.chunk_text(text, size, overlap)
    assert got == walk(text, size, overlap)
    body = text.strip(TRIMMED)
    assert all(0 < len(c) <= size and c == c.strip(TRIMMED) and c in body for c in got)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aab \n\t.é😀"), max_size=70), min_size=1, max_size=12), st.integers(2, 15), st.integers(0, 1))
def test_spark_equals_driver(spark, texts, size, overlap):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "documentId string, content string")
    rows = chunking.chunk_documents(df, size, overlap).orderBy("documentId", "chunkIndex").collect()
    got = {}
    for r in rows:
        got.setdefault(r.documentId, []).append(r.chunkText)
    assert got == {str(i): c for i, t in enumerate(texts) if (c := chunking.chunk_text(t, size, overlap))}


def test_blank_pieces_take_no_index(spark):
    df = spark.createDataFrame([("d", "a" + " " * 60 + "b"), ("n", None)], "documentId string, content string")
    rows = chunking.chunk_documents(df, 20, 5).orderBy("chunkIndex").collect()
    assert [(r.chunkIndex, r.chunkText) for r in rows] == [(0, "a"), (1, "b"), (2, "b")]


def test_with_index():
    assert chunking.chunk_with_index("A" * 150, 50, 10)[0] == (0, "A" * 50)
