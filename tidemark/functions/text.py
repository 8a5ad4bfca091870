"""Column functions on text, hashes and ids. All are built-ins and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a Java trim removes: every character up to and including U+0020.
TRIMMED = "".join(map(chr, range(33)))

__all__ = [
    "TRIMMED", "java_trim", "sha256_hex", "md5_hex", "chunk_id", "embedding_id_by_model", "vector_hash",
    "embedding_id_by_vector", "document_id_from_path", "clean_text", "file_name_of", "document_id_of_file",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(TRIMMED))


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def md5_hex(c: Column | str) -> Column:
    return F.md5(_col(c))


def chunk_id(document_id: Column | str, index: Column | str, chunk_hash: Column | str) -> Column:
    """``<document>_<index>_<first 8 of the SHA-256>``."""
    return F.concat_ws("_", _col(document_id), _col(index).cast("string"), F.substring(_col(chunk_hash), 1, 8))


def embedding_id_by_model(chunk: Column | str, model: Column | str) -> Column:
    return F.concat(_col(chunk), F.lit("_"), F.regexp_replace(_col(model), "[^a-zA-Z0-9]", "_"))


def vector_hash(vector: Column | str) -> Column:
    """MD5 of the numbers as text, joined by commas."""
    return F.md5(F.concat_ws(",", F.transform(_col(vector), lambda x: x.cast("string"))))


def embedding_id_by_vector(chunk: Column | str, hashed: Column | str) -> Column:
    return F.concat(_col(chunk), F.lit("_"), F.substring(_col(hashed), 1, 8))


def document_id_from_path(path: Column | str) -> Column:
    """``doc_`` and 16 hex digits; both kinds of slash give the same id."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.translate(_col(path), "\\", "/"), 256), 1, 16))


def clean_text(c: Column | str) -> Column:
    """White space runs to one space, control characters out, both ends trimmed; null gives ''."""
    spaced = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    return java_trim(F.regexp_replace(spaced, "[\\x00-\\x1F\\x7F]", ""))


def file_name_of(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def document_id_of_file(name: Column | str) -> Column:
    """The name without a final lower-case ``.pdf``."""
    return F.regexp_replace(_col(name), "\\.pdf$", "")
