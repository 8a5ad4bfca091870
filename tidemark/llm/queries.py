"""Registered queries of the subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import table
from ..session import scratch
from . import duplicates, encoding, history, packing, scans, sentences, spans, splitting, vectors

Query = Callable[[SparkSession, str], DataFrame]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_table, record_key, text`` of both record tables; repeated rows are still there."""
    files = table(spark, sf_dir, "doc_files").select(F.lit("doc_files").alias("record_table"), F.col("filePath").alias("record_key"), F.col("content").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunkId").alias("record_key"), F.col("chunkText").alias("text"))
    return files.unionByName(chunks)


KEYS = ["record_table", "record_key"]


def _p1_found(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_spaces(s, d), 200).withColumnsRenamed({"space": "record_table", "key": "record_key"})


def _p1_amount(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_amount(_spaces(s, d), 200).withColumnsRenamed({"space": "record_table", "key": "record_key"})


def _p3_neighbours(s: SparkSession, d: str) -> DataFrame:
    found = vectors.neighbours(table(s, d, "chunk_vectors"), "chunkId", "embeddingVector", "embeddingModel", k=5, least=0.84, dimension=64)
    return found.withColumnsRenamed({"space": "embeddingModel", "key": "chunkId"})


def _p3_found(s: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_pairs(_p3_neighbours(s, d).withColumnRenamed("chunkId", "key"))


def _spaces(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).select(F.col("record_table").alias("space"), F.col("record_key").alias("key"), "text")


def _p4_found(s: SparkSession, d: str) -> DataFrame:
    return scans.find(table(s, d, "doc_files"), "filePath", "content").withColumnRenamed("line_no", "lineNo")


def _p4_repaired(s: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(s, d, "doc_files"), "filePath", "content")


def _p5_found(s: SparkSession, d: str) -> DataFrame:
    return duplicates.pairs(_spaces(s, d), 0.6, 3).select(F.col("space").alias("record_table"), "key_a", "key_b")


def _p5_groups(s: SparkSession, d: str) -> DataFrame:
    return duplicates.groups(_spaces(s, d), 0.6, 3).withColumnsRenamed({"space": "record_table", "key": "record_key"})


def _p6_found(s: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(splitting.split(records(s, d), KEYS, "text", with_text=False), KEYS)


def _p6_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split(records(s, d).dropDuplicates(KEYS), KEYS, "text")


def _p7_found(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s)}/index-{uuid.uuid4().hex}"
    return history.already_known(table(s, d, "chunk_arrivals"), table(s, d, "chunks"), table(s, d, "chunk_vectors"), path)


def _p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(s, d, "documents"))


def _p8_decoded(s: SparkSession, d: str) -> DataFrame:
    return encoding.decode(_p8_ids(s, d))


def _p9_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(encoding.token_counts(table(s, d, "documents")), "doc_id", "n_tokens", 2048)


def _p10_found(s: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(s, d, "documents")).select("doc_id", "start_at", "end_at")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_amount": _p1_amount,
        "p3_found": _p3_found,
        "p3_neighbours": _p3_neighbours,
        "p4_found": _p4_found,
        "p4_repaired": _p4_repaired,
        "p5_found": _p5_found,
        "p5_groups": _p5_groups,
        "p6_found": _p6_found,
        "p6_pieces": _p6_pieces,
        "p7_found": _p7_found,
        "p8_ids": _p8_ids,
        "p8_decoded": _p8_decoded,
        "p9_containers": _p9_containers,
        "p10_found": _p10_found,
    }


_BOTH = "SELECT 'doc_files' AS record_table, filePath AS record_key, content AS text FROM doc_files UNION ALL SELECT 'chunks', chunkId, chunkText FROM chunks"
_TRIMMED = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

_SQL_P1 = f"""
    WITH t AS (SELECT DISTINCT record_table, record_key, text FROM ({_BOTH}) WHERE length(text) >= 200),
    w AS (SELECT record_table, record_key, i, md5(substring(text, i + 1, 200)) AS h
          FROM (SELECT *, unnest(range(length(text) - 199)) AS i FROM t)),
    s AS (SELECT record_table, h FROM w GROUP BY record_table, h HAVING min(record_key) <> max(record_key)),
    m AS (SELECT DISTINCT record_table, record_key, i FROM w JOIN s USING (record_table, h)),
    g AS (SELECT *, CASE WHEN i <= lag(i) OVER p + 200 THEN 0 ELSE 1 END AS new FROM m WINDOW p AS (PARTITION BY record_table, record_key ORDER BY i)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY record_table, record_key ORDER BY i) AS k FROM g)
    SELECT record_table, record_key, CAST(min(i) AS INT) AS start_at, CAST(max(i) + 200 AS INT) AS end_at FROM n GROUP BY record_table, record_key, k"""

_SQL_P1_AMOUNT = f"""
    WITH f AS (SELECT record_table, record_key, sum(end_at - start_at) AS n FROM ({_SQL_P1}) GROUP BY 1, 2),
    z AS (SELECT record_table, record_key, max(coalesce(length(text), 0)) AS n_chars FROM ({_BOTH}) GROUP BY 1, 2)
    SELECT record_table, record_key, CAST(n_chars AS INT) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared,
           CASE WHEN n_chars > 0 THEN coalesce(n, 0)::DOUBLE / n_chars ELSE 0.0::DOUBLE END AS share
    FROM z LEFT JOIN f USING (record_table, record_key)"""

# Exact; the operator may miss a small share, and misses none on the small tables.
_SQL_P3 = """    WITH u AS (SELECT DISTINCT embeddingModel AS m, chunkId, embeddingVector AS v FROM chunk_vectors
               WHERE chunkId IS NOT NULL AND len(embeddingVector) = 64
                 AND len(list_filter(embeddingVector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddingVector, lambda x: x <> 0)) > 0),
    n AS (SELECT m, chunkId, v, sqrt(list_inner_product(v, v)) AS l FROM u),
    p AS (SELECT a.chunkId AS a, b.chunkId AS b, round(list_inner_product(a.v, b.v) / (a.l * b.l), 6) AS c
          FROM n a JOIN n b ON a.m = b.m AND a.chunkId <> b.chunkId),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p WHERE c >= 0.84)
    SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE k <= 5"""

_GRAMS = r"SELECT DISTINCT {key}, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {source}) WHERE len(w) >= 3)"

_SQL_P5 = f"""
    WITH g AS ({_GRAMS.format(key="record_table, record_key", text="text", source=f"({_BOTH})")}),
    n AS (SELECT record_table, record_key, count(*) AS n FROM g GROUP BY 1, 2),
    b AS (SELECT x.record_table, x.record_key AS key_a, y.record_key AS key_b, count(*) AS c
          FROM g x JOIN g y ON x.record_table = y.record_table AND x.h = y.h AND x.record_key < y.record_key GROUP BY 1, 2, 3)
    SELECT b.record_table, key_a, key_b FROM b
    JOIN n p ON p.record_table = b.record_table AND p.record_key = key_a
    JOIN n q ON q.record_table = b.record_table AND q.record_key = key_b
    WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9"""

_SQL_P7 = f"""
    WITH RECURSIVE a AS (SELECT *, row_number() OVER (ORDER BY batchNo, arrivalNo) AS k FROM chunk_arrivals),
    x AS (SELECT k, chunkHash, chunkText FROM a UNION ALL SELECT -row_number() OVER (), chunkHash, chunkText FROM chunks),
    g AS ({_GRAMS.format(key="k", text="chunkText", source="x")}),
    n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT y.k AS k, z.k AS j, count(*) AS c FROM g y JOIN g z ON y.h = z.h AND z.k < y.k WHERE y.k > 0 GROUP BY 1, 2),
    e AS (SELECT c.k, c.j FROM c JOIN n p ON p.k = c.k JOIN n q ON q.k = c.j WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9
          UNION SELECT y.k, z.k FROM x y JOIN x z ON lower(y.chunkHash) = lower(z.chunkHash) AND z.k < y.k WHERE y.k > 0
          UNION SELECT y.k, z.k FROM x y JOIN x z ON y.chunkText = z.chunkText AND z.k < y.k WHERE y.k > 0),
    i AS (SELECT a.k, any_value(a.arrivalNo) AS arrivalNo,
                 coalesce(bool_or(e.j < 0), false) OR bool_or(a.chunkId IN (SELECT chunkId FROM chunk_vectors WHERE chunkId IS NOT NULL)) AS direct,
                 coalesce(list(e.j) FILTER (WHERE e.j > 0), []) AS near
          FROM a LEFT JOIN e ON a.k = e.k GROUP BY a.k),
    r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
          UNION ALL
          SELECT i.k, CASE WHEN coalesce(i.direct, false) OR list_has_any(r.kept, i.near) THEN r.kept ELSE list_append(r.kept, i.k) END
          FROM r JOIN i ON i.k = r.k + 1)
    SELECT arrivalNo FROM i WHERE k NOT IN (SELECT unnest(kept) FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SQL_P1,
        "p1_amount": _SQL_P1_AMOUNT,
        "p3_found": _SQL_P3,
        "p5_found": _SQL_P5,
        "p6_found": f"SELECT DISTINCT record_table, record_key FROM ({_BOTH}) WHERE length({_TRIMMED.format('text')}) > 1000",
        "p7_found": _SQL_P7,
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
