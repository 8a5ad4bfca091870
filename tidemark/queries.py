"""Registered queries of the core operators and their SQL.

The two-snapshot fixture of the diff operators comes from ``documents``: the current state leaves
out ids ending in 2, the previous state those ending in 0 and has another text for those ending in 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedders import HashEmbedder
from .functions import text as fn
from .operators import chunking, diff, embedding, merge, snapshots, topk
from .schemas import DOCUMENT, EMBEDDING, conform
from .session import materialize, scratch
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as Document rows."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").cast("string").alias("documentId"),
        F.concat(F.lit("doc/"), "doc_id").alias("filePath"),
        F.col("doc_id").cast("string").alias("fileName"),
        F.col("text").alias("content"),
        fn.sha256_hex("text").alias("contentHash"),
        F.lit(0).cast("long").alias("processedAt"),
        F.lit("v1").alias("version"),
    )
    return conform(rows, DOCUMENT)


def _number() -> F.Column:
    return F.col("documentId").cast("long")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(_number() % 10 != 2)


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter(_number() % 10 != 0)
    d = d.withColumn("content", F.when(_number() % 10 == 1, F.concat("content", F.lit(" v0"))).otherwise(F.col("content")))
    return d.withColumn("contentHash", fn.sha256_hex("content"))


#: Vectors whose numbers times 1,000 are whole numbers that a double writes in full.
_FINITE = "embeddingVector is not null and forall(embeddingVector, x -> x is not null and not isnan(x) and abs(x) < 9000)"
_LIGHT = ["documentId", "filePath", "fileName", "contentHash", "version"]


def _chunks(docs: DataFrame) -> DataFrame:
    return chunking.chunk_documents(docs, 1000, 100).drop("chunkTimestamp")


def _delta(part: str) -> Query:
    return lambda s, d: getattr(diff.detect_changes(current(s, d), previous(s, d)), part).select(*_LIGHT)


def _changes(s: SparkSession, d: str) -> DataFrame:
    return diff.classify(current(s, d), previous(s, d))


def _keys(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    """documentIds by kind of change."""
    named = _changes(s, d).filter(F.col("change_type").isin(*kinds))
    return named.select(F.substring_index("filePath", "/", -1).alias("documentId"), "filePath")


def _stored_embeddings(s: SparkSession, d: str) -> DataFrame:
    return embedding.embed_chunks(_chunks(previous(s, d)), HashEmbedder(16))


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("chunkId", "documentId", "embeddingModel", F.transform("embeddingVector", lambda x: F.round(x, 6)).alias("embeddingVector"))


def _embed_incremental(s: SparkSession, d: str) -> DataFrame:
    kept, made = embedding.generate_embeddings(_chunks(current(s, d)), _stored_embeddings(s, d), HashEmbedder(16))
    return _vectors(merge.merge_embeddings(kept, made))


def _stored_changes(s: SparkSession, d: str) -> tuple[diff.DocumentDelta, DataFrame]:
    """(the four views, keys of what is new, changed or deleted) of one stored comparison."""
    changes = materialize(_changes(s, d), "changes")
    touched = changes.filter(F.col("change_type") != diff.UNCHANGED)
    return diff.detect_changes(current(s, d), previous(s, d), changes), touched.select(F.substring_index("filePath", "/", -1).alias("documentId"), "filePath")


def _merged_chunks(s: SparkSession, d: str) -> DataFrame:
    parts, gone = _stored_changes(s, d)
    new = _chunks(merge.docs_to_process(parts.new, parts.changed))
    return merge.merge_chunks(new, _chunks(previous(s, d)), gone)


def _merged_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Stored vectors of chunks that are there, and a vector for every chunk without one."""
    chunks, stored = table(s, d, "chunks"), conform(table(s, d, "chunk_vectors"), EMBEDDING)
    kept = embedding.embeddings_kept(stored, chunks)
    made = embedding.embed_chunks(embedding.chunks_to_embed(chunks, stored), HashEmbedder(16))
    return merge.merge_embeddings(kept, made).select("chunkId", "embeddingModel")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """The documents of a store that the three tables were committed to."""
    store = Store(s, f"{scratch(s)}/store-{uuid.uuid4().hex}")
    run = store.begin()
    for name, source in (("documents", "doc_files"), ("chunks", "chunks"), ("embeddings", "chunk_vectors")):
        store.write(run, name, table(s, d, source))
    store.commit(run, {})
    return store.load("documents")


def _whole_numbers() -> F.Column:
    """Vectors whose text is the same in every engine."""
    return F.transform("embeddingVector", lambda x: F.floor(x * 1000).cast("double"))


def _merged_documents(s: SparkSession, d: str) -> DataFrame:
    parts, gone = _stored_changes(s, d)
    return merge.merge_documents(merge.docs_to_process(parts.new, parts.changed), previous(s, d), gone).select(*_LIGHT)


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_files")


def _p2(s: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(s, d, "doc_snapshots"), table(s, d, "snapshot_log"))


def queries() -> dict[str, Query]:
    text = lambda s, d: table(s, d, "documents")
    return {
        "chunk_documents": lambda s, d: _chunks(documents(s, d)),
        "chunk_text": lambda s, d: chunking.pieces(documents(s, d), "content", 1000, 100).select("documentId", "piece"),
        "chunk_with_index": lambda s, d: chunking.indexed(chunking.pieces(documents(s, d), "content", 40, 5), "documentId").select("documentId", "chunk_index", "piece"),
        "chunk_index": lambda s, d: chunking.chunk_documents(documents(s, d), 300, 30).select("documentId", "chunkIndex", F.length("chunkText").alias("n_chars")),
        "chunk_id": lambda s, d: text(s, d).select("doc_id", fn.chunk_id("doc_id", F.lit(7), fn.sha256_hex("text")).alias("chunk_id")),
        "scan_documents": lambda s, d: documents(s, d).select(*_LIGHT, "content"),
        "load_snapshot": _loaded,
        "hash_sha256": lambda s, d: text(s, d).select("doc_id", fn.sha256_hex("text").alias("sha256")),
        "hash_md5": lambda s, d: text(s, d).select("doc_id", fn.md5_hex("text").alias("md5")),
        "java_trim": lambda s, d: text(s, d).select("doc_id", fn.java_trim("text").alias("trimmed")),
        "clean_text": lambda s, d: text(s, d).select("doc_id", fn.clean_text("text").alias("cleaned")),
        "document_id_from_path": lambda s, d: _files(s, d).select("filePath", "processedAt", fn.document_id_from_path("filePath").alias("doc_key")),
        "file_name_of": lambda s, d: _files(s, d).select("filePath", "processedAt", fn.file_name_of("filePath").alias("name"), fn.document_id_of_file(fn.file_name_of("filePath")).alias("stem")),
        "embedding_id_model": lambda s, d: table(s, d, "chunk_vectors").select("embeddingId", "embeddingTimestamp", fn.embedding_id_by_model("chunkId", "embeddingModel").alias("id_by_model")),
        "embedding_id_hash": lambda s, d: table(s, d, "chunk_vectors").filter(_FINITE).select("chunkId", fn.embedding_id_by_vector("chunkId", fn.vector_hash(_whole_numbers())).alias("id_by_vector")),
        "delta_classify": _changes,
        "delta_new": _delta("new"),
        "delta_changed": _delta("changed"),
        "delta_unchanged": _delta("unchanged"),
        "delta_deleted": _delta("deleted"),
        "delta_all_new": lambda s, d: diff.classify(current(s, d), previous(s, d).filter("false")),
        "delta_all_deleted": lambda s, d: diff.classify(current(s, d).filter("false"), previous(s, d)),
        "delta_stats": lambda s, d: diff.stats(_changes(s, d)),
        "dedup_ratio": lambda s, d: diff.dedup_ratio(_changes(s, d)).select(F.round("dedup_ratio", 6).alias("dedup_ratio")),
        "docs_to_process": lambda s, d: merge.docs_to_process(*(lambda p: (p.new, p.changed))(diff.detect_changes(current(s, d), previous(s, d)))).select(*_LIGHT),
        "filter_kept_chunks": lambda s, d: merge.without(_chunks(previous(s, d)), _keys(s, d, diff.CHANGED, diff.DELETED)).select("chunkId", "documentId", "chunkIndex"),
        "delete_chunks": lambda s, d: merge.delete_chunks(_chunks(previous(s, d)), _keys(s, d, diff.DELETED)).select("chunkId", "documentId", "chunkIndex"),
        "merge_chunks": lambda s, d: _merged_chunks(s, d),
        "merge_documents": lambda s, d: _merged_documents(s, d),
        "distinct_chunk_docs": lambda s, d: merge.distinct_documents(table(s, d, "chunks")),
        "embeddings_kept": lambda s, d: _vectors(embedding.embeddings_kept(_stored_embeddings(s, d), _chunks(current(s, d)))),
        "chunks_to_embed": lambda s, d: embedding.chunks_to_embed(_chunks(current(s, d)), _stored_embeddings(s, d)).select("chunkId", "documentId", "chunkText"),
        "embed_incremental": _embed_incremental,
        "merge_embeddings": _merged_embeddings,
        "embedding_stats": lambda s, d: embedding.embedding_stats(_chunks(current(s, d)), _stored_embeddings(s, d)),
        "topk_cosine": lambda s, d: (lambda e: topk.topk_cosine(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5))(table(s, d, "embeddings")),
        "p2_found": _p2,
        "p2_change_counts": lambda s, d: _p2(s, d).groupBy("snapshotNo", "changeType").agg(F.count(F.lit(1)).alias("n")),
    }


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _cuts(source: str, size: int, overlap: int) -> str:
    """Pieces of ``content``: all windows, the repeated last one marked by ``lag``."""
    step = size - overlap
    piece = _TRIM.format(f"substring(body, k * {step} + 1, {size})")
    return f"""
        SELECT documentId, k, piece FROM (
          SELECT documentId, k, n, len, piece, lag(piece) OVER (PARTITION BY documentId ORDER BY k) AS before FROM (
            SELECT documentId, k, n, len, {piece} AS piece FROM (
              SELECT documentId, body, length(body) AS len, CAST(ceil(length(body) / {step}.0) AS INT) AS n,
                     unnest(range(CAST(ceil(length(body) / {step}.0) AS INT))) AS k
              FROM (SELECT documentId, {_TRIM.format("content")} AS body FROM {source}) b WHERE body <> '')
          )
        ) w WHERE piece <> '' AND NOT (k = n - 1 AND n >= 2 AND piece = before AND (n - 2) * {step} + {size} < len)"""


def _sql_chunks(source: str, size: int = 1000, overlap: int = 100) -> str:
    return f"""
        SELECT documentId || '_' || chunkIndex || '_' || substring(chunkHash, 1, 8) AS chunkId, documentId, chunkIndex,
               piece AS chunkText, chunkHash, 'v1' AS chunkingVersion
        FROM (SELECT documentId, piece, sha256(piece) AS chunkHash,
                     CAST(row_number() OVER (PARTITION BY documentId ORDER BY k) - 1 AS INT) AS chunkIndex
              FROM ({_cuts(source, size, overlap)}) c)"""


_DOCS = """
    docs AS (SELECT CAST(doc_id AS VARCHAR) AS documentId, 'doc/' || doc_id AS filePath, CAST(doc_id AS VARCHAR) AS fileName,
                    text AS content, sha256(text) AS contentHash, CAST(0 AS BIGINT) AS processedAt, 'v1' AS version, doc_id FROM documents),
    cur AS (SELECT * FROM docs WHERE doc_id % 10 <> 2),
    prev AS (SELECT * REPLACE (sha256(content) AS contentHash) FROM
              (SELECT * REPLACE (CASE WHEN doc_id % 10 = 1 THEN content || ' v0' ELSE content END AS content) FROM docs WHERE doc_id % 10 <> 0)),
    changes AS (SELECT coalesce(c.filePath, p.filePath) AS filePath,
                  CASE WHEN p.filePath IS NULL THEN 'new' WHEN c.filePath IS NULL THEN 'deleted'
                       WHEN c.contentHash IS NOT DISTINCT FROM p.contentHash THEN 'unchanged' ELSE 'changed' END AS change_type
                FROM cur c FULL JOIN prev p ON c.filePath = p.filePath)"""
_SQL_LIGHT = "documentId, filePath, fileName, contentHash, version"


def _sql_vector(text: str = "chunkText") -> str:
    numbers = ", ".join(f"round(CAST('0x' || substring(sha256({text}), {2 * i + 1}, 2) AS INT) / 255.0, 6)" for i in range(16))
    return f"[{numbers}]::DOUBLE[]"


_SQL_PATH = r"""regexp_replace(CASE WHEN regexp_matches(replace(filePath, '\', '/'), '^[A-Za-z][A-Za-z0-9+.-]+:') OR filePath LIKE '%\%%' ESCAPE '\'
    THEN url_decode(regexp_replace(replace(filePath, '\', '/'), '^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?', ''))
    ELSE replace(filePath, '\', '/') END, '/{2,}', '/', 'g')"""

_SQL_P2 = f"""
    WITH ord AS (SELECT snapshotNo, row_number() OVER (ORDER BY snapshotNo) AS pos FROM (
             SELECT snapshotNo FROM doc_snapshots UNION SELECT snapshotNo FROM snapshot_log)),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, snapshotNo ORDER BY coalesce(processedAt, -4611686018427387904) DESC, hash DESC NULLS LAST) AS rn
               FROM (SELECT snapshotNo, {_SQL_PATH} AS path, lower(contentHash) AS hash, processedAt FROM doc_snapshots WHERE filePath IS NOT NULL)) WHERE rn = 1),
    isl AS (SELECT path, pos, hash, pos - row_number() OVER (PARTITION BY path ORDER BY pos) AS g FROM latest JOIN ord USING (snapshotNo)),
    st AS (SELECT path, pos, last_value(hash IGNORE NULLS) OVER (PARTITION BY path, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM isl),
    ch AS (SELECT coalesce(c.pos, p.pos + 1) AS pos, coalesce(c.path, p.path) AS filePath,
             CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN p.h <> c.h THEN 'changed' END AS changeType
           FROM st c FULL JOIN st p ON c.path = p.path AND c.pos = p.pos + 1)
    SELECT snapshotNo, filePath, changeType FROM ch JOIN ord USING (pos) WHERE pos > 1 AND changeType IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    kind = lambda k, side: f"WITH {_DOCS} SELECT {_SQL_LIGHT} FROM {side} WHERE filePath IN (SELECT filePath FROM changes WHERE change_type = '{k}')"
    ids = lambda *kinds: f"(SELECT substring(filePath, 5) FROM changes WHERE change_type IN ({', '.join(map(repr, kinds))}))"
    chunks_now, chunks_before = _sql_chunks("cur"), _sql_chunks("prev")
    vector_rows = f"chunkId, documentId, 'sha256-bytes' AS embeddingModel, {_sql_vector()} AS embeddingVector"
    dot = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))"
    norm = lambda t: f"sqrt(list_inner_product(CAST({t}.embedding AS DOUBLE[]), CAST({t}.embedding AS DOUBLE[])))"
    return {
        "chunk_documents": f"WITH {_DOCS} {_sql_chunks('docs')}",
        "chunk_text": f"WITH {_DOCS} SELECT documentId, piece FROM ({_cuts('docs', 1000, 100)})",
        "chunk_with_index": f"WITH {_DOCS} SELECT documentId, CAST(row_number() OVER (PARTITION BY documentId ORDER BY k) - 1 AS INT) AS chunk_index, piece FROM ({_cuts('docs', 40, 5)})",
        "chunk_index": f"WITH {_DOCS} SELECT documentId, chunkIndex, CAST(length(chunkText) AS INT) AS n_chars FROM ({_sql_chunks('docs', 300, 30)})",
        "chunk_id": "SELECT doc_id, concat_ws('_', CAST(doc_id AS VARCHAR), '7', substring(sha256(text), 1, 8)) AS chunk_id FROM documents",
        "scan_documents": f"WITH {_DOCS} SELECT {_SQL_LIGHT}, content FROM docs",
        "load_snapshot": "SELECT documentId, filePath, fileName, content, contentHash, processedAt, version FROM doc_files",
        "hash_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "hash_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "java_trim": f"SELECT doc_id, {_TRIM.format('text')} AS trimmed FROM documents",
        "clean_text": rf"SELECT doc_id, {_TRIM.format(r'''regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g')''')} AS cleaned FROM documents",
        "document_id_from_path": r"SELECT filePath, processedAt, 'doc_' || substring(sha256(replace(filePath, '\', '/')), 1, 16) AS doc_key FROM doc_files",
        "file_name_of": r"SELECT filePath, processedAt, regexp_extract(filePath, '[^/]*$') AS name, regexp_replace(regexp_extract(filePath, '[^/]*$'), '\.pdf$', '') AS stem FROM doc_files",
        "embedding_id_model": "SELECT embeddingId, embeddingTimestamp, chunkId || '_' || regexp_replace(embeddingModel, '[^a-zA-Z0-9]', '_', 'g') AS id_by_model FROM chunk_vectors",
        "embedding_id_hash": """SELECT chunkId, chunkId || '_' || substring(md5(array_to_string(list_transform(embeddingVector, lambda x: CAST(CAST(CAST(floor(x * 1000) AS BIGINT) AS DOUBLE) AS VARCHAR)), ',')), 1, 8) AS id_by_vector
            FROM chunk_vectors WHERE embeddingVector IS NOT NULL AND len(list_filter(embeddingVector, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 9000)) = 0""",
        "delta_classify": f"WITH {_DOCS} SELECT * FROM changes",
        "delta_new": kind("new", "cur"),
        "delta_changed": kind("changed", "cur"),
        "delta_unchanged": kind("unchanged", "cur"),
        "delta_deleted": kind("deleted", "prev"),
        "delta_all_new": f"WITH {_DOCS} SELECT filePath, 'new' AS change_type FROM cur",
        "delta_all_deleted": f"WITH {_DOCS} SELECT filePath, 'deleted' AS change_type FROM prev",
        "delta_stats": f"WITH {_DOCS} SELECT change_type, count(*) AS n FROM changes GROUP BY change_type",
        "dedup_ratio": f"WITH {_DOCS} SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE change_type = 'unchanged') / count(*) FILTER (WHERE change_type <> 'deleted'), 6) AS dedup_ratio FROM changes",
        "docs_to_process": f"WITH {_DOCS} SELECT {_SQL_LIGHT} FROM cur WHERE filePath IN (SELECT filePath FROM changes WHERE change_type IN ('new', 'changed'))",
        "filter_kept_chunks": f"WITH {_DOCS} SELECT chunkId, documentId, chunkIndex FROM ({chunks_before}) WHERE documentId NOT IN {ids('changed', 'deleted')}",
        "delete_chunks": f"WITH {_DOCS} SELECT chunkId, documentId, chunkIndex FROM ({chunks_before}) WHERE documentId NOT IN {ids('deleted')}",
        "merge_chunks": f"WITH {_DOCS} {chunks_now}",
        "merge_documents": f"WITH {_DOCS} SELECT {_SQL_LIGHT} FROM cur",
        "distinct_chunk_docs": "SELECT DISTINCT documentId FROM chunks",
        "embeddings_kept": f"WITH {_DOCS} SELECT {vector_rows} FROM ({chunks_before}) WHERE chunkId IN (SELECT chunkId FROM ({chunks_now}))",
        "chunks_to_embed": f"WITH {_DOCS} SELECT chunkId, documentId, chunkText FROM ({chunks_now}) WHERE chunkId NOT IN (SELECT chunkId FROM ({chunks_before}))",
        "embed_incremental": f"WITH {_DOCS} SELECT {vector_rows} FROM ({chunks_now})",
        "merge_embeddings": """SELECT chunkId, embeddingModel FROM chunk_vectors WHERE chunkId IN (SELECT chunkId FROM chunks)
            UNION ALL SELECT DISTINCT chunkId, 'sha256-bytes' FROM chunks WHERE chunkId NOT IN (SELECT chunkId FROM chunk_vectors WHERE chunkId IS NOT NULL)""",
        "embedding_stats": f"WITH {_DOCS}, a AS (SELECT chunkId FROM ({chunks_before})), b AS (SELECT chunkId FROM ({chunks_now})) SELECT count(*) FILTER (WHERE a.chunkId IS NOT NULL AND b.chunkId IS NOT NULL) AS kept, count(*) FILTER (WHERE b.chunkId IS NULL) AS removed, count(*) FILTER (WHERE a.chunkId IS NULL) AS to_embed FROM a FULL JOIN b ON a.chunkId = b.chunkId",
        "topk_cosine": f"""SELECT query_id, neighbour_id, cosine, CAST(rank AS INT) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS rank FROM (
              SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round({dot} / ({norm("q")} * {norm("r")}), 6) AS cosine
              FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
        "p2_found": _SQL_P2,
        "p2_change_counts": f"SELECT snapshotNo, changeType, count(*) AS n FROM ({_SQL_P2}) GROUP BY snapshotNo, changeType",
    }
