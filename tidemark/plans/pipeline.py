"""The incremental run: scan, diff, chunk, embed, commit.

After each run the stored state equals what a rebuild from the current corpus would give. Every
expensive step is materialized once: the extraction, the diff, and the new embeddings.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..embedders import Embedder, HttpEmbedder
from ..operators import diff, merge
from ..operators.chunking import chunk_documents
from ..operators.embedding import generate_embeddings
from ..schemas import DOCUMENT, conform
from ..session import materialize
from ..sources import files
from ..sources.store import Store


@dataclass(frozen=True)
class RunReport:
    """``committed`` is False where nothing had changed; ``failed`` counts files without text."""

    first_run: bool
    committed: bool
    changes: dict[str, int]
    dedup_ratio: float
    failed: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    embedded: int = 0


def run(spark: SparkSession, config: Config, embedder: Embedder | None = None, extractor: files.Extractor = files.extract_text_from_bytes) -> RunReport:
    """Indexes the PDF files of ``config.input_dir``."""
    extracted = materialize(files.extract(files.read_files(spark, config.input_dir), extractor), "extracted")
    documents = files.to_documents(extracted, config.document_version, config.document_id_mode)
    return index(spark, config, documents, embedder, files.quarantine(extracted))


def index(spark: SparkSession, config: Config, documents: DataFrame, embedder: Embedder | None = None, failed: DataFrame | None = None) -> RunReport:
    """Indexes a full scan given as Document rows. Stored rows of ``failed`` paths stay as they are."""
    embedder = embedder or HttpEmbedder(config.embedding_host, config.embedding_model)
    store = Store(spark, config.output_dir, keep=config.keep_versions)
    first = store.current() is None
    previous = store.load("documents")
    current = conform(documents, DOCUMENT)
    n_failed = 0
    if failed is not None:
        store.keep_failed(failed, True)
    if failed is not None and (n_failed := failed.count()):
        current = current.unionByName(merge.only(previous, failed, "filePath"))
    diff.assert_unique(current, "filePath")
    diff.assert_unique(current, "documentId")

    changes = materialize(diff.classify(current, previous), "changes")
    counts = {kind: 0 for kind in (diff.NEW, diff.CHANGED, diff.UNCHANGED, diff.DELETED)} | {r[0]: r[1] for r in diff.stats(changes).collect()}
    seen = counts[diff.NEW] + counts[diff.CHANGED] + counts[diff.UNCHANGED]
    ratio = 100.0 * counts[diff.UNCHANGED] / seen if seen else 0.0
    touched = counts[diff.NEW] + counts[diff.CHANGED] + counts[diff.DELETED]
    if not touched and not first:
        return RunReport(False, False, counts, ratio, n_failed, store.current()["rows"])

    delta = diff.detect_changes(current, previous, changes)
    process = merge.docs_to_process(delta.new, delta.changed)
    gone = changes.filter(F.col("change_type").isin(diff.CHANGED, diff.DELETED, diff.NEW)).select("filePath")
    replaced = merge.only(previous, gone, "filePath")

    run_id = store.begin()
    store.write(run_id, "documents", merge.merge_documents(process, previous, gone))
    fresh = chunk_documents(process, config.chunk_size, config.overlap, config.chunking_version)
    # A document that moved keeps its id: its old chunks go with the id of either side.
    ids = replaced.select("documentId").unionByName(process.select("documentId"))
    store.write(run_id, "chunks", merge.merge_chunks(fresh, store.load("chunks"), ids))
    chunks = store.load("chunks", run_id)
    kept, made = generate_embeddings(chunks, store.load("embeddings"), embedder, config.reuse_by_model)
    made = materialize(made, "embedded")
    store.write(run_id, "embeddings", merge.merge_embeddings(kept, made))
    manifest = store.commit(run_id, {"config": asdict(config), "changes": counts})
    return RunReport(first, True, counts, ratio, n_failed, manifest["rows"], made.count())
