"""Settings of an indexing run, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

_ENVIRONMENT = {
    "input_dir": "INPUT_DIR",
    "output_dir": "OUTPUT_DIR",
    "embedding_host": "OLLAMA_HOST",
    "master": "SPARK_MASTER",
    "checkpoint_dir": "CHECKPOINT_DIR",
}


@dataclass(frozen=True)
class Config:
    """chunk_size and overlap count characters; keep_versions is how many snapshots stay on disk."""

    input_dir: str = "test-corpus"
    output_dir: str = "delta-output"
    chunk_size: int = 1000
    overlap: int = 100
    chunking_version: str = "v1"
    embedding_model: str = "mxbai-embed-large"
    embedding_host: str = "http://localhost:11434"
    app_name: str = "tidemark"
    master: str = "local[*]"
    checkpoint_dir: str = "checkpoints"
    document_version: str = "v1"
    document_id_mode: str = "file_name"
    reuse_by_model: bool = False
    keep_versions: int = 2

    def __post_init__(self) -> None:
        for name in ("input_dir", "output_dir", "embedding_model"):
            if not getattr(self, name):
                raise ValueError(f"{name} must be set")
        if self.chunk_size <= 0 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and overlap in [0, chunk_size)")
        if self.document_id_mode not in ("file_name", "path_hash"):
            raise ValueError("document_id_mode is file_name or path_hash")


def load(**settings) -> Config:
    """Defaults, then the given settings, then the environment."""
    found = {name: os.environ[key] for name, key in _ENVIRONMENT.items() if os.environ.get(key)}
    return replace(Config(**settings), **found)
