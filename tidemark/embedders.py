"""Embedders turn chunk rows into vectors.

``HashEmbedder`` is deterministic and built from SQL functions; ``HttpEmbedder`` calls a model
server from the executors, with one client per partition and bounded retries.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str

    def embed(self, chunks: DataFrame) -> DataFrame:
        """``chunkId, documentId, chunkText`` to ``chunkId, documentId, embeddingVector``."""
        ...


@dataclass(frozen=True)
class HashEmbedder:
    """Component i is byte i of the text's SHA-256, divided by 255; at most 32 components."""

    dimension: int = 16
    model: str = "sha256-bytes"

    def embed(self, chunks: DataFrame) -> DataFrame:
        if not 0 < self.dimension <= 32:
            raise ValueError("dimension must be 1 to 32")
        byte = lambda i: F.conv(F.substring(F.sha2("chunkText", 256), 2 * i + 1, 2), 16, 10).cast("double") / 255
        return chunks.select("chunkId", "documentId", F.array(*[byte(i) for i in range(self.dimension)]).alias("embeddingVector"))


class EmbeddingClient:
    """One text per request: POST ``/api/embeddings`` with model and prompt, answer ``embedding``."""

    def __init__(self, base_url: str, timeout: float = 60, opener: Callable = urllib.request.urlopen) -> None:
        self.base_url, self.timeout, self.opener = base_url.rstrip("/"), timeout, opener

    def generate(self, text: str, model: str) -> list[float]:
        body = json.dumps({"model": model, "prompt": text}).encode()
        request = urllib.request.Request(f"{self.base_url}/api/embeddings", body, {"Content-Type": "application/json"})
        with self.opener(request, timeout=self.timeout) as answer:
            if answer.status != 200:
                raise RuntimeError(f"embedding server answered {answer.status}")
            return [float(x) for x in json.load(answer)["embedding"]]

    def test_connection(self) -> bool:
        try:
            with self.opener(urllib.request.Request(f"{self.base_url}/api/tags"), timeout=self.timeout) as answer:
                return answer.status == 200
        except OSError:
            return False


@dataclass(frozen=True)
class HttpEmbedder:
    """A text that still fails after ``attempts`` fails the job. Client errors are not repeated."""

    base_url: str
    model: str
    attempts: int = 3
    wait_s: float = 0.5
    partitions: int | None = None

    def embed(self, chunks: DataFrame) -> DataFrame:
        base_url, model, attempts, wait_s = self.base_url, self.model, self.attempts, self.wait_s

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = EmbeddingClient(base_url)

            def one(text: str) -> list[float]:
                for k in range(attempts):
                    try:
                        return client.generate(text, model)
                    except urllib.error.HTTPError as e:
                        if e.code < 500 or k + 1 == attempts:
                            raise
                    except OSError:
                        if k + 1 == attempts:
                            raise
                    time.sleep(wait_s * 2**k)
                raise RuntimeError("attempts must be positive")

            for pdf in batches:
                yield pd.DataFrame({"chunkId": pdf.chunkId, "documentId": pdf.documentId, "embeddingVector": [one(t) for t in pdf.chunkText]})

        rows = chunks.select("chunkId", "documentId", "chunkText")
        rows = rows.repartition(self.partitions) if self.partitions else rows
        return rows.mapInPandas(call, "chunkId string, documentId string, embeddingVector array<double>")
