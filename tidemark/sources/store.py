"""Versioned snapshot store: three tables, one atomic commit.

``<root>/snapshots/<run>/<table>`` holds complete tables; ``<root>/_CURRENT`` names the run that
counts and is replaced by a rename after all tables were written and verified. A reader therefore
sees one whole state, a crash in between leaves the old state, and an empty table is a stored state
like any other. Any Hadoop file system works.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, conform, empty

FAILED = "filePath string, error string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    fmt: str = "parquet"
    keep: int = 2
    written: dict[tuple[str, str], int] = field(default_factory=dict, compare=False)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        path = self._path(*parts)
        return self._fs(path).exists(path)

    def current(self) -> dict | None:
        """The manifest of the state that counts."""
        path = self._path("_CURRENT")
        if not self._fs(path).exists(path):
            return None
        stream = self._fs(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def location(self, run: str, table: str) -> str:
        return self._path("snapshots", run, table).toString()

    def table_exists(self, table: str) -> bool:
        now = self.current()
        return bool(now) and self.exists("snapshots", now["run"], table)

    def load(self, table: str, run: str | None = None) -> DataFrame:
        """A table of the current or a named run; typed and empty where there is none. The schema is
        given, so an id like 007 stays text."""
        now = {"run": run} if run else self.current()
        if not now:
            return empty(self.spark, TABLES[table])
        return self.spark.read.format(self.fmt).schema(TABLES[table]).load(self.location(now["run"], table))

    def history(self) -> list[str]:
        path = self._path("snapshots")
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(path)) if self.exists("snapshots") else []

    def begin(self) -> str:
        now = self.current()
        return f"{(int(now['run'].split('-')[0]) + 1 if now else 1):08d}-{uuid.uuid4().hex[:8]}"

    def write(self, run: str, table: str, df: DataFrame) -> None:
        """Counts the rows as they are written, for ``verify``."""
        seen = Observation()
        conform(df, TABLES[table]).observe(seen, F.count(F.lit(1)).alias("n")).write.format(self.fmt).save(self.location(run, table))
        self.written[run, table] = seen.get["n"]

    def verify(self, run: str) -> dict[str, int]:
        """Rows by table; raises where a table is missing or has other rows than were written."""
        missing = [t for t in TABLES if not self.exists("snapshots", run, t)]
        if missing:
            raise RuntimeError(f"snapshot {run} lacks {', '.join(missing)}")
        found = {t: self.load(t, run).count() for t in TABLES}
        wrong = [t for t, n in found.items() if n != self.written.get((run, t), n)]
        if wrong:
            raise RuntimeError(f"snapshot {run} has other rows than were written to {', '.join(wrong)}")
        return found

    def commit(self, run: str, details: dict) -> dict:
        """Verifies the run, then makes it current; older runs beyond ``keep`` are removed."""
        before = self.current()
        manifest = {"run": run, "previous": before and before["run"], "rows": self.verify(run)} | details
        target, draft = self._path("_CURRENT"), self._path(f"_CURRENT.{run}")
        fs = self._fs(target)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        conf = self.spark._jsc.hadoopConfiguration()
        contexts = self.spark._jvm.org.apache.hadoop.fs.FileContext
        named = target.toUri().getScheme()
        context = contexts.getFileContext(target.toUri(), conf) if named else contexts.getFileContext(conf)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(draft, target, options)
        for old in self.history()[: -self.keep] if self.keep > 0 else []:
            if old not in (run, manifest["previous"]):
                gone = self._path("snapshots", old)
                fs.delete(gone, True)
        return manifest

    def keep_failed(self, failed: DataFrame, replace: bool) -> None:
        """Stores ``filePath, error`` of files without text; a full scan replaces what was kept before."""
        failed.select("filePath", "error").write.mode("overwrite" if replace else "append").parquet(self._path("failed").toString())

    def failed(self) -> DataFrame:
        """``filePath, error`` of the files kept as failed."""
        if not self.exists("failed"):
            return self.spark.createDataFrame([], FAILED)
        return self.spark.read.schema(FAILED).parquet(self._path("failed").toString())

    def index_path(self) -> str:
        return self._path("retrieval_index").toString()

    def index_exists(self) -> bool:
        return self.exists("retrieval_index")
