import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tidemark import config as configs
from tidemark.cli import main
from tidemark.embedders import EmbeddingClient, HashEmbedder, HttpEmbedder
from tidemark.plans.pipeline import run
from tidemark.schemas import TABLES
from tidemark.sources import files, pdf
from tidemark.sources.store import Store
from tidemark.streaming.incremental import retry, watch


def make_pdf(text: str, compress: bool = False) -> bytes:
    body = b"BT /F1 12 Tf (" + text.replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj ET"
    extra = b" /Filter /FlateDecode" if compress else b""
    body = zlib.compress(body) if compress else body
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(body)).encode() + extra + b" >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


class Corpus:
    def __init__(self, spark, folder, **settings):
        self.spark, self.dir = spark, folder / "in"
        self.dir.mkdir()
        self.config = configs.Config(input_dir=str(self.dir), output_dir=str(folder / "out"), chunk_size=40, overlap=5, **settings)

    def put(self, name, text):
        (self.dir / name).write_bytes(make_pdf(text))

    def run(self):
        return run(self.spark, self.config, HashEmbedder(4))

    def state(self, config=None):
        store = Store(self.spark, (config or self.config).output_dir)
        columns = {"documents": ["documentId", "filePath", "contentHash"], "chunks": ["chunkId", "chunkText"], "embeddings": ["embeddingId", "chunkId"]}
        return {t: sorted(map(tuple, store.load(t).select(*c).collect())) for t, c in columns.items()}

    def rebuilt(self, folder):
        fresh = configs.Config(input_dir=str(self.dir), output_dir=str(folder), chunk_size=40, overlap=5)
        run(self.spark, fresh, HashEmbedder(4))
        return self.state(fresh)


def test_runs_converge_to_a_rebuild(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    for n in range(3):
        c.put(f"d{n}.pdf", f"document {n} " * 10)
    first = c.run()
    assert first.first_run and first.changes["new"] == 3 and first.embedded == first.rows["chunks"]
    again = c.run()
    assert not again.committed and again.dedup_ratio == 100.0
    c.put("d1.pdf", "document 1 " * 5 + "edited")
    c.put("d3.pdf", "document 3 " * 10)
    (c.dir / "d0.pdf").rename(c.dir / "renamed.pdf")
    (c.dir / "upper.PDF").write_bytes(make_pdf("left out"))
    second = c.run()
    assert second.changes == {"new": 2, "changed": 1, "unchanged": 1, "deleted": 1}
    assert 0 < second.embedded < second.rows["chunks"]
    assert c.state() == c.rebuilt(tmp_path / "rebuilt")


def test_emptied_corpus_is_stored(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    c.put("a.pdf", "some text here")
    c.put("blank.pdf", "   ")
    c.run()
    for p in c.dir.iterdir():
        p.unlink()
    gone = c.run()
    assert gone.committed and gone.changes["deleted"] == 2 and gone.rows == {"documents": 0, "chunks": 0, "embeddings": 0}
    assert not c.run().committed


def test_first_run_over_nothing(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    assert c.run().rows == {"documents": 0, "chunks": 0, "embeddings": 0}


def test_unreadable_file_is_not_a_deletion(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    c.put("a.pdf", "some text here")
    c.put("b.pdf", "other text here")
    c.run()
    before = c.state()
    (c.dir / "a.pdf").write_bytes(b"no pdf at all")
    report = c.run()
    assert report.failed == 1 and not report.committed and c.state() == before


def test_missing_folder_raises(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        run(spark, configs.Config(input_dir=str(tmp_path / "nowhere"), output_dir=str(tmp_path / "out")), HashEmbedder(4))


def test_crash_before_the_commit_leaves_the_old_state(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    c.put("a.pdf", "some text here")
    c.run()
    before = c.state()
    c.put("b.pdf", "other text")

    class Broken:
        model = "broken"

        def embed(self, chunks):
            raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        run(spark, c.config, Broken())
    assert c.state() == before
    c.run()
    assert c.state() == c.rebuilt(tmp_path / "rebuilt")


def test_store_keeps_versions_and_text_ids(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    for n in range(4):
        c.put("007.pdf", f"text number {n}")
        c.run()
    store = Store(spark, c.config.output_dir)
    assert len(store.history()) == 2 and store.load("documents").head().documentId == "007"
    assert store.table_exists("chunks") and not store.index_exists()
    now = store.current()
    assert store.load("documents", now["previous"]).head().content.endswith("2")
    with pytest.raises(RuntimeError):
        store.commit("00000099-none", {})


def test_rows_lost_after_the_write_stop_the_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "out"))
    run_id = store.begin()
    for t, schema in TABLES.items():
        store.write(run_id, t, spark.createDataFrame([], schema))
    store.write(run_id + "x", "documents", spark.range(3).selectExpr("cast(id as string) documentId", "'' filePath", "'' fileName", "'' content", "'' contentHash", "0L processedAt", "'' version"))
    assert store.written[run_id + "x", "documents"] == 3 and store.commit(run_id, {})["rows"] == {t: 0 for t in TABLES}
    store.written[run_id, "chunks"] = 1
    with pytest.raises(RuntimeError, match="chunks"):
        store.verify(run_id)


@pytest.mark.parametrize("compress", [False, True])
def test_pdf_text(compress, tmp_path):
    data = make_pdf("Hello (PDF) é", compress)
    assert pdf.extract_text_from_bytes(data).strip() == "Hello (PDF) é"
    (tmp_path / "x.pdf").write_bytes(data)
    assert pdf.extract_text(str(tmp_path / "x.pdf")).strip() == "Hello (PDF) é"
    with pytest.raises(ValueError):
        pdf._plain_text(b"garbage")


def test_quarantine(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(make_pdf("fine"))
    (tmp_path / "bad.pdf").write_bytes(b"bad")
    documents, bad = files.scan_documents(spark, str(tmp_path), id_mode="path_hash")
    assert documents.head().documentId.startswith("doc_")
    assert bad.head().filePath.endswith("bad.pdf") and "ValueError" in bad.head().error


@pytest.fixture
def server():
    calls, fail = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(request["prompt"])
            if fail:
                self.send_response(fail.pop())
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [len(request["prompt"]), 1]}).encode())

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", calls, fail
    made.shutdown()


def test_http_embedder(spark, server):
    url, calls, fail = server
    chunks = spark.createDataFrame([("c1", "d", "abc"), ("c2", "d", "abcd")], "chunkId string, documentId string, chunkText string")
    fail.append(503)
    rows = {r.chunkId: r.embeddingVector for r in HttpEmbedder(url, "m", wait_s=0.01).embed(chunks).collect()}
    assert rows == {"c1": [3.0, 1.0], "c2": [4.0, 1.0]} and len(calls) == 3
    fail.append(400)
    with pytest.raises(Exception, match="400"):
        HttpEmbedder(url, "m").embed(chunks).collect()
    assert EmbeddingClient(url).test_connection()
    assert not EmbeddingClient("http://127.0.0.1:9", timeout=1).test_connection()


def test_every_chunk_is_embedded_once(spark, server, tmp_path):
    url, calls, _ = server
    c = Corpus(spark, tmp_path)
    c.put("a.pdf", "a text that makes several chunks because it is long " * 3)
    report = run(spark, c.config, HttpEmbedder(url, "m"))
    assert len(calls) == report.embedded == report.rows["embeddings"] > 1


def test_stream_of_files(spark, tmp_path):
    c = Corpus(spark, tmp_path, app_name=f"stream-{tmp_path.name}")
    c.put("a.pdf", "first text")
    watch(spark, c.config, HashEmbedder(4)).awaitTermination()
    c.put("b.pdf", "second text")
    watch(spark, c.config, HashEmbedder(4)).awaitTermination()
    assert [r[0] for r in c.state()["documents"]] == ["a", "b"]


def test_failed_files_of_a_stream_are_kept_and_read_again(spark, tmp_path):
    c = Corpus(spark, tmp_path, app_name=f"stream-{tmp_path.name}")
    c.put("a.pdf", "first text")
    (c.dir / "b.pdf").write_bytes(b"no pdf at all")
    watch(spark, c.config, HashEmbedder(4)).awaitTermination()
    store = Store(spark, c.config.output_dir)
    assert [(r.filePath.rpartition("/")[2], r.error[:10]) for r in store.failed().collect()] == [("b.pdf", "ValueError")]
    assert [r[0] for r in c.state()["documents"]] == ["a"]
    assert retry(spark, c.config, HashEmbedder(4)).changes["new"] == 0 and store.failed().count() == 1
    c.put("b.pdf", "second text")
    assert retry(spark, c.config, HashEmbedder(4)).changes["new"] == 1 and store.failed().count() == 0
    assert [r[0] for r in c.state()["documents"]] == ["a", "b"] and retry(spark, c.config, HashEmbedder(4)) is None


def test_config(monkeypatch):
    monkeypatch.setenv("INPUT_DIR", "/x")
    assert configs.load(chunk_size=10, overlap=1).input_dir == "/x"
    for wrong in ({"chunk_size": 0}, {"overlap": 1000}, {"input_dir": ""}, {"document_id_mode": "x"}):
        with pytest.raises(ValueError):
            configs.Config(**wrong)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(make_pdf("some text"))
    assert main(["--offline", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--master", spark.sparkContext.master]) == 0
    assert "RunReport(first_run=True" in capsys.readouterr().out
