import os
import shutil
import subprocess
import sys

import pytest

from tests.compare import same
from tests.conftest import SMALL
from tidemark import queries as core
from tidemark.operators import chunking


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, name, core.queries()[name], core.oracle_sql()[name], SMALL)


def test_every_query_runs_and_sql_names_queries(spark):
    assert set(core.oracle_sql()) <= set(core.queries())
    assert set(core.oracle_sql()) == set(core.queries())


def test_blank_pieces_are_not_counted(spark):
    df = spark.createDataFrame([("d", "a" + " " * 60 + "b")], "documentId string, content string")
    cut = chunking.pieces(df, "content", 20, 5)
    assert [r.piece_no for r in cut.orderBy("piece_no").collect()][-1] > 1
    assert [(r.chunk_index, r.piece) for r in chunking.indexed(cut, "documentId").orderBy("chunk_index").collect()] == list(enumerate(chunking.chunk_text("a" + " " * 60 + "b", 20, 5)))


def test_a_broken_subpackage_is_an_error(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemark" / "llm" / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_alone():
    """No module of the core imports the subpackage, and the entry does without it."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(f"{root}/tidemark", f"{folder}/tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", folder)
        code = "import __spark_entry__ as e; assert 'p2_found' in e.queries() and not any(k.startswith(('p1_', 'p8_')) for k in e.queries()), e.queries()"
        subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, env={**os.environ, "PYTHONPATH": folder}, timeout=120)
