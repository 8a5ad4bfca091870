import os

import pytest

from tidemark import session


def test_intermediate_tables_are_swept(spark):
    df = session.materialize(spark.range(5), "numbers")
    folder = session.scratch(spark)
    assert df.count() == 5 and folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.listdir(folder)
    session.sweep(spark)
    assert not os.path.exists(folder)


def test_discarded_tables_go_alone(spark):
    one, two = session.materialize(spark.range(5), "one"), session.materialize(spark.range(6), "two")
    folders = set(os.listdir(session.scratch(spark)))
    session.discard(one, spark.range(3))
    assert {f for f in folders if f.startswith("two")} <= set(os.listdir(session.scratch(spark))) < folders
    assert two.count() == 6
    parts = session.materialize(spark.range(20).selectExpr("id", "id % 3 as part"), "parts", "part")
    assert parts.columns == ["id", "part"] and parts.filter("part = 1").count() == 7
    session.discard(parts)
    assert not any(f.startswith("parts") for f in os.listdir(session.scratch(spark)))


def test_the_named_folder_is_used(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_cluster_must_name_a_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
