import os

import pytest

from panelforge.operators.durable import Store, shared_dir


def test_tables_are_written_once_and_deleted(spark):
    store = Store(spark)
    rows = store(spark.range(5).selectExpr("id AS k", "id * 2 AS v"))
    assert rows.columns == ["k", "v"] and rows.count() == 5 and not spark.catalog.listTables()
    path = store.paths[0].removeprefix("file:")
    assert path.startswith(shared_dir(spark).removeprefix("file:")) and os.path.isdir(path)
    assert store.discard() == 1 and not os.path.exists(path) and store.discard() == 0


def test_a_cluster_must_name_a_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
