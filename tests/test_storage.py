from pathlib import Path

import pytest

from wakeline.functions.storage import forget, settle, shared_dir


def test_tables_are_written_to_the_shared_folder_and_can_be_forgotten(spark):
    forget(spark)
    rows = settle(spark.range(5), "five")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    assert rows.count() == 5 and len(list(folder.glob("wakeline-five-*"))) == 1
    assert forget(spark) == 1 and not list(folder.glob("wakeline-five-*"))


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            shared_dir(Session())
