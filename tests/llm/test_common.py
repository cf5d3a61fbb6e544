"""The shared folder and what operators leave in it."""

import os

import pytest

from vaultspark.llm import common


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert "://" in common.shared_dir(spark)


def test_clean_up_removes_what_was_cut(spark):
    df = common.cut(spark.range(5), "test-cut")
    path = df._cut_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    common.clean_up(spark)
    assert not os.path.exists(path) and not common.written()


def test_names_of_file_systems(tmp_path):
    fs, at = common.arrow_fs(f"file://{tmp_path}/x")
    assert at == f"{tmp_path}/x" and common.arrow_fs(f"{tmp_path}/x")[1] == at
    with pytest.raises(ValueError, match="viewfs"):
        common.arrow_fs("viewfs://store/x")
