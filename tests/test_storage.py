"""Intermediate tables: where they go, and that they go away."""

import os

import pytest

from stratalex import storage


class Conf:
    def get(self, key, default=None):
        return default


class Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, master):
        self.conf, self.sparkContext = Conf(), Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(master))


def test_local_masters_get_a_folder():
    for master in ("local", "local[4]", "local[*]"):
        session = Session(master)
        assert storage.shared_dir(session) == session.sparkContext.dir and os.path.isdir(session.sparkContext.dir.removeprefix("file://"))


def test_discard(spark):
    df = storage.materialise(spark.range(5), "five")
    path = df._stratalex_path.removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and os.path.isdir(path)
    storage.discard(df, spark.range(1))
    assert not os.path.exists(path)
