"""The shared folder must be named on a cluster."""

import pytest

from issuesift.session import ensure_checkpoint_dir


class Conf:
    def get(self, key, default=None):
        return default


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return Conf()


class Session:
    sparkContext, conf = Context(), Conf()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_no_private_folder_on_a_cluster(master, monkeypatch):
    monkeypatch.setattr(Context, "master", master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_the_named_folder_is_used(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
