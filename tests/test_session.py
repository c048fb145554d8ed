import pytest

from twinraster import session


class Context:
    def __init__(self, master, settings):
        self.master, self.settings = master, settings

    def getConf(self):
        return self.settings


class Conf(dict):
    def set(self, key, value):
        assert not key.startswith("spark."), "a running session refuses these"
        self[key] = value


class Session:
    def __init__(self, master, settings=()):
        self.conf, self.sparkContext = Conf(settings), Context(master, dict(settings))


def test_the_configured_folder_wins():
    assert session.shared_folder(Session("spark://host:7077", [("spark.checkpoint.dir", "hdfs:///x")])) == "hdfs:///x"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session(master))


def test_a_local_session_keeps_one_folder_of_its_own():
    local = Session("local[4]")
    assert session.shared_folder(local) == session.shared_folder(local) == local.conf["twinraster.checkpoint.dir"]


def test_the_real_session_has_a_folder(spark):
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
    assert session.cut(spark.range(3)).count() == 3
