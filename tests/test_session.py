import pytest

from kestrel import session


class _Dir:
    def isDefined(self):
        return False


class _Context:
    """A Spark context as far as ``shared_dir`` looks at one."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self._jsc = self
        self.sc = lambda: self
        self.getCheckpointDir = lambda: _Dir() if self.folder is None else type("D", (), {"isDefined": lambda s: True, "get": lambda s: self.folder})()

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, folder=None):
        self.sparkContext = _Context(master)
        self.conf = type("C", (), {"get": lambda s, k, d=None: folder})()


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(_Session(master))
        assert session.shared_dir(_Session(master, "file:///shared")) == "file:///shared"
    assert "kestrel-cp-" in session.shared_dir(_Session("local[4]"))
