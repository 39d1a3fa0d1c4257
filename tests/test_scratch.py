import pytest

from shardweave.sources import scratch


class FakeConf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class FakeContext:
    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"


class FakeSession:
    def __init__(self, value, master):
        self.conf, self.sparkContext = FakeConf(value), FakeContext(master)


def test_the_session_names_the_folder():
    assert scratch.fresh_path(FakeSession("s3://shared/x/", "yarn"), "a").startswith("s3://shared/x/a-")


def test_only_a_local_session_may_use_a_local_folder():
    session = FakeSession(None, "local[2]")
    assert scratch.shared_folder(session) == scratch.shared_folder(session)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(FakeSession(None, "spark://host:7077"))


def test_paths_are_never_used_twice(spark):
    assert scratch.fresh_path(spark, "x") != scratch.fresh_path(spark, "x")
