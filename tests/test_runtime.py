import pytest

from dqspark.runtime import broadcast_if_small, ensure_checkpoint_dir, materialize


class FakeContext:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class FakeSession:
    def __init__(self, master, shared=None, current=None):
        self.sparkContext = FakeContext(master, current)
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}


def test_shared_folder_is_used_and_never_replaced():
    session = FakeSession("yarn", shared="hdfs:///shared")
    ensure_checkpoint_dir(session)
    assert session.sparkContext.current == "hdfs:///shared"
    session = FakeSession("yarn", shared="hdfs:///shared", current="hdfs:///other")
    ensure_checkpoint_dir(session)
    assert session.sparkContext.current == "hdfs:///other"


def test_private_folder_only_for_local_masters():
    session = FakeSession("local[2]")
    ensure_checkpoint_dir(session)
    assert session.sparkContext.current
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(FakeSession("spark://host:7077"))


def test_materialize_cuts_the_plan(spark):
    df = materialize(spark.range(10).selectExpr("id * 2 as x"))
    assert "Range" not in df._jdf.queryExecution().logical().toString() and df.count() == 10


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    hinted = lambda df, **bounds: "ResolvedHint" in broadcast_if_small(df, **bounds)._jdf.queryExecution().analyzed().toString()
    texts = spark.range(20).selectExpr("id", "repeat('x', 1000) as key")
    assert hinted(texts, max_rows=20, max_bytes=30_000) and hinted(texts.limit(0))
    assert not hinted(texts, max_rows=19) and not hinted(texts, max_bytes=20_000)
