import os
from types import SimpleNamespace

import pytest

from cairn import session


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(SimpleNamespace(sparkContext=context, conf=conf))
    named = SimpleNamespace(get=lambda *_: "hdfs://shared")
    context = SimpleNamespace(getConf=lambda: named, master="yarn")
    assert session.work_dir(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs://shared"


def test_tables_are_removed(spark):
    path = lambda df: df._cairn_path.removeprefix("file://")
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch():
        inside = session.materialize(spark.range(5), "inside")
        assert inside.count() == 5 and os.path.exists(path(inside))
    assert not os.path.exists(path(inside)) and kept.count() == 3
    session.discard(kept, spark.range(1))
    assert not os.path.exists(path(kept))
    session.discard(kept)
