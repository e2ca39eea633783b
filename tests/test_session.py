"""Where intermediates go."""

from types import SimpleNamespace

import pytest

from ledgerlens import session
from ledgerlens.plans.queries import _scratch


def _fake(master, conf=None):
    undefined = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(
        master=master, setCheckpointDir=lambda d: None,
        _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)))
    settings = dict(conf or {})
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=settings.get, set=settings.__setitem__))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_fake(master))
    assert session.ensure_checkpoint_dir(_fake(master, {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_a_local_session_makes_its_own(master):
    assert session.ensure_checkpoint_dir(_fake(master))


def test_query_outputs_lie_among_the_intermediates(spark):
    assert _scratch(spark, "x").startswith(session.materialised_dir(spark))
