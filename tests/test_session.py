from types import SimpleNamespace

import pytest

from sieveline import session


def _cluster(configured):
    conf = SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else default)
    hadoop = SimpleNamespace(get=lambda key: "file:///")
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("folder", ["/mnt/share/checkpoints", "file:///mnt/share/checkpoints", "hdfs://name/checkpoints"])
def test_a_cluster_uses_the_configured_folder_with_and_without_a_scheme(folder):
    assert session.shared_dir(_cluster(folder)) == folder


def test_a_cluster_without_a_configured_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_cluster(None))
