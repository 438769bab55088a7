from __future__ import annotations

from types import SimpleNamespace

import pytest

from caremeter.llm.common import shared_dir


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.rsplit(".", 1)[-1], default)))


def test_shared_folder_is_named_by_the_cluster():
    assert shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "s3a://b/x/", "spark.master": "yarn"}.get(key, default)))) == "s3a://b/x"
    assert shared_dir(session(master="local[8]")) and shared_dir(session(master="local"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,4000]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master=master))
