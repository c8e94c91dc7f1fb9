from types import SimpleNamespace

import pytest

from adhere import session


def _fake(master, **conf):
    return SimpleNamespace(
        sparkContext=SimpleNamespace(master=master),
        conf=SimpleNamespace(get=lambda key, default: conf.get("folder", default),
                             set=lambda key, value: conf.update(folder=value)))


def test_configured_folder_is_used():
    assert session.shared_folder(_fake("yarn", folder="hdfs://x/y")) == "hdfs://x/y"
    assert session.work_path(_fake("yarn", folder="hdfs://x/y/"), "p").startswith("hdfs://x/y/p-")


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_folder(_fake("spark://host:7077"))


def test_local_master_makes_one_folder():
    fake = _fake("local[2]")
    assert session.shared_folder(fake) == session.shared_folder(fake)
