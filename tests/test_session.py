from types import SimpleNamespace

import pytest

from cuesheet.session import shared_folder, ship_package


def session(named, master):
    chosen = []
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: chosen[-1] if chosen else None,
        setCheckpointDir=chosen.append,
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


def test_the_cluster_names_the_shared_folder():
    assert shared_folder(session("hdfs://shared/x", "yarn")) == "hdfs://shared/x"


def test_only_a_local_session_makes_its_own():
    local = session(None, "local[4]")
    assert shared_folder(local) == shared_folder(local)
    assert shared_folder(local).startswith("/tmp/spark-")
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))


def test_executors_get_the_package_once(spark):
    ship_package(spark)
    ship_package(spark)
    assert sum(f.endswith("cuesheet.zip") for f in spark.sparkContext.listFiles) == 1
