"""Scratch folder rules."""

from types import SimpleNamespace

import pytest

from wheeltrace import session as Se


def fake(conf, master, checkpoint=None):
    sc = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=sc)


def test_named_folder_wins():
    assert Se.scratch_root(fake({"spark.checkpoint.dir": "hdfs:///x/"}, "yarn", "other")) == "hdfs:///x"
    assert Se.scratch_root(fake({}, "yarn", "hdfs:///y")) == "hdfs:///y"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError):
        Se.scratch_root(fake({}, "spark://host:7077"))


def test_local_folder_is_reused():
    assert Se.scratch_root(fake({}, "local[4]")) == Se.scratch_root(fake({}, "local[2]"))


def test_materialize_keeps_rows_and_types(spark):
    df = spark.sql("select 1L as a, cast(null as double) as b, array(1, 2) as c")
    out = Se.materialize(df)
    assert out.collect() == df.collect() and out.dtypes == df.dtypes and Se.size_in_bytes(out) > 0
