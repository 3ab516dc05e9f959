from __future__ import annotations

from types import SimpleNamespace

import pytest

from runloom.session import durable, new_folder, shared_folder


def session(configured, master="local[2]", set_already=None):
    """A stand-in for a session with the given settings."""
    context = SimpleNamespace(master=master, folder=set_already)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda folder: setattr(context, "folder", folder)
    conf = SimpleNamespace(get=lambda key, default: configured if configured else default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_configured_folder_is_used():
    assert shared_folder(session("hdfs://x/ckpt/")) == "hdfs://x/ckpt"
    assert shared_folder(session(None, "yarn", "hdfs://y")) == "hdfs://y"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "spark://host:7077"))


def test_a_local_session_gets_its_own_folder(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    local = session(None)
    folder = shared_folder(local)
    assert folder.startswith(str(tmp_path)) and shared_folder(local) == folder
    assert new_folder(local, "x") != new_folder(local, "x")


def test_durable_is_evaluated_once(spark):
    from pyspark.sql import functions as F

    kept = durable(spark.range(100).withColumn("r", F.rand()))
    assert kept.exceptAll(kept).count() == 0
    assert [row.r for row in kept.orderBy("id").collect()] == [row.r for row in kept.orderBy("id").collect()]
    assert kept.schema.simpleString() == "struct<id:bigint,r:double>"


def test_the_owner_can_delete_what_was_written(spark, monkeypatch):
    from runloom import session as module

    monkeypatch.setattr(module, "_MADE", [])
    kept = durable(spark.range(10))
    assert kept.count() == 10 and len(module._MADE) == 1
    folder = module._MADE[0]
    assert module.drop_folders(spark) == 1 and module._MADE == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
