from types import SimpleNamespace

import pytest

from lectern.plans.session import configure
from lectern.sinks.scratch import shared_folder


def test_the_callers_session_is_left_alone(spark):
    mine = spark.newSession()
    mine.conf.set("spark.sql.shuffle.partitions", "3")
    before = mine.conf.get("spark.sql.constraintPropagation.enabled")
    own = configure(mine)
    assert own.conf.get("spark.sql.shuffle.partitions") == "3"
    assert own.conf.get("spark.sql.constraintPropagation.enabled") == "false"
    assert mine.conf.get("spark.sql.constraintPropagation.enabled") == before
    assert own.range(5).filter("id > 2").count() == 2


def session(master, folder=None, checkpoint=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


def test_scratch_tables_need_a_shared_folder():
    assert shared_folder(session("spark://x:7077", "file:///shared/")) == "file:///shared"
    assert shared_folder(session("spark://x:7077", None, "hdfs://a/b")) == "hdfs://a/b"
    assert "lectern-" in shared_folder(session("local[4]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            shared_folder(session(master))


def test_partitions_of_exchanges_follow_the_size_of_what_is_read(spark, tmp_path, monkeypatch):
    from lectern.operators.match import spread
    from lectern.plans import inputs, session

    spark.range(20_000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 2) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 16)
    own = session.configure(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = inputs.table(own, str(tmp_path), "documents")
    assert int(own.conf.get("spark.sql.shuffle.partitions")) > 10 and spread(rows, "doc_id").rdd.getNumPartitions() > 10
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
