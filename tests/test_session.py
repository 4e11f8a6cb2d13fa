"""The shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from feedsieve.session import new_table_path, shared_dir, write_shared


def session(master, folder, current=None):
    """A stand-in with just what the folder is looked up from."""
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: current, setCheckpointDir=made.append
    )
    conf = SimpleNamespace(get=lambda key, default: folder)
    return SimpleNamespace(conf=conf, sparkContext=context), made


def test_the_folder_of_the_cluster_is_used():
    spark, made = session("yarn", "hdfs:///shared")
    assert shared_dir(spark) == "hdfs:///shared" and made == ["hdfs:///shared"]
    spark, made = session("yarn", "hdfs:///shared", current="hdfs:///shared/id")
    assert shared_dir(spark) == "hdfs:///shared" and made == []


def test_a_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077", None)[0])


def test_a_local_master_gets_a_temporary_folder(tmp_path):
    spark, made = session("local[2]", None)
    folder = shared_dir(spark)
    assert made == [folder] and "feedsieve-" in folder
    assert shared_dir(session("local[2]", None, str(tmp_path))[0]) == str(tmp_path)


def test_written_tables_stay_as_they_are(spark):
    random = spark.range(1000).withColumn("r", F.rand())
    written = write_shared(random, "random")
    assert sorted(written.collect()) == sorted(written.collect())
    assert written.schema.names == ["id", "r"]
    assert new_table_path(spark, "a") != new_table_path(spark, "a")
