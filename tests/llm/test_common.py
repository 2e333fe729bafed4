"""What the operators share."""

import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import common, near_dup


def session(master, folder=None):
    own = {}
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder), getCheckpointDir=lambda: own.get("dir"), setCheckpointDir=lambda x: own.update(dir=x))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session("local-cluster[2,1,1024]"))
    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]"))


@pytest.mark.parametrize("x", [[], [0], [1, 2, 3], [255, 256], [2**40, 0, 7], [2**63 - 1]])
def test_planes(x):
    assert common.unplanes(common.planes(np.array(x, np.int64))).tolist() == x


def test_shards_keep_whole_documents_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(common, "DEAL_BYTES", 50)
    docs = [(i % 7 if i % 5 else None, f"text {i} é" * (i % 4)) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    dealt = common.deal(d, 4).collect()
    found = []
    for shard in range(4):
        blobs = [r.blob for r in dealt if r.shard == shard]
        assert common.documents(blobs) == common.documents(blobs[::-1])
        found += zip(*common.documents(blobs), strict=True)
    assert sorted(found) == sorted((common.NO_ID if i is None else i, t.encode()) for i, t in docs)


def test_batches_are_cut():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7))], ["x"])
    assert [b.num_rows for b in common.few_rows(iter([batch, batch.slice(0, 0)]), 3)] == [3, 3, 1, 0]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_alike(spark, how):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(9, 99)], "k long, v long")
    found = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, x string")
    hot = spark.createDataFrame([(0,), (5,)], "k long")
    want = sorted(rows.join(found, "k", how).collect(), key=repr)
    assert sorted(common.beside(rows, found, ["k"], hot, F.xxhash64("v"), how).collect(), key=repr) == want
    assert sorted(common.beside(rows, found, ["k"], hot.limit(0), F.xxhash64("v"), how).collect(), key=repr) == want


def test_shuffle_files_go_when_a_table_is_saved(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    conf, before = spark.conf.get(common.CLEANUP, None), shuffled()
    saved = common.save(spark, spark.range(1000).repartition(3, "id"), "dealt")
    assert not shuffled() - before
    assert saved.count() == 1000 and spark.conf.get(common.CLEANUP, None) == conf


def test_tables_on_the_way_go(spark):
    held = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    before, rows = held(), spark.range(5)
    with common.passing(spark) as outer:
        first = common.save(spark, rows, "first")
        with common.passing(spark, first) as keep:
            common.save(spark, first, "gone")
            inner = keep(common.save(spark, first, "inner"))
        assert {x.split("-")[0] for x in held() - before} == {"inner"}
        last = outer(common.save(spark, inner, "last"))
    assert {x.split("-")[0] for x in held() - before} == {"last"} and last.count() == 5
    with pytest.raises(ValueError), common.passing(spark):
        common.save(spark, rows, "lost")
        raise ValueError
    assert {x.split("-")[0] for x in held() - before} == {"last"}


def test_near_dedup_leaves_what_its_result_reads(spark):
    held = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    docs = spark.createDataFrame([(i, f"word{i // 2} " * 9) for i in range(10)], "doc_id long, text string")
    before = held()
    kept = near_dup.drop_near(docs)
    assert {x.split("-")[0] for x in held() - before} == {"kept"} and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8]
    before = held()
    found = near_dup.classes(docs)
    assert {x.split("-")[0] for x in held() - before} == {"ids", "node_classes", "hot"} and found.count() == 10
