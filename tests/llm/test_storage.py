"""What intermediate tables leave on disk."""

import glob
import time

import numpy as np
import pyarrow as pa

from millrace.llm import common, graph
from millrace.llm import jaccard as J
from millrace.llm import sentencepiece_fst


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    out = common.materialise(spark.range(20_000).selectExpr("id % 5000 AS k").repartition(4, "k").groupBy("k").count(), "counts")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert out.count() == 5000 and spark.conf.get(common.CLEANUP, None) == setting


def test_components_keep_one_table_of_edges(spark):
    held = lambda: set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/*/edges-*"))
    before = held()
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    found = graph.components(edges)
    assert len(held() - before) == 1
    assert sorted((r.node, r.component) for r in found.collect()) == [(i, 0) for i in range(41)]


def test_long_texts_are_stated_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(120)),) for i in range(12)], "text string").coalesce(1)
    frequent = np.empty(0, np.uint64)
    whole = J._statements(docs, 3, 90, 100, frequent).distinct().collect()
    monkeypatch.setattr(J, "STATED", 40)
    parts = J._statements(docs, 3, 90, 100, frequent).distinct().collect()
    assert sorted(whole) == sorted(parts) and len({r.set_id for r in parts}) == 12


def test_workers_forget_what_another_operator_kept(spark):
    texts = spark.range(64).selectExpr("concat('some words ', id) AS text").repartition(16)

    def loaded(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepiece_fst._LOADED)])], names=["n"])

    assert sentencepiece_fst.encode_decode(texts).where("round_trip").count() == 64
    assert sum(r.n for r in texts.mapInArrow(loaded, "n long").collect()) > 0
    assert sum(r.n for r in texts.mapInArrow(common.tidy(loaded), "n long").collect()) == 0
