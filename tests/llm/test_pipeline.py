"""Every stage against a plain version of its decision, on the smallest tables and on a fixture with nulls."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import decontaminate as D
from millrace.llm import sentencepiece_fst as S

from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(9001, None, "en", "src0", 0), (9002, "12 34", None, None, 5), (9003, docs.where("doc_id = 3").first().text, None, "src1", 9)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "sentencepiece":
            assert at.columns == docs.columns
    first = seen["language_id"]
    assert set(before) - set(first) >= {9001, 9002} and len(first) >= 0.95 * len(before)
    second = seen["line_dedup"]
    assert set(second) == set(first) and all(r.n_chars == len(r.text) for r in second.values())
    own = [(d, r.text) for d, r in second.items()]
    component = {d: c for d, _, c in linked(own, 5, 80, 100)}
    third = seen["jaccard_dedup"]
    assert set(third) == {d for d, _ in own if component[d] == d} and 9003 not in third
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = [(d, r.text) for d, r in third.items() if any(t.split()[5] in r.text for _, t in items)]
    bad = {d for d, *_ in contaminated([x for x in near if len(x[1]) < 4000], items[:8])}
    fourth = seen["decontaminate"]
    assert set(fourth) <= set(third) and not bad & set(fourth)
    last = seen["sentencepiece"]
    with open(S.MODEL, "rb") as f:
        machine = S.Transducer(f.read())
    assert set(last) == set(fourth) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in last.values())
    for d in list(last)[:40]:
        merged = [machine.ids.get(p) for part in machine.parts(fourth[d].text) for p in machine.merged(part)[0]]
        assert None in merged or merged == last[d].token_ids


def test_run_and_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and got.count() > 50
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert D.drop_contaminated(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == docs.count()


def test_columns_of_any_name_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ["score", "Lang_Pred", "_millrace_lower", "_millrace_lang", "gone", "host", "set_id", "component_id", "n_tokens"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extra})
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
    rows = at.collect()
    assert len(rows) > 20 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == len(rows)


def test_batches_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (corpus_pipeline.decontaminated, corpus_pipeline.sentencepiece):
        spark.conf.unset(key)
        stage(spark, docs, SF)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4096).alias("text"))
        found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert max(found) < 3 << 19 and sum(found) >= 4000 * 4096
    spark.conf.unset(key)
