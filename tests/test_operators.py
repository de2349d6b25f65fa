import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import batching, mixture, scoring, splits, stages, testset, vectors
from millrace.sources import fixtures, scans, sinks
from millrace.streaming import ingest

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_of_whole_texts(spark):
    from test_text import plain

    rows = scoring.utterance_errors(fixtures.pairs(spark, SF)).collect()
    assert len(rows) > 50
    for r in rows:
        ref, hyp = plain(r.reference), plain(r.hypothesis)
        assert r.word_errors == edits(ref.split(), hyp.split()) and r.words == len(ref.split())
        if len(ref) * len(hyp) < 60_000:
            assert r.char_errors == edits(ref.replace(" ", ""), hyp.replace(" ", ""))
        assert r.chars == len(ref.replace(" ", ""))


def test_scores_pool_and_macro_is_the_mean_of_rounded_rates(spark):
    rows = [("a", 1, 4, 2, 10, "a"), ("a", 0, 3, 0, 9, ""), ("b", 5, 3, 9, 8, None), ("c", 0, 0, 1, 0, "a")]
    df = spark.createDataFrame(rows, "config string, word_errors long, words long, char_errors long, chars long, language_pred string")
    got = {r.config: r for r in scoring.rollup(df).collect()}
    assert got["a"].wer == round(1 / 7, 4) and got["b"].wer == round(5 / 3, 4) and got["c"].wer == 0
    assert got["__micro__"].wer == 0.6 and got["__micro__"].n == 4
    assert got["__macro__"].wer == pytest.approx(round((0.1429 + 1.6667) / 3, 4), abs=1e-9)
    assert got["a"].lid_acc == 1.0 and got["b"].lid_acc is None
    one = scoring.matched_compare(df, df.where("config <> 'b'")).first()
    assert one.ours == one.theirs == 1 / 7


def test_bootstrap_covers_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", f"h{i}", "x", int(rng.poisson(3)), 10) for i in range(400)]
    df = spark.createDataFrame(rows, "reference string, hypothesis string, config string, word_errors long, words long")
    r = scoring.bootstrap_delta(df, df.where("word_errors < 3"), 300).first()
    true = np.mean([x[3] for x in rows]) / 10 - np.mean([x[3] for x in rows if x[3] < 3]) / 10
    assert r.low <= r.mean <= r.high and r.low < true < r.high and abs(r.mean - true) < 0.02


def test_splits_keep_groups_whole_and_rescue_a_test_book(spark):
    rows = [("a", f"b{i}", float(random.Random(i).randrange(1, 100))) for i in range(40)]
    rows += [("two", "x", 100.0), ("two", "y", 90.0), ("one", "z", 5.0), ("none", "u", 0.0), ("none", "v", 0.0), ("null", "w", None)]
    df = spark.createDataFrame(rows * 2, "config string, book string, duration double")
    got = splits.assign_groups(df).collect()
    by = {(r.config, r.book): r.split for r in got}
    assert len(got) == len(by) == len(rows)
    assert by["two", "y"] == "test" and by["two", "x"] == "train" and by["one", "z"] == "train"
    assert {by["none", "u"], by["none", "v"], by["null", "w"]} == {"train"}
    total = sum(d for c, _, d in rows if c == "a")
    part = sum(d for c, b, d in rows if c == "a" and by[c, b] == "test")
    assert 0.02 < part / total < 0.12


def test_targets_and_budget(spark):
    weights = spark.createDataFrame([("a", 100.0, 0.5), ("b", 10.0, 0.3), ("c", 80.0, 0.2)], "config string, avail double, weight double")
    got = {r.config: r for r in mixture.mixture_targets(weights, 120.0, 60.0).collect()}
    assert sum(r.target for r in got.values()) == pytest.approx(120, abs=0.5)
    assert got["b"].target == 10 and all(r.target <= min(60, r.avail) + 1e-9 for r in got.values())
    few = mixture.mixture_targets(weights, 1000.0, 60.0).collect()
    assert {r.config: r.target for r in few} == {"a": 60, "b": 10, "c": 60} and mixture.mixture_targets(weights.limit(0), 9.0, 9.0).count() == 0
    pool = spark.createDataFrame([("a", str(i), 10.0) for i in range(500)], "config string, id string, duration double")
    goal = spark.createDataFrame([("a", 1001 / 3600)], "config string, target double")
    assert mixture.select_to_budget(pool, goal).count() == 101


def test_test_sets_share_nothing_with_training(spark):
    rows = fixtures.segments(spark, SF)
    split_map = splits.assign_groups(rows)
    trained = rows.where("shard < 3").select("config", "id")
    pool = testset.pools(rows, split_map, trained, F.lit(True))
    assert pool.where("side = 'leaked'").join(trained, ["config", "id"], "left_semi").count() == 0
    assert pool.groupBy("config", "side", "id").count().where("count > 1").count() == 0
    taken = testset.sample(pool, 3, 2).groupBy("config", "side").count().collect()
    assert taken and all(r["count"] <= 3 for r in taken)


@pytest.mark.parametrize("most", [None, 3])
def test_batches_cost_at_most_the_budget(spark, most):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), str(i), float(rng.choice([1, 2, 2.5, 7, 30, 100]))) for i in range(300)] + [("z", "0", 0.0), ("z", "1", 5.0)]
    df = spark.createDataFrame(rows, "config string, id string, duration double")
    got = batching.length_buckets(df, 60.0, most).collect()
    assert len(got) == len(rows)
    want = {}
    for c in "abz":  # the plain rule, row by row
        batch, held = 0, 0
        for d, i in sorted((d, i) for k, i, d in rows if k == c):
            if held and (d * (held + 1) > 60 or (most and held >= most)):
                batch, held = batch + 1, 0
            held += 1
            want.setdefault((c, batch), []).append(d)
    have = {}
    for r in got:
        have.setdefault((r.config, r.batch), []).append(r.duration)
    assert {k: sorted(v) for k, v in have.items()} == want


def plain_batches(values, budget, most):
    out, batch, held = [], 0, 0
    for d in values:
        if held and (d * (held + 1) > budget or (most and held >= most)):
            batch, held = batch + 1, 0
        held += 1
        out.append(batch)
    return out


def test_rules_of_blocks_tell_the_batches_of_the_plain_fold():
    rng = random.Random(1)
    for _ in range(600):
        budget, most = rng.choice([1.0, 7.5, 60.0, 0.3]), rng.choice([None, 1, 3, 10])
        values = sorted(rng.choice([0, 0.1, 0.3, 1, 2, 2.5, 7, 30, 100]) for _ in range(rng.randrange(1, 80)))
        cuts = sorted(rng.sample(range(1, len(values)), min(len(values) - 1, rng.randrange(6)))) if len(values) > 1 else []
        blocks = [np.array(values[a:b], float) for a, b in zip([0, *cuts], [*cuts, len(values)])]
        starts = batching.batch_starts([(len(b), *batching.batch_rule(b, budget, most)) for b in blocks])
        got = [x for b, (held, batch) in zip(blocks, starts) for x in batching.block_batches(b, budget, most, held, batch).tolist()]
        assert got == plain_batches(values, budget, most)


def test_batches_of_a_key_over_many_blocks(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else None, i % 700 if i % 50 else None, rng.choice([None, float("nan"), 0.0, rng.random() * 20, 3.0, 7.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "config string, id long, duration double").repartition(5)
    got = batching.length_buckets(df, 40.0).collect()
    assert len(got) == len(rows)
    plain = lambda d: 0.0 if d is None or math.isnan(d) else d
    for key in ("hot", None):
        mine = sorted((r for r in got if r.config == key), key=lambda r: (plain(r.duration), -1 if r.id is None else r.id, r.batch))
        want = sorted((plain(d), -1 if i is None else i) for c, i, d in rows if c == key)
        assert [(plain(r.duration), -1 if r.id is None else r.id) for r in mine] == want
        assert [r.batch for r in mine] == plain_batches([d for d, _ in want], 40.0, None)


def test_size_shards(spark):
    sizes = [5, 5, 1, 20, 3, 3, 4, 1]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(sizes)], "config string, pos int, size long")
    assert [r.shard_id for r in batching.size_shards(df, 10).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2, 2, 3]


def plain_shards(sizes, limit):
    out, held, shard = [], 0.0, 0
    for s in sizes:
        out.append(shard)
        held += min(max(s, 0), limit)
        if held >= limit:
            shard, held = shard + 1, 0.0
    return out


def test_rules_of_blocks_tell_the_shards_of_the_plain_fold():
    rng = random.Random(8)
    for _ in range(400):
        limit = rng.choice([0, 1, 7, 50, 1000])
        blocks = [[min(rng.choice([0, 0, 1, 2, 3, 11, 60]), limit) for _ in range(rng.choice([1, 2, 9, 80]))] for _ in range(rng.randrange(1, 9))]
        rules = [batching.block_rule(np.array(b, float), limit) for b in blocks]
        starts = batching.block_starts(rules, limit)
        got = [s for b, (held, shard) in zip(blocks, starts) for s in batching.block_shards(np.array(b, float), limit, held, shard).tolist()]
        assert got == plain_shards([s for b in blocks for s in b], limit)
    whole, upto, count, rest = batching.block_rule(np.ones(1000), 10.0)
    assert whole == 1000 and len(upto) == 10


def test_size_shards_of_a_key_over_many_blocks(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else None, i if i % 50 else None, rng.choice([0, 1, 4, 9, 70, None])) for i in range(3000)] + [("nan", 2**60 + i, 5) for i in range(9)]
    df = spark.createDataFrame(rows, "config string, pos long, size long").repartition(5)
    got = batching.size_shards(df, 40).collect()
    for key in ("hot", None, "nan"):
        mine = sorted((r for r in got if r.config == key), key=lambda r: (-1 if r.pos is None else r.pos, r["size"] or 0))
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-1 if r[1] is None else r[1], r[2] or 0))
        assert [r["size"] or 0 for r in mine] == [r[2] or 0 for r in want]
        # Rows of one place and size are equal, so their shards are compared in order.
        shards = plain_shards([r[2] or 0 for r in want], 40)
        assert sorted((r.pos or -1, r["size"] or 0, r.shard_id) for r in mine) == sorted((r[1] or -1, r[2] or 0, s) for r, s in zip(want, shards))
    odd = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, -5.0), ("a", 3, float("inf")), ("a", 4, 2.0)], "config string, pos long, size double")
    assert [r.shard_id for r in batching.size_shards(odd, 3).orderBy("pos").collect()] == [0, 0, 0, 1]
    assert batching.size_shards(odd.limit(0), 3).count() == 0


def test_no_row_is_lost_or_doubled_in_batches(spark):
    rows = [("a", "1", None, 1), ("a", "2", 5.0, 1), ("a", "2", 5.0, 1), (None, "3", 5.0, None), ("a", "4", 7.0, None)]
    df = spark.createDataFrame(rows, "config string, id string, duration double, pos int")
    assert sorted(map(repr, (tuple(r)[:4] for r in batching.length_buckets(df, 12.0).collect()))) == sorted(map(repr, rows))
    cut = batching.size_shards(df.withColumn("size", F.col("duration")), 6.0).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in cut))) == sorted(map(repr, rows))
    assert sorted(r.shard_id for r in cut if r.config == "a") == [0, 1, 1, 1]


def test_word_edits_of_many_words(spark):
    a = [f"w{i}" for i in range(2000)]
    b = a[:100] + ["x"] + a[100:]
    df = spark.createDataFrame([(a[:400], b[:401]), (a, a), ([], ["q"]), (a, a[1500:])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(A.word_edits(F.col("a"), F.col("b"))).collect()] == [1, 0, 1, 1500]
    # The code points of words: far more than a text has, none of them a surrogate.
    assert A._FIRST_CODE > 0xDFFF and A._FIRST_CODE + A._CODES - 1 == 0x10FFFF


def test_small_functions(spark, tmp_path):
    wave = spark.createDataFrame([([32768.0, 0.0, 16384.0, 16384.0], 2), ([0.5, -0.5, 1.0], 1), ([], 2)], "x array<double>, c int")
    assert [r[0] for r in wave.select(A.mono(F.col("x"), F.col("c"))).collect()] == [[0.5, 0.5], [0.5, -0.5, 1.0], []]
    names = spark.createDataFrame([("NVIDIA A 100-SXM",), ("Tesla t4",), ("a10g",), ("cpu",), (None,)], "n string")
    got = [tuple(r) for r in names.select(*stages.device_class(F.col("n"))).collect()]
    assert got == [("A100", 312.0), ("T4", 65.0), ("A10G", 125.0), ("unknown", 65.0), ("unknown", 65.0)]
    one = spark.range(1).select(stages.real_time_factor(F.lit(2.0), F.lit(16000), F.lit(16000)).alias("f"), *stages.extrapolated_hours(F.lit(10), F.lit(3), F.lit(60.0), F.lit(65.0), F.lit(130.0))).first()
    assert tuple(one) == (2.0, 0.5, 0.25)
    rows = spark.createDataFrame([("a", "1", "xx"), ("a", "2", "yyyy"), ("b", "3", None)], "config string, id string, text string")
    told = {r.check: (r.status, r.detail) for r in stages.doctor(spark, {"manifest": rows, "splits": None}, {"testset": None}, {"manifest": ["id", "audio"]}).collect()}
    assert told == {"manifest": ("ok", "3 rows, 2 configs"), "splits": ("FAIL", "missing"), "testset": ("WARN", "missing"), "manifest columns": ("FAIL", "missing ['audio']")}
    (tmp_path / "d.json").write_text('{\n "a": {"b": 1},\n "c": [1, 2]\n}')
    assert scans.read_document(spark, f"{tmp_path}/d.json").select("a.b", "c").first() == (1, [1, 2])
    rows.repartition(3).write.parquet(f"{tmp_path}/parts")
    sinks.merge_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/one", 1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1 and spark.read.parquet(f"{tmp_path}/one").count() == 3
    assert scans.directory_size(spark, f"{tmp_path}/one") == sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet"))
    assert sinks.row_group_bytes(rows, "text", 0.000012) == 12 and sinks.row_group_bytes(rows.limit(0), "text", 1) == 1_000_000
    assert sinks.with_metadata(rows, "text", {"unit": "word"}).schema["text"].metadata == {"unit": "word"}
    assert sinks.split_header(["train", "dev"]).splitlines()[-1] == "    path: data/dev-*.parquet" and "- split: train" in sinks.split_header(["train"])
    many = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1)], "config string, pos int")
    parts = {(r.config, r.part): r["count"] for r in sinks.eval_cut(many, 5, "pos").groupBy("config", "part").count().collect()}
    assert parts == {("a", "eval"): 3, ("a", "train"): 57, ("b", "eval"): 1}


def test_shard_files_keep_the_limit(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 17 + 1) for i in range(900)] + [(7, None)], "id int, size int")
    sinks.write_shards(df, f"{tmp_path}/s", 500)
    per = [sum(r.size or 0 for r in spark.read.parquet(str(f)).collect()) for f in (tmp_path / "s").glob("*.parquet")]
    assert sum(per) == sum(i % 17 + 1 for i in range(900)) and max(per) < 500 + 17 and len(per) == sum(per) // 500 + 1
    assert spark.read.parquet(f"{tmp_path}/s").count() == 901
    sinks.write_shards(df, f"{tmp_path}/many", 500, block_rows=1)  # more ranges than rows
    many = [sum(r.size or 0 for r in spark.read.parquet(str(f)).collect()) for f in (tmp_path / "many").glob("*.parquet")]
    assert sorted(many) == sorted(per)


def test_split_source(spark, tmp_path):
    (tmp_path / "data" / "x" / "data").mkdir(parents=True)
    root = f"{tmp_path}/data/x/data"
    rows = [(bytearray(32044), " a ", "1500"), (bytearray(44 + 64000), "b", None), (bytearray(50), "c", "?"), (None, "d", "1"), (bytearray(b"z"), "  ", "1")]
    spark.createDataFrame([((a, "p"), t, d) for a, t, d in rows], "audio struct<bytes binary, path string>, text string, duration_ms string").coalesce(1).write.parquet(f"{root}/t")
    next((tmp_path / "data" / "x" / "data" / "t").glob("*.parquet")).rename(f"{root}/train-0.parquet")
    got = sorted((r.text, r.seconds) for r in scans.read_split(spark, root, "train").collect())
    assert got == [("a", 1.5), ("b", 2.0), ("c", 6 / 32000)]
    with pytest.raises(FileNotFoundError):
        scans.read_split(spark, root, "dev")
    (tmp_path / "data" / "x" / "data" / "n.bin").write_bytes(b"12")
    have, missing = scans.attach_files(spark.createDataFrame([("n.bin",), ("m.bin",)], "file string"), spark, root, "file")
    assert bytes(have.first().bytes) == b"12" and [r.file for r in missing.collect()] == ["m.bin"]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(3) * 10
    rows = [("c", i, (centres[i % 3] + rng.normal(0, 0.3, 3)).tolist()) for i in range(45)]
    df = spark.createDataFrame(rows, "config string, vec_id long, vector array<double>")
    got = {r.vec_id: r.cluster for r in vectors.cluster_clips(df, 0.3).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)
    blocks = vectors.similarity_pairs(df.withColumn("book", F.lit("b")), rows_per_block=7)
    assert blocks.count() == blocks.select("a", "b").distinct().count() == 45 * 44 // 2
    assert blocks.where("a >= b").count() == 0


def test_ctc(spark):
    df = spark.createDataFrame([([1, 1, 9, 1, 2, 2, 0, 0, 7, 9],), ([],), ([9, 9],)], "ids array<int>")
    chars = F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit("b"))
    assert [r[0] for r in df.select(A.ctc_decode(F.col("ids"), chars, 9, 0)).collect()] == ["aab", "", ""]


def test_scans_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a_eng", "1", "x", 2.0), ("b_fra", "2", "y", 3.0)], "config string, id string, text string, duration double")
    out = f"{tmp_path}/parts"
    sinks.write_partitions(rows, out)
    sinks.write_partitions(rows.withColumn("text", F.lit("new")).union(spark.createDataFrame([("c_deu", "3", "z", 1.0)], rows.schema)), out)
    back = {r.config: r.text for r in spark.read.parquet(out).collect()}
    assert back == {"a_eng": "x", "b_fra": "y", "c_deu": "z"}
    sinks.write_partitions(rows.where("id = '1'").withColumn("text", F.lit("new")), out, force=True)
    assert {r.config: r.text for r in spark.read.parquet(out).collect()} == {**back, "a_eng": "new"}
    for name in ("a_eng", "b_fra"):
        rows.where(F.col("config") == name).drop("config").write.parquet(f"{tmp_path}/root/{name}")
    found = scans.read_partitions(spark, f"{tmp_path}/root", ["id", "absent"])
    assert found.columns == ["config", "id"] and {tuple(r) for r in found.collect()} == {("a_eng", "1"), ("b_fra", "2")}
    assert {r.config for r in scans.files_by_partition(spark, f"{tmp_path}/root").collect()} == {"a_eng", "b_fra"}
    sinks.write_json_lines(rows, f"{tmp_path}/r.jsonl")
    assert scans.read_records(spark, f"{tmp_path}/r.jsonl").count() == 2
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "1.wav").write_bytes(b"1234")
    (tmp_path / "m.csv").write_text("file,sentence\n1.wav,a\n2.wav,b\n")
    listed = scans.read_csv(spark, f"{tmp_path}/m.csv", ["file", "sentence", "split"])
    have, missing = scans.attach_files(listed, spark, f"{tmp_path}/audio", "file")
    assert bytes(have.first().bytes) == b"1234" and [r.file for r in missing.collect()] == ["2.wav"]
    sinks.write_document(rows, f"{tmp_path}/doc", "config")
    sinks.write_routed(rows.withColumn("side", F.lit("honest")), f"{tmp_path}/routed")
    sinks.write_shards(rows.withColumn("size", F.lit(10)), f"{tmp_path}/shards", 10)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 2
    assert sinks.report(rows.orderBy("id"), {"config": 8, "id": 3}) == ["config  id", "a_eng   1", "b_fra   2"]
    fixed = scans.to_schema(rows.drop("text").withColumn("source_file", F.lit("GEN.1.2"))).first()
    assert (fixed.text, fixed.book, bytes(fixed.audio)) == ("", "GEN", b"")


def test_stages_go_on_after_a_failure():
    def fail():
        raise ValueError

    now = datetime(2030, 1, 1, tzinfo=timezone.utc)
    made = [stages.Stage("a", lambda: 1), stages.Stage("b", fail), stages.Stage("c", lambda: 1, needs=("b",)), stages.Stage("d", fail, lambda: True), stages.Stage("e", lambda: 1, minutes=90)]
    got = stages.run_stages(made, now + timedelta(hours=1), lambda: now)
    assert [s for _, s, _ in got] == ["ok", "FAILED", "skipped (deps)", "skipped", "skipped (clock)"]
    assert stages.deadline("2030-01-01T00:00:00Z") == stages.deadline("2030-01-01T00:00:00") == now


def test_ingest_takes_each_file_once(spark, tmp_path):
    def put(n):
        spark.createDataFrame([("a", n)], "config string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    args = (spark, f"{tmp_path}/in", "config string, n int", f"{tmp_path}/out", f"{tmp_path}/check")
    put(1)
    ingest.ingest_new_files(*args)
    put(2)
    ingest.ingest_new_files(*args)
    ingest.ingest_new_files(*args)
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    doubled = ingest.apply_model(spark.range(3), lambda parts: (pd.DataFrame({"y": p["id"] * 2}) for p in parts), "y long")
    assert sorted(r.y for r in doubled.collect()) == [0, 2, 4]


def test_similarity_pairs_over_blocks(spark):
    """Every pair once whatever the blocks; clips without an id, a length or the others' size meet nothing."""
    rows = [(i, str(i % 3), [float(i % 7 - 3), float(i % 5), float(i % 4 - 1)]) for i in range(60)]
    odd = [(None, "0", [1.0, 2.0, 3.0]), (97, "1", [0.0, 0.0, 0.0]), (98, None, [1.0, 1.0]), (99, "2", None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, book string, vector array<double>")
    want = {}
    for a, book_a, x in rows:
        for b, book_b, y in rows:
            n = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
            if a < b and n > 0:
                want[a, b] = (book_a, book_b, round(sum(v * w for v, w in zip(x, y)) / n, 9))
    for per_block in (512, 16, 3):
        got = [(r.a, r.b, r.book_a, r.book_b, round(r.cosine, 9)) for r in vectors.similarity_pairs(df, per_block).collect()]
        assert len(got) == len(want) and {(a, b): tuple(rest) for a, b, *rest in got} == want
    assert vectors.similarity_pairs(df.limit(0)).collect() == []


def test_spread_only_small_tables(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    assert scans.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in scans.spread(df).collect()) == list(range(1000))
    monkeypatch.setattr(scans, "SPLIT_BYTES", 10)
    assert scans.spread(df) is df
