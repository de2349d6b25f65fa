"""Order statistics by rounds of histograms, similarity statistics without pair rows, clusters and draws."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles, scoring, vectors


def by_key(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: sorted(v, key=lambda x: (math.isnan(x), x)) for k, v in out.items()}


def test_ranks_of_awkward_values(spark):
    rng = random.Random(3)
    hard = [float("inf"), -float("inf"), float("nan"), 0.0, -0.0, 5e-324, 1e-320, 1.7e308, -1.7e308, 1e-300, 2e-300]
    rows = [("a", rng.choice(hard)) for _ in range(300)] + [(None, rng.gauss(0, 1)) for _ in range(500)] + [("c", 7.0)] * 400 + [("d", None)]
    rows += [("e", 1.0 + i * 2.0**-52) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, value double")
    held = by_key(rows)
    wanted = [(k, r) for k, v in held.items() for r in {0, len(v) // 3, len(v) // 2, len(v) - 1, len(v) + 5}]
    got = {(r.key, r.rank): r.value for r in quantiles.order_statistics(df, spark.createDataFrame(wanted, "key string, rank long"), bins=8, small=4).collect()}
    want = {(k, r): held[k][r] for k, r in wanted if r < len(held[k])}
    assert got.keys() == want.keys()
    assert all(got[x] == want[x] or math.isnan(got[x]) and math.isnan(want[x]) for x in want)


def test_percentiles_match_numpy_and_weights_repeat_rows(spark):
    rng = np.random.default_rng(1)
    values = {k: rng.normal(size=n).round(2).tolist() for k, n in (("a", 1), ("b", 2), ("c", 999))}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "config string, duration double")
    got = {r.config: r for r in quantiles.linear_percentiles(df, {"p05": 0.05, "p5": 0.5, "p975": 0.975}).collect()}
    for k, vs in values.items():
        for name, q in (("p05", 5), ("p5", 50), ("p975", 97.5)):
            assert got[k][name] == pytest.approx(np.percentile(vs, q), abs=1e-12)
    assert got["none"].p5 is None and len(got) == 4
    counts = df.groupBy("config", "duration").agg(F.count("*").alias("times"))
    plain = {r.config: r.p for r in quantiles.floor_percentiles(df, {"p": 0.9}).collect()}
    told = {r.config: r.p for r in quantiles.floor_percentiles(counts, {"p": 0.9}, times="times").collect()}
    assert plain == told == {k: sorted(v)[int(0.9 * (len(v) - 1))] for k, v in values.items()}
    assert quantiles.floor_percentiles(df.limit(0), {"p": 0.5}).count() == 0


def test_a_million_distinct_values_of_one_key(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("config"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("duration"))
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    r = quantiles.linear_percentiles(df, {"low": 0.05, "mid": 0.5}).first()
    assert r.low == pytest.approx(np.percentile(values, 5)) and r.mid == pytest.approx(np.percentile(values, 50))


def clips_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, book string, vector array<double>")


@pytest.mark.parametrize("bins, small, block", [(2048, 4096, 1024), (4, 3, 16)])
def test_similarity_statistics_make_no_pairs(spark, bins, small, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.choice(["a", "b", "c"]) if i % 9 else None, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(70)]
    rows += [(70, "a", [0.0] * 5), (None, "a", [1.0] * 5), (71, "b", [1.0, 2.0]), (72, "b", [2.0, 1.0]), (3, "a", [1.0] * 5)]
    df = clips_of(spark, rows)
    within, across = [], []
    kept = [(i, b, np.array(v)) for i, b, v in rows if i is not None and np.linalg.norm(v) > 1e-6]
    for (i, a, x), (j, b, y) in itertools.combinations(kept, 2):
        if len(x) == len(y) and i != j:
            (within if a is not None and a == b else across).append(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    got = {r.kind: r for r in vectors.similarity_stats(df, bins=bins, small=small, rows_per_block=block).collect()}
    for kind, values in (("within", within), ("across", across)):
        assert got[kind].n == 2 * len(values)
        assert got[kind].mean == pytest.approx(np.mean(values), abs=2e-6) and got[kind].p5 == pytest.approx(np.percentile(values, 5), abs=2e-6)
    one = vectors.auto_threshold(df, bins=bins, small=small, rows_per_block=block).first()
    assert one.threshold == pytest.approx(1 - np.percentile(within, 5), abs=2e-6)
    assert vectors.auto_threshold(df.where("book IS NULL")).first().threshold is None
    assert vectors.similarity_stats(df.limit(0)).count() == 0


def closest_first(x, threshold):
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        far = [(d[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)]
        least, i, j = min(far)
        if least >= threshold:
            break
        groups[i] += groups.pop(j)
    out = np.zeros(len(x), int)
    for g, members in enumerate(sorted(groups, key=min)):
        out[members] = g
    return out


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_is_the_closest_first_rule(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 6))
    for threshold in (0.2, 0.6, 0.9, 2.5):
        assert vectors.upgma(x, threshold).tolist() == closest_first(x, threshold).tolist()


def test_five_thousand_clips_cluster_in_seconds():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(250, 16)) for c in centres])
    began = time.time()
    labels = vectors.upgma(x, 0.5)
    assert time.time() - began < 60 and all(len(set(labels[i * 250 : i * 250 + 250])) == 1 for i in range(20))


def test_draws_are_poisson_and_each_row_has_its_own(spark):
    steps = scoring.poisson_steps()
    assert steps[0] == math.floor(math.exp(-1) * 2**32) and sum(1 - s / 2**32 for s in steps) == pytest.approx(1, abs=1e-6)
    # Rows that are alike are drawn apart: the sums of n of them vary as n draws do, not as one of n times the size.
    rows = [(1, 1, 4, 10)] * 400
    df = spark.createDataFrame(rows, "conv_id long, turn long, word_errors long, words long")
    odd = df.withColumn("word_errors", F.when(F.rand(3) < 0.5, 0).otherwise(8).cast("long"))
    odd = spark.createDataFrame(odd.collect(), df.schema)
    r = scoring.bootstrap_delta(odd, df, 200).first()
    spread = 2 * 1.96 * 0.4 / math.sqrt(400)
    assert 0.5 * spread < r.high - r.low < 2 * spread
    assert scoring.bootstrap_delta(odd, df, 200).first() == r


def test_similarity_statistics_hold_a_stripe_at_a_time(monkeypatch):
    """A task's memory is that of two blocks and a stripe of their products, not of all of these."""
    x, y = np.random.default_rng(1).normal(size=(100, 4)), np.random.default_rng(2).normal(size=(70, 4))
    monkeypatch.setattr(vectors, "NARROW", 8)
    held = [(at, c.copy(), c.base) for at, c in vectors._stripes(x, y)]
    assert max(c.shape[0] for _, c, _ in held) == 8 and len({id(b) for _, _, b in held}) == 1
    assert np.allclose(np.concatenate([c for _, c, _ in held]), x @ y.T)


def test_similarity_pairs_come_in_stripes(spark):
    df = clips_of(spark, [(i, "ab"[i % 2] if i % 5 else None, [float(i % 7 + 1), float(i % 3), 2.0]) for i in range(40)])
    whole, parts = (sorted((r.a, r.b, r.book_a or "", r.book_b or "", r.cosine) for r in vectors.similarity_pairs(df, block, stripe).collect()) for block, stripe in ((512, 64), (9, 2)))
    assert len(whole) == 40 * 39 // 2 and [r[:4] for r in whole] == [r[:4] for r in parts]
    assert np.allclose([r[4] for r in whole], [r[4] for r in parts])


def test_similarity_pairs_shuffle_no_copies(spark, capsys):
    """Blocks are read by the tasks that compare them, a pair at a time; before, each was shuffled as often as there are blocks."""
    df = clips_of(spark, [(i, "ab"[i % 2], [float(i % 7 + 1), float(i % 3), 2.0][: 3 - i % 2]) for i in range(60)])
    pairs = vectors.similarity_pairs(df, 6)
    pairs.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 2 * (30 * 29 // 2)
    assert vectors.similarity_pairs(df.limit(0), 6).count() == 0
