import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk as T


def brute(rows, k):
    sound = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if q is not None and q % 20 == 0:
            s = sorted((-int(a @ b), 2**63 if i is None else i) for i, b in sound if i != q and len(b) == len(a))
            out += [(q, r + 1, None if i == 2**63 else i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_against_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(T, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(T, "QUERY_ROWS", 20)
    monkeypatch.setattr(T, "LEAF", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(600)]
    rows += [(600 + i, rows[20][1]) for i in range(60)]  # one very common vector
    rows += [(1000, None), (1020, [None] + [0.1] * 7), (1040, [float("nan")] + [0.1] * 7), (1060, [float("inf")] * 8), (None, [0.3] * 8)]
    rows += [(1080, [0.5, 0.25]), (1081, [0.5, -0.25]), (1100, [])]
    rows += [rows[40]] * 70 + [rows[41]] * 200  # repeated rows, of a query and of a candidate
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()), key=str)
    assert got == brute(rows, 20)
    assert T.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact():
    x = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 3.0]])
    row, ids, score = T.search(x, np.array([1, 2, 3]), x[:1], np.array([1]), 2, np.array([-np.inf]))
    assert ids.tolist() == [3, 2][::-1] and int(score[0]) == min(2**80 + 2, 2**63 - 1)


def test_few_leaves_are_opened_for_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (16, 4))
    x = np.floor(centres[np.arange(4096) % 16] + rng.normal(0, 1, (4096, 4)))
    seen = []
    plain = np.rint
    monkeypatch.setattr(T.np, "rint", lambda s: seen.append(s.shape) or plain(s))
    row, ids, score = T.search(x, np.arange(4096), x[:1], np.array([0]), 5, np.array([-np.inf]))
    want = sorted(zip(-(x @ x[0]), range(4096)))
    assert sorted(zip(-score, ids)) == [w for w in want if w[1] != 0][:5]
    assert sum(s[1] for s in seen) < 2048


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 100)
    sizes = []
    plain = T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name: sizes.append((name, df)) or plain(df, name))
    df = spark.createDataFrame([(20, [0.5, 0.25])] * 1500, "vec_id long, embedding array<double>")
    assert T.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    per = dict(sizes)["queries"].groupBy("shard").count().collect()
    assert len(per) == 15 and max(r["count"] for r in per) < 200
