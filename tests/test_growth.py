"""Steps whose cost must stay in proportion to their rows, and blocks that must stay bounded."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import edits, symbols
from millrace.operators import batching, splits, vectors
from millrace.plans.texts import BLANK, DONOR, SPACE, UNKNOWN


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_equal_the_table():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(90))] for _ in range(2))
        b = a[: r.randrange(len(a) + 1)] + b[:5] if r.random() < 0.3 else b
        assert edits.distance(a, b) == _table(a, b)


def test_ids_and_back_as_the_expressions_tell_them(spark):
    texts = ["ab  c", "", None, "zz é\U0001f600 -'|", "a" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    vocab = F.create_map(*[F.lit(x) for kv in DONOR.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in DONOR.items() if len(k) == 1 for x in (v, k)])
    plain = A.encode(F.filter(F.split("t", ""), lambda x: x != ""), vocab, UNKNOWN)
    ids = df.select("i", symbols.encode_text(F.col("t"), DONOR, UNKNOWN).alias("got"), plain.alias("want"))
    assert all(r.got == r.want for r in ids.collect())
    told = ids.select(symbols.ctc_text(F.col("want"), DONOR, BLANK, SPACE).alias("got"), A.ctc_decode(F.col("want"), back, BLANK, SPACE).alias("want"))
    assert all(r.got == r.want for r in told.collect())


def test_decoding_takes_time_in_proportion(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: (x % 7).cast("int")).alias("ids"))
    made = F.transform(F.col("ids"), lambda x: x + 1)  # an expression, which a lambda that names it would compute each time
    began = time.monotonic()
    assert df.select(F.length(A.ctc_decode(made, F.create_map(F.lit(1), F.lit("a")), 30, 0)).alias("n")).first().n > 0
    assert time.monotonic() - began < 20


def test_many_books_are_split_in_proportion(spark):
    books = spark.range(60_000).select(F.lit("a").alias("config"), F.col("id").cast("string").alias("book"), (F.col("id") % 50 + 1).cast("double").alias("duration"))
    began = time.monotonic()
    got = {r.split: r["count"] for r in splits.assign_groups(books).groupBy("split").count().collect()}
    assert time.monotonic() - began < 20
    assert sum(got.values()) == 60_000 and 0.04 < got["test"] / 60_000 < 0.06 and 0.04 < got["dev"] / 60_000 < 0.06


def test_batches_do_not_depend_on_the_rows_of_a_block(spark, monkeypatch):
    r = random.Random(3)
    rows = [("a" if i % 3 else "b", str(i), float(r.randrange(1, 30))) for i in range(900)]
    df = spark.createDataFrame(rows, "config string, id string, duration double")
    whole = sorted(map(tuple, batching.length_buckets(df, 60.0).collect()))
    monkeypatch.setattr(batching, "BLOCK_BITS", 5)
    assert sorted(map(tuple, batching.length_buckets(df, 60.0).collect())) == whole
    sizes = df.withColumn("size", F.col("duration")).withColumn("pos", F.col("id").cast("int"))
    small = sorted(map(tuple, batching.size_shards(sizes, 100.0).collect()))
    monkeypatch.setattr(batching, "BLOCK_BITS", 16)
    assert sorted(map(tuple, batching.size_shards(sizes, 100.0).collect())) == small


def test_clusters_by_rounds_are_the_closest_first_rule(spark):
    rng = np.random.default_rng(5)
    for d, threshold in ((3, 0.3), (6, 0.9)):
        x = rng.normal(size=(90, d))
        x[60:70] = x[:10]
        rows = [("a" if i % 2 else None, i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "config string, vec_id long, vector array<double>").repartition(5)
        want = {}
        for odd in (0, 1):
            want |= {i: c for i, c in zip(range(odd, 90, 2), vectors.upgma(x[odd::2], threshold).tolist())}
        got = vectors.cluster_clips(df, threshold, alone=4, per_block=10).collect()
        assert len(got) == 90 and {r.vec_id: r.cluster for r in got} == want
