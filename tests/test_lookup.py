"""Lookups that read little, the packed sink, gated ingest and inference in halves."""

import glob
import json
import os
import shutil

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import batching, inference, profile
from millrace.sources import fixtures, lookup, packs
from millrace.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_a_lookup_opens_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "by-id")
    df = spark.range(200_000).select(F.format_string("id%09d", F.col("id") * 17 % 200_000).alias("id"), (F.col("id") % 7).alias("x"), F.repeat(F.lit("y"), 20).alias("text"))
    lookup.write_by_id(df, path, files=4, group_rows=5000)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/*.parquet")]
    assert sum(groups) >= 40
    ids = spark.createDataFrame([(f"id{i:09d}",) for i in (3, 77_777, 77_778, 150_001)] + [("absent",), (None,), ("id000000003",)], "id string")
    found = lookup.lookup_by_id(spark, path, ids, columns=["x"])
    assert sorted(r.id for r in found.collect()) == ["id000000003", "id000077777", "id000077778", "id000150001"]
    assert lookup.rows_scanned(lookup.lookup_by_id(spark, path, ids)) < 20_000
    assert lookup.rows_scanned(spark.read.parquet(path)) == 200_000
    joined = lookup.lookup_by_id(spark, path, ids, columns=["x"], named=2)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))
    assert lookup.lookup_by_id(spark, path, ids.limit(0)).count() == 0


def test_shards_after_the_last_find_are_not_read(spark, tmp_path):
    root = str(tmp_path / "shards")
    rows = [("a", f"i{k}", k % 10, k) for k in range(100)] + [("b", f"i{k}", k % 4, k) for k in range(40)] + [("a", "i3", 7, 1000)]
    df = spark.createDataFrame(rows, "config string, id string, shard int, x long")
    lookup.write_shards_apart(df, root)
    # The shards that nothing may open are destroyed.
    for k in (0, 1, 2, 3, 4, 6, 9):
        for f in glob.glob(f"{root}/config=a/shard={k}/*.parquet"):
            with open(f, "wb") as out:
                out.write(b"not parquet")
    wanted = spark.createDataFrame([("a", "i5"), ("a", "i15"), ("a", "i7"), ("a", "i88"), ("b", "i0"), ("b", "zz"), ("b", "zz")], "config string, id string")
    hints = spark.createDataFrame([("a", 8), ("a", 5), ("a", 7)], "config string, shard int")
    out = lookup.find_in_waves(spark, root, wanted, hints, 3)
    assert sorted((r.config, r.id, r.shard, r.x) for r in out.found.collect()) == [("a", "i15", 5, 15), ("a", "i5", 5, 5), ("a", "i7", 7, 7), ("a", "i88", 8, 88), ("b", "i0", 0, 0)]
    assert [tuple(r) for r in out.missing.collect()] == [("b", "zz")]
    assert sorted((r.config, r.shard) for r in out.read.collect()) == [("a", 5), ("a", 7), ("a", 8), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]


def test_of_rows_of_one_id_the_first_shard_in_order_wins(spark, tmp_path):
    root = str(tmp_path / "shards")
    rows = [("a", "i", s, s * 10 + k) for s in range(4) for k in (1, 0)]
    lookup.write_shards_apart(spark.createDataFrame(rows, "config string, id string, shard int, x long"), root)
    wanted, hints = spark.createDataFrame([("a", "i")], "config string, id string"), spark.createDataFrame([("a", 2)], "config string, shard int")
    out = lookup.find_in_waves(spark, root, wanted, hints, 2, ("x",))
    assert [(r.shard, r.x) for r in out.found.collect()] == [(2, 20)]
    none = lookup.find_in_waves(spark, root, wanted.limit(0), hints, 2)
    assert none.found.count() == none.missing.count() == none.read.count() == 0
    absent = lookup.find_in_waves(spark, root, spark.createDataFrame([("z", "i")], "config string, id string"), hints, 2)
    assert absent.found.count() == absent.read.count() == 0 and absent.missing.count() == 1


def pack_rows(spark, n):
    rows = [(("dev", "test", "", None)[i % 4], i, bytes([i % 256]) * (50 + i % 7), f"t{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "split string, pos long, audio binary, text string")


def test_packs_have_names_groups_index_and_footer(spark, tmp_path):
    rows, df = pack_rows(spark, 400)
    path = str(tmp_path / "packs")
    packs.pack(df, path, "audio", shard_mb=0.003, row_group_mb=0.0005, footer={"features": json.dumps({"audio": "Audio"})})
    names = sorted(os.listdir(path))
    back = []
    for split in ("dev", "test", "train"):
        own = [r for r in rows if (r[0] or "train") == split]
        shards, held, size = [], [], 0
        for r in own:
            held.append(r)
            size += len(r[2])
            if size >= 3000:
                shards.append(held)
                held, size = [], 0
        shards += [held] if held else []
        for i, shard in enumerate(shards):
            name = f"{split}-{i:05d}-of-{len(shards):05d}.parquet"
            back.append(name)
            f = pq.ParquetFile(f"{path}/{name}")
            per = max(int(500 / (sum(len(r[2]) for r in shard) / len(shard))), 1)
            assert [f.metadata.row_group(g).num_rows for g in range(f.num_row_groups)] == [min(per, len(shard) - at) for at in range(0, len(shard), per)]
            assert f.read().column("pos").to_pylist() == [r[1] for r in shard] and f.metadata.row_group(0).column(0).has_column_index
            assert json.loads(f.metadata.metadata[b"features"]) == {"audio": "Audio"} and "split" not in f.schema_arrow.names
    assert names == sorted(back)
    packs.pack(df.where("pos < 8"), path, "audio")
    assert sorted(os.listdir(path)) == [f"{s}-00000-of-00001.parquet" for s in ("dev", "test", "train")]


def test_a_failed_task_leaves_no_pack(spark, tmp_path):
    path = str(tmp_path / "packs")
    writer = packs._Writer(path, {}, True)
    rows, df = pack_rows(spark, 40)
    packs.pack(df, path, "audio")
    kept = sorted(os.listdir(path))
    control = df.selectExpr("pos", "audio", "'x' AS _pack_split", "0 AS _pack_shard", "1 AS _pack_shards", "5 AS _pack_rows", "0 AS _pack_file").toArrow().to_batches()

    def failing():
        yield control[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.write(iter(control))  # another task of the same job had written its shard
    writer.abort([])
    assert sorted(os.listdir(path)) == kept


def test_files_count_once_two_looks_agree(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    taken = []

    def step(number):
        ingest.ingest_stable(spark, str(source), f"{root}/listings", f"{root}/checkpoint", number, lambda paths, k: taken.extend(os.path.basename(p) for p in paths), "*.bin")

    def put(name, size):
        (source / name).write_bytes(b"x" * size)

    put("a.bin", 10), put("empty.bin", 0), put("c.txt", 5)
    step(1)
    assert taken == []
    put("b.bin", 4)
    step(2)
    assert taken == ["a.bin"]
    put("b.bin", 9), put("a.bin", 99)
    step(3)
    assert taken == ["a.bin"]  # b has grown, and what was taken is not taken again
    step(4)
    step(5)
    assert taken == ["a.bin", "b.bin"]


def test_a_streamed_profile_is_the_batch_profile(spark, tmp_path):
    rows = fixtures.segments(spark, SF)
    stream = ingest.ProfileStream(spark, str(tmp_path / "in"), str(tmp_path / "out"), rows.schema)
    for k in range(3):
        rows.where(F.col("doc_id") % 3 == k).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream.step()
        stream.step()
    assert len(glob.glob(str(tmp_path / "out/states/*"))) == 3
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(profile.profile_of(stream.state())) == plain(profile.profile(rows))


def test_a_model_that_refuses_large_batches_sees_every_row_once(spark):
    rows = [("ab"[i % 2] if i % 5 else None, str(i), float(i % 13 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "config string, id string, duration double")
    cut = batching.length_buckets(df, 60.0)

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) > 3:
            raise MemoryError
        assert batch[["config", "batch"]].drop_duplicates().shape[0] == 1
        return batch[["id"]].assign(n=len(batch))

    got = inference.infer(cut, model, "id string, n long").collect()
    assert sorted(r.id for r in got) == sorted(r[1] for r in rows) and max(r.n for r in got) <= 3
    frames = [pd.DataFrame({"k": [1, 1, 2]}), pd.DataFrame({"k": [2, None]}), pd.DataFrame({"k": [None, 3.0]})]
    assert [len(b) for b in inference.whole_batches(iter(frames), ("k",))] == [2, 2, 2, 1]
    with pytest.raises(MemoryError):
        list(inference.in_halves(lambda b: (_ for _ in ()).throw(MemoryError()), pd.DataFrame({"k": [1, 2]})))


@pytest.mark.parametrize("rate, wanted", [(16_000, 24_000), (24_000, 16_000), (8_000, 16_000), (44_100, 22_050)])
def test_resampling_keeps_tones_and_levels(spark, rate, wanted):
    n = 900
    tone = np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    df = spark.createDataFrame([(tone.tolist(), [0.5] * n, [], [1.0])], "x array<double>, flat array<double>, none array<double>, one array<double>")
    r = df.select(*[A.resample(F.col(c), rate, wanted).alias(c) for c in df.columns]).first()
    want = np.sin(2 * np.pi * 440 * np.arange(len(r.x)) / wanted)
    edge = 60
    assert len(r.x) == -(-n * wanted // rate) and r.none == [] and len(r.one) == -(-wanted // rate)
    assert np.abs(np.array(r.x)[edge:-edge] - want[edge:-edge]).max() < 0.01 and np.allclose(np.array(r.flat)[edge:-edge], 0.5)
    assert df.select(A.resample(F.col("x"), rate, rate).alias("x")).first().x == tone.tolist()


def test_scratch_is_gone_with_its_application(spark):
    path = lookup.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    shutil.rmtree(path.removeprefix("file:"))
