import numpy as np

from millrace.llm import langid as L

TESTS = "/root/testdata/sf0.01"


def test_pair_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    net = L.ByteCNN(["a", "b", "c"])
    x = rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    want = np.zeros((5, 3))
    wide = max(L.WIDTHS)
    for i in range(5):
        e = net.embed[x[i]]
        s = [sum(e[p + o] @ net.conv[o] for o in range(wide)) for p in range(L.WINDOW - wide + 1)]
        z = np.maximum(np.max(s, axis=0) + net.bias, 0) @ net.dense + net.out
        want[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(net.probabilities(x), want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTS}/documents.parquet")
    out = L.op7(spark, TESTS).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r.lang == r.lang_pred for r in out if r.lang is not None]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    rows = [(i, f"der die das und {i} nicht auf dem weg" if i % 2 else f"the cat sat on {i} mats with that", "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "de"), (101, "", "en"), (102, "12 34 !", None), (103, "日本", None), (104, "the cat", None), (None, "und der", "de"), (104, "the cat", None)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double")
    net = L.train(df)
    got = {r.doc_id: r for r in L.predict(df, net).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred in ("de", "en")
    assert got[104].lang_pred == "en" and net.labels == ["de", "en"]
    bare = df.where("lang is null")
    empty = L.train(bare)
    assert {r.lang_pred for r in L.predict(bare, empty).collect()} == {"und"}
    assert L.predict(df.limit(0), net).count() == 0


def test_no_letter_is_und_in_training_and_prediction(spark):
    signs = ["½ ²", "Ⅷ ①", "৹ 12", "_ -", "٣"]
    rows = [(i, f"der die das und {i} nicht" if i % 2 else f"the cat sat on {i}", "de" if i % 2 else "en") for i in range(60)]
    rows += [(100 + i, t, "xx") for i, t in enumerate(signs)] + [(200, "ª", None), (201, "ʰ 5", None), (202, "٣ب", None)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, Score string")
    net = L.train(df)
    assert net.labels == ["de", "en"]
    got = {r.doc_id: r for r in L.predict(df, net, names=("l", "p")).collect()}
    assert all(got[100 + i].l == "und" and got[100 + i].p == 0 for i in range(len(signs)))
    assert all(got[i].l in net.labels for i in (200, 201, 202)) and got[3].Score == "own"
    assert "Score" not in L.predict(df, net).columns


def test_whole_texts_against_plain_windows(spark):
    rng = np.random.default_rng(4)
    net = L.ByteCNN(["a", "b", "c"])
    texts = ["x", "hello wörld " * 3, "".join(chr(97 + c) for c in rng.integers(0, 26, 1000)), "日本語" * 40_000, "z" * 256, "y" * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(df, net).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        held = [data[lo : lo + L.WINDOW].ljust(L.WINDOW, b"\0") for lo in range(0, len(data), L.WINDOW)]
        p = net.probabilities(np.frombuffer(b"".join(held), np.uint8).reshape(-1, L.WINDOW)).mean(axis=0)
        assert got[i].lang_pred == net.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-5


def test_ids_that_repeat_give_one_sample_each(spark):
    rows = [(i % 4, f"{w} text number {i}", w) for i in range(400) for w in ("one", "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(df).labels == ["one", "two"]
