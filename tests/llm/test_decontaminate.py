import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import decontaminate as D
from millrace.llm import words as W


def plain_words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def shingles(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute(docs, items, n=5):
    """Every window of every text against every item."""
    out = {}
    for d, (doc, text) in enumerate(docs):
        w = plain_words(text)
        for item, t in items:
            v = plain_words(t)
            theirs, m = shingles(v, n), len(v)
            for a in range(max(1, len(w) - m + 1)) if w and v else ():
                mine = shingles(w[a : a + m], min(n, m))
                common = (mine & theirs).total()
                total = mine.total() + theirs.total() - common
                if 100 * common >= 80 * total:
                    best = out.get((d, item))
                    if best is None or common / total > best[0]:
                        out[d, item] = (common / total, a)
    return sorted((docs[d][0], i, round(s, 9), a) for (d, i), (s, a) in out.items())


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 4, 14, 25, 40, 59])))) for i in range(25)]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.choice([0, 3, 20, 60, 200]))
        if i % 2:
            x = rng.choice(items)[1].split()
            if i % 3 == 0:
                x[rng.randrange(len(x))] = "changed"
            cut = rng.randrange(len(w) + 1)
            w[cut:cut] = x
        docs.append((i, rng.choice([" ", "\n", ", "]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "..."), (3, docs[3][1]), (503, items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_windows(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    rows = D.find_contamination(df, bench).collect()
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in rows)
    assert got == brute(docs, items) and len(got) > 30
    hit = {g[0] for g in got}
    kept = sorted(r.doc_id for r in D.drop_contaminated(df, bench).collect())
    assert kept == sorted(d for d, _ in docs if d not in hit)
    assert D.find_contamination(df.limit(0), bench).count() == 0 and D.find_contamination(df, bench.limit(0)).count() == 0
    assert D.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_blocks_find_all_fingerprints_in_radius():
    rng = np.random.default_rng(0)
    b = D.Benchmark(list(range(300)), [" ".join(f"x{v}" for v in rng.integers(0, 500, 30)) for _ in range(300)])
    flips = [np.uint64(sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 16)), replace=False))) for _ in range(500)]
    prints = b.prints[rng.integers(0, 300, 500)] ^ np.array(flips)
    got = set(zip(*map(np.ndarray.tolist, b.candidates(prints))))
    dist = np.bitwise_count(prints[:, None] ^ b.prints[None])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(dist <= b.radius))))


def test_small_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_contamination(df, bench).count() == len(brute(docs, items))


def test_long_text_is_read_in_blocks(spark, monkeypatch):
    docs, items = corpus(5)
    rng = random.Random(6)
    vocab = [f"z{i}" for i in range(900)]
    w = rng.choices(vocab, k=3000)
    for i, (_, t) in enumerate(items):
        at = 100 * i + rng.randrange(40)
        w[at:at] = t.split()
    docs = [(1, " ".join(w)), (2, " ".join(w[::-1])), (3, items[6][1] + " " + items[6][1])]
    for size in (16, 100, 1 << 16):
        monkeypatch.setattr(D, "BLOCK_WORDS", size)
        b = D.Benchmark([i for i, _ in items], [t.lower() for _, t in items])
        got = []
        for lo, _, words in W.chunks(W.strings([t.lower() for _, t in docs]), D._SEP):
            got += [(docs[lo + d][0], b.ids[i], round(s, 9), a) for d, found in b.matches(words).items() for i, (s, a, _) in found.items()]
        assert sorted(got) == brute(docs, items)


def test_memory_of_a_very_long_text():
    import tracemalloc

    rng = np.random.default_rng(1)
    item = " ".join(f"q{v}" for v in rng.integers(0, 500, 30))
    b = D.Benchmark([7], [item])
    text = "some filler words here and there " * 350_000 + item + " tail" * 10
    texts = W.strings([text])
    tracemalloc.start()
    (found,) = [b.matches(words) for _, _, words in W.chunks(texts, D._SEP)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][0][0] == 1.0 and peak < 20 * len(text)


def test_recall_near_the_threshold(spark):
    """The fingerprints are an estimate: against the exact similarity of all windows."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([40, 60, 90])))) for i in range(40)]
    docs = []
    for i in range(200):
        x = rng.choice(items)[1].split()
        for _ in range(rng.choice([1, 1, 2])):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        docs.append((i, " ".join(rng.choices(vocab, k=30) + x + rng.choices(vocab, k=30))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, i, *_ in brute(docs, items)}
    got = {(r.doc_id, r.item_id) for r in D.find_contamination(df, bench).collect()}
    assert got <= want and len(want) > 60 and len(got) >= 0.95 * len(want)
