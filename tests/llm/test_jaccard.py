import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard as J
from millrace.llm import words as W


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, n):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, p, q):
    sets = [plain_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and q * common >= p * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n_docs=140, big=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=30)
    docs = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 12, 14, 30, 80, 200, 400]))] for _ in range(n_docs)]
    for d in docs[:40]:
        d[1:1] = passage
    base = [rng.choice(vocab) for _ in range(150)]
    chain = list(base)
    for i in range(big):  # a chain of copies that drifts beyond the threshold, and copies of others
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(vocab)
        docs.append(chain)
    for d in rng.sample(docs, 60):
        d = list(d)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            d[rng.randrange(len(d))] = rng.choice(vocab)
        docs.append(d)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(d)) for i, d in enumerate(docs)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[5][1].upper()), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


def test_words_are_the_plain_ones():
    texts = ["", "Aé bÉ  c\x0b\x0cd\te\n", None, "x", " \r\n", "ß ß ÄA äa", "one two three four"]
    for _, _, w in W.chunks(pa.array(texts)):
        got = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.ptr[i], w.ptr[i + 1])] for i in range(len(texts))]
        assert [plain_words(" ".join(g)) for g in got] == [plain_words(t) for t in texts]
        flat = [x for g in got for x in map(str, plain_words(" ".join(g)))]
        assert len({(a, int(h)) for a, h in zip(flat, w.hash)}) == len(set(flat))
        s, _, ptr = w.shingles(3)
        assert np.diff(ptr).tolist() == [len(plain_words(t)) - 2 if len(plain_words(t)) >= 3 else min(1, len(plain_words(t))) for t in texts]


def test_hashes_do_not_depend_on_the_chunk(monkeypatch):
    texts = pa.array(["one two three four", "x " * 50, "one two three four"])
    whole = next(W.chunks(texts))[2].shingles(3)[0].tolist()
    monkeypatch.setattr(W, "CHUNK", 10)
    assert [h for _, _, w in W.chunks(texts) for h in w.shingles(3)[0].tolist()] == whole


def test_linked_sets_share_a_segment():
    rng = np.random.default_rng(3)
    for p, q in ((90, 100), (80, 100)):
        for _ in range(300):
            n = int(rng.integers(4, 900))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(1, n))):
                op = rng.integers(3)
                c = np.delete(b, rng.integers(len(b))) if op != 1 and len(b) > 1 else b
                c = np.unique(np.append(c, rng.integers(0, 2**63).astype(np.uint64))) if op else c
                common = len(np.intersect1d(a, c))
                if q * common < p * (len(a) + len(c) - common):
                    break
                b = c
            if len(a) != len(b) or (a != b).any():
                assert set(J.signatures(a, p, q).tolist()) & set(J.signatures(b, p, q).tolist())


@pytest.mark.parametrize("n,p,cap,seed", [(3, 90, J.CAP, 1), (5, 80, J.CAP, 2), (3, 90, 3000, 3)])
def test_components_are_those_of_all_pairs(spark, n, p, cap, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, sig int, component string")
    got = J.jaccard_components(df, n, p, 100, cap=cap).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, p, 100)


@pytest.mark.parametrize("parts,fold", [(1, 0), (1, 8), (8, 8)])
def test_a_family_near_the_threshold(spark, monkeypatch, parts, fold):
    """Texts that may link with a segment's smallest class also meet those that may not; one link hangs on it here."""
    monkeypatch.setattr(J, "FOLD", fold, raising=False)
    rng = random.Random(2)
    texts = [[f"b{i}" for i in range(64)] for _ in range(90)]
    for d in texts:
        for _ in range(rng.randint(1, 3)):
            d[rng.randrange(len(d))] = f"x{rng.randrange(10**9)}"
    for _ in range(60):
        d = list(rng.choice(texts[:90]))
        d[rng.randrange(len(d))] = f"x{rng.randrange(10**9)}"
        texts.append(d)
    texts = [" ".join(d) for d in texts]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)
    got = J.jaccard_components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90, 100)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(df).select("doc_id", "component_id").collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None)]
    assert J.jaccard_components(df.limit(0)).count() == 0
    assert J.keep_one(df.where("doc_id = 4")).count() == 1


def test_one_row_of_each_group_stays_and_all_others(spark):
    long = "a b c d e f g h i j"
    rows = [
        (None, long, 1), (None, "quite another text of seven words here", 2), (7, "a third text under an id that repeats", 3), (7, long + " k", 4),
        (9, long, 5), (9, long, 6), (None, None, 7), (None, "", 8), (None, "a fourth text without any id at all", 9), (None, "a fourth text without any id at all", 10),
        (3, "words alone", 11), (3, "words alone", 11),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumns({"hash": F.lit(1), "gone": F.lit("x"), "_millrace_hash": F.lit(2)}).repartition(3)
    got = J.keep_one(df, 5, 60)
    assert got.columns == df.columns
    kept = sorted(r.kept for r in got.collect())
    # The group of 1, 4, 5 and 6 keeps the text of id 7, those of 9 and 10, and of 11 twice, one row each.
    assert [k for k in kept if k not in (9, 10)] == [2, 3, 4, 7, 8, 11] and len(kept) == 7


@pytest.mark.parametrize("seed", range(3))
def test_what_stays_is_one_of_each_component(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 5, 5, d]), t) for d, t in corpus(seed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80, 100)
    group = {i: c for i, _, c in numbered}
    n = {i: size for i, size, _ in numbered}
    best = {}
    for i, (d, t) in enumerate(rows):
        if n[i]:
            best[group[i]] = min(best.get(group[i], (2, 0)), (d is None, d or 0))
    got = [(r.doc_id, r.text) for r in J.keep_one(df).collect()]
    with_words = [(d, t) for d, t in got if (t or "").split()]
    by_text = {}
    for i, (d, t) in enumerate(rows):
        by_text.setdefault((d, t), group[i])
    found = [by_text[x] for x in with_words]
    assert sorted(found) == sorted(best) and all((d is None, d or 0) == best[by_text[d, t]] for d, t in with_words)
    assert len(got) - len(with_words) == sum(not n[i] for i in range(len(rows)))


def test_segments_are_stated_in_rounds(spark, monkeypatch):
    """A round shuffles a share of the segments' hashes, and the rounds together find what one does."""
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, plain = [], J._statements
    monkeypatch.setattr(J, "_statements", lambda *a: made.append(plain(*a)) or made[-1])
    J.keep_one(df)
    counts = [rows.distinct().count() for rows in made]
    assert max(counts) < 0.6 * sum(counts) and sum(counts) > 10_000
    got = J.jaccard_components(df, 5, 80, rounds=3).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 5, 80, 100)
