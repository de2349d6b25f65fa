"""Collocations, the token cache and the source audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, divergence, lexicon, token_cache
from millrace.llm import words as W

ODD = [None, "", " \t ", "a", ".,;:!?", "A b.C d\x0be f\x0cg,h", "é ÉÀ ß x\x00y", "x" * 20_000, "(a) [b] a-b 3.5", "日本 語。 日本 語"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed, n=120, vocabulary=40, length=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(length)):
            text += "The quick Brown fox jumps" if rng.random() < 0.1 else rng.choice(words[: rng.choice((3, 10, vocabulary))])
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";"])
        out.append((text, rng.choice(["en", "de", None, "und"]), rng.choice(["s0", "s0", "s0", "s1", "s2", None])))
    return out + [(t, lang, "odd") for t in ODD for lang in ("en", None)]


def plain_collocations(rows, least, top, percent):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer.get(p[i : i + m], 0), a)
        told = []
        for p, a in candidates.items():
            if 100 * longer.get(p, 0) >= percent * a:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], "text string, lang string, source string, n long")
    return df.withColumns({"ids": F.lit("x"), "key": F.lit(1), "lang_": F.lit("en"), "part": F.lit(2)}).repartition(5)


@pytest.mark.parametrize("rows_sent, wide", [(2_000_000, False), (0, False), (2_000_000, True)])
def test_collocations_are_the_plain_ones(spark, monkeypatch, rows_sent, wide):
    rows = corpus(1)
    if wide:  # numbers of two digits, small batches of keys
        monkeypatch.setattr(collocations.W, "CHUNK", 1 << 12)
    want = plain_collocations(rows, 6, 40, 100)
    got = collocations.collocations(frame(spark, rows), least=6, top=40, dictionary_rows=rows_sent)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60
    assert {r[0] for r in want} == {"en", "de", "und"}


def test_collocations_of_a_share_and_without_any(spark):
    rows = corpus(2)
    got = collocations.collocations(frame(spark, rows), least=6, top=1000, percent=60)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 6, 1000, 60)
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("a b c", "en", None)] * 3)).count() == 0


def test_keys_of_any_width_are_counted_by_prefix():
    rng = np.random.default_rng(0)
    for width, high in ((1, 9), (2, 1 << 20)):
        names = rng.integers(1, high, 6)
        numbers = np.where(rng.random(3000) < 0.2, 0, rng.choice(names, 3000)).astype(np.int32)
        found = collocations.windows(numbers)
        digits, counts = collocations.radix_runs(collocations.packed(found, width), np.ones(found.shape[1], np.int64))
        values = digits if width == 1 else digits[::2].astype(int) << 16 | digits[1::2]
        want = Counter(map(tuple, found.T.tolist()))
        assert {tuple(v): int(c) for v, c in zip(values.T.tolist(), counts)} == want
        assert [tuple(v) for v in values.T.tolist()] == sorted(want)
        heads = list(zip(*(h.tolist() for h in collocations._heads(digits))))
        cuts = sorted(set(rng.choice(len(heads), 7)))
        parts = collocations.parts_of(digits, sorted({heads[i] for i in cuts}))
        assert parts.tolist() == [sum(s <= h for s in {heads[i] for i in cuts}) for h in heads]


def test_ranges_meet_in_prefix_sums(spark):
    """Splitters within one phrase: its counts come from several ranges."""
    numbers = np.array(([1, 2, 3, 4, 5, 0] * 40) + ([1, 2, 3, 0] * 30) + ([1, 2, 9, 9, 0] * 20), np.int32)
    coded = spark.createDataFrame([(bytearray(numbers.tobytes()),)] * 2, "numbers binary")
    digits = collocations.packed(collocations.windows(numbers), 1)
    cuts = sorted({(int(a), int(b)) for a, b in zip(*collocations._heads(digits))})
    got = {tuple(r.ids): r.a for r in collocations.phrase_counts(coded, 1, cuts, 50).collect()}
    want = Counter()
    for run in ([1, 2, 3, 4, 5],) * 80 + ([1, 2, 3],) * 60 + ([1, 2, 9, 9],) * 40:
        want.update(tuple(run[i : i + m]) for m in range(2, 6) for i in range(len(run) - m + 1))
    assert got == {p: n for p, n in want.items() if n >= 50}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_007
    grams = spark.createDataFrame([([1, 2], big), ([1, 2, 3], big - 1)], "ids array<int>, a long")
    known = spark.createDataFrame([(1, "en", "x", 5 * big), (2, "en", "y", 3 * big + 1), (3, "en", "z", 2 * big)], "id int, lang string, word string, n long")
    totals = spark.createDataFrame([("en", 99 * big + 5)], "lang string, n long")
    got = {r.phrase: r for r in collocations.scored(grams, known, totals).collect()}
    assert got["x y"].score == 1000 * big * (99 * big + 5) // (5 * big * (3 * big + 1))
    assert (got["x y z"].l, got["x y z"].r) == (big, 2 * big) and got["x y z"].score == 1000 * (big - 1) * (99 * big + 5) // (big * 2 * big)


# --- token cache ----------------------------------------------------------------------------------------------------
def tokenizer_path(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


TEXTS = ["Hello  World\n\n", " hello world", "hello world ", "a<|endoftext|>b <|EndOfText|> <|startoftext|>", "x y z\x1c ́é", "it's 12's", "e\t́", "日本語 🙂", "y" * 9000]


@pytest.mark.parametrize("name, blank_free", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)])
def test_counts_are_the_librarys(spark, tmp_path, monkeypatch, name, blank_free):
    path = tokenizer_path(name)
    rng = random.Random(7)
    texts = TEXTS + [t for t in ODD] + [" ".join(rng.choice(TEXTS) for _ in range(rng.randrange(1, 900))) for _ in range(25)]
    rows = [(i % 31 if i % 4 else None, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "n_tokens": F.lit("x")})
    monkeypatch.setattr(token_cache, "CHUNK", 512)
    cache = token_cache.TokenCache(spark, str(tmp_path), path, blank_free)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in cache.count_tokens(df, limit=100).collect())
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    each = {t: count(t or "") for t in set(texts)}
    want = sorted((i is not None, i, len((t or "").encode()), each[t], each[t] > 100) for i, t in rows)
    assert got == want


def test_only_misses_are_encoded_and_versions_are_apart(spark, tmp_path, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    cache = token_cache.TokenCache(spark, str(tmp_path), path, blank_free=True)
    df = spark.createDataFrame([(1, "One two"), (2, "One  two\n"), (3, None), (4, "three"), (1, "One two")], "doc_id long, text string")
    keys = lambda d: d.select(F.unhex(F.sha2(cache.content("text").cast("binary"), 256)).alias("digest"))
    assert cache.extend(df, keys(df)) == 3 and cache.extend(df, keys(df)) == 0
    more = df.unionByName(spark.createDataFrame([(9, "three  "), (9, "four")], df.schema))
    monkeypatch.setattr(token_cache, "BROADCAST_ROWS", 0)  # more misses than are sent to the tasks
    assert cache.extend(more, keys(more)) == 1 and cache.counts().count() == 4
    assert sorted((r.doc_id, r.n_tokens) for r in cache.count_tokens(more).collect()) == [(1, 2), (1, 2), (2, 2), (3, 0), (4, 1), (9, 1), (9, 1)]
    monkeypatch.setattr(token_cache, "counter", lambda path: pytest.fail("nothing is missing"))
    assert cache.extend(more, keys(more)) == 0
    other = token_cache.TokenCache(spark, str(tmp_path), tokenizer_path("byte_bpe_50k.json"))
    assert other.counts() is None and other.version != cache.version
    assert token_cache.TokenCache(spark, str(tmp_path / "none"), path).count_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_cache.tokenizer_digest("vocabulary.tiktoken")


def test_words_are_encoded_once_while_they_are_held():
    path = tokenizer_path("word_bpe_49k.json")
    texts = [" ".join("word" * (i % 5) + str(i % 90) for i in range(400)), "word0", "", "z" * 5000]
    for held, once in ((1 << 25, True), (0, False)):
        encoder, seen = token_cache.Encoder(path, True, held), []
        count = encoder.count
        encoder.count = lambda new: seen.extend(new) or count(new)
        for _ in range(2):
            assert encoder.totals(texts[:2]) == [count([t])[0] for t in texts[:2]]
        assert encoder.totals(texts[2:]) == [count([t])[0] for t in texts[2:]]
        assert (len(set(seen)) == len(seen)) == once


# --- source audit ---------------------------------------------------------------------------------------------------
def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            groups[s].update(t for t in terms if df[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, listed in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(listed, 1)]
    return sorted(out)


@pytest.mark.parametrize("width, height", [(4096, 128), (3, 2), (7, 1)])
def test_divergence_is_the_plain_one(spark, width, height):
    rows = corpus(3) + [("", "xx", "only"), (None, "xx", "other"), ("few words here", "xx", None)]
    got = divergence.divergence(frame(spark, rows), least=5, top=4, width=width, height=height)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 5, 4)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_divergence_of_little(spark):
    assert divergence.divergence(frame(spark, [("a", "en", "s")]).limit(0)).count() == 0
    rows = [("a b", "en", "s"), ("a", "en", "t"), (None, None, None)]
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows)).collect())) == plain_divergence(rows, 10, 10)


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**12, 8 * 10**15], np.int64)
    total = 8 * 10**15 + 12345
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
    p = np.array([[1, 10**9 + 1, 5], [7, 7, 7]], np.int64)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    assert divergence.distances(p, p).tolist() == [[sum(f(int(a), int(b)) for a, b in zip(x, y)) for y in p] for x in p]


def test_tallies_merge_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "HELD", 50)
    rows = corpus(4, 60)
    df = frame(spark, rows).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    sep = W.separators(collocations.PIECE_ENDS)

    def told(tally):
        import pyarrow as pa

        (key, group, n, docs), (names, size, data) = tally.counts[0], tally.words[0]
        listed = list(tally.names)
        word = lexicon.spelled(size, data, np.searchsorted(names, key))
        cols = [pa.array([listed[g][i] for g in group], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, word, pa.array(n), pa.array(docs)], names=["lang", "source", "word", "n", "docs"])

    got = {tuple(r)[:3]: (r.n, r.docs) for r in lexicon.gathered(df, sep, 3, told, "lang string, source string, word string, n long, docs long").collect()}
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        words = re.findall("[^\x09-\x0d .,;:!?]+", lowered(text))
        n.update((lang or "", source or "", w) for w in words)
        docs.update((lang or "", source or "", w) for w in set(words))
    assert got == {k: (n[k], docs[k]) for k in n}
