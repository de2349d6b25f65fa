import random

import numpy as np
import pytest

from millrace.llm import sentencepiece_fst as S


@pytest.fixture(scope="module")
def machine():
    with open(S.MODEL, "rb") as f:
        return S.Transducer(f.read())


@pytest.fixture(scope="module")
def machines(machine):
    sp = pytest.importorskip("sentencepiece")
    with open(S.MODEL, "rb") as f:
        return machine, sp.SentencePieceProcessor(model_proto=f.read())


SYLLABLES = "tion the an er ing on ß ü ción que os de ñ ie sch ver ge é ê au ou x q 0 17 . , \n \t @ zz ▁ ab".split(" ") + [" "] * 8


def test_paths_come_from_relaxed_arcs(machine):
    """Every part's ids are the least path over all arcs, which are counted where they are relaxed."""
    rng = random.Random(8)
    for _ in range(60):
        part = S.MARK + "".join(rng.choice([x for x in SYLLABLES if x.strip()]) for _ in range(rng.randrange(1, 6))).replace("\n", "").replace(S.MARK, "")
        before = machine.relaxed
        (packed,) = machine.shortest([part])
        arcs = [(i, j, machine.ids[part[i:j]]) for i in range(len(part)) for j in range(i + 1, len(part) + 1) if part[i:j] in machine.ids]
        assert machine.relaxed - before == len(arcs)
        best = {(0, -1): (0, 0.0, ())}
        for end in range(1, len(part) + 1):  # all states (position, last piece), with nothing left out
            for i, j, p in arcs:
                if j == end:
                    for (at, last), (bad, cost, path) in list(best.items()):
                        if at == i:
                            wrong = last >= 0 and machine.merged(machine.text_of[last] + machine.text_of[p])[0] != [machine.text_of[last], machine.text_of[p]]
                            new = (bad + wrong, cost + machine.cost[p], (*path, p))
                            if (j, p) not in best or new[:2] < best[j, p][:2]:
                                best[j, p] = new
        least = min(v for (at, _), v in best.items() if at == len(part))
        assert least[0] == 0 and list(least[2]) == np.frombuffer(packed, "<i4").tolist()
        assert [machine.text_of[p] for p in least[2]] == machine.merged(part)[0]


def test_joins_are_those_of_merging(machine):
    rng = random.Random(3)
    ids = list(machine.text_of)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)]
    texts = [t for t in machine.ids if len(t) > 3]
    for t in rng.sample(texts, 3000):  # pieces that often stand together
        k = rng.randrange(1, len(t))
        if t[:k] in machine.ids and t[k:] in machine.ids:
            pairs.append((machine.ids[t[:k]], machine.ids[t[k:]]))
    pairs = [(a, b) for a, b in pairs if all(machine.merged(machine.text_of[x])[0] == [machine.text_of[x]] for x in (a, b))]
    got = machine.joins_well(*(np.array(c, np.int32) for c in zip(*pairs)))
    want = [machine.merged(machine.text_of[a] + machine.text_of[b])[0] == [machine.text_of[a], machine.text_of[b]] for a, b in pairs]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_random_texts_match_plain_merges(machine):
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(25)))
        want = [machine.ids.get(p) for part in machine.parts(text) for p in machine.merged(part)[0]]
        if None not in want:
            assert machine.encode(text).tolist() == want


def test_caches_change_nothing(machine, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(40))) for _ in range(200)]
    want = [x.tolist() for x in machine.encode_all(texts)]
    monkeypatch.setattr(S, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(S, "AT_ONCE", 16)
    for _ in range(2):
        for lo in range(0, 200, 20):
            assert [x.tolist() for x in machine.encode_all(texts[lo : lo + 20])] == want[lo : lo + 20]


CASES = [
    "", " ", "  ", "a", " a  b \n", "Hello  world\n ñe <s> </s> \t x   y 日本語 a", "\n\n\n", "x\x01y z", "🙂🙂 ok\r\n",
    "    def f(x):\n        return x**2\n", "a" * 5000, "ab " * 3000, "<0x41>", "ﬁ Å①", "   x",
]


@pytest.mark.parametrize("text", CASES)
def test_matches_library(machines, text):
    ours, lib = machines
    assert ours.encode(text).tolist() == lib.encode(text)
    assert ours.decode(ours.encode(text)) == text


def test_random_texts_match_library(machines):
    ours, lib = machines
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(SYLLABLES).replace("▁", "") for _ in range(rng.randrange(60)))
        assert ours.encode(text).tolist() == lib.encode(text), text
        assert ours.decode(ours.encode(text)) == text


def test_space_mark_comes_back_as_space(machines):
    ours, lib = machines
    text = "x▁y ▁"
    assert ours.encode(text).tolist() == lib.encode(text)
    assert ours.decode(ours.encode(text)) == "x y  "


def test_dataframe(spark):
    df = spark.createDataFrame(
        [(1, "a b", "k"), (2, None, None), (2, None, None), (3, "", "z")], "doc_id long, text string, decoded string"
    )
    rows = S.encode_decode(df).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [2, 0, 0, 0]
    assert all(r.round_trip for r in rows) and rows[0].decoded == "a b"
    assert S.encode_decode(df.limit(0)).count() == 0
