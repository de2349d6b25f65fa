import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


FIXED = [
    "", "a@b", "a@b.c", "x a.b@c-d.e.f. y", "a@b@c.d", "@x.y", "é@x.y é", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.255x",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4", "+49 (30) 1234-5678", "++1 234 567 8901", "+1", "1.2.3.4@5.6.7.8 +12.3.4.56789012",
    "٣.1.2.3 ٤", "+1 555 555 5555-", "4111  1111 1111 1111", "日本 4242424242424242 日",
]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(text):
    assert P.base_spans(text) == plain(text)


def test_random_texts():
    rng = np.random.default_rng(4)
    for chars in ("ab@.@-+ ", "0123456789 -+.()", "0159.@a+ -é"):
        for _ in range(4000):
            text = "".join(rng.choice(list(chars), int(rng.integers(1, 40))))
            assert P.base_spans(text) == plain(text), text


def test_disclosing_terms_match_counts_by_hand(spark):
    rows = [(i, f"the quick agent codename{i % 3} wrote to boss{i % 3}@x.org about the plan") for i in range(12)]
    rows += [(100 + i, "the plan about nothing wrote the quick brown text to nobody") for i in range(40)]
    rows += [(None, None), (500, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in P.find_personal_data(df).collect()}
    words = Counter()
    near = Counter()
    for _, t in rows:
        t = t or ""
        tokens = [m for m in re.finditer(r"[^\s!-/:-@\[-`{-~]+", t)]
        words.update(m[0] for m in tokens)
        for s, _, e in P.base_spans(t):
            left = [m for m in tokens if m.end() <= s][-P.CONTEXT :]
            right = [m for m in tokens if m.start() >= e][: P.CONTEXT]
            near.update((t[s:e], m[0]) for m in left + right if len(m[0]) > 2)
    total = sum(words.values())
    around = Counter()
    for (c, _), n in near.items():
        around[c] += n
    want = {
        (c, w)
        for (c, w), n in near.items()
        if n >= P.SUPPORT and math.log(n * total / (around[c] * words[w])) >= P.ALPHA * math.log(total / around[c])
    }
    assert {w for _, w in want} == {"codename0", "codename1", "codename2"}
    for i, t in rows[:12]:
        got = {t[x.start : x.end] for x in found[i].terms}
        assert got == {w for c, w in want if c in t}
    assert found[500].base == "" and found[500].terms == [] and found[100].terms == []
    clean = {r.doc_id: r.text for r in P.sanitise(df).collect()}
    assert "@" not in clean[0] and "codename0" not in clean[0] and clean[100] == rows[12][1]


def test_terms_far_from_a_mention_and_in_texts_without_it(spark):
    far = " ".join(["the plan about nothing wrote the text to nobody"] * 3)
    rows = [(i, f"Dossier Zanzibar{i % 3} {far} boss{i % 3}@x.org") for i in range(18)]
    rows += [(100 + i, far) for i in range(300)]
    rows += [(900, f"{far} zanzibar1 {far}"), (901, f"zanzibar2 boss2@x.org {far} zanzibar2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in P.find_personal_data(df).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        assert [t[x.start : x.end].lower() for x in found[i].terms] == re.findall("zanzibar[0-9]", t.lower()), i
    clean = [r.text for r in P.sanitise(df).collect()]
    assert len(clean) == len(rows) and not any("zanzibar" in t.lower() or "@" in t for t in clean)


def disclosed(texts):
    """Terms by both rules, all pairs counted one by one."""
    words, held, near, entities, total = Counter(), Counter(), Counter(), Counter(), 0
    both, around = Counter(), Counter()
    for t in texts:
        spans = P.base_spans(t)
        tokens = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\s!-/:-@\[-`{-~]+", t)]
        total += len(tokens)
        words.update(w for _, _, w in tokens)
        held.update({w for _, _, w in tokens})
        free = {w for a, e, w in tokens if len(w) > 2 and any(map(str.isalpha, w)) and all(e <= s or a >= f for s, _, f in spans)}
        own = {P._entity(k, t[s:e]) for s, k, e in spans}
        entities.update(own)
        both.update((c, w) for c in own for w in free)
        for s, k, e in spans:
            left, right = [x for x in tokens if x[1] <= s][-P.CONTEXT :], [x for x in tokens if x[0] >= e][: P.CONTEXT]
            near.update((P._entity(k, t[s:e]), w) for a, z, w in left + right if w in free and all(z <= f or a >= g for f, _, g in spans))
    for (c, _), n in near.items():
        around[c] += n
    rule = lambda n, of, c, w: n >= P.SUPPORT and of > c and math.log(n * of / (c * w)) >= P.ALPHA * math.log(of / c)
    out = {w for (c, w), n in near.items() if rule(n, total, around[c], words[w])}
    return out | {w for (c, w), n in both.items() if rule(n, len(texts), entities[c], held[w])}


@pytest.mark.parametrize("seed", range(3))
def test_terms_are_those_of_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"person{i}" for i in range(30)]
    texts = []
    for _ in range(160):
        body = [str(rng.choice(["alpha", "beta", "gamma", "delta", "the"])) for _ in range(int(rng.integers(3, 40)))]
        for i in rng.choice(30, int(rng.integers(0, 4)), replace=False) if rng.random() < 0.6 else ():
            far = body.copy()
            far.insert(int(rng.integers(0, len(far) + 1)), names[i])
            far.insert(int(rng.integers(0, len(far) + 1)), f"P{i % 20}@x.org" if rng.random() < 0.8 else "+49 30 1234567" + str(i % 7))
            body = far
        texts.append(" ".join(body))
    texts += texts[:20] + ["", "no mention of person3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: {texts[r.doc_id][x.start : x.end].lower() for x in r.terms} for r in P.find_personal_data(df).collect()}
    want = disclosed(texts)
    assert len(want) >= 5
    for i, t in enumerate(texts):
        assert found[i] == {w for w in want if w in t.split()}, i


def test_pages_of_many_mentions_and_terms_make_few_pairs(spark):
    """Entities and terms of the same texts are counted once: three copies of a page with 3000 of each."""
    page = " ".join(f"name{i} n{i}@x.org" for i in range(3000))
    df = spark.createDataFrame([(i, page) for i in range(3)] + [(10 + i, f"some other text {i}") for i in range(30)], "doc_id long, text string")
    found = {r.doc_id: r for r in P.find_personal_data(df).collect()}
    assert all(len(found[i].terms) == 3000 and found[i].n_email == 3000 for i in range(3)) and found[12].terms == []


def test_query_digests(spark, tmp_path):
    rows = [(1, "mail a@b.co"), (2, None), (1, "mail a@b.co"), (None, "9 9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, P.op1(spark, str(tmp_path)).select("doc_id", "n_email", "base_sha256", "spans").collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 4 and got[1] == got[0] and sha("email:5:11") in got[0] and sha("") in got[2]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert P.op1(spark, f"{tmp_path}/e").count() == 0
