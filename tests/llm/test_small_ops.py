import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, lines, shards
from millrace.llm.common import shared_dir


# --- chat -----------------------------------------------------------------------------------------------------------
TEXTS = ["hi", "", None, "~0 ~ [INST] <s></s> > [/INST]", "a\n\nb", "</s>[INST] ok [/INST]", "<role=x>", "日本 🙂", "x" * 30_000, "<" * 5_000]


def test_formatted_text_reads_back(spark):
    rows = [(c, t, role, TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "tool", None])]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, 1, "a>b<[~", "z"), (None, 0, "user", "n"), (51, None, "assistant", "q")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    roles, texts = chat.parse_formatted(F.col("formatted"))
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumns({"roles": roles, "texts": texts}).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert got[c].roles == [r for _, r, _ in turns] and got[c].texts == [t for _, _, t in turns]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        masked = [s.text for s in got[c].segments if s.loss]
        assert len(masked) == sum(r == "assistant" for _, r, _ in turns)


@pytest.mark.parametrize(
    "roles,state,valid",
    [(["user", "assistant"], "assistant", True), (["system", "user", "assistant"] * 1, "assistant", True), (["assistant"], "error", False), (["user", "user"], "error", False), (["user"], "user", False), (["system", "assistant"], "error", False)],
)
def test_role_machine(spark, roles, state, valid):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert (row.end_state, row.valid) == (state, valid)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------
def test_line_frequencies(spark):
    rows = [(i, "a", f"footer\nbody {i}\n  footer \n\n") for i in range(40)] + [(100 + i, "a", f"other {i}") for i in range(10)]
    rows += [(200 + i, "b", "footer\nrare") for i in range(4)] + [(300, None, "footer\nx"), (301, "a", None), (302, "a", ""), (0, "a", "footer\nbody 0\n  footer \n\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, drop int")
    out = lines.dedup_document_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    pages = Counter(s for _, s, _ in rows)
    held = Counter()
    for _, s, t in rows:
        held.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    want = Counter()
    for i, s, t in rows:
        gone = lambda x: s is not None and x.strip(" ") and held[s, x.strip(" ")] >= lines.MIN_PAGES and held[s, x.strip(" ")] > lines.RATIO * pages[s]  # noqa: B023, E731
        want[i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(x))] += 1
    assert got == want and got[0, "body 0\n\n"] == 2
    assert lines.dedup_document_lines(df.limit(0)).count() == 0


def test_html_lines(spark):
    html = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><p>A <b>b</b><br>c &amp;lt; d</p><!-- x\n --><ul><li>e</li></ul>f</body>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [r[0] for r in df.select(lines.html_lines(lines.text_of("html"))).collect()]
    assert got == [["A b", "c &lt; d", "e", "f"], [], []]
    urls = spark.createDataFrame([("HTTP://u@A.b:80/x?y",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in urls.select(lines.host_of(F.col("u"))).collect()] == ["a.b", None, None]


# --- shards ---------------------------------------------------------------------------------------------------------
def test_shards_are_even_gapless_and_whole(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i * 37 % 200)) for i in range(3000)] + [(5000 + i, "copy " * 40) for i in range(1500)]
    rows += [(None, None), (7, ""), (7, ""), (8, "y" * 2000)]
    df = spark.createDataFrame([(i, t, zlib.crc32((t or "").encode()), 9) for i, t in rows], "doc_id long, text string, crc long, shard int")
    got = shards.shard_documents(df, 16, keep=("crc",)).collect()
    assert Counter((r.doc_id, r.crc) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    total, per = sum(r.size for r in got), Counter()
    slots = defaultdict(list)
    for r in got:
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(per) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(per.values()) - min(per.values()) <= 2 * shards.TOLERANCE * total / 16 + 2001
    homes = defaultdict(set)
    for r in got:
        homes[r.crc].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 1  # only the large group of copies is cut


def test_shards_of_little(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.size) for r in shards.shard_documents(df, 4).collect()} == {(1, 2), (2, 1)}
    assert shards.shard_documents(df.limit(0), 4).count() == 0


def test_shards_against_plain_sorting(spark):
    rows = [(i, f"t{i * 7919 % 400}" * (1 + i % 9)) for i in range(900)] + [(4, "same " * 30)] * 700 + [(None, None)] * 3
    df = spark.createDataFrame([(i, t, 1, "p", "f") for i, t in rows], "doc_id long, text string, shard int, place string, first string")
    got = shards.shard_documents(df, 8, keep=("shard", "place", "first")).collect()
    assert {(r.kept_shard, r.kept_place, r.kept_first) for r in got} == {(1, "p", "f")}
    # In key order, shards follow each other and slots count up from 0; repeated rows part where a shard is full.
    ordered = sorted(got, key=lambda r: (r.hash, r.doc, r.row))
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in got)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t or "") + 1) for i, t in rows)
    per, mean = Counter(), sum(r.size for r in got) / 8
    for r in got:
        per[r.shard] += r.size
    assert len(per) == 8 and all(abs(b - mean) <= 2 * shards.TOLERANCE * mean + max(r.size for r in got) for b in per.values())
    # A boundary misses its target by the tolerance or one row at most.
    below = 0
    for k in range(7):
        below += per[k]
        assert abs(below - (k + 1) * mean) <= max(1, shards.TOLERANCE * mean) + max(r.size for r in got)


def test_intermediates_lie_in_the_shared_folder_and_go(spark):
    import glob

    from millrace.llm.common import discard, materialise

    folder = shared_dir(spark).removeprefix("file:")
    held = materialise(spark.range(3), "held")
    assert glob.glob(f"{folder}/millrace-*/held-*") and held.count() == 3
    discard(held)
    assert not glob.glob(f"{folder}/millrace-*/held-*")


def test_lines_of_long_pages_and_clashing_names(spark):
    long = "\n".join(["nav"] * 3 + [f"line {i}" for i in range(60_000)])
    rows = [(1, "h", long), (2, "h", "nav\nonly"), (3, "small", "nav\na"), (4, "small", "b"), (5, None, "nav")]
    df = spark.createDataFrame([(*r, 0, "g", 7) for r in rows], "doc_id long, source string, text string, host int, gone string, _millrace_host int")
    got = {r.doc_id: r for r in lines.dedup_document_lines(df).collect()}
    assert got[1].text == long[12:] and got[2].text == "only" and got[3].text == "nav\na" and got[5].text == "nav"
    assert {(r.host, r.gone, r._millrace_host) for r in got.values()} == {(0, "g", 7)}
