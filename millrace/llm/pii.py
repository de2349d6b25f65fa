"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Protected entities are the values that the patterns find (an address, a number). The corpus estimates how strongly a
term t reveals an entity c, by words and by texts. By words: with T words in all, n(t) of them t, w(c) words within
CONTEXT words of a mention of c and n(c, t) of those t, the pointwise mutual information log(n(c, t) T / (w(c) n(t)))
reaches the entity's information content log(T / w(c)) when t occurs nowhere else. By texts, T, n(t), w(c) and n(c, t)
count the texts that there are, that hold t, c or both, however far apart. Terms with PMI >= ALPHA * IC and
n(c, t) >= SUPPORT by either are sanitised wherever they stand, in texts without the entity too: removed at a share of
REMOVE or more, else generalised.

All counts cover all texts. Texts are read twice, for counts and for marks. Words end at white space and ASCII
punctuation, A-Z count as a-z, words without a letter or under three characters are no terms, nor are words of a mention.
A null text is empty. Ids may be null or repeated; columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialise, table, tidy

CONTEXT, SUPPORT, ALPHA, REMOVE = 8, 3, 0.8, 0.95
KINDS = ("email", "ip", "card", "phone")
_SEP = W.separators("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile("[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_FLUSH = 1_000_000
#: Judged terms that a worker holds at once; more are marked block by block.
BLOCK = 2_000_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ signs: a local part can't hold one."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if first := _DIGIT.search(text):
        at = max(0, first.start() - 1)
        for m in _IP.finditer(text, first.start()):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text, at):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def _free_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, is a term outside all mentions) of a text's words."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = W.Words(data, np.array([0, len(data)]), _SEP)
    place = np.cumsum((data & 0xC0) != 0x80)
    start, end = place[words.start] - 1, place[words.end - 1]
    free = end - start > 2
    for a, _, b in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    for i in np.flatnonzero(free):
        free[i] = any(c.isalpha() for c in text[start[i] : end[i]])
    return words.hash.view(np.int64), start, end, free


def _near(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int]], list[str], list[int]]:
    """((entity, term) around each mention, the text's entities, its terms)."""
    terms, start, end, free = _free_terms(text, spans)
    near = []
    for a, kind, b in spans:
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        around = [*range(max(0, lo - CONTEXT), lo), *range(hi, min(len(start), hi + CONTEXT))]
        near += [(_entity(kind, text[a:b]), int(terms[i])) for i in around if free[i]]
    return near, sorted({_entity(kind, text[a:b]) for a, kind, b in spans}), np.unique(terms[free]).tolist()


_SCAN = "contexts array<struct<entity:string,term:long>>, entities array<string>, terms array<long>, term long, n long, held long"
_CONTEXT = pa.struct([("entity", pa.string()), ("term", pa.int64())])
_KINDS = {
    "contexts": pa.list_(_CONTEXT),
    "entities": pa.list_(pa.string()),
    "terms": pa.list_(pa.int64()),
    **{c: pa.int64() for c in ("term", "n", "held")},
}


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(back, weights=np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2))


def _counts(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, occurrences, texts that hold it) of the words of some texts."""
    text = np.repeat(np.arange(len(words.ptr) - 1), np.diff(words.ptr))
    order = np.lexsort((text, words.hash))
    hashes, text = words.hash[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    held = new.copy()
    held[1:] |= text[1:] != text[:-1]
    group = np.cumsum(new) - 1
    return hashes[new], np.bincount(group), np.bincount(group, weights=held).astype(np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


def _scan(df: DataFrame, text_col: str) -> DataFrame:
    """A row for each text with mentions, and rows (term, n, held) of word and text counts, told apart by null n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rows = [_near(t, spans) for t in texts if (spans := base_spans(t))]
            if rows:
                yield _batch(dict(zip(("contexts", "entities", "terms"), _pairs(rows))))
            for _, _, words in W.chunks(W.strings(texts), _SEP):
                parts.append(_counts(words))
                size += len(parts[-1][0])
                if size > _FLUSH:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > _FLUSH // 2:
                        yield _batch({"term": parts[0][0].view(np.int64), "n": parts[0][1], "held": parts[0][2]})
                        parts, size = [], 0
        if parts:
            keys, n, held = _summed(parts)
            yield _batch({"term": keys.view(np.int64), "n": n, "held": held})

    return df.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), _SCAN)


def _pairs(rows: list) -> tuple[list, list, list]:
    contexts = [[{"entity": e, "term": t} for e, t in near] for near, _, _ in rows]
    return contexts, [r[1] for r in rows], [r[2] for r in rows]


def _shares(known: DataFrame, total, alpha: float) -> DataFrame:
    """known (both, around, n) with the share of information that `both` discloses, where it reaches alpha."""
    pmi = F.log(F.col("both") * total / (F.col("around") * F.col("n")))
    content = F.log(total / F.col("around"))
    return known.withColumn("share", F.when(content > 0, pmi / content)).where(F.col("share") >= alpha)


def _classes(rows: DataFrame, item: str) -> DataFrame:
    """(item, n, texts): in how many texts each item of rows (t, item) is, and a name for which those are."""
    name = F.xxhash64(F.bit_xor(F.xxhash64("t")), F.bit_xor(F.xxhash64("t", F.lit(1))), F.count("*"))
    return rows.groupBy(item).agg(F.count("*").alias("n"), name.alias("texts"))


def _by_texts(found: DataFrame, held: DataFrame, n_texts: int, alpha: float, support: int) -> DataFrame:
    """(term, share): each term's largest share with an entity, by texts. found: t, entities, terms of the texts with
    mentions; held: term, n of all texts.

    Entities that are in the same texts have the same counts with every term, so one stands for all of them, and so it is
    with terms: the pairs that are counted are those of distinct sets of texts. Terms go first that no entity could reach:
    of those that are in c texts with mentions, the best entity is in the same c."""
    total = F.lit(float(n_texts))
    entities = _classes(found.select("t", F.explode("entities").alias("entity")), "entity").where(F.col("n") >= support)
    terms = _classes(found.select("t", F.explode("terms").alias("term")), "term").where(F.col("n") >= support)
    terms = terms.withColumnRenamed("n", "c").join(held, "term")
    terms = terms.where(F.log(total / F.col("n")) >= alpha * F.log(total / F.col("c")) - 1e-9)
    terms = materialise(terms.select("term", "n", F.xxhash64("texts", "n").alias("held")), "term-classes")
    entities = materialise(entities.select("entity", F.col("n").alias("around"), F.col("texts").alias("who")), "entity-classes")
    ours = found.select("t", F.explode("entities").alias("entity")).join(entities, "entity").select("t", "who").distinct()
    theirs = found.select("t", F.explode("terms").alias("term")).join(terms, "term").select("t", "held").distinct()
    both = ours.join(theirs, "t").groupBy("who", "held").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    sizes = entities.select("who", "around").distinct()
    known = terms.select("held", "n").distinct()
    best = _shares(both.join(sizes, "who").join(known, "held"), total, alpha).groupBy("held").agg(F.max("share").alias("share"))
    return terms.join(best, "held").select("term", "share")


def disclosing_terms(scan: DataFrame, n_texts: int, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(term, share): terms whose PMI with some entity, by words or by texts, is at least alpha of the entity's information
    content, and the largest such share. scan: a written table of _scan's rows, each with a number `t`."""
    found = scan.where("n is null")
    counts = scan.where("n is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    total = scan.where("n is not null").agg(F.sum("n")).first()[0] or 0
    near = found.select(F.explode("contexts").alias("x")).select("x.entity", "x.term")
    near = near.groupBy("entity", "term").agg(F.count("*").alias("both"))
    around = near.groupBy("entity").agg(F.sum("both").alias("around"))
    known = near.where(F.col("both") >= support).join(around, "entity").join(counts.select("term", "n"), "term")
    by_words = _shares(known, F.lit(float(total)), alpha).select("term", "share")
    by_texts = _by_texts(found.select("t", "entities", "terms"), counts.select("term", F.col("held").alias("n")), n_texts, alpha, support)
    return by_words.union(by_texts).groupBy("term").agg(F.max("share").alias("share"))


_MARKED = (
    "doc_id long, text string, row_key string, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "terms array<struct<start:int,end:int,removed:boolean>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])


def _mark(rows: DataFrame, terms: np.ndarray, removed: np.ndarray) -> DataFrame:
    """Rows (doc_id, text, terms) with what the patterns find, and the places of `terms` (sorted) added to theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in re.sub("<.*>", "", _MARKED).split(",")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(_SPAN)]
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hit = np.zeros(len(texts), bool)
            for lo, _, words in W.chunks(W.strings(texts), _SEP) if len(terms) else ():
                at = np.flatnonzero(np.isin(words.hash.view(np.int64), terms))
                hit[lo + np.searchsorted(words.ptr, at, "right") - 1] = True
            out = []
            for text, found, has in zip(texts, batch.column(2).to_pylist(), hit.tolist()):
                spans = base_spans(text)
                if has:
                    own, start, end, free = _free_terms(text, spans)
                    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                    for i in np.flatnonzero(free & (terms[at] == own)):
                        found.append({"start": int(start[i]), "end": int(end[i]), "removed": bool(removed[at[i]])})
                key = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest() if spans or found else None
                out.append((key, *[sum(k == kind for _, k, _ in spans) for kind in range(4)], told(spans), found))
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return rows.select("doc_id", "text", "terms").mapInArrow(tidy(run), _MARKED)


def _marked(df: DataFrame, id_col: str, text_col: str, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The texts with their mentions and disclosing terms; one row for each of df."""
    scan = materialise(_scan(df, text_col).withColumn("t", F.monotonically_increasing_id()), "personal-data")
    judged = disclosing_terms(scan, df.count(), alpha, support)
    judged = materialise(judged.select("term", (F.col("share") >= REMOVE).alias("removed")), "disclosing-terms")
    blocks = max(1, -(-judged.count() // BLOCK))
    empty = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), empty.alias("terms"))
    for i in range(blocks):
        part = judged.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).orderBy("term").toArrow()
        rows = _mark(rows, part.column(0).to_numpy(), part.column(1).to_numpy())
    return rows.withColumn("terms", F.sort_array("terms"))


def find_personal_data(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT
) -> DataFrame:
    """(doc_id, row_key, n_email, n_ip, n_card, n_phone, base, terms array<struct<start, end, removed>>)."""
    return _marked(df, id_col, text_col, alpha, support).drop("text")


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with personal data masked by kind, generalised terms as [TERM] and removed terms left out."""
    found = _marked(df, id_col, text_col, **options).where("base <> '' OR size(terms) > 0")
    names = {"doc_id": "_d", "base": "_base", "terms": "_terms"}
    spans = found.select(*[F.col(c).alias(n) for c, n in names.items()], F.xxhash64("text").alias("_h")).distinct()

    @F.pandas_udf("string")
    def masked(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, b, t in zip(texts, base, terms):
            cuts = [(int(x.split(":")[1]), int(x.split(":")[2]), f"[{x.split(':')[0].upper()}]") for x in (b or "").split(",") if x]
            cuts += [(x["start"], x["end"], "" if x["removed"] else "[TERM]") for x in (t if t is not None else ())]
            at, parts = 0, []
            for a, e, mask in sorted(cuts):
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, e)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pd.Series(out)

    same = df[id_col].eqNullSafe(spans["_d"]) & (F.xxhash64(df[text_col]) == spans["_h"])
    joined = df.join(spans, same, "left")
    return joined.withColumn(text_col, masked(text_col, "_base", "_terms")).select(*df.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    base = F.filter(F.split("base", ","), lambda x: x != "")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "term")) for x in (k, i)])
    both = F.concat(base, F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])))
    keyed = F.transform(
        both,
        lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int"), rank[F.split_part(x, F.lit(":"), F.lit(1))], x.alias("told")),
    )
    spans = F.array_join(F.transform(F.sort_array(keyed), lambda x: x["told"]), ",")
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
