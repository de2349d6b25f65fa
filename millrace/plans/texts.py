"""Queries on provenance, text and vocabularies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import arrays as A
from millrace.functions import parse as P
from millrace.functions import symbols as Y
from millrace.functions import text as X
from millrace.operators import batching, profile, splits, vocabulary
from millrace.sources import fixtures

from .base import add, norm, quoted, split_ctes, trainable

SOURCES = ["MAT.1.2", "abc", "GEN.01.7", "A.B.C", "", "LUK.2.3.4", "mat.1.2", "REV.22.x"]
NAMES = ["Asante_Twi_twi", "English_eng", "Plain", "Two_Words", "X_ENG", "_abc", "a_b_cde"]
#: Inline texts: what the test tables lack.
EDGES = [
    "Nine kites, gone… (by noon)", "ŊƆƐ ƏꞋ FUƲ", "ɛↄx ǝԑ ϵο раху", "‘Tis — “so” ‒ said", "o'er re-do -x- y' 'z", "w​x‌y‍z",
    "õ-q", "ŝ k-", "7 up", "up٧", "Q", "", "'-'", "LOUD WORDS", "\x1dm\x0bn\x85o", "one\ttwo\nthree", "p_q{r}`~",
]


def _with_inline(spark, df, column, values, **fixed):
    rows = spark.createDataFrame([(f"e{i}", v) for i, v in enumerate(values)], f"id string, {column} string")
    return df.select("id", column).unionByName(rows)


def _inline_sql(column, values):
    return ", ".join(f"('e{i}', {_sql_text(v)})" for i, v in enumerate(values))


def _sql_text(value):
    parts, held = [], ""
    for c in value:
        if ord(c) < 32:
            parts += [quoted(held), f"chr({ord(c)})"]
            held = ""
        else:
            held += c
    return " || ".join([*parts, quoted(held)])


def _texts(spark, d):
    return _with_inline(spark, fixtures.segments(spark, d), "text", EDGES)


_TEXTS = f"texts AS (SELECT id, text FROM segments UNION ALL SELECT * FROM (VALUES {_inline_sql('text', EDGES)}) t(id, text))"


def _normal(df, **options):
    return df.withColumn("normal", X.normalize(F.col("text"), **options))


add(
    "parse_source",
    lambda s, d: _with_inline(s, fixtures.segments(s, d), "source_file", SOURCES).select("id", *[c.alias(n) for n, c in P.parse_source(F.col("source_file")).items()]),
    rf"""
    s AS (SELECT id, source_file AS f FROM segments UNION ALL SELECT * FROM (VALUES {_inline_sql('f', SOURCES)}) t(id, f)),
    m AS (SELECT *, regexp_matches(f, '{P.SOURCE}') AS ok FROM s)
    SELECT id, CASE WHEN ok THEN regexp_extract(f, '{P.SOURCE}', 1) ELSE f END AS book,
      CASE WHEN ok THEN CAST(regexp_extract(f, '{P.SOURCE}', 2) AS INTEGER) ELSE -1 END AS chapter,
      CASE WHEN ok THEN regexp_extract(f, '{P.SOURCE}', 3) ELSE '' END AS version FROM m""",
    ("segments",),
)


def _names(spark, d):
    given = fixtures.segments(spark, d).select("config").distinct()
    return given.union(spark.createDataFrame([(n,) for n in NAMES], "config string")).distinct()


_NAMES = "names AS (SELECT DISTINCT config FROM segments UNION SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") t(config))"

add(
    "parse_config",
    lambda s, d: _names(s, d).select("config", *[c.alias(n) for n, c in P.parse_config(F.col("config")).items()]),
    f"""{_NAMES}
    SELECT config, CASE WHEN regexp_matches(config, '{P.CONFIG}') THEN regexp_extract(config, '{P.CONFIG}', 1) ELSE config END AS language,
      CASE WHEN regexp_matches(config, '{P.CONFIG}') THEN regexp_extract(config, '{P.CONFIG}', 2) ELSE '' END AS iso FROM names""",
    ("segments",),
)
add("iso_of", lambda s, d: _names(s, d).select("config", P.iso_of(F.col("config")).alias("iso")), f"{_NAMES} SELECT config, split_part(config, '_', -1) AS iso FROM names", ("segments",))
add(
    "pretty_config",
    lambda s, d: _names(s, d).select("config", P.pretty(F.col("config")).alias("pretty")),
    rf"{_NAMES} SELECT config, replace(regexp_extract(config, '^(.*)_[^_]*$', 1), '_', ' ') || ' (' || split_part(config, '_', -1) || ')' AS pretty FROM names",
    ("segments",),
)


def _splits(s, d):
    return splits.assign_groups(fixtures.segments(s, d))


_SPLITS = split_ctes("segments")
add("book_splits", _splits, f"{_SPLITS} SELECT config, book, split FROM splits", ("segments",))
add(
    "join_split_map",
    lambda s, d: splits.with_split(fixtures.segments(s, d).select("config", "id", "book"), _splits(s, d)),
    f"{_SPLITS} SELECT s.config, s.id, s.book, p.split FROM segments s LEFT JOIN splits p ON s.config = p.config AND s.book = p.book",
    ("segments",),
)
add(
    "join_split_default",
    lambda s, d: splits.with_split(fixtures.segments(s, d).select("config", "id", "book"), _splits(s, d).where("split = 'test'"), "train"),
    f"{_SPLITS} SELECT s.config, s.id, s.book, coalesce(p.split, 'train') AS split FROM segments s LEFT JOIN (SELECT * FROM splits WHERE split = 'test') p ON s.config = p.config AND s.book = p.book",
    ("segments",),
)
add("hours_by_book", lambda s, d: splits.group_hours(fixtures.segments(s, d), "config", "book"), "SELECT config, book, sum(duration) / 3600 AS hours FROM segments GROUP BY config, book", ("segments",))
add(
    "hours_by_split",
    lambda s, d: splits.group_hours(splits.with_split(fixtures.segments(s, d), _splits(s, d)), "config", "split"),
    f"{_SPLITS} SELECT s.config, split, sum(duration) / 3600 AS hours FROM segments s JOIN splits p ON s.config = p.config AND s.book = p.book GROUP BY s.config, split",
    ("segments",),
)
add("books_per_split", lambda s, d: splits.books_per_split(_splits(s, d)), f"{_SPLITS} SELECT config, split, count(*) AS n_books FROM splits GROUP BY config, split", ("segments",))

add(
    "text_has_digits",
    lambda s, d: _texts(s, d).select("id", X.has_digits(F.col("text")).alias("has_digits")),
    rf"{_TEXTS} SELECT id, regexp_matches(coalesce(text, ''), '\p{{Nd}}') AS has_digits FROM texts",
    ("segments",),
)
add(
    "text_normalize",
    lambda s, d: _texts(s, d).select("id", X.normalize(F.col("text")).alias("normal"), X.normalize(F.col("text"), keep_apostrophe=False).alias("bare")),
    f"{_TEXTS} SELECT id, {norm('text')} AS normal, {norm('text', False)} AS bare FROM texts",
    ("segments",),
)
add(
    "text_is_trainable",
    lambda s, d: _normal(_texts(s, d)).select("id", X.is_trainable(F.col("text"), F.col("normal")).alias("trainable")),
    f"{_TEXTS} SELECT id, {trainable('text')} AS trainable FROM texts",
    ("segments",),
)
add(
    "charset_by_lang",
    lambda s, d: profile.charsets(_normal(fixtures.segments(s, d)), "normal"),
    f"""c AS (SELECT DISTINCT config, unnest(string_split({norm('text')}, '')) AS c FROM segments)
    SELECT config, string_agg(c, '' ORDER BY c) AS charset FROM c WHERE c <> ' ' AND c <> '' GROUP BY config""",
    ("segments",),
)
add(
    "casing_profile",
    lambda s, d: fixtures.segments(s, d).groupBy("config", X.casing(F.col("text")).alias("casing")).agg(F.count("*").alias("n")),
    r"""l AS (SELECT config, regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g') AS t FROM segments)
    SELECT config, CASE WHEN t = '' THEN 'no-letters' WHEN t = upper(t) THEN 'ALL CAPS' WHEN t = lower(t) THEN 'all lower' ELSE 'Mixed' END AS casing,
      count(*) AS n FROM l GROUP BY 1, 2""",
    ("segments",),
)
add(
    "trainable_counts",
    lambda s, d: _normal(fixtures.segments(s, d)).withColumn("t", X.is_trainable(F.col("text"), F.col("normal"))).groupBy("config").agg(
        F.count_if("t").alias("kept"), F.count_if(~F.col("t")).alias("dropped")
    ),
    f"""t AS (SELECT config, {trainable('text')} AS t FROM segments)
    SELECT config, count(*) FILTER (WHERE t) AS kept, count(*) FILTER (WHERE NOT t) AS dropped FROM t GROUP BY config""",
    ("segments",),
)

# Vocabulary: a donor of plain letters, built by rule.
DONOR = {"|": 0, **{chr(97 + i): 1 + i for i in range(26)}, "'": 27, "-": 28, "[UNK]": 29, "[PAD]": 30}
BLANK, UNKNOWN, SPACE = 30, 29, 0


def _donor(s):
    return s.createDataFrame(list(DONOR.items()), "token string, id int")


def _counts(s, d):
    return vocabulary.char_counts(_normal(fixtures.segments(s, d)), "normal")


_COUNTS = f"""chars AS (SELECT unnest(string_split({norm('text')}, '')) AS char FROM segments),
    counts AS (SELECT char, count(*) AS n FROM chars WHERE char <> ' ' AND char <> '' GROUP BY char),
    donor AS (SELECT * FROM (VALUES {", ".join(f"({quoted(k)}, {v})" for k, v in DONOR.items())}) t(token, id))"""
add("char_counts", _counts, f"{_COUNTS} SELECT char, n FROM counts", ("segments",))
add(
    "rare_char_share",
    lambda s, d: vocabulary.rare_share(_counts(s, d), _donor(s)),
    f"""{_COUNTS}, r AS (SELECT n, n < 50 AND NOT EXISTS (SELECT 1 FROM donor WHERE token = char) AS rare FROM counts)
    SELECT count(*) FILTER (WHERE rare) AS n_rare, CAST(coalesce(sum(n) FILTER (WHERE rare), 0) AS BIGINT) AS occurrences,
      coalesce(sum(n) FILTER (WHERE rare), 0) / sum(n) AS share FROM r""",
    ("segments",),
)
add("vocab_new_chars", lambda s, d: vocabulary.new_chars(_counts(s, d), _donor(s)), f"{_COUNTS} SELECT char, n FROM counts WHERE char NOT IN (SELECT token FROM donor)", ("segments",))
add(
    "vocab_extend",
    lambda s, d: vocabulary.extend(_counts(s, d), _donor(s)),
    f"""{_COUNTS} SELECT token, id FROM donor UNION ALL
    SELECT char, CAST(row_number() OVER (ORDER BY char) + (SELECT max(id) FROM donor) AS INTEGER) FROM counts WHERE n >= 50 AND char NOT IN (SELECT token FROM donor)""",
    ("segments",),
)


def _encoded(s, d):
    Y.bound_batches(s)
    return _normal(fixtures.segments(s, d)).withColumn("ids", Y.encode_text(F.col("normal"), DONOR, UNKNOWN))


_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in DONOR.items()) + "}"
_BACK = "MAP {" + ", ".join(f"{v}: {quoted(k)}" for k, v in DONOR.items() if len(k) == 1) + "}"
_ENCODED = f"""vocab AS (SELECT {_MAP} AS m), encoded AS (SELECT config, id, duration, doc_id, list_transform(list_filter(string_split({norm('text')}, ''), lambda c: c <> ''),
      lambda c: coalesce(m[CASE WHEN c = ' ' THEN '|' ELSE c END], {UNKNOWN})) AS ids FROM segments, vocab)"""
_told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
add(
    "tokenize_encode",
    lambda s, d: _encoded(s, d).select("config", "id", _told("ids").alias("ids")),
    f"{_ENCODED} SELECT config, id, coalesce(array_to_string(ids, ' '), '') AS ids FROM encoded",
    ("segments",),
)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _frames(ids: pa.Array) -> pa.Array:
    """Ids as a model's frames tell them: of three in a row, the first twice and a blank, the second and a blank, the third."""
    begin = ids.offsets.to_numpy()
    values, begin = ids.values.to_numpy()[begin[0] : begin[-1]], begin - begin[0]
    place = (np.arange(len(values)) - np.repeat(begin[:-1], np.diff(begin))) % 3
    ends = np.concatenate([[0], np.cumsum(3 - place)])
    out = np.repeat(values, 3 - place)
    out[(ends[1:] - 1)[place < 2]] = BLANK
    return pa.ListArray.from_arrays(pa.array(ends[begin].astype(np.int32)), pa.array(out))


def _ctc(s, d):
    return _encoded(s, d).select("config", "id", Y.ctc_text(_frames("ids"), DONOR, BLANK, SPACE).alias("decoded"))


add(
    "ctc_decode",
    _ctc,
    f"""{_ENCODED}, frames AS (SELECT config, id, flatten(list_transform(ids, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN [x, x, {BLANK}] WHEN (i - 1) % 3 = 1 THEN [x, {BLANK}] ELSE [x] END)) AS f FROM encoded),
    kept AS (SELECT config, id, list_filter(f, lambda x, i: (i = 1 OR x <> f[i - 1]) AND x <> {BLANK}) AS k FROM frames), back AS (SELECT {_BACK} AS b)
    SELECT config, id, coalesce(trim(array_to_string(list_transform(k, lambda x: CASE WHEN x = {SPACE} THEN ' ' ELSE coalesce(b[x], '') END), '')), '') AS decoded FROM kept, back""",
    ("segments",),
)

BUDGET = 40_000.0
RUNS = """runs AS (SELECT {key}, duration, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY duration) AS rn,
      CASE WHEN duration > 0 THEN greatest(1, CAST(floor({budget} / duration) AS BIGINT)) ELSE 1000000000 END AS room FROM {view} GROUP BY {key}, duration),
    fill AS (
      SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS rn, CAST(-1 AS DOUBLE) AS duration, CAST(1 AS BIGINT) AS room, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS first_batch,
        CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS length FROM runs
      UNION ALL
      SELECT r.{key}, r.rn, r.duration, r.room, least(r.n, greatest(0, r.room - f.length)), f.batch,
        f.batch + CASE WHEN r.n > greatest(0, r.room - f.length) THEN 1 + (r.n - greatest(0, r.room - f.length) - 1) // r.room ELSE 0 END,
        CASE WHEN r.n > greatest(0, r.room - f.length) THEN r.n - greatest(0, r.room - f.length) - (r.n - greatest(0, r.room - f.length) - 1) // r.room * r.room ELSE f.length + r.n END
      FROM fill f JOIN runs r ON r.{key} = f.{key} AND r.rn = f.rn + 1
    ),
    batches AS (SELECT s.*, CASE WHEN r < taken THEN first_batch ELSE first_batch + 1 + (r - taken) // room END AS batch
      FROM (SELECT *, row_number() OVER (PARTITION BY {key}, duration ORDER BY {order}) - 1 AS r FROM {view}) s JOIN fill f ON f.{key} = s.{key} AND f.duration = s.duration)"""


def _batched(s, d):
    """Batches of texts: those move, at a byte a character, and become ids where they are told."""
    Y.bound_batches(s)
    rows = _normal(fixtures.segments(s, d)).select("config", "id", "doc_id", "duration", "normal")
    return batching.length_buckets(rows, BUDGET, order=("doc_id",))


def _padded(s, d):
    size = F.max(F.length("normal")).over(Window.partitionBy("config", "batch"))
    rows = _batched(s, d).withColumn("longest", size).withColumn("ids", Y.encode_text(F.col("normal"), DONOR, UNKNOWN))
    return rows.select("config", "id", "batch", F.size("ids").cast("long").alias("n"), _told(A.pad(F.col("ids"), F.col("longest"))).alias("labels"))


add(
    "pad_labels",
    _padded,
    _ENCODED + ", " + RUNS.format(key="config", view="encoded", budget=BUDGET, order="doc_id") + """,
    sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY config, batch) AS longest FROM batches)
    SELECT config, id, batch, len(ids) AS n, coalesce(array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ' '), '') AS labels FROM sized""",
    ("segments",),
)
