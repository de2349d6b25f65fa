"""Queries on scores, embeddings and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import scoring, stages, vectors
from millrace.sources import fixtures
from millrace.sources.interim import materialise

from .base import add, norm

pairs, clips = fixtures.pairs, fixtures.clips


def _errors(s, d):
    return scoring.utterance_errors(pairs(s, d))


def _written(s, d):
    """The errors without their texts, found once for plans that read them several times."""
    return materialise(_errors(s, d).select("conv_id", "turn", "config", "language_pred", "word_errors", "words", "char_errors", "chars"), "errors")


#: Distances in SQL. Words: rows of the distance table one after the other, each an array, where a place is the least of
#: what comes from above and of any place before plus the way from there. Characters: the pair's distinct ones become
#: single bytes, as the engine's own distance counts bytes.
_ERRORS = f"""normal AS (SELECT *, {norm("reference")} AS r, {norm("hypothesis")} AS h FROM pairs),
    listed AS (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(h, ' '), lambda w: w <> '') AS hw,
      replace(r, ' ', '') AS rc, replace(h, ' ', '') AS hc, list_distinct(string_split(replace(r || h, ' ', ''), '')) AS known FROM normal),
    steps AS (
      SELECT conv_id, turn, 0::BIGINT AS i, range(0, len(hw) + 1) AS held, rw, hw FROM listed
      UNION ALL
      SELECT conv_id, turn, i + 1, list_transform(range(0, len(hw) + 1), lambda j: list_min(reach[1:j + 1]) + j), rw, hw
      FROM (SELECT conv_id, turn, i, rw, hw, list_prepend(i + 1, list_transform(range(1, len(hw) + 1),
        lambda j: least(held[j + 1] + 1, held[j] + CASE WHEN rw[i + 1] = hw[j] THEN 0 ELSE 1 END) - j)) AS reach FROM steps WHERE i < len(rw))
    ),
    words AS (SELECT conv_id, turn, held[len(hw) + 1] AS word_errors FROM steps WHERE i = len(rw)),
    errors AS (SELECT l.conv_id, l.turn, config, language_pred, word_errors, len(rw) AS words, length(rc) AS chars,
      levenshtein(translate(rc, array_to_string(known, ''), array_to_string(list_transform(range(1, len(known) + 1), lambda c: chr(CAST(c AS INTEGER))), '')),
        translate(hc, array_to_string(known, ''), array_to_string(list_transform(range(1, len(known) + 1), lambda c: chr(CAST(c AS INTEGER))), ''))) AS char_errors
      FROM listed l JOIN words w ON l.conv_id = w.conv_id AND l.turn = w.turn)"""
_RATE = "CASE WHEN sum({b}) > 0 THEN CAST(sum({a}) AS DOUBLE) / CAST(sum({b}) AS DOUBLE) ELSE 0 END"
_WER, _CER = _RATE.format(a="word_errors", b="words"), _RATE.format(a="char_errors", b="chars")
_SCORES = f"""count(*) AS n, CAST(sum(word_errors) AS BIGINT) AS word_errors, CAST(sum(words) AS BIGINT) AS words, CAST(sum(char_errors) AS BIGINT) AS char_errors,
      CAST(sum(chars) AS BIGINT) AS chars, round({_WER}, 4) AS wer, round({_CER}, 4) AS cer, avg(CASE WHEN language_pred <> '' THEN CAST(language_pred = config AS INTEGER) END) AS lid_acc"""
add(
    "utterance_errors",
    lambda s, d: _errors(s, d).select("conv_id", "turn", "config", "word_errors", "words", "char_errors", "chars"),
    f"{_ERRORS} SELECT conv_id, turn, config, word_errors, words, char_errors, chars FROM errors",
    ("pairs",),
)
add("wer_cer_by_lang", lambda s, d: scoring.scores_by_config(_errors(s, d)), f"{_ERRORS} SELECT config, {_SCORES} FROM errors GROUP BY config", ("pairs",))
add(
    "score_rollup",
    lambda s, d: scoring.rollup(_written(s, d)),
    f"""{_ERRORS}, per AS (SELECT config, {_SCORES} FROM errors GROUP BY config)
    SELECT * FROM per UNION ALL SELECT '__micro__', {_SCORES} FROM errors
    UNION ALL SELECT '__macro__', CAST(sum(n) AS BIGINT), CAST(sum(word_errors) AS BIGINT), CAST(sum(words) AS BIGINT), CAST(sum(char_errors) AS BIGINT), CAST(sum(chars) AS BIGINT),
      round(avg(wer), 4), round(avg(cer), 4), avg(lid_acc) FROM per""",
    ("pairs",),
)
add(
    "lid_accuracy",
    lambda s, d: scoring.lid_accuracy(pairs(s, d)),
    "SELECT config, count(*) AS n, avg(CAST(language_pred = config AS INTEGER)) AS lid_acc FROM pairs WHERE language_pred <> '' GROUP BY config",
    ("pairs",),
)
add(
    "leak_gap",
    lambda s, d: (lambda e: scoring.leak_gap(e.where("conv_id % 2 = 0"), e.where("conv_id % 2 = 1")))(_written(s, d)),
    f"""{_ERRORS}, side AS (SELECT config, conv_id % 2 AS k, {_WER} AS rate FROM errors GROUP BY 1, 2)
    SELECT a.config, a.rate AS honest, b.rate AS leaked, (a.rate - b.rate) * 100 AS gap_points, CASE WHEN b.rate > 0 THEN a.rate / b.rate - 1 END AS inflation
    FROM side a JOIN side b ON a.config = b.config AND a.k = 0 AND b.k = 1""",
    ("pairs",),
)
add(
    "leak_verdict",
    lambda s, d: fixtures.read(s, d, "supplier").select("s_suppkey", scoring.verdict(F.col("s_acctbal") - 500, F.col("s_acctbal") + F.col("s_nationkey") * 100).alias("verdict")),
    """SELECT s_suppkey, CASE WHEN s_acctbal - 500 <= 0 AND s_acctbal + s_nationkey * 100 >= 0 THEN 'spans zero' WHEN s_acctbal - 500 > 0 THEN 'leakage helps' ELSE 'leakage hurts' END AS verdict
    FROM supplier""",
)
add(
    "matched_compare",
    lambda s, d: (lambda e: scoring.matched_compare(e, e.where("config <> 'system' and turn % 2 = 0")))(_written(s, d)),
    f"""{_ERRORS}, theirs AS (SELECT * FROM errors WHERE config <> 'system' AND turn % 2 = 0), ours AS (SELECT * FROM errors WHERE config IN (SELECT config FROM theirs))
    SELECT o.*, t.* FROM (SELECT {_WER} AS ours, count(*) AS n_ours FROM ours) o, (SELECT {_WER} AS theirs, count(*) AS n_theirs FROM theirs) t""",
    ("pairs",),
)
add(
    "not_covered",
    lambda s, d: pairs(s, d).select("config").distinct().join(pairs(s, d).where("config <> 'system'").select("config"), "config", "left_anti"),
    "SELECT DISTINCT config FROM pairs WHERE config NOT IN (SELECT config FROM pairs WHERE config <> 'system')",
    ("pairs",),
)
#: As many as the reference draws.
_ROUNDS = 2000
_TIMES = " + ".join(f"CAST(u >= {step} AS BIGINT)" for step in scoring.poisson_steps())
add(
    "bootstrap_delta",
    lambda s, d: (lambda e: scoring.bootstrap_delta(e.where("conv_id % 2 = 0"), e.where("conv_id % 2 = 1"), _ROUNDS))(_written(s, d)).select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")]),
    f"""{_ERRORS}, tagged AS (SELECT conv_id % 2 AS side, conv_id || ':' || turn AS key, word_errors AS e, words AS w FROM errors),
    nth AS (SELECT *, row_number() OVER (PARTITION BY side, key ORDER BY e, w) AS nth FROM tagged),
    drawn AS (SELECT four * 4 + j AS round, side, e, w, CAST('0x' || substr(md5('7:' || side || ':' || four || ':' || key || ':' || nth), CAST(8 * j + 1 AS BIGINT), 8) AS UBIGINT) AS u
      FROM nth, range({-(-_ROUNDS // 4)}) f(four), range(4) j(j)),
    sums AS (SELECT round, side, sum(e * ({_TIMES})) AS e, sum(w * ({_TIMES})) AS w FROM drawn WHERE round < {_ROUNDS} GROUP BY round, side),
    deltas AS (SELECT round, sum((1 - 2 * side) * CASE WHEN w > 0 THEN CAST(e AS DOUBLE) / CAST(w AS DOUBLE) ELSE 0 END) AS d FROM sums GROUP BY round)
    SELECT round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM deltas""",
    ("pairs",),
)

_NORMS = "n AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM clips)"
_PAIRS = f"""{_NORMS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.book AS book_a, b.book AS book_b,
      list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2])) / (a.n * b.n) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE a.n > 1e-6 AND b.n > 1e-6)"""
add(
    "l2_normalize",
    lambda s, d: vectors.l2_normalize(clips(s, d)).select("vec_id", F.posexplode("vector").alias("i", "x")),
    f"{_NORMS} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, vector[i] / n AS x FROM (SELECT *, unnest(range(1, len(vector) + 1)) AS i FROM n WHERE n > 1e-6)",
    ("clips",),
)
add("pairwise_similarity", lambda s, d: vectors.similarity_pairs(clips(s, d)), f"{_PAIRS} SELECT a, b, book_a, book_b, cosine FROM p", ("clips",))
add(
    "similarity_stats",
    lambda s, d: vectors.similarity_stats(clips(s, d)),
    f"{_PAIRS} SELECT CASE WHEN book_a = book_b THEN 'within' ELSE 'across' END AS kind, count(*) * 2 AS n, round(avg(cosine), 6) AS mean, round(quantile_cont(cosine, 0.05), 6) AS p5 FROM p GROUP BY 1",
    ("clips",),
)
add("auto_threshold", lambda s, d: vectors.auto_threshold(clips(s, d)), f"{_PAIRS} SELECT round(1 - quantile_cont(cosine, 0.05), 6) AS threshold FROM p WHERE book_a = book_b", ("clips",))
add(
    "standardize",
    lambda s, d: vectors.standardize(clips(s, d)).withColumn("z", F.round("z", 6)),
    """e AS (SELECT vec_id, i, vector[i] AS x FROM (SELECT *, unnest(range(1, len(vector) + 1)) AS i FROM clips)), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i)
    SELECT vec_id, CAST(e.i - 1 AS INTEGER) AS i, round((x - m) / (s + 1e-8), 6) AS z FROM e JOIN m USING (i)""",
    ("clips",),
)
# One partition for every book, as in the reference's survey of one configuration after the other.
add(
    "cluster_clips",
    lambda s, d: vectors.cluster_clips(clips(s, d).withColumnRenamed("book", "config"), 0.9),
    """e AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x * x))) + 1e-8 AS n FROM clips),
    d AS (SELECT a.book AS config, a.vec_id AS a, b.vec_id AS b, 1 - list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2])) / (a.n * b.n) AS d
      FROM e a JOIN e b ON a.book = b.book AND a.vec_id < b.vec_id),
    merges AS (
      SELECT 0 AS step, book AS config, vec_id, vec_id AS label FROM clips
      UNION ALL
      SELECT s.step + 1, s.config, s.vec_id, CASE WHEN s.label = m.hi THEN m.lo ELSE s.label END
      FROM merges s JOIN (
        SELECT config, lo, hi FROM (
          SELECT *, row_number() OVER (PARTITION BY config ORDER BY d, lo, hi) AS r FROM (
            SELECT d.config, least(x.label, y.label) AS lo, greatest(x.label, y.label) AS hi, avg(d.d) AS d
            FROM d JOIN merges x ON x.config = d.config AND x.vec_id = d.a JOIN merges y ON y.config = d.config AND y.vec_id = d.b WHERE x.label <> y.label GROUP BY ALL))
        WHERE r = 1 AND d < 0.9) m ON m.config = s.config
    ), last AS (SELECT config, vec_id, max_by(label, step) AS label FROM merges GROUP BY config, vec_id)
    SELECT config, vec_id, dense_rank() OVER (PARTITION BY config ORDER BY label) - 1 AS cluster FROM last""",
    ("clips",),
)


def _votes(s, d):
    return vectors.majority_vote(clips(s, d).withColumn("cluster", F.col("vec_id") % 4))


def _clusters(s, d):
    hours = clips(s, d).groupBy("book").agg((F.sum((F.col("vec_id") % 60).cast("double")) / 3600).alias("hours"))
    return vectors.cluster_hours(_votes(s, d), hours)


_VOTES = """c AS (SELECT book, vec_id % 4 AS cluster, count(*) AS n FROM clips GROUP BY 1, 2),
    votes AS (SELECT book, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, cluster) AS r FROM c) WHERE r = 1)"""
_HOURS = f"""{_VOTES}, h AS (SELECT book, sum(CAST(vec_id % 60 AS DOUBLE)) / 3600 AS hours FROM clips GROUP BY book),
    per AS (SELECT cluster, count(*) AS n_books, sum(coalesce(hours, 0)) AS hours FROM votes LEFT JOIN h USING (book) GROUP BY cluster)"""
add("majority_vote", _votes, f"{_VOTES} SELECT book, cluster, n FROM votes", ("clips",))
add("cluster_hours", lambda s, d: _clusters(s, d).withColumn("hours", F.round("hours", 9)), f"{_HOURS} SELECT cluster, n_books, round(hours, 9) AS hours FROM per", ("clips",))
add(
    "cluster_rank",
    lambda s, d: vectors.rank_clusters(_clusters(s, d)).withColumns({c: F.round(c, 9) for c in ("largest_hours", "share")}),
    f"{_HOURS} SELECT count(*) AS n_clusters, arg_max(cluster, {{'h': hours, 'c': -cluster}}) AS largest, round(max(hours), 9) AS largest_hours, round(max(hours) / greatest(sum(hours), 1e-9), 9) AS share FROM per",
    ("clips",),
)


def _viable(s, d):
    per = fixtures.segments(s, d).groupBy("config", (F.col("chapter") % 4).alias("cluster")).agg((F.sum("duration") / 3600).alias("hours"))
    return per.groupBy("config").agg(
        F.count("*").alias("n_speakers"), F.max("hours").alias("largest_hours"), (F.max("hours") >= 10).alias("viable"), (F.count("*") == 1).alias("single")
    )


add(
    "tts_viability",
    _viable,
    """p AS (SELECT config, chapter % 4 AS cluster, sum(duration) / 3600 AS hours FROM segments GROUP BY 1, 2)
    SELECT config, count(*) AS n_speakers, max(hours) AS largest_hours, max(hours) >= 10 AS viable, count(*) = 1 AS single FROM p GROUP BY config""",
    ("segments",),
)


def _points(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return fixtures.read(s, d, "events").select("user_id", F.row_number().over(order).alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).select(
        "user_id", "step", (F.col("us") / 1000000).alias("seconds")
    )


add(
    "progress_rate",
    lambda s, d: stages.progress_rate(_points(s, d)),
    """WITH p AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step, epoch_us(ts) / 1000000 AS seconds FROM events),
    e AS (SELECT user_id, min(step) AS first, max(step) AS last, min(seconds) AS t0, max(seconds) AS t1 FROM p GROUP BY user_id)
    SELECT user_id, first, last, CASE WHEN t1 > t0 THEN (last - first) / (t1 - t0) ELSE CAST(last AS DOUBLE) END AS rate FROM e""",
)
add(
    "newest_step",
    lambda s, d: stages.newest_step(fixtures.read(s, d, "orders").select(F.concat(F.lit("ckpt/step"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", ".pt").otherwise(".tmp")).alias("name"))),
    "SELECT max(o_orderkey) AS step, 'ckpt/step' || max(o_orderkey) || '.pt' AS name FROM orders WHERE o_orderstatus = 'F'",
)
add(
    "cosine_lr",
    lambda s, d: fixtures.read(s, d, "orders").select(F.col("o_orderkey").alias("step"), F.round(A.cosine_rate(F.col("o_orderkey"), 1000, 24_000), 9).alias("rate")),
    "SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 1000 THEN o_orderkey / 1000 ELSE 0.5 * (1 + cos(pi() * least((o_orderkey - 1000) / 23000, 1))) END, 9) AS rate FROM orders",
)


def _classified(s, d):
    p = A.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return fixtures.read(s, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", A.argmax(F.col("p")).alias("best"), F.round(F.array_max("p"), 9).alias("confidence"))


add(
    "softmax_argmax",
    _classified,
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings)
    SELECT vec_id, list_position(e, list_max(e)) - 1 AS best, round(list_max(e) / list_sum(e), 9) AS confidence FROM e""",
)


_PHASES = A.filter_phases(3, 2)
_SIDE = len(_PHASES[0]) // 2
add(
    "resampled",
    lambda s, d: clips(s, d).select("vec_id", F.posexplode(A.resample(F.col("vector"), 16_000, 24_000)).alias("i", "x")).withColumn("x", F.round("x", 9)).withColumn("x", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x"))),
    f"""e AS (SELECT vec_id, vector, unnest(range(0, CAST(ceil(len(vector) * 3 / 2) AS BIGINT))) AS i FROM clips)
    SELECT vec_id, i, CASE WHEN x = 0 THEN 0 ELSE x END AS x FROM (SELECT vec_id, CAST(i AS INTEGER) AS i, round(list_sum(list_transform(range({-_SIDE}, {_SIDE + 1}), lambda j:
      CASE WHEN i * 2 // 3 - j BETWEEN 0 AND len(vector) - 1 THEN vector[i * 2 // 3 - j + 1] ELSE 0 END * ({_PHASES})[i * 2 % 3 + 1][j + {_SIDE + 1}])), 9) AS x FROM e)""",
    ("clips",),
)


def _agreement(s, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = fixtures.read(s, d, "embeddings").select("vec_id", x.alias("x"), F.transform(x, lambda v: F.floor(v * 64) / 64).alias("y"))
    return e.select("vec_id", A.largest_difference(F.col("x"), F.col("y")).alias("largest"), (A.argmax(F.col("x")) == A.argmax(F.col("y"))).alias("agrees"))


add(
    "array_agreement",
    _agreement,
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 64) / 64) AS y FROM embeddings)
    SELECT vec_id, list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) AS largest, list_position(x, list_max(x)) = list_position(y, list_max(y)) AS agrees FROM e""",
)
