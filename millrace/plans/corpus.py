"""Queries on scans, ids, profiles, mixtures and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import parse as P
from millrace.functions import text as X
from millrace.operators import batching, dedupe, mixture, profile, quantiles, splits, stages, testset
from millrace.operators.splits import SEED
from millrace.sources import fixtures, lookup, packs, scans
from millrace.sources.fixtures import BIG_ORDER
from millrace.sources.interim import materialise
from millrace.streaming import ingest

from .base import add, norm, split_ctes, trainable
from .texts import RUNS

seg, big = fixtures.segments, fixtures.segments_big
_ALL = ", ".join(BIG_ORDER)


def _splits(s, d):
    return splits.assign_groups(seg(s, d))


def _big_splits(s, d):
    return splits.assign_groups(big(s, d))


_S, _B = split_ctes("segments"), split_ctes("big")

add("scan_projected", lambda s, d: scans.project(big(s, d), ["config", "id", "duration", "shard", "absent"]), "SELECT config, id, duration, shard FROM big", ("big",))


def _files(s, d):
    """Segments written to a folder for each config: rows and hours as read back, and how many of the files that hold
    them the listing lacks."""
    root = lookup.scratch(s, "by-config")
    big(s, d).withColumn("folder", F.col("config")).select("folder", "id", "duration").write.partitionBy("folder").parquet(root)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name")
    held = s.read.option("recursiveFileLookup", "true").parquet(root).select("id", "duration", F.col("_metadata.file_path").alias("path"))
    per = held.groupBy("path").agg(F.count("id").alias("n"), F.sum("duration").alias("seconds")).select(name, "n", "seconds")
    listed = scans.files_by_partition(s, root).where("length > 0").select(name, F.lit(0).alias("gone"))
    config = F.regexp_extract("name", "^folder=([^/]+)/", 1).alias("config")
    told = per.join(listed, "name", "left").groupBy(config)
    return told.agg(F.sum("n").alias("n_rows"), (F.sum("seconds") / 3600).alias("hours"), F.sum(F.coalesce("gone", F.lit(1))).cast("long").alias("unlisted"))


add("scan_files_by_partition", _files, "SELECT config, count(*) AS n_rows, sum(duration) / 3600 AS hours, CAST(0 AS BIGINT) AS unlisted FROM big GROUP BY config", ("big",))
add(
    "shard_prefix_sample",
    lambda s, d: scans.first_shards(big(s, d), 4).groupBy("config").agg(
        F.countDistinct("shard").alias("n_shards"), F.count("*").alias("n_rows"), (F.sum("duration") * F.first("scale") / 3600).alias("hours")
    ),
    """o AS (SELECT config, shard, row_number() OVER (PARTITION BY config ORDER BY shard) AS r, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, shard FROM big))
    SELECT b.config, count(DISTINCT b.shard) AS n_shards, count(*) AS n_rows, sum(duration) * any_value(n / least(n, 4)) / 3600 AS hours
    FROM big b JOIN o ON b.config = o.config AND b.shard = o.shard WHERE r <= 4 GROUP BY b.config""",
    ("big",),
)
add(
    "even_spread_sample",
    lambda s, d: scans.spread_shards(big(s, d), 5).groupBy("config", "shard").agg(F.count("*").alias("n_rows")),
    """o AS (SELECT config, shard, row_number() OVER (PARTITION BY config ORDER BY shard) - 1 AS r, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, shard FROM big)),
    p AS (SELECT * FROM o WHERE n <= 5 OR r IN (SELECT CAST(floor(i * (n - 1) / 4) AS BIGINT) FROM range(5) t(i)))
    SELECT b.config, b.shard, count(*) AS n_rows FROM big b JOIN p ON b.config = p.config AND b.shard = p.shard GROUP BY 1, 2""",
    ("big",),
)


def _urgent(s, d):
    return fixtures.read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat("o_orderkey", F.lit(".1")).alias("id"))


add(
    "lookup_ids_semi",
    lambda s, d: scans.lookup(big(s, d), _urgent(s, d)).select("config", "id", "duration", "shard"),
    "SELECT config, id, duration, shard FROM big WHERE id IN (SELECT o_orderkey || '.1' FROM orders WHERE o_orderpriority = '1-URGENT')",
    ("big",),
)
add(
    "lookup_missing_anti",
    lambda s, d: scans.not_found(big(s, d), _urgent(s, d)),
    "SELECT DISTINCT o_orderkey || '.1' AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey || '.1' NOT IN (SELECT id FROM big)",
    ("big",),
)
#: Ids of the pruned lookup: few orders of many.
_RARE = "o_totalprice > (SELECT max(o_totalprice) * 0.97 FROM orders)"


def _pruned(s, d):
    orders = fixtures.read(s, d, "orders")
    top = orders.agg((F.max("o_totalprice") * 0.97).alias("least"))
    ids = orders.join(top, F.col("o_totalprice") > F.col("least")).select(F.concat("o_orderkey", F.lit(".1")).alias("id"))
    path = lookup.scratch(s, "by-id")
    lookup.write_by_id(big(s, d), path)
    return lookup.lookup_by_id(s, path, ids, columns=["config", "duration", "shard"]).select("config", "id", "duration", "shard")


add("lookup_pruned", _pruned, f"SELECT config, id, duration, shard FROM big WHERE id IN (SELECT o_orderkey || '.1' FROM orders WHERE {_RARE})", ("big",))


def _search(s, d):
    """AF: ids of the two hinted shards alone; NF: ids of any shard, no hint; RF: also ids that no shard holds."""
    rows, path = big(s, d), lookup.scratch(s, "shards")
    lookup.write_shards_apart(rows, path)
    tenth = F.col("l_partkey") % 10 == 3
    wanted = rows.where("config = 'AF' AND shard IN (9, 12) OR config = 'NF' AND l_partkey % 10 = 3").select("config", "id")
    some = rows.where((F.col("config") == "RF") & tenth)
    wanted = wanted.unionByName(some.select("config", "id")).unionByName(some.select("config", F.concat(F.lit("x"), "id").alias("id")))
    hints = s.createDataFrame([("AF", 9), ("AF", 12)], "config string, shard int")
    out = lookup.find_in_waves(s, path, wanted, hints, 2, tuple(BIG_ORDER))
    none = F.lit(None)
    return (
        out.found.select(F.lit("found").alias("status"), "config", "id", "shard", none.cast("int").alias("wave"))
        .unionByName(out.missing.select(F.lit("missing").alias("status"), "config", "id", none.cast("int").alias("shard"), none.cast("int").alias("wave")))
        .unionByName(out.read.select(F.lit("read").alias("status"), "config", none.cast("string").alias("id"), "shard", "wave"))
    )


add(
    "lookup_in_waves",
    _search,
    """wanted AS (SELECT DISTINCT config, id FROM big WHERE config = 'AF' AND shard IN (9, 12) OR config IN ('NF', 'RF') AND l_partkey % 10 = 3
      UNION SELECT config, 'x' || id FROM big WHERE config = 'RF' AND l_partkey % 10 = 3),
    placed AS (SELECT config, shard, CAST(floor(log2(place / 2 + 1)) AS INTEGER) AS wave, place FROM (
      SELECT config, shard, row_number() OVER (PARTITION BY config ORDER BY CASE WHEN config = 'AF' AND shard IN (9, 12) THEN 0 ELSE 1 END, shard) - 1 AS place
      FROM (SELECT DISTINCT config, shard FROM big))),
    first AS (SELECT w.config, w.id, min_by(p.shard, p.place) AS shard, min(p.wave) AS wave FROM wanted w LEFT JOIN big b ON b.config = w.config AND b.id = w.id
      LEFT JOIN placed p ON p.config = b.config AND p.shard = b.shard GROUP BY 1, 2),
    reach AS (SELECT config, CASE WHEN count(*) = count(wave) THEN max(wave) ELSE 1000 END AS upto FROM first GROUP BY config)
    SELECT CASE WHEN shard IS NULL THEN 'missing' ELSE 'found' END AS status, config, id, shard, CAST(NULL AS INTEGER) AS wave FROM first
    UNION ALL SELECT 'read', p.config, NULL, shard, wave FROM placed p JOIN reach r ON r.config = p.config AND p.wave <= r.upto""",
    ("big",),
)
add(
    "to_schema",
    lambda s, d: scans.to_schema(seg(s, d).drop("book").withColumn("audio", F.struct(F.encode("id", "utf-8").alias("bytes"), F.lit("x").alias("path")))).withColumn("audio", F.decode("audio", "utf-8")),
    "SELECT config, id, coalesce(text, '') AS text, CAST(duration AS FLOAT) AS duration, source_file, book, id AS audio FROM segments",
    ("segments",),
)
_REQUIRED = ["id", "language", "text", "duration", "source_file", "audio"]
add(
    "schema_check",
    lambda s, d: scans.missing_columns(seg(s, d), _REQUIRED),
    "SELECT \"column\", status, n FROM (SELECT count(id) AS i, count(text) AS t, count(duration) AS d, count(source_file) AS f FROM segments), "
    "LATERAL (VALUES ('id', 'ok', i), ('language', 'FAIL', 0), ('text', 'ok', t), ('duration', 'ok', d), ('source_file', 'ok', f), ('audio', 'FAIL', 0)) v(\"column\", status, n)",
    ("segments",),
)
add(
    "artifact_check",
    lambda s, d: stages.artifact_check(big(s, d)),
    """SELECT count(*) AS n_rows, count(DISTINCT config) AS n_configs, count(DISTINCT (config, id)) AS n_ids, count(DISTINCT (config, book)) AS n_books,
    count(*) FILTER (WHERE duration <= 0) AS n_empty FROM big""",
    ("big",),
)
add(
    "id_uniqueness",
    lambda s, d: dedupe.id_uniqueness(big(s, d)),
    """SELECT config, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(duration) / 3600 AS hours, count(*) / count(DISTINCT id) AS factor,
    sum(duration) / 3600 * count(DISTINCT id) / count(*) AS unique_hours FROM big GROUP BY config HAVING count(*) > count(DISTINCT id)""",
    ("big",),
)


def _train(s, d):
    return big(s, d).join(_big_splits(s, d).where("split = 'train'"), ["config", "book"], "left_semi")


_TRAIN = f"{_B}, train AS (SELECT b.* FROM big b JOIN splits p ON b.config = p.config AND b.book = p.book WHERE p.split = 'train')"
add("dedupe_min_duration", lambda s, d: dedupe.min_duration(_train(s, d)), f"{_TRAIN} SELECT config, id, min(duration) AS duration FROM train GROUP BY config, id", ("big",))
_KEPT = ["config", "id", "duration", "book", "shard", "l_partkey", "l_extendedprice"]
add(
    "dedupe_argmin_row",
    lambda s, d: dedupe.first_row(big(s, d), ["duration", *BIG_ORDER]).select(*_KEPT),
    f"SELECT {', '.join(_KEPT)} FROM (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY duration, {_ALL}) AS r FROM big) WHERE r = 1",
    ("big",),
)
add(
    "dedupe_first_row",
    lambda s, d: dedupe.first_row(big(s, d), list(BIG_ORDER)).select(*_KEPT),
    f"SELECT {', '.join(_KEPT)} FROM (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY {_ALL}) AS r FROM big) WHERE r = 1",
    ("big",),
)
add("dedupe_min_shard", lambda s, d: dedupe.min_shard(big(s, d)), "SELECT config, id, min(shard) AS shard FROM big GROUP BY config, id", ("big",))
add("duration_between", lambda s, d: big(s, d).where(F.col("duration").between(5, 20)).select("config", "id", "duration"), "SELECT config, id, duration FROM big WHERE duration BETWEEN 5 AND 20", ("big",))
add(
    "duration_fallback",
    lambda s, d: fixtures.read(s, d, "documents").select(
        "doc_id",
        P.duration_of(
            F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, "n/a"), F.octet_length("text")
        ).alias("seconds"),
    ),
    """SELECT doc_id, coalesce(TRY_CAST(CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN 'n/a' END AS DOUBLE) / 1000,
      greatest(strlen(text) - 44, 0) / CAST(32000 AS DOUBLE)) AS seconds FROM documents""",
)
add("coverage_filter", lambda s, d: seg(s, d).where(P.iso_of(F.col("config")).isin("fra", "deu", "xyz")).select("config", "id"), "SELECT config, id FROM segments WHERE split_part(config, '_', -1) IN ('fra', 'deu', 'xyz')", ("segments",))
_ASKED = ["SRC0", "SRC7", "SRC19", "SRC20", "GEN"]
add(
    "absent_books",
    lambda s, d: scans.not_found(seg(s, d).select("book"), s.createDataFrame([(b,) for b in _ASKED], "book string"), "book"),
    "SELECT book FROM (VALUES " + ", ".join(f"('{b}')" for b in _ASKED) + ") t(book) WHERE book NOT IN (SELECT book FROM segments)",
    ("segments",),
)

def _profile_sql(most: str) -> str:
    """The audit row in SQL; `most` limits the shards."""
    return f"""o AS (SELECT config, shard, row_number() OVER (PARTITION BY config ORDER BY shard) AS r, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, shard FROM segments)),
    scale AS (SELECT config, CAST(count(*) AS DOUBLE) / count(*) FILTER (WHERE r <= {most}) AS scale, count(*) AS n_files FROM o GROUP BY config),
    seg AS (SELECT s.* FROM segments s JOIN o ON o.config = s.config AND o.shard = s.shard WHERE r <= {most}),
    src AS (SELECT config, source_file, count(*) AS n FROM seg GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY n DESC, source_file) AS r FROM src),
    a AS (SELECT config, count(*) AS n_sources, max(n) AS max_per_source, sum(n) FILTER (WHERE r <= 1) / sum(n) AS top1_share, sum(n) FILTER (WHERE r <= 5) / sum(n) AS top5_share,
      string_agg(source_file, ',' ORDER BY r) FILTER (WHERE r <= 3) AS sample_sources,
      CAST(list_sort(list(n))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE) AS median_per_source FROM ranked GROUP BY config),
    b AS (SELECT config, count(*) AS n, sum(duration) / 3600 AS hours, max(duration) AS duration_max,
      list_sort(list(duration))[CAST(floor(CAST(0.5 AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS duration_p50,
      list_sort(list(duration))[CAST(floor(CAST(0.9 AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS duration_p90,
      coalesce(first(CASE WHEN text <> '' THEN left(text, 120) END ORDER BY CASE WHEN text <> '' THEN 0 ELSE 1 END, shard, doc_id), '') AS sample_text FROM seg GROUP BY config),
    c AS (SELECT config, count(DISTINCT c) AS charset_size FROM (SELECT config, unnest(string_split(text, '')) AS c FROM seg WHERE text <> '') WHERE c <> '' GROUP BY config)
    SELECT b.config, regexp_extract(b.config, '^(.*)_([a-z]{{3}})$', 1) AS language, regexp_extract(b.config, '^(.*)_([a-z]{{3}})$', 2) AS iso, n_files, CAST(floor(n * scale) AS BIGINT) AS n_segments,
      hours * scale AS total_hours, a.* EXCLUDE (config), duration_p50, duration_p90, duration_max, charset_size, sample_text
    FROM b JOIN scale USING (config) JOIN a USING (config) LEFT JOIN c USING (config)"""


add("profile_by_config", lambda s, d: profile.profile(seg(s, d)), _profile_sql("1000000"), ("segments",))



def _streamed(s, d):
    """Segments that arrive as files in two parts; a file counts once two looks have told the same size."""
    rows, root = seg(s, d), lookup.scratch(s, "stream")
    stream = ingest.ProfileStream(s, f"{root}/files", root, rows.schema)
    for part in ("shard < 5", "shard >= 5"):
        rows.where(part).write.mode("append").parquet(f"{root}/files")
        stream.step()
        stream.step()
    return profile.profile_of(stream.state())


add("profile_streamed", _streamed, _profile_sql("1000000"), ("segments",))
add("profile_sampled", lambda s, d: profile.profile(seg(s, d), 3), _profile_sql("3"), ("segments",))
add(
    "percentile_floor",
    lambda s, d: quantiles.floor_percentiles(big(s, d), {"p50": 0.5, "p90": 0.9, "p99": 0.99}),
    "SELECT config, " + ", ".join(f"list_sort(list(duration))[CAST(floor(CAST({q} AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM big GROUP BY config",
    ("big",),
)
add(
    "percentile_linear",
    lambda s, d: quantiles.linear_percentiles(big(s, d), {"p05": 0.05, "p50": 0.5, "p975": 0.975}).select("config", *[F.round(n, 9).alias(n) for n in ("p05", "p50", "p975")]),
    "SELECT config, " + ", ".join(f"round(quantile_cont(duration, {q}), 9) AS {n}" for n, q in (("p05", 0.05), ("p50", 0.5), ("p975", 0.975))) + " FROM big GROUP BY config",
    ("big",),
)
_DOMINANT = """v AS (SELECT config, version, count(*) AS n, count(DISTINCT book) AS books FROM {view} GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY n DESC, version) AS r, sum(n) OVER (PARTITION BY config) AS total, count(*) OVER (PARTITION BY config) AS versions FROM v)"""
add(
    "version_profile",
    lambda s, d: profile.version_profile(seg(s, d)),
    _DOMINANT.format(view="segments") + " SELECT config, version AS dominant, n, n / total AS share, versions AS n_versions, books AS dominant_books FROM ranked WHERE r = 1",
    ("segments",),
)
add(
    "version_overlap",
    lambda s, d: profile.version_overlap(big(s, d)),
    """o AS (SELECT DISTINCT config, book, version FROM big)
    SELECT a.config, a.version AS v1, b.version AS v2, count(*) AS shared_books FROM o a JOIN o b ON a.config = b.config AND a.book = b.book AND a.version < b.version GROUP BY 1, 2, 3""",
    ("big",),
)
add(
    "dominant_version_filter",
    lambda s, d: profile.dominant_rows(seg(s, d), ["SRC1", "SRC2", "SRC3"]).select("config", "id", "book", "version"),
    _DOMINANT.format(view="segments") + " SELECT s.config, id, book, s.version FROM segments s JOIN ranked r ON s.config = r.config AND s.version = r.version AND r.r = 1 WHERE book IN ('SRC1', 'SRC2', 'SRC3')",
    ("segments",),
)
add(
    "top_sources",
    lambda s, d: seg(s, d).groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file").limit(10),
    "SELECT source_file, count(*) AS n FROM segments GROUP BY 1 ORDER BY n DESC, source_file LIMIT 10",
    ("segments",),
)
add(
    "union_parts",
    lambda s, d: seg(s, d).select("config", "id", "duration").unionByName(big(s, d).select("duration", "config", "id")).groupBy("config").agg(F.count("*").alias("n"), F.sum("duration").alias("total")),
    "u AS (SELECT config, id, duration FROM segments UNION ALL SELECT config, id, duration FROM big) SELECT config, count(*) AS n, sum(duration) AS total FROM u GROUP BY config",
    ("segments", "big"),
)


def _two(s, d):
    a = seg(s, d)
    return a.where("shard < 4").select("config", "book"), a.where("version = '1' and shard >= 2").select("config", "book")


_TWO = ("SELECT config, book FROM segments WHERE shard < 4", "SELECT config, book FROM segments WHERE version = '1' AND shard >= 2")
add("lang_intersect", lambda s, d: (lambda t: t[0].intersect(t[1]))(_two(s, d)), f"SELECT * FROM ({_TWO[0]} INTERSECT {_TWO[1]})", ("segments",))
add("lang_except", lambda s, d: (lambda t: t[0].subtract(t[1]))(_two(s, d)), f"SELECT * FROM ({_TWO[0]} EXCEPT {_TWO[1]})", ("segments",))
add(
    "first_per_group",
    lambda s, d: dedupe.first_row(seg(s, d), ["doc_id"], ("config", "book")).select("config", "book", "id"),
    "SELECT config, book, id FROM (SELECT *, row_number() OVER (PARTITION BY config, book ORDER BY doc_id) AS r FROM segments) WHERE r = 1",
    ("segments",),
)
add("tail_n", lambda s, d: seg(s, d).select("config", "id", "doc_id").orderBy(F.desc("doc_id")).limit(25).drop("doc_id"), "SELECT config, id FROM (SELECT * FROM segments ORDER BY doc_id DESC LIMIT 25)", ("segments",))


def _strided(s, d):
    counts = seg(s, d).groupBy("config", "book").agg(F.count("*").alias("n"))
    order, all_ = Window.partitionBy("config").orderBy(F.desc("n"), "book"), Window.partitionBy("config")
    ranked = counts.select("*", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(all_).alias("total"))
    stride = F.greatest(F.floor(F.col("total") / 6), F.lit(1))
    return ranked.where((F.col("r") % stride == 0) & (F.col("r") < 6 * stride)).select("config", "book", "n")


add(
    "strided_pick",
    _strided,
    """c AS (SELECT config, book, count(*) AS n FROM segments GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY n DESC, book) - 1 AS r, greatest(count(*) OVER (PARTITION BY config) // 6, 1) AS stride FROM c)
    SELECT config, book, n FROM r WHERE r % stride = 0 AND r < 6 * stride""",
    ("segments",),
)
add(
    "lang_index",
    lambda s, d: seg(s, d).select("config").distinct().withColumn("index", (F.row_number().over(Window.orderBy("config")) - 1).cast("long")),
    "SELECT config, row_number() OVER (ORDER BY config) - 1 AS index FROM (SELECT DISTINCT config FROM segments)",
    ("segments",),
)


#: Document ids of a block of running sums.
DROP_BLOCK = 65_536


def _drops(s, d):
    """The first rule that fails names the reason; the budget counts survivors in input order."""
    rows = seg(s, d).withColumn("normal", X.normalize(F.col("text")))
    top = profile.version_profile(rows).select("config", "dominant")
    rows = rows.join(F.broadcast(top), "config")  # a row for each config
    reason = (
        F.when(F.col("version") != F.col("dominant"), "other-version")
        .when(~F.col("book").isin(*[f"SRC{i}" for i in range(15)]), "other-book")
        .when(~F.col("duration").between(100, 6000), "duration")
        .when(X.has_digits(F.col("text")), "digits")
        .when(F.length("normal") < 4, "too-short-text")
    )
    # Sums run within blocks of document ids, on top of the sums of the blocks before, so no window holds a whole config.
    block = F.coalesce(F.floor(F.col("doc_id") / DROP_BLOCK), F.lit(-1 << 62))
    live = F.when(reason.isNull(), F.col("duration")).otherwise(0.0)
    rows = rows.select("config", "id", "doc_id", block.alias("block"), reason.alias("reason"), live.alias("live"))
    rows = materialise(rows, "reasons")
    earlier = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1).orderBy("block" if c == "all" else "doc_id")), F.lit(0.0))
    sums = rows.groupBy("config", "block").agg(F.sum("live").alias("all"))
    sums = sums.select("config", "block", earlier("all", "config").alias("base"))
    out = rows.join(sums, ["config", "block"]).withColumn("before", F.col("base") + earlier("live", "config", "block"))
    over = F.col("reason").isNull() & (F.col("before") >= 36_000)
    return out.select("config", "id", F.when(over, "over-budget").otherwise(F.coalesce("reason", F.lit("kept"))).alias("reason"))


add(
    "drop_reasons",
    _drops,
    _DOMINANT.format(view="segments") + rf""",
    d AS (SELECT s.*, r.version AS dominant, {norm('text')} AS normal FROM segments s JOIN ranked r ON s.config = r.config AND r.r = 1),
    w AS (SELECT *, CASE WHEN version <> dominant THEN 'other-version' WHEN book NOT IN ({", ".join(f"'SRC{i}'" for i in range(15))}) THEN 'other-book'
      WHEN NOT duration BETWEEN 100 AND 6000 THEN 'duration' WHEN regexp_matches(coalesce(text, ''), '\p{{Nd}}') THEN 'digits' WHEN length(normal) < 4 THEN 'too-short-text' END AS reason FROM d),
    p AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN duration ELSE 0 END) OVER (PARTITION BY config ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT config, id, CASE WHEN reason IS NULL AND before >= 36000 THEN 'over-budget' ELSE coalesce(reason, 'kept') END AS reason FROM p""",
    ("segments",),
)

# Mixture
HOURS, CAP = 300.0, 150.0


def _flagged(s, d):
    """Segments without their texts but with whether they may train. Mixtures and evaluation sets read them many times,
    so texts are normalized in one scan and the narrow table is written."""
    rows = seg(s, d).withColumn("normal", X.normalize(F.col("text")))
    rows = rows.withColumn("trainable", X.is_trainable(F.col("text"), F.col("normal")))
    return materialise(rows.select("config", "book", "id", "shard", "duration", "trainable"), "flagged")


def _pool(rows):
    train = splits.assign_groups(rows).where("split = 'train'").select("config", "book")
    return dedupe.min_duration(rows.where("trainable").join(train, ["config", "book"], "left_semi"))


def _weights(rows):
    return mixture.temperature_weights(mixture.available(_pool(rows)))


def _targets(rows):
    return mixture.mixture_targets(_weights(rows), HOURS, CAP)


_POOL = f"""{_S}, pool AS (SELECT s.config, s.id, min(coalesce(duration, 0)) AS duration FROM segments s JOIN splits p ON s.config = p.config AND s.book = p.book AND p.split = 'train'
      WHERE {trainable('text')} GROUP BY s.config, s.id),
    avail AS (SELECT config, sum(duration) / 3600 AS avail FROM pool GROUP BY config)"""
_WEIGHTS = f"""{_POOL}, raw AS (SELECT *, power(avail / (sum(avail) OVER ()), 0.5) AS raw FROM avail),
    weights AS (SELECT config, avail, raw / sum(raw) OVER () AS weight FROM raw)"""
_TARGETS = f"""{_WEIGHTS}, water AS (
      SELECT 0 AS round, config, avail, weight, least(weight * {HOURS}, {CAP}, avail) AS target FROM weights
      UNION ALL
      SELECT round + 1, config, avail, weight, CASE WHEN slack > 0.5 AND target < least({CAP}, avail) - 1e-6 THEN least(target + slack * weight / z, {CAP}, avail) ELSE target END
      FROM (SELECT *, {HOURS} - sum(target) OVER () AS slack, sum(CASE WHEN target < least({CAP}, avail) - 1e-6 THEN weight END) OVER () AS z FROM water WHERE round < 20)
    ), targets AS (SELECT config, avail, weight, CAST(target AS DOUBLE) AS target FROM water WHERE round = 20)"""
add("available_hours", lambda s, d: mixture.available(_pool(_flagged(s, d))), f"{_POOL} SELECT config, avail FROM avail", ("segments",))
add("temperature_weights", lambda s, d: _weights(_flagged(s, d)).withColumn("weight", F.round("weight", 9)), f"{_WEIGHTS} SELECT config, avail, round(weight, 9) AS weight FROM weights", ("segments",))
add(
    "mixture_targets",
    lambda s, d: _targets(_flagged(s, d)).select("config", "avail", F.round("weight", 9).alias("weight"), F.round("target", 6).alias("target")),
    f"{_TARGETS} SELECT config, avail, round(weight, 9) AS weight, round(target, 6) AS target FROM targets",
    ("segments",),
)
add("mixture_shares", lambda s, d: mixture.shares(_targets(_flagged(s, d))).select(F.round("raw_share", 9).alias("raw_share"), F.round("mixed_share", 9).alias("mixed_share")), f"{_TARGETS} SELECT round(max(avail) / greatest(sum(avail), 1e-9), 9) AS raw_share, round(max(target) / greatest(sum(target), 1e-9), 9) AS mixed_share FROM targets", ("segments",))


def _selected(rows):
    return mixture.select_to_budget(_pool(rows), _targets(rows))


_SELECTED = f"""{_TARGETS}, placed AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY config ORDER BY md5('{SEED}:' || config || ':' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pool),
    selected AS (SELECT p.config, p.id, p.duration FROM placed p JOIN targets t ON p.config = t.config WHERE before < target * 3600)"""
add("mixture_select", lambda s, d: _selected(_flagged(s, d)), f"{_SELECTED} SELECT config, id, duration FROM selected", ("segments",))
add("semi_selected_ids", lambda s, d: (lambda rows: rows.join(_selected(rows), ["config", "id"], "left_semi"))(_flagged(s, d)).select("config", "id", "shard"), f"{_SELECTED} SELECT s.config, s.id, shard FROM segments s SEMI JOIN selected USING (config, id)", ("segments",))
add("anti_trained_ids", lambda s, d: (lambda rows: rows.join(_selected(rows), ["config", "id"], "left_anti"))(_flagged(s, d)).select("config", "id", "shard"), f"{_SELECTED} SELECT s.config, s.id, shard FROM segments s ANTI JOIN selected USING (config, id)", ("segments",))

# Evaluation sets
_MATCH = f"""matched AS (SELECT config, book FROM (SELECT p.config, p.book, row_number() OVER (PARTITION BY p.config ORDER BY md5('{SEED}:match:' || p.config || ':' || p.book), p.book) AS r,
      (SELECT count(*) FROM splits t WHERE t.config = p.config AND t.split = 'test') AS n FROM splits p WHERE p.split = 'train') WHERE r <= n)"""
add("match_books", lambda s, d: testset.matched_books(_splits(s, d)), f"{_S}, {_MATCH} SELECT config, book FROM matched", ("segments",))


def _pools(rows, match=True):
    return testset.pools(rows, splits.assign_groups(rows), _selected(rows), F.col("trainable"), match)


_PICKS = f"""{_SELECTED}, {_MATCH}, fit AS (SELECT s.config, s.id, s.book, s.shard, p.split FROM segments s JOIN splits p ON s.config = p.config AND s.book = p.book WHERE {trainable('text')}),
    pools AS (SELECT config, 'honest' AS side, id, min(shard) AS shard FROM fit WHERE split = 'test' GROUP BY config, id
      UNION ALL SELECT config, 'leaked', id, min(shard) FROM fit f WHERE split = 'train'
        AND (NOT EXISTS (SELECT 1 FROM matched m WHERE m.config = f.config) OR EXISTS (SELECT 1 FROM matched m WHERE m.config = f.config AND m.book = f.book))
        AND NOT EXISTS (SELECT 1 FROM selected t WHERE t.config = f.config AND t.id = f.id) GROUP BY config, id)"""
add(
    "eval_sample_topk",
    lambda s, d: testset.sample(_pools(_flagged(s, d)), 20, 5),
    f"""{_PICKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY config, side ORDER BY md5('{SEED}:' || config || ':' || side || ':' || id), id) AS r, count(*) OVER (PARTITION BY config, side) AS n FROM pools)
    SELECT config, side, id, shard FROM ranked WHERE r <= 20 AND (side = 'honest' OR n >= 5)""",
    ("segments",),
)
add(
    "testset_summary",
    lambda s, d: (lambda rows: testset.summary(_pools(rows), rows, 5))(_flagged(s, d)),
    f"""{_PICKS} SELECT c.config, count(*) FILTER (WHERE side = 'honest') AS honest_pool, count(*) FILTER (WHERE side = 'leaked') AS leaked_pool,
      count(*) FILTER (WHERE side = 'leaked') < 5 AS leaked_excluded FROM (SELECT DISTINCT config FROM segments) c LEFT JOIN pools USING (config) GROUP BY c.config""",
    ("segments",),
)
add(
    "pick_clips",
    lambda s, d: testset.pick_clips(seg(s, d), 300, 5000, 8, 3),
    f"""mid AS (SELECT * FROM segments WHERE coalesce(duration, 0) BETWEEN 300 AND 5000),
    b AS (SELECT config, book, row_number() OVER (PARTITION BY config ORDER BY book) - 1 AS spot, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, book FROM mid)),
    c AS (SELECT config, book FROM b WHERE n <= 8 OR spot IN (SELECT CAST(floor(i * (n / 8)) AS BIGINT) FROM range(8) t(i))),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY m.config, m.book ORDER BY md5('{SEED}:' || m.config || ':' || m.book || ':' || id), id, shard) AS r FROM mid m JOIN c ON m.config = c.config AND m.book = c.book)
    SELECT config, book, id, shard FROM r WHERE r <= 3""",
    ("segments",),
)

# Batches and shards
add("length_buckets", lambda s, d: batching.length_buckets(big(s, d), 640.0, order=("id", *BIG_ORDER)).select("config", "id", "duration", "batch"), RUNS.format(key="config", view="big", budget=640, order=f"id, {_ALL}") + " SELECT config, id, duration, batch FROM batches", ("big",))
add(
    "bucket_shuffle",
    lambda s, d: batching.shuffle_batches(batching.length_buckets(big(s, d), 640.0, order=("id", *BIG_ORDER)), 3),
    RUNS.format(key="config", view="big", budget=640, order=f"id, {_ALL}") + f" SELECT config, batch, row_number() OVER (PARTITION BY config ORDER BY md5('{SEED + 3}:' || batch), batch) AS place FROM (SELECT DISTINCT config, batch FROM batches)",
    ("big",),
)
add(
    "size_shards",
    lambda s, d: batching.size_shards(seg(s, d).withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), 100_000, order="doc_id").select("config", "id", F.col("size").cast("long").alias("size"), "shard_id"),
    """o AS (SELECT config, id, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY config ORDER BY doc_id) AS rn FROM segments),
    cut AS (
      SELECT DISTINCT config, CAST('' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS shard_id, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS nxt FROM o
      UNION ALL
      SELECT o.config, o.id, o.size, o.rn, c.nxt, CASE WHEN c.held + o.size >= 100000 THEN 0 ELSE c.held + o.size END, c.nxt + CASE WHEN c.held + o.size >= 100000 THEN 1 ELSE 0 END
      FROM cut c JOIN o ON o.config = c.config AND o.rn = c.rn + 1)
    SELECT config, id, size, shard_id FROM cut WHERE rn > 0""",
    ("segments",),
)


def _packed(s, d):
    """Segments packed by language; what the files' names and footers tell."""
    path = lookup.scratch(s, "packs")
    rows = seg(s, d).select("config", "doc_id", "id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("audio"))
    packs.pack(rows, path, "audio", "config", "doc_id", 0.1, 0.02, {"features": '{"audio": "binary"}'})
    told = packs.footers(s, path)
    return told.select("file", "n_rows", "n_groups", "group_rows", F.get_json_object("footer", "$.features").alias("features"))


add(
    "packed_shards",
    _packed,
    """o AS (SELECT config, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY config ORDER BY doc_id) AS rn FROM segments),
    cut AS (
      SELECT DISTINCT config, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS nxt FROM o
      UNION ALL
      SELECT o.config, o.size, o.rn, c.nxt, CASE WHEN c.held + o.size >= 100000 THEN 0 ELSE c.held + o.size END, c.nxt + CASE WHEN c.held + o.size >= 100000 THEN 1 ELSE 0 END
      FROM cut c JOIN o ON o.config = c.config AND o.rn = c.rn + 1),
    shards AS (SELECT config, shard, count(*) AS n, greatest(CAST(floor(20000 / greatest(avg(size), 1)) AS BIGINT), 1) AS g FROM cut WHERE rn > 0 GROUP BY 1, 2)
    SELECT printf('%s-%05d-of-%05d.parquet', config, shard, count(*) OVER (PARTITION BY config)) AS file, n AS n_rows, CAST(ceil(n / g) AS BIGINT) AS n_groups, least(n, g) AS group_rows,
      '{"audio": "binary"}' AS features FROM shards""",
    ("segments",),
)
