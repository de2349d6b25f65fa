"""Line dedup by site-relative frequency.

For each host, a line's frequency is the share of the host's pages that contain it; lines above `ratio` on at least
`min_pages` pages are boilerplate of that host and go wherever they occur there. The least number only asks that a line
is on more than one page, so hosts of every size are judged by the ratio. Lines are compared trimmed, by 64-bit hashes;
blank lines stay and are never counted. Rows are pages: repeated rows count as often as they occur. A page without a
host can't be judged and stays whole; a null text is empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_of, unused

RATIO, MIN_PAGES = 0.1, 2


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, gone array<long>) of pages (host, lines). A host's array is short: lines on more than `ratio` of its pages
    number at most the mean lines of a page / ratio."""
    judged = pages.where(F.col("host").isNotNull())
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))
    counts = judged.select("host", F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n"))
    totals = judged.groupBy("host").agg(F.count("*").alias("total"))
    common = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    return common.groupBy("host").agg(F.collect_list("k").alias("gone"))


def drop_boilerplate(
    pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> tuple[DataFrame, Column, Column]:
    """(pages with private columns added, their lines, their lines without the host's boilerplate). The boilerplate
    table is written first, so the planner sees its true size and broadcasts it only under the session's threshold.
    Pages without a host go past the join, which would bring them together."""
    h, every, gone, bad = (unused(pages, f"_millrace_{c}") for c in ("host", "lines", "gone", "bad"))
    held = pages.withColumns({h: host, every: lines})
    found = materialise(boilerplate_lines(held.select(F.col(h).alias("host"), F.col(every).alias("lines")), ratio, min_pages), "boilerplate")
    judged = held.where(F.col(h).isNotNull()).join(found.select(F.col("host").alias(h), F.col("gone").alias(gone)), h, "left")
    # The host's list meets a page's lines in a hash set; only what both hold is sought line by line.
    keys = F.transform(every, lambda x: F.xxhash64(F.trim(x)))
    judged = judged.withColumn(bad, F.array_intersect(keys, F.col(gone))).drop(gone)
    judged = judged.unionByName(held.where(F.col(h).isNull()).withColumn(bad, F.lit(None).cast("array<bigint>")))
    kept = F.when(F.coalesce(F.size(bad), F.lit(0)) <= 0, F.col(every)).otherwise(
        F.filter(every, lambda x: ~F.array_contains(F.col(bad), F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    )
    return judged, F.col(every), kept


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible text of a page as trimmed, non-blank lines: scripts, styles and comments go, block tags break lines."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|form|pre|blockquote)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def op5(spark, sf_dir: str) -> DataFrame:
    """Pages without the boilerplate lines of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(text_of("html")).alias("lines"))
    pages = materialise(pages, "page-lines")  # parsed once, counted and filtered from there
    out, every, kept = drop_boilerplate(pages, F.col("host"), F.col("lines"))
    out = out.select("page_id", "host", F.size(every).cast("long").alias("n_lines"), kept.alias("kept"))
    n_dropped = (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped")
    return out.select("page_id", "host", "n_lines", n_dropped, F.array_join("kept", "\n").alias("text"))


def dedup_document_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The same rows and columns, each text without the boilerplate lines of its host (`host_col`)."""
    out, _, kept = drop_boilerplate(docs, F.col(host_col), F.split(text_of(text_col), "\n", -1))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).select(*docs.columns)


_LINES_SQL = r"""
  list_filter(list_transform(string_split_regex(
    replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|form|pre|blockquote)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'),
    '[\r\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')
"""

ORACLE_OP5 = f"""
WITH pages_ AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
    {_LINES_SQL} AS lines FROM pages
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages_)
  WHERE host IS NOT NULL GROUP BY host, line
), drops AS (
  SELECT c.host, list(c.line) AS gone FROM counts c
  JOIN (SELECT host, count(*) AS total FROM pages_ GROUP BY host) t ON c.host = t.host
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.total GROUP BY c.host
)
SELECT page_id, p.host, len(lines) AS n_lines,
  len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x))) AS n_dropped,
  array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)), chr(10)) AS text
FROM pages_ p LEFT JOIN drops d ON p.host = d.host
"""
