"""What the query modules share: registration and SQL fragments of the oracle."""

from __future__ import annotations

from millrace.functions.text import FOLD, HOMOGLYPHS, PUNCTUATION
from millrace.operators.splits import SEED
from millrace.sources.fixtures import VIEWS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """Registers a query; sql is a SELECT, or further CTEs and a SELECT, over the named views."""
    QUERIES[name] = query
    if sql is not None:
        body = sql.strip()
        if views:
            body = "WITH RECURSIVE " + ",\n".join(VIEWS[v] for v in views) + (",\n" if not body.upper().startswith("SELECT") else "\n") + body
        elif not body.upper().startswith(("SELECT", "WITH")):
            body = "WITH RECURSIVE " + body
        ORACLE[name] = body


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(expr: str, table: dict[str, str]) -> str:
    ordered = sorted(table.items(), key=lambda kv: kv[1] == "")
    return f"translate({expr}, {quoted(''.join(k for k, _ in ordered))}, {quoted(''.join(v for _, v in ordered))})"


def norm(expr: str, keep_apostrophe: bool = True) -> str:
    """The normalization chain in SQL without look-around: runs of edge marks first, then marks after and before a
    character that is no letter, digit or underscore."""
    out = f"nfc_normalize(coalesce({expr}, ''))"
    out = _translate(f"lower({_translate(out, FOLD)})", HOMOGLYPHS)
    out = f"translate({out}, {quoted(PUNCTUATION)}, {quoted(' ' * len(PUNCTUATION))})"
    if not keep_apostrophe:
        out = f"translate({out}, '''', ' ')"
    for pattern, new in ((r"[-'']{2,}", " "), (r"(^|[^\p{L}\p{N}_])[-'']", r"\1 "), (r"[-'']($|[^\p{L}\p{N}_])", r" \1")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return rf"trim(regexp_replace({out}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def trainable(expr: str) -> str:
    n = norm(expr)
    return rf"(NOT regexp_matches(coalesce({expr}, ''), '\p{{Nd}}') AND length({n}) >= 2 AND regexp_matches({n}, '\p{{L}}'))"


def split_ctes(view: str, prefix: str = "") -> str:
    """CTE `{prefix}splits(config, book, split)` of a view."""
    p = prefix
    fits = lambda got: f"(f.{got} < o.total * CAST(0.05 AS DOUBLE) AND f.{got} + o.d <= o.total * CAST(0.05 AS DOUBLE) + o.d / 2)"
    return f"""
{p}books AS (SELECT config, book, sum(coalesce(duration, 0)) AS d, md5('{SEED}:' || config || ':' || book) AS h FROM {view} GROUP BY config, book),
{p}ordered AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY h, book) AS rn, sum(d) OVER (PARTITION BY config) AS total,
  count(*) OVER (PARTITION BY config) AS n FROM {p}books),
{p}fold AS (
  SELECT DISTINCT config, CAST('' AS VARCHAR) AS book, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS gt, CAST(0 AS DOUBLE) AS gd, CAST('' AS VARCHAR) AS split FROM {p}ordered
  UNION ALL
  SELECT o.config, o.book, o.rn, f.gt + CASE WHEN {fits('gt')} THEN o.d ELSE 0 END,
    f.gd + CASE WHEN NOT {fits('gt')} AND {fits('gd')} THEN o.d ELSE 0 END,
    CASE WHEN {fits('gt')} THEN 'test' WHEN {fits('gd')} THEN 'dev' ELSE 'train' END
  FROM {p}fold f JOIN {p}ordered o ON o.config = f.config AND o.rn = f.rn + 1
),
{p}rescue AS (SELECT o.config, min_by(o.book, {{'d': o.d, 'rn': o.rn}}) AS book FROM {p}ordered o WHERE o.n > 1 AND o.total > 0
  AND NOT EXISTS (SELECT 1 FROM {p}fold f WHERE f.config = o.config AND f.split = 'test') GROUP BY o.config),
{p}splits AS (SELECT o.config, o.book, CASE WHEN o.total <= 0 THEN 'train' WHEN r.book IS NOT NULL THEN 'test' ELSE f.split END AS split
  FROM {p}ordered o JOIN {p}fold f ON f.config = o.config AND f.rn = o.rn
  LEFT JOIN {p}rescue r ON r.config = o.config AND r.book = o.book)"""
