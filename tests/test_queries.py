"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.operators import scoring
from millrace.plans import corpus, evaluation
from millrace.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    if name not in ORACLE:
        assert got
        return
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(plain(tuple(r[i] for i in at))) for r in found.fetchall())


def test_running_sums_do_not_depend_on_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["drop_reasons"](spark, SF).collect()))
    assert {"kept", "over-budget"} <= {r[2] for r in whole}
    monkeypatch.setattr(corpus, "DROP_BLOCK", 17)
    assert sorted(map(tuple, QUERIES["drop_reasons"](spark, SF).collect())) == whole


def test_bootstrap_runs_all_rounds_of_its_operator(spark):
    errors = evaluation._written(spark, SF).select("conv_id", "turn", "word_errors", "words")
    whole = scoring.bootstrap_delta(errors.where("conv_id % 2 = 0"), errors.where("conv_id % 2 = 1")).first()
    assert plain(tuple(QUERIES["bootstrap_delta"](spark, SF).first())) == plain(tuple(whole))
    assert "range(500)" in ORACLE["bootstrap_delta"] and "round < 2000 " in ORACLE["bootstrap_delta"]
