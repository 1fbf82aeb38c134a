"""Every query with an oracle against DuckDB on the smallest tables; every other query must run and give rows."""

import glob
import os
from datetime import datetime, timezone
from decimal import Decimal

import duckdb
import pytest

from veloquent.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, (float, Decimal)):
        return f"{float(x):.12g}"
    if isinstance(x, datetime):
        return x.astimezone(timezone.utc).isoformat()
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    found = duck.execute(catalog.ORACLES[name])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert len(catalog.QUERIES[name](spark, DATA).collect()) > 0  # all columns, which a count would prune


def test_scans_are_pruned_and_filtered(spark):
    plan = catalog.QUERIES["recent_logs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "response_data" not in plan and "GreaterThanOrEqual(created_at" in plan
    plan = catalog.QUERIES["usage_by_key"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "expected_text" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["phoneme_sequences", "phoneme_map", "diphthong_rebuild", "word_overall_rollup", "attempt_words", "observed_lexicon", "tenant_summary", "p2_features", "p3_trailing"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
