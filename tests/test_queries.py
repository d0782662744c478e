"""Every registered query of the library: against its SQL, or at least that it runs over whole tables."""

from __future__ import annotations

import pytest

from granary.operators import registry
from tests.compare import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, con, name):
    same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0


def test_entry_imports_without_extras(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["doc_id", "contaminated", "n_shared", "first_item"]


def test_exact_jaccard_on_a_small_table(spark, small, con):
    from granary.operators.dedup import EXACT_JACCARD_SQL

    same(QUERIES["near_dup_exact_jaccard"](spark, small), con, EXACT_JACCARD_SQL)


def test_log_window_join_makes_no_pairs(spark, tmp_path):
    """Ends that equal a value, equal and repeated balances, none, and many customers of a few values, whose pairs were all made before."""
    import duckdb

    con = duckdb.connect()
    con.execute("""CREATE TABLE customer AS SELECT k AS c_custkey, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN -5.0 WHEN k % 5 = 0 THEN 1.0 WHEN k % 3 = 0 THEN round(0.98 + 0.01 * (k % 6), 2) ELSE (k * 7919 % 1000003) / 100.0 END AS c_acctbal FROM range(40000) r(k)
                   UNION ALL SELECT 50000 + k, v FROM (VALUES (0, 'inf'::DOUBLE), (1, 98.0), (2, 102.0), (3, 97.99), (4, 102.01)) x(k, v)""")
    con.execute("CREATE TABLE supplier AS SELECT k AS s_suppkey, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 THEN 100.0 WHEN k % 4 = 1 THEN 1.0 ELSE (k * 104729 % 1000003) / 100.0 END AS s_acctbal FROM range(2000) r(k) UNION ALL SELECT 3000, 'inf'::DOUBLE")
    for name in ("customer", "supplier"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    df = QUERIES["log_window_join"](spark, str(tmp_path))
    same(df, con, SQL["log_window_join"])
    assert "BroadcastNestedLoopJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Window" in plan
