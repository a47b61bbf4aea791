"""Queries on tables that are larger or otherwise than the given ones, against the same SQL."""

import re

import duckdb
import pytest

from tidemark.plans import catalog, exits, learned, more, rest, stats, stopping  # noqa: F401


@pytest.fixture
def equals_sql(spark, tmp_path):
    def check(name, **tables):
        """``tables``: the SELECT of each, for DuckDB."""
        con = duckdb.connect()
        for t, select in tables.items():
            con.sql(f"COPY ({select}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLE[name])
        at = [want.columns.index(c) for c in df.columns]
        want = [tuple(r[i] for i in at) for r in want.fetchall()]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
        return want

    return check


ORDERS = "SELECT range AS o_orderkey, range % 7 AS o_custkey, 100000.0 + range % 997 AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate FROM range({n})"


@pytest.mark.parametrize("n", [1, 4000])
def test_patterns_first_seen_at_one_time(equals_sql, n):
    """As in large tables, where each pattern occurs on the first day."""
    want = equals_sql("sample_size", orders=ORDERS.format(n=n))
    assert len(want) == 2


EVENTS = "SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, 7::BIGINT AS user_id, '{kind}' AS event_type, value::DOUBLE AS value, '{{\"k\": ' || k || '}}' AS props FROM ({rows})"


def test_losses_that_sum_up_to_the_limit(equals_sql):
    """A loss of exactly 500 is not over it, whatever binary fractions have left in its running sum."""
    (row,) = equals_sql("risk_gates", events=EVENTS.format(kind="error", rows="SELECT range AS event_id, CASE WHEN range < 60 THEN 4.77 WHEN range < 120 THEN 1.49 ELSE 31.1 END AS value, 1 AS k FROM range(129)"))
    assert 4 in row  # of nine rows after the 120th, the fifth meets a loss of 500


def test_means_at_a_whole_number(equals_sql):
    """Ten purchases of 51 on average: which side of it their sum ends on is up to its order."""
    (row,) = equals_sql("sophistication", events=EVENTS.format(kind="click", rows="SELECT range AS event_id, CASE WHEN range < 6 THEN 36.02 ELSE 73.47 END AS value, CASE WHEN range < 6 THEN 31 ELSE 20 END AS k FROM range(12)"))
    assert 50 in row


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_flow_copies_no_row(spark, equals_sql, sf):
    """One shuffle, by which rows were numbered, and no row sent to each of its frames."""
    said = plan(catalog.QUERIES["rolling_flow"](spark, sf))
    assert "Generate" not in said and said.count("Exchange hashpartitioning") == 1
    equals_sql("rolling_flow", events=EVENTS.format(kind="click", rows="SELECT range AS event_id, 1 + range % 50 AS value, 1 AS k FROM range(40)"))


def test_reputation_keeps_no_table_of_pairs(spark, equals_sql, sf):
    """Pairs of actor and key are told apart by a sort: a hash table of them grows with the rows of a task."""
    assert not re.search(r"Aggregate\(keys=\[actor#\d+L?, key#\d+L?\]", plan(catalog.QUERIES["reputation_rowframe"](spark, sf)))
    day = "TIMESTAMP '1995-01-01' + to_days(CAST(range % 40 AS INTEGER))"
    orders = f"SELECT range AS o_orderkey, 150000.0 + range % 3 - 1 AS o_totalprice, {day} AS o_orderdate FROM range(60)"
    equals_sql("reputation_rowframe", orders=orders, lineitem=f"SELECT range % 60 AS l_orderkey, range % 4 AS l_suppkey, {day} AS l_shipdate FROM range(200)")
