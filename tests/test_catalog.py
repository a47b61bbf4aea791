"""Every query of the tape equals its SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog, exits, learned, more, rest, stats, stopping  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(float(v[i]) if isinstance(v[i], (int, float)) else v[i] for i in order) for v in values), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    want = db.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


def test_features_do_not_look_ahead(spark, sf):
    """Rows after the decision do not change any entry feature."""
    from pyspark.sql import functions as F

    from tidemark.operators import features, triggers
    from tidemark.sources.tape import events_tape

    tape = events_tape(spark, sf)
    at = F.col("k_idx")
    whole = features.entry(features.steps(triggers.with_triggers(tape)), at)
    cut = features.entry(features.steps(triggers.with_triggers(tape.filter("n <= 3"))), at)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_interval_join_does_not_depend_on_bins(spark, sf):
    """One row per purchase, and an empty right side gives nulls."""
    from pyspark.sql import functions as F

    from tidemark.operators import joins
    from tidemark.sources.tape import events_tape

    tape = events_tape(spark, sf)
    left, right = tape.filter("kind = 'purchase'"), tape.filter("kind = 'view'").select("key", "ts", "seq")
    got = joins.trailing_interval(left, right, 5000.0, [F.count("seq").alias("c")], ["n"])
    assert got.count() == left.count()
    none = joins.trailing_interval(left, right.limit(0), 5000.0, [F.count("seq").alias("c")], ["n"])
    assert none.filter("c is not null").count() == 0
