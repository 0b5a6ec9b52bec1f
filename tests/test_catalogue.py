"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from parlquery import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert sorted(repr(tuple(plain(r[k]) for k in order)) for r in found.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Columns and filters reach the files, limits are top-k, no cross joins."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for name in ("fts_ranked_recency", "hybrid_search", "excerpt_range_tier", "filter_file_fts"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "TakeOrderedAndProject" in text, name
    text = plan(registry.QUERIES["messages_clean"](spark, SF))
    assert "PushedFilters: [In(role, [assistant,user])]" in text
    text = plan(registry.QUERIES["vec_knn"](spark, SF))
    assert "TakeOrderedAndProject" in text and "label" not in text
