import pytest
from conftest import SMALL
from oracle import connect, rows

import __spark_entry__ as entry
from matchforge.plans import registry, vectors


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) and len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_topk_by_label", "fuzzy_search_topk", "analogs_scored", "demote_conflicts", "weighted_multiplicity"])
def test_partitions_change_nothing(spark, name):
    first = rows(registry.QUERIES[name](spark, SMALL).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["leader_check", "text_contradictions"])
def test_the_catalogue_is_read_before_the_last_plan(spark, name):
    """A plan that works shortlists out of the catalogue at each look needs more of the driver than the tables do."""
    assert not [f for f in registry.QUERIES[name](spark, SMALL).inputFiles() if "part.parquet" in f]


def test_gold_ranks_behind_a_hot_key(spark, monkeypatch):
    """500 rows of one key are nearer than the query's own key."""
    rows = [(0, "g", 0, [1.0, 0.0]), (1, "g", 1, [0.5, 0.0])] + [(i, "h", i % 2, [0.9, 0.0]) for i in range(2, 502)]
    index = spark.createDataFrame(rows, "row_id bigint, slug string, view bigint, embedding array<double>")
    monkeypatch.setattr(vectors, "index_rows", lambda *_: index)
    monkeypatch.setattr(vectors, "query_rows", lambda *_: index.filter("row_id = 0").selectExpr("row_id AS query_id", "slug AS gold", "embedding"))
    assert [tuple(r) for r in vectors.gold_ranks(spark, SMALL).collect()] == [(0, 1)]
