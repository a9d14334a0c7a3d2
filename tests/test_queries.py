"""Every registered query against its SQL, over the smallest tables."""

import pytest
from oracle import difference

from rulelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Tables of a few hundred rows need no more; other tests and the larger tables take many."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF) == ""


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_over_empty_tables(spark, tmp_path):
    """Those that look at a first row, write and read tables, or loop."""
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("title_search", "projection_select", "artifact_store", "term_mentions", "unresolved_suggestions", "dependency_closure", "canonical_edge_order", "directory_snapshot_hash", "concept_book", "plan_contract_issues"):
        rows = catalog.QUERIES[name](spark, str(tmp_path)).count()
        assert rows == {"directory_snapshot_hash": 1, "concept_book": 2, "dependency_closure": 2}.get(name, 0), name
