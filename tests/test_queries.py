"""Every query with SQL against DuckDB on the smallest tables."""

import math
import re

import duckdb
import pytest

from fraglake.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return x if isinstance(x, (str, bool)) else f"{float(x):.9g}"

    return sorted(tuple(str(one(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = plans.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    expected = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = [[r[names.index(c)] for c in columns] for r in expected.fetchall()]
    assert plain(map(tuple, got.select(*columns).collect())) == plain(rows)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8 * 63
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["csm_k5", "csm_by_size", "csm_motifs", "csm_purpyr", "embedding_pca"])
def test_reads_are_not_moved_by_contig(spark, sf, name):
    """A genome has few contigs: shuffled by them alone, all reads would be in a few tasks."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the reads were many
    try:
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert re.search(r"BroadcastHashJoin \[chrom#\d+\]", plan)
    assert not re.search(r"hashpartitioning\(chrom#\d+, \d+\)", plan)
