"""Registered queries agree with their oracles on the smallest tables."""

import os

import duckdb
import pytest

import check

SF = "/root/testdata/sf0.001"
NAMES = ["p4_explode_impressions", "v1_table_violations", "m1_rank_hot_groups", "m10_metric_by_slice", "m12_paired_bootstrap",
         "k3_category_rank_orders", "k7_clicks_last_24h", "n3_negative_samples", "e13_attention_scores"]


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(names, cur.fetchall())
