"""A choice of queries against DuckDB at the smallest scale; the driver compares all of them at sf0.01."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "a1_monthly_totals", "b3_group_yoy", "w8_ytd_computed", "b7_trade_balance", "b1_mirror_gap", "b6a_bloc_yoy", "b9_group_share", "l5_version_observations", "q1_q2_coverage_gaps", "q11_source_status",
    "a3_to_observations_uk", "b5_shapes", "b8_allgoods_share", "b13_cross_check", "b12_partner_balance", "s4_release_pages", "s17_page_errors", "q9_publication", "r29_bilateral_section", "r28_deficit_by_scope",
    "s9_clustered_layout", "q3_duplicate_raw_rows", "q11_sources_rollup", "q20_run_histories", "q4_unexpected_codes", "a5_a6_allgoods", "l3_merge_findings", "p1_stream_monthly_totals",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda row: repr([x if isinstance(x, (float, int, bool, type(None))) else str(x) for x in row])
    assert sorted(text([r[c] for c in names]) for r in df.collect()) == sorted(map(text, cur.fetchall()))
