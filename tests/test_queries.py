"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vhist import queries as history
from vhist.plans.materialize import spread
from vhist.sources.projection import History

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "commit_projection parent_edges ref_list closure_all_tips nth_first_parent log_path tree_diff_filtered ls_files cat_file_size duplicate_blobs "
    "path_filter_glob path_filter_exclude attr_filter abbrev_unique resolve_name_cascade branch_verbose grep_lines grep_invert grep_basic "
    "path_levels_glob path_levels_plain path_levels_folder path_levels_unclosed relative_paths show_ref_suffix rev_parse_names ref_widths blob_part "
    "rev_list_exact shortlog_by_count shortlog_wrapped "
    "rename_exact_pairs line_multiset_added blame_groups shortlog_mailmap coverage_progress stream_ingest"
).split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    got = history.QUERIES[name](spark, SF)
    want = duck.sql(history.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["root", "pos", "oid", "author", "subject"] and out.limit(1).count() == 1


def reads(df, name):
    return df._jdf.queryExecution().sparkPlan().toString().count(f"/{name}.parquet")


def test_snapshots_read_line_items_once(spark):
    for name in ("tree_diff_name_status", "tree_diff_filtered"):
        assert reads(history.QUERIES[name](spark, SF), "lineitem") == 1


def test_changes_read_line_items_twice(spark):
    assert reads(history.QUERIES["changed_paths_mask"](spark, SF), "lineitem") == 2


def test_spread_bounds_the_rows_of_a_task(spark):
    assert spread(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10
    assert spread(spark.range(10), "id", rows=100).rdd.getNumPartitions() == 4


def test_writes_of_some_commits_and_paths(spark):
    h = History(spark, SF)
    want = {tuple(r) for r in h.touches.where("path like 'Brand#2/%'").collect()}
    assert want and {tuple(r) for r in h.touches_where(F.col("path").like("Brand#2/%")).collect()} == want
    ids = h.orders.where("o_orderkey < 9").select(F.col("o_orderkey").alias("id"))
    assert {tuple(r) for r in h.touches_where(ids=ids).collect()} == {tuple(r) for r in h.touches.where("id < 9").collect()}
