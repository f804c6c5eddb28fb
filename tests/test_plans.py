"""What the plans must look like for large inputs."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshtally.operators import formats, metrics, ranks, stats, tableops
from meshtally.operators.process import merge
from meshtally.plans import views as V
from meshtally.plans.registered import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packets_take_two_exchanges(spark):
    text = plan(formats.format_sdn(V.sdn_rows(spark, SF)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "partial_count" in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(metrics.energy_by_hops(V.plog(spark, SF).select("time", "node", "hops", F.col("value").alias("all_rdc"))))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"ts", "user_id", "value", "props"}


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["range_isin_filter"](spark, SF))
    for part in ("GreaterThanOrEqual(l_quantity,10", "In(l_returnflag", "EqualTo(l_linestatus,F)"):
        assert part in text


def test_hop_filter_stays_above_the_packets(spark):
    text = plan(formats.format_sdn(V.sdn_rows(spark, SF)).where("hops between 1 and 5"))
    assert text.index("Filter") < text.index("Exchange")


def test_first_n_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["top_n"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_duplicates_use_no_window(spark):
    text = plan(tableops.duplicates(V.table(spark, SF, "lineitem"), ["l_orderkey", "l_linenumber"]))
    assert "Window" not in text and "LeftSemi" in text


def test_modes_combine_before_the_shuffle(spark):
    text = plan(ranks.modes(V.table(spark, SF, "lineitem"), ["l_suppkey"], ["l_returnflag"]))
    assert "partial_count" in text and "ObjectHashAggregate" not in text


def test_large_groups_are_not_sorted_whole(spark):
    """Whatever the size, the window over the rows is partitioned by range too."""
    df = V.table(spark, SF, "lineitem")
    text = plan(stats.ecdf(df, "l_extendedprice", ["l_returnflag"]))
    inner = [w for w in re.findall(r"Window \[sum\(_weight[^\n]*", text)]
    assert inner and all("_part" in w for w in inner)
    text = plan(ranks.percentiles(df, "l_extendedprice", {"m": 0.5}, ["l_returnflag"]))
    assert "percentile(" not in text


def test_merge_leaves_the_join_to_the_planner(spark):
    a, b = V.table(spark, SF, "orders"), V.table(spark, SF, "customer")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(merge(a, b, "o_custkey", "c_custkey"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
