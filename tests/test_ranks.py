import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtally.operators import ranks


def skewed(spark):
    """Group b has most rows; a third of its values are one value; there are NULLs, NaN and a NULL group."""
    r = np.random.default_rng(5)
    values = np.round(np.exp(r.normal(3, 2, 6000)), 2)
    values[:2000] = 7.25
    rows = [("b", float(v), i) for i, v in enumerate(values)]
    rows += [("a", float(i), 10_000 + i) for i in range(4)] + [(None, 5.0, 20_000), (None, 6.0, 20_001)]
    rows += [("a", None, 30_000), ("b", float("nan"), 30_001)]
    return spark.createDataFrame(rows, "g string, v double, n int")


PROBS = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "p33": 0.33, "med": 0.5, "p999": 0.999, "p1": 1.0}


@pytest.mark.parametrize("parts", [1, 40])
def test_percentiles_are_exact(spark, shuffles, parts):
    shuffles(parts)
    got = {r["g"]: r for r in ranks.percentiles(skewed(spark), "v", PROBS, ["g"]).collect()}
    pdf = skewed(spark).toPandas().dropna(subset=["v"])
    for g in ("a", "b", None):
        x = pdf[pdf.g.isna() if g is None else pdf.g == g].v.to_numpy()
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), rel=1e-12), (g, name)


@pytest.mark.parametrize("parts", [1, 40])
def test_percentiles_without_groups(spark, shuffles, parts):
    shuffles(parts)
    row = ranks.percentiles(skewed(spark), "v", {"med": 0.5}).first()
    assert row["med"] == skewed(spark).toPandas().v.median()


@pytest.mark.parametrize("parts", [1, 40])
def test_value_shares(spark, shuffles, parts):
    shuffles(parts)
    got = ranks.value_shares(skewed(spark), "v", ["g"]).toPandas()
    pdf = skewed(spark).toPandas().dropna(subset=["v"])
    b = pdf[pdf.g == "b"].v
    mine = got[got.g == "b"].sort_values("v")
    assert mine.n.tolist() == b.value_counts().sort_index().tolist()
    assert mine.upto.tolist() == b.value_counts().sort_index().cumsum().tolist()
    assert set(mine.total) == {len(b)}
    assert got.n.sum() == len(pdf)


@pytest.mark.parametrize("parts", [1, 40])
def test_numbers_follow_the_order(spark, shuffles, parts):
    shuffles(parts)
    df = skewed(spark).where("v is not null and not isnan(v)")
    pdf = ranks.numbered(df, ["g"], "v", "n").toPandas()
    for _, part in pdf.groupby("g", dropna=False):
        part = part.sort_values("pos")
        assert part.pos.tolist() == list(range(len(part)))
        assert part.v.is_monotonic_increasing


def test_numbers_are_the_same_for_any_cut(spark, rows, shuffles):
    df = skewed(spark).where("v is not null and not isnan(v)")
    shuffles(1)
    one = rows(ranks.numbered(df, ["g"], "v", "n"), "n", "pos")
    shuffles(40)
    assert rows(ranks.numbered(df, ["g"], "v", "n"), "n", "pos") == one


@pytest.mark.parametrize("order", [
    "lpad(cast(x as string), 4, '0')", "date_add(date'2020-01-01', cast(x as int))",
    "cast(timestamp_ntz'2020-01-01 00:00:00' as timestamp_ntz) + make_dt_interval(0, 0, 0, x)",
    "1700000000000000000 + x", "cast(x as decimal(20, 3))"])
def test_any_type_is_numbered(spark, shuffles, order):
    shuffles(16)
    df = spark.range(900).selectExpr("(id * 7919) % 900 as x").selectExpr("x", f"{order} as o")
    got = ranks.numbered(df, [], "o", "x").collect()
    assert {r["x"]: r["pos"] for r in got} == {i: i for i in range(900)}


def test_one_repeated_value_is_one_order(spark, shuffles):
    shuffles(16)
    got = ranks.numbered(spark.range(3000).selectExpr("id", "1.5 as v"), [], "v", "id").collect()
    assert all(r["pos"] == r["id"] for r in got)


def test_a_large_group_is_cut(spark, shuffles, tmp_path):
    shuffles(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.running_sum(spark.range(20_000), [], "id", F.lit(1), None, "s")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "_part" in plan
        laid = spark.read.parquet(re.search(r"(/\S*meshtally-[0-9a-f]{32})", str(got.inputFiles()))[1])
        assert laid.groupBy("_part").count().agg(F.max("count")).first()[0] < 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sum_of_weights(spark, shuffles):
    df = spark.range(1000).withColumns({"g": F.lit(1), "w": (F.col("id") % 7).cast("double")})
    for parts in (1, 30):
        shuffles(parts)
        got = ranks.running_sum(df, ["g"], "id", F.col("w"), None, "s", "t").orderBy("id").toPandas()
        assert np.allclose(got.s, np.cumsum(np.arange(1000) % 7))
        assert set(got.t) == {float((np.arange(1000) % 7).sum())}


def test_modes(spark, rows):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "x"), ("a", 3, None), ("a", 1, None), ("b", None, None), ("a", 2, "y")],
                               "k string, n int, s string")
    assert rows(ranks.modes(df, ["k"], ["n", "s"])) == [("a", 1, "x"), ("b", None, None)]


def test_last_value(spark, rows):
    df = spark.createDataFrame([(1, 5.0, 1, 1), (1, 6.0, 2, 1), (1, None, 3, 1), (1, 7.0, 2, 2)], "k int, v double, t int, line int")
    assert rows(ranks.last_value(df, ["k"], "v", ["t", "line"])) == [(1, 7.0)]


def test_join_on_null_keys(spark, rows):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 10), (2, 20)], "k int, b int")
    assert rows(ranks.join_on(a, b, ["k"])) == [(2, 2, 20), (None, 1, 10)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.percentiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
    assert ranks.value_shares(df, "v", ["g"]).count() == 0
    assert pd.isna(ranks.percentiles(df, "v", {"m": 0.5}).first()["m"])
