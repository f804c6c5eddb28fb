import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshtally.functions.maths import delivery_ratio, first_integer, normal_cdf, params_text, receive_ratio
from meshtally.operators import stats


def values(spark, xs, group="g"):
    return spark.createDataFrame([(group, float(x)) for x in xs], "g string, v double")


SAMPLE = np.round(np.random.default_rng(2).gamma(2.0, 8.0, 700), 2)


def test_normal_cdf(spark):
    zs = [-40.0, -37.5, -12.0, -7.2, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 7.05, 7.08, 9.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf(F.col("z"))).collect()]
    want = [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_mad(spark, rows):
    assert rows(stats.reject_outliers(values(spark, [1, 2, 3, 100]), "v", 2, ()), "v") == [(1.0,), (2.0,), (3.0,)]
    assert stats.reject_outliers(values(spark, [4, 4, 4, 9]), "v").count() == 4
    med = np.median(SAMPLE)
    dev = np.abs(SAMPLE - med)
    kept = SAMPLE[dev / np.median(dev) < 2]
    got = stats.reject_outliers(values(spark, SAMPLE), "v", 2, ["g"]).toPandas()
    assert sorted(got.v) == sorted(kept.tolist())


def test_trim(spark, rows):
    df = spark.createDataFrame([(i,) for i in list(range(20)) * 2], "id int")
    want = sorted([(i,) for i in range(6, 15)] * 2, key=repr)
    assert rows(stats.trim_extremes(df, "id")) == want
    assert stats.trim_extremes(df.where("id < 5"), "id").count() == 0


@pytest.mark.parametrize("parts", [1, 30])
def test_ecdf(spark, shuffles, parts):
    shuffles(parts)
    got = stats.ecdf(values(spark, SAMPLE), "v", ["g"]).orderBy("x").toPandas()
    xs = np.unique(SAMPLE)
    assert got.x.tolist() == xs.tolist()
    assert got.y.tolist() == pytest.approx([(SAMPLE <= x).mean() for x in xs])


def test_cumulative_histogram(spark):
    got = stats.cumulative_histogram(values(spark, SAMPLE), "v", 17, ["g"]).orderBy("bin").toPandas()
    counts, edges = np.histogram(SAMPLE, 17)
    assert got.n.tolist() == counts.tolist()
    assert got.edge.tolist() == pytest.approx(edges[1:].tolist())
    assert got.y.tolist() == pytest.approx((counts.cumsum() / counts.sum()).tolist())
    one = stats.cumulative_histogram(values(spark, [5, 5]), "v", 4).orderBy("bin").toPandas()
    assert one.n.tolist() == np.histogram([5, 5], 4)[0].tolist()


@pytest.mark.parametrize("parts", [1, 30])
def test_fitted_cdf(spark, shuffles, parts):
    shuffles(parts)
    got = stats.fitted_cdf(values(spark, SAMPLE), "v", ["g"], 0.1).orderBy("i").toPandas()
    grid = np.arange(0, SAMPLE.max(), 0.1)
    curve = np.array([0.5 * math.erfc(-(x - SAMPLE.mean()) / SAMPLE.std() / math.sqrt(2)) for x in grid]).cumsum()
    assert got.x.tolist() == pytest.approx(grid.tolist())
    assert got.y.tolist() == pytest.approx((curve / curve[-1]).tolist())


def test_fitted_cdf_of_one_value(spark):
    got = stats.fitted_cdf(values(spark, [1, 1]), "v", ["g"], 0.5).toPandas()
    assert len(got) == 2 and got.y.isna().all()


def test_box(spark, shuffles):
    xs = np.append(SAMPLE, [500.0, 900.0])
    df = values(spark, xs).unionByName(values(spark, [float("nan")]))
    for parts in (1, 30):
        shuffles(parts)
        b = stats.box_stats(df, "v", ["g"]).first()
        q1, med, q3 = np.percentile(xs, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        assert (b["q1"], b["med"], b["q3"]) == pytest.approx((q1, med, q3))
        assert (b["whislo"], b["whishi"]) == (xs[xs >= q1 - reach].min(), xs[xs <= q3 + reach].max())


def test_density(spark):
    xs = SAMPLE[:200]
    df = values(spark, xs).withColumn("g", F.lit(1)).unionByName(values(spark, [1, 2, 9], "x").withColumn("g", F.lit(9)))
    got = stats.density(df, "v", "g", [1]).orderBy("i").toPandas()
    h = xs.std(ddof=1) * len(xs) ** -0.2
    grid = np.linspace(xs.min(), xs.max(), 100)
    want = np.exp(-0.5 * ((grid[:, None] - xs) / h) ** 2).sum(1) / (len(xs) * h * math.sqrt(2 * math.pi))
    assert got.x.tolist() == pytest.approx(grid.tolist())
    assert got.y.tolist() == pytest.approx(want.tolist())


def test_density_far_from_every_value(spark):
    df = spark.createDataFrame([(1, 0.0)] * 5000 + [(1, 1.0)] + [(1, 0.001)] * 10, "g int, v double")
    got = stats.density(df, "v", "g", [1], 50).orderBy("i").toPandas()
    assert len(got) == 50 and got.y.iloc[25] == 0.0 and got.y.iloc[-1] > 0


def test_error_bars(spark, rows):
    df = spark.createDataFrame([("a", 4.0), ("a", 0.0), ("a", 16.0), ("b", 9.0), ("a", -1.0)], "g string, y double")
    got = dict(rows(stats.error_bars(df, ["g"]).where("g = 'a'"), "y", "err"))
    assert got[4.0] == pytest.approx(4.75 / 2) and got[16.0] == pytest.approx(4.75 / 4)
    assert got[0.0] is None and got[-1.0] is None


def test_ratios_and_text(spark):
    df = spark.createDataFrame([(10, 2, "run 30-b7"), (0, 0, "none")], "a int, b int, t string")
    got = df.select(delivery_ratio(F.col("a"), F.col("b")), receive_ratio(F.col("a"), F.col("b")), first_integer("t"),
                    params_text(F.create_map(F.lit("K"), F.lit("[1, 2]"), F.lit("L"), F.lit("x")))).collect()
    assert tuple(got[0]) == (80.0, 20.0, 30, "K=[1,2] L=x")
    assert tuple(got[1])[:3] == (None, None, None)
