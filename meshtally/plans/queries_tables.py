"""Queries on series, statistics, configured joins, the run catalogue and generic table operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshtally.functions.maths import (
    CDF_DENOMINATOR, CDF_FAR, CDF_NEAR, CDF_NUMERATOR, first_integer, params_text)
from meshtally.operators import runs, series, stats
from meshtally.operators import tableops as ops
from meshtally.operators.process import process
from meshtally.plans import views as V
from meshtally.plans.catalog import query
from meshtally.plans.experiment import analyse
from meshtally.plans.queries_logs import r6, sdn_packets
from meshtally.session import scratch_dir, settle
from meshtally.sources import tables


# --- series -----------------------------------------------------------------

def _bars(spark, sf, holes=False):
    """Mean value per run and hops; with holes a run lacks the hop counts its own number rules out."""
    p = V.plog(spark, sf).withColumn("run", V.run_name())
    p = p.where("hops <> length(event_type)") if holes else p
    return settle(p.groupBy("run", "hops").agg(F.avg("value").alias("y")))


def _bars_sql(holes: bool) -> str:
    return V.PLOG + f""",
bars AS (SELECT {V.RUN_CASE} AS run, hops, avg(value) AS y FROM plog {"WHERE hops <> length(event_type)" * holes} GROUP BY ALL),
bar_series AS (SELECT run, 'rdc' AS metric, 'bar' AS kind, row_number() OVER (PARTITION BY run ORDER BY hops) - 1 AS pos,
  CAST(hops AS VARCHAR) AS x, CAST(hops AS DOUBLE) AS x_num, y, NULL::DOUBLE AS err, 'Hops' AS xlabel, 'Value' AS ylabel FROM bars)"""


_BARS, _BARS_WITH_HOLES = _bars_sql(False), _bars_sql(True)


def _bar_series(spark, sf, holes=False):
    return series.to_series(_bars(spark, sf, holes), F.col("run"), "rdc", "bar", "hops", "y", "Hops", "Value")


def _lines(spark, sf):
    p = V.plog(spark, sf).withColumn("run", V.run_name())
    points = settle(p.groupBy("run", "k").agg(F.avg("value").alias("y")))
    return series.to_series(stats.error_bars(points, ["run"]), F.col("run"), "lat", "line", "k", "y", "k", "Value", "err")


_LINES = f""",
points AS (SELECT {V.RUN_CASE} AS run, k, avg(value) AS y FROM plog GROUP BY ALL),
line_series AS (SELECT run, 'lat' AS metric, 'line' AS kind, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS pos,
  CAST(k AS VARCHAR) AS x, CAST(k AS DOUBLE) AS x_num, y,
  CASE WHEN y > 0 THEN avg(y) OVER (PARTITION BY run) / sqrt(y) END AS err, 'k' AS xlabel, 'Value' AS ylabel FROM points)"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("y", "err") if c in df.columns})


@query("series_table", f"""
WITH {_BARS}{_LINES}
SELECT * REPLACE (round(y, 6) AS y, round(err, 6) AS err) FROM (SELECT * FROM bar_series UNION ALL SELECT * FROM line_series)""")
def series_table(spark, sf):
    return _rounded(_bar_series(spark, sf).unionByName(_lines(spark, sf)))


@query("series_lookup", f"""
WITH {_BARS} SELECT * REPLACE (round(y, 6) AS y) FROM bar_series WHERE run IN ('sim-30-a', 'control')""")
def series_lookup(spark, sf):
    """Stored series, read back for two runs."""
    path = f"{scratch_dir(spark)}/series-{uuid.uuid4().hex}"
    tables.save_series(_bar_series(spark, sf), path)
    return _rounded(series.lookup(tables.load_series(spark, path), ["sim-30-a", "control"], ["rdc"]))


@query("series_align", f"""
WITH {_BARS_WITH_HOLES},
r AS (SELECT unnest(['sim-30-a', 'sim-20-a', 'control']) AS run), xs AS (SELECT DISTINCT x, x_num FROM bar_series WHERE run IN (FROM r))
SELECT 'rdc' AS metric, xs.x, xs.x_num, r.run, round(coalesce(b.y, 0), 6) AS y
FROM xs CROSS JOIN r LEFT JOIN bar_series b ON b.x = xs.x AND b.run = r.run""")
def series_align(spark, sf):
    return _rounded(series.align(_bar_series(spark, sf, holes=True), ["sim-30-a", "sim-20-a", "control"]))


_CONCAT = """
ids AS (SELECT *, coalesce(nullif(regexp_extract(run, '([0-9]+)', 1), ''), run) AS id FROM line_series),
joined AS (SELECT metric, id, run, row_number() OVER (PARTITION BY metric, id ORDER BY run, pos) - 1 AS pos, x, x_num, y, err FROM ids)"""


@query("series_concat", f"""
WITH {V.PLOG}{_LINES},{_CONCAT} SELECT * REPLACE (round(y, 6) AS y, round(err, 6) AS err) FROM joined""")
def series_concat(spark, sf):
    return _rounded(series.concatenate(_lines(spark, sf)))


@query("compare_runs", f"""
WITH {_BARS_WITH_HOLES}{_LINES},{_CONCAT},
r AS (SELECT unnest(['sim-30-a', 'sim-30-b', 'control']) AS run),
xs AS (SELECT x, min(pos) AS pos FROM bar_series WHERE run IN (FROM r) GROUP BY x),
hist AS (SELECT 'share' AS metric, 'hist' AS kind, run, pos, x, y FROM bar_series WHERE run IN (FROM r)),
l AS (SELECT id, run, row_number() OVER (PARTITION BY id ORDER BY run, pos) - 1 AS pos, x, y, err FROM ids WHERE run IN (FROM r))
SELECT 'rdc' AS metric, 'bar' AS kind, coalesce(nullif(regexp_extract(r.run, '([0-9]+)', 1), ''), r.run) AS id, r.run AS label,
  CAST(xs.pos AS BIGINT) AS pos, xs.x, round(coalesce(b.y, 0), 6) AS y, NULL::DOUBLE AS err
FROM xs CROSS JOIN r LEFT JOIN bar_series b ON b.x = xs.x AND b.run = r.run
UNION ALL SELECT 'lat', 'line', id, run, pos, x, round(y, 6), round(err, 6) FROM l
UNION ALL SELECT metric, kind, coalesce(nullif(regexp_extract(run, '([0-9]+)', 1), ''), run), run, pos, x, round(y, 6), NULL FROM hist""")
def compare_runs(spark, sf):
    bars = _bar_series(spark, sf, holes=True)
    hist = bars.withColumns({"metric": F.lit("share"), "kind": F.lit("hist")})
    every = bars.unionByName(_lines(spark, sf)).unionByName(hist)
    # few points from many events: stored once, as results are, then compared
    return _rounded(series.compare(settle(every), ["sim-30-a", "sim-30-b", "control"], ["rdc", "lat", "share"]))


@query("run_order", """
SELECT o_orderkey, CAST(nullif(regexp_extract('sim ' || o_orderpriority, '([0-9]+)', 1), '') AS BIGINT) AS number,
  coalesce(nullif(regexp_extract(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END, '([0-9]+)', 1), ''),
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END) AS id FROM orders""")
def run_order(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("none")
    return o.select("o_orderkey", first_integer(F.concat(F.lit("sim "), "o_orderpriority")).alias("number"),
                    series.run_id(name).alias("id"))


@query("clip_labels", f"""
WITH {_BARS} SELECT run, x, round(y, 6) AS y, CAST(CASE WHEN ceil(y) > 48 THEN ceil(y) END AS BIGINT) AS label FROM bar_series""")
def clip_labels(spark, sf):
    return _rounded(series.clip_labels(_bar_series(spark, sf), 48).select("run", "x", "y", "label"))


@query("error_bars", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_shipdate AS VARCHAR)[1:10] AS day,
  round(avg(l_extendedprice) OVER (PARTITION BY l_suppkey, l_returnflag) / sqrt(l_extendedprice), 4) AS err FROM lineitem""")
def error_bars(spark, sf):
    li = V.table(spark, sf, "lineitem")
    e = stats.error_bars(li, ["l_suppkey", "l_returnflag"], "l_extendedprice")
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                    F.substr(F.col("l_shipdate").cast("string"), F.lit(1), F.lit(10)).alias("day"), F.round("err", 4).alias("err"))


@query("series_summary", f"""
WITH {_BARS},
whole AS (SELECT run, metric, round(y, 0) AS y FROM bar_series),
m AS (SELECT run, y, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, y) AS rn FROM whole GROUP BY run, y)
SELECT w.run, w.metric, round(avg(w.y), 6) AS mean, round(median(w.y), 6) AS median, max(m.y) AS mode
FROM whole w JOIN m ON m.run = w.run AND rn = 1 GROUP BY w.run, w.metric""")
def series_summary(spark, sf):
    s = series.summarise(_bar_series(spark, sf).withColumn("y", F.round("y", 0)))
    return s.select("run", "metric", r6("mean"), r6("median"), "mode")


# --- scalar metrics ---------------------------------------------------------

def _run_metrics(spark, sf):
    """Delivery and latency of four runs, one per injected drop rate."""
    packets = sdn_packets(spark, sf).withColumn("run", (F.col("seq") % 4 * 25).cast("string"))
    by = packets.groupBy("run").agg(
        (F.lit(100.0) * (1 - F.count_if(F.col("received") == "missed") / F.count(F.lit(1)))).alias("pdr"),
        F.avg("lat").alias("lat"))
    return by.unpivot(["run"], ["pdr", "lat"], "name", "value")


_RUN_METRICS = V.PACKETS + """,
wide AS (SELECT CAST(seq % 4 * 25 AS VARCHAR) AS run,
  100 * (1 - count(*) FILTER (received = 'missed') / count(*)::DOUBLE) AS pdr, avg(lat) AS lat FROM packets GROUP BY 1),
m AS (SELECT run, 'pdr' AS name, pdr AS value FROM wide UNION ALL SELECT run, 'lat', lat FROM wide)"""


@query("metric_table", f"WITH {_RUN_METRICS} SELECT run, name, round(value, 6) AS value FROM m")
def metric_table(spark, sf):
    """Saved in three steps, one of them a second time, read back as one table."""
    m = settle(_run_metrics(spark, sf))
    path = f"{scratch_dir(spark)}/metrics-{uuid.uuid4().hex}"
    tables.save_metrics(m.where("name = 'pdr'"), path)
    tables.save_metrics(m.where("name = 'lat'").withColumn("value", F.lit(-1.0)), path)
    for _ in range(2):
        tables.save_metrics(m.where("name = 'lat'"), path)
    return tables.load_metrics(spark, path).select("run", "name", r6("value"))


@query("metric_sweep", f"""
WITH {_RUN_METRICS} SELECT run, round(pdr, 6) AS pdr, round(lat, 6) AS lat FROM wide WHERE run IN ('0', '25', '50', '75')""")
def metric_sweep(spark, sf):
    s = series.sweep(_run_metrics(spark, sf), ["0", "25", "50", "75"], ["pdr", "lat"])
    return s.select("run", r6("pdr"), r6("lat"))


# --- statistics -------------------------------------------------------------

@query("mad_filter", """
WITH med AS (SELECT median(value) AS m FROM events), dev AS (SELECT median(abs(value - m)) AS mad FROM events, med)
SELECT event_id, user_id, value FROM events, med, dev WHERE mad = 0 OR abs(value - m) < 2 * mad""")
def mad_filter(spark, sf):
    return stats.reject_outliers(V.table(spark, sf, "events").select("event_id", "user_id", "value"), "value")


@query("mad_filter_groups", """
WITH med AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
dev AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN med USING (event_type) GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN med USING (event_type) JOIN dev USING (event_type)
WHERE mad = 0 OR abs(value - m) < 3 * mad""")
def mad_filter_groups(spark, sf):
    return stats.reject_outliers(V.table(spark, sf, "events").select("event_id", "event_type", "value"), "value", 3, ["event_type"])


@query("trim_ids", """
WITH u AS (SELECT DISTINCT user_id AS id FROM events),
lo AS (SELECT max(id) AS lo FROM (SELECT id FROM u ORDER BY id LIMIT 6)), hi AS (SELECT min(id) AS hi FROM (SELECT id FROM u ORDER BY id DESC LIMIT 5))
SELECT event_id, user_id FROM events, lo, hi WHERE user_id > lo AND user_id < hi""")
def trim_ids(spark, sf):
    return stats.trim_extremes(V.table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query("ecdf", """
SELECT DISTINCT event_type, value AS x, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS y FROM events""")
def ecdf(spark, sf):
    return stats.ecdf(V.table(spark, sf, "events"), "value", ["event_type"]).withColumn("y", F.round("y", 9))


@query("ecdf_total", "SELECT DISTINCT l_extendedprice AS x, round(cume_dist() OVER (ORDER BY l_extendedprice), 9) AS y FROM lineitem")
def ecdf_total(spark, sf):
    """One distribution over the whole table."""
    return stats.ecdf(V.table(spark, sf, "lineitem"), "l_extendedprice").withColumn("y", F.round("y", 9))


@query("cum_hist", """
WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT event_type, least(CAST(floor((value - lo) / (hi - lo) * 30) AS INTEGER), 29) AS bin, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY ALL),
g AS (SELECT event_type, lo, hi, CAST(unnest(range(30)) AS INTEGER) AS bin FROM s)
SELECT event_type, bin, round(lo + (hi - lo) * (bin + 1) / 30.0::DOUBLE, 6) AS edge, coalesce(n, 0) AS n,
  round(sum(coalesce(n, 0)) OVER (PARTITION BY event_type ORDER BY bin) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type)::DOUBLE, 6) AS y
FROM g LEFT JOIN c USING (event_type, bin)""")
def cum_hist(spark, sf):
    h = stats.cumulative_histogram(V.table(spark, sf, "events"), "value", 30, ["event_type"])
    return h.select("event_type", "bin", r6("edge"), "n", r6("y"))


@query("box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
  least(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), round(q1, 6)) AS whislo, greatest(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), round(q3, 6)) AS whishi
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, med, q3""")
def box_stats(spark, sf):
    b = stats.box_stats(V.table(spark, sf, "events"), "value", ["event_type"])
    return b.select("event_type", r6("q1"), r6("med"), r6("q3"), "whislo", "whishi")


@query("box_stats_ranges", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
  min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whislo,
  max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whishi
FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q1, med, q3""")
def box_stats_ranges(spark, sf):
    """Few large groups."""
    b = stats.box_stats(V.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return b.select("l_returnflag", r6("q1"), r6("med"), r6("q3"), "whislo", "whishi")


def _cdf_sql(z: str) -> str:
    """The same published formula in SQL, over a column holding |z|."""
    def horner(coefficients):
        text = repr(coefficients[0])
        for c in coefficients[1:]:
            text = f"({text} * a + {c!r}::DOUBLE)"
        return text.replace(repr(coefficients[0]), f"{coefficients[0]!r}::DOUBLE", 1)
    near = f"exp(-a * a / 2) * {horner(CDF_NUMERATOR)} / {horner(CDF_DENOMINATOR)}"
    far = "exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65::DOUBLE))))) / sqrt(2 * pi())"
    return f"""CASE WHEN {z} > 0 THEN 1 - u ELSE u END FROM (SELECT *,
      CASE WHEN a > {CDF_FAR} THEN 0 WHEN a < {CDF_NEAR} THEN {near} ELSE {far} END AS u"""


@query("fitted_cdf", f"""
WITH f AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sigma, CAST(ceil(max(value) / 0.1::DOUBLE) AS BIGINT) AS points FROM events GROUP BY 1),
g AS (SELECT *, unnest(range(points)) AS i FROM f),
z AS (SELECT event_type, i, i * 0.1::DOUBLE AS x, (i * 0.1::DOUBLE - mu) / sigma AS z, abs((i * 0.1::DOUBLE - mu) / sigma) AS a FROM g),
p AS (SELECT event_type, i, x, {_cdf_sql("z")} FROM z)),
s AS (SELECT event_type, i, x, sum(p) OVER (PARTITION BY event_type ORDER BY i) / sum(p) OVER (PARTITION BY event_type) AS y FROM p AS t(event_type, i, x, p))
SELECT event_type, i, round(x, 6) AS x, round(y, 9) AS y FROM s""")
def fitted_cdf(spark, sf):
    f = stats.fitted_cdf(V.table(spark, sf, "events"), "value", ["event_type"])
    return f.select("event_type", "i", r6("x"), F.round("y", 9).alias("y"))


@query("kde", """
WITH v AS (SELECT CAST(k % 7 AS INTEGER) AS grp, value FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, floor(value * 4) / 4 AS value FROM events)),
s AS (SELECT grp, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*), -0.2::DOUBLE) AS h FROM v WHERE grp BETWEEN 1 AND 4 GROUP BY 1),
g AS (SELECT *, CAST(unnest(range(100)) AS INTEGER) AS i FROM s),
x AS (SELECT *, lo + i * ((hi - lo) / 99) AS x FROM g)
SELECT grp, i, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (n * h * sqrt(2 * pi())), 9) AS y
FROM x JOIN v USING (grp) GROUP BY grp, i, x, n, h""")
def kde(spark, sf):
    p = V.plog(spark, sf).select(F.col("hops").alias("grp"), "value")
    d = stats.density(p, "value", "grp", [1, 2, 3, 4])
    return d.select("grp", "i", r6("x"), F.round("y", 9).alias("y"))


# --- configured joins, filters, rows ----------------------------------------

@query("cfg_merge", """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_nationkey, c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey BETWEEN 3 AND 11 AND o_totalprice BETWEEN 1000 AND 300000""")
def cfg_merge(spark, sf):
    t = {"orders": V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
         "customer": V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")}
    steps = {
        "orders": [
            {"merge": {"df": "customer", "left_on": "o_custkey", "right_on": "c_custkey"},
             "filter": {"col": "c_nationkey", "min": 3, "max": 11}},
            {"filter": {"col": "o_totalprice", "min": 1000, "max": 300000}}],
        "absent": [{"filter": {"col": "x", "min": 0, "max": 1}}]}
    return process(t, steps)["orders"]


@query("cfg_merge_outer", """
WITH a AS (SELECT c_custkey % 60 AS node, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT s_suppkey % 90 + 30 AS node, avg(s_acctbal) AS bal, count(*) AS m FROM supplier GROUP BY 1)
SELECT coalesce(a.node, b.node) AS node, round(a.bal, 6) AS bal_x, n, round(b.bal, 6) AS bal_y, m FROM a FULL JOIN b ON a.node = b.node""")
def cfg_merge_outer(spark, sf):
    a = V.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 60).alias("node")).agg(
        F.avg("c_acctbal").alias("bal"), F.count(F.lit(1)).alias("n"))
    b = V.table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 90 + 30).alias("node")).agg(
        F.avg("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("m"))
    step = {"merge": {"df": "b", "how": "outer", "left_on": "node", "right_on": "node"}}
    return process({"a": a, "b": b}, {"a": [step]})["a"].select("node", r6("bal_x"), "n", r6("bal_y"), "m")


_MERGED = """
WITH a AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 60 END AS node, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 90 + 30 END AS node, avg(s_acctbal) AS bal, count(*) AS m FROM supplier GROUP BY 1)
SELECT {node} AS node, round(a.bal, 6) AS bal_x, n, round(b.bal, 6) AS bal_y, m FROM a {join}"""


def _merged(spark, sf, **how):
    a = V.table(spark, sf, "customer").groupBy(F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey") % 60).alias("node")).agg(
        F.avg("c_acctbal").alias("bal"), F.count(F.lit(1)).alias("n"))
    b = V.table(spark, sf, "supplier").groupBy(F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") % 90 + 30).alias("node")).agg(
        F.avg("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("m"))
    step = {"merge": {"df": "b", "left_on": "node", "right_on": "node", **how}}
    return process({"a": a, "b": b}, {"a": [step]})["a"].select("node", r6("bal_x"), "n", r6("bal_y"), "m")


@query("cfg_merge_left", _MERGED.format(node="a.node", join="LEFT JOIN b ON a.node = b.node"))
def cfg_merge_left(spark, sf):
    return _merged(spark, sf, how="left")


@query("cfg_merge_right", _MERGED.format(node="b.node", join="RIGHT JOIN b ON a.node = b.node"))
def cfg_merge_right(spark, sf):
    return _merged(spark, sf, how="right")


@query("cfg_merge_null_safe", _MERGED.format(node="a.node", join="JOIN b ON a.node IS NOT DISTINCT FROM b.node"))
def cfg_merge_null_safe(spark, sf):
    return _merged(spark, sf, null_safe=True)


@query("range_isin_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (2, 5)
  AND (l_discount > 0.05 OR l_tax < 0.02) AND l_linestatus = 'F'""")
def range_isin_filter(spark, sf):
    li = V.table(spark, sf, "lineitem")
    rows = process({"l": li}, {"l": [{"filter": {"col": "l_quantity", "min": 10, "max": 30}}]})["l"]
    rows = ops.in_list(ops.in_list(rows, "l_returnflag", ["A", "R"]), "l_linenumber", [2, 5], keep=False)
    rows = rows.where((F.col("l_discount") > 0.05) | (F.col("l_tax") < 0.02))
    return ops.where_keys(rows, {"l_linestatus": "F"}).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("row_search", """
SELECT * FROM part WHERE p_type = 'ECONOMY' AND (p_size = 11 OR p_partkey = 11 OR p_retailprice = 11)""")
def row_search(spark, sf):
    return ops.search_rows(V.table(spark, sf, "part"), ["ECONOMY", "11"])


@query("dup_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def dup_rows(spark, sf):
    d = ops.duplicates(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("distinct_vals", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_vals(spark, sf):
    return ops.unique(V.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("union_by_name", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, NULL FROM part""")
def union_by_name(spark, sf):
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = V.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    p = V.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return ops.union_by_name(c, s, p)


@query("top_n", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 5""")
def top_n(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ops.first_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 5)


@query("multi_sort", """
SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderpriority, o_totalprice DESC, o_orderkey""")
def multi_sort(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey").orderBy(
        F.asc("o_orderstatus"), F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey")


@query("null_rows", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS v, CASE WHEN event_id % 5 > 0 THEN event_type END AS kind, user_id,
  event_id % 7 = 0 AS odd FROM events),
f AS (SELECT *, coalesce(v, -1) AS filled, coalesce(v, CAST(user_id AS DOUBLE)) AS other,
  CASE WHEN NOT odd THEN coalesce(v, -1) END AS no_nan, v IS NULL AS was_null FROM e)
SELECT 'all' AS rows, event_id, filled, coalesce(kind, 'none') AS kind, other, no_nan, was_null FROM f
UNION ALL SELECT 'complete', event_id, filled, kind, other, no_nan, was_null FROM f WHERE v IS NOT NULL AND kind IS NOT NULL
UNION ALL SELECT 'valued', event_id, filled, coalesce(kind, 'none'), other, no_nan, was_null FROM f WHERE v IS NOT NULL""")
def null_rows(spark, sf):
    """All rows, those without any NULL, those with a value; filled afterwards."""
    e = V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("kind"), "user_id")
    kept = e.withColumn("rows", F.lit("all")).unionByName(e.dropna("any").withColumn("rows", F.lit("complete"))).unionByName(
        e.dropna(subset=["v"]).withColumn("rows", F.lit("valued")))
    filled = kept.withColumns({"other": F.coalesce("v", F.col("user_id").cast("double")), "was_null": F.col("v").isNull()}) \
        .fillna({"v": -1.0, "kind": "none"}).withColumnRenamed("v", "filled")
    nan = filled.withColumn("no_nan", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("filled")))
    return ops.nan_to_null(nan).select("rows", "event_id", "filled", "kind", "other", "no_nan", "was_null")


@query("pivot_hops", f"""
WITH {V.PLOG}, o AS (SELECT hops, value, row_number() OVER (PARTITION BY hops ORDER BY event_id) - 1 AS occurrence FROM plog)
SELECT occurrence, {", ".join(f"max(value) FILTER (hops = {h}) AS h{h}" for h in range(7))} FROM o GROUP BY occurrence""")
def pivot_hops(spark, sf):
    wide = ops.occurrence_matrix(V.plog(spark, sf), "hops", list(range(7)), "value", "event_id", "event_id")
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(7)})


@query("pivot_ranges", f"""
WITH o AS (SELECT l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) - 1 AS occurrence FROM lineitem)
SELECT occurrence, {", ".join(f"max(l_extendedprice) FILTER (l_linenumber = {n}) AS n{n}" for n in range(1, 8))} FROM o GROUP BY occurrence""")
def pivot_ranges(spark, sf):
    """The same for few large groups; equal prices are ordered by their order."""
    wide = ops.occurrence_matrix(
        V.table(spark, sf, "lineitem"), "l_linenumber", list(range(1, 8)), "l_extendedprice", "l_extendedprice", "l_orderkey")
    return wide.withColumnsRenamed({str(n): f"n{n}" for n in range(1, 8)})


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("table_pivot", f"""
SELECT c_nationkey, {", ".join(f"round(avg(c_acctbal) FILTER (c_mktsegment = '{s}'), 6) AS seg_{s}" for s in SEGMENTS)}
FROM customer GROUP BY c_nationkey""")
def table_pivot(spark, sf):
    wide = ops.pivot_mean(V.table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", SEGMENTS, "seg_")
    return wide.select("c_nationkey", *[r6(f"seg_{s}") for s in SEGMENTS])


# --- run catalogue ----------------------------------------------------------

@query("run_catalog", """
SELECT c_custkey, 'NAME=' || replace(c_name, ' ', '') || ' SEGMENT=' || c_mktsegment || ' BAL=' || CAST(CAST(c_acctbal * 100 AS BIGINT) AS VARCHAR)
  || coalesce(' NUM_APPS=' || n_regionkey || ' FLOWID=' || n_nationkey || ' DELAY=[60,75]', '') AS makeargs
FROM customer LEFT JOIN nation ON n_nationkey + 5 = c_nationkey""")
def run_catalog(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("flow_id"), F.create_map(
        F.lit("NAME"), "c_name", F.lit("SEGMENT"), "c_mktsegment", F.lit("BAL"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")).alias("params"))
    n = V.table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 5).alias("flow_id"), F.col("n_regionkey").alias("num_apps"), F.create_map(
            F.lit("FLOWID"), F.col("n_nationkey").cast("string"), F.lit("DELAY"), F.lit("[60, 75]")).alias("flows"))
    return runs.catalogue(c, n).select("c_custkey", "makeargs")


@query("param_grid", """
SELECT p_partkey, r AS rate, f AS freq, 'RATE=' || r || ' FREQ=' || f AS text
FROM (SELECT p_partkey, f, unnest([p_size, p_size + 10]) AS r FROM (SELECT p_partkey, p_size, unnest([60, 75, 90]) AS f FROM part))""")
def param_grid(spark, sf):
    p = V.table(spark, sf, "part").select(
        "p_partkey", F.array("p_size", F.col("p_size") + 10).alias("RATE"), F.array(F.lit(60), F.lit(75), F.lit(90)).alias("FREQ"))
    return runs.grid(p, ["RATE", "FREQ"]).select(
        "p_partkey", F.col("RATE").alias("rate"), F.col("FREQ").alias("freq"), params_text("params").alias("text"))


@query("param_maps", """
SELECT p_partkey, kind, a, b FROM (
  SELECT p_partkey, 'pairs' AS kind, a, b FROM (SELECT p_partkey, b, unnest([1, 2]) AS a FROM (SELECT p_partkey, unnest([p_size, -1]) AS b FROM part))
  UNION ALL SELECT p_partkey, 'zip', 1, p_size FROM part UNION ALL SELECT p_partkey, 'zip', 2, -1 FROM part)""")
def param_maps(spark, sf):
    p = V.table(spark, sf, "part").select(
        "p_partkey",
        F.array(*[F.create_map(F.lit("A"), F.lit(i), F.lit("B"), F.lit(0)) for i in (1, 2)]).alias("l"),
        F.array(F.create_map(F.lit("B"), "p_size"), F.create_map(F.lit("B"), F.lit(-1))).alias("r"))
    both = runs.grid_of_maps(p, "l", "r").withColumn("kind", F.lit("pairs")).unionByName(
        runs.zip_maps(p, "l", "r").withColumn("kind", F.lit("zip")))
    return both.select("p_partkey", "kind", F.col("params")["A"].alias("a"), F.col("params")["B"].alias("b"))


@query("param_key_values", "SELECT p_partkey, 'SIZE' AS key, unnest([p_size, p_size * 2]) AS value FROM part")
def param_key_values(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.create_map(
        F.lit("SIZE"), F.array("p_size", F.col("p_size") * 2), F.lit("KEY"), F.array("p_size")).alias("lists"))
    return runs.key_values(p, "lists", "SIZE").select("p_partkey", "key", "value")


@query("map_explode", """
SELECT c_custkey, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer""")
def map_explode(spark, sf):
    c = V.table(spark, sf, "customer").select(
        "c_custkey", F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("m"))
    return ops.from_map(c, "m")


@query("xml_count", "SELECT o_orderkey, CAST(o_orderkey % 4 + o_custkey % 3 AS INTEGER) AS n FROM orders")
def xml_count(spark, sf):
    """A scenario document per order, its number of nodes given by the order's keys."""
    motes = F.repeat(F.lit("<mote><id>1</id></mote>"), (F.col("o_orderkey") % 4 + F.col("o_custkey") % 3).cast("int"))
    docs = V.table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.lit("<simconf><simulation><title>t</title>"), motes, F.lit("</simulation><mote/></simconf>")).alias("xml"))
    return tables.element_count(docs).select("o_orderkey", "n")


# --- generic operations -----------------------------------------------------

@query("table_ops_numeric", """
SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS bad, CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS good, CAST(p_retailprice AS VARCHAR)[1:2] AS head,
  CAST(p_size AS BIGINT) AS wide FROM part""")
def table_ops_numeric(spark, sf):
    p = V.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("bad"), F.col("p_size").cast("string").alias("good"),
        F.substr(F.col("p_retailprice").cast("string"), F.lit(1), F.lit(2)).alias("head"), F.col("p_size").alias("wide"))
    p = ops.to_number(ops.to_number(p, "bad", coerce=True), "good")
    return p.withColumn("wide", F.col("wide").cast("bigint"))


@query("table_ops_columns", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def table_ops_columns(spark, sf):
    c = V.table(spark, sf, "customer").drop("c_acctbal")
    c = c.withColumnsRenamed({"c_custkey": "T.KEY", "c_name": "T.NAME", "c_mktsegment": "SEGMENT", "c_nationkey": "Nation"})
    return ops.lower_names(ops.last_name_part(c))


@query("table_ops_text", """
SELECT p_partkey, p_name[1:2] AS head, lower(p_brand) AS brand, length(p_name) AS n, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END AS kind,
  regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits, p_name || '/' || p_size AS both, split_part(p_name, ' ', 1) AS first,
  CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) END AS rest FROM part""")
def table_ops_text(spark, sf):
    p = V.table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size",
        F.when(F.col("p_size") % 2 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("kind"),
        F.col("p_brand").alias("digits"))
    p = ops.replace_everywhere(ops.tidy_text(p), "[^0-9]+", columns=["digits"])
    p = ops.split_in_two(ops.add_columns(p, "p_name", "p_size", "both", "/"), "p_name", " ", "first", "rest")
    return p.select("p_partkey", F.substring("p_name", 1, 2).alias("head"), F.lower("p_brand").alias("brand"),
                    F.length("p_name").alias("n"), "kind", "digits", "both", "first", "rest")


@query("table_ops_count", "SELECT count(*) AS n FROM lineitem")
def table_ops_count(spark, sf):
    return V.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("table_ops_cond", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_mktsegment = 'BUILDING' THEN 'hit' ELSE c_mktsegment END AS segment,
  round(coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, 0) + c_nationkey, 6) AS total FROM customer""")
def table_ops_cond(spark, sf):
    c = V.table(spark, sf, "customer").withColumn("bal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")))
    c = ops.set_where(c, (F.col("c_nationkey") == 3) & (F.col("c_mktsegment") == "BUILDING"), "c_mktsegment", "hit")
    c = ops.null_safe_sum(c, "bal", "c_nationkey", "total")
    return c.select("c_custkey", F.col("c_mktsegment").alias("segment"), r6("total"))


# --- whole experiment -------------------------------------------------------

@query("experiment_series", f"""
WITH {V.OPS},
r AS (SELECT *, 'run-' || (epoch % 3) AS run FROM op_fmt WHERE active = 1 AND hops BETWEEN 1 AND 5),
pdr AS (SELECT run, hops, 100 * (1 - count(*) FILTER (drpd) / count(*)::DOUBLE) AS y FROM r WHERE type IN ('CONF', 'CLCT', 'RACT') GROUP BY ALL),
lat AS (SELECT run, hops, avg(lat) AS y FROM r WHERE received = 'correct' AND type IN ('CONF', 'CLCT', 'RACT') GROUP BY ALL),
o AS (SELECT run, CAST(CASE type WHEN 'CONF' THEN 0 WHEN 'CLCT' THEN 1 ELSE 2 END AS BIGINT) AS pos,
  CASE type WHEN 'CONF' THEN 'CONFIGURE' WHEN 'CLCT' THEN 'COLLECT' ELSE 'REACT' END AS op, avg(op_duration) AS y
  FROM r WHERE type <> 'ASSC' GROUP BY ALL)
SELECT run, 'pdr_v_hops' AS metric, 'bar' AS kind, row_number() OVER (PARTITION BY run ORDER BY hops) - 1 AS pos,
  CAST(hops AS VARCHAR) AS x, CAST(hops AS DOUBLE) AS x_num, round(y, 6) AS y, NULL::DOUBLE AS err FROM pdr
UNION ALL SELECT run, 'lat', 'line', row_number() OVER (PARTITION BY run ORDER BY hops) - 1, CAST(hops AS VARCHAR),
  CAST(hops AS DOUBLE), round(y, 6), round(CASE WHEN y > 0 THEN avg(y) OVER (PARTITION BY run) / sqrt(y) END, 6) FROM lat
UNION ALL SELECT run, 'atomic_op_times', 'bar', pos, op, NULL, round(y, 6), NULL FROM o""")
def experiment_series(spark, sf):
    """Lines of three runs in one job: tables, steps, metrics, series."""
    lines = V.op_lines(spark, sf).withColumn("run", F.concat(F.lit("run-"), F.expr("(event_id div 8) % 3")))
    types = ["CONF", "CLCT", "RACT"]
    _, result = analyse(
        lines.drop("event_id"), "atomic", ["atomic-op", "atomic-energy"],
        {"pdr_v_hops": {"df": "atomic-op", "packets": types},
         "latency_v_hops": {"df": "atomic-op", "packets": types, "file": "lat"},
         "atomic_op_times": {"packets": types}},
        {"atomic-op": [{"filter": {"col": "active", "min": 1, "max": 1}}, {"filter": {"col": "hops", "min": 1, "max": 5}}]},
        by=["run"], store=f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}")
    return _rounded(result).drop("xlabel", "ylabel")
