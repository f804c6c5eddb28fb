"""Whole experiments of the layered and the flat profile: two runs in one job, every metric of the profile as a series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshtally.operators.formats import register_formatter
from meshtally.plans import views as V
from meshtally.plans.catalog import query
from meshtally.plans.experiment import Metric, analyse, register_metric, register_profile
from meshtally.plans.queries_logs import _FLAT, PAIRS
from meshtally.plans.queries_sources import _flat_lines, _head, _tag
from meshtally.plans.queries_tables import _cdf_sql
from meshtally.session import scratch_dir
from meshtally.sources.patterns import register_pattern

START, SCALE = 1_704_067_200_000_000, 10_000  # the month of events becomes some minutes


def _plog(spark, sf):
    return V.plog(spark, sf).withColumn("time", F.expr(f"(time - {START}) div {SCALE}"))


def _on_this_clock(sql: str) -> str:
    return sql.replace("epoch_us(ts) // 1000 * 1000 AS time", f"(epoch_us(ts) // 1000 * 1000 - {START}) // {SCALE} AS time")


def _node_lines(p):
    """Topology, power, routing and association lines, beside the packets' own."""
    c, kind = F.col, F.col("event_type")
    cents = F.round(c("value") * 100).cast("bigint")
    p = p.withColumn("cents", cents)
    power = V.line("PW (r ", F.expr("cents div 100"), ".", F.lpad((c("cents") % 100).cast("string"), 2, "0"),
                   " / ", F.expr("k div 10"), ".-", c("k") % 10)
    own = F.when(kind == "click", F.concat(_head("RPL"), V.line("h:", c("hops"), ", n:", c("k") % 9))) \
        .when(kind == "signup", F.concat(_head("POW"), power)) \
        .when(kind == "error", F.concat(_head("ICMP"), V.line(" type:", c("k"), " code:", c("hops"))))
    joins = F.concat(
        _head("RPL"), _tag("n", F.when(c("k") % 3 > 0, c("k"))), _tag("c", F.when(kind == "purchase", 1)),
        _tag("dag", F.when(kind == "click", 1)), _tag("dao", F.when(kind.isin("view", "click"), 1)))
    return p.select("g", F.explode(F.array(own, joins)).alias("value")).where(F.col("value").isNotNull())


def _runs(spark, sf, packet_lines, profile, patterns, plots):
    p = _plog(spark, sf)
    lines = packet_lines(p).unionByName(_node_lines(p)).select(
        "value", F.concat(F.lit("run-"), F.col("g") % 2).alias("run"))
    _, result = analyse(lines, profile, patterns, plots, by=["run"], store=f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}")
    # grid points as text depend on how a language writes fractions
    return result.select("run", "metric", "kind", "pos", F.when(F.col("kind") != "hist", F.col("x")).alias("x"),
                         *[F.round(c, 6).alias(c) for c in ("x_num", "y", "err")])


_TYPES = "('FTQ', 'FTS', 'REQUEST', 'OPEN_PATH')"


def _series_sql(packets: str, nodes: str, more: str) -> str:
    """Series of ``packets``; ``nodes`` defines far(run, node, hops)."""
    return f"""
WITH {_on_this_clock(packets)},
p AS (SELECT *, 'run-' || (seq % 2) AS run FROM packets),
each AS (SELECT run, id, hops, sum(lat) AS lat FROM p WHERE received = 'correct' AND type IN {_TYPES} GROUP BY ALL),
lvh AS (SELECT run, hops, avg(lat) AS y FROM each WHERE hops IS NOT NULL GROUP BY ALL),
lat AS (SELECT run, avg(lat) FILTER (received = 'correct') AS y FROM p GROUP BY run),
pvh AS (SELECT run, hops, 100 * (1 - count(*) FILTER (received = 'missed') / count(*)::DOUBLE) AS y
  FROM p WHERE type IN {_TYPES} AND hops IS NOT NULL GROUP BY ALL),
pdr AS (SELECT run, 100 * (1 - count(*) FILTER (received = 'missed') / count(*)::DOUBLE) AS y FROM p GROUP BY run),
{nodes},
power AS (SELECT 'run-' || (g % 2) AS run, node, avg(round(value, 2)) AS rdc FROM plog WHERE event_type = 'signup' GROUP BY ALL),
evh AS (SELECT run, hops, avg(rdc) AS y FROM power JOIN far USING (run, node) WHERE hops BETWEEN 1 AND 5 GROUP BY ALL),
f AS (SELECT 'run-' || (g % 2) AS run, avg(time / 1e6) AS mu, stddev_pop(time / 1e6) AS sigma,
  CAST(ceil(max(time / 1e6) / 0.1::DOUBLE) AS BIGINT) AS points FROM plog WHERE event_type = 'purchase' GROUP BY 1),
g AS (SELECT *, unnest(range(points)) AS i FROM f),
z AS (SELECT run, i, i * 0.1::DOUBLE AS x, (i * 0.1::DOUBLE - mu) / sigma AS z, abs((i * 0.1::DOUBLE - mu) / sigma) AS a FROM g),
c AS (SELECT run, i, x, {_cdf_sql("z")} FROM z)),
curve AS (SELECT run, i, x, sum(p) OVER (PARTITION BY run ORDER BY i) / sum(p) OVER (PARTITION BY run) AS y FROM c AS t(run, i, x, p)),
bars AS (
  SELECT run, 'latency_v_hops' AS metric, 'line' AS kind, hops, y, CASE WHEN y > 0 THEN avg(y) OVER (PARTITION BY run) / sqrt(y) END AS err
  FROM lvh
  UNION ALL SELECT run, 'pdr_v_hops', 'bar', hops, y, NULL FROM pvh
  UNION ALL SELECT run, 'energy_v_hops', 'bar', hops, y, NULL FROM evh)
SELECT run, metric, kind, row_number() OVER (PARTITION BY run, metric ORDER BY hops) - 1 AS pos, CAST(hops AS VARCHAR) AS x,
  CAST(hops AS DOUBLE) AS x_num, round(y, 6) AS y, round(err, 6) AS err FROM bars
UNION ALL SELECT run, 'latency', 'line', 0, 'ALL', NULL, round(y, 6), round(CASE WHEN y > 0 THEN sqrt(y) END, 6) FROM lat
UNION ALL SELECT run, 'pdr', 'bar', 0, 'ALL', NULL, round(y, 6), NULL FROM pdr
UNION ALL SELECT run, 'association_v_time', 'hist', i, NULL, round(x, 6), round(y, 6), NULL FROM curve{more}"""


_MODE = """far AS (SELECT run, node, hops FROM (
  SELECT run, node, hops, row_number() OVER (PARTITION BY run, node ORDER BY count(*) DESC, hops) AS rn
  FROM ({}) GROUP BY run, node, hops) WHERE rn = 1)"""

COMMON = {
    "latency_v_hops": {"packets": PAIRS, "index": ["id"], "aggfunc": {"lat": "sum"}}, "latency": None,
    "pdr_v_hops": {"packets": PAIRS}, "pdr": None, "energy_v_hops": {"df": "pow"},
    "association_v_time": {"df": "join", "packets": ["controller"]}}


@query("experiment_layered", _series_sql(
    V.PACKETS, _MODE.format("SELECT 'run-' || (g % 2) AS run, node, hops FROM plog WHERE event_type = 'click'"), """
UNION ALL SELECT run, 'traffic_ratio', 'bar', 0, 'ratio', NULL, round(a.n / b.n::DOUBLE, 6), NULL
FROM (SELECT run, count(*) AS n FROM p GROUP BY run) a
JOIN (SELECT 'run-' || (g % 2) AS run, count(*) AS n FROM plog WHERE event_type = 'error' GROUP BY 1) b USING (run)"""))
def experiment_layered(spark, sf):
    return _runs(spark, sf, lambda p: p.select("g", V.sdn_line().alias("value")), "layered",
                 ["sdn", "node", "join", "pow", "icmp"], {**COMMON, "traffic_ratio": None})


@query("experiment_flat", _series_sql(_FLAT, _MODE.format("SELECT run, node, hops FROM p WHERE node <> 1"), ""))
def experiment_flat(spark, sf):
    """Hops of a node are those of the packets it sent."""
    return _runs(spark, sf, lambda p: _flat_lines(p, "g").select("g", "value"), "flat", ["all", "pow", "node", "join"], COMMON)


# --- own formats, tables and metrics -----------------------------------------

def _register_beacons() -> None:
    """A format, its table, a metric on it and a profile's name, as a user adds them."""
    register_pattern("beacon", r"\s*\[BEACON\]\s*(?P<state>UP|DOWN)(?:\s+b:(?P<battery>\d+\.\d+)|\s+n:(?P<degree>\d+))+.*?$",
                     {"battery": "double"}, needs="[BEACON]", begins=("UP", "DOWN"))
    register_formatter("beacon", lambda rows, by=(): rows.where("state = 'UP'").groupBy(*by, "node").agg(
        F.avg("battery").alias("battery"), F.max("degree").alias("degree")))
    register_profile("own", "layered")
    register_metric("battery_v_degree", Metric(
        lambda df, tables, by, profile: df.groupBy(*by, F.col("degree").alias("x")).agg(F.avg("battery").alias("y")),
        {"layered": ["beacon"]}, "bar", "Degree", "Battery (V)"))


@query("experiment_own", f"""
WITH {V.PLOG},
b AS (SELECT 'run-' || (g % 2) AS run, node, avg(value) AS battery, max(k % 9) AS degree FROM plog WHERE event_type IN ('view', 'click') GROUP BY ALL),
p AS (SELECT run, degree, avg(battery) AS y FROM b GROUP BY ALL)
SELECT run, 'battery' AS metric, 'bar' AS kind, row_number() OVER (PARTITION BY run ORDER BY degree) - 1 AS pos,
  CAST(degree AS VARCHAR) AS x, round(y, 6) AS y FROM p""")
def experiment_own(spark, sf):
    """A registered format through its own formatter and metric."""
    _register_beacons()
    p = V.plog(spark, sf)
    cents = F.round(F.col("value") * 100).cast("bigint")
    state = F.when(F.col("event_type").isin("view", "click"), "UP").otherwise("DOWN")
    lines = p.withColumn("cents", cents).select(
        V.line(F.col("time"), ": ", F.col("node"), ": [BEACON] ", state, " n:", F.col("k") % 9, " b:", F.expr("cents div 100"), ".",
               F.lpad((F.col("cents") % 100).cast("string"), 2, "0")).alias("value"),
        F.concat(F.lit("run-"), F.col("g") % 2).alias("run"))
    _, result = analyse(lines, "own", ["beacon"], {"battery_v_degree": {"file": "battery"}}, by=["run"])
    return result.select("run", "metric", "kind", "pos", "x", F.round("y", 6).alias("y"))
