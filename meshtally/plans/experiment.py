"""From a run description to its tables and result series.

A description names a profile, the log tables it needs and the metrics with
their arguments. With ``by=("run",)`` the logs of any number of runs go through
one job, each run keeping its own results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.operators import metrics as M
from meshtally.operators.formats import format_table
from meshtally.operators.process import process
from meshtally.operators.series import number_points, to_series
from meshtally.operators.stats import error_bars, fitted_cdf
from meshtally.session import settle
from meshtally.sources.logs import scrape, scrape_once

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Metric:
    """``points(table, tables, by, **arguments)`` gives a table with columns ``x`` and ``y``."""

    points: Callable[..., DataFrame]
    tables: Mapping[str, Sequence[str]]  # profile -> tables it needs
    kind: str
    xlabel: str
    ylabel: str
    errors: bool = False
    pos: str | None = None


# Grid step in s of the fitted association curve per profile. Fixed values.
CURVE_STEPS = {"atomic": 0.005}
CURVE_STEP = 0.1


def _xy(df: DataFrame, by: Sequence[str], x: str, y: str, *more: str) -> DataFrame:
    return df.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), *more)


def _latency_v_hops(df, tables, by, profile, packets, index=None, aggfunc=None, fill_hop=None):
    return _xy(M.latency_by_hops(df, packets, index, aggfunc, fill_hop, by), by, "hops", "lat")


def _pdr_v_hops(df, tables, by, profile, packets):
    return _xy(M.pdr_by_hops(df, packets, by), by, "hops", "pdr")


def _energy_v_hops(df, tables, by, profile, packets=None):
    nodes = M.hops_of_nodes(tables["all"], by=by) if "all" in tables else tables.get("node")
    return _xy(M.energy_by_hops(df, nodes, by=by), by, "hops", "rdc")


def _latency(df, tables, by, profile, packets=None, xlabel=None):
    return _xy(M.latency_total(df, packets, xlabel, by), by, "x", "lat")


def _pdr(df, tables, by, profile, packets=None, xlabel=None):
    if packets is not None:
        return _xy(M.pdr_by_type(df, packets, by), by, "type", "pdr")
    total = M.pdr_total(df, None, by)
    return _xy(total.withColumn("x", F.lit(str(xlabel if xlabel is not None else "ALL"))), by, "x", "pdr")


def _association_v_time(df, tables, by, profile, packets=None):
    times = M.association_times(df, packets, by)
    return fitted_cdf(times, "time", by, CURVE_STEPS.get(profile, CURVE_STEP)).withColumnRenamed("i", "pos")


def _op_times(df, tables, by, profile, packets=None):
    return _xy(M.op_times(df, packets, by), by, "op", "duration", "pos")


def _traffic_ratio(df, tables, by, profile, packets=None):
    ratio = M.traffic_ratio(tables["sdn"], tables["icmp"], by)
    return _xy(ratio.withColumn("x", F.lit("ratio")), by, "x", "ratio")


# Metric names, tables, plot kinds and axis labels.
METRICS: dict[str, Metric] = {
    "atomic_op_times": Metric(
        _op_times, {"atomic": ["atomic-op"]}, "bar", "Op Type", "Time(ms)", pos="pos"),
    "association_v_time": Metric(
        _association_v_time, {"atomic": ["atomic-op"], "layered": ["join"], "flat": ["join"]},
        "hist", "Time (s)", "Proportion of Nodes", pos="pos"),
    "latency_v_hops": Metric(
        _latency_v_hops, {"atomic": ["atomic-op"], "layered": ["sdn", "node"], "flat": ["all"]},
        "line", "Hops", "End-to-end delay (ms)", errors=True),
    "pdr_v_hops": Metric(
        _pdr_v_hops, {"atomic": ["atomic-op", "atomic-energy"], "layered": ["sdn", "node"], "flat": ["all"]},
        "bar", "Hops", "End-to-end PDR (%)"),
    "energy_v_hops": Metric(
        _energy_v_hops, {"atomic": ["atomic-energy"], "layered": ["sdn", "node", "pow"], "flat": ["all", "pow"]},
        "bar", "Hops", "Radio Duty Cycle (%)"),
    "latency": Metric(
        _latency, {"atomic": ["atomic-op"], "layered": ["sdn", "node"], "flat": ["all"]},
        "line", "Number of Nodes", "End-to-end delay (ms)", errors=True),
    "pdr": Metric(
        _pdr, {"atomic": ["atomic-op"], "layered": ["sdn", "node"], "flat": ["all"]},
        "bar", "Packet Type", "End-to-end PDR (%)"),
    "traffic_ratio": Metric(
        _traffic_ratio, {"layered": ["sdn", "icmp"]}, "bar", "Traffic", "Control / routing"),
}

_profiles: dict[str, str] = {}


def register_profile(name: str, like: str) -> None:
    """Another name for a profile (atomic, layered, flat)."""
    _profiles[name] = like


def register_metric(name: str, metric: Metric) -> None:
    METRICS[name] = metric


def build_tables(lines: DataFrame, patterns: Sequence[str], steps: Mapping[str, Sequence[Mapping]] | None = None,
                 by: Sequence[str] = (), store: str | None = None) -> dict[str, DataFrame]:
    """Log lines to formatted and processed tables.

    With ``store`` the log is read once for all patterns and the parsed rows
    are kept there; without it each table reads the log when it is used.
    """
    rows = scrape_once(lines, patterns, store) if store else scrape(lines, patterns)
    return process({name: format_table(name, df, by) for name, df in rows.items()}, steps or {})


def metric_series(name: str, tables: Tables, profile: str, arguments: Mapping | None = None,
                  run: str | None = None, by: Sequence[str] = (), number: bool = True) -> DataFrame:
    """One metric as a series; its name is the ``file`` argument, else the metric's own.

    Without ``number`` points that have no order of their own have no pos yet.
    """
    if name not in METRICS:
        raise KeyError(f"no metric named {name!r}; known: {sorted(METRICS)}")
    metric = METRICS[name]
    profile = _profiles.get(profile, profile)
    needed = metric.tables.get(profile)
    if needed is None:
        raise KeyError(f"metric {name!r} is not defined for profile {profile!r}")
    absent = [t for t in needed if t not in tables]
    if absent:
        raise LookupError(f"metric {name!r} needs tables {absent}")
    args = dict(arguments or {})
    source = args.pop("df", needed[0])
    title = args.pop("file", name)
    if name == "latency" and "xlabel" in args:
        title = f"{args['xlabel']}_{title}"
    given = {t: tables[t] for t in {*needed, source}}
    points = metric.points(given[source], given, by, profile, **args)
    if metric.errors or number and not metric.pos:
        points = settle(points)  # the few points come from a whole log and are read more than once
    if metric.errors:
        points = error_bars(points, by)
    return to_series(
        points, F.col("run") if "run" in by else str(run), title, metric.kind, "x", "y",
        metric.xlabel, metric.ylabel, "err" if metric.errors else None, metric.pos, number)


def analyse(lines: DataFrame, profile: str, patterns: Sequence[str], plots: Mapping[str, Mapping | None],
            steps: Mapping[str, Sequence[Mapping]] | None = None, run: str | None = None,
            by: Sequence[str] = (), store: str | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Tables and all series of one run, or of many with ``by=("run",)``."""
    tables = build_tables(lines, patterns, steps, by, store)
    series = None
    for name, arguments in plots.items():
        part = metric_series(name, tables, profile, arguments, run, by, number=False)
        series = part if series is None else series.unionByName(part)
    # the points of all metrics are worked out once, then numbered together
    return tables, None if series is None else number_points(settle(series))
