"""Delivery, latency, energy, association and operation metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.functions.maths import delivery_ratio, receive_ratio
from meshtally.functions.packets import millis_to_seconds
from meshtally.operators.ranks import join_on, last_value, modes, percentiles
from meshtally.session import settle

# Aggregates that a run description may name.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": percentiles, "count": F.count,
}

# Operation names as logged -> as reported, in report order.
OPERATIONS = {"CONF": "CONFIGURE", "CLCT": "COLLECT", "RACT": "REACT"}


def of_types(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return df if types is None or "type" not in df.columns else df.where(F.col("type").isin(list(types)))


def _missed(df: DataFrame) -> Column:
    return F.col("drpd") if "drpd" in df.columns else F.col("received") == "missed"


# --- summaries -------------------------------------------------------------

def run_summary(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Simulator profile: one row of packet counts."""
    got = F.col("received")
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("TX") > 0).alias("sent"), F.count_if(F.col("RX") > 0).alias("received"),
        F.count_if(got == "rtx").alias("retransmissions"),
        F.count_if(got == "missed").alias("missed"), F.count_if(got == "superfluous").alias("superfluous"))


def type_counts(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return packets.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("packets"))


def run_summary_testbed(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Testbed profile: one row of packet counts."""
    tx, rx = F.col("TX"), F.col("RX")
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tx == 1).alias("sent"), F.count_if(rx == 1).alias("received"),
        F.count_if(F.col("RTX") == 1).alias("retransmissions"),
        F.count_if((rx == 0) & (tx == 1)).alias("missed"),
        F.count_if((tx == 0) & (rx == 1)).alias("superfluous"))


def unpaired(packets: DataFrame) -> DataFrame:
    """Packets sent once and never received, or received once and never sent."""
    tx, rx = F.col("TX"), F.col("RX")
    return packets.where(((tx == 1) & (rx == 0)) | ((tx == 0) & (rx == 1)))


def topology_summary(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct nodes, highest and mean hops and, where known, degree."""
    stats = [F.count_distinct("node").alias("nodes"),
             F.max("hops").alias("max_hops"), F.avg("hops").alias("mean_hops")]
    if "degree" in nodes.columns:
        stats += [F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree")]
    return nodes.groupBy(*by).agg(*stats)


# --- delivery ---------------------------------------------------------------

def _delivery(df: DataFrame, *keys: str) -> DataFrame:
    missed = F.count_if(_missed(df))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), missed.alias("missed"),
        delivery_ratio(F.count(F.lit(1)), missed).alias("pdr"))


def pdr_by_hops(packets: DataFrame, types: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(hops, total, missed, pdr) of the given packet types."""
    if types is None:
        raise ValueError("pdr_by_hops needs packet types")
    return _delivery(of_types(packets, types).where(F.col("hops").isNotNull()), *by, "hops")


def pdr_by_type(packets: DataFrame, types: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return _delivery(of_types(packets, types).where(F.col("type").isNotNull()), *by, "type")


def pdr_total(packets: DataFrame, types: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row: total, received, missed, pdr. Here only the status counts."""
    df = of_types(packets, types)
    missed = F.count_if(F.col("received") == "missed")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.contains("received", F.lit("correct"))).alias("received"),
        missed.alias("missed"), delivery_ratio(F.count(F.lit(1)), missed).alias("pdr"))


def pdr_testbed(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Packets received once, less the superfluous ones, against packets sent once."""
    tx, rx = F.col("TX"), F.col("RX")
    sent, received = F.count_if(tx == 1), F.count_if(rx == 1)
    superfluous = F.count_if((tx == 0) & (rx == 1))
    return packets.groupBy(*by).agg(sent.alias("sent"), received.alias("received"), superfluous.alias("superfluous"),
                       receive_ratio(sent, received - superfluous).alias("pdr"))


# --- latency ----------------------------------------------------------------

def delivered(packets: DataFrame, types: Sequence[str] | None) -> DataFrame:
    df = of_types(packets, types)
    return df.where(F.col("received").isin("correct", "rtx")) if "received" in df.columns else df


def aggregate_by_name(df: DataFrame, keys: Sequence[str], functions: Mapping[str, str]) -> DataFrame:
    """Group by ``keys`` and apply the named function to each column."""
    unknown = [f for f in functions.values() if f not in AGGREGATES]
    if unknown:
        raise ValueError(f"aggregates not allowed: {unknown}; known: {sorted(AGGREGATES)}")
    medians = [c for c, f in functions.items() if f == "median"]
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[AGGREGATES[f](c).alias(c) for c, f in functions.items() if f != "median"])
    for c in medians:
        plain = join_on(plain, percentiles(df, c, {c: 0.5}, keys), keys, "left")
    return plain.select(*keys, *functions)


def _exchange_spans(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(hops, lat, n): span in ms of every exchange, with its packets per hop count.

    Packets are first combined per (id, hops), so the window sees only as many
    rows per id as that id has hop counts.
    """
    parts = df.where(F.col("id").isNotNull()).groupBy(*by, "id", "hops").agg(
        F.count(F.lit(1)).alias("n"), F.min("mintime").alias("_from"), F.max("maxtime").alias("_to"))
    w = W.partitionBy(*by, "id")
    return (
        parts.withColumns({
            "_all": F.sum("n").over(w),
            "lat": (F.unix_micros(F.max("_to").over(w)) - F.unix_micros(F.min("_from").over(w))).cast("double")
            / F.lit(1e3)})
        .where(F.col("_all") > 1).select(*by, "hops", "lat", "n")
    )


def latency_by_hops(packets: DataFrame, types: Sequence[str], index: Sequence[str] | None = None,
                    aggfunc: str | Mapping[str, str] | None = None, fill_hop: int | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """(hops, lat): mean latency of delivered packets per hop count.

    With several types, ``index`` and ``aggfunc``, packets are combined first:
    ``{'lat': name}`` aggregates over index and hops; ``between`` takes the time
    from the first to the last packet of each exchange. ``fill_hop`` adds that
    hop count, if it is missing, with the mean of the others.
    """
    df = delivered(packets, types)
    if len(types) > 1 and index is not None and aggfunc is not None:
        if "between" in aggfunc:
            spans = _exchange_spans(df, by).where(F.col("hops").isNotNull())
            by_hops = spans.groupBy(*by, "hops").agg(
                (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("lat"))
            return _fill_hop(by_hops, fill_hop, by)
        df = aggregate_by_name(df, list(dict.fromkeys([*by, *index, "hops"])), aggfunc)
    by_hops = df.where(F.col("hops").isNotNull()).groupBy(*by, "hops").agg(F.avg("lat").alias("lat"))
    return _fill_hop(by_hops, fill_hop, by)


def _fill_hop(by_hops: DataFrame, hop: int | None, by: Sequence[str]) -> DataFrame:
    if hop is None:
        return by_hops
    by_hops = settle(by_hops)  # a few rows from a whole log, used twice
    extra = (
        by_hops.groupBy(*by).agg(F.avg("lat").alias("lat"), F.count_if(F.col("hops") == hop).alias("_there"))
        .where(F.col("_there") == 0)
        .select(*by, F.lit(hop).cast(dict(by_hops.dtypes)["hops"]).alias("hops"), "lat")
    )
    return by_hops.unionByName(extra)


def latency_total(packets: DataFrame, types: Sequence[str] | None = None, label: str | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """(x, lat): mean latency of the delivered packets under one label."""
    x = label if label is not None else str(list(types)) if types is not None else "ALL"
    # a condition inside the mean, so a run that delivered nothing still has its row
    lat = F.avg(F.when(F.col("received") == "correct", F.col("lat")))
    return of_types(packets, types).groupBy(*by).agg(F.lit(x).alias("x"), lat.alias("lat"))


def latency_testbed(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: mean over paired packets, over all rows, over delivered rows."""
    paired = (F.col("TX") == 1) & (F.col("RX") == 1)
    return packets.groupBy(*by).agg(
        F.avg(F.when(paired, F.col("lat"))).alias("paired_lat"), F.avg("lat").alias("mean_lat"),
        F.avg(F.when(F.contains("received", F.lit("correct")), F.col("lat"))).alias("delivered_lat"))


def latency_by_retransmissions(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(RTX, lat): mean over paired packets per number of retransmissions."""
    paired = (F.col("TX") == 1) & (F.col("RX") == 1)
    return packets.where(paired).groupBy(*by, "RTX").agg(F.avg("lat").alias("lat"))


# --- energy -----------------------------------------------------------------

def hops_of_nodes(packets: DataFrame, skip_node: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent hops per sending node, the sink left out."""
    rows = packets.where(F.col("node") != skip_node)
    return modes(rows, [*by, "node"], ["hops"])


def energy_by_hops(energy: DataFrame, nodes: DataFrame | None = None, order: Sequence[str] = ("time", "line", "line_id"),
                   low: int = 1, high: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(hops, rdc): last duty cycle of each node, averaged per hop count.

    ``nodes`` (node, hops) replaces the hops of the energy rows.
    """
    latest = [c for c in order if c in energy.columns] or ["all_rdc"]
    if nodes is not None:
        energy = join_on(energy.drop("hops"), nodes.select(*by, "node", "hops"), [*by, "node"], "left")
    near = energy.where(F.col("hops").between(low, high) & F.col("node").isNotNull())
    return last_value(near, [*by, "hops", "node"], "all_rdc", latest).groupBy(*by, "hops").agg(F.avg("all_rdc").alias("rdc"))


# --- association, operations, traffic ---------------------------------------

def association_times(df: DataFrame, types: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(type, id, time in s); operation rows give their latency as time."""
    df = of_types(df, types)
    if "time" not in df.columns or "op_duration" in df.columns:
        df = df.select(*by, "type", F.col("node").alias("id"), millis_to_seconds("lat").alias("time"))
    return df.select(*by, "type", "id", "time")


def association_stats(times: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, median and maximum of the times."""
    keys = list(groups)
    basic = times.groupBy(*keys).agg(
        F.avg("time").alias("mean"), F.stddev_pop("time").alias("std_dev"), F.max("time").alias("max"))
    middle = percentiles(times, "time", {"median": 0.5}, keys)
    return join_on(basic, middle, keys, "left").select(*keys, "mean", "std_dev", "median", "max")


def op_times(ops: DataFrame, types: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(pos, op, duration): mean duration per operation, always all of them in report order."""
    means = of_types(ops, types).groupBy(*by).agg(*[
        F.avg(F.when(F.col("type").isin(logged, reported), F.col("op_duration"))).alias(reported)
        for logged, reported in OPERATIONS.items()])
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(o).alias("op"), F.col(o).alias("duration"))
        for i, o in enumerate(OPERATIONS.values())])
    return means.select(*by, F.inline(rows))


def op_time_summary(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over the few operation means."""
    return means.groupBy(*by).agg(F.avg("duration").alias("mean"), F.median("duration").alias("median"),
                     F.max("duration").alias("max"))


def traffic_ratio(control: DataFrame, routing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Control messages against routing messages: both are counted before they meet."""
    a = control.groupBy(*by).agg(F.count(F.lit(1)).alias("control"))
    b = routing.groupBy(*by).agg(F.count(F.lit(1)).alias("routing"))
    both = join_on(a, b, list(by), "left").withColumn("routing", F.coalesce("routing", F.lit(0)))
    return both.withColumn(
        "ratio", F.try_divide(F.col("control").cast("double"), F.col("routing").cast("double")))
