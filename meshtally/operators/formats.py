"""From parsed rows to analysis tables, one function per log table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.functions.packets import exchange_id, is_dropped, micros_to_seconds, packet_key, radio_state
from meshtally.operators.ranks import modes
from meshtally.operators.reconcile import reconcile


def keyed_sdn(rows: DataFrame) -> DataFrame:
    """sdn or app rows with states, defaults and keys set, before reconciliation."""
    rows = rows.withColumns({
        "state": radio_state(),
        "seq": F.coalesce("seq", F.lit(0)),
        "hops": F.coalesce("hops", F.lit(0)),
        "origin": F.coalesce("origin", "src") if "origin" in rows.columns else F.col("src"),
        "target": F.coalesce("target", F.lit(1)) if "target" in rows.columns else F.lit(1),
    })
    if "packet" not in rows.columns:
        rows = rows.withColumn("packet", packet_key())
    return rows if "id" in rows.columns else rows.withColumn("id", exchange_id())


def _reconciled(rows: DataFrame, keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    # keys made here determine these columns; keys that came with the rows may not
    made = not {"packet", "id"} & set(rows.columns)
    return reconcile(keyed, fixed=("type", "id", "seq") if made else (), by=by)


def format_sdn(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _reconciled(rows, keyed_sdn(rows), by)


def keyed_all(rows: DataFrame) -> DataFrame:
    """Rows without hops are dropped; a missing origin or target is node 0."""
    rows = rows.dropna(subset=["hops"]).fillna(0, subset=["origin", "target"])
    if "packet" not in rows.columns:
        rows = rows.withColumn("packet", packet_key())
    return rows if "id" in rows.columns else rows.withColumn("id", exchange_id())


def format_all(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _reconciled(rows, keyed_all(rows), by)


def format_icmp(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, "level", "module", "type", "code", "node", "time")


def format_node(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent hops and degree per node."""
    return modes(rows.where(F.col("node").isNotNull()), [*by, "node"], ["hops", "degree"])


def format_join(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per association event: (type, id, time in s)."""
    rows = rows.withColumn("id", F.coalesce("id", "node")).drop("node", "level", "module")
    steps = ["dag", "dao", "controller"]
    return (
        rows.unpivot([*by, "id", "time"], steps, "type", "value")
        .where(F.col("value").isNotNull()).drop("value")
        .select(*by, "type", "id", micros_to_seconds("time").alias("time"))
    )


def format_energy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean duty cycle per node."""
    return (
        rows.where(F.col("node").isNotNull())
        .groupBy(*by, "node").agg(F.avg("all_rdc").alias("all_rdc"), F.avg("rdc").alias("rdc"))
    )


def format_atomic_energy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Projection; time and line number stay, as rows have no order of their own."""
    order = [c for c in ("time", "line", "line_id") if c in rows.columns]
    return rows.select(*by, "epoch", "node", "module", "type", "n_phases", "hops", "gon", "ron", "con",
                       "all_rdc", "rdc", *order)


def format_atomic_op(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """OP rows with drop flag and status; CONF rows count as active, set after the flag."""
    ops = rows.where(F.col("module") == "OP").select(
        *by, "epoch", "node", "module", "type", "hops", "c_phase", "n_phases", "lat", "op_duration", "active")
    ops = ops.withColumn("drpd", is_dropped())
    return ops.withColumns({
        "received": F.when(F.col("drpd"), "missed").otherwise("correct"),
        "active": F.when(F.col("type") == "CONF", F.lit(1)).otherwise(F.col("active")),
    })


# Called with the parsed rows and the extra leading keys (such as the run).
FORMATTERS: dict[str, Callable[..., DataFrame]] = {
    "app": format_sdn,
    "sdn": format_sdn,
    "sdn-any-state": format_sdn,
    "icmp": format_icmp,
    "node": format_node,
    "join": format_join,
    "pow": format_energy,
    "all": format_all,
    "atomic-energy": format_atomic_energy,
    "atomic-op": format_atomic_op,
}


def register_formatter(name: str, formatter: Callable[..., DataFrame]) -> None:
    FORMATTERS[name] = formatter


def format_table(name: str, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if name not in FORMATTERS:
        raise KeyError(f"no formatter for table {name!r}; known: {sorted(FORMATTERS)}")
    return FORMATTERS[name](rows, by=by)


def format_testbed(rows: DataFrame) -> DataFrame:
    """Complete testbed rows with their time in µs."""
    return rows.dropna("any").withColumn("time", F.unix_micros("timestamp"))
