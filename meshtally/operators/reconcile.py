"""Send and receive events to one row per packet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.functions.packets import status_by_pairing, status_by_receipt
from meshtally.operators.ranks import join_on
from meshtally.sources.buckets import save_bucketed

# Output column -> state it counts.
STATES = {"TX": "TX", "RX": "RX", "RTX": "RTR", "FWD": "FWD"}


def combinations(events: DataFrame, packet: str, modal: Sequence[str], time_us: str, state: str = "state",
                 hops: str | None = None, fixed: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Step one of ``packet_summary``: the distinct combinations of a packet's columns with counts, first and last time.

    Combined before the shuffle: a packet repeated in a large share of the log shrinks to its few combinations.
    """
    return events.groupBy(*by, packet, *fixed, *modal).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(state) == s).alias(c) for c, s in STATES.items()],
        F.min(time_us).alias("_first"), F.max(time_us).alias("_last"),
        *([F.max(hops).alias("_hops")] if hops else []))


def packet_summary(events: DataFrame, packet: str, modal: Sequence[str], time_us: str, state: str = "state",
                   hops: str | None = None, fixed: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Event counts, first and last time, most frequent columns, highest hops per packet.

    ``fixed`` columns have one value per packet, ``modal`` ones take their most
    frequent value (smallest on ties, NULLs left out).

    Step one counts the distinct combinations of a packet's columns. Step two brings these together once per packet; the
    counts per column and the final aggregate reuse that partitioning. ``by`` adds
    leading keys, such as the run.
    """
    first = combinations(events, packet, modal, time_us, state, hops, fixed, by)
    return _summary(first.repartition(*by, packet), packet, modal, hops is not None, fixed, by)


FEW = 32  # combinations of one packet that are looked at together


def _most(rows: Column, c: str) -> Column:
    """The value of ``c`` with the highest summed count in a short list, the smallest of several; NULL only if there is no other."""
    def times(v: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, e: F.when(e[c] == v, acc + e["n"]).otherwise(acc))

    values = F.array_distinct(F.transform(rows, lambda r: r[c]))
    return F.array_min(F.transform(values, lambda v: F.struct((-times(v)).alias("m"), v.alias("v"))))["v"]


def _summary(merged: DataFrame, packet: str, modal: Sequence[str], hops: bool, fixed: Sequence[str],
             by: Sequence[str]) -> DataFrame:
    """Step two, on combinations that are laid out by packet.

    One sort brings a packet's combinations together. Packets of few are done there and go on as one row each, so only these
    rows, not all combinations, meet a second sort. The combinations of other packets go on once for each modal column, and
    that sort counts the column's values: a packet may have any number of them.
    """
    key = [*by, packet, *fixed]
    whole = {**dict.fromkeys(STATES, F.sum), "_first": F.min, "_last": F.max, **({"_hops": F.max} if hops else {})}
    if modal:
        place = W.partitionBy(*key).orderBy("_first")
        every = place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        few = F.col("_rows") <= FEW
        rows = merged.withColumns({"_rows": F.count(F.lit(1)).over(every), "_place": F.row_number().over(place)})
        rows = rows.withColumns({
            **{f"_all{c}": f(c).over(every) for c, f in whole.items()},
            "_list": F.collect_list(F.when(few, F.struct(
                F.col("_n").alias("n"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(modal)]))).over(every)})
        rows = rows.where(~few | (F.col("_place") == 1)).withColumns({
            **{c: F.when(few, F.col(f"_all{c}")).otherwise(F.col(c)) for c in whole},
            **{c: F.when(few, _most(F.col("_list"), f"v{i}")).otherwise(F.col(c)) for i, c in enumerate(modal)}})
        # -1: the one row of a packet; else the number of the column that this copy of a row counts
        rows = rows.withColumn("_of", F.explode(F.when(few, F.array(F.lit(-1))).otherwise(
            F.array(*[F.lit(i) for i in range(len(modal))]))))
        own = [F.when(F.col("_of") == i, F.col(c)) for i, c in enumerate(modal)]
        merged = rows.withColumn("_same", F.sum("_n").over(W.partitionBy(*key, "_of", *own))).withColumns(
            {c: F.when(F.col("_of") <= 0, F.col(c)) for c in STATES})

    def most(i: int, c: str) -> Column:
        counted = F.col(c).isNotNull() & F.col("_of").isin(-1, i)
        return F.min_by(c, F.when(counted, F.struct(-F.col("_same"), F.col(c)))).alias(c)

    return merged.groupBy(*key).agg(
        *[f(c).alias("hops" if c == "_hops" else c) for c, f in whole.items()],
        *[most(i, c) for i, c in enumerate(modal)])


def _latency(status: str = "received") -> Column:
    spent = (F.col("_last") - F.col("_first")).cast("double") / F.lit(1e3)
    return F.when(F.contains(F.col(status), F.lit("correct")), spent).otherwise(F.lit(0.0))


MODAL = ("type", "id", "src", "dest", "seq", "origin", "target")


def _modal(fixed: Sequence[str]) -> list[str]:
    return [c for c in MODAL if c not in fixed]


def _packets(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.withColumn("received", status_by_receipt()).select(
        *by, "packet", *STATES, "received", F.col("src").alias("node"), "type", "id", "src", "dest", "seq",
        "origin", "target", "hops", _latency().alias("lat"),
        F.timestamp_micros("_first").alias("mintime"), F.timestamp_micros("_last").alias("maxtime"))


def reconcile(events: DataFrame, fixed: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Packet table of the simulator profiles.

    ``events``: packet, id, type, state, time (µs), src, dest, seq, origin,
    target, hops. Latency is in ms, 0 unless delivered. ``fixed`` names the
    columns that follow from the packet key.
    """
    return _packets(packet_summary(events, "packet", _modal(fixed), "time", hops="hops", fixed=fixed, by=by), by)


def store_events(events: DataFrame, name: str, path: str, fixed: Sequence[str] = (), by: Sequence[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """Store events as combinations in buckets of the packet, for ``reconcile_stored``."""
    first = combinations(events, "packet", _modal(fixed), "time", hops="hops", fixed=fixed, by=by)
    return save_bucketed(first, name, path, [*by, "packet"], buckets)


def reconcile_stored(stored: DataFrame, fixed: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The packet table from what ``store_events`` wrote; nothing is shuffled."""
    return _packets(_summary(stored, "packet", _modal(fixed), True, fixed, by), by)


def reconcile_testbed(events: DataFrame, time_us: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """Packet table of the testbed profile: packet, type (state), epoch, src, id, time (µs)."""
    s = packet_summary(events, "packet", ["epoch", "src", "id"], time_us, state="type", by=by)
    return s.withColumn("received", status_by_pairing()).select(
        *by, "packet", *STATES, "epoch", "src", "id", "received", _latency().alias("lat"))


def state_cells(events: DataFrame, packet: str = "packet", node: str = "node", state: str = "state") -> DataFrame:
    """(packet, node, cell): the states seen by a node, sorted and joined by blanks.

    States are counted first; the text is repeated from the counts.
    """
    counts = events.where(F.col(state).isNotNull()).groupBy(packet, node, state).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    per_state = F.sort_array(F.collect_list(F.struct(F.col(state).alias("s"), F.col("_n").alias("n"))))
    text = F.transform(per_state, lambda e: F.trim(F.repeat(F.concat(e["s"], F.lit(" ")), e["n"])))
    # one entry per distinct state, not per event
    return counts.groupBy(packet, node).agg(F.array_join(text, " ").alias("cell"))


def state_matrix(events: DataFrame, nodes: Sequence, packet: str = "packet", node: str = "node",
                 state: str = "state", hole: str = "MISS") -> DataFrame:
    """Packets as rows, the listed nodes as columns, ``hole`` where a node saw nothing.

    For small node sets; ``state_cells`` is the same content for any number.
    """
    cells = state_cells(events, packet, node, state)
    grid = cells.groupBy(packet).pivot(node, list(nodes)).agg(F.first("cell"))
    return grid.fillna(hole, subset=[str(n) for n in nodes])


def round_trips(packets: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Packets whose ``key`` occurs more than once, ``lat`` replaced by the exchange's span in ms.

    Aggregate and join instead of a window: the join can split a key that holds
    a large share of the packets, a window cannot.
    """
    spans = (
        packets.where(F.col(key).isNotNull()).groupBy(*by, key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("mintime").alias("_from"), F.max("maxtime").alias("_to"))
        .where(F.col("_n") > 1)
    )
    if not by:  # a plain equality, so that packets stored in buckets of the key stay where they are
        spans = spans.withColumnRenamed(key, "_key")
        joined = packets.join(spans, F.col(key) == F.col("_key")).drop("_key")
    else:
        joined = join_on(packets, spans, [*by, key])
    span = (F.unix_micros("_to") - F.unix_micros("_from")).cast("double") / F.lit(1e3)
    return joined.withColumn("lat", span).drop("_n", "_from", "_to")
