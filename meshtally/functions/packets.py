"""Column expressions for packets: keys, states, status, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(*parts: str | Column) -> Column:
    """Parts joined by ``_``; a missing part stays visible as an empty one."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def packet_key() -> Column:
    """What makes one packet: its type with the fields that identify it."""
    kind = F.col("type")
    return (
        F.when(kind == "OPEN_PATH", _key(kind, "dest", "origin", "seq"))
        .when(kind == "REQUEST", _key(kind, "src", "origin", "seq"))
        .when(kind == "FTS", _key(kind, "dest", "seq"))
        .otherwise(_key(kind, "src", "dest", "seq"))
    )


def exchange_id() -> Column:
    """Shared by a request and its answer."""
    kind = F.col("type")
    return (
        F.when(kind == "OPEN_PATH", _key("dest", "origin", "seq"))
        .when(kind == "REQUEST", _key("src", "origin", "seq"))
        .when(kind == "FTS", _key("dest", "seq"))
        .otherwise(_key("src", "seq"))
    )


def radio_state(state: str = "state") -> Column:
    """OUT is a send, IN a receive; all else is kept."""
    s = F.col(state)
    return F.when(s == "OUT", "TX").when(s == "IN", "RX").otherwise(s)


def status_by_receipt(tx: str = "TX", rx: str = "RX") -> Column:
    """Simulator profile: never received, received too often, or correct."""
    sent, got = F.col(tx), F.col(rx)
    return (
        F.when(got == 0, "missed").when(sent > 1, "correct")
        .when(got > 1, "superfluous").otherwise("correct")
    )


def status_by_pairing(tx: str = "TX", rx: str = "RX", rtx: str = "RTX") -> Column:
    """Testbed profile: exactly one send against exactly one receive."""
    sent, got = F.col(tx), F.col(rx)
    status = (
        F.when((sent == 1) & (got == 0), "missed")
        .when((sent == 0) & (got == 1), "superfluous").otherwise("correct")
    )
    return F.concat(status, F.when(F.col(rtx) > 0, " - RTX").otherwise(""))


def is_dropped(active: str = "active", lat: str = "lat") -> Column:
    """An active node without a latency dropped its packet (NULL counts as no)."""
    return F.coalesce((F.col(active) == 1) & (F.col(lat) == 0), F.lit(False))


def micros_to_timestamp(us: str | Column) -> Column:
    return F.timestamp_micros(us)


def micros_to_seconds(us: str | Column) -> Column:
    return (F.col(us) if isinstance(us, str) else us).cast("double") / F.lit(1e6)


def micros_to_millis(us: str | Column) -> Column:
    return (F.col(us) if isinstance(us, str) else us).cast("double") / F.lit(1e3)


def millis_to_seconds(ms: str | Column) -> Column:
    return (F.col(ms) if isinstance(ms, str) else ms).cast("double") / F.lit(1e3)
