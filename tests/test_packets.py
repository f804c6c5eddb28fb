import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meshtally.functions.packets import status_by_pairing, status_by_receipt
from meshtally.operators import formats
from meshtally.operators import reconcile as reconcile_module
from meshtally.operators.reconcile import reconcile, reconcile_testbed, round_trips, state_cells, state_matrix

EVENT = "time bigint, node int, state string, type string, src int, dest int, seq bigint, hops int"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize("tx,rx,want", [
    (1, 0, "missed"), (1, 1, "correct"), (2, 1, "correct"), (1, 2, "superfluous"), (0, 1, "correct"), (0, 0, "missed")])
def test_status_by_receipt(spark, tx, rx, want):
    df = spark.createDataFrame([(tx, rx)], "TX int, RX int")
    assert df.select(status_by_receipt()).first()[0] == want


@pytest.mark.parametrize("tx,rx,rtx,want", [
    (1, 0, 0, "missed"), (0, 1, 0, "superfluous"), (1, 1, 0, "correct"), (1, 1, 2, "correct - RTX"),
    (2, 0, 0, "correct"), (1, 0, 1, "missed - RTX")])
def test_status_by_pairing(spark, tx, rx, rtx, want):
    df = spark.createDataFrame([(tx, rx, rtx)], "TX int, RX int, RTX int")
    assert df.select(status_by_pairing()).first()[0] == want


def test_keys(spark, rows):
    df = events(spark, [(1, 1, "OUT", t, 7, 1, 14, 2) for t in ("FTQ", "FTS", "REQUEST", "OPEN_PATH")])
    got = rows(formats.keyed_sdn(df), "type", "packet", "id", "state", "origin", "target")
    assert got == [
        ("FTQ", "FTQ_7_1_14", "7_14", "TX", 7, 1), ("FTS", "FTS_1_14", "1_14", "TX", 7, 1),
        ("OPEN_PATH", "OPEN_PATH_1_7_14", "1_7_14", "TX", 7, 1), ("REQUEST", "REQUEST_7_7_14", "7_7_14", "TX", 7, 1)]


def test_counts_latency_and_modes(spark):
    df = events(spark, [
        (1000, 7, "OUT", "FTS", 3, 1, 14, 2), (5000, 8, "IN", "FTS", 1, 1, 14, 4), (9000, 9, "IN", "FTS", 3, 1, 14, 3),
        (9500, 9, "BUF", "FTS", 1, 1, 14, None)])
    p = formats.format_sdn(df).first()
    assert (p["packet"], p["TX"], p["RX"], p["RTX"], p["FWD"], p["received"]) == ("FTS_1_14", 1, 2, 0, 0, "superfluous")
    # 3 and 1 are equally frequent: the smaller one
    assert (p["src"], p["node"], p["hops"], p["lat"]) == (1, 1, 4, 0.0)
    assert (p["mintime"], p["maxtime"]) == (datetime(1970, 1, 1, 0, 0, 0, 1000), datetime(1970, 1, 1, 0, 0, 0, 9500))


def test_delivered_latency_is_the_span(spark):
    df = events(spark, [(1000, 7, "OUT", "NSU", 7, 1, 1, 2), (4500, 1, "IN", "NSU", 7, 1, 1, 2)])
    assert formats.format_sdn(df).first()["lat"] == 3.5


def test_many_events_are_counted_exactly(spark):
    df = events(spark, [(i, 7, "TX", "NSU", 7, 1, 1, 2) for i in range(30)] + [(40, 1, "RX", "NSU", 7, 1, 1, 2)])
    p = formats.format_sdn(df).first()
    assert (p["TX"], p["RX"]) == (30, 1)


def test_missing_hops_and_origin_in_the_flat_table(spark, rows):
    df = spark.createDataFrame([
        (1, 2, "TX", "REQUEST", None, None, 5, 1, 9, 2), (3, 1, "RX", "REQUEST", None, None, 5, 1, 9, 2),
        (4, 1, "RX", "REQUEST", 4, 4, 5, 1, 9, None)],
        "time bigint, node int, state string, type string, origin int, target int, src int, dest int, seq bigint, hops int")
    assert rows(formats.format_all(df), "packet", "id", "origin", "target", "TX", "RX") == [("REQUEST_5_0_9", "5_0_9", 0, 0, 1, 1)]


def test_missing_parts_stay_visible_in_the_key(spark):
    df = events(spark, [(1, 1, "OUT", "NSU", None, 1, 14, 2)])
    assert formats.keyed_sdn(df).first()["packet"] == "NSU__1_14"


def test_one_packet_may_hold_most_rows(spark):
    """A repeated key with many values per column, against a plain count in Python."""
    hot = spark.range(30000).select(
        F.col("id").alias("time"), (F.col("id") % 50).cast("int").alias("node"),
        F.when(F.col("id") % 3 == 0, "TX").otherwise("RX").alias("state"), F.lit("FTS").alias("type"),
        F.when(F.col("id") % 4 == 0, 42).otherwise(F.col("id") % 997).cast("int").alias("src"), F.lit(1).alias("dest"),
        F.lit(5).cast("bigint").alias("seq"), (F.col("id") % 6).cast("int").alias("hops"))
    p = formats.format_sdn(hot.repartition(16)).first()
    assert (p["TX"], p["RX"], p["src"], p["hops"], p["received"]) == (10000, 20000, 42, 5, "correct")


def test_runs_stay_apart(spark, rows):
    df = events(spark, [(1, 7, "OUT", "NSU", 7, 1, 1, 2), (2, 1, "IN", "NSU", 7, 1, 1, 2)])
    both = df.withColumn("run", F.lit("a")).unionByName(df.where("state = 'OUT'").withColumn("run", F.lit("b")))
    assert rows(formats.format_sdn(both, by=["run"]), "run", "TX", "RX", "received") == [
        ("a", 1, 1, "correct"), ("b", 1, 0, "missed")]


def test_keys_that_came_with_the_rows(spark):
    df = events(spark, [(1, 7, "TX", "A", 7, 1, 1, 2), (2, 1, "RX", "B", 7, 1, 2, 2), (3, 1, "RX", "B", 7, 1, 2, 2)])
    p = formats.format_sdn(df.withColumn("packet", F.lit("p"))).first()
    assert (p["type"], p["seq"], p["TX"], p["RX"]) == ("B", 2, 1, 2)


def test_testbed_packets(spark, rows):
    df = spark.createDataFrame([
        ("p1", "TX", 3, 4, 17, 1000), ("p1", "RX", 3, 4, 17, 3000), ("p1", "RTR", 2, 4, 17, 2000), ("p2", "RX", 3, 4, 18, 500),
        ("p3", "TX", 3, 4, 19, 500)], "packet string, type string, epoch bigint, src int, id bigint, time bigint")
    assert rows(reconcile_testbed(df), "packet", "TX", "RX", "RTX", "epoch", "received", "lat") == [
        ("p1", 1, 1, 1, 3, "correct - RTX", 2.0), ("p2", 0, 1, 0, 3, "superfluous", 0.0), ("p3", 1, 0, 0, 3, "missed", 0.0)]


def test_state_matrix(spark, rows):
    df = spark.createDataFrame([("p", 1, "TX"), ("p", 2, "RX"), ("p", 2, "FWD"), ("p", 2, "RX"), ("q", 3, "RX"), ("q", 1, None)],
                               "packet string, node int, state string")
    assert rows(state_matrix(df, [1, 2, 3])) == [("p", "TX", "FWD RX RX", "MISS"), ("q", "MISS", "MISS", "RX")]
    assert rows(state_cells(df)) == [("p", 1, "TX"), ("p", 2, "FWD RX RX"), ("q", 3, "RX")]


def test_round_trip_over_one_id(spark, rows):
    df = events(spark, [
        (0, 7, "OUT", "FTQ", 7, 1, 14, 2), (30000, 1, "IN", "FTQ", 7, 1, 14, 2),
        (50000, 1, "OUT", "FTS", 1, 7, 14, 2), (90000, 7, "IN", "FTS", 1, 7, 14, 2), (0, 9, "OUT", "FTQ", 9, 1, 14, 2)])
    packets = formats.format_sdn(df)
    assert rows(round_trips(packets), "packet", "lat") == [("FTQ_7_1_14", 90.0), ("FTS_7_14", 90.0)]


def test_order_and_partitions_do_not_matter(spark, rows):
    df = events(spark, [(i * 7 % 1000, i % 9, ["OUT", "IN", "BUF"][i % 3], "NSU", i % 5, 1, i % 11, i % 6) for i in range(800)])
    want = rows(formats.format_sdn(df))
    assert rows(formats.format_sdn(df.repartition(13).sortWithinPartitions(F.desc("time")))) == want
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(formats.format_sdn(df.coalesce(1))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_reconcile_needs_no_keys_from_us(spark):
    df = events(spark, [(1, 7, "TX", "A", 7, 1, 1, 2)]).withColumns(
        {"packet": F.lit("p"), "id": F.lit("i"), "origin": F.lit(1), "target": F.lit(1)})
    assert reconcile(df).first()["received"] == "missed"


def test_packets_of_any_number_of_combinations(spark, monkeypatch):
    """Packets of few and of many combinations, NULLs and ties among them, against counting by hand; few sorts."""
    monkeypatch.setattr(reconcile_module, "FEW", 5)
    r = random.Random(7)
    columns = ["packet", "state", "time", "hops", "type", "id", "src", "dest", "seq", "origin", "target"]
    some = lambda n: r.choice([None, *range(n)])
    data = [(f"p{p}" if p else None, r.choice(["TX", "RX", "RTR", "FWD", None]), r.randint(0, 10**6), some(5), r.choice(["a", "b", None]),
             r.choice(["x", "y"]), some(3), some(2), some(40), some(4), None)
            for p in range(40) for _ in range(p * p // 4 + 1)]
    df = spark.createDataFrame(data, "packet string, state string, time bigint, hops int, type string, id string, src int, dest int, "
                                     "seq bigint, origin int, target int")
    for by, fixed in (([], ()), (["id"], ("id",))):
        made = reconcile(df, fixed, by)
        want = {}
        for p in {(d[0], d[5]) if by else (d[0],) for d in data}:
            own = [dict(zip(columns, d, strict=True)) for d in data if ((d[0], d[5]) if by else (d[0],)) == p]
            mode = {}
            for c in ("type", "id", "src", "dest", "seq", "origin", "target"):
                seen = Counter(e[c] for e in own if e[c] is not None)
                mode[c] = min(seen, key=lambda v, s=seen: (-s[v], v)) if seen else None
            states = Counter(e["state"] for e in own)
            times = [e["time"] for e in own]
            want[p] = (*[states[x] for x in ("TX", "RX", "RTR", "FWD")], *mode.values(),
                       max((e["hops"] for e in own if e["hops"] is not None), default=None), min(times), max(times))
        got = made.select("packet", F.col("id").alias("own_id"), "TX", "RX", "RTX", "FWD", "type", "id", "src", "dest", "seq", "origin",
                          "target", "hops", F.unix_micros("mintime"), F.unix_micros("maxtime")).collect()
        assert len(got) == len(want)
        assert {(g[0], g[1]) if by else (g[0],): tuple(g)[2:] for g in got} == want
        assert made._jdf.queryExecution().executedPlan().toString().count("- Sort [") <= 2
