import pytest
from pyspark.sql import functions as F

from meshtally.operators import formats, metrics as M

PACKET = ("packet string, TX bigint, RX bigint, RTX bigint, received string, node int, type string, id string, hops int, "
          "lat double, mintime timestamp, maxtime timestamp")


def packets(spark, rows):
    """(type, id, hops, received, lat ms)"""
    df = spark.createDataFrame(rows, "type string, id string, hops int, received string, lat double")
    return df.withColumns({
        "mintime": F.timestamp_micros(F.lit(0)), "maxtime": F.timestamp_micros((F.col("lat") * 1000).cast("bigint")),
        "node": F.lit(2), "TX": F.lit(1), "RX": F.when(F.col("received") == "missed", 0).otherwise(1), "RTX": F.lit(0)})


def delivery(spark):
    return packets(spark, [("A", str(i), 1, "missed" if i < 2 else "correct", 0.0 if i < 2 else 10.0) for i in range(10)]
                   + [("B", str(i), 2, "missed" if i < 1 else "correct", 0.0 if i < 1 else 30.0) for i in range(4)]
                   + [("C", "9", 2, "superfluous", 0.0), ("A", "n", None, "missed", 0.0)])


def test_pdr(spark, rows):
    assert rows(M.pdr_by_hops(delivery(spark), ["A", "B"]), "hops", "pdr") == [(1, 80.0), (2, 75.0)]
    assert rows(M.pdr_by_type(delivery(spark), ["B", "C"]), "type", "total", "missed", "pdr") == [("B", 4, 1, 75.0), ("C", 1, 0, 100.0)]
    total = M.pdr_total(delivery(spark)).first()
    assert (total["total"], total["missed"], total["received"], total["pdr"]) == (16, 4, 11, 75.0)
    with pytest.raises(ValueError):
        M.pdr_by_hops(delivery(spark), None)


def test_drop_flag_comes_first(spark, rows):
    df = delivery(spark).withColumn("drpd", F.lit(True))
    assert rows(M.pdr_by_hops(df, ["A"]), "pdr") == [(0.0,)]


def test_latency_counts_delivered_packets_only(spark, rows):
    assert rows(M.latency_by_hops(delivery(spark), ["A", "B", "C"])) == [(1, 10.0), (2, 30.0)]
    assert rows(M.latency_total(delivery(spark))) == [("ALL", (8 * 10 + 3 * 30) / 11)]
    assert rows(M.latency_total(delivery(spark), ["B"], "30")) == [("30", 30.0)]


def test_latency_preaggregated(spark, rows):
    df = packets(spark, [("A", "1", 1, "correct", 10.0), ("B", "1", 1, "correct", 20.0), ("A", "2", 1, "correct", 6.0)])
    index = ["id"]
    assert rows(M.latency_by_hops(df, ["A", "B"], index, {"lat": "sum"})) == [(1, 18.0)]
    assert rows(M.latency_by_hops(df, ["A", "B"], index, {"lat": "median"})) == [(1, 10.5)]
    assert index == ["id"]
    # one type, or no index: no aggregation before the mean
    assert rows(M.latency_by_hops(df, ["A"], index, {"lat": "sum"})) == [(1, 8.0)]
    assert rows(M.latency_by_hops(df, ["A", "B"], None, {"lat": "sum"})) == [(1, 12.0)]
    with pytest.raises(ValueError):
        M.latency_by_hops(df, ["A", "B"], index, {"lat": "eval"})


def test_latency_between(spark, rows):
    df = packets(spark, [("A", "1", 1, "correct", 30.0), ("B", "1", 2, "correct", 90.0), ("A", "2", 1, "correct", 6.0),
                         ("B", None, 1, "correct", 1.0), ("A", None, 1, "correct", 1.0)])
    assert rows(M.latency_by_hops(df, ["A", "B"], ["id"], "between")) == [(1, 90.0), (2, 90.0)]


def test_latency_fill(spark, rows):
    assert rows(M.latency_by_hops(delivery(spark), ["A", "B"], fill_hop=5)) == [(1, 10.0), (2, 30.0), (5, 20.0)]
    assert rows(M.latency_by_hops(delivery(spark), ["A", "B"], fill_hop=2)) == [(1, 10.0), (2, 30.0)]


def test_summaries(spark, rows):
    s = M.run_summary(delivery(spark)).first().asDict()
    assert s == {"total": 16, "sent": 16, "received": 12, "retransmissions": 0, "missed": 4, "superfluous": 1}
    assert rows(M.type_counts(delivery(spark))) == [("A", 11), ("B", 4), ("C", 1)]


TB = "packet string, TX bigint, RX bigint, RTX bigint, received string, lat double"


def test_testbed_metrics(spark, rows):
    df = spark.createDataFrame([
        ("1", 1, 1, 0, "correct", 10.0), ("2", 1, 1, 1, "correct - RTX", 30.0), ("3", 1, 0, 0, "missed", 0.0),
        ("4", 0, 1, 0, "superfluous", 0.0), ("5", 2, 0, 0, "correct", 50.0)], TB)
    assert M.pdr_testbed(df).first()["pdr"] == pytest.approx(200 / 3)
    assert tuple(M.latency_testbed(df).first()) == (20.0, 18.0, 30.0)
    assert rows(M.latency_by_retransmissions(df)) == [(0, 10.0), (1, 30.0)]
    s = M.run_summary_testbed(df).first().asDict()
    assert s == {"total": 5, "sent": 3, "received": 3, "retransmissions": 1, "missed": 1, "superfluous": 1}
    assert rows(M.unpaired(df), "packet") == [("3",), ("4",)]


def test_energy(spark, rows):
    df = spark.createDataFrame([
        (10, 1, 1, 9.0), (20, 1, 1, 4.0), (30, 1, 1, None), (5, 2, 1, 6.0), (5, 3, 7, 1.0), (5, 4, None, 1.0)],
        "time bigint, node int, hops int, all_rdc double")
    assert rows(M.energy_by_hops(df)) == [(1, 5.0)]
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "node int, hops int")
    assert rows(M.energy_by_hops(df, nodes)) == [(2, 2.5), (3, 6.0)]


def test_hops_of_nodes(spark, rows):
    df = spark.createDataFrame([(1, 9), (2, 3), (2, 1), (2, 3), (3, 4), (3, 2)], "node int, hops int")
    assert rows(M.hops_of_nodes(df)) == [(2, 3), (3, 2)]


OP = ("epoch bigint, node int, module string, type string, hops int, c_phase int, n_phases int, lat bigint, "
      "op_duration bigint, active int")


def ops(spark):
    return formats.format_atomic_op(spark.createDataFrame([
        (1, 1, "OP", "CONF", 1, 1, 2, 0, 100, 0), (1, 2, "OP", "CLCT", 2, 1, 2, 0, 50, 1), (1, 2, "OP", "CLCT", 2, 1, 2, 5000, 70, 1),
        (1, 2, "PW", "CLCT", 2, 1, 2, 5, 70, 1), (1, 3, "OP", "ASSC", 1, 1, 2, 2500, 10, 1), (1, 3, "OP", "ASSC", 1, None, 2, None, 10, 1)], OP))


def test_operations(spark, rows):
    assert rows(ops(spark), "type", "active", "drpd", "received") == [
        ("ASSC", 1, False, "correct"), ("ASSC", 1, False, "correct"), ("CLCT", 1, False, "correct"),
        ("CLCT", 1, True, "missed"), ("CONF", 1, False, "correct")]
    times = M.op_times(ops(spark), ["CONF", "CLCT", "RACT"])
    assert rows(times) == [(0, "CONFIGURE", 100.0), (1, "COLLECT", 60.0), (2, "REACT", None)]
    assert tuple(M.op_time_summary(times).first()) == (80.0, 80.0, 100.0)
    topology = M.topology_summary(ops(spark)).first()
    assert (topology["nodes"], topology["max_hops"]) == (3, 2)


def test_association(spark, rows):
    joins = spark.createDataFrame([
        (2_000_000, 3, "STAT", "RPL", None, None, 1, None), (4_000_000, 4, "STAT", "RPL", 9, 1, 1, None),
        (6_000_000, 5, "STAT", "SDN", 4, 1, None, None)],
        "time bigint, node int, level string, module string, id int, controller int, dag int, dao int")
    table = formats.format_join(joins)
    assert rows(table) == [("controller", 4, 6.0), ("controller", 9, 4.0), ("dag", 3, 2.0), ("dag", 9, 4.0)]
    s = M.association_stats(M.association_times(table, ["dag"])).first()
    assert tuple(s) == (3.0, 1.0, 3.0, 4.0)
    op = M.association_times(ops(spark), ["ASSC"]).where("time is not null").first()
    assert (op["id"], op["time"]) == (3, 2.5)


def test_traffic_ratio(spark):
    assert tuple(M.traffic_ratio(spark.range(6), spark.range(4)).first()) == (6, 4, 1.5)
    assert tuple(M.traffic_ratio(spark.range(6), spark.range(0)).first()) == (6, 0, None)


def test_by_run(spark, rows):
    df = delivery(spark).withColumn("run", F.lit("x")).unionByName(delivery(spark).where("type = 'B'").withColumn("run", F.lit("y")))
    assert rows(M.pdr_by_hops(df, ["A", "B"], ["run"]), "run", "hops", "pdr") == [("x", 1, 80.0), ("x", 2, 75.0), ("y", 2, 75.0)]
    assert rows(M.latency_by_hops(df, ["A", "B"], fill_hop=1, by=["run"])) == [("x", 1, 10.0), ("x", 2, 30.0), ("y", 1, 30.0), ("y", 2, 30.0)]
    assert rows(M.latency_by_hops(df, ["A", "B"], ["id"], "between", by=["run"]), "run", "hops", "lat") == [
        ("x", 1, 30.0), ("x", 2, 30.0)]
