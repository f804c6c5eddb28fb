"""Queries on parsing, packets and metrics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.functions.packets import (
    exchange_id, micros_to_millis, micros_to_seconds, micros_to_timestamp, packet_key)
from meshtally.operators import formats, metrics
from meshtally.operators.ranks import last_value, modes
from meshtally.operators.reconcile import reconcile, reconcile_testbed, round_trips, state_matrix
from meshtally.plans import views as V
from meshtally.plans.catalog import query
from meshtally.plans.experiment import build_tables
from meshtally.session import scratch_dir, settle
from meshtally.sources import logs, tables

CONTROL = ["FTQ", "FTS", "NSU"]
PAIRS = ["FTQ", "FTS", "REQUEST", "OPEN_PATH"]


def r6(column: str, name: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(name or column)


def sdn_packets(spark, sf):
    return formats.format_sdn(V.sdn_rows(spark, sf))


def flat_packets(spark, sf):
    """DATA rows miss their hops at times, some rows their origin or target."""
    p = V.plog(spark, sf)
    rows = p.select(
        "time", "node", F.when(F.col("state") == "OUT", "TX").otherwise("RX").alias("state"), "type",
        "src", "dest", "seq", F.when(F.col("hops") < 6, F.col("hops")).alias("hops"),
        F.when(F.col("seq") % 3 > 0, F.col("origin")).alias("origin"),
        F.when(F.col("seq") % 5 > 0, F.lit(1)).alias("target"))
    return formats.format_all(rows)


def testbed_packets(spark, sf):
    return reconcile_testbed(V.shipments(spark, sf))


# --- parsing ----------------------------------------------------------------

@query("parse_packets", f"""
WITH {V.PLOG}
SELECT event_id, time, node, 'STAT' AS level, 'SDN' AS module, state, type, src, dest, 2 AS app, seq, hops, 0 AS mac FROM plog""")
def parse_packets(spark, sf):
    lines = V.plog(spark, sf).select(V.sdn_line().alias("value"), "event_id")
    return logs.parse(lines, "sdn")


@query("parse_multi", f"""
WITH {V.OPS}
SELECT event_id, 'atomic-op' AS pattern, time, node, CASE event_type WHEN 'view' THEN 'OP' ELSE 'PW' END AS module,
  g AS epoch, op AS type, hops, CASE event_type WHEN 'view' THEN k % 5 END AS phases,
  CASE event_type WHEN 'view' THEN CAST(dur AS BIGINT) END AS lat, NULL::DOUBLE AS all_rdc, NULL::INTEGER AS degree
FROM ops WHERE event_type IN ('view', 'purchase')
UNION ALL
SELECT event_id, 'atomic-energy', time, node, CASE event_type WHEN 'view' THEN 'OP' ELSE 'PW' END,
  g, op, hops, CASE event_type WHEN 'purchase' THEN k % 5 END, NULL,
  CASE event_type WHEN 'purchase' THEN round(value, 2) END, NULL
FROM ops WHERE event_type IN ('view', 'purchase')
UNION ALL
SELECT event_id, 'node', time, node, 'RPL', NULL, NULL, hops, NULL, NULL, NULL, k % 9 FROM ops WHERE event_type = 'click'
UNION ALL
SELECT event_id, 'icmp', time, node, 'ICMP', NULL, CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL
FROM ops WHERE event_type = 'error'
UNION ALL
SELECT event_id, 'pow', time, node, 'POW', NULL, NULL, NULL, NULL, NULL, round(value, 2), NULL FROM ops WHERE event_type = 'signup'""")
def parse_multi(spark, sf):
    names = ["atomic-op", "atomic-energy", "node", "icmp", "pow"]
    routed = logs.route(V.op_lines(spark, sf), names)

    return routed.select(
        "event_id", "pattern", "time", "node", "module", "epoch", "type", "hops",
        F.col("n_phases").alias("phases"), "lat", "all_rdc", "degree")


@query("parse_power", f"""
WITH {V.PLOG}
SELECT event_id, time, node, 'POW' AS module, round(value, 2) AS all_rdc, k / 10.0::DOUBLE AS rdc
FROM plog WHERE event_type = 'signup'""")
def parse_power(spark, sf):
    rows = logs.parse(V.op_lines(spark, sf), "pow")
    return rows.select("event_id", "time", "node", "module", "all_rdc", "rdc")


def _testbed_lines(spark, sf):
    """One line per event, a NUL byte inside, the source left out of error lines."""
    p = V.plog(spark, sf)
    return p.select(
        F.concat(
            F.lit("["), F.date_format(F.timestamp_micros("time"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("]\u0000 D: ep:"),
            F.col("k"), F.lit(" "), F.when(F.col("state") == "OUT", "TX").otherwise("RX"), F.lit(" "),
            F.lpad(F.lower(F.hex("pkt")), 16, "0"), F.lit(" id:"), F.col("pkt"),
            F.when(F.col("event_type") != "error", F.concat(F.lit(" s:"), F.col("src"))).otherwise("")).alias("value"),
        F.concat(F.lit("/logs/day1/NATION_"), F.col("node") % 30, F.lit(".txt")).alias("file"), "event_id")


@query("multi_file_parse", f"""
WITH {V.PLOG}
SELECT event_id, time, CAST(k AS BIGINT) AS epoch, CASE state WHEN 'OUT' THEN 'TX' ELSE 'RX' END AS type,
  lpad(lower(printf('%x', pkt)), 16, '0') AS packet, pkt AS id, src, n_nationkey AS node
FROM plog LEFT JOIN nation ON n_name = 'NATION_' || (node % 30)
WHERE event_type <> 'error'""")
def multi_file_parse(spark, sf):
    names = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    rows = logs.parse_testbed(_testbed_lines(spark, sf), names)
    return rows.select("event_id", F.unix_micros("timestamp").alias("time"), "epoch", "type", "packet", "id", "src", "node")


@query("testbed_fields", f"""
WITH {V.PLOG}
SELECT event_id, CAST(k AS BIGINT) AS epoch, 'TX' AS type, 'ab ' || (k % 10) AS packet, pkt AS id, src FROM plog""")
def testbed_fields(spark, sf):
    """Short packet names: the strict pattern keeps the next tag out of them."""
    p = V.plog(spark, sf)
    lines = p.select(F.concat(F.lit("x| D: ep:"), "k", F.lit(" TX ab "), F.col("k") % 10, F.lit(" id:"), "pkt",
                              F.lit(" s:"), "src").alias("value"), "event_id")
    return logs.parse(lines, "testbed-strict").select("event_id", "epoch", "type", "packet", "id", "src")


@query("drop_null_cols", """
SELECT event_id, event_type, CASE WHEN event_id % 1000 = 7 THEN value END AS rare FROM events""")
def drop_null_cols(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", "event_type", F.lit(None).cast("int").alias("gone"),
        F.when(F.col("event_id") % 1000 == 7, F.col("value")).alias("rare"), F.lit(None).cast("string").alias("none"))
    return tables.drop_null_columns(e)


@query("sink_roundtrip", f"""
WITH {V.PACKETS}
SELECT packet, unnest(['007', '1e3']) AS run, type, received, lat FROM packets
UNION ALL SELECT packet, 'csv', type, received, lat FROM packets""")
def sink_roundtrip(spark, sf):
    """Packets stored under names of runs that look like numbers, one twice, and as CSV, then read back."""
    packets = settle(sdn_packets(spark, sf))
    path = f"{scratch_dir(spark)}/roundtrip-{uuid.uuid4().hex}"
    for run, rows in (("007", packets.limit(1)), ("1e3", packets), ("7", packets), ("007", packets)):
        tables.save_tables({"packet": rows}, path, run)
    stored = tables.load_table(spark, path, "packet", ["007", "1e3"])
    tables.write_csv(stored.where("run = '007'").select("packet", "type", "received", "lat"), f"{path}/csv")
    text = tables.read_csv(spark, f"{path}/csv", "packet string, type string, received string, lat double")
    return stored.select("packet", "run", "type", "received", "lat").unionByName(text.withColumn("run", F.lit("csv")))


# --- keys, times, packets ---------------------------------------------------

@query("packet_keys", f"WITH {V.KEYED} SELECT time, state, packet, id, origin, target FROM keyed")
def packet_keys(spark, sf):
    return formats.keyed_sdn(V.sdn_rows(spark, sf)).select("time", "state", "packet", "id", "origin", "target")


@query("packet_keys_origin", f"""
WITH {V.PLOG}
SELECT event_id,
  CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', type, dest, origin, seq) WHEN 'REQUEST' THEN concat_ws('_', type, src, origin, seq)
            WHEN 'FTS' THEN concat_ws('_', type, dest, seq) ELSE concat_ws('_', type, src, dest, seq) END AS packet,
  CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', dest, origin, seq) WHEN 'REQUEST' THEN concat_ws('_', src, origin, seq)
            WHEN 'FTS' THEN concat_ws('_', dest, seq) ELSE concat_ws('_', src, seq) END AS id
FROM plog""")
def packet_keys_origin(spark, sf):
    return V.plog(spark, sf).select("event_id", packet_key().alias("packet"), exchange_id().alias("id"))


@query("time_units", f"""
WITH {V.PLOG}
SELECT event_id, time, round(time / 1e6, 6) AS seconds, round(time / 1e3, 3) AS millis, time AS micros FROM plog""")
def time_units(spark, sf):
    return V.plog(spark, sf).select(
        "event_id", "time", F.round(micros_to_seconds("time"), 6).alias("seconds"),
        F.round(micros_to_millis("time"), 3).alias("millis"), F.unix_micros(micros_to_timestamp("time")).alias("micros"))


def _packet_columns(df):
    return df.withColumns({"mintime_us": F.unix_micros("mintime"), "maxtime_us": F.unix_micros("maxtime"),
                           "lat": F.round("lat", 6)}).drop("mintime", "maxtime")


@query("packet_status", f"WITH {V.PACKETS} SELECT * REPLACE (round(lat, 6) AS lat) FROM packets")
def packet_status(spark, sf):
    """Lines to packets: parse, key, reconcile."""
    lines = V.plog(spark, sf).select(V.sdn_line().alias("value"))
    return _packet_columns(formats.format_sdn(logs.parse(lines, "sdn")))


_FLAT = V.PLOG + """,
flat AS (
  SELECT time, node, CASE state WHEN 'OUT' THEN 'TX' ELSE 'RX' END AS state, type, src, dest, seq, hops,
    CASE WHEN seq % 3 > 0 THEN origin ELSE 0 END AS origin, CASE WHEN seq % 5 > 0 THEN 1 ELSE 0 END AS target
  FROM plog WHERE hops < 6),
flat_keyed AS (
  SELECT *,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', type, dest, origin, seq) WHEN 'REQUEST' THEN concat_ws('_', type, src, origin, seq)
              WHEN 'FTS' THEN concat_ws('_', type, dest, seq) ELSE concat_ws('_', type, src, dest, seq) END AS packet,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', dest, origin, seq) WHEN 'REQUEST' THEN concat_ws('_', src, origin, seq)
              WHEN 'FTS' THEN concat_ws('_', dest, seq) ELSE concat_ws('_', src, seq) END AS id
  FROM flat),""" + V.packets_sql("flat_keyed")


@query("packet_status_all", f"WITH {_FLAT} SELECT * REPLACE (round(lat, 6) AS lat) FROM packets")
def packet_status_all(spark, sf):
    return _packet_columns(flat_packets(spark, sf))


@query("packet_status_tb", f"WITH {V.PACKETS_TB} SELECT * REPLACE (round(lat, 6) AS lat) FROM packets")
def packet_status_tb(spark, sf):
    return testbed_packets(spark, sf).withColumn("lat", F.round("lat", 6))


@query("packet_status_mixed", f"""
WITH {V.SHIPMENTS},
mixed AS (SELECT *, type AS state, kind AS k2, CAST(node % 3 AS INTEGER) AS hops, CAST(epoch AS INTEGER) AS dest, id % 4 AS seq,
    CAST(id % 6 AS INTEGER) AS origin, CAST(id % 2 AS INTEGER) AS target FROM shipments),
keyed AS (SELECT packet, state, time, hops, src, dest, seq, origin, target, k2 AS type, CAST(id % 5 AS VARCHAR) AS id FROM mixed),
{V.packets_sql("keyed")}
SELECT * REPLACE (round(lat, 6) AS lat) FROM packets""")
def packet_status_mixed(spark, sf):
    """Keys that came with the rows: every column takes its most frequent value."""
    s = V.shipments(spark, sf)
    return _packet_columns(reconcile(s.select(
        "packet", F.col("type").alias("state"), "time", F.col("kind").alias("type"),
        (F.col("id") % 5).cast("string").alias("id"), "src", F.col("epoch").cast("int").alias("dest"),
        (F.col("id") % 4).alias("seq"), (F.col("id") % 6).cast("int").alias("origin"),
        (F.col("id") % 2).cast("int").alias("target"), (F.col("node") % 3).alias("hops"))))


@query("state_matrix", f"""
WITH {V.SHIPMENTS},
cells AS (SELECT packet, node, string_agg(type, ' ' ORDER BY type) AS cell FROM shipments GROUP BY packet, node)
SELECT packet, {", ".join(f"coalesce(max(cell) FILTER (node = {n}), 'MISS') AS n{n}" for n in range(1, 8))}
FROM cells GROUP BY packet""")
def state_matrix_query(spark, sf):
    wide = state_matrix(V.shipments(spark, sf), list(range(1, 8)), state="type")
    return wide.withColumnsRenamed({str(n): f"n{n}" for n in range(1, 8)})


# --- summaries --------------------------------------------------------------

@query("run_summary", f"""
WITH {V.PACKETS}
SELECT count(*) AS total, count(*) FILTER ("TX" > 0) AS sent, count(*) FILTER ("RX" > 0) AS received,
  count(*) FILTER (received = 'rtx') AS retransmissions, count(*) FILTER (received = 'missed') AS missed,
  count(*) FILTER (received = 'superfluous') AS superfluous FROM packets""")
def run_summary(spark, sf):
    return metrics.run_summary(sdn_packets(spark, sf))


@query("type_counts", f"WITH {V.PACKETS} SELECT type, count(*) AS packets FROM packets GROUP BY type")
def type_counts(spark, sf):
    return metrics.type_counts(sdn_packets(spark, sf))


@query("run_summary_tb", f"""
WITH {V.PACKETS_TB}
SELECT count(*) AS total, count(*) FILTER ("TX" = 1) AS sent, count(*) FILTER ("RX" = 1) AS received,
  count(*) FILTER ("RTX" = 1) AS retransmissions, count(*) FILTER ("RX" = 0 AND "TX" = 1) AS missed,
  count(*) FILTER ("TX" = 0 AND "RX" = 1) AS superfluous FROM packets""")
def run_summary_tb(spark, sf):
    return metrics.run_summary_testbed(testbed_packets(spark, sf))


@query("unpaired_packets", f"""
WITH {V.PACKETS_TB}
SELECT packet, "TX", "RX", "RTX", received FROM packets WHERE ("TX" = 1 AND "RX" = 0) OR ("TX" = 0 AND "RX" = 1)""")
def unpaired_packets(spark, sf):
    return metrics.unpaired(testbed_packets(spark, sf)).select("packet", "TX", "RX", "RTX", "received")


_NODE_SQL = V.PLOG + """,
nodes AS (SELECT node, hops, k % 9 AS degree FROM plog),
node_hops AS (SELECT node, hops FROM (SELECT node, hops, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, hops) AS rn
  FROM nodes GROUP BY node, hops) WHERE rn = 1),
node_degree AS (SELECT node, degree FROM (SELECT node, degree, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, degree) AS rn
  FROM nodes GROUP BY node, degree) WHERE rn = 1),
node_fmt AS (SELECT node, hops, degree FROM node_hops JOIN node_degree USING (node))"""


def _nodes(spark, sf):
    return V.plog(spark, sf).select("node", "hops", (F.col("k") % 9).alias("degree"))


@query("node_mode", f"WITH {_NODE_SQL} SELECT node, hops, degree FROM node_fmt")
def node_mode(spark, sf):
    return formats.format_node(_nodes(spark, sf))


@query("topology_summary", f"""
WITH {_NODE_SQL}
SELECT count(DISTINCT node) AS nodes, max(hops) AS max_hops, round(avg(hops), 6) AS mean_hops, max(degree) AS max_degree,
  round(avg(degree), 6) AS mean_degree FROM node_fmt""")
def topology_summary(spark, sf):
    s = metrics.topology_summary(formats.format_node(_nodes(spark, sf)))
    return s.select("nodes", "max_hops", r6("mean_hops"), "max_degree", r6("mean_degree"))


@query("modal_value", """
WITH flags AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn
  FROM lineitem GROUP BY l_suppkey, l_returnflag),
lines AS (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn
  FROM lineitem GROUP BY l_suppkey, l_linenumber)
SELECT l_suppkey, l_returnflag, l_linenumber FROM flags JOIN lines USING (l_suppkey) WHERE flags.rn = 1 AND lines.rn = 1""")
def modal_value(spark, sf):
    return modes(V.table(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linenumber"])


@query("node_energy", f"""
WITH {V.PLOG} SELECT node, round(avg(value), 6) AS all_rdc, round(avg(k / 10.0::DOUBLE), 6) AS rdc FROM plog GROUP BY node""")
def node_energy(spark, sf):
    rows = V.plog(spark, sf).select("node", F.col("value").alias("all_rdc"), (F.col("k") / 10).alias("rdc"))
    return formats.format_energy(rows).select("node", r6("all_rdc"), r6("rdc"))


@query("last_per_group", f"""
WITH {V.PLOG}
SELECT node, value FROM (SELECT node, value, row_number() OVER (PARTITION BY node ORDER BY time DESC, event_id DESC) AS rn
  FROM plog WHERE k % 4 > 0) WHERE rn = 1""")
def last_per_group(spark, sf):
    rows = V.plog(spark, sf).withColumn("value", F.when(F.col("k") % 4 > 0, F.col("value")))
    return last_value(rows, ["node"], "value", ["time", "event_id"])


# --- operations and energy --------------------------------------------------

def _ops(spark, sf):
    return formats.format_atomic_op(logs.parse(V.op_lines(spark, sf), "atomic-op"))


@query("op_format", f"WITH {V.OPS} SELECT * FROM op_fmt")
def op_format(spark, sf):
    return _ops(spark, sf)


@query("op_times", f"""
WITH {V.OPS},
means AS (SELECT type, avg(op_duration) AS duration FROM op_fmt GROUP BY type)
SELECT pos, op, round(duration, 6) AS duration
FROM (VALUES (0, 'CONFIGURE', 'CONF'), (1, 'COLLECT', 'CLCT'), (2, 'REACT', 'RACT')) AS o(pos, op, type) LEFT JOIN means USING (type)""")
def op_times(spark, sf):
    return metrics.op_times(_ops(spark, sf), ["CONF", "CLCT", "RACT"]).select("pos", "op", r6("duration"))


@query("op_time_summary", f"""
WITH {V.OPS},
means AS (SELECT avg(op_duration) AS d FROM op_fmt WHERE type IN ('CONF', 'CLCT', 'RACT') GROUP BY type)
SELECT round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(max(d), 6) AS max FROM means""")
def op_time_summary(spark, sf):
    s = metrics.op_time_summary(metrics.op_times(_ops(spark, sf), ["CONF", "CLCT", "RACT"]))
    return s.select(r6("mean"), r6("median"), r6("max"))


def _energy(spark, sf):
    return formats.format_atomic_energy(logs.parse(V.op_lines(spark, sf), "atomic-energy"))


_ENERGY_SQL = V.OPS + """,
energy AS (
  SELECT g AS epoch, node, CASE event_type WHEN 'view' THEN 'OP' ELSE 'PW' END AS module, op AS type,
    CASE event_type WHEN 'purchase' THEN k % 5 END AS n_phases, hops,
    CASE event_type WHEN 'purchase' THEN CAST(k AS BIGINT) END AS gon, CASE event_type WHEN 'purchase' THEN CAST(k + 1 AS BIGINT) END AS ron,
    CASE event_type WHEN 'purchase' THEN CAST(k + 2 AS BIGINT) END AS con, CASE event_type WHEN 'purchase' THEN round(value, 2) END AS all_rdc,
    CASE event_type WHEN 'purchase' THEN k / 10.0::DOUBLE END AS rdc, time
  FROM ops WHERE event_type IN ('view', 'purchase'))"""


@query("energy_format", f"WITH {_ENERGY_SQL} SELECT * FROM energy")
def energy_format(spark, sf):
    return _energy(spark, sf)


@query("energy_by_hops", f"""
WITH {_ENERGY_SQL},
last AS (SELECT hops, node, all_rdc, row_number() OVER (PARTITION BY hops, node ORDER BY time DESC) AS rn
  FROM energy WHERE all_rdc IS NOT NULL AND hops BETWEEN 1 AND 5)
SELECT hops, round(avg(all_rdc), 6) AS rdc FROM last WHERE rn = 1 GROUP BY hops""")
def energy_by_hops(spark, sf):
    return metrics.energy_by_hops(_energy(spark, sf)).select("hops", r6("rdc"))


@query("energy_by_node_hops", f"""
WITH {_NODE_SQL},
pow AS (SELECT node, avg(value) AS all_rdc FROM plog GROUP BY node)
SELECT n.hops, round(avg(p.all_rdc), 6) AS rdc FROM pow p JOIN node_fmt n USING (node) WHERE n.hops BETWEEN 1 AND 5 GROUP BY n.hops""")
def energy_by_node_hops(spark, sf):
    rows = V.plog(spark, sf).select("node", F.col("value").alias("all_rdc"), (F.col("k") / 10).alias("rdc"))
    power = formats.format_energy(rows)
    return metrics.energy_by_hops(power, formats.format_node(_nodes(spark, sf))).select("hops", r6("rdc"))


@query("energy_by_packet_hops", f"""
WITH {V.PACKETS},
pow AS (SELECT node, avg(value) AS all_rdc FROM plog GROUP BY node),
far AS (SELECT node, hops FROM (SELECT node, hops, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, hops) AS rn
  FROM packets WHERE node <> 1 GROUP BY node, hops) WHERE rn = 1)
SELECT far.hops, round(avg(all_rdc), 6) AS rdc FROM pow JOIN far USING (node) WHERE far.hops BETWEEN 1 AND 5 GROUP BY far.hops""")
def energy_by_packet_hops(spark, sf):
    rows = V.plog(spark, sf).select("node", F.col("value").alias("all_rdc"), F.col("value").alias("rdc"))
    nodes = metrics.hops_of_nodes(sdn_packets(spark, sf))
    return metrics.energy_by_hops(formats.format_energy(rows), nodes).select("hops", r6("rdc"))


# --- delivery ---------------------------------------------------------------

_PDR = "round(100.0::DOUBLE * (1 - count(*) FILTER (received = 'missed') / count(*)::DOUBLE), 6) AS pdr"


@query("pdr_by_hops", f"""
WITH {V.PACKETS}
SELECT hops, count(*) AS total, count(*) FILTER (received = 'missed') AS missed, {_PDR}
FROM packets WHERE type IN ('FTQ', 'FTS', 'NSU') GROUP BY hops""")
def pdr_by_hops(spark, sf):
    return metrics.pdr_by_hops(sdn_packets(spark, sf), CONTROL).withColumn("pdr", F.round("pdr", 6))


@query("pdr_by_hops_op", f"""
WITH {V.OPS}
SELECT hops, count(*) AS total, count(*) FILTER (drpd) AS missed,
  round(100.0::DOUBLE * (1 - count(*) FILTER (drpd) / count(*)::DOUBLE), 6) AS pdr
FROM op_fmt WHERE type IN ('CONF', 'CLCT') GROUP BY hops""")
def pdr_by_hops_op(spark, sf):
    return metrics.pdr_by_hops(_ops(spark, sf), ["CONF", "CLCT"]).withColumn("pdr", F.round("pdr", 6))


@query("pdr_by_type", f"""
WITH {V.PACKETS}
SELECT type, count(*) AS total, count(*) FILTER (received = 'missed') AS missed, {_PDR}
FROM packets WHERE type IN ('FTQ', 'DATA') GROUP BY type""")
def pdr_by_type(spark, sf):
    return metrics.pdr_by_type(sdn_packets(spark, sf), ["FTQ", "DATA"]).withColumn("pdr", F.round("pdr", 6))


@query("pdr_total", f"""
WITH {V.PACKETS}
SELECT count(*) AS total, count(*) FILTER (received LIKE '%correct%') AS received,
  count(*) FILTER (received = 'missed') AS missed, {_PDR} FROM packets""")
def pdr_total(spark, sf):
    return metrics.pdr_total(sdn_packets(spark, sf)).withColumn("pdr", F.round("pdr", 6))


@query("pdr_testbed", f"""
WITH {V.PACKETS_TB}, c AS (
  SELECT count(*) FILTER ("TX" = 1) AS sent, count(*) FILTER ("RX" = 1) AS received,
    count(*) FILTER ("TX" = 0 AND "RX" = 1) AS superfluous FROM packets)
SELECT *, round((received - superfluous) / sent::DOUBLE * 100, 6) AS pdr FROM c""")
def pdr_testbed(spark, sf):
    return metrics.pdr_testbed(testbed_packets(spark, sf)).withColumn("pdr", F.round("pdr", 6))


# --- latency ----------------------------------------------------------------

@query("latency_by_hops", f"""
WITH {V.PACKETS}
SELECT hops, round(avg(lat), 6) AS lat FROM packets
WHERE received = 'correct' AND type IN ('FTQ', 'FTS', 'NSU') GROUP BY hops""")
def latency_by_hops(spark, sf):
    return metrics.latency_by_hops(sdn_packets(spark, sf), CONTROL).select("hops", r6("lat"))


@query("latency_preagg", f"""
WITH {V.PACKETS},
sums AS (SELECT id, hops, sum(lat) AS lat FROM packets
  WHERE received = 'correct' AND type IN ('FTQ', 'FTS', 'REQUEST', 'OPEN_PATH') GROUP BY id, hops)
SELECT hops, round(avg(lat), 6) AS lat FROM sums GROUP BY hops""")
def latency_preagg(spark, sf):
    return metrics.latency_by_hops(sdn_packets(spark, sf), PAIRS, ["id"], {"lat": "sum"}).select("hops", r6("lat"))


@query("latency_preagg_named", f"""
WITH {V.PACKETS},
each AS (SELECT id, hops, avg(lat) AS mean, min(lat) AS min, max(lat) AS max, median(lat) AS median, count(lat)::DOUBLE AS count FROM packets
  WHERE received = 'correct' AND type IN ('FTQ', 'FTS', 'REQUEST', 'OPEN_PATH') GROUP BY id, hops),
long AS (UNPIVOT each ON mean, min, max, median, count INTO NAME fn VALUE lat)
SELECT fn, hops, round(avg(lat), 6) AS lat FROM long GROUP BY fn, hops""")
def latency_preagg_named(spark, sf):
    """Each aggregate a configuration may name; the packets are worked out once."""
    packets = settle(metrics.delivered(sdn_packets(spark, sf), PAIRS))
    parts = [metrics.latency_by_hops(packets, PAIRS, ["id"], {"lat": fn}).select(F.lit(fn).alias("fn"), "hops", r6("lat"))
             for fn in ("mean", "min", "max", "median", "count")]
    return reduce(DataFrame.unionByName, parts)


_BETWEEN = V.PACKETS + """,
trips AS (
  SELECT *, count(*) OVER w AS n, (max(maxtime_us) OVER w - min(mintime_us) OVER w) / 1000.0::DOUBLE AS trip
  FROM packets WHERE received = 'correct' AND type IN ('FTQ', 'FTS', 'REQUEST', 'OPEN_PATH') WINDOW w AS (PARTITION BY id))"""


@query("latency_between", f"WITH {_BETWEEN} SELECT hops, round(avg(trip), 6) AS lat FROM trips WHERE n > 1 GROUP BY hops")
def latency_between(spark, sf):
    return metrics.latency_by_hops(sdn_packets(spark, sf), PAIRS, ["id"], "between").select("hops", r6("lat"))


@query("round_trips", f"WITH {_BETWEEN} SELECT packet, id, hops, round(trip, 6) AS lat FROM trips WHERE n > 1")
def round_trips_query(spark, sf):
    done = settle(metrics.delivered(sdn_packets(spark, sf), PAIRS))  # read twice
    return round_trips(done).select("packet", "id", "hops", r6("lat"))


@query("latency_fill", f"""
WITH {V.PACKETS},
m AS (SELECT hops, avg(lat) AS lat FROM packets WHERE received = 'correct' AND type = 'DATA' AND hops <> 5 GROUP BY hops)
SELECT hops, round(lat, 6) AS lat FROM m UNION ALL SELECT 5, round(avg(lat), 6) FROM m""")
def latency_fill(spark, sf):
    packets = sdn_packets(spark, sf).where(F.col("hops") != 5)
    return metrics.latency_by_hops(packets, ["DATA"], fill_hop=5).select("hops", r6("lat"))


@query("latency_total", f"""
WITH {V.PACKETS}
SELECT '30' AS x, round(avg(lat), 6) AS lat FROM packets WHERE received = 'correct' AND type IN ('FTQ', 'FTS', 'NSU')""")
def latency_total(spark, sf):
    return metrics.latency_total(sdn_packets(spark, sf), CONTROL, "30").select("x", r6("lat"))


@query("latency_testbed", f"""
WITH {V.PACKETS_TB}
SELECT round(avg(lat) FILTER ("TX" = 1 AND "RX" = 1), 2) AS paired_lat, round(avg(lat), 2) AS mean_lat,
  round(avg(lat) FILTER (received LIKE '%correct%'), 2) AS delivered_lat FROM packets""")
def latency_testbed(spark, sf):
    s = metrics.latency_testbed(testbed_packets(spark, sf))
    return s.select(*[F.round(c, 2).alias(c) for c in ("paired_lat", "mean_lat", "delivered_lat")])


@query("latency_by_rtx", f"""
WITH {V.PACKETS_TB}
SELECT "RTX", round(avg(lat), 2) AS lat FROM packets WHERE "TX" = 1 AND "RX" = 1 GROUP BY "RTX" """)
def latency_by_rtx(spark, sf):
    return metrics.latency_by_retransmissions(testbed_packets(spark, sf)).select("RTX", F.round("lat", 2).alias("lat"))


# --- association, traffic ---------------------------------------------------

def _joins(spark, sf):
    p, kind = V.plog(spark, sf), F.col("event_type")
    rows = p.select(
        "time", "node", F.lit("STAT").alias("level"), F.lit("RPL").alias("module"),
        F.when(F.col("k") % 3 > 0, F.col("k")).alias("id"), F.when(kind == "click", 1).alias("dag"),
        F.when(kind.isin("view", "click"), 1).alias("dao"), F.when(kind == "purchase", 1).alias("controller"))
    return formats.format_join(rows)


_ASSOC = V.PLOG + """,
joins AS (SELECT time, CASE WHEN k % 3 > 0 THEN k ELSE node END AS id, event_type FROM plog),
assoc AS (
  SELECT 'dag' AS type, id, time / 1e6 AS time FROM joins WHERE event_type = 'click'
  UNION ALL SELECT 'dao', id, time / 1e6 FROM joins WHERE event_type IN ('view', 'click')
  UNION ALL SELECT 'controller', id, time / 1e6 FROM joins WHERE event_type = 'purchase')"""


@query("assoc_unpivot", f"WITH {_ASSOC} SELECT type, id, round(time, 6) AS time FROM assoc")
def assoc_unpivot(spark, sf):
    return _joins(spark, sf).select("type", "id", r6("time"))


@query("assoc_stats", f"""
WITH {_ASSOC}, o AS (SELECT type, time - 1704000000 AS time FROM assoc)
SELECT type, round(avg(time), 4) AS mean, round(stddev_pop(time), 4) AS std_dev, round(median(time), 4) AS median,
  round(max(time), 4) AS max FROM o WHERE type IN ('dag', 'dao') GROUP BY type""")
def assoc_stats(spark, sf):
    times = metrics.association_times(_joins(spark, sf), ["dag", "dao"])
    times = times.withColumn("time", F.col("time") - F.lit(1704000000.0))
    s = metrics.association_stats(times, ["type"])
    return s.select("type", *[F.round(c, 4).alias(c) for c in ("mean", "std_dev", "median", "max")])


@query("assoc_stats_op", f"""
WITH {V.OPS}
SELECT round(avg(lat / 1000.0::DOUBLE), 6) AS mean, round(stddev_pop(lat / 1000.0::DOUBLE), 6) AS std_dev,
  round(median(lat / 1000.0::DOUBLE), 6) AS median, max(lat / 1000.0::DOUBLE) AS max FROM op_fmt WHERE type = 'ASSC'""")
def assoc_stats_op(spark, sf):
    # read several times from here on: parsed once, then kept
    s = metrics.association_stats(settle(metrics.association_times(_ops(spark, sf), ["ASSC"])))
    return s.select(r6("mean"), r6("std_dev"), r6("median"), "max")


@query("traffic_ratio", f"""
WITH {V.PLOG}, c AS (SELECT count(*) FILTER (event_type <> 'error') AS control, count(*) FILTER (event_type = 'error') AS routing FROM plog)
SELECT *, round(control / routing::DOUBLE, 6) AS ratio FROM c""")
def traffic_ratio(spark, sf):
    p = V.plog(spark, sf)
    return metrics.traffic_ratio(p.where("event_type <> 'error'"), p.where("event_type = 'error'")).select(
        "control", "routing", r6("ratio"))


@query("lines_to_pdr", f"""
WITH {V.PACKETS}
SELECT hops, count(*) AS total, count(*) FILTER (received = 'missed') AS missed, {_PDR}
FROM packets WHERE type IN ('FTQ', 'FTS', 'NSU') AND hops BETWEEN 1 AND 5 GROUP BY hops""")
def pdr_by_hops_from_lines(spark, sf):
    """Lines, packets, the hop filter on whole packets, delivery by hops."""
    lines = V.plog(spark, sf).select(V.sdn_line().alias("value"))
    built = build_tables(lines, ["sdn"], {"sdn": [{"filter": {"col": "hops", "min": 1, "max": 5}}]})
    return metrics.pdr_by_hops(built["sdn"], CONTROL).withColumn("pdr", F.round("pdr", 6))
