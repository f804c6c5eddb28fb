"""Queries on line numbers, stored layouts, folders that grow, rejected lines and keys that are used again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.operators import formats, runs, sketches
from meshtally.operators.process import merge
from meshtally.operators.ranks import last_value, numbered
from meshtally.operators.reconcile import reconcile, reconcile_stored, round_trips, store_events
from meshtally.operators.sessions import part_reused
from meshtally.plans import views as V
from meshtally.plans.catalog import query
from meshtally.plans.queries_logs import _packet_columns, r6, sdn_packets
from meshtally.session import scratch_dir, settle
from meshtally.sources import logs
from meshtally.sources.buckets import save_bucketed
from meshtally.sources.growing import GrowingLogs
from meshtally.sources.numbered import read_numbered
from meshtally.sources.rejects import scrape_checked

LINES = 20_000  # of one file


def _fresh(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


# --- true line numbers -------------------------------------------------------

def _numbered(spark, sf):
    """The events' lines in files of 20,000, in their order, read in splits of 64 KB."""
    path = _fresh(spark, "ordered")
    lines = V.plog(spark, sf).select(F.expr(f"event_id div {LINES}").alias("chunk"), "event_id", V.sdn_line().alias("value"))
    lines.repartition("chunk").sortWithinPartitions("chunk", "event_id").select("chunk", "value").write.partitionBy(
        "chunk").text(path)
    read = read_numbered(spark, path, recursive=True, split_bytes=64 << 10)
    chunk = F.regexp_extract("file", "chunk=([0-9]+)/", 1).cast("bigint")
    return logs.parse(read, "sdn").withColumn("chunk", chunk)


@query("line_numbers", f"""
WITH {V.PLOG}
SELECT event_id // {LINES} AS chunk, row_number() OVER (PARTITION BY event_id // {LINES} ORDER BY event_id) AS line,
  time, node, state, type, seq FROM plog""")
def line_numbers(spark, sf):
    return _numbered(spark, sf).select("chunk", "line", "time", "node", "state", "type", "seq")


@query("last_by_line", f"""
WITH {V.PLOG}
SELECT event_id // {LINES} AS chunk, node, arg_max(state, event_id) AS state FROM plog GROUP BY ALL""")
def last_by_line(spark, sf):
    """The last state of each node in each file, by nothing but the order of its lines."""
    return last_value(_numbered(spark, sf), ["chunk", "node"], "state", ["line"])


# --- tables laid out by packet ----------------------------------------------

@query("stored_packets", f"WITH {V.PACKETS} SELECT * REPLACE (round(lat, 6) AS lat) FROM packets")
def stored_packets(spark, sf):
    """Events stored by packet, reconciled where they lie."""
    fixed = ("type", "id", "seq")
    events = formats.keyed_sdn(V.sdn_rows(spark, sf))
    stored = store_events(events, _table("events"), _fresh(spark, "events"), fixed)
    return _packet_columns(reconcile_stored(stored, fixed))


@query("stored_round_trips", f"""
WITH {V.PACKETS},
spans AS (SELECT id, count(*) AS n, (max(maxtime_us) - min(mintime_us)) / 1000.0::DOUBLE AS trip FROM packets GROUP BY id)
SELECT packet, id, hops, round(trip, 6) AS lat FROM packets JOIN spans USING (id) WHERE n > 1""")
def stored_round_trips(spark, sf):
    """Packets stored by exchange, spans worked out and joined back where they lie."""
    packets = save_bucketed(sdn_packets(spark, sf), _table("packets"), _fresh(spark, "packets"), ["id"])
    return round_trips(packets).select("packet", "id", "hops", r6("lat"))


@query("stored_merge", f"""
WITH {V.PACKETS}
SELECT packet, a.received AS received_x, b.received AS received_y, round(a.lat, 6) AS lat_x
FROM packets a FULL JOIN (SELECT * FROM packets WHERE type <> 'NSU') b USING (packet) WHERE a.hops > 0""")
def stored_merge(spark, sf):
    """Two stored packet tables merged on the packet, bucket by bucket."""
    packets = sdn_packets(spark, sf)
    one = save_bucketed(packets.select("packet", "received", "lat", "hops"), _table("run"), _fresh(spark, "run"), ["packet"])
    two = save_bucketed(packets.where("type <> 'NSU'").select("packet", "received", "lat"), _table("run"),
                        _fresh(spark, "run"), ["packet"])
    return merge(one, two, "packet", "packet", "outer").where("hops > 0").select(
        "packet", "received_x", "received_y", r6("lat_x"))


# --- folders that grow -------------------------------------------------------

def _replace_file(spark, lines, folder: str) -> None:
    """One file in ``folder``, always under the same name."""
    draft = _fresh(spark, "draft")
    lines.coalesce(1).write.text(draft)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(draft).getFileSystem(conf)
    made = [s.getPath() for s in fs.listStatus(hadoop.Path(draft)) if s.getPath().getName().startswith("part-")]
    hadoop.FileUtil.copy(fs, made[0], fs, hadoop.Path(f"{folder}/late.log"), False, True, conf)


def grow(spark, sf, folder: str) -> list:
    """A folder of logs in two states, taken in after each: a file is added, one changes, one node's logs go."""
    lines = V.plog(spark, sf).select("event_id", "event_type", (F.col("node") % 4).alias("part"), V.sdn_line().alias("value"))
    early, many = F.col("event_id") < 500, lines.where("event_id >= 500")
    logs_of = GrowingLogs(spark, folder, _fresh(spark, "known"), lambda text: logs.parse(text, "sdn").drop("line_id"))
    many.where("part < 3").select("part", "value").write.partitionBy("part").text(f"{folder}/a")
    _replace_file(spark, lines.where(early & (F.col("event_type") != "error")).select("value"), folder)
    first = logs_of.refresh()
    many.where("part = 3").select("part", "value").write.partitionBy("part").text(f"{folder}/b")
    _replace_file(spark, lines.where(early).select("value"), folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = hadoop.Path(f"{folder}/a/part=1")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return [logs_of, first, logs_of.refresh()]


@query("growing_logs", f"""
WITH {V.PLOG}
SELECT time, node, state, type, src, dest, seq, hops FROM plog WHERE event_id < 500 OR node % 4 <> 1""")
def growing_logs(spark, sf):
    """The rows after the second refresh."""
    return grow(spark, sf, _fresh(spark, "growing"))[0].rows().select(
        "time", "node", "state", "type", "src", "dest", "seq", "hops")


# --- rejected lines ----------------------------------------------------------

NAMES = ["atomic-op", "atomic-energy", "node", "icmp", "pow"]


def _planted(spark, sf):
    """Operation lines; every 11th is junk, and the time of every 13th has too many digits."""
    return V.op_lines(spark, sf).withColumn(
        "value", F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("~~ "), F.col("value")))
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit("99999999999999999999"), F.col("value")))
        .otherwise(F.col("value")))


_KINDS = """CASE event_type WHEN 'view' THEN ['atomic-op', 'atomic-energy'] WHEN 'purchase' THEN ['atomic-op', 'atomic-energy']
  WHEN 'click' THEN ['node'] WHEN 'signup' THEN ['pow'] ELSE ['icmp'] END"""


@query("scrape_counts", f"""
WITH {V.OPS},
rows AS (SELECT event_id, unnest({_KINDS}) AS pattern FROM ops WHERE event_id % 11 <> 0)
SELECT 'lines' AS what, '' AS name, count(*) AS n FROM ops
UNION ALL SELECT 'matches', pattern, count(*) FROM rows GROUP BY pattern
UNION ALL SELECT 'unmatched', '', count(*) FROM ops WHERE event_id % 11 = 0
UNION ALL SELECT 'failed', 'time', count(*) FROM rows WHERE event_id % 13 = 0""")
def scrape_counts(spark, sf):
    """Counts of lines, matches and failed casts, observed while the rows are stored."""
    s = scrape_checked(_planted(spark, sf), NAMES, _fresh(spark, "checked"))
    found = [("lines", "", s.lines), ("unmatched", "", s.unmatched), *[("matches", p, n) for p, n in s.matches.items()],
             *[("failed", f, n) for f, n in s.failed.items() if n]]
    return spark.createDataFrame(found, "what string, name string, n bigint")


@query("scrape_rejects", f"""
WITH {V.OPS}
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN pattern END AS pattern,
  CASE WHEN event_id % 11 <> 0 THEN 'time' ELSE '' END AS failed
FROM (SELECT event_id, unnest({_KINDS}) AS pattern FROM ops WHERE event_id % 13 = 0 AND event_id % 11 <> 0
  UNION ALL SELECT event_id, '' FROM ops WHERE event_id % 11 = 0)""")
def scrape_rejects(spark, sf):
    rejects = scrape_checked(_planted(spark, sf), NAMES, _fresh(spark, "checked")).rejects
    return rejects.select("event_id", "pattern", F.array_join("failed", ",").alias("failed"))


# --- keys used again ---------------------------------------------------------

GAP_S = 3600


@query("reused_keys", f"""
WITH {V.PLOG.replace("g % 150", "g % 15").replace("g AS seq", "g % 3 AS seq")},
keyed0 AS (
  SELECT time, type, src, dest, seq, hops, src AS origin, 1 AS target,
    CASE state WHEN 'OUT' THEN 'TX' WHEN 'IN' THEN 'RX' ELSE state END AS state,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', type, dest, src, seq) WHEN 'REQUEST' THEN concat_ws('_', type, src, src, seq)
              WHEN 'FTS' THEN concat_ws('_', type, dest, seq) ELSE concat_ws('_', type, src, dest, seq) END AS packet,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', dest, src, seq) WHEN 'REQUEST' THEN concat_ws('_', src, src, seq)
              WHEN 'FTS' THEN concat_ws('_', dest, seq) ELSE concat_ws('_', src, seq) END AS id
  FROM plog),
late AS (SELECT *, coalesce(time - lag(time) OVER (PARTITION BY id ORDER BY time) > {GAP_S}000000, false) AS new FROM keyed0),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY id ORDER BY time) AS session FROM late),
keyed AS (
  SELECT * REPLACE (packet || m AS packet, id || m AS id)
  FROM (SELECT *, CASE WHEN session > 0 THEN '#' || session ELSE '' END AS m FROM numbered)),
{V.packets_sql("keyed")}
SELECT packet, "TX", "RX", received, id, type, seq, hops, round(lat, 6) AS lat FROM packets""")
def reused_keys(spark, sf):
    """Sequence numbers that start over: packets more than an hour apart are different ones."""
    far = (F.col("g") % 15).cast("int")
    even = F.col("pkt") % 2 == 0
    rows = V.plog(spark, sf).withColumns({
        "seq": F.col("g") % 3, "src": F.when(even, far).otherwise(F.lit(1)), "dest": F.when(even, F.lit(1)).otherwise(far),
    }).select("time", "node", "state", "type", "src", "dest", "seq", "hops")
    events = part_reused(formats.keyed_sdn(rows), GAP_S * 1_000_000)
    return reconcile(events).select("packet", "TX", "RX", "received", "id", "type", "seq", "hops", r6("lat"))


# --- stored sketches ---------------------------------------------------------

PROBS = {"p01": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}


@query("sketch_quantiles", f"""
WITH {V.PLOG},
n AS (SELECT {V.RUN_CASE} AS run, count(*) AS n FROM plog GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM plog)
SELECT run, name, n, true AS within FROM n, (VALUES ('p01'), ('q1'), ('med'), ('q3'), ('p99')) AS p(name)""")
def sketch_quantiles(spark, sf):
    """Sketches per run, stored in two saves and merged without the log; their quantiles' true ranks, counted from it."""
    rows = V.plog(spark, sf).select(V.run_name().alias("run"), F.lit("value").alias("metric"), (F.col("value") + F.col("k") / 1000).alias("v"))
    path = _fresh(spark, "sketches")
    for some in (rows.where("run = 'control'"), rows.where("run <> 'control'")):
        sketches.save_sketches(sketches.sketch(some, "v", ["run", "metric"]), path)
    stored = sketches.load_sketches(spark, path)
    every = sketches.merge_sketches(stored, ["metric"]).withColumn("run", F.lit("all"))
    found = settle(sketches.sketched_quantiles(stored.unionByName(every), PROBS, ["run"]))
    both = rows.unionByName(rows.withColumn("run", F.lit("all")))
    # rows per run and value first; the five values of a run meet those
    counts = both.groupBy("run", "v").agg(F.count(F.lit(1)).alias("c"))
    ranks = counts.join(found, "run").groupBy("run", "name", "p", "n", "error").agg(
        (F.coalesce(F.sum(F.when(F.col("v") < F.col("value"), F.col("c"))), F.lit(0)) / F.col("n")).alias("below"),
        (F.coalesce(F.sum(F.when(F.col("v") <= F.col("value"), F.col("c"))), F.lit(0)) / F.col("n")).alias("upto"))
    within = (F.col("p") >= F.col("below") - F.col("error")) & (F.col("p") <= F.col("upto") + F.col("error"))
    return ranks.select("run", "name", "n", within.alias("within"))


# --- grids of any size -------------------------------------------------------

@query("param_grid_large", """
WITH g AS (SELECT max(p_partkey) AS n FROM part),
a AS (SELECT unnest(range(n)) AS x FROM g), b AS (SELECT unnest(range(40)) AS y), c AS (SELECT unnest(range(3)) AS z)
SELECT x % 7 AS x7, count(*) AS n, CAST(sum(x * 1000 + y * 10 + z) AS BIGINT) AS total FROM a, b, c GROUP BY 1""")
def param_grid_large(spark, sf):
    """One row whose lists multiply to a grid that grows with the parts, made by many tasks."""
    one = V.table(spark, sf, "part").agg(F.max("p_partkey").alias("n")).select(
        F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1).alias("x"), F.expr("sequence(0, 39)").alias("y"),
        F.expr("sequence(0, 2)").alias("z"))
    made = runs.grid(one, ["x", "y", "z"])
    total = F.col("params")["x"].cast("bigint") * 1000 + F.col("params")["y"].cast("bigint") * 10 + F.col("params")["z"].cast("bigint")
    return made.groupBy((F.col("x") % 7).alias("x7")).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))


# --- numbers in the order of any type ----------------------------------------

_ORDERS = {
    "text": ("o_orderpriority", "o_orderpriority"),
    "date": ("CAST(o_orderdate AS DATE)", "CAST(o_orderdate AS DATE)"),
    "timestamp": ("o_orderdate", "o_orderdate"),
    "bigint": ("1152921504606846976 - o_custkey", "1152921504606846976 - o_custkey")}


@query("numbered_types", " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, o_orderstatus, o_orderkey,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql}, o_orderkey) - 1 AS pos FROM orders"""
    for kind, (_, sql) in _ORDERS.items()))
def numbered_types(spark, sf):
    """Rows of each group numbered in the order of a text, a date, a time and a number near 2^60."""
    orders = V.table(spark, sf, "orders")
    parts = []
    for kind, (column, _) in _ORDERS.items():
        rows = orders.select("o_orderstatus", "o_orderkey", F.expr(column).alias("at"))
        parts.append(numbered(rows, ["o_orderstatus"], "at", "o_orderkey").select(
            F.lit(kind).alias("kind"), "o_orderstatus", "o_orderkey", "pos"))
    return reduce(DataFrame.unionByName, parts)
