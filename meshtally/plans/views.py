"""The test tables seen as experiment logs, for Spark and as SQL text.

``events`` are node events: four make one packet, two packets one exchange.
``lineitem`` with ``orders`` is a larger testbed log: one order is one packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the fields of an sdn line.

    The clock ticks in ms and values come in quarters: sums of either are exact
    in any order.
    """
    e = table(spark, sf_dir, "events")
    g = F.expr("event_id div 8")
    even = F.col("pkt") % 2 == 0
    far = (F.col("g") % 150).cast("int")
    kind = F.col("g") % 4
    return (
        e.select(
            "event_id", F.expr("event_id div 4").alias("pkt"), g.alias("g"),
            (F.unix_millis(F.col("ts").cast("timestamp")) * 1000).alias("time"),
            F.col("user_id").cast("int").alias("node"), "event_type",
            (F.floor(F.col("value") * 4) / 4.0).alias("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"))
        .select(
            "*",
            F.when(F.col("event_type").isin("click", "signup"), "OUT")
            .when(F.col("event_type").isin("view", "purchase"), "IN").otherwise("BUF").alias("state"),
            F.when(kind == 0, F.when(even, "FTQ").otherwise("FTS")).when(kind == 1, "NSU")
            .when(kind == 2, F.when(even, "REQUEST").otherwise("OPEN_PATH")).otherwise("DATA").alias("type"),
            F.when(even, far).otherwise(F.lit(1)).alias("src"),
            F.when(even, F.lit(1)).otherwise(far).alias("dest"),
            F.col("g").alias("seq"), (F.col("g") % 13).cast("int").alias("origin"),
            (F.col("k") % 7).alias("hops"))
    )


PLOG = """
e AS (
  SELECT event_id, event_id // 4 AS pkt, event_id // 8 AS g, epoch_us(ts) // 1000 * 1000 AS time,
         CAST(user_id AS INTEGER) AS node, event_type, floor(value * 4) / 4 AS value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
plog AS (
  SELECT *,
    CASE WHEN event_type IN ('click', 'signup') THEN 'OUT'
         WHEN event_type IN ('view', 'purchase') THEN 'IN' ELSE 'BUF' END AS state,
    CASE WHEN g % 4 = 0 THEN CASE WHEN pkt % 2 = 0 THEN 'FTQ' ELSE 'FTS' END
         WHEN g % 4 = 1 THEN 'NSU'
         WHEN g % 4 = 2 THEN CASE WHEN pkt % 2 = 0 THEN 'REQUEST' ELSE 'OPEN_PATH' END
         ELSE 'DATA' END AS type,
    CAST(CASE WHEN pkt % 2 = 0 THEN g % 150 ELSE 1 END AS INTEGER) AS src,
    CAST(CASE WHEN pkt % 2 = 0 THEN 1 ELSE g % 150 END AS INTEGER) AS dest,
    g AS seq, CAST(g % 13 AS INTEGER) AS origin, CAST(k % 7 AS INTEGER) AS hops
  FROM e)"""

# packet and exchange keys; OPEN_PATH and REQUEST know their origin only from src
KEYED = PLOG + """,
keyed AS (
  SELECT time, node, type, src, dest, seq, hops, src AS origin, 1 AS target,
    CASE state WHEN 'OUT' THEN 'TX' WHEN 'IN' THEN 'RX' ELSE state END AS state,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', type, dest, src, seq)
              WHEN 'REQUEST' THEN concat_ws('_', type, src, src, seq)
              WHEN 'FTS' THEN concat_ws('_', type, dest, seq)
              ELSE concat_ws('_', type, src, dest, seq) END AS packet,
    CASE type WHEN 'OPEN_PATH' THEN concat_ws('_', dest, src, seq)
              WHEN 'REQUEST' THEN concat_ws('_', src, src, seq)
              WHEN 'FTS' THEN concat_ws('_', dest, seq)
              ELSE concat_ws('_', src, seq) END AS id
  FROM plog)"""

_STATUS = """CASE WHEN "RX" = 0 THEN 'missed' WHEN "TX" > 1 THEN 'correct'
              WHEN "RX" > 1 THEN 'superfluous' ELSE 'correct' END"""


def packets_sql(keyed: str) -> str:
    """Reconciliation written with filtered counts and ranked value counts."""
    ranked = ",\n".join(
        f"""mode_{c} AS (
  SELECT packet, {c} FROM (
    SELECT packet, {c}, row_number() OVER (PARTITION BY packet ORDER BY count(*) DESC, {c}) AS rn
    FROM {keyed} WHERE {c} IS NOT NULL GROUP BY packet, {c}) WHERE rn = 1)"""
        for c in ("type", "id", "src", "dest", "seq", "origin", "target"))
    joins = " ".join(f"LEFT JOIN mode_{c} USING (packet)"
                     for c in ("type", "id", "src", "dest", "seq", "origin", "target"))
    return f"""
counted AS (
  SELECT packet,
    count(*) FILTER (state = 'TX') AS "TX", count(*) FILTER (state = 'RX') AS "RX",
    count(*) FILTER (state = 'RTR') AS "RTX", count(*) FILTER (state = 'FWD') AS "FWD",
    max(hops) AS hops, min(time) AS mintime_us, max(time) AS maxtime_us
  FROM {keyed} GROUP BY packet),
{ranked},
packets AS (
  SELECT packet, "TX", "RX", "RTX", "FWD", {_STATUS} AS received, src AS node, type, id, src, dest, seq,
    origin, target, hops,
    CASE WHEN {_STATUS} = 'correct' THEN (maxtime_us - mintime_us) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS lat,
    mintime_us, maxtime_us
  FROM counted {joins})"""


PACKETS = KEYED + "," + packets_sql("keyed")


def sdn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed sdn rows, as parsing would give them."""
    return plog(spark, sf_dir).select(
        "time", "node", "state", "type", "src", "dest", "seq", "hops")


def line(*parts) -> Column:
    """One text line; a part is text as it is, or a column."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sdn_line() -> Column:
    c = F.col
    return line(c("time"), ": ", c("node"), ": [STAT: SDN ] ", c("state"), " ", c("type"), " s:", c("src"),
                " d:", c("dest"), " a:2 id:", c("seq"), " h:", c("hops"), " m:0")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testbed events: packet, type (state), epoch, src, id, time, node, hops, kind, value."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(od, li["l_orderkey"] == od["o_orderkey"]).select(
        F.col("l_orderkey").cast("string").alias("packet"),
        F.when(F.col("l_returnflag") == "A", "TX").when(F.col("l_returnflag") == "N", "RX")
        .otherwise("RTR").alias("type"),
        F.col("l_linenumber").cast("bigint").alias("epoch"), F.col("l_suppkey").cast("int").alias("src"),
        F.col("l_partkey").alias("id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("time"),
        F.col("l_linenumber").alias("node"), F.col("o_orderpriority").alias("kind"),
        F.col("l_extendedprice").alias("value"))


SHIPMENTS = """
shipments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS packet,
    CASE l_returnflag WHEN 'A' THEN 'TX' WHEN 'N' THEN 'RX' ELSE 'RTR' END AS type,
    CAST(l_linenumber AS BIGINT) AS epoch, CAST(l_suppkey AS INTEGER) AS src, l_partkey AS id,
    epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS time, l_linenumber AS node, o_orderpriority AS kind, l_extendedprice AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_STATUS_TB = """CASE WHEN "TX" = 1 AND "RX" = 0 THEN 'missed' WHEN "TX" = 0 AND "RX" = 1 THEN 'superfluous'
  ELSE 'correct' END || CASE WHEN "RTX" > 0 THEN ' - RTX' ELSE '' END"""

_TB_MODES = ",\n".join(
    f"""mode_{c} AS (
  SELECT packet, {c} FROM (
    SELECT packet, {c}, row_number() OVER (PARTITION BY packet ORDER BY count(*) DESC, {c}) AS rn
    FROM shipments WHERE {c} IS NOT NULL GROUP BY packet, {c}) WHERE rn = 1)"""
    for c in ("epoch", "src", "id"))

PACKETS_TB = SHIPMENTS + f""",
counted AS (
  SELECT packet,
    count(*) FILTER (type = 'TX') AS "TX", count(*) FILTER (type = 'RX') AS "RX",
    count(*) FILTER (type = 'RTR') AS "RTX", count(*) FILTER (type = 'FWD') AS "FWD",
    min(time) AS first_us, max(time) AS last_us
  FROM shipments GROUP BY packet),
{_TB_MODES},
packets AS (
  SELECT packet, "TX", "RX", "RTX", "FWD", epoch, src, id, {_STATUS_TB} AS received,
    CASE WHEN {_STATUS_TB} LIKE '%correct%' THEN (last_us - first_us) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS lat
  FROM counted LEFT JOIN mode_epoch USING (packet) LEFT JOIN mode_src USING (packet) LEFT JOIN mode_id USING (packet))"""


def op_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation, power and other lines, one per event: value, event_id."""
    p = plog(spark, sf_dir)
    kind = F.col("event_type")
    op = F.element_at(F.array(*[F.lit(x) for x in ("CONF", "CLCT", "RACT", "ASSC")]), (F.col("g") % 4 + 1).cast("int"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    p = p.withColumns({"op": op, "cents": cents, "dur": F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("k"))})
    c, e = F.col, F.expr
    power = line(e("cents div 100"), ".", F.lpad((c("cents") % 100).cast("string"), 2, "0"),
                 " / ", e("k div 10"), ".-", c("k") % 10)
    head = line(c("time"), ": ", c("node"), ": ")
    return p.select(
        F.when(kind == "view", line(
            head, "INFO: OP ep:", c("g"), " ", c("op"), " h:", c("hops"), " cp: ", c("k") % 3, " tp: ", c("k") % 5,
            " dur: ", c("dur"), " tdur: ", c("k") * 3, " an:", c("k") % 2))
        .when(kind == "purchase", line(
            head, "INFO: PW ep:", c("g"), " ", c("op"), " h:", c("hops"), " np:", c("k") % 5, " gon:", c("k"),
            " ron:", c("k") + 1, " con:", c("k") + 2, " (r ", power))
        .when(kind == "click", line(head, "[STAT: RPL] h:", c("hops"), ", n:", c("k") % 9))
        .when(kind == "signup", line(head, "[STAT: POW] PW (r ", power))
        .otherwise(line(head, "[STAT: ICMP]  type:", c("k"), " code:", c("hops")))
        .alias("value"), "event_id")


OPS = PLOG + """,
ops AS (
  SELECT *, CASE g % 4 WHEN 0 THEN 'CONF' WHEN 1 THEN 'CLCT' WHEN 2 THEN 'RACT' ELSE 'ASSC' END AS op,
    CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS dur FROM plog),
op_fmt AS (
  SELECT g AS epoch, node, 'OP' AS module, op AS type, hops, k % 3 AS c_phase, k % 5 AS n_phases,
    CAST(dur AS BIGINT) AS lat, CAST(k * 3 AS BIGINT) AS op_duration,
    CASE WHEN op = 'CONF' THEN 1 ELSE k % 2 END AS active,
    (k % 2 = 1 AND dur = 0) AS drpd, CASE WHEN k % 2 = 1 AND dur = 0 THEN 'missed' ELSE 'correct' END AS received
  FROM ops WHERE event_type = 'view')"""

# Event type -> run name of the comparison queries.
RUNS = {"click": "sim-30-a", "signup": "sim-30-b", "view": "sim-20-a", "purchase": "sim-10-a", "error": "control"}


def run_name() -> Column:
    name = F.lit(None).cast("string")
    for kind, run in RUNS.items():
        name = F.when(F.col("event_type") == kind, run).otherwise(name)
    return name


RUN_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in RUNS.items()) + " END"
