"""Queries that write the events as files of the kinds experiments leave, and read those."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshtally.operators import formats
from meshtally.plans import views as V
from meshtally.plans.catalog import query
from meshtally.plans.queries_logs import _ASSOC, _testbed_lines, r6
from meshtally.session import scratch_dir
from meshtally.sources import logs, tables


def _text_folders(lines, spark, by: str) -> str:
    """The lines as text files, one folder for each value of ``by``."""
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select(by, "value").write.partitionBy(by).text(path)
    return path


def _folder(by: str):
    return F.regexp_extract("file", f"{by}=([^/]+)/", 1)


@query("read_logs_dir", f"""
WITH {V.PLOG}
SELECT {V.RUN_CASE} AS run, time, node, state, type, src, dest, seq, hops FROM plog""")
def read_logs_dir(spark, sf):
    """A folder of logs per run, read in one scan."""
    lines = V.plog(spark, sf).select(V.run_name().alias("run"), V.sdn_line().alias("value"))
    read = logs.read_logs(spark, _text_folders(lines, spark, "run"), recursive=True).withColumn("run", _folder("run"))
    return logs.parse(read, "sdn").select("run", "time", "node", "state", "type", "src", "dest", "seq", "hops")


@query("lookup_csv", f"""
WITH {V.PLOG}
SELECT time, CAST(k AS BIGINT) AS epoch, CASE state WHEN 'OUT' THEN 'TX' ELSE 'RX' END AS type,
  lpad(lower(printf('%x', pkt)), 16, '0') AS packet, pkt AS id, src, n_nationkey AS node
FROM plog LEFT JOIN nation ON n_name = 'NATION_' || (node % 30)
WHERE event_type <> 'error'""")
def lookup_csv(spark, sf):
    """Testbed logs in a folder per node, node numbers from a CSV."""
    lines = _testbed_lines(spark, sf).withColumn("name", logs.file_stem(F.col("file")))
    names = f"{scratch_dir(spark)}/names-{uuid.uuid4().hex}"
    tables.write_csv(V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), names)
    read = logs.read_logs(spark, _text_folders(lines, spark, "name"), recursive=True).withColumn("file", _folder("name"))
    rows = logs.parse_testbed(read, logs.read_lookup(spark, names))
    return rows.select(F.unix_micros("timestamp").alias("time"), "epoch", "type", "packet", "id", "src", "node")


@query("xml_files", "SELECT s_suppkey, CAST(s_suppkey % 5 + s_nationkey % 3 AS INTEGER) AS n FROM supplier")
def xml_files(spark, sf):
    """A scenario file per supplier, its number of nodes given by the supplier's keys."""
    motes = F.repeat(F.lit("<mote><id>1</id></mote>"), (F.col("s_suppkey") % 5 + F.col("s_nationkey") % 3).cast("int"))
    docs = V.table(spark, sf, "supplier").select("s_suppkey", F.concat(
        F.lit("<simconf><simulation><title>t</title>"), motes, F.lit("</simulation><mote/></simconf>")).alias("value"))
    # the suppliers are few bytes and many files: a task for every share of the files, not of the bytes
    shares = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    read = tables.read_documents(spark, _text_folders(shares, spark, "s_suppkey"))
    return tables.element_count(read).select(_folder("s_suppkey").cast("bigint").alias("s_suppkey"), "n")


# --- line patterns ----------------------------------------------------------

def _tag(name: str, value):
    """`` name:value``, nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f" {name}:"), value.cast("string")), F.lit(""))


def _head(module: str):
    return V.line(F.col("time"), ": ", F.col("node"), f": [STAT: {module} ] ")


@query("parse_app", f"""
WITH {V.PLOG}
SELECT event_id, time, node, 'APP' AS module, CASE state WHEN 'OUT' THEN 'TX' ELSE 'RX' END AS state, type, src, dest, 3 AS app, seq,
  CASE WHEN hops BETWEEN 1 AND 5 THEN hops END AS hops, 1 AS mac FROM plog WHERE state <> 'BUF'""")
def parse_app(spark, sf):
    c = F.col
    lines = V.plog(spark, sf).select("event_id", F.concat(
        _head("APP"), F.when(c("state") == "OUT", "TX").when(c("state") == "IN", "RX").otherwise("BUF"), F.lit(" "), "type",
        _tag("s", c("src")), _tag("d", c("dest")), _tag("a", F.lit(3)), _tag("id", c("seq")), _tag("m", F.lit(1)),
        _tag("h", c("hops"))).alias("value"))
    return logs.parse(lines, "app").select("event_id", "time", "node", "module", "state", "type", "src", "dest", "app", "seq", "hops", "mac")


@query("parse_join", f"WITH {_ASSOC} SELECT type, id, round(time, 6) AS time FROM assoc")
def parse_join(spark, sf):
    """Association lines to one row per kind of association."""
    c, kind = F.col, F.col("event_type")
    lines = V.plog(spark, sf).select(F.concat(
        _head("RPL"), _tag("n", F.when(c("k") % 3 > 0, c("k"))), _tag("c", F.when(kind == "purchase", 1)),
        _tag("dag", F.when(kind == "click", 1)), _tag("dao", F.when(kind.isin("view", "click"), 1))).alias("value"))
    return formats.format_join(logs.parse(lines, "join")).select("type", "id", r6("time"))


@query("parse_all", f"""
WITH {V.PLOG}
SELECT event_id, time, node, CASE state WHEN 'OUT' THEN 'TX' ELSE 'RX' END AS state, type, CASE WHEN g % 3 > 0 THEN origin END AS origin,
  CASE WHEN g % 5 > 0 THEN 1 END AS target, src, dest, seq, CASE WHEN hops < 6 THEN hops END AS hops FROM plog""")
def parse_all(spark, sf):
    lines = _flat_lines(V.plog(spark, sf))
    return logs.parse(lines, "all").select(
        "event_id", "time", "node", "state", "type", "origin", "target", "src", "dest", "seq", "hops")


def _flat_lines(p, *more: str):
    c = F.col
    return p.select("event_id", *more, F.concat(
        _head("SDN"), F.when(c("state") == "OUT", "TX").otherwise("RX"), F.lit(" "), "type",
        _tag("m", F.when(c("seq") % 3 > 0, c("origin"))), _tag("t", F.when(c("seq") % 5 > 0, F.lit(1))),
        _tag("s", c("src")), _tag("d", c("dest")), _tag("id", c("seq")), _tag("h", c("hops"))).alias("value"))


@query("parse_sdn_any", f"""
WITH {V.PLOG}
SELECT event_id, time, node, CASE event_type WHEN 'signup' THEN 'TX' WHEN 'purchase' THEN 'RX' ELSE state END AS state, type, src, dest,
  seq, hops FROM plog""")
def parse_sdn_any(spark, sf):
    kind = F.col("event_type")
    p = V.plog(spark, sf).withColumn("state", F.when(kind == "signup", "TX").when(kind == "purchase", "RX").otherwise(F.col("state")))
    return logs.parse(p.select(V.sdn_line().alias("value"), "event_id"), "sdn-any-state").select(
        "event_id", "time", "node", "state", "type", "src", "dest", "seq", "hops")
