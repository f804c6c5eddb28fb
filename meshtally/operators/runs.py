"""Run catalogue: parameter texts, traffic profiles, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtally.functions.maths import merge_maps, params_text


def flow_text(flows: DataFrame, apps: str = "num_apps", params: str = "flows", out: str = "flow_args") -> DataFrame:
    """Traffic profile as text: the number of applications, then its parameters."""
    head = F.concat(F.lit("NUM_APPS="), F.col(apps).cast("string"))
    return flows.withColumn(out, F.concat_ws(" ", head, params_text(params)))


def catalogue(runs: DataFrame, flows: DataFrame, params: str = "params", flow: str = "flow_id",
              flow_key: str = "flow_id", out: str = "makeargs") -> DataFrame:
    """Runs with their parameters as one text, the traffic profile's appended."""
    profiles = flow_text(flows).select(F.col(flow_key).alias("_flow"), "flow_args")
    return (
        runs.join(profiles, runs[flow] == profiles["_flow"], "left")
        .withColumn(out, F.concat_ws(" ", params_text(params), F.col("flow_args")))
        .drop("_flow", "flow_args")
    )


BLOCK = 10_000  # combinations that a task makes of one row
PIECE = 100  # values of one list that travel together


def _pieces(values: str) -> Column:
    """A list as a list of lists of ``PIECE`` values, the last one shorter."""
    places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int"))
    return F.transform(places, lambda i: F.slice(F.col(values), i * PIECE + 1, F.lit(PIECE)))


def grid(df: DataFrame, values: Sequence[str], out: str = "params") -> DataFrame:
    """Every combination of the row's own value lists, as a map from list name to value.

    Lists are cut in pieces first, so that no block carries a long list whole. The combinations of pieces are numbered and
    their numbers dealt to all tasks in blocks, so the product of one row may be of any size; a number's digits, with the
    pieces' lengths as bases, are the places in them. An empty or NULL list leaves no combination.
    """
    sizes = [F.size(c).cast("bigint") for c in values]
    rows = df.where(reduce(lambda a, b: a & b, [F.coalesce(n, F.lit(0)) > 0 for n in sizes]))
    for c in values:
        rows = rows.withColumn(c, F.explode(_pieces(c)))
    rows = rows.withColumn("_total", reduce(lambda a, b: a * b, sizes))
    start, end = F.lit(0).cast("bigint"), F.col("_total")
    for step in (BLOCK * BLOCK, BLOCK):
        step = F.lit(step).cast("bigint")
        rows = rows.withColumn("_from", F.explode(F.sequence(start, end - 1, step)))
        start, end = F.col("_from"), F.least(F.col("_total"), F.col("_from") + step)
    # dealt in turn: rows of one block must not meet by their equal numbers
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = dealt.withColumn("_i", F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_total"), F.col("_from") + BLOCK) - 1)))
    picked = {}
    for i, c in enumerate(values):
        # the number over the product of the later lists' lengths, modulo this one's
        stride = " * ".join(["1L", *[f"size(`{later}`)" for later in values[i + 1:]]])
        picked[c] = F.get(F.col(c), F.expr(f"CAST((_i div ({stride})) % size(`{c}`) AS INT)"))
    chosen = numbered.withColumns(picked).drop("_total", "_from", "_i")
    return chosen.withColumn(out, F.create_map(*[
        e for c in values for e in (F.lit(c), F.col(c).cast("string"))]))


def grid_of_maps(df: DataFrame, left: str, right: str, out: str = "params") -> DataFrame:
    """Every pair of the row's two lists of maps, merged; the right one wins."""
    pairs = df.withColumn("_l", F.explode(left)).withColumn("_r", F.explode(right))
    return pairs.withColumn(out, merge_maps("_l", "_r")).drop("_l", "_r")


def zip_maps(df: DataFrame, left: str, right: str, out: str = "params") -> DataFrame:
    """Two lists of maps merged position by position, as far as the shorter one goes."""
    both = F.slice(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), 1,
                   F.least(F.size(left), F.size(right)))
    return df.withColumn("_p", F.explode(both)).withColumn(out, merge_maps(F.col("_p.l"), F.col("_p.r"))).drop("_p")


def key_values(df: DataFrame, lists: str, key: str) -> DataFrame:
    """(key, value) for each entry of one list in a map of lists."""
    return df.withColumn("key", F.lit(key)).withColumn("value", F.explode(F.try_element_at(lists, F.lit(key))))
