"""One scan that stores the rows of several patterns and, beside them, the lines that gave no or no whole row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshtally.sources.logs import route, routed_table

# The folder of lines that no pattern matches.
NOTHING = "none"


@dataclass(frozen=True)
class Scrape:
    """Typed tables by pattern, rejected lines, and counts from the same pass.

    ``rejects``: the columns that came with the lines, ``value``, ``pattern`` (NULL where none matched) and
    ``failed``, the fields whose text is no value of their type.
    """

    tables: Mapping[str, DataFrame]
    rejects: DataFrame
    lines: int
    matches: Mapping[str, int]
    unmatched: int
    failed: Mapping[str, int]


def scrape_checked(lines: DataFrame, names: Sequence[str], path: str, value: str = "value") -> Scrape:
    """Read the log once: typed rows per pattern and rejected lines go to ``path``, counts are observed on the way.

    A matched field that does not fit its type reads as NULL in the table; its line is a reject as well. Columns
    of ``lines`` other than ``value`` pass through, but for names that a pattern has as a field.
    """
    if NOTHING in names:
        raise ValueError(f"a pattern may not be called {NOTHING}")
    seen, kept = Observation(), Observation()
    counted = lines.observe(seen, F.count(F.lit(1)).alias("lines"))
    rows = route(counted, names, value, rejects=NOTHING)
    fields = [f for f, t in rows.dtypes if t != "string" and f not in lines.columns and f not in ("pattern", "failed")]
    rows = rows.observe(
        kept, *[F.count_if(F.col("pattern") == n).alias(f"m_{i}") for i, n in enumerate([*names, NOTHING])],
        *[F.count_if(F.array_contains("failed", f)).alias(f"f_{i}") for i, f in enumerate(fields)])
    rows.write.mode("overwrite").partitionBy("pattern").parquet(path)
    stored = lines.sparkSession.read.schema(rows.schema).parquet(path)
    got = kept.get
    own = [c for c in lines.columns if c in stored.columns and c != value]
    rejects = stored.where(F.col("line").isNotNull()).select(
        *own, F.col("line").alias(value), F.nullif("pattern", F.lit(NOTHING)).alias("pattern"), "failed")
    return Scrape(
        {n: routed_table(stored.drop("line", "failed"), n, names) for n in names}, rejects, seen.get["lines"],
        {n: got[f"m_{i}"] for i, n in enumerate(names)}, got[f"m_{len(names)}"],
        {f: got[f"f_{i}"] for i, f in enumerate(fields)})
