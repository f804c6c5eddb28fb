"""Generic table operations with their usual notebook meaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshtally.operators.ranks import join_on, numbered


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def to_number(df: DataFrame, column: str, sql_type: str = "double", coerce: bool = False) -> DataFrame:
    """Strict conversion fails on bad text; with ``coerce`` it becomes NULL."""
    c = F.col(column)
    return df.withColumn(column, c.try_cast(sql_type) if coerce else c.cast(sql_type))


def in_list(df: DataFrame, column: str, values: Sequence, keep: bool = True) -> DataFrame:
    """Rows whose value is in the list, or not in it (NULL is in no list)."""
    hit = F.col(column).isin(list(values))
    return df.where(hit) if keep else df.where(~F.coalesce(hit, F.lit(False)))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def last_name_part(df: DataFrame, sep: str = ".") -> DataFrame:
    return df.toDF(*[c.split(sep)[-1] for c in df.columns])


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows per group; the limit is applied before the shuffle as well."""
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def where_keys(df: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Rows with the given value on each level."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def tidy_text(df: DataFrame) -> DataFrame:
    """Trim every text column; empty text becomes NULL."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c, t in df.dtypes if t == "string"})


def replace_everywhere(df: DataFrame, pattern: str, replacement: str = "",
                       columns: Sequence[str] | None = None) -> DataFrame:
    """Regex replace in every text column, or in those listed."""
    return df.withColumns({c: F.regexp_replace(c, pattern, replacement) for c, t in df.dtypes
                           if t == "string" and (columns is None or c in columns)})


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence,
               prefix: str = "") -> DataFrame:
    """Mean of ``value`` per index and listed column value, flat column names."""
    wide = df.dropna(subset=list(index)).groupBy(*index).pivot(column, list(values)).agg(F.avg(value))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def set_where(df: DataFrame, condition: Column, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def add_columns(df: DataFrame, a: str, b: str, out: str, sep: str = "") -> DataFrame:
    """Two columns as one text; NULL if either is."""
    return df.withColumn(out, F.concat(F.col(a).cast("string"), F.lit(sep), F.col(b).cast("string")))


def null_safe_sum(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """a + b with 0 for a missing a."""
    return df.withColumn(out, F.coalesce(F.col(a), F.lit(0)) + F.col(b))


def split_in_two(df: DataFrame, column: str, sep: str, first: str, second: str) -> DataFrame:
    """Split at the first separator only."""
    at = F.locate(sep, F.col(column))
    return df.withColumns({
        first: F.when(at > 0, F.substr(column, F.lit(1), at - 1)).otherwise(F.col(column)),
        second: F.when(at > 0, F.substr(column, at + len(sep))),
    })


def from_map(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per map entry."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose keys occur more than once.

    Counts and a semi-join: unlike a window it does not bring a key that holds
    a large share of the rows into one task.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    return join_on(df, repeated, list(keys), "left_semi")


def search_rows(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Rows holding every text as the whole value of some column."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    for t in texts:
        df = df.where(F.array_contains(cells, t))
    return df


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def occurrence_matrix(df: DataFrame, column: str, values: Sequence, value: str, order: str, tie: str) -> DataFrame:
    """(occurrence, one column per listed value): the n-th row of each value side by side."""
    rows = df.where(F.col(column).isin(list(values)))
    at = numbered(rows, [column], order, tie, "occurrence")
    return at.groupBy("occurrence").pivot(column, list(values)).agg(F.first(value))
