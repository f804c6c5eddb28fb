"""Configured merge and filter steps between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Join kinds a configuration may name.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: DataFrame, right: DataFrame, left_on: str | Sequence[str], right_on: str | Sequence[str],
          how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join. Same-named keys become one column; other clashing names get ``_x`` and ``_y``.

    With ``null_safe`` a NULL key meets a NULL key. The planner picks the join
    from the sizes of the sides, at run time too.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}; known: {sorted(JOIN_KINDS)}")
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    shared = [a for a, b in zip(lk, rk) if a == b]
    clash = (set(left.columns) & set(right.columns)) - set(shared)
    ln = {c: f"{c}_x" if c in clash else c for c in left.columns}
    rn = {c: f"_r_{c}" if c in shared else f"{c}_y" if c in clash else c for c in right.columns}
    a, b = left.withColumnsRenamed(ln), right.withColumnsRenamed(rn)
    on = [F.col(ln[x]).eqNullSafe(F.col(rn[y])) if null_safe else F.col(ln[x]) == F.col(rn[y])
          for x, y in zip(lk, rk)]
    joined = a.join(b, on, JOIN_KINDS[how])
    columns = [
        F.coalesce(c, f"_r_{c}").alias(c) if c in shared and how in ("right", "outer") else F.col(ln[c])
        for c in left.columns]
    return joined.select(*columns, *[F.col(rn[c]) for c in right.columns if c not in shared])


def keep_range(df: DataFrame, col: str, min: float, max: float) -> DataFrame:
    """Rows with ``col`` between both ends; NULL is outside."""
    return df.where(F.col(col).between(min, max))


def process(tables: Mapping[str, DataFrame], steps: Mapping[str, Sequence[Mapping]]) -> dict[str, DataFrame]:
    """Run each table's steps in order; later steps see earlier results.

    A step holds ``merge: {df, left_on, right_on, how}``, ``filter: {col, min,
    max}`` or both, merge first. Tables that are not there are skipped.
    """
    out = dict(tables)
    for name, todo in steps.items():
        if name not in out:
            continue
        for step in todo or []:
            df = out[name]
            if "merge" in step:
                m = dict(step["merge"])
                df = merge(df, out[m.pop("df")], **m)
            if "filter" in step:
                df = keep_range(df, **step["filter"])
            out[name] = df
    return out
