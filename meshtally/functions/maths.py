"""Numeric and text column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal distribution function after Hart (1968) as given by West (2005),
# "Better approximations to cumulative normal functions": relative error near
# 1e-15. Numerator and denominator, highest power first.
CDF_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
    33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207,
    86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)
CDF_NEAR = 7.07106781186547
CDF_FAR = 37.0


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, inside generated code."""
    a = F.abs(z)
    bell = F.exp(-a * a / F.lit(2.0))
    near = bell * _horner(a, CDF_NUMERATOR) / _horner(a, CDF_DENOMINATOR)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    far = bell / tail / F.lit(math.sqrt(2 * math.pi))
    upper = F.when(a > CDF_FAR, F.lit(0.0)).when(a < CDF_NEAR, near).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - upper).otherwise(upper)


def delivery_ratio(sent: Column, dropped: Column) -> Column:
    """(1 - dropped / sent) * 100, NULL when nothing was sent."""
    return (F.lit(1.0) - F.try_divide(dropped.cast("double"), sent.cast("double"))) * F.lit(100.0)


def receive_ratio(sent: Column, received: Column) -> Column:
    """received / sent * 100, NULL when nothing was sent."""
    return F.try_divide(received.cast("double"), sent.cast("double")) * F.lit(100.0)


def first_integer(text: str | Column) -> Column:
    """The first whole number in a text, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("bigint")


def params_text(params: str | Column) -> Column:
    """Map to ``K=V K=V``, blanks removed from the values."""
    return F.concat_ws(" ", F.transform(
        F.map_entries(params),
        lambda e: F.concat(e["key"], F.lit("="),
                           F.replace(F.coalesce(e["value"].cast("string"), F.lit("None")), F.lit(" "), F.lit("")))))


def merge_maps(left: str | Column, right: str | Column) -> Column:
    """Both maps in one; the right one wins where keys clash."""
    r = F.col(right) if isinstance(right, str) else right
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(r, k)), r)
