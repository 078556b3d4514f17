"""Exact decimal text of doubles (FN-24) and percentages cut out of metric lines (PRJ-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagsift.functions.text import bind

_SPLIT = 134217729.0             # 2 ** 27 + 1: cuts a double into halves of 26 bits
_HIGH = float(2 ** 62)


def decimal_text(x, digits: int) -> Column:
    """FN-24: a double with ``digits`` (1 to 6) decimals, rounded half to even on its exact binary value.

    0.125 with two decimals is 0.12, as it lies between; 2.675 is 2.67, as the double lies below.  The fraction of a
    double is exact, and its product with 10 ** digits is the exact sum of two doubles (it is cut into halves
    first), so the comparison with one half is exact too.  nan, inf and -inf are these words; -0.0 keeps its sign;
    null stays null; values of 1e37 and more raise.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)

    def whole(v: Column) -> Column:              # exact text of an integral double
        big = F.floor(v / _HIGH)
        wide = F.lit(2 ** 62).cast("decimal(38,0)")
        sums = (big.cast("decimal(19,0)") * wide).cast("decimal(38,0)") + (v - big.cast("double") * _HIGH).cast("bigint").cast("decimal(19,0)")
        return F.when(v < _HIGH, v.cast("bigint").cast("string")).otherwise(sums.cast("string"))

    def text(v: Column) -> Column:
        v = F.abs(v)
        base = F.when(v < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v)
        return bind(F.struct(base.alias("base"), (v - base).alias("f")), lambda p: bind(
            F.struct(p["base"].alias("base"), p["f"].alias("f"), (p["f"] * _SPLIT - (p["f"] * _SPLIT - p["f"])).alias("h")), lambda q: bind(
                F.struct(q["base"].alias("base"), (q["h"] * scale).alias("hi"), ((q["f"] - q["h"]) * scale).alias("lo")), lambda r: bind(
                    F.struct(r["base"].alias("base"), r["hi"].alias("hi"), r["lo"].alias("lo"),
                             F.greatest(F.floor(r["hi"] + r["lo"]), F.lit(0)).alias("k")), _rounded))))

    def _rounded(s: Column) -> Column:
        # How far the rest is beyond a half: its sign decides; both differences are exact.
        rest, low = (s["hi"] - s["k"].cast("double")) - 0.5, -s["lo"]
        up = F.when(rest > low, 1).when(rest < low, 0).otherwise(s["k"] % 2)
        return bind(s["k"] + up, lambda k: F.concat(
            whole(s["base"] + (k >= int(scale)).cast("double")), F.lit("."), F.lpad((k % int(scale)).cast("string"), digits, "0")))

    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    size = F.abs(x)
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan")
            .when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when(size >= 1e37, F.raise_error(F.lit("too large for decimal text")).cast("string"))
            .otherwise(F.concat(sign, text(x))))


def rounded(x, digits: int) -> Column:
    """A double rounded half to even on its exact value (finite values below 1e37)."""
    return decimal_text(x, digits).cast("double")


def metric_percent(line, name: str) -> Column:
    """PRJ-04: from ``... name = d.ddddd`` the first four decimals as a percentage with two, cut off, not rounded.

    Lines with fewer than five decimals, or without the metric, stay as they are.
    """
    line = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(line, rf"^.*{name} = (\d)\.(\d{{2}})(\d{{2}})\d+$", "$2.$3")
