"""Column expressions for evidence scores and list decisions (FN-10..16, FN-19..22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# Log10 stand-in for probability 0 (numeric underflow).
LOG10_ZERO = -1000.0
# Manually validated names that are never put on a block list: (name, type).
PROTECTED_NAMES = (("insulin", "ggp"), ("INSULIN", "ggp"))

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def odds_ratio(global_p, local_p, invert: bool = False) -> Column:
    """FN-10: l*g / ((1-l)(1-g)); +inf when the denominator is 0.

    With ``invert`` both probabilities are replaced by their complements first.
    """
    g, l = _c(global_p), _c(local_p)
    if invert:
        g, l = 1 - g, 1 - l
    den = (1 - l) * (1 - g)
    return F.when(den == 0, F.lit(INF)).otherwise((l * g) / den)


def prob_diff(global_p, local_p, invert: bool = False) -> Column:
    """FN-11: l - (1 - g)."""
    g, l = _c(global_p), _c(local_p)
    if invert:
        g, l = 1 - g, 1 - l
    return l - (1 - g)


def simple_ratio(global_p, local_p, invert: bool = False) -> Column:
    """FN-12: l / (1 - g); +inf when 1 - g is 0."""
    g, l = _c(global_p), _c(local_p)
    if invert:
        g, l = 1 - g, 1 - l
    return F.when((1 - g) == 0, F.lit(INF)).otherwise(l / (1 - g))


# UDF-01: ranking functions by name.  `simple` computes the difference, as the
# reference does (its simple-ratio function is never reached); the ratio that
# the name promises is offered as `simple_ratio`.
RANKING_FUNCTIONS = {
    "ratio": odds_ratio,
    "diff": prob_diff,
    "simple": prob_diff,
    "simple_ratio": simple_ratio,
}


def ranking_value(name: str, global_p, local_p, invert: bool = False) -> Column:
    """FN-16: the ranking value of a list row under the named function."""
    try:
        fn = RANKING_FUNCTIONS[name]
    except KeyError:
        raise ValueError(f"unknown ranking function {name!r}") from None
    return fn(global_p, local_p, invert)


def is_protected(name_col, type_col, protected=PROTECTED_NAMES) -> Column:
    """True for (name, type) pairs on the protected list (FLT-11)."""
    cond = F.lit(False)
    for n, t in protected:
        cond = cond | ((_c(name_col) == F.lit(n)) & (_c(type_col) == F.lit(t)))
    return cond


def safe_div(num, den) -> Column:
    """FN-22: num / den, 0 when den is 0 or NULL."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(0.0))


def softmax(arr) -> Column:
    """FN-20: numerically stable softmax of an array of doubles."""
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)
