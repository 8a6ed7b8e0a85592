"""Column helpers for the null and number rules the panel operators rely on."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else_na(cond: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def exact_sum(c: Column | str) -> Column:
    """Sum that loses nothing and, where it can, does not depend on the order of the rows.

    Values below 1e18 that ten decimals hold exactly add up in DECIMAL; all others
    (longer fractions, larger numbers, infinities) add up as doubles.
    """
    x = as_col(c).cast("double")
    fixed = x.try_cast("decimal(28,10)")
    fits = F.coalesce((F.abs(x) < 1e18) & (fixed.cast("double") == x), F.lit(False))
    exact, rest = F.sum(F.when(fits, fixed)).cast("double"), F.sum(F.when(~fits, x))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def sum0(c: Column | str) -> Column:
    """Sum that skips nulls and is 0 when nothing is left."""
    return F.coalesce(exact_sum(c), F.lit(0.0))


def ratio(num: Column | str, den: Column | str, keep_inf: bool = False) -> Column:
    """Quotient; null where the denominator is 0.

    With ``keep_inf`` a non-zero numerator over 0 gives signed infinity, and
    only 0/0 is null.
    """
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    out = F.when(den != 0, F.try_divide(num, den))
    if keep_inf:
        inf = F.lit(float("inf"))
        out = out.when(num > 0, inf).when(num < 0, -inf)
    return out


def any_nonzero(*cols: Column | str) -> Column:
    """True where at least one column is neither null nor zero."""
    return reduce(or_, [F.coalesce(as_col(c), F.lit(0)) != 0 for c in cols])


def null_if_zero(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(0))


def false_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(False))


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace the listed values, keep every other value."""
    c = as_col(c)
    out = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(c)


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number becomes null."""
    return as_col(c).try_cast("double")


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    return F.bround(as_col(c), digits)


def comma_text(c: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(as_col(c), 0)


def percent_text(c: Column | str, digits: int = 0) -> Column:
    return F.concat(F.format_number(as_col(c) * 100, digits), F.lit("%"))


def indicator_code(indicator: Column | str, part: Column | str) -> Column:
    """Indicator name with ``_D`` appended for denominators."""
    ind = as_col(indicator)
    return F.when(as_col(part) == "D", F.concat(ind, F.lit("_D"))).otherwise(ind)


def display_name(agency: Column | str, owner: Column | str, partner: Column | str) -> Column:
    """``agency owner partner`` as one label."""
    return F.concat_ws(" ", as_col(agency), as_col(owner), as_col(partner))
