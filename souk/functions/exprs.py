"""Column -> Column helpers for the semantics Spark does not give by default.

All helpers build plain Catalyst expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from souk import config

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def INF() -> Column:  # noqa: N802 - literal constructors need an active session
    return F.lit(float("inf"))


def NEG_INF() -> Column:  # noqa: N802
    return F.lit(float("-inf"))


def NAN() -> Column:  # noqa: N802
    return F.lit(float("nan"))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """IEEE division: x/0 is +-Inf, 0/0 is NaN, a NULL operand gives NULL.

    Spark under ANSI raises on a zero divisor and ``try_divide`` gives NULL,
    neither of which matches the survey arithmetic.
    """
    n, d = _c(num).cast("double"), _c(den).cast("double")
    by_zero = F.when(n > 0, INF()).when(n < 0, NEG_INF()).when(n == 0, NAN())
    return F.when(d == 0, by_zero).otherwise(n / d)


def is_finite(c: ColumnOrName) -> Column:
    x = _c(c)
    return ~(F.isnan(x) | (F.abs(x) == INF()))


def finite_or_null(c: ColumnOrName) -> Column:
    """Inf, -Inf and NaN become NULL."""
    x = _c(c)
    return F.when(is_finite(x), x)


def nan_to_null(c: ColumnOrName) -> Column:
    x = _c(c)
    return F.when(~F.isnan(x), x)


def mean_skip_na(c: ColumnOrName) -> Column:
    """Mean that skips NULL and NaN but keeps Inf (cleaned afterwards)."""
    return F.avg(nan_to_null(c))


# Means sum in two parts.  Ordinary values (magnitude below 1e7, at most eight
# decimals: prices and counts as surveys write them) are summed as decimals, so
# their mean does not depend on the order in which partitions are combined; it
# is rounded half-up at 12 decimals and converted to the nearest double once.
# All other finite values are summed as doubles, whatever their size.
MEAN_VALUE_TYPE = "decimal(18,8)"
MEAN_SUM_TYPE = "decimal(28,8)"
MEAN_RESULT_TYPE = "decimal(38,12)"
ORDINARY = 1e7


def decimal_part(c: ColumnOrName) -> Column:
    """The value as a decimal if that loses nothing, else NULL."""
    x = _c(c).cast("double")
    d = F.when(F.abs(x) < ORDINARY, x).try_cast(MEAN_VALUE_TYPE)
    return F.when(d.cast("double") == x, d)


def double_part(c: ColumnOrName) -> Column:
    """A finite value that ``decimal_part`` does not hold, else NULL."""
    x = _c(c).cast("double")
    return F.when(is_finite(x) & decimal_part(x).isNull(), x)


def is_inf(c: ColumnOrName) -> Column:
    return F.abs(_c(c)) == INF()


def finite_count(c: ColumnOrName) -> Column:
    """How many values of a group are finite."""
    return F.count(F.when(is_finite(c), 1))


def mean_of(decimals: Column, doubles: Column, n: Column) -> Column:
    """Mean from the two sums and the count of finite values (NULL for no values)."""
    exact = (decimals.cast(MEAN_SUM_TYPE) / n.cast("decimal(20,0)")).cast(MEAN_RESULT_TYPE).cast("double")
    mixed = (F.coalesce(decimals.cast("double"), F.lit(0.0)) + doubles) / n
    return F.when(n > 0, F.when(doubles.isNull(), exact).otherwise(mixed))


def clean_mean(c: ColumnOrName) -> Column:
    """Group mean as the survey computes it: NULL and NaN skipped; any Inf
    makes the mean non-finite, which becomes NULL; no values -> NULL."""
    mean = mean_of(F.sum(decimal_part(c)), F.sum(double_part(c)), finite_count(c))
    return F.when(F.count(F.when(is_inf(c), 1)) == 0, mean)


def half_even(c: ColumnOrName, digits: int = 0) -> Column:
    """Round half to even (banker's rounding), as the survey's rounding does."""
    return F.bround(_c(c), digits)


def first_replace(c: ColumnOrName, pattern: str, replacement: str) -> Column:
    """Replace the first match of a literal-safe regex only."""
    return F.regexp_replace(_c(c), f"^(.*?){pattern}", f"$1{replacement}")


def sentence_case(c: ColumnOrName) -> Column:
    """First character upper case, the rest lower case (not initcap)."""
    x = _c(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def month_name(c: ColumnOrName, names: Iterable[str] = config.MONTH_NAMES) -> Column:
    """Month number 1..12 to its English name; anything else NULL."""
    x = _c(c).cast("int")
    arr = F.array(*[F.lit(n) for n in names])
    return F.when(x.between(1, len(tuple(names))), F.element_at(arr, x))


def to_number(c: ColumnOrName) -> Column:
    """Text to double; failures become NULL (never an error)."""
    return _c(c).try_cast("double")


#: The spellings of a false logical value; any other text is true or missing.
FALSE_WORDS = ("F", "FALSE", "false", "False")


def to_flag(c: ColumnOrName) -> Column:
    """Text to boolean; NULL and any other text (``no``, ``0``) mean TRUE."""
    return ~F.coalesce(_c(c).cast("string").isin(list(FALSE_WORDS)), F.lit(False))


def na_text(c: ColumnOrName) -> Column:
    """NULL rendered as the text 'NA' when pasted into a key."""
    return F.coalesce(_c(c).cast("string"), F.lit("NA"))


def paste(*cols: ColumnOrName, sep: str = "_") -> Column:
    """Key building that writes NULL as 'NA' instead of nulling the key."""
    return F.concat_ws(sep, *[na_text(c) for c in cols])


def contains_or_false(c: ColumnOrName, needle: str) -> Column:
    """Substring test where a NULL text is FALSE."""
    return F.coalesce(_c(c).contains(needle), F.lit(False))


def yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("yes")).otherwise(F.lit("no"))


def recode_sentinels(c: ColumnOrName, is_text: bool = False,
                     sentinel: int = config.SENTINEL_MISSING,
                     one_text: str = config.TEXT_ONE) -> Column:
    """Sentinel 99 -> NULL; for text columns 'yes' -> 1 and other text -> number
    or NULL."""
    x = _c(c)
    if is_text:
        num = F.when(x == F.lit(one_text), F.lit(1.0)).otherwise(to_number(x))
    else:
        num = x.cast("double")
    return F.when(num == sentinel, F.lit(None).cast("double")).otherwise(num)


def pct_change(cur: ColumnOrName, base: ColumnOrName) -> Column:
    """(x - y) / y * 100 with IEEE division; Inf/NaN are kept."""
    return safe_div(_c(cur) - _c(base), _c(base)) * 100


def count_distinct_na(c: ColumnOrName) -> Column:
    """Distinct count where NULL counts as one more value."""
    x = _c(c)
    return F.count_distinct(x) + F.max(x.isNull().cast("int")).cast("long")


def conditional_copy(cond: Column, source: ColumnOrName) -> Column:
    """Copy ``source`` where ``cond`` holds, NULL elsewhere (NULL cond -> NULL)."""
    return F.when(cond, _c(source))
