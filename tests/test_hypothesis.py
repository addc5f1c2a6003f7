"""Property tests of the numeric rules against exact Python arithmetic."""

import math
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from souk.functions import exprs as X

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
prices = st.decimals(min_value=0, max_value=100000, places=2).map(float)
common = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@common
@given(st.lists(st.tuples(finite, st.one_of(st.just(0.0), finite)), min_size=1, max_size=20))
def test_safe_div_matches_ieee(spark, pairs):
    df = spark.createDataFrame(pairs, "p double, w double")
    for (p, w), (got,) in zip(pairs, df.select(X.safe_div("p", "w")).collect()):
        if w == 0:
            want = math.copysign(math.inf, p) if p != 0 else math.nan
            assert (math.isnan(got) and math.isnan(want)) or got == want
        else:
            assert got == p / w


@common
@given(st.lists(prices, min_size=1, max_size=40), st.integers(min_value=1, max_value=8))
def test_exact_mean_is_correctly_rounded(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    got = df.agg(X.clean_mean("x")).first()[0]
    exact = sum(Fraction(Decimal(repr(v))) for v in values) / len(values)
    q = Decimal(exact.numerator) / Decimal(exact.denominator)
    want = float(q.quantize(Decimal("1e-12"), rounding=ROUND_HALF_UP))
    assert got == want


# short decimals: their text is the same from Java's Double.toString (what
# Spark's bround rounds) and from Python's repr
short = st.decimals(min_value=-1000000, max_value=1000000, places=4).map(float)


@common
@given(st.lists(short, min_size=1, max_size=20))
def test_half_even_matches_decimal(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, (got,) in zip(values, df.select(X.half_even("x", 2)).collect()):
        assert got == float(Decimal(repr(v)).quantize(Decimal("0.01")))  # default context: half-even
