"""Exact sums against fractions."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.functions import exact
from loomgrid.plans import registry


def nearest(values):
    """The double nearest to the exact sum."""
    values = [v for v in values if v is not None]
    if any(math.isnan(v) for v in values) or {math.inf, -math.inf} <= set(values):
        return math.nan
    if any(math.isinf(v) for v in values):
        return next(v for v in values if math.isinf(v))
    try:
        return float(sum(map(Fraction, values), Fraction(0)))
    except OverflowError:
        return math.inf if sum(map(Fraction, values)) > 0 else -math.inf


def sums(spark, groups, **how):
    rows = [(k, v) for k, g in enumerate(groups) for v in g]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    return {r["k"]: r["v"] for r in exact.exact_sums(df, ["k"], **how).collect()}


GROUPS = [
    [1e16, 0.01, -1e16], [0.1] * 1000, [1e308, 1e308, -1e308], [1e308, 1e308], [-1e308, -1e308, 5.0], [5e-324] * 3, [5e-324, -5e-324], [2.0**1023, 2.0**-1074, -(2.0**1023)], [math.inf, 1.0], [-math.inf, 1.0], [math.inf, -math.inf],
    [math.nan, 1.0], [None, None], [None, 2.5], [-0.0], [0.0, -0.0], [1.0, 2.0**-53], [1.0, 2.0**-53, 2.0**-80], [1.0, 2.0**-53, -(2.0**-80)], [-1.0, -(2.0**-53)], [2.0**28, -1.0], [2.0**28 - 2.0**-24, 2.0**28], [1e300, 1e-300, 1.0, -1e300],
    [float(2**k) for k in range(-200, 200, 7)], [(-1.0) ** k * float(3**k) for k in range(60)], [1e100, -1e100, 1e84, -1e84, 3.0], [-1e-310, 2e-308],
]


@pytest.mark.parametrize("rows", [0, exact.MOST_ROWS * 3])
def test_chosen_groups(spark, rows):
    got = sums(spark, GROUPS, rows=rows)
    for k, g in enumerate(GROUPS):
        want = nearest(g)
        assert got[k] == want or (math.isnan(got[k]) and math.isnan(want)), (g[:5], got[k], want)


def test_random_groups(spark):
    rng = random.Random(2)
    spread = lambda e: [math.ldexp(rng.uniform(-1, 1), rng.randint(-e, e)) for _ in range(rng.randint(1, 40))]
    groups = [spread(e) for e in (0, 3, 30, 60, 300, 1000) for _ in range(60)]
    groups += [[*g, *(-x for x in g), 1e-5] for g in groups[:100]]
    got = sums(spark, groups)
    assert all(got[k] == nearest(g) for k, g in enumerate(groups))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(width=64), max_size=12), min_size=1, max_size=30))
def test_any_floats(spark, groups):
    got = sums(spark, [g or [None] for g in groups])
    for k, g in enumerate(groups):
        assert got[k] == nearest(g) or (math.isnan(got[k]) and math.isnan(nearest(g)))


def test_order_does_not_matter_and_no_python(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.rand(1) - 0.5).alias("v")).withColumn("v", F.col("v") * F.pow(F.lit(10.0), F.col("v") * 60)).cache()
    one = exact.exact_sums(df.repartition(7), ["k"])
    two = exact.exact_sums(df.orderBy("v"), ["k"])
    assert sorted(one.collect()) == sorted(two.collect())
    plan = one._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    df.unpersist()


@pytest.mark.parametrize("name", ["sum_kahan", "mean_kahan"])
def test_the_large_values_do_not_hang_on_the_order_of_a_shuffle(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Limit" not in plan and "Offset" not in plan
