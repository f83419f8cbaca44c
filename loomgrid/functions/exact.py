"""Exact sums of doubles by expressions: the sum is rounded once, to the nearest double, whatever the order of the rows.

A finite double v is written in digits of ``DIGIT`` bits: with its band b, about log2(v) / DIGIT, v = c0 2^(DIGIT b) + c1 2^(DIGIT (b - 1)) + c2 2^(DIGIT (b - 2)) with integers
c0 (signed), c1 and c2, as 53 bits fit in what is below the first of a digit's bits and two digits. Scaling by powers of two and cutting at the point
are exact. The integers are summed as longs by group and band, before and after the shuffle; a group has few bands, 77 at most.
Its positions are then carried from the lowest up, and the three highest digits, with a last bit that says whether anything is
below, are one decimal that becomes the double. Where the bands are close and the sums small, one decimal holds the whole.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 28
BASE = 1 << DIGIT
#: Rows of a sum of longs, and the size of sums up to which one decimal holds two neighbouring bands.
MOST_ROWS, SMALL = 1 << 33, 1 << 40
WHOLE = "decimal(38,0)"


def digits(v: Column) -> tuple[Column, Column]:
    """(band, x) of finite values: v = x 2^(DIGIT band), |x| from about 1 to about BASE."""
    band = F.coalesce(F.floor(F.log2(F.abs(v)) / DIGIT), F.lit(0)).cast("int")
    # in two steps, as the power that scales the smallest numbers is beyond the doubles
    half = F.pow(F.lit(2.0), -band * (DIGIT // 2))
    return band, v * half * half


def sums_by_band(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys..., band, s0, s1, s2, nan, up, down): sums of the digits of a band, and how many values are not finite."""
    v = F.col(value).cast("double")
    finite = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    rows = df.select(*keys, v.alias("_v"), finite.alias("_f"))
    band, x = digits(F.col("_f"))
    rows = rows.select(*keys, "_v", band.alias("band"), x.alias("_x"))
    first = F.floor("_x")
    rest = (F.col("_x") - first) * BASE
    second = F.floor(rest)
    rows = rows.select(*keys, "_v", "band", first.alias("c0"), second.alias("c1"), F.floor((rest - second) * BASE).alias("c2"))
    return rows.groupBy(*keys, "band").agg(
        *[F.sum(f"c{k}").alias(f"s{k}") for k in range(3)],
        F.count_if(F.isnan("_v")).alias("nan"), F.count_if(F.col("_v") == float("inf")).alias("up"), F.count_if(F.col("_v") == -float("inf")).alias("down"),
    )


def by_group(bands: DataFrame, keys: list[str], parts: str | None) -> DataFrame:
    """(keys..., cells, lo, hi, most, nan, up, down): of each group the sums of its bands, the positions they span and the largest of them.

    ``parts`` is a key that goes, after the sums are carried once to single positions.
    """
    flags = ("nan", "up", "down")
    bands = bands.select(*keys, *([parts] if parts else []), "band", *[F.coalesce(f"s{k}", F.lit(0)).cast("long").alias(f"s{k}") for k in range(3)], *flags)
    if parts:
        place = lambda k, s, up=0: F.struct((F.col("band") - k + up).alias("band"), s.alias("s0"))
        split = F.array(*[x for k in range(3) for x in (place(k, F.col(f"s{k}").bitwiseAND(F.lit(BASE - 1))), place(k, F.shiftright(f"s{k}", DIGIT), 1))])
        rows = bands.select(*keys, F.posexplode(split).alias("nth", "cell"), *flags).select(*keys, "cell.*", *[F.when(F.col("nth") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in flags])
        bands = rows.groupBy(*keys, "band").agg(F.sum("s0").alias("s0"), *[F.sum(c).alias(c) for c in flags]).withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    most = F.greatest(*[F.abs(f"s{k}") for k in range(3)])
    return bands.groupBy(*keys).agg(
        F.collect_list(F.struct("band", "s0", "s1", "s2")).alias("cells"), (F.min("band") - 2).alias("lo"), F.max("band").alias("hi"), F.max(most).alias("most"), *[F.sum(c).alias(c) for c in flags]
    )


def scaled(x: Column, exponent: Column) -> Column:
    """x 2^exponent, in two steps."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def carried(sign: int) -> Column:
    """(carry, d): the digits from the lowest position up of the sum, or of its negative."""
    at = lambda c, p: F.when(c["band"] == p, c["s0"]).when(c["band"] == p + 1, c["s1"]).when(c["band"] == p + 2, c["s2"]).otherwise(F.lit(0).cast("long"))
    own = lambda p: F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + at(c, p) * F.lit(sign))
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("d"))

    def step(acc: Column, p: Column) -> Column:
        t = acc["carry"] + own(p)
        return F.struct(F.shiftright(t, DIGIT).alias("carry"), F.concat(acc["d"], F.array(t.bitwiseAND(F.lit(BASE - 1)))).alias("d"))

    return F.aggregate(F.sequence(F.col("lo"), F.col("hi") + 3), empty, step)


def rounded(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys..., name): the double nearest to the sum of a group's cells."""
    groups = groups.withColumn("small", (F.col("hi") - F.col("lo") <= 3) & (F.col("most") <= SMALL))
    groups = groups.withColumn("up_", F.when(~F.col("small"), carried(1)))
    groups = groups.withColumn("minus", F.coalesce(F.col("up_.carry") < 0, F.lit(False)))
    groups = groups.withColumn("d", F.when(F.col("minus"), carried(-1)["d"]).otherwise(F.col("up_.d")))
    groups = groups.withColumn("top", F.array_max(F.filter(F.transform("d", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())))
    weights = F.array(*[F.lit(Decimal(BASE**k)).cast("decimal(26,0)") for k in range(4)])
    term = lambda c, k: c[f"s{k}"].cast("decimal(19,0)") * F.get(weights, c["band"] - k - F.col("lo"))
    whole = F.aggregate("cells", F.lit(0).cast(WHOLE), lambda t, c: (t + term(c, 0) + term(c, 1) + term(c, 2)).cast(WHOLE))
    at = lambda k: F.coalesce(F.get("d", F.col("top") - k), F.lit(0)).cast("decimal(10,0)")
    below = F.exists(F.transform("d", lambda x, i: (i < F.col("top") - 2) & (x != 0)), lambda x: x)
    head = (at(0) * F.lit(Decimal(2 * BASE**2)).cast("decimal(26,0)") + at(1) * F.lit(Decimal(2 * BASE)).cast("decimal(26,0)") + at(2) * F.lit(2)).cast(WHOLE) + F.when(below, 1).otherwise(0)
    large = F.when(F.col("top").isNull(), 0.0).otherwise(scaled(head.cast("double"), (F.col("lo") + F.col("top") - 2) * DIGIT - 1)) * F.when(F.col("minus"), -1.0).otherwise(1.0)
    value = F.when(F.col("small"), scaled(whole.cast("double"), F.col("lo") * DIGIT)).otherwise(large)
    odd = F.when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), float("nan")).when(F.col("up") > 0, float("inf")).when(F.col("down") > 0, -float("inf"))
    return groups.select(*keys, F.coalesce(odd, value + F.lit(0.0)).alias(name))


def exact_sums(df: DataFrame, keys: list[str], value: str = "v", rows: int = 0, name: str = "v") -> DataFrame:
    """(keys..., name): the sum of ``value`` by keys, rounded once; nulls are left out, a group of nothing else sums to 0.

    rows: what a group may hold, if known. Above MOST_ROWS a group is summed in parts, which are carried once before they meet.
    """
    parts = -(-rows // MOST_ROWS)
    if parts > 1:
        dealt = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        return rounded(by_group(sums_by_band(dealt, [*keys, "_part"], value), keys, "_part"), keys, name)
    return rounded(by_group(sums_by_band(df, keys, value), keys, None), keys, name)
