"""Exclusive quantiles of the kind that monitoring reports: by rank i * (n + 1) / 100, with plain rules for few values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 95, 99)


#: Ranges of values that are counted first; a group's wanted ranks are looked for in a few of them.
RANGES = 64


def _range_of(value: Column, limits: list[float]) -> Column:
    """How many limits lie below a value, by halves."""
    if not limits:
        return F.lit(0)

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= limits[middle], half(low, middle)).otherwise(half(middle + 1, high))

    return half(0, len(limits))


def latency_percentiles(df: DataFrame, value: str, by: list[str], *, few_median: bool = False) -> DataFrame:
    """p50, p95, p99 and n for each group.

    Fewer than 4 values: the least (or with ``few_median`` the upper middle one) and the largest; p95 is the largest
    below 20 values, p99 below 100.  ``by`` may be empty.

    No group is sorted in one task: each group's values are counted in ranges (limits from approximate quantiles of all
    values, found when the plan is made), the ranges that hold wanted ranks are known from the counts, and only
    their distinct values, with how often each occurs, are put in order.
    """
    groups = by or ["__all"]
    rows = df.where(F.col(value).isNotNull())
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    rows = rows.select(*groups, F.col(value).cast("double").alias("__v"))
    limits = sorted(set(rows.where(~F.isnan("__v")).approxQuantile("__v", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    rows = rows.withColumn("__range", _range_of(F.col("__v"), limits))
    counts = rows.groupBy(*groups, "__range").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    # A row for each group and range: RANGES at most of a group.
    whole = Window.partitionBy(*groups)
    known = counts.withColumns({"__before": F.sum("__c").over(whole.orderBy("__range")) - F.col("__c"), "__n": F.sum("__c").over(whole), "__least": F.min("__lo").over(whole), "__most": F.max("__hi").over(whole)})

    def place(i: int) -> Column:
        return F.least(F.greatest(F.floor(i * (F.col("__n") + 1) / 100), F.lit(1)), F.col("__n") - 1)

    ranks = [r for i in PERCENTS for r in (place(i), place(i) + 1)] + [F.floor(F.col("__n") / 2) + 1, F.lit(1)]
    inside = [(r > F.col("__before")) & (r <= F.col("__before") + F.col("__c")) for r in ranks]
    wanted = known.where(reduce(or_, inside)).select(*groups, "__range", "__before", "__n", "__least", "__most")
    values = rows.join(wanted, [*groups, "__range"]).groupBy(*groups, "__range", "__before", "__n", "__least", "__most", "__v").agg(F.count("*").alias("__c"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*groups, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank <= F.col("__to")), F.col("__v")))

    parts = []
    for i in PERCENTS:
        j = place(i)
        parts += [at(j).alias(f"__a{i}"), at(j + 1).alias(f"__b{i}")]
    agg = ranked.groupBy(*groups, "__n", "__least", "__most").agg(*parts, at(F.floor(F.col("__n") / 2) + 1).alias("__mid"))

    def between(i: int) -> Column:
        delta = i * (F.col("__n") + 1) - 100 * place(i)
        return (F.col(f"__a{i}") * (100 - delta) + F.col(f"__b{i}") * delta) / 100

    few, most = F.col("__n") < 4, F.col("__most")
    p50 = F.when(few, F.col("__mid") if few_median else F.col("__least")).otherwise(between(50))
    return agg.select(*by, F.col("__n").alias("n"), p50.alias("p50"), F.when(F.col("__n") < 20, most).otherwise(between(95)).alias("p95"), F.when(F.col("__n") < 100, most).otherwise(between(99)).alias("p99"))
