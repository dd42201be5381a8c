"""Quantiles per group: exact by distributed rank selection (E-05, E-07), or by a mergeable sketch (E-06).

Exact: equal values are counted first, so repeats cost nothing. The wanted ranks are then sought in
three narrowing steps, each an aggregation and a window of bounded size: buckets of about 0.2 %
of the value, 4,096 even parts of the buckets that hold a wanted rank, and the values of the parts that
do. No step gathers a group's values in one task or one map, so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 4096
#: buckets per factor e of the value
_FINE = 512
_FAR = 1 << 60


def _coarse(v: Column) -> Column:
    """A bucket number that never falls as ``v`` rises."""
    size = F.when(F.abs(v) == float("inf"), F.lit(_FAR)).otherwise(F.floor(F.log1p(F.abs(v)) * _FINE).cast("bigint"))
    return F.when(F.isnan(v), F.lit(_FAR + 1)).when(v < 0, -size).otherwise(size)


def _inside(ranks: Column, after: Column, n: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= after - n) & (r < after))


def exact_quantiles(df: DataFrame, keys: list[str], columns: dict[str, list[float]]) -> DataFrame:
    """One row per group: ``keys`` and, per name in ``columns``, ``<name>_q``, its interpolated quantiles.

    Nulls in a column are left out; a group without values gets null. Null keys are a group.
    ``keys`` may be empty (one row, or none without rows).
    """
    names = list(columns)
    values = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(names)])
    probs = F.get(F.array(*[F.array(*[F.lit(float(p)) for p in columns[c]]) for c in names]), F.col("g._kind"))
    # the group as one struct: its null fields compare as equal in joins
    counts = (df.select(*keys, F.inline(values)).where("_v IS NOT NULL").groupBy(*keys, "_kind", "_v")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.struct(*keys, "_kind").alias("g"), F.col("_v").alias("v"), "n", _coarse(F.col("_v")).alias("b1")))

    def wanted(total: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(probs, lambda p: F.array(
            F.floor(p * (total - 1)).cast("bigint"), F.ceil(p * (total - 1)).cast("bigint")))))

    def running(w) -> Column:
        return F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))

    first = (counts.groupBy("g", "b1").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
             .withColumn("after", running(Window.partitionBy("g").orderBy("b1")))
             .withColumn("total", F.sum("n").over(Window.partitionBy("g")))
             .withColumn("ranks", _inside(wanted(F.col("total")), F.col("after"), F.col("n")))
             .where(F.size("ranks") > 0)
             .select("g", "b1", "lo", "hi", "total", "ranks", (F.col("after") - F.col("n")).alias("before")))
    near = counts.join(first, ["g", "b1"]).withColumn("b2", F.when(F.col("hi") > F.col("lo"), F.floor(
        (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (_PARTS - 1)).cast("bigint")).otherwise(F.lit(0)))
    second = (near.groupBy("g", "b1", "b2").agg(F.sum("n").alias("n"), F.max("before").alias("before"), F.max("ranks").alias("ranks"))
              .withColumn("after", F.col("before") + running(Window.partitionBy("g", "b1").orderBy("b2")))
              .withColumn("ranks", _inside(F.col("ranks"), F.col("after"), F.col("n"))).where(F.size("ranks") > 0)
              .select("g", "b1", "b2", "ranks", (F.col("after") - F.col("n")).alias("before")))
    found = (near.select("g", "b1", "b2", "v", "n", "total").join(second, ["g", "b1", "b2"])
             .withColumn("after", F.col("before") + running(Window.partitionBy("g", "b1", "b2").orderBy("v")))
             .select("g", "total", "v", F.explode(_inside(F.col("ranks"), F.col("after"), F.col("n"))).alias("rank"))
             .groupBy("g").agg(F.max("total").alias("total"), F.map_from_entries(
                 F.collect_list(F.struct("rank", "v"))).alias("at")))        # two values per probability

    def interpolated(p: Column) -> Column:
        place = p * (F.col("total") - 1)
        low = F.element_at("at", F.floor(place).cast("bigint"))
        return low + (place - F.floor(place)) * (F.element_at("at", F.ceil(place).cast("bigint")) - low)
    found = found.select("g.*", F.transform(probs, interpolated).alias("q"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == i, F.col("q"))).alias(f"{c}_q")
                                      for i, c in enumerate(names)])


def rank_error(k: int) -> float:
    """Bound on a sketch's rank error, as a share of the rows: twice the 99 % figure for parameter ``k``."""
    return 2 * 2.296 / k ** 0.9021


def sketch_quantiles(column: str, probs: list[float], k: int) -> Column:
    """Aggregate: approximate quantiles by a KLL sketch (mergeable, a few kB whatever the rows)."""
    sketch = F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k))
    return F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))) for p in probs])


def sketch_check(df: DataFrame, key: str, column: str, probs: list[float], k: int) -> DataFrame:
    """Per group and probability: the sketch's value, its true share of rows, and whether that is within the bound."""
    rows = df.where(F.col(column).isNotNull())
    # the group as a struct: null groups join too
    approx = (rows.groupBy(F.struct(key).alias("g")).agg(sketch_quantiles(column, probs, k).alias("q"))
              .select("g", F.posexplode("q").alias("i", "value")))
    hits = rows.select(F.struct(key).alias("g"), F.col(column).cast("double").alias("v")).groupBy("g", "v").count().join(approx, "g")
    share = hits.groupBy("g", "i", "value").agg(
        (F.sum(F.when(F.col("v") < F.col("value"), F.col("count")).otherwise(0)) / F.sum("count")).alias("below"),
        (F.sum(F.when(F.col("v") <= F.col("value"), F.col("count")).otherwise(0)) / F.sum("count")).alias("up_to"))
    p = F.get(F.array(*[F.lit(float(x)) for x in probs]), F.col("i"))
    error = F.lit(rank_error(k))
    return share.select(f"g.{key}", p.alias("prob"), "value", "below", "up_to", error.alias("rank_error"),
                        ((p >= F.col("below") - error) & (p <= F.col("up_to") + error)).alias("within_bound"))
