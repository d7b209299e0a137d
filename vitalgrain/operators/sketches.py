"""Mergeable sketches that bound an exact answer: percentiles in two scans, distinct values in one.

Nothing here runs a job while a plan is built, and no task sorts or holds a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DOUBLE = 1.7976931348623157e308
#: Sizes of theta sketches are powers of two between these.
LEAST_LG, MOST_LG = 12, 26


def percentile_index(df: DataFrame, value: str, share: float = 0.95, accuracy: int = 10_000, name: str = "value") -> DataFrame:
    """One row: the value at index int(share * n) of the n sorted values that aren't null; null of none.

    The first scan counts and keeps a quantile summary, whose ranks are off by n / accuracy at most. It gives two
    values around the one sought, at a distance of two such errors. The second scan counts what lies below the
    lower one, and the different values between the two; running totals over these (4 n / accuracy rows of equal or
    fewer values) tell which it is. Up to 4 * accuracy rows all lie between. Not a number counts as the largest value.
    A summary that missed is an error, never a wrong value.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    # summaries compare by <: what isn't finite stands at the ends
    ranked = F.greatest(F.least(F.nanvl("v", F.lit(MOST_DOUBLE)), F.lit(MOST_DOUBLE)), F.lit(-MOST_DOUBLE))
    slack = 2.0 / accuracy
    first = known.agg(F.count("*").alias("n"), F.percentile_approx(ranked, [max(0.0, share - slack), min(1.0, share + slack)], accuracy).alias("q"))
    few = F.col("n") <= 4 * accuracy
    bounds = first.select(
        F.lit(1).alias("_one"), F.least(F.floor(F.col("n") * share), F.col("n") - 1).alias("want"), F.when(few, -MOST_DOUBLE).otherwise(F.get("q", F.lit(0))).alias("low"), F.when(few, MOST_DOUBLE).otherwise(F.get("q", F.lit(1))).alias("high")
    )
    near = known.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one").where(ranked <= F.col("high"))
    inside = ranked >= F.col("low")
    counts = near.groupBy("want", inside.alias("inside"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("inside", "v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.col("upto") > F.col("want")
    checked = F.when(F.col("inside"), F.col("v")).otherwise(F.raise_error(F.lit("the quantile summary missed its rank")))
    missed = F.when((F.count("*") > 0) & (F.count_if(hit) == 0), F.raise_error(F.lit("the quantile summary missed its rank")).cast("double"))
    return upto.agg(F.coalesce(missed, F.min(F.when(hit, checked))).alias(name))


def distinct_up_to(column: Column, most: int) -> Column:
    """An aggregate: how many different values a column has, exact up to ``most`` and ``most`` beyond.

    A theta sketch of twice that size is a set of hashes up to there. Nulls don't count.
    """
    lg = max(LEAST_LG, (2 * most - 1).bit_length())
    if lg > MOST_LG:
        return F.least(F.count_distinct(column), F.lit(most))
    said = F.concat(F.lit("v"), column.cast("string"))  # sketches leave empty texts out
    return F.least(F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(said, lg)), F.lit(0)), F.lit(most)).cast("long")
