"""Grouped analytics over clinical entities.

Every limit has a total order. Example arrays hold a few names per group, cut before anything is
collected (see ``with_examples``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import scalars as S


def money(name: str, alias: str, how=F.sum, places: int = 2) -> Column:
    """A rounded figure that is 0 rather than null over no values."""
    return F.round(F.coalesce(how(name), F.lit(0.0)), places).alias(alias)


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


# ---- conditions ----
def conditions_by_name(conditions: DataFrame, limit: int = 50) -> DataFrame:
    return top(
        conditions.groupBy("condition_name").agg(
            F.count("*").alias("total_cases"),
            F.count_if(F.col("status") == "active").alias("active_cases"),
            F.count_if(F.col("status") == "resolved").alias("resolved_cases"),
            F.count_distinct("patient_id").alias("patient_count"),
        ),
        [F.desc("total_cases"), F.asc("condition_name")],
        limit,
    )


def conditions_by_demographics(conditions: DataFrame, patients: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """Inner join with patients, of conditions that are counted per patient and name before; the join strategy is left to sizes at run time."""
    people = patients.select("patient_id", "gender", "race", "ethnicity", S.age_group(S.age(F.col("birth_date"), as_of)).alias("age_group"))
    counted = conditions.groupBy("patient_id", "condition_name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))
    keys = ["gender", "race", "ethnicity", "age_group"]
    return top(
        counted.join(people, "patient_id").groupBy(*keys).agg(
            F.sum("n").alias("condition_count"),
            F.count_distinct("condition_name").alias("unique_conditions"),
            F.count_distinct("patient_id").alias("patient_count"),
            F.sum("active").alias("active_count"),
        ),
        [F.desc("condition_count"), *map(F.asc, keys)],
        limit,
    )


def conditions_by_month(conditions: DataFrame, limit: int = 50) -> DataFrame:
    return top(
        conditions.groupBy(F.year("onset_ts").cast("long").alias("year"), F.month("onset_ts").cast("long").alias("month")).agg(
            F.count("*").alias("condition_count"),
            F.count_distinct("patient_id").alias("patient_count"),
            F.count_distinct("condition_name").alias("unique_conditions"),
            F.count_if(F.col("status") == "active").alias("active_count"),
        ),
        [F.desc("year"), F.desc("month")],
        limit,
    )


# ---- money ----
def financial_summary(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count("*").alias("claim_count"), money("total_value", "total_amount"), money("total_value", "average_amount", F.avg, 4),
        money("total_value", "min_amount", F.min), money("total_value", "max_amount", F.max),
    )


def financial_by_patient(claims: DataFrame, limit: int = 100) -> DataFrame:
    return top(
        claims.groupBy("patient_id").agg(
            F.min("patient_display_name").alias("patient_name"), F.count("*").alias("claim_count"), money("total_value", "total_amount"),
            money("total_value", "average_amount", F.avg, 4), money("total_value", "min_amount", F.min), money("total_value", "max_amount", F.max),
        ),
        [F.desc("total_amount"), F.asc("patient_id")],
        limit,
    )


def financial_by(claims: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return top(
        claims.groupBy(key).agg(
            F.count("*").alias("claim_count"), money("total_value", "total_amount"), money("total_value", "average_amount", F.avg, 4), F.count_distinct("patient_id").alias("patient_count")
        ),
        [F.desc("total_amount"), F.asc(key)],
        limit,
    )


def financial_by_month(claims: DataFrame, limit: int = 50) -> DataFrame:
    year, month = F.year("billable_ts"), F.month("billable_ts")
    return (
        top(
            claims.groupBy(year.alias("y"), month.alias("m")).agg(
                F.count("*").alias("claim_count"), money("total_value", "total_amount"), money("total_value", "average_amount", F.avg, 4), F.count_distinct("patient_id").alias("patient_count")
            ),
            [F.desc("y"), F.desc("m")],
            limit,
        )
        .withColumn("period", F.concat_ws("-", "y", "m"))
        .drop("y", "m")
    )


# ---- groups with examples ----
def with_examples(df: DataFrame, key: str, name: str, min_count: int = 1, limit: int | None = 50, examples: int = 5) -> DataFrame:
    """Groups by count, largest first, with the first names of each.

    Rows are counted per group and name once; counts and names both come from that. Names are ranked and
    cut before they are shuffled and collected, so a large group becomes neither a large task nor a large array.
    """
    from pyspark.sql import Window

    names = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("group_key"), F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    order = [F.desc("count"), F.asc("group_key")]
    groups = top(names.groupBy("group_key").agg(F.sum("_n").alias("count")).where(F.col("count") >= min_count), order, limit)
    first = names.withColumn("_at", F.row_number().over(Window.partitionBy("group_key").orderBy(F.asc_nulls_last("_name")))).where(F.col("_at") <= examples)
    lists = first.groupBy("group_key").agg(F.sort_array(F.collect_list("_name")).alias("examples"))
    return groups.join(lists, "group_key").select("group_key", "count", "examples").orderBy(*order)


# ---- generic record queries and patterns ----
def records(df: DataFrame, columns: list[str], order: list[Column], limit: int = 50) -> DataFrame:
    return top(df.select(*columns), order, limit)


def pattern_counts(df: DataFrame, key: Column, alias: str = "group_key", limit: int = 20, min_count: int = 1, value: str | None = None) -> DataFrame:
    """Rows and distinct patients per key; with ``value`` its average, least and most."""
    extra = [] if value is None else [money(value, "average", F.avg, 4), money(value, "minimum", F.min), money(value, "maximum", F.max), money(value, "total")]
    grouped = df.groupBy(key.alias(alias)).agg(F.count("*").alias("count"), F.count_distinct("patient_id").alias("patient_count"), *extra)
    return top(grouped.where(F.col("count") >= min_count), [F.desc("count"), F.asc(alias)], limit)


def prevalence(conditions: DataFrame, patients: DataFrame, name: str | None = None, status: str = "active", limit: int = 20) -> DataFrame:
    """Distinct patients per condition over all patients."""
    from vitalgrain.functions import filters as L

    total = patients.agg(F.count_distinct("patient_id").alias("population"))  # one row, which every group meets
    found = L.apply(conditions, L.contains("condition_name", name), L.equals("status", status)).groupBy("condition_name").agg(F.count_distinct("patient_id").alias("patients"))
    both = found.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    rated = both.select("condition_name", "patients", F.round(F.col("patients") * 100.0 / F.col("population"), 4).alias("prevalence"))
    return top(rated, [F.desc("patients"), F.asc("condition_name")], limit)


def trends(observations: DataFrame, unit: str = "month", limit: int = 20) -> DataFrame:
    """Averages per test and period with the change from the period before."""
    from pyspark.sql import Window

    by = observations.groupBy("test_name", S.period(F.col("test_ts"), unit).alias("period")).agg(
        F.count("*").alias("count"), money("value", "average", F.avg, 4), money("value", "minimum", F.min), money("value", "maximum", F.max)
    )
    before = F.lag("average").over(Window.partitionBy("test_name").orderBy("period"))
    return top(by.withColumn("change", F.round(F.col("average") - before, 4)), [F.asc("test_name"), F.asc("period")], limit)


def missing_from_schedule(given: DataFrame, schedule: list[tuple[str, int, int]], age_in_years: int) -> DataFrame:
    """The scheduled vaccines for an age that weren't given."""
    spark = given.sparkSession
    due = spark.createDataFrame([(v,) for v, low, high in schedule if low <= age_in_years <= high], "vaccine_name string")
    return due.join(given.select("vaccine_name").distinct(), "vaccine_name", "left_anti")


def claim_items(lineitem: DataFrame) -> DataFrame:
    """Claims with their items as an array of structs, in order."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product"), F.col("l_extendedprice").alias("net_value"))
    return lineitem.groupBy(F.col("l_orderkey").cast("string").alias("claim_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def adjudications(eobs: DataFrame, unit: str = "month", limit: int = 25) -> DataFrame:
    """Paid and denied amounts per insurer and period."""
    grouped = eobs.groupBy("insurer_display", S.period(F.col("billable_ts"), unit).alias("period")).agg(
        F.round(F.sum("adjudicated_value"), 2).alias("paid"), F.round(F.sum("denied_value"), 2).alias("denied")
    )
    return top(grouped, [F.desc("period"), F.asc("insurer_display")], limit)


def eob_details(eobs: DataFrame, claim_reference: str | None = None, eob_id: str | None = None, patient_id: str | None = None, category: str | None = None) -> DataFrame:
    """One row per explanation of benefit and category of its amounts."""
    from vitalgrain.functions import filters as L

    rows = L.apply(eobs, L.equals("claim_reference", claim_reference), L.equals("eob_id", eob_id), L.equals("patient_id", patient_id))
    amounts = F.create_map(F.lit("paid"), F.col("adjudicated_value"), F.lit("denied"), F.col("denied_value"))
    return L.apply(rows.select("eob_id", "claim_reference", F.explode(amounts).alias("category", "amount")), L.equals("category", category))


def conditions_by_place(conditions: DataFrame, patients: DataFrame, field: str = "city") -> DataFrame:
    """Conditions counted by a field of their patients, counted per patient before the join."""
    counted = conditions.groupBy("patient_id").agg(F.count("*").alias("n"))
    return counted.join(patients.select("patient_id", field), "patient_id").groupBy(field).agg(F.sum("n").alias("count"))
