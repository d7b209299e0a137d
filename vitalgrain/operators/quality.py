"""Quality rules as Columns of findings, profiles, and content-hash dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import scalars as S
from vitalgrain.operators.joins import orphans
from vitalgrain.operators.sketches import distinct_up_to

Rule = Callable[[], Column]


def _finding(rule: str, field: str, message: str, severity: str = "error") -> Column:
    return F.struct(F.lit(rule).alias("rule_name"), F.lit(severity).alias("severity"), F.lit(field).alias("field_name"), F.lit(message).alias("message"))


def completeness(name: str, fields: list[str], allow_empty: bool = False) -> Column:
    """A finding per required field that is missing, or blank if that isn't allowed."""
    checks = []
    for f in fields:
        check = F.when(F.col(f).isNull(), _finding(name, f, "missing"))
        checks.append(check if allow_empty else check.when(F.trim(F.col(f).cast("string")) == "", _finding(name, f, "blank")))
    return F.array_compact(F.array(*checks))


def format_rule(name: str, field: str, pattern: str | None = None, low: int | None = None, high: int | None = None) -> Column:
    """Pattern from the start, and length; null passes."""
    text, checks = F.col(field).cast("string"), []
    if pattern:
        checks.append(F.when(~text.rlike("^(?:" + pattern.removeprefix("^") + ")"), _finding(name, field, "pattern")))
    if low is not None:
        checks.append(F.when(F.length(text) < low, _finding(name, field, "too short")))
    if high is not None:
        checks.append(F.when(F.length(text) > high, _finding(name, field, "too long")))
    return F.array_compact(F.array(*checks))


def date_consistency(name: str, fields: list[str], as_of: str) -> Column:
    """Dates that can't be read, lie ahead or too far back; null and blank pass."""
    checks = []
    for f in fields:
        text = S.blank_to_null(F.col(f).cast("string"))
        odd = S.implausible_date(S.parse_time(text), as_of)
        checks.append(
            F.when(text.isNotNull() & S.parse_time(text).isNull(), _finding(name, f, "no date", "warning"))
            .when(odd == "future", _finding(name, f, "in the future"))
            .when(odd == "too_old", _finding(name, f, "too old", "warning"))
        )
    return F.array_compact(F.array(*checks))


def default_rules(as_of: str) -> dict[str, list[Column]]:
    """Row rules per table; references are checked apart by ``reference_findings``."""
    return {
        "patients": [
            completeness("patient_required_fields", ["patient_id", "first_name", "last_name", "birth_date", "gender"]),
            date_consistency("patient_date_consistency", ["birth_date"], as_of),
            format_rule("patient_name_format", "first_name", low=1, high=50),
            format_rule("patient_gender_format", "gender", "^(male|female|other|unknown)$"),
        ],
        "conditions": [completeness("condition_required_fields", ["patient_id", "condition_name", "status"])],
        "observations": [completeness("observation_required_fields", ["patient_id", "test_name", "value", "unit", "test_date"])],
        "medications": [completeness("medication_required_fields", ["patient_id", "medication_name", "status"])],
    }


def validate(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Adds the findings of all rules; one pass, nothing but expressions."""
    return df.withColumn("findings", F.concat(*rules))


def reference_findings(df: DataFrame, patients: DataFrame, name: str) -> DataFrame:
    return orphans(df, patients, "patient_id", "patient_id").select("patient_id", _finding(name, "patient_id", "no such patient").alias("finding"))


def score(validated: DataFrame) -> DataFrame:
    """Share of rows without a finding; 100 for no rows."""
    fine = F.count_if(F.size("findings") == 0)
    return validated.agg(F.count("*").alias("total"), fine.alias("valid"), F.round(F.coalesce(F.avg(F.when(F.size("findings") == 0, 100.0).otherwise(0.0)), F.lit(100.0)), 4).alias("quality_score"))


def summary(validated: DataFrame, by: str = "rule_name") -> DataFrame:
    return validated.select(F.explode("findings").alias("f")).groupBy(F.col(f"f.{by}").alias(by)).agg(F.count("*").alias("count"))


def profile(df: DataFrame, columns: list[str], most: int = 100) -> DataFrame:
    """Per column: rows, completeness, nulls, blanks and distinct values up to a bound; one scan, a row per task is shuffled."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        aggs.append(F.struct(F.count_if(text.isNull()).alias("nulls"), F.count_if(F.trim(text) == "").alias("blanks"), distinct_up_to(text, most).alias("values")).alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col("n").alias("rows"), F.col(f"c{i}.nulls").alias("nulls"), F.col(f"c{i}.blanks").alias("blanks"), F.col(f"c{i}.values").alias("distinct_values")) for i, c in enumerate(columns)))
    found = one.select(F.explode(rows).alias("p")).select("p.*")
    return found.withColumn("completeness", S.percentage(F.col("rows") - F.col("nulls") - F.col("blanks"), F.col("rows")))


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(F.sha2(F.to_json(F.struct(*columns)), 256))).alias("duplicates"))


def type_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column and type of the values found, null included."""
    kinds = dict(df.dtypes)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNull(), "null").otherwise(kinds[c]).alias("type")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.type").agg(F.count("*").alias("count"))


#: The fields that tell duplicates, per table.
DEDUP_FIELDS = {
    "patients": ["first_name", "last_name", "birth_date"],
    "conditions": ["patient_id", "condition_name"],
    "observations": ["patient_id", "test_name", "test_date"],
    "medications": ["patient_id", "medication_name", "prescribed_date"],
    "encounters": ["patient_id", "start_date"],
}


def hashed(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("content_hash", S.content_hash(fields))


def duplicate_groups(df: DataFrame, fields: list[str], key: str, limit: int | None = None) -> DataFrame:
    """Hashes of several rows with their count and first key."""
    found = hashed(df, fields).groupBy("content_hash").agg(F.count("*").alias("count"), F.min(key).alias("original")).where("count > 1").orderBy(F.desc("count"), "content_hash")
    return found if limit is None else found.limit(limit)


def keep(df: DataFrame, fields: list[str], key: str, strategy: str = "first", at: str | None = None) -> DataFrame:
    """One row per content: first or last by key, newest or oldest by time (missing times last, then by key).

    An aggregate rather than a window, so that copies are reduced before they are shuffled.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(0)
    order = {"newest": F.struct(F.coalesce(-micros, F.lit(2**63 - 1)), F.col(key)), "oldest": F.struct(F.coalesce(micros, F.lit(2**63 - 1)), F.col(key))}.get(strategy, F.struct(F.col(key)))
    pick = F.max_by if strategy == "last" else F.min_by
    return hashed(df, fields).groupBy("content_hash").agg(pick(F.struct(*df.columns), order).alias("r")).select("r.*", "content_hash")


def split(df: DataFrame, fields: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(originals, duplicates): of each content the row of the smallest key, and the others."""
    named = hashed(df, fields)
    first = named.groupBy("content_hash").agg(F.min(key).alias(key))
    return named.join(first, ["content_hash", key], "left_semi"), named.join(first, ["content_hash", key], "left_anti")


def dedup_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, contents, groups of several and rows beyond the first; sums before any shuffle of rows."""
    groups = hashed(df, fields).groupBy("content_hash").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"))


def unknown_only(new: DataFrame, known: DataFrame, fields: list[str]) -> DataFrame:
    """The new rows whose content isn't known."""
    return hashed(new, fields).join(known.select("content_hash").distinct(), "content_hash", "left_anti")
