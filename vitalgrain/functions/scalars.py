"""Scalar functions on Columns: text, dates, numbers, arrays, JSON and hashes. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as both Java and RE2 see it.
SPACE = r"[ \t\n\r\f]+"
#: Words in a test's name that make it a vital sign.
VITAL_WORDS = ("blood pressure", "heart rate", "temperature", "weight", "height", "bmi", "respiratory rate", "oxygen")
#: Hosts and prefixes of terminologies, which are no medical text.
CODE_PREFIXES = ("http://", "https://", "urn:")
CODE_HOSTS = ("snomed.info", "loinc.org", "hl7.org", "terminology.")
#: The shapes of e-mail addresses, ids and names, the longest id or name, and what a short session id shows as.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ID = r"^[a-zA-Z0-9\-_]+$"
NAME = r"^[a-zA-Z0-9 \t\n\r\f\-']+$"
LONGEST_NAME = 100
INVALID_SESSION = "[INVALID]"
#: Words in a function's name that tell its resource, in this order.
RESOURCE_WORDS = (("patient", "patient"), ("condition", "condition|diagnos"), ("medication", "medication|drug"), ("financial", "financial|billing|claim"), ("audit", "audit|log"))
#: Points of the complexity score, its least and most.
PHI_POINTS, AGGREGATE_POINTS, PROJECTION_POINTS, SMALL_LIMIT_POINTS = 2, 3, 1, -1
MOST_DEPTH_POINTS, MOST_STAGE_POINTS, SMALL_LIMIT, LEAST_SCORE, MOST_SCORE = 3, 3, 100, 0, 10
#: Code -> label of the clean layer; the empty key is the default.
LABELS = {
    "allergy_category": {"food": "food", "medication": "medication", "environment": "environment", "biologic": "biologic", "": "environment"},
    "criticality": {"low": "low", "high": "high", "unable-to-assess": "moderate", "": "moderate"},
    "condition_status": {"active": "active", "recurrence": "active", "relapse": "active", "inactive": "inactive", "remission": "inactive", "resolved": "resolved", "": "active"},
    "medication_status": {"active": "active", "completed": "completed", "stopped": "stopped", "on-hold": "active", "cancelled": "stopped", "entered-in-error": "stopped", "": "active"},
    "encounter_class": {"AMB": "ambulatory", "NONAC": "ambulatory", "EMER": "emergency", "IMP": "inpatient", "ACUTE": "inpatient", "VR": "virtual", "": "ambulatory"},
    "care_plan_status": {"active": "active", "completed": "inactive", "revoked": "inactive", "on-hold": "active", "": "active"},
    "allergy_status": {"active": "active", "inactive": "inactive", "resolved": "resolved", "": "active"},
    "gender": {"male": "male", "female": "female", "other": "other", "": "unknown"},
}


def label(kind: str, code: Column) -> Column:
    """The label of a code; unknown and missing codes get the default."""
    labels = dict(LABELS[kind])
    default = labels.pop("")
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(table, F.coalesce(code, F.lit(""))), F.lit(default))


def blank_to_null(text: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(text), F.lit(""))


def coding_text(code: Column, prefer_display: bool = True) -> Column:
    """The first coding's display, else the text, else empty; the other way round on request."""
    display, text = blank_to_null(F.get(code["coding"], F.lit(0))["display"]), blank_to_null(code["text"])
    return F.coalesce(*((display, text) if prefer_display else (text, display)), F.lit(""))


def reference_id(reference: Column) -> Column:
    """What follows urn:uuid:, else the last slash, else all of it."""
    return F.when(reference.contains("urn:uuid:"), F.substring_index(reference, "urn:uuid:", -1)).otherwise(F.substring_index(reference, "/", -1))


def display_text(reference: Column) -> Column:
    return F.trim(F.coalesce(reference["display"], F.lit("")))


def clean_text(text: Column) -> Column:
    """Without links and tags, with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, r"https?://[^ \t\n\r\f]+", ""), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def decode_base64(text: Column) -> Column:
    """The UTF-8 text behind base64 without its bad bytes; empty where it isn't base64."""
    raw = F.try_to_binary(text, F.lit("base64")).cast("string")
    return F.coalesce(F.translate(F.make_valid_utf8(raw), "�", ""), F.lit(""))


def medically_relevant(text: Column) -> Column:
    """At least three characters, no bare code, no link and no terminology address."""
    no_prefix = reduce(lambda a, b: a & b, (~text.startswith(p) for p in CODE_PREFIXES))
    no_host = reduce(lambda a, b: a & b, (~text.contains(h) for h in CODE_HOSTS))
    return F.coalesce((F.length(text) >= 3) & ~text.rlike(r"^[A-Z0-9\-_]+$") & no_prefix & no_host, F.lit(False))


def observation_type(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(VITAL_WORDS)), "vital_sign").otherwise("lab_result")


def collapse_lower(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def mask_value(text: Column) -> Column:
    """ab***yz for more than four characters."""
    return F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 2), F.lit("***"), F.substring(text, -2, 2))).otherwise(text)


def mask_session(text: Column) -> Column:
    return F.when(F.length(text) >= 8, F.concat(F.substring(text, 1, 4), F.lit("..."), F.substring(text, -4, 4))).otherwise(INVALID_SESSION)


def fallback_id(patient_id: Column, row_id: Column) -> Column:
    return F.coalesce(blank_to_null(patient_id), row_id)


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a value; null values are empty."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def state_code(state: Column) -> Column:
    """As ``filters.normalize_state``, for a column."""
    from vitalgrain.functions.filters import STATE_CODES

    table, name = F.create_map(*(F.lit(x) for pair in STATE_CODES.items() for x in pair)), F.trim(state)
    return F.coalesce(F.element_at(table, F.lower(name)), F.when(F.length(name) == 2, F.upper(name)).otherwise(state))


def shorten(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def dangerous(text: Column) -> Column:
    from vitalgrain.functions.filters import DANGEROUS_PATTERNS

    return reduce(lambda a, b: a | b, (text.rlike(p) for p in DANGEROUS_PATTERNS))


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def is_id(text: Column) -> Column:
    return text.rlike(ID) & (F.length(text) <= LONGEST_NAME)


def is_name(text: Column) -> Column:
    return text.rlike(NAME) & (F.length(text) <= LONGEST_NAME)


def resource_type_of(name: Column) -> Column:
    """The kind of resource that a function's name speaks of; the first that fits."""
    low, out = F.lower(name), F
    for kind, words in RESOURCE_WORDS:
        out = out.when(low.rlike(words), kind)
    return out.otherwise("unknown")


def parse_time(text: Column) -> Column:
    """ISO text, also with Z or an offset, as a time; null where it is none."""
    return F.try_to_timestamp(text)


def end_of_day(at: Column) -> Column:
    return F.date_trunc("day", at) + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59.999999))


def implausible_date(at: Column, as_of: str) -> Column:
    """More than a day ahead of as_of, or over 150 years behind."""
    now = F.to_timestamp(F.lit(as_of))
    return F.when(at > now + F.expr("INTERVAL 1 DAY"), "future").when(at < now - F.expr(f"INTERVAL {150 * 365} DAYS"), "too_old")


def period(at: Column, unit: str) -> Column:
    """The first day of the day, week, month, quarter or year, as a string."""
    return F.date_trunc(unit, at).cast("date").cast("string")


def birth_year(birth_date: Column) -> Column:
    return F.substring(birth_date, 1, 4)


def age(birth_date: Column, as_of: str) -> Column:
    """Whole years at as_of."""
    return F.floor(F.months_between(F.to_date(F.lit(as_of)), F.try_to_timestamp(birth_date).cast("date")) / 12).cast("int")


def _age_group(years: Column, *edges: int) -> Column:
    out = F.when(years.isNull(), "unknown")
    low = 0
    for edge in edges:
        out = out.when(years < edge, f"{low}-{edge - 1}")
        low = edge
    return out.otherwise(f"{low}+")


def age_group(years: Column) -> Column:
    return _age_group(years, 18, 35, 55, 75)


def age_group_private(years: Column) -> Column:
    return _age_group(years, 18, 30, 50, 70)


def percentage(part: Column, whole: Column) -> Column:
    """Rounded to two places within 0 and 100; 0 of nothing."""
    share = F.round(F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole), 2)
    return F.greatest(F.least(share, F.lit(100.0)), F.lit(0.0))


def backoff(strategy: str, base: float, attempt: Column, most: float = 60.0) -> Column:
    """Seconds before the next try."""
    wait = {"immediate": F.lit(0.0), "linear": base * (attempt + 1), "exponential": base * F.pow(F.lit(2.0), attempt)}[strategy]
    return F.least(wait.cast("double"), F.lit(most))


def dlq_delay(retries: Column) -> Column:
    return F.lit(300.0) * F.pow(F.lit(2.0), retries)


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def map_or_null(items: Column, test, make) -> Column:
    """The elements that pass, each made anew; null where none is left."""
    found = F.transform(F.filter(items, test), make)
    return F.when(F.size(found) > 0, found)


def json_text(document: Column, path: str, default: str | None = None) -> Column:
    """The text at a path; empty and null count as missing."""
    return F.coalesce(F.nullif(F.get_json_object(document, path), F.lit("")), F.lit(default))


def content_hash(fields: list[str]) -> Column:
    """Hash of the fields that aren't null, in order of their names, without case and extra spaces."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f.lower()}:"), collapse_lower(F.col(f).cast("string")))) for f in fields]
    return F.sha2(F.concat_ws("|", F.sort_array(F.array_compact(F.array(*parts)))), 256)


def complexity_score(contains_phi: Column, depth: Column, query_type: Column, stages: Column, has_projection: Column, limit: Column) -> Column:
    """0 to 10: personal data, nesting, stages and projection add to it, a small limit takes from it."""
    aggregate = query_type == "aggregate"
    score = (
        F.when(contains_phi, PHI_POINTS).otherwise(0)
        + F.least(depth, F.lit(MOST_DEPTH_POINTS))
        + F.when(aggregate, AGGREGATE_POINTS + F.least(F.coalesce(stages, F.lit(0)), F.lit(MOST_STAGE_POINTS))).otherwise(0)
        + F.when(has_projection, PROJECTION_POINTS).otherwise(0)
        + F.when((limit > 0) & (limit < SMALL_LIMIT), SMALL_LIMIT_POINTS).otherwise(0)
    )
    return F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(MOST_SCORE), score)).cast("int")
