"""Filters as Columns, built from parameters; None or empty parameters filter nothing."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrain.functions.errors import ValidationError

#: Operators and patterns that never come from user input.
DANGEROUS_OPERATORS = frozenset((
    "$where", "$regex", "$expr", "$function", "$accumulator", "$let", "$reduce", "$map", "$filter", "$lookup", "$unionWith", "$out", "$merge",
    "$replaceRoot", "$addFields", "$project", "$match", "$group", "$sort", "$limit", "$skip", "$count", "$facet", "$bucket", "$bucketAuto",
    "$sortByCount",
))
DANGEROUS_PATTERNS = (r"\.\.", r"[\x00-\x1F\x7F-\x9F]", r"(?i)<script", r"(?i)javascript:")
#: Fields that a query may name.
ALLOWED_FIELDS = frozenset((
    "patient_id", "first_name", "last_name", "city", "state", "address.city", "address.state", "birth_date", "gender", "medication_name",
    "condition_name", "insurance_provider", "claim_amount", "procedure_name", "observation_type", "test_name", "value", "unit", "prescribed_date",
    "performed_date", "administration_date", "onset_date", "status", "verification_status", "severity", "encounter_type", "visit_reason", "location",
    "provider", "drug_name", "therapeutic_class", "drug_class", "drug_subclass", "rxcui", "ingredient_rxcui", "group_by", "min_count", "limit",
))
#: State names and their codes.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}


def equals(field: str, value) -> Column | None:
    return None if value is None else F.col(field) == value


def contains(field: str, text: str | None, ignore_case: bool = True) -> Column | None:
    """The unescaped pattern occurs anywhere; letters match in either case, accented ones too."""
    return F.col(field).rlike(("(?iu)" if ignore_case else "") + text) if text else None


def contains_literal(fields: list[str], term: str, case_sensitive: bool = False) -> Column:
    """The literal text occurs in one of the fields."""
    if case_sensitive:
        return reduce(lambda a, b: a | b, (F.col(f).contains(term) for f in fields))
    return reduce(lambda a, b: a | b, (F.lower(f).contains(term.lower()) for f in fields))


def one_of(field: str, values) -> Column | None:
    return F.col(field).isin(list(values)) if values else None


def parse_bound(value: str | None, end: bool = False) -> datetime | None:
    """An ISO date or time; a bad one is no bound. An end bound covers its whole day."""
    if not value:
        return None
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None
    return at.replace(hour=23, minute=59, second=59, microsecond=999999) if end else at


def date_range(field: str, start: str | None = None, end: str | None = None) -> Column | None:
    """Both ends inclusive, on a timestamp column, so that the bounds reach the scan."""
    low, high = parse_bound(start), parse_bound(end, end=True)
    parts = []
    if low is not None:
        parts.append(F.col(field) >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        parts.append(F.col(field) <= F.lit(high).cast("timestamp_ntz"))
    return all_of(*parts)


def string_range(field: str, start: str | None, end: str | None) -> Column | None:
    return all_of(None if start is None else F.col(field) >= start, None if end is None else F.col(field) <= end)


def number_range(field: str, low: float | None = None, high: float | None = None) -> Column | None:
    return all_of(None if low is None else F.col(field) >= low, None if high is None else F.col(field) <= high)


def year_range(field: str, year: int, month: int | None = None) -> Column:
    """year(field) = year (and month) written as a range that a scan can use."""
    first = datetime(year, month or 1, 1)
    after = datetime(year + 1, 1, 1) if month in (None, 12) else datetime(year, month + 1, 1)
    return (F.col(field) >= F.lit(first).cast("timestamp_ntz")) & (F.col(field) < F.lit(after).cast("timestamp_ntz"))


def all_of(*filters: Column | None) -> Column | None:
    """The conjunction of the filters that are there."""
    found = [f for f in filters if f is not None]
    return reduce(and_, found) if found else None


def apply(df, *filters: Column | None):
    both = all_of(*filters)
    return df if both is None else df.where(both)


def normalize_state(state: str) -> str:
    """A state's code; two letters in upper case; anything else unchanged."""
    name = state.strip()
    return STATE_CODES.get(name.lower(), name.upper() if len(name) == 2 else state)


def patient_search(first_name=None, last_name=None, patient_id=None, city=None, state=None, birth_date_start=None, birth_date_end=None, gender=None, race=None) -> Column | None:
    return all_of(
        contains("first_name", first_name), contains("last_name", last_name), equals("patient_id", patient_id), contains("city", city),
        F.col("state").rlike("(?iu)^" + re.escape(normalize_state(state)) + "$") if state else None,
        string_range("birth_date", birth_date_start, birth_date_end), equals("gender", gender), contains("race", race),
    )


#: Name -> (required parameters, optional ones, filter).
PATTERNS = {
    "active_conditions": ([], ["patient_id", "condition_type"], lambda p: all_of(F.col("status") == "active", equals("patient_id", p.get("patient_id")), equals("condition_name", p.get("condition_type")))),
    "patient_medications": (["patient_id"], ["status"], lambda p: all_of(equals("patient_id", p["patient_id"]), equals("status", p.get("status")))),
    "date_range": (["date_field", "start_date", "end_date"], [], lambda p: string_range(p["date_field"], p["start_date"], p["end_date"])),
    "text_search": (["search_term"], ["field1", "field2"], lambda p: contains_literal([p[f] for f in ("field1", "field2") if p.get(f)] or ["text"], p["search_term"])),
    "recent_encounters": (["patient_id", "date_threshold"], [], lambda p: all_of(equals("patient_id", p["patient_id"]), F.col("start_date") >= p["date_threshold"])),
    "lab_results": (["patient_id"], ["date_range"], lambda p: all_of(equals("patient_id", p["patient_id"]), F.col("observation_type") == "lab_result", F.col("status") == "final")),
    "patient_demographics": ([], ["gender", "age_range", "state"], lambda p: all_of(equals("gender", p.get("gender")), equals("age_range", p.get("age_range")), equals("state", p.get("state")))),
}


def pattern(name: str, params: dict) -> Column | None:
    """A named filter with its parameters put in."""
    if name not in PATTERNS:
        raise ValidationError(f"unknown pattern {name}; known: {', '.join(PATTERNS)}")
    required, _, build = PATTERNS[name]
    if missing := [p for p in required if not params.get(p)]:
        raise ValidationError(f"{name} needs {', '.join(missing)}")
    return build(params)


def validate_params(params: dict, most: int = 500) -> dict:
    """Drop None and unknown fields, refuse operators and dangerous text, shorten long strings."""

    def clean(value):
        if isinstance(value, dict):
            if bad := DANGEROUS_OPERATORS & set(value):
                raise ValidationError(f"operators not allowed: {', '.join(sorted(bad))}")
            return {k: clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, str):
            if any(re.search(p, value) for p in DANGEROUS_PATTERNS):
                raise ValidationError("text holds a dangerous pattern")
            return value[:most]
        return value

    if bad := DANGEROUS_OPERATORS & set(params):
        raise ValidationError(f"operators not allowed: {', '.join(sorted(bad))}")
    return {k: clean(v) for k, v in params.items() if v is not None and k in ALLOWED_FIELDS}


def validate_patient_id(value: str) -> str:
    if not re.fullmatch(r"[a-zA-Z0-9\-_]{1,100}", value or ""):
        raise ValidationError("a patient id has up to 100 letters, digits, - and _")
    return value


def validate_name(value: str) -> str:
    if not re.fullmatch(r"[a-zA-Z0-9\s\-']{1,100}", value or ""):
        raise ValidationError("a name has up to 100 letters, digits, spaces, - and '")
    return value


def validate_limit(limit: int, most: int = 500) -> int:
    if limit < 1:
        raise ValidationError("a limit is at least 1")
    return min(limit, most)


def validate_dates(start: str | None, end: str | None) -> None:
    for d in (start, end):
        if d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
            raise ValidationError("dates are YYYY-MM-DD")
        if d is not None:
            try:
                datetime.fromisoformat(d)
            except ValueError as e:
                raise ValidationError(f"no such day: {d}") from e
    if start and end and start > end:
        raise ValidationError("the start lies behind the end")


def query_depth(query) -> int:
    """Nesting of a query; a plain value has none."""
    inner = query.values() if isinstance(query, dict) else query if isinstance(query, list) else ()
    return 1 + max(map(query_depth, inner), default=0) if isinstance(query, (dict, list)) else 0


def validate_depth(query, most: int = 10) -> int:
    if (depth := query_depth(query)) > most:
        raise ValidationError(f"query depth {depth} exceeds {most}")
    return depth
