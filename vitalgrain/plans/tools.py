"""The domain tools: parameters in, one DataFrame plan out.

``get_*`` tools filter, project and take the newest rows; ``analyze_*`` tools group. Both kinds are
described by data, so that each tool is one line; anything of more shape has a function of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import filters as L
from vitalgrain.functions import scalars as S
from vitalgrain.functions.errors import ValidationError
from vitalgrain.operators import analytics as A


@dataclass(frozen=True)
class Get:
    """A record tool: filters by parameter name, output columns, and its time column."""

    entity: str
    key: str
    at: str
    columns: tuple[str, ...]
    equal: dict[str, str] = field(default_factory=dict)
    contain: dict[str, str] = field(default_factory=dict)
    listed: dict[str, str] = field(default_factory=dict)
    range_: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # kind -> (column, low parameter, high parameter)
    limit: int = 50


@dataclass(frozen=True)
class Analyze:
    """A pattern tool: what it can be grouped by, its filters and an optional figure."""

    entity: str
    at: str
    groups: dict[str, str]
    equal: dict[str, str] = field(default_factory=dict)
    contain: dict[str, str] = field(default_factory=dict)
    value: str | None = None
    limit: int = 20


def _filters(spec, params: dict) -> list[Column | None]:
    out = [L.equals(c, params.get(p)) for p, c in spec.equal.items()] + [L.contains(c, params.get(p)) for p, c in spec.contain.items()]
    if isinstance(spec, Get):
        out += [L.one_of(c, params.get(p)) for p, c in spec.listed.items()]
        for kind, (c, low, high) in spec.range_.items():
            out.append((L.date_range if kind.startswith("date") else L.number_range)(c, params.get(low), params.get(high)))
    return out


def get(spec: Get, df: DataFrame, ascending: bool = False, limit: int | None = None, **params) -> DataFrame:
    rows = L.apply(df, *_filters(spec, params))
    order = [F.asc_nulls_last(spec.at) if ascending else F.desc_nulls_last(spec.at), F.asc(spec.key)]
    return rows.orderBy(*order).limit(L.validate_limit(spec.limit if limit is None else limit)).select(*spec.columns)


def group_column(spec: Analyze, by: str) -> Column:
    """A column, or the period of the time column for time_period, day, week, month, quarter and year."""
    if by in spec.groups:
        return F.col(spec.groups[by])
    unit = {"time_period": "month"}.get(by, by)
    if unit not in ("day", "week", "month", "quarter", "year"):
        raise ValidationError(f"can't group by {by}; use {', '.join(spec.groups)} or a period")
    return S.period(F.col(spec.at), unit)


def analyze(spec: Analyze, df: DataFrame, group_by: str, limit: int | None = None, min_count: int = 1, **params) -> DataFrame:
    rows = L.apply(df, *_filters(spec, params))
    return A.pattern_counts(rows, group_column(spec, group_by), limit=spec.limit if limit is None else limit, min_count=min_count, value=spec.value)


PATIENT = {"patient_id": "patient_id"}
GETS = {
    "get_patient_allergies": Get("allergies", "source_fhir_id", "recorded_ts", ("source_fhir_id", "patient_id", "allergy_name", "category", "severity", "status", "recorded_date"), PATIENT | {"category": "category", "severity": "severity", "status": "status"}, {"allergy_name": "allergy_name"}, {}, {"date": ("recorded_ts", "recorded_date_start", "recorded_date_end")}),
    "get_patient_conditions": Get("conditions", "source_fhir_id", "onset_ts", ("source_fhir_id", "patient_id", "condition_name", "status", "verification_status", "onset_date"), PATIENT | {"status": "status", "verification_status": "verification_status"}, {"condition_name": "condition_name"}, {}, {"date": ("onset_ts", "onset_date_start", "onset_date_end"), "date2": ("recorded_ts", "recorded_date_start", "recorded_date_end")}),
    "get_patient_immunizations": Get("immunizations", "source_fhir_id", "administration_ts", ("source_fhir_id", "patient_id", "vaccine_name", "status", "location", "administration_date"), PATIENT | {"status": "status"}, {"vaccine_name": "vaccine_name", "location": "location"}, {}, {"date": ("administration_ts", "administration_date_start", "administration_date_end")}),
    "get_vaccine_history": Get("immunizations", "source_fhir_id", "administration_ts", ("source_fhir_id", "patient_id", "vaccine_name", "administration_date"), PATIENT, {}, {"vaccine_types": "vaccine_name"}, {}, 100),
    "get_patient_observations": Get("observations", "source_fhir_id", "test_ts", ("source_fhir_id", "patient_id", "test_name", "value", "unit", "status", "test_date"), PATIENT | {"observation_type": "observation_type", "status": "status", "unit": "unit"}, {"test_name": "test_name"}, {}, {"date": ("test_ts", "test_date_start", "test_date_end"), "number": ("value", "value_min", "value_max")}),
    "get_patient_procedures": Get("procedures", "source_fhir_id", "performed_ts", ("source_fhir_id", "patient_id", "procedure_name", "status", "location", "performed_date"), PATIENT | {"status": "status", "procedure_category": "procedure_category"}, {"procedure_name": "procedure_name", "location": "location"}, {}, {"date": ("performed_ts", "performed_date_start", "performed_date_end")}),
    "get_procedure_history": Get("procedures", "source_fhir_id", "performed_ts", ("source_fhir_id", "patient_id", "procedure_name", "performed_date", "outcome"), PATIENT, {}, {"procedure_types": "procedure_name"}, {"date": ("performed_ts", "performed_date_start", "performed_date_end")}, 100),
    "get_patient_encounters": Get("encounters", "source_fhir_id", "start_ts", ("source_fhir_id", "patient_id", "encounter_type", "visit_reason", "status", "provider", "location", "start_date"), PATIENT | {"encounter_type": "encounter_type", "status": "status"}, {"location": "location", "provider": "provider", "visit_reason": "visit_reason"}, {}, {"date": ("start_ts", "start_date", "end_date")}),
    "get_encounter_history": Get("encounters", "source_fhir_id", "start_ts", ("source_fhir_id", "patient_id", "encounter_type", "visit_reason", "start_date"), PATIENT, {}, {"encounter_types": "encounter_type"}, {"date": ("start_ts", "start_date", "end_date")}, 100),
    "get_provider_encounters": Get("encounters", "source_fhir_id", "start_ts", ("source_fhir_id", "patient_id", "provider", "encounter_type", "status", "start_date"), PATIENT | {"encounter_type": "encounter_type", "status": "status"}, {"provider": "provider"}, {}, {"date": ("start_ts", "start_date", "end_date")}),
    "get_patient_claims": Get("claims", "claim_id", "billable_ts", ("claim_id", "patient_id", "insurance_display", "facility_display", "status", "total_value", "billable_period_start"), PATIENT | {"status": "status"}, {"insurance_provider": "insurance_display", "facility": "facility_display"}, {}, {"date": ("billable_ts", "billable_start_date", "billable_end_date"), "number": ("total_value", "min_amount", "max_amount")}),
    "get_patient_eobs": Get("eobs", "eob_id", "billable_ts", ("eob_id", "patient_id", "insurer_display", "outcome", "status", "total_submitted_value", "billable_period_start"), PATIENT | {"status": "status", "outcome": "outcome"}, {"insurer": "insurer_display", "facility": "facility_display"}, {}, {"date": ("billable_ts", "billable_start_date", "billable_end_date"), "number": ("total_submitted_value", "min_submitted_amount", "max_submitted_amount")}),
    "get_lab_results": Get("observations", "source_fhir_id", "test_ts", ("source_fhir_id", "patient_id", "test_name", "value", "unit", "test_date"), PATIENT | {"status": "status", "observation_type": "observation_type"}, {}, {"lab_test_names": "test_name"}, {"date": ("test_ts", "test_date_start", "test_date_end")}),
    "get_patient_care_plans": Get("care_plans", "source_fhir_id", "start_ts", ("source_fhir_id", "patient_id", "plan_name", "status", "start_date"), PATIENT | {"status": "status"}, {"plan_name": "plan_name"}, {}, {"date": ("start_ts", "period_start", "period_end")}),
}
ANALYSES = {
    "analyze_allergy_patterns": Analyze("allergies", "recorded_ts", {"allergy": "allergy_name", "category": "category", "severity": "severity", "status": "status"}, PATIENT),
    "analyze_condition_patterns": Analyze("conditions", "onset_ts", {"condition": "condition_name", "status": "status", "verification_status": "verification_status"}, PATIENT | {"status": "status"}, {"condition_name": "condition_name"}),
    "analyze_immunization_patterns": Analyze("immunizations", "administration_ts", {"vaccine": "vaccine_name", "status": "status", "location": "location"}, PATIENT | {"status": "status"}, {"vaccine_name": "vaccine_name"}),
    "analyze_observation_patterns": Analyze("observations", "test_ts", {"test_name": "test_name", "observation_type": "observation_type", "unit": "unit"}, PATIENT | {"status": "status", "observation_type": "observation_type"}, {"test_name": "test_name"}, "value"),
    "analyze_procedure_patterns": Analyze("procedures", "performed_ts", {"procedure_name": "procedure_name", "status": "status", "location": "location"}, PATIENT | {"status": "status", "procedure_category": "procedure_category"}),
    "analyze_encounter_patterns": Analyze("encounters", "start_ts", {"encounter_type": "encounter_type", "status": "status", "location": "location", "provider": "provider"}, PATIENT | {"status": "status", "encounter_type": "encounter_type"}),
    "analyze_visit_reasons": Analyze("encounters", "start_ts", {"visit_reason": "visit_reason"}, PATIENT | {"encounter_type": "encounter_type"}, {}, None, 25),
    "analyze_claims_patterns": Analyze("claims", "billable_ts", {"insurance": "insurance_display", "facility": "facility_display", "status": "status"}, PATIENT | {"status": "status"}, {"insurance_provider": "insurance_display", "facility": "facility_display"}, "total_value"),
    "analyze_insurance_utilization": Analyze("claims", "billable_ts", {"insurance": "insurance_display"}, {}, {"insurance_provider": "insurance_display"}, "total_value", 25),
    "calculate_claim_totals": Analyze("claims", "billable_ts", {"patient": "patient_id", "insurance": "insurance_display", "facility": "facility_display"}, PATIENT, {"insurance_provider": "insurance_display", "facility": "facility_display"}, "total_value"),
    "analyze_eob_patterns": Analyze("eobs", "billable_ts", {"insurer": "insurer_display", "facility": "facility_display", "outcome": "outcome", "status": "status"}, PATIENT | {"outcome": "outcome"}, {"insurer": "insurer_display", "facility": "facility_display"}, "total_submitted_value"),
    "calculate_eob_totals": Analyze("eobs", "billable_ts", {"patient": "patient_id", "insurer": "insurer_display", "facility": "facility_display"}, PATIENT, {"insurer": "insurer_display", "facility": "facility_display"}, "adjudicated_value"),
    "get_procedure_statistics": Analyze("procedures", "performed_ts", {}, {"procedure_category": "procedure_category", "location": "location"}),
}


# ---- tools with a shape of their own ----
def search_patients(patients: DataFrame, role: str = "admin", limit: int = 20, **params) -> DataFrame:
    from vitalgrain.operators.governance import mask_search

    found = L.apply(patients, L.patient_search(**params)).select("patient_id", "first_name", "last_name", "birth_date", "gender", "city", "state")
    return mask_search(found.orderBy("patient_id").limit(L.validate_limit(limit)), role)


def search_drugs(drugs: DataFrame, drug_name=None, therapeutic_class=None, drug_class=None, drug_subclass=None, rxcui=None, limit: int = 50) -> DataFrame:
    found = L.apply(
        drugs, L.contains("primary_drug_name", drug_name), L.contains("therapeutic_class_l2", therapeutic_class), L.contains("drug_class_l3", drug_class),
        L.contains("drug_subclass_l4", drug_subclass), L.equals("ingredient_rxcui", rxcui),
    )
    return found.orderBy("primary_drug_name", "ingredient_rxcui").limit(L.validate_limit(limit))


def medication_history(medications: DataFrame, drugs: DataFrame, patient_id=None, medication_name=None, drug_class=None, status=None, prescribed_date_start=None, limit: int = 50) -> DataFrame:
    """Newest first; the limit comes before the join unless a drug class decides which rows stay."""
    from vitalgrain.operators.joins import enrich_medications

    rows = L.apply(medications, L.equals("patient_id", patient_id), L.contains("medication_name", medication_name), L.equals("status", status), L.date_range("prescribed_ts", prescribed_date_start))
    order = [F.desc("prescribed_ts"), F.asc("source_fhir_id")]
    if not drug_class:
        rows = rows.orderBy(*order).limit(limit)
    out = enrich_medications(rows, drugs)
    out = L.apply(out, L.contains("drug.drug_class_l3", drug_class)).orderBy(*order).limit(L.validate_limit(limit))
    return out.select("source_fhir_id", "patient_id", "medication_name", "status", "prescribed_date", "prescriber", F.col("drug.ingredient_rxcui").alias("rxcui"), F.col("drug.therapeutic_class_l2").alias("therapeutic_class"), F.col("drug.drug_class_l3").alias("drug_class"))


def reports(df: DataFrame, search_text=None, patient_id=None, report_type=None, start=None, end=None, limit: int = 50) -> DataFrame:
    rows = L.apply(df, L.contains("clinical_summary", search_text), L.equals("patient_id", patient_id), L.contains("report_type", report_type), L.string_range("report_date", start, end))
    return rows.orderBy(F.desc("report_date"), "source_fhir_id").limit(L.validate_limit(limit)).select("source_fhir_id", "patient_id", "report_type", "report_date", F.length("clinical_summary").cast("long").alias("summary_chars"))


def condition_details(conditions: DataFrame, condition_id: str, include_similar: bool = False, limit: int = 10) -> DataFrame:
    """A condition, and on request others of its name."""
    own = conditions.where(F.col("source_fhir_id") == condition_id)
    out = own.select(F.lit("exact").alias("match"), "source_fhir_id", "patient_id", "condition_name", "onset_date")
    if not include_similar:
        return out
    name = own.select(F.col("condition_name").alias("n")).distinct()
    others = conditions.join(name, F.col("condition_name") == F.col("n"), "left_semi").where(F.col("source_fhir_id") != condition_id)
    return out.unionByName(others.orderBy("source_fhir_id").limit(limit).select(F.lit("similar").alias("match"), "source_fhir_id", "patient_id", "condition_name", "onset_date"))


def vital_signs(observations: DataFrame, patient_id: str | None = None, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Vital signs with the change from the one before of the same kind."""
    from pyspark.sql import Window

    rows = L.apply(observations, F.col("observation_type") == "vital_sign", L.equals("patient_id", patient_id), L.one_of("test_name", kinds))
    before = F.lag("value").over(Window.partitionBy("patient_id", "test_name").orderBy("test_ts", "source_fhir_id"))
    out = rows.withColumn("change", F.round(F.col("value") - before, 4))
    return out.orderBy(F.desc("test_ts"), "source_fhir_id").limit(limit).select("source_fhir_id", "patient_id", "test_name", "value", "test_date", "change")


def abnormal_labs(observations: DataFrame, limit: int = 50, z: float = 1.5) -> DataFrame:
    """Final lab results further than z standard deviations from their test's mean; the means are few rows."""
    labs = observations.where((F.col("observation_type") == "lab_result") & (F.col("status") == "final"))
    norms = labs.groupBy("test_name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    scored = labs.join(norms, "test_name").withColumn("z", F.round((F.col("value") - F.col("mean")) / F.col("sd"), 3))
    return scored.where(F.abs("z") > z).orderBy(F.desc("test_ts"), "source_fhir_id").limit(limit).select("source_fhir_id", "test_name", "value", "z")


def procedure_outcomes(procedures: DataFrame, period: str = "year", limit: int = 20) -> DataFrame:
    rate = lambda o: F.round(F.avg(F.when(F.col("outcome") == o, 100.0).otherwise(0.0)), 2)
    grouped = procedures.groupBy("procedure_name", S.period(F.col("performed_ts"), period).alias("period")).agg(F.count("*").alias("count"), rate("success").alias("success_rate"), rate("complication").alias("complication_rate"))
    return grouped.orderBy("procedure_name", "period").limit(limit)
