"""Role masks and de-identification as projections, so that masked columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vitalgrain.functions import scalars as S

#: Fields that any role may see, and those of each role; admin sees all.
METADATA = frozenset((
    "id", "_id", "resource_id", "source_id", "resource_type", "created_at", "updated_at", "timestamp", "version", "event_type", "event_date",
    "count", "total", "index",
))
ROLES = {
    "admin": None,
    "clinician": frozenset((
        "patient_id", "first_name", "last_name", "birth_date", "gender", "phone", "email", "address", "city", "state", "conditions", "medications",
        "allergies", "observations", "encounters", "procedures", "immunizations", "condition_name", "status", "onset_date", "severity",
        "medication_name", "prescriber", "dosage_instruction", "prescribed_date", "test_name", "value", "unit", "effective_date_time",
        "visit_reason", "location", "provider", "performed_date", "resource_type", "source_id", "event_date", "event_type", "event_name", "details",
    )),
    "researcher": frozenset((
        "gender", "birth_year", "city", "state", "condition_name", "medication_name", "test_name", "observation_type", "procedure_name", "year",
        "month", "age_group", "count", "average", "total", "percentage", "prevalence", "resource_type", "event_type",
    )),
    "billing": frozenset((
        "patient_id", "first_name", "last_name", "insurance_provider", "claim_amount", "charges", "total_amount", "billing_code", "diagnosis_codes",
        "procedure_codes", "condition_name", "procedure_name", "service_date", "billing_date", "resource_type", "claim_status",
    )),
    "read_only": frozenset((
        "patient_id", "first_name", "last_name", "birth_date", "gender", "city", "state", "condition_name", "status", "onset_date",
        "verification_status", "event_type", "event_date", "event_name", "source_id", "details", "resource_type",
    )),
}
#: Direct identifiers.
IDENTIFIERS = frozenset((
    "name", "first_name", "last_name", "full_name", "middle_name", "address", "street_address", "city", "state", "zip_code", "postal_code", "phone",
    "phone_number", "email", "email_address", "patient_id", "medical_record_number", "mrn", "account_number", "certificate_number",
    "vehicle_identifier", "device_identifier", "url", "ip_address", "biometric_identifier", "photo", "photograph", "fingerprint", "voiceprint",
    "iris_scan", "retina_scan", "ssn", "social_security", "social_security_number",
))
#: What a patient search hides from a role.
SEARCH_HIDDEN = {"billing": ["first_name", "last_name"], "researcher": ["patient_id", "city", "state"], "public": ["patient_id", "first_name", "last_name", "city", "state"]}
#: Tables with personal data (singular and plural).
PHI_TABLES = frozenset((
    "patient", "patients", "condition", "conditions", "medication", "medications", "observation", "observations", "encounter", "encounters",
    "care_plan", "care_plans", "diagnostic_report", "diagnostic_reports", "appointment", "appointments", "claim", "claims", "allergy", "allergies",
))
#: Permissions by role; admin has all.
PERMISSIONS = {
    "clinician": {"read_phi", "read_clinical"},
    "researcher": {"read_deidentified", "read_aggregates"},
    "billing": {"read_financial", "read_demographics"},
    "read_only": {"read_basic"},
}


def _allowed(name: str, role: str) -> bool:
    return name in ROLES[role] or name.lower() in METADATA


def _masked(c: Column, kind, role: str) -> Column | None:
    """A nested value with the allowed inner fields only; None if none is left."""
    if isinstance(kind, StructType):
        parts = [(f.name, _masked(c[f.name], f.dataType, role)) for f in kind.fields if _allowed(f.name, role)]
        parts = [p.alias(n) for n, p in parts if p is not None]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        if _masked(F.lit(None), kind.elementType, role) is None:
            return None
        return F.transform(c, lambda x: _masked(x, kind.elementType, role))
    return c


def mask(df: DataFrame, role: str) -> DataFrame:
    """The columns that the role may see; nested ones are cut by the same list."""
    if ROLES[role] is None:
        return df
    parts = [(f.name, _masked(F.col(f.name), f.dataType, role)) for f in df.schema.fields if _allowed(f.name, role)]
    return df.select(*(p.alias(n) for n, p in parts if p is not None))


def de_identify(df: DataFrame, as_of: str) -> DataFrame:
    """Without direct identifiers; the birth date becomes a year and an age group."""
    out = df
    if "birth_date" in df.columns:
        out = out.withColumn("birth_year", S.birth_year(F.col("birth_date"))).withColumn("age_group", S.age_group_private(S.age(F.col("birth_date"), as_of)))
    return out.drop("birth_date", *(c for c in out.columns if c in IDENTIFIERS))


def minimum_necessary(df: DataFrame, role: str, as_of: str) -> DataFrame:
    if role != "researcher":
        return mask(df, role)
    return mask(de_identify(df, as_of), role)


def mask_search(df: DataFrame, role: str) -> DataFrame:
    """Hidden columns become null, the rows stay."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in SEARCH_HIDDEN.get(role, []) if c in df.columns})


class ProjectionCache:
    """Columns per (role, table), worked out once; ``load`` puts in lists from a configuration."""

    def __init__(self):
        self.known: dict[tuple[str, str], list[str]] = {}

    def load(self, config: dict[str, dict[str, list[str]]]) -> None:
        """{role: {table: columns}}"""
        self.known |= {(role, table): list(columns) for role, tables in config.items() for table, columns in tables.items()}

    def apply(self, df: DataFrame, role: str, table: str) -> DataFrame:
        columns = self.known.setdefault((role, table), mask(df, role).columns)
        return df.select(*(c for c in columns if c in df.columns))


def has_permission(role: str, permission: str) -> bool:
    return role == "admin" or permission in PERMISSIONS.get(role, ())


def is_phi(table: Column) -> Column:
    return F.lower(table).isin(sorted(PHI_TABLES))


def audit_record(df: DataFrame, key: str, operation: str, role: str) -> DataFrame:
    """One row: how many results a call gave, and the first ten ids."""
    ids = df.select(key).distinct().orderBy(key).limit(10).agg(F.sort_array(F.collect_list(key)).alias("id_sample")).withColumn("_one", F.lit(1))
    counts = df.agg(F.count("*").alias("result_count")).withColumn("_one", F.lit(1))
    return counts.join(ids, "_one").select(F.lit(operation).alias("operation"), F.lit(role).alias("role"), "result_count", "id_sample")
