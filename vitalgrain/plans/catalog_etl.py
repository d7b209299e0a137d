"""Registry, second part: bundles and their transforms, drug classes, sinks, runtime helpers and validation.

Bundles are made from the star-schema tables as JSON text, one per patient, so that each transform has an
SQL twin over the tables themselves. Sinks write to a fresh shared folder and are read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.functions import errors
from vitalgrain.functions import filters as L
from vitalgrain.functions import scalars as S
from vitalgrain.operators import bloom, governance, joins, observe, quality, runtime, scans, sinks
from vitalgrain.operators.log_table import LogTable
from vitalgrain.operators.shared_cache import SharedCache
from vitalgrain.plans import pipeline
from vitalgrain.sources import drug_classes, fhir
from vitalgrain.sources.entities import entity, entity_sql, read_table
from vitalgrain.streaming.bounded import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, make: Callable, sql: str | None = None, entities: tuple[str, ...] = (), tables: tuple[str, ...] = ()) -> None:
    """Register a query: ``make`` takes the session, its entities and its tables as DataFrames, in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, *(entity(spark, sf_dir, e) for e in entities), *(read_table(spark, sf_dir, t) for t in tables))

    QUERIES[name] = run
    if sql:
        SQL[name] = (entity_sql(*entities) if entities else "") + sql


# ---- bundles ----
CODE = "named_struct('coding', array(named_struct('code', {code}, 'display', {display})), 'text', {text})"


def _code(display: str, text: str = "'spare text'", code: str = "'c'") -> str:
    return CODE.format(display=display, text=text, code=code)


#: Resource type -> SQL of (patient, resource) over the star-schema tables.
RESOURCES = {
    "AllergyIntolerance": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'AllergyIntolerance', 'id', CAST(o_orderkey AS STRING), 'code', {_code("CASE WHEN o_orderkey % 20 = 0 THEN 'ABC-1' ELSE 'allergen ' || CAST(o_orderkey % 20 AS STRING) END")},
        'category', CASE o_orderkey % 4 WHEN 0 THEN array('food') WHEN 1 THEN array('medication') WHEN 2 THEN array('weird') END, 'criticality', CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'unable-to-assess' END,
        'clinicalStatus', {_code("NULL", "NULL", "CASE WHEN o_orderstatus = 'F' THEN 'inactive' ELSE 'active' END")}, 'recordedDate', CAST(CAST(o_orderdate AS DATE) AS STRING), 'patient', named_struct('reference', 'urn:uuid:' || CAST(o_custkey AS STRING)))) AS resource FROM {{orders}}""",
    "Condition": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'Condition', 'id', CAST(o_orderkey AS STRING), 'code', {_code("CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END")}, 'clinicalStatus', {_code("NULL", "NULL", "CASE o_orderstatus WHEN 'F' THEN 'relapse' WHEN 'O' THEN 'remission' ELSE 'resolved' END")},
        'verificationStatus', CASE WHEN o_orderkey % 3 = 0 THEN {_code("NULL", "NULL", "'provisional'")} END, 'onsetDateTime', CAST(CAST(o_orderdate AS DATE) AS STRING), 'subject', named_struct('reference', 'Patient/' || CAST(o_custkey AS STRING)))) AS resource FROM {{orders}}""",
    "Observation": f"""SELECT user_id AS patient, to_json(named_struct('resourceType', 'Observation', 'id', CAST(event_id AS STRING), 'code', {_code("CASE WHEN event_id % 4 = 0 THEN 'Body Weight ' || event_type ELSE 'level of ' || event_type END")}, 'valueQuantity', CASE WHEN event_id % 5 <> 0 THEN named_struct('value', value, 'unit', 'kg') END,
        'effectiveDateTime', CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(ts AS DATE) AS STRING) END, 'issued', '2024-02-02', 'subject', named_struct('reference', 'urn:uuid:' || CAST(user_id AS STRING)))) AS resource FROM {{events}}""",
    "MedicationRequest": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'MedicationRequest', 'id', CAST(o_orderkey AS STRING), 'medicationCodeableConcept', CASE WHEN o_orderkey % 2 = 0 THEN {_code("'tablet ' || CAST(o_orderkey AS STRING)")} END, 'medicationReference', named_struct('display', ' syrup  '),
        'status', CASE o_orderstatus WHEN 'F' THEN 'on-hold' WHEN 'O' THEN 'stopped' END, 'authoredOn', CAST(CAST(o_orderdate AS DATE) AS STRING), 'requester', named_struct('display', o_clerk_or_none), 'subject', named_struct('reference', CAST(o_custkey AS STRING)))) AS resource
        FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS o_clerk_or_none FROM {{orders}})""",
    "Immunization": f"""SELECT user_id AS patient, to_json(named_struct('resourceType', 'Immunization', 'id', CAST(event_id AS STRING), 'vaccineCode', {_code("'vaccine ' || event_type")}, 'occurrenceDateTime', CAST(CAST(ts AS DATE) AS STRING), 'location', CASE WHEN event_id % 2 = 0 THEN named_struct('display', 'site A') END,
        'status', CASE WHEN event_id % 13 = 0 THEN 'not-done' END, 'patient', named_struct('reference', 'urn:uuid:' || CAST(user_id AS STRING)))) AS resource FROM {{events}}""",
    "Procedure": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'Procedure', 'id', CAST(o_orderkey AS STRING), 'code', {_code("NULL", "'step ' || lower(o_orderpriority)")}, 'performedPeriod', CASE WHEN o_orderkey % 2 = 0 THEN named_struct('start', CAST(CAST(o_orderdate AS DATE) AS STRING), 'end', '2020-01-01') END,
        'performedDateTime', '1999-09-09', 'subject', named_struct('reference', 'urn:uuid:' || CAST(o_custkey AS STRING)))) AS resource FROM {{orders}}""",
    "Encounter": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'Encounter', 'id', CAST(o_orderkey AS STRING), 'class', named_struct('code', CASE o_orderstatus WHEN 'F' THEN 'EMER' WHEN 'O' THEN 'VR' ELSE 'X' END), 'type', array({_code("lower(o_orderpriority)")}), 'period', named_struct('start', CAST(CAST(o_orderdate AS DATE) AS STRING)),
        'participant', array(named_struct('individual', named_struct('display', 'Dr. ' || CAST(o_orderkey % 9 AS STRING)))), 'subject', named_struct('reference', 'urn:uuid:' || CAST(o_custkey AS STRING)))) AS resource FROM {{orders}}""",
    "CarePlan": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'CarePlan', 'id', CAST(o_orderkey AS STRING), 'category', array({_code("'ABC-1'")}, {_code("'management of ' || lower(o_orderpriority)")}), 'status', CASE WHEN o_orderkey % 2 = 0 THEN 'revoked' ELSE 'on-hold' END,
        'activity', array(named_struct('detail', named_struct('code', {_code("'X-1'")}, 'status', CAST(NULL AS STRING))), named_struct('detail', named_struct('code', {_code("CASE WHEN o_orderkey % 6 = 0 THEN 'X-2' ELSE 'exercise ' || CAST(o_orderkey % 3 AS STRING) END")}, 'status', 'completed'))), 'period', named_struct('start', CAST(CAST(o_orderdate AS DATE) AS STRING)),
        'subject', named_struct('reference', 'urn:uuid:' || CAST(o_custkey AS STRING)))) AS resource FROM {{orders}}""",
    "Patient": """SELECT c_custkey AS patient, to_json(named_struct('resourceType', 'Patient', 'id', CAST(c_custkey AS STRING), 'name', array(named_struct('use', 'usual', 'given', array('Nick'), 'family', 'Name'), named_struct('use', 'official', 'given', CASE WHEN c_custkey % 10 = 0 THEN array('') ELSE array(c_name) END, 'family', c_mktsegment)),
        'birthDate', '1950-01-0' || CAST(1 + c_custkey % 9 AS STRING), 'gender', CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'nonsense' END, 'address', array(named_struct('line', array('1 Main', 'Apt ' || CAST(c_custkey AS STRING)), 'city', 'Ames')), 'telecom', array(named_struct('system', 'email', 'value', 'e'), named_struct('system', 'phone', 'value', '555')),
        'extension', array(named_struct('url', 'http://x/us-core-race', 'extension', array(named_struct('url', 'text', 'valueString', 'race ' || CAST(c_nationkey AS STRING))))))) AS resource FROM {customer}""",
    "DiagnosticReport": f"""SELECT doc_id % 150 AS patient, to_json(named_struct('resourceType', 'DiagnosticReport', 'id', CAST(doc_id AS STRING), 'code', CASE WHEN doc_id % 2 = 0 THEN {_code("lang")} END, 'presentedForm', array(named_struct('data', base64(CAST(text AS BINARY)))), 'issued', '2024-03-0' || CAST(1 + doc_id % 9 AS STRING),
        'subject', named_struct('reference', 'urn:uuid:' || CAST(doc_id % 150 AS STRING)))) AS resource FROM {{documents}}""",
    "Claim": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'Claim', 'id', CAST(o_orderkey AS STRING), 'patient', CASE WHEN o_orderkey % 8 <> 0 THEN named_struct('reference', 'urn:uuid:' || CAST(o_custkey AS STRING)) END, 'total', named_struct('value', o_totalprice), 'billablePeriod', named_struct('start', CAST(CAST(o_orderdate AS DATE) AS STRING)),
        'item', array(named_struct('productOrService', {_code("'ABC-9'")}, 'encounter', CAST(NULL AS ARRAY<STRUCT<reference: STRING>>)), named_struct('productOrService', {_code("'visit ' || lower(o_orderpriority)")}, 'encounter', array(named_struct('reference', 'urn:uuid:e' || CAST(o_orderkey AS STRING))))), 'diagnosis', array(named_struct('diagnosisReference', named_struct('reference', 'Condition/' || CAST(o_orderkey AS STRING)))))) AS resource FROM {{orders}}""",
    "ExplanationOfBenefit": f"""SELECT o_custkey AS patient, to_json(named_struct('resourceType', 'ExplanationOfBenefit', 'id', CAST(o_orderkey AS STRING), 'patient', named_struct('reference', CAST(o_custkey AS STRING)), 'outcome', 'complete', 'total', array(named_struct('amount', named_struct('value', o_totalprice, 'currency', CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END))),
        'insurer', named_struct('display', o_orderpriority), 'claim', named_struct('reference', 'urn:uuid:' || CAST(o_orderkey AS STRING)), 'item', array(named_struct('category', {_code("'Lab work'")}, 'adjudication', array(named_struct('category', {_code("'Paid amount'")}, 'amount', named_struct('value', o_totalprice)), named_struct('category', {_code("'None'")}, 'amount', CAST(NULL AS STRUCT<value: DOUBLE>))))))) AS resource FROM {{orders}}""",
}


def _raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    import re

    text = RESOURCES[kind]
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", text)))})


def bundles(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """(file, value): one bundle per patient and kind."""
    parts = []
    for kind in kinds:
        one = _raw(spark, sf_dir, kind).groupBy("patient").agg(F.array_join(F.transform(F.collect_list("resource"), lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}"))), ",").alias("entries"))
        parts.append(one.select(F.concat(F.lit(f"{kind}-"), F.col("patient").cast("string"), F.lit(".json")).alias("file"), F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), "entries", F.lit("]}")).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _over_bundles(name: str, kinds: list[str], make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(fhir.parse(bundles(spark, sf_dir, kinds)))
    SQL[name] = sql


def _transform(name: str, kind: str, sql: str, *columns: str) -> None:
    table = fhir.final_name(fhir.RAW_NAMES[kind])
    _over_bundles(name, [kind], lambda r: fhir.transform(r)[table].selectExpr(*columns, "source_fhir_id"), sql)


K, C, DAY = "CAST(o_orderkey AS VARCHAR) AS source_fhir_id", "CAST(o_custkey AS VARCHAR) AS patient_id", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
E, U, TS = "CAST(event_id AS VARCHAR) AS source_fhir_id", "CAST(user_id AS VARCHAR) AS patient_id", "CAST(CAST(ts AS DATE) AS VARCHAR)"
_transform("udf01_allergies", "AllergyIntolerance", f"SELECT 'allergen ' || o_orderkey % 20 AS allergy_name, CASE o_orderkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'medication' ELSE 'environment' END AS category, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'moderate' END AS severity, CASE WHEN o_orderstatus = 'F' THEN 'inactive' ELSE 'active' END AS status, {DAY} AS recorded_date, {C}, {K} FROM orders WHERE o_orderkey % 20 <> 0", "allergy_name", "category", "severity", "status", "recorded_date", "patient_id")
_transform("udf01_conditions", "Condition", f"SELECT * FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS condition_name, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'inactive' ELSE 'resolved' END AS status, {DAY} AS onset_date, {DAY} AS recorded_date, CASE WHEN o_orderkey % 3 = 0 THEN 'provisional' ELSE 'confirmed' END AS verification_status, {C}, {K} FROM orders) WHERE NOT regexp_full_match(condition_name, '[A-Z0-9_-]+')", "condition_name", "status", "onset_date", "recorded_date", "verification_status", "patient_id")
_transform("udf01_observations", "Observation", f"SELECT CASE WHEN event_id % 4 = 0 THEN 'Body Weight ' || event_type ELSE 'level of ' || event_type END AS test_name, value, 'kg' AS unit, 'final' AS status, CASE WHEN event_id % 3 <> 0 THEN {TS} ELSE '2024-02-02' END AS test_date, {U}, CASE WHEN event_id % 4 = 0 THEN 'vital_sign' ELSE 'lab_result' END AS observation_type, {E} FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL", "test_name", "value", "unit", "status", "test_date", "patient_id", "observation_type")
_transform("udf01_medications", "MedicationRequest", f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'tablet ' || o_orderkey ELSE 'syrup' END AS medication_name, CASE o_orderstatus WHEN 'O' THEN 'stopped' ELSE 'active' END AS status, {DAY} AS prescribed_date, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prescriber, {C}, {K} FROM orders", "medication_name", "status", "prescribed_date", "prescriber", "patient_id")
_transform("udf01_immunizations", "Immunization", f"SELECT 'vaccine ' || event_type AS vaccine_name, {TS} AS administration_date, CASE WHEN event_id % 2 = 0 THEN 'site A' END AS location, CASE WHEN event_id % 13 = 0 THEN 'not-done' ELSE 'completed' END AS status, {U}, {E} FROM events", "vaccine_name", "administration_date", "location", "status", "patient_id")
_transform("udf01_procedures", "Procedure", f"SELECT 'step ' || lower(o_orderpriority) AS procedure_name, 'completed' AS status, CASE WHEN o_orderkey % 2 = 0 THEN {DAY} ELSE '1999-09-09' END AS performed_date, CASE WHEN o_orderkey % 2 = 0 THEN '2020-01-01' END AS end_date, {C}, {K} FROM orders", "procedure_name", "status", "performed_date", "end_date", "patient_id")
_transform("udf01_encounters", "Encounter", f"SELECT CASE o_orderstatus WHEN 'F' THEN 'emergency' WHEN 'O' THEN 'virtual' ELSE 'ambulatory' END AS encounter_type, lower(o_orderpriority) AS visit_reason, {DAY} AS start_date, 'Dr. ' || o_orderkey % 9 AS provider, 'finished' AS status, {C}, {K} FROM orders", "encounter_type", "visit_reason", "start_date", "provider", "status", "patient_id")
_transform("udf01_care_plans", "CarePlan", f"SELECT 'management of ' || lower(o_orderpriority) AS plan_name, CASE WHEN o_orderkey % 2 = 0 THEN 'inactive' ELSE 'active' END AS status, 'exercise ' || o_orderkey % 3 || ' completed' AS activities, {DAY} AS start_date, {C}, {K} FROM orders WHERE o_orderkey % 6 <> 0", "plan_name", "status", "array_join(transform(activities, a -> a.activity_name || ' ' || a.status), ',') AS activities", "start_date", "patient_id")
_transform("udf01_patients", "Patient", "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS first_name, c_mktsegment AS last_name, '1950-01-0' || (1 + c_custkey % 9) AS birth_date, CASE WHEN c_custkey % 3 = 0 THEN 'male' ELSE 'unknown' END AS gender, '1 Main, Apt ' || c_custkey AS street, 'US' AS country, '555' AS phone, 'race ' || c_nationkey AS race, 'English' AS language, CAST(c_custkey AS VARCHAR) AS source_fhir_id FROM customer WHERE c_custkey % 10 <> 0", "patient_id", "first_name", "last_name", "birth_date", "gender", "address.street AS street", "address.country AS country", "phone", "race", "language")
_transform("udf01_diagnostic_reports", "DiagnosticReport", r"SELECT * FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Clinical Report' END AS report_type, sha256(c) AS summary, '2024-03-0' || (1 + doc_id % 9) AS report_date, CAST(doc_id % 150 AS VARCHAR) AS patient_id, CAST(doc_id AS VARCHAR) AS source_fhir_id, c FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r\f]+', '', 'g'), '<[^>]+>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS c FROM documents)) x WHERE length(c) >= 20".replace("SELECT * FROM (SELECT CASE", "SELECT * EXCLUDE (c) FROM (SELECT CASE", 1), "report_type", "sha2(clinical_summary, 256) AS summary", "report_date", "patient_id")
_transform("udf01_claims", "Claim", f"SELECT {C}, {DAY} AS billable_period_start, o_totalprice AS total_value, 'USD' AS total_currency, CAST(o_orderkey AS VARCHAR) AS diagnoses, 'visit ' || lower(o_orderpriority) || ' e' || o_orderkey AS items, {K} FROM orders WHERE o_orderkey % 8 <> 0", "patient_id", "billable_period_start", "total_value", "total_currency", "array_join(diagnosis_references, ',') AS diagnoses", "array_join(transform(items, i -> i.product_or_service_display || ' ' || i.encounter_reference), ',') AS items")
_transform("udf01_explanations", "ExplanationOfBenefit", f"SELECT {C}, 'complete' AS outcome, o_totalprice AS total_submitted_value, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS total_submitted_currency, o_orderpriority AS insurer_display, CAST(o_orderkey AS VARCHAR) AS claim_reference, o_totalprice AS paid, {K} FROM orders", "patient_id", "outcome", "total_submitted_value", "total_submitted_currency", "insurer_display", "claim_reference", "items[0].adjudications[0].amount_value AS paid")

SOME = ["Condition", "Observation", "Patient"]
_over_bundles("src03_bundle_resources", SOME, lambda r: r.groupBy("file").agg(F.count("*").alias("n")), "SELECT 'Condition-' || o_custkey || '.json' AS file, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'Observation-' || user_id || '.json', COUNT(*) FROM events GROUP BY 1 UNION ALL SELECT 'Patient-' || c_custkey || '.json', 1 FROM customer")
_over_bundles("src04_routing", SOME, fhir.by_raw_table, "SELECT 'conditions' AS raw_table, COUNT(*) AS count FROM orders UNION ALL SELECT 'observations', COUNT(*) FROM events UNION ALL SELECT 'patients', COUNT(*) FROM customer")
_over_bundles("src05_sanitized", ["Condition"], lambda r: r.select("fhir_id", F.col("ingestion_metadata.ingestion_version").alias("version"), F.col("ingestion_metadata.ingested_at").isNotNull().alias("stamped")), "SELECT CAST(o_orderkey AS VARCHAR) AS fhir_id, '1.0' AS version, true AS stamped FROM orders")
_over_bundles("agg32_ingest_counts", SOME, fhir.ingest_counts, "SELECT 'Condition' AS resource_type, COUNT(*) AS count FROM orders UNION ALL SELECT 'Observation', COUNT(*) FROM events UNION ALL SELECT 'Patient', COUNT(*) FROM customer")
_over_bundles("agg29_transform_stats", ["Observation"], lambda r: fhir.transform_stats(r, "Observation"), "SELECT 'Observation' AS resource_type, COUNT(*) AS processed, COUNT(*) FILTER (event_id % 5 <> 0) AS transformed, COUNT(*) FILTER (event_id % 5 = 0) AS skipped FROM events")
_over_bundles("udf02_registry", ["Condition", "Patient"], lambda r: r.sparkSession.createDataFrame([(t, d.columns[0]) for t, d in fhir.transform(r).items()], "table_name string, first_column string"), "SELECT * FROM (VALUES ('allergies', 'allergy_name'), ('conditions', 'condition_name'), ('observations', 'test_name'), ('medications', 'medication_name'), ('immunizations', 'vaccine_name'), ('procedures', 'procedure_name'), ('encounters', 'encounter_type'), ('care_plans', 'plan_name'), ('patients', 'patient_id'), ('diagnosticreports', 'report_type'), ('claims', 'patient_id'), ('explanationofbenefits', 'patient_id')) v(table_name, first_column)")
add("err03_table_names", lambda s: s.createDataFrame([(raw, fhir.final_name(raw), fhir.ingestion_name(fhir.final_name(raw))) for raw in fhir.RAW_NAMES.values()], "raw string, final string, back string").agg(F.count_if(F.col("raw") == F.col("back")).alias("same"), F.count_if(F.col("raw") != F.col("final")).alias("renamed")), "SELECT 12 AS same, 3 AS renamed")


def _files(spark: SparkSession, orders: DataFrame) -> str:
    """A folder of bundles as JSON files, one per order priority."""
    at = f"{shared_folder(spark)}/bundles"
    resource = F.struct(F.lit("Condition").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), F.struct(F.col("o_orderpriority").alias("text")).alias("code"))
    found = orders.groupBy(F.substring("o_orderpriority", 1, 1).alias("part")).agg(F.collect_list(F.struct(resource.alias("resource"))).alias("entry"))
    found.select(F.lit("Bundle").alias("resourceType"), "entry", "part").write.partitionBy("part").json(at)
    return f"{at}/part=*"


add("src01_find_files", lambda s, o: fhir.find_files(s, [_files(s, o)]).agg(F.count("*").alias("files"), F.count_if(F.col("bytes") > 0).alias("filled")), "SELECT COUNT(DISTINCT o_orderpriority) AS files, COUNT(DISTINCT o_orderpriority) AS filled FROM orders", tables=("orders",))
add("src02_bundle_scan", lambda s, o: fhir.scan(s, [_files(s, o)]).select("resource_type", "fhir_id"), "SELECT 'Condition' AS resource_type, CAST(o_orderkey AS VARCHAR) AS fhir_id FROM orders", tables=("orders",))

# ---- drug classes ----
TREES = """WITH n AS (SELECT n_regionkey AS r, chr(65 + n_regionkey) || lpad(CAST(n_nationkey AS STRING), 2, '0') AS c, n_name FROM {nation})
    SELECT to_json(named_struct('rxclassTree', collect_list(named_struct('rxclassMinConceptItem', named_struct('classId', chr(65 + r), 'className', r_name), 'rxclassTree', kids)))) AS body FROM (
      SELECT r, collect_list(named_struct('rxclassMinConceptItem', named_struct('classId', c, 'className', n_name), 'rxclassTree', array(named_struct('rxclassMinConceptItem', named_struct('classId', c || 'B', 'className', CAST(NULL AS STRING)),
        'rxclassTree', array(named_struct('rxclassMinConceptItem', named_struct('classId', c || 'BA', 'className', 'sub ' || n_name))))))) AS kids FROM n GROUP BY r
    ) JOIN {region} ON r = r_regionkey"""
ANSWERS = """SELECT atc_code, to_json(named_struct('drugMemberGroup', named_struct('drugMember', collect_list(named_struct('minConcept', named_struct('rxcui', CASE WHEN p_partkey % 40 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END, 'name', ' ' || p_name, 'tty', CASE WHEN p_partkey % 3 = 0 THEN 'BN' ELSE 'IN' END)))))) AS body
    FROM (SELECT *, chr(65 + n_regionkey) || lpad(CAST(n_nationkey AS STRING), 2, '0') || 'BA' AS atc_code FROM {part} JOIN {nation} ON p_partkey % 25 = n_nationkey) GROUP BY atc_code"""
N_SQL = "WITH n AS (SELECT n_nationkey, n_name, r_name, chr(CAST(65 + n_regionkey AS INT)) AS l1, chr(CAST(65 + n_regionkey AS INT)) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS c FROM nation JOIN region ON n_regionkey = r_regionkey) "
FOUND_SQL = "SELECT c || 'BA' AS atc_code, CAST(p_partkey AS VARCHAR) AS rxcui, p_name AS name, n_name, c FROM part JOIN n ON p_partkey % 25 = n_nationkey WHERE p_partkey % 40 <> 0 AND p_partkey % 3 <> 0"


def _trees(spark: SparkSession, nation: DataFrame, region: DataFrame) -> DataFrame:
    return spark.sql(TREES, nation=nation, region=region)


def _answers(spark: SparkSession, part: DataFrame, nation: DataFrame) -> DataFrame:
    return spark.sql(ANSWERS, part=part, nation=nation)


add("src07_class_tree", lambda s, n, r: drug_classes.edges(_trees(s, n, r)), N_SQL + "SELECT DISTINCT NULL AS parent, l1 AS code, r_name AS name FROM n UNION ALL SELECT l1, c, n_name FROM n UNION ALL SELECT c, c || 'B', NULL FROM n UNION ALL SELECT c || 'B', c || 'BA', 'sub ' || n_name FROM n", tables=("nation", "region"))
add("src07_level_four", lambda s, n, r: drug_classes.level_4(drug_classes.edges(_trees(s, n, r))), N_SQL + "SELECT c || 'BA' AS atc_code, n_name AS therapeutic_class_l2, c || 'B' AS drug_class_l3, 'sub ' || n_name AS drug_subclass_l4 FROM n", tables=("nation", "region"))
add("src07_class_paths", lambda s, n, r: drug_classes.recursive_paths(s, drug_classes.edges(_trees(s, n, r))), N_SQL + "SELECT DISTINCT l1 AS code, l1 AS path, 0 AS depth FROM n UNION ALL SELECT c, l1 || '/' || c, 1 FROM n UNION ALL SELECT c || 'B', l1 || '/' || c || '/' || c || 'B', 2 FROM n UNION ALL SELECT c || 'BA', l1 || '/' || c || '/' || c || 'B/' || c || 'BA', 3 FROM n", tables=("nation", "region"))
add("src08_class_members", lambda s, p, n: drug_classes.members(_answers(s, p, n)), N_SQL + f"SELECT atc_code, rxcui, name FROM ({FOUND_SQL})", tables=("part", "nation"))
add("src11_drug_table", lambda s, p, n, r: drug_classes.drug_table(_trees(s, n, r), _answers(s, p, n)), N_SQL + f"SELECT rxcui AS ingredient_rxcui, name AS primary_drug_name, n_name AS therapeutic_class_l2, c || 'B' AS drug_class_l3, 'sub ' || n_name AS drug_subclass_l4, atc_code FROM ({FOUND_SQL})", tables=("part", "nation", "region"))
add("jsn02_valid_drugs", lambda s, d: drug_classes.valid_drugs(d.withColumn("ingredient_rxcui", F.when(F.col("drug_subclass_l4") == "S7", "  ").otherwise(F.concat(F.lit(" "), "ingredient_rxcui"))))[0].select("ingredient_rxcui", "primary_drug_name"), "SELECT ingredient_rxcui, primary_drug_name FROM drugs WHERE drug_subclass_l4 <> 'S7'", ("drugs",))

# ---- sinks: written, then read back ----


def _written(spark: SparkSession, write: Callable[[str], None]) -> DataFrame:
    at = f"{shared_folder(spark)}/table"
    write(at)
    return spark.read.parquet(at)


def _drug_upsert(s, d):
    table = LogTable(s, f"{shared_folder(s)}/drugs")
    first = d.select("ingredient_rxcui", "primary_drug_name")
    table.upsert(first, "ingredient_rxcui")
    table.upsert(drug_classes.valid_drugs(first.withColumn("primary_drug_name", F.when(F.col("ingredient_rxcui").cast("int") % 2 == 0, F.concat(F.lit("new "), "primary_drug_name")).otherwise(" ")))[0], "ingredient_rxcui")
    return table.read()


def _patients_log(s, p):
    """Two changes, folded buckets, and a third change over them."""
    table = LogTable(s, f"{shared_folder(s)}/patients")
    table.upsert(p.select("patient_id", "city", "state"), "patient_id", 8)
    table.upsert(p.select("patient_id", F.when(F.col("gender") == "male", "moved").alias("city")), "patient_id")
    table.compact(2)
    table.upsert(p.select("patient_id", F.when(F.col("gender") != "female", F.lit("new")).alias("state"), "gender"), "patient_id")
    return table.read()


def _overwrite_in_place(s, c):
    def write(at):
        c.select("source_fhir_id", "status").write.parquet(at)
        sinks.overwrite(s.read.parquet(at).withColumn("status", F.upper("status")), at)

    return _written(s, write)


def _new_content(s, c):
    table = LogTable(s, f"{shared_folder(s)}/conditions")
    rows = c.select("source_fhir_id", "patient_id", "condition_name")
    table.upsert_new_content(rows.where("condition_name < '3'"), "source_fhir_id", ["patient_id", "condition_name"])
    table.upsert_new_content(rows, "source_fhir_id", ["patient_id", "condition_name"])
    return table.read().select("source_fhir_id")


def _database(s, c):
    """Bucketed, renamed, read, and the database dropped at last."""
    name = f"scratch_{shared_folder(s).rsplit('/', 1)[-1]}"
    s.sql(f"CREATE DATABASE {name}")
    try:
        sinks.bucketed(c.select("source_fhir_id", "patient_id"), f"{name}.raw", "patient_id", 4)
        sinks.rename(s, f"{name}.raw", f"{name}.clean")
        layout = {r.col_name.strip(): r.data_type for r in s.sql(f"DESCRIBE EXTENDED {name}.clean").collect()}
        rows = s.table(f"{name}.clean").agg(F.count("*").alias("n")).first().n
    finally:
        sinks.drop_database(s, name)
    return s.createDataFrame([(layout["Num Buckets"], layout["Bucket Columns"], rows, s.catalog.databaseExists(name))], "buckets string, columns string, n long, there boolean")


def _unknown_by_filter(s, c):
    """Contents that aren't known yet, by a stored filter of the known ones and one of the others."""
    rows = quality.hashed(c, ["patient_id", "condition_name"])
    known, size = rows.where("status = 'active'"), c.count()
    blocks = bloom.blocks_for(size)
    return bloom.anti_join(rows, known, "content_hash", bloom.build(known, "content_hash", blocks), blocks, size).select("source_fhir_id")


def _log(s, c):
    at = f"{shared_folder(s)}/log"
    for known in (F.col("status") == "active", ~F.col("status").eqNullSafe("active")):  # two appends, all rows
        sinks.append_log(c.where(known).select(F.lit("access").alias("event"), "patient_id", "status"), at)
    return s.read.schema("event string, patient_id string, status string").json(at).groupBy("event", "status").agg(F.count("*").alias("n"))


add("snk02_drugs_upsert", _drug_upsert, "SELECT ingredient_rxcui, CASE WHEN CAST(ingredient_rxcui AS INT) % 2 = 0 THEN 'new ' || primary_drug_name ELSE primary_drug_name END AS primary_drug_name FROM drugs", ("drugs",))
add("snk01_patients_log", _patients_log, "SELECT patient_id, CASE WHEN gender = 'male' THEN 'moved' ELSE city END AS city, CASE WHEN gender <> 'female' THEN 'new' ELSE state END AS state, gender FROM patients", ("patients",))
add("join07_unknown_by_filter", _unknown_by_filter, "SELECT source_fhir_id FROM conditions WHERE (patient_id, condition_name) NOT IN (SELECT patient_id, condition_name FROM conditions WHERE status = 'active')", ("conditions",))
add("snk03_upsert_by_first_key", lambda s, c: joins.upsert_by_first_key(c.select(F.when(F.col("status") != "active", F.col("source_fhir_id")).alias("source_fhir_id"), "patient_id", "status").dropDuplicates(["source_fhir_id", "patient_id"]), c.where("status <> 'active'").select("source_fhir_id", "patient_id", F.lit("new").alias("status"))).groupBy("status").agg(F.count("*").alias("n")),
    "SELECT 'new' AS status, COUNT(*) AS n FROM conditions WHERE status <> 'active' UNION ALL SELECT 'active', COUNT(DISTINCT patient_id) FROM conditions WHERE status = 'active'", ("conditions",))
add("snk04_overwrite_in_place", _overwrite_in_place, "SELECT source_fhir_id, upper(status) AS status FROM conditions", ("conditions",))
add("snk05_rename_and_drop", _database, "SELECT '4' AS buckets, '[`patient_id`]' AS columns, COUNT(*) AS n, false AS there FROM conditions", ("conditions",))
QUERIES["snk06_bucketed"], SQL["snk06_bucketed"] = QUERIES["snk05_rename_and_drop"], SQL["snk05_rename_and_drop"]
QUERIES["snk10_drop_database"], SQL["snk10_drop_database"] = QUERIES["snk05_rename_and_drop"], SQL["snk05_rename_and_drop"]
add("snk07_new_content_only", _new_content, "SELECT source_fhir_id FROM conditions WHERE condition_name < '3' UNION SELECT source_fhir_id FROM conditions WHERE (patient_id, condition_name) NOT IN (SELECT patient_id, condition_name FROM conditions WHERE condition_name < '3')", ("conditions",))
add("snk13_audit_log", _log, "SELECT 'access' AS event, status, COUNT(*) AS n FROM conditions GROUP BY 2", ("conditions",))
add("snk14_log_lines", lambda s, p: sinks.log_lines(p.select("patient_id", F.struct("city", F.col("gender").alias("kind")).alias("context")), "patient seen", "INFO"), """SELECT '{"level":"INFO","message":"patient seen","patient_id":"' || patient_id || '","context_city":"' || city || '","context_kind":"' || gender || '"}' AS line FROM patients""", ("patients",))


def _cached(s, sf_dir) -> DataFrame:
    """Another session finds what the first has made, and a count of the results that are there."""
    at = shared_folder(s)
    for session in (s, s.newSession(), s.newSession()):
        c = entity(session, sf_dir, "conditions")
        out = SharedCache(session, at).get("count", {"table": "conditions"}, "admin", c.groupBy("status").agg(F.count("*").alias("n")))
    p, fs = sinks._hadoop(s, at)
    made = [x for k in fs.listStatus(p) for x in fs.listStatus(k.getPath()) if x.getPath().getName().startswith("result-")]
    return s.read.schema(out.schema).parquet(*{f.rpartition("/")[0] for f in out.inputFiles()}).withColumn("made", F.lit(len(made)))


QUERIES["snk16_result_cache"] = _cached
SQL["snk16_result_cache"] = entity_sql("conditions") + "SELECT status, COUNT(*) AS n, 1 AS made FROM conditions GROUP BY 1"


# ---- sources and runtime ----
def _members_by_rest(s, nations, customers):
    """A table joined with a service's answers, which a server on this machine gives for the time of the query."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    names = {str(r.n_nationkey): r.n_name for r in nations.collect()}  # one row per nation

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code = parse_qs(urlsplit(self.path).query)["classId"][0]
            body = json.dumps({"drugMemberGroup": {"drugMember": [{"minConcept": {"rxcui": code, "name": names[code], "tty": "IN"}}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = drug_classes.fetch_members(s, sorted(names), f"http://127.0.0.1:{server.server_port}", delay=0.02)
        at = f"{shared_folder(s)}/members"
        found.write.parquet(at)
    finally:
        server.shutdown()
    members = s.read.schema(found.schema).parquet(at)
    return customers.join(members, F.col("c_nationkey").cast("string") == F.col("atc_code")).groupBy("name").agg(F.count("*").alias("n"))


add("src09_members_by_rest", _members_by_rest, "SELECT n_name AS name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", tables=("nation", "customer"))
add("src12_full_scan", lambda s, n: n, "SELECT * FROM nation", tables=("nation",))
add("src15_cursor", lambda s, n: s.createDataFrame([(i, len(b), min(b)) for i, b in enumerate(runtime.cursor(n.orderBy("n_nationkey"), 10, lambda r: r.n_nationkey))], "batch int, n int, least long"), "SELECT CAST(n_nationkey // 10 AS INT) AS batch, CAST(COUNT(*) AS INT) AS n, MIN(n_nationkey) AS least FROM nation GROUP BY 1", tables=("nation",))
QUERIES["udf05_stream_transformer"], SQL["udf05_stream_transformer"] = QUERIES["src15_cursor"], SQL["src15_cursor"]
add("src16_tables", lambda s, n, r: _with_views(s, {"vg_nation": n, "vg_region": r}, lambda: s.createDataFrame([(t,) for t in runtime.tables(s) if t.startswith("vg_")], "name string")), "SELECT * FROM (VALUES ('vg_nation'), ('vg_region')) v(name)", tables=("nation", "region"))
add("src19_required_table", lambda s, n: _with_views(s, {"vg_known": n}, lambda: s.createDataFrame([(runtime.require_table(s, "vg_known").count(), errors.enveloped(lambda: runtime.require_table(s, "vg_absent"))()["error"])], "n long, error string")), "SELECT COUNT(*) AS n, 'not_found' AS error FROM nation", tables=("nation",))
add("src17_sampled_schema", lambda s, e: observe.sampled_schema(e.select("event_id", "event_type", "props", F.struct("user_id").alias("who"))).select("path", F.array_join("types", ",").alias("types"), "sample_value", "filled", "sampled", "documents"),
    """WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 100) SELECT path, types, sample_value, filled, 100 AS sampled, (SELECT COUNT(*) FROM events) AS documents FROM (
    SELECT 'event_id' AS path, 'bigint' AS types, MIN(CAST(event_id AS VARCHAR)) AS sample_value, COUNT(*) AS filled FROM s UNION ALL SELECT 'event_type', 'string', MIN(event_type), COUNT(*) FROM s
    UNION ALL SELECT 'props', 'OBJECT<k: BIGINT>', MIN(props), COUNT(*) FROM s UNION ALL SELECT 'who', 'struct<user_id:bigint>', MIN('{' || user_id || '}'), COUNT(*) FROM s UNION ALL SELECT 'who.user_id', 'bigint', MIN(CAST(user_id AS VARCHAR)), COUNT(*) FROM s)""", tables=("events",))


def _with_views(spark: SparkSession, views: dict[str, DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return make()
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def _retried(s, n):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("not yet")
        return n.count()

    return s.createDataFrame([(runtime.retry(flaky, sleep=lambda _: None), len(tries))], "n long, tries int")


add("stm04_retry", _retried, "SELECT COUNT(*) AS n, 3 AS tries FROM nation", tables=("nation",))
add("stm08_trace_flushes", lambda s, e: scans.flushes(e, "user_id", ["ts", "event_id"]).groupBy("user_id", "flush").agg(F.count("*").alias("n")), "SELECT user_id, (r - 1) // 10 AS flush, COUNT(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2", tables=("events",))
add("hsh02_cache_key", lambda s, n: s.createDataFrame([(runtime.cache_key("find", {"b": 1, "a": "x"}, "admin"), runtime.cache_key("find", {"a": "x", "b": 1}, "admin") == runtime.cache_key("find", {"b": 1, "a": "x"}, "billing"))], "key string, shared boolean"), """SELECT sha256('["find", {"a": "x", "b": 1}, "admin"]') AS key, false AS shared""", tables=("nation",))
add("idx01_table_layout", lambda s, n: _with_views(s, {"vg_layout": n}, lambda: s.createDataFrame([(len(runtime.table_layout(s, "vg_layout")), runtime.table_layout(s, "vg_layout")["files"])], "facts int, files int")), "SELECT 5 AS facts, 1 AS files", tables=("nation",))
add("idx01_column_use", lambda s, e: runtime.column_use(e.select(F.array(F.lit("user_id"), F.when(F.col("event_id") % 2 == 0, "ts")).alias("columns"), "ts")), "SELECT 'user_id' AS field, COUNT(*) AS uses, MAX(ts) AS last_used FROM events UNION ALL SELECT 'ts', COUNT(*), MAX(ts) FROM events WHERE event_id % 2 = 0", tables=("events",))
add("idx02_suggestions", lambda s, c: s.createDataFrame([(x,) for x in observe.suggest_indexes(c.select("patient_id", "status", "onset_date", F.lit(None).cast("string").alias("empty")))], "suggestion string"), "SELECT * FROM (VALUES ('onset_date'), ('patient_id'), ('status'), ('patient_id,status')) v(suggestion)", ("conditions",))
add("err01_envelope", lambda s, c: s.createDataFrame([(str(x["success"]), x["error"]) for x in (errors.enveloped(lambda: c.select("nope").count())(), errors.enveloped(lambda: L.validate_limit(0))())], "success string, error string"), "SELECT * FROM (VALUES ('False', 'query_error'), ('False', 'validation_error')) v(success, error)", ("conditions",))
add("err02_kinds", lambda s, c: s.createDataFrame([(errors.convert(e).code,) for e in (TimeoutError("t"), ConnectionError("c"), errors.ValidationError("v"), errors.NotFoundError("n"))], "code string"), "SELECT * FROM (VALUES ('source_error'), ('source_error'), ('validation_error'), ('not_found')) v(code)", ("conditions",))

# ---- filters, projections and validation ----
COUNT = "SELECT COUNT(*) AS count FROM {t} WHERE {w}"
for _name, _match, _table, _where in (
    ("flt01_equals", {"status": "active"}, "conditions", "status = 'active'"), ("flt06_number_range", {"total_value": {"$gte": 1000, "$lt": 90000}}, "claims", "total_value >= 1000 AND total_value < 90000"), ("flt07_not_null", {"birth_date": {"$ne": None}}, "patients", "birth_date IS NOT NULL"),
    ("flt09_in_list", {"status": {"$in": ["active", "resolved"]}, "condition_name": {"$nin": ["5-LOW"]}}, "conditions", "status IN ('active', 'resolved') AND condition_name <> '5-LOW'"), ("flt10_any_of", {"$or": [{"status": "active"}, {"condition_name": {"$regex": "^2"}}]}, "conditions", "status = 'active' OR condition_name LIKE '2%'"),
):
    add(_name, lambda s, d, m=_match: d.where(pipeline.condition(m)).agg(F.count("*").alias("count")), COUNT.format(t=_table, w=_where), (_table,))
add("flt04_all_of", lambda s, c: L.apply(c, L.equals("status", "active"), None, L.contains("condition_name", "urgent"), L.date_range("onset_ts", "1996-01-01")).agg(F.count("*").alias("count")), COUNT.format(t="conditions", w="status = 'active' AND condition_name ILIKE '%urgent%' AND onset_ts >= TIMESTAMP '1996-01-01'"), ("conditions",))
add("flt05_patient_search", lambda s, p: p.where(L.patient_search(first_name="auto", state="asia", birth_date_start="1950-01-01", gender="male")).select("patient_id"), "SELECT patient_id FROM patients WHERE first_name ILIKE '%auto%' AND lower(state) = 'asia' AND birth_date >= '1950-01-01' AND gender = 'male'", ("patients",))
add("flt11_having", lambda s, c: pipeline.compile_pipeline(c, [{"$group": {"_id": "$patient_id", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 9}}}]), "SELECT patient_id AS _id, COUNT(*) AS n FROM conditions GROUP BY 1 HAVING COUNT(*) > 9", ("conditions",))
add("flt14_validated_params", lambda s, p: p.where(pipeline.condition(L.validate_params({"gender": "male", "evil": "x", "city": None}))).agg(F.count("*").alias("count")), COUNT.format(t="patients", w="gender = 'male'"), ("patients",))
add("flt15_validators", lambda s, p: s.createDataFrame([_refusals()], "refused int, limit int"), "SELECT 4 AS refused, 500 AS limit", ("patients",))
add("flt16_depth", lambda s, p: s.createDataFrame([(L.query_depth({"a": [{"b": {"c": 1}}]}), _refused(lambda: L.validate_depth({"a": [{"b": {"c": 1}}]}, 3)))], "depth int, refused boolean"), "SELECT 4 AS depth, true AS refused", ("patients",))


def _refused(f: Callable) -> bool:
    try:
        f()
    except errors.ValidationError:
        return True
    return False


def _refusals() -> tuple[int, int]:
    bad = (lambda: L.validate_patient_id("a b"), lambda: L.validate_limit(0), lambda: L.validate_dates("2024-02-30", None), lambda: L.validate_name("a_b"), lambda: L.validate_limit(9))
    return sum(map(_refused, bad)), L.validate_limit(10_000)


add("prj02_projected_pipeline", lambda s, c: pipeline.project(c.where("status = 'active'"), {"source_fhir_id": 1, "status": 1}), "SELECT source_fhir_id, status FROM conditions WHERE status = 'active'", ("conditions",))
add("prj03_renamed", lambda s, c: pipeline.compile_pipeline(c, [{"$project": {"key": "$source_fhir_id", "status": 1}}]), "SELECT source_fhir_id AS key, status FROM conditions", ("conditions",))
add("prj04_year_and_month", lambda s, c: pipeline.compile_pipeline(c, [{"$addFields": {"year": {"$year": "$onset_ts"}, "month": {"$month": "$onset_ts"}}}, {"$project": {"source_fhir_id": 1, "year": 1, "month": 1}}]), "SELECT source_fhir_id, year(onset_ts) AS year, month(onset_ts) AS month FROM conditions", ("conditions",))
QUERIES["pipe13_add_fields"], SQL["pipe13_add_fields"] = QUERIES["prj04_year_and_month"], SQL["prj04_year_and_month"]


def _projection_cache(s, c):
    cache = governance.ProjectionCache()
    cache.load({"billing": {"conditions": ["patient_id", "condition_name", "absent"]}})
    once, again = cache.apply(c, "clinician", "conditions"), cache.apply(c, "clinician", "conditions")
    return cache.apply(c, "billing", "conditions").withColumn("clinician_columns", F.lit(len(again.columns) if once.columns == again.columns else -1))


add("prj06_projection_cache", _projection_cache, "SELECT patient_id, condition_name, 4 AS clinician_columns FROM conditions", ("conditions",))
add("prj07_fallback_id", lambda s, c: c.select("c_custkey", S.fallback_id(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 0, "  "), F.col("c_custkey").cast("string")).alias("id")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer", tables=("customer",))
add("agg34_matrix_summary", lambda s, e: observe.matrix_summary(e, F.col("event_type") != "error", "event_type"), "SELECT COUNT(*) AS total, COUNT(*) FILTER (event_type <> 'error') AS passed, ROUND(AVG(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END), 2) AS success_rate, COUNT(DISTINCT event_type) AS tools FROM events", tables=("events",))
add("agg37_accumulators", lambda s, e: pipeline.compile_pipeline(e, [{"$group": {"_id": "$event_type", "n": {"$sum": 1}, "low": {"$min": "$value"}, "high": {"$max": "$value"}, "first": {"$first": "$event_id"}, "users": {"$addToSet": "$user_id"}, "count": {"$count": {}}}}]), "SELECT event_type AS _id, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, MIN(event_id) AS first, list(DISTINCT user_id ORDER BY user_id) AS users, COUNT(*) AS count FROM events GROUP BY 1", tables=("events",))
add("pipe03_group", lambda s, c: pipeline.compile_pipeline(c, [{"$group": {"_id": {"s": "$status", "v": "$verification_status"}, "n": {"$sum": 1}}}, {"$project": {"s": "$_id.s", "v": "$_id.v", "n": 1, "_id": 0}}]), "SELECT status AS s, verification_status AS v, COUNT(*) AS n FROM conditions GROUP BY 1, 2", ("conditions",))
add("pipe04_sort_limit", lambda s, c: pipeline.compile_pipeline(c, [{"$sort": {"onset_date": -1, "source_fhir_id": 1}}, {"$limit": 20}, {"$project": {"source_fhir_id": 1}}]), "SELECT source_fhir_id FROM conditions ORDER BY onset_date DESC, source_fhir_id LIMIT 20", ("conditions",))
add("pipe05_limit", lambda s, c: pipeline.compile_pipeline(c, [{"$sort": {"source_fhir_id": 1}}, {"$limit": 7}, {"$count": "n"}]), "SELECT 7 AS n", ("conditions",))
add("pipe07_count", lambda s, c: pipeline.compile_pipeline(c, [{"$match": {"status": "active"}}, {"$count": "n"}]), "SELECT COUNT(*) AS n FROM conditions WHERE status = 'active'", ("conditions",))
add("pipe09_unwind", lambda s, c: pipeline.compile_pipeline(c.select("source_fhir_id", F.split("condition_name", "-").alias("parts")), [{"$unwind": "$parts"}, {"$group": {"_id": "$parts", "n": {"$sum": 1}}}]), "SELECT unnest(string_split(condition_name, '-')) AS _id, COUNT(*) AS n FROM conditions GROUP BY 1", ("conditions",))
add("pipe14_checked", lambda s, c: s.createDataFrame([(len(pipeline.build([{"$match": {}}, {"$limit": 1}])), _refused(lambda: pipeline.build([{"$out": "x"}])), len(pipeline.problems_of([{"$what": 1}, {}, {"$merge": 1}])))], "stages int, refused boolean, problems int"), "SELECT 2 AS stages, true AS refused, 3 AS problems", ("conditions",))
QUERIES["pipe15_problems"], SQL["pipe15_problems"] = QUERIES["pipe14_checked"], SQL["pipe14_checked"]
add("pipe16_estimate", lambda s, c: s.createDataFrame([pipeline.estimate(x) for x in ([{"$match": {}}], [{"$group": {}}, {"$sort": {}}], [{"$lookup": {}}, {"$facet": {}}, {"$sort": {}}], [{"$lookup": {}}] * 4)], "weight int, name string"), "SELECT * FROM (VALUES (0, 'minimal'), (3, 'low'), (7, 'medium'), (12, 'high')) v(weight, name)", ("conditions",))
add("pipe17_explained", lambda s, l: s.createDataFrame([_explained(l)], "scans int, pushed boolean, hints int"), "SELECT 1 AS scans, true AS pushed, 0 AS hints", tables=("lineitem",))
add("pipe19_parsed", lambda s, c: c.where(pipeline.condition(pipeline.parse_query('{"status": "active"}', "find"))).agg(F.count("*").alias("count")).withColumn("refused", F.lit(sum(_refused(lambda q=q, k=k: pipeline.parse_query(q, k)) for q, k in (("{", "find"), ("{}", "aggregate"), ("[]", "find"), ('[{"$merge": "x"}]', "aggregate"), ("{}", "drop"))))), "SELECT COUNT(*) AS count, 5 AS refused FROM conditions WHERE status = 'active'", ("conditions",))


def _explained(lineitem: DataFrame) -> tuple:
    found = pipeline.analyze(lineitem, [{"$match": {"l_quantity": {"$gt": 40}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}])
    return found["scans"], any("l_quantity" in p for p in found["pushed_filters"]), len(found["hints"])


# ---- scalars, windows and governance ----
add("str03_display", lambda s, c: c.select("c_custkey", S.display_text(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).alias("display"))).alias("text")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS text FROM customer", tables=("customer",))
add("str08_state_code", lambda s, c: c.select("c_custkey", S.state_code(F.element_at(F.array(*map(F.lit, (" New York ", "ca", "Ontario", "utah"))), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("code")), "SELECT c_custkey, ['NY', 'CA', 'Ontario', 'UT'][c_custkey % 4 + 1] AS code FROM customer", tables=("customer",))
add("str11_blank_to_null", lambda s, c: c.select("c_custkey", S.blank_to_null(F.when(F.col("c_custkey") % 2 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_name"))).alias("text")), "SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_name END AS text FROM customer", tables=("customer",))
add("str12_shorten", lambda s, d: d.select("doc_id", *(F.sha2(S.shorten(F.col("text"), n), 256).alias(f"to_{n}") for n in (100, 200, 500))), "SELECT doc_id, " + ", ".join(f"sha256(CASE WHEN length(text) > {n} THEN text[1:{n - 3}] || '...' ELSE text END) AS to_{n}" for n in (100, 200, 500)) + " FROM documents", tables=("documents",))
add("str17_prompt", lambda s, n: n.select(S.filled("Name: {name}\nRegion: {region}.", name=F.col("n_name"), region=F.col("n_regionkey")).alias("prompt")), "SELECT 'Name: ' || n_name || chr(10) || 'Region: ' || n_regionkey || '.' AS prompt FROM nation", tables=("nation",))
add("mth07_to_number", lambda s, p: p.select("p_partkey", S.to_number(F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))).alias("number")), "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 0.5::DOUBLE END AS number FROM part", tables=("part",))
WORDS_SQL = "regexp_extract_all(p_name, '[^ ]+')"
add("arr01_first", lambda s, p: p.select("p_partkey", S.first_of(F.when(F.col("p_partkey") % 5 != 0, F.split("p_name", " "))).alias("word")), f"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN {WORDS_SQL}[1] END AS word FROM part", tables=("part",))
add("arr02_first_where", lambda s, p: p.select("p_partkey", S.first_where(F.split("p_name", " "), lambda w: F.length(w) > 5).alias("word")), f"SELECT p_partkey, list_filter({WORDS_SQL}, lambda w: length(w) > 5)[1] AS word FROM part", tables=("part",))
add("arr05_set_size", lambda s, c: pipeline.compile_pipeline(c, [{"$group": {"_id": "$patient_id", "kinds": {"$addToSet": "$status"}}}, {"$project": {"n": {"$size": "$kinds"}}}]), "SELECT patient_id AS _id, CAST(COUNT(DISTINCT status) AS INT) AS n FROM conditions GROUP BY 1", ("conditions",))
NESTED = lambda p: p.select("patient_id", F.struct("city", F.lit("secret").alias("ssn"), F.array(F.struct("state", F.lit("x").alias("phone_number"))).alias("details")).alias("address"), "balance")
add("arr06_nested_mask", lambda s, p: governance.mask(NESTED(p), "clinician").select("patient_id", F.to_json("address").alias("address")), """SELECT patient_id, '{"city":"' || city || '","details":[{"state":"' || state || '"}]}' AS address FROM patients""", ("patients",))
RECORDS = lambda p: p.select("patient_id", F.array(F.struct("city", F.lit("secret").alias("ssn")), F.struct(F.col("state").alias("city"), F.col("balance").cast("string").alias("ssn"))).alias("address"), F.lit("x").alias("ssn"))
add("gov02_nested_records", lambda s, p: governance.mask(RECORDS(p), "clinician").select("patient_id", F.to_json("address").alias("address")), """SELECT patient_id, '[{"city":"' || city || '"},{"city":"' || state || '"}]' AS address FROM patients""", ("patients",))
add("gov06_permissions", lambda s, p: s.createDataFrame([(r, governance.has_permission(r, "read_phi"), governance.has_permission(r, "read_financial")) for r in governance.ROLES], "role string, phi boolean, financial boolean"), "SELECT * FROM (VALUES ('admin', true, true), ('clinician', true, false), ('researcher', false, false), ('billing', false, true), ('read_only', false, false)) v(role, phi, financial)", ("patients",))
add("win02_originals_and_duplicates", lambda s, c: _split(c), "SELECT source_fhir_id, CASE WHEN row_number() OVER (PARTITION BY patient_id, condition_name ORDER BY source_fhir_id) = 1 THEN 'original' ELSE 'duplicate' END AS part FROM conditions", ("conditions",))
add("win05_running_mean", lambda s, e: scans.running_mean(e, "event_type", ["ts", "event_id"], "value").select("event_id", F.round(F.col("running_mean") + 1e-9, 4).alias("running_mean")), "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 4) AS running_mean FROM events", tables=("events",))


def _split(c: DataFrame) -> DataFrame:
    first, others = quality.split(c, quality.DEDUP_FIELDS["conditions"], "source_fhir_id")
    return first.select("source_fhir_id", F.lit("original").alias("part")).unionAll(others.select("source_fhir_id", F.lit("duplicate").alias("part")))
