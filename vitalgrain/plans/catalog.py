"""Registry of the engine's own queries and their ANSI SQL twins.

A query is (spark, sf_dir) -> DataFrame. The SQL is written by hand for each shape; record and pattern
tools share a renderer as they share an operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.functions import filters as L
from vitalgrain.functions import scalars as S
from vitalgrain.functions import user
from vitalgrain.operators import analytics as A
from vitalgrain.operators import governance, joins, limits, observe, quality, runtime, scans, sinks, timeline
from vitalgrain.plans import catalog_etl, catalog_requests, catalog_state, pipeline, tools
from vitalgrain.sources import fhir
from vitalgrain.sources.entities import entity, entity_sql, read_table
from vitalgrain.streaming import bounded, machines, stateful

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-06-01"


def add(name: str, make: Callable, sql: str | None = None, entities: tuple[str, ...] = (), tables: tuple[str, ...] = ()) -> None:
    """Register a query: ``make`` takes its entities and tables as DataFrames, in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(*(entity(spark, sf_dir, e) for e in entities), *(read_table(spark, sf_dir, t) for t in tables))

    _QUERIES[name] = run
    if sql:
        _SQL[name] = (entity_sql(*entities) if entities else "") + sql


# ---- TOOL and AGG ----
NAME_SQL = """SELECT condition_name, COUNT(*) AS total_cases, COUNT(*) FILTER (status = 'active') AS active_cases, COUNT(*) FILTER (status = 'resolved') AS resolved_cases,
  COUNT(DISTINCT patient_id) AS patient_count FROM conditions {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""
add("tool03_conditions_by_name", A.conditions_by_name, NAME_SQL.format(where=""), ("conditions",))
add("agg01_active_conditions", lambda c: A.conditions_by_name(c.where("status = 'active'")), NAME_SQL.format(where="WHERE status = 'active'"), ("conditions",))
AGE = "datediff('month', CAST(birth_date AS DATE), DATE '2024-06-01') - CASE WHEN day(CAST(birth_date AS DATE)) > 1 THEN 1 ELSE 0 END"
GROUP_CASE = "CASE WHEN a IS NULL THEN 'unknown' WHEN a < 18 THEN '0-17' WHEN a < {1} THEN '18-{0}' WHEN a < {3} THEN '{1}-{2}' WHEN a < {5} THEN '{3}-{4}' ELSE '{5}+' END"
add(
    "agg02_conditions_by_demographics",
    lambda c, p: A.conditions_by_demographics(c, p, AS_OF),
    f""", people AS (SELECT patient_id, gender, race, ethnicity, {GROUP_CASE.format(34, 35, 54, 55, 74, 75)} AS age_group FROM (SELECT *, floor(({AGE}) / 12) AS a FROM patients))
    SELECT gender, race, ethnicity, age_group, COUNT(*) AS condition_count, COUNT(DISTINCT condition_name) AS unique_conditions, COUNT(DISTINCT patient_id) AS patient_count, COUNT(*) FILTER (status = 'active') AS active_count
    FROM conditions JOIN people USING (patient_id) GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 50""",
    ("conditions", "patients"),
)
add("agg03_conditions_by_month", A.conditions_by_month, """SELECT year(onset_ts) AS year, month(onset_ts) AS month, COUNT(*) AS condition_count, COUNT(DISTINCT patient_id) AS patient_count, COUNT(DISTINCT condition_name) AS unique_conditions,
    COUNT(*) FILTER (status = 'active') AS active_count FROM conditions GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 50""", ("conditions",))
add("agg04_individual_conditions", lambda c: A.records(c.where("status = 'active'"), ["patient_id", "condition_name", "status", "onset_date", "verification_status", "source_fhir_id"], [F.asc("source_fhir_id")]),
    "SELECT patient_id, condition_name, status, onset_date, verification_status, source_fhir_id FROM conditions WHERE status = 'active' ORDER BY source_fhir_id LIMIT 50", ("conditions",))
MONEY = "ROUND(SUM(total_value), 2) AS total_amount, ROUND(AVG(total_value), 4) AS average_amount"
add("agg05_financial_summary", A.financial_summary, f"SELECT COUNT(*) AS claim_count, {MONEY}, ROUND(MIN(total_value), 2) AS min_amount, ROUND(MAX(total_value), 2) AS max_amount FROM claims", ("claims",))
add("agg05_financial_first_rows", lambda c: A.records(c, ["claim_id", "patient_id", "total_value", "insurance_display"], [F.asc("claim_id")]), "SELECT claim_id, patient_id, total_value, insurance_display FROM claims ORDER BY claim_id LIMIT 50", ("claims",))
add("agg06_financial_by_patient", A.financial_by_patient, f"SELECT patient_id, MIN(patient_display_name) AS patient_name, COUNT(*) AS claim_count, {MONEY}, ROUND(MIN(total_value), 2) AS min_amount, ROUND(MAX(total_value), 2) AS max_amount FROM claims GROUP BY 1 ORDER BY total_amount DESC, 1 LIMIT 100", ("claims",))
for _n, _key in (("agg07_financial_by_insurance", "insurance_display"), ("agg08_financial_by_facility", "facility_display")):
    add(_n, lambda c, k=_key: A.financial_by(c, k), f"SELECT {_key}, COUNT(*) AS claim_count, {MONEY}, COUNT(DISTINCT patient_id) AS patient_count FROM claims GROUP BY 1 ORDER BY total_amount DESC, 1 LIMIT 50", ("claims",))
add("agg09_financial_by_month", A.financial_by_month, f"SELECT * EXCLUDE (y, m), y || '-' || m AS period FROM (SELECT year(billable_ts) AS y, month(billable_ts) AS m, COUNT(*) AS claim_count, {MONEY}, COUNT(DISTINCT patient_id) AS patient_count FROM claims GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 50)", ("claims",))
add("tool04_financial_range", lambda c: A.financial_summary(L.apply(c, L.contains("insurance_display", "build"), L.number_range("total_value", 1000, 200000), L.date_range("billable_ts", "1996-01-01", "1998-06-30"))),
    f"SELECT COUNT(*) AS claim_count, {MONEY}, ROUND(MIN(total_value), 2) AS min_amount, ROUND(MAX(total_value), 2) AS max_amount FROM claims WHERE insurance_display ILIKE '%build%' AND total_value BETWEEN 1000 AND 200000 AND billable_ts >= TIMESTAMP '1996-01-01' AND billable_ts < TIMESTAMP '1998-07-01'", ("claims",))
EXAMPLES = """, g AS (SELECT {key} AS group_key, COUNT(*) AS count FROM {t} WHERE {key} IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= {least} ORDER BY 2 DESC, 1 LIMIT 50)
    SELECT group_key, count, (SELECT list(n ORDER BY n)[1:5] FROM (SELECT DISTINCT {name} AS n FROM {t} WHERE {key} = group_key)) AS examples FROM g"""
for _n, _t, _key, _name, _least in (
    ("agg10_drug_classes_l2", "drugs", "therapeutic_class_l2", "primary_drug_name", 1), ("agg10_drug_classes_l3", "drugs", "drug_class_l3", "primary_drug_name", 2), ("agg10_drug_classes_l4", "drugs", "drug_subclass_l4", "primary_drug_name", 3),
    ("agg11_care_plans_by_status", "care_plans", "status", "plan_name", 1), ("agg11_care_plans_by_name", "care_plans", "plan_name", "plan_name", 1), ("agg11_care_plans_by_start", "care_plans", "start_date", "plan_name", 1),
):
    add(_n, lambda d, k=_key, n=_name, m=_least: A.with_examples(d, k, n, m), EXAMPLES.format(key=_key, t=_t, name=_name, least=_least), (_t,))
add("agg12_count", lambda c: pipeline.execute(lambda _: c, "conditions", '{"status": "active"}', "count"), "SELECT COUNT(*) AS count FROM conditions WHERE status = 'active'", ("conditions",))
add("agg13_distinct", lambda c: pipeline.execute(lambda _: c, "conditions", {"field": "condition_name", "query": {"status": "active"}}, "distinct"), "SELECT DISTINCT condition_name AS value FROM conditions WHERE status = 'active'", ("conditions",))

SEARCH = "SELECT patient_id, first_name, last_name, birth_date, gender, city, state FROM patients WHERE {w} ORDER BY patient_id LIMIT 20"
add("tool01_search_patients", lambda p: tools.search_patients(p, last_name="customer#0000001", gender="male", birth_date_start="1940-01-01", birth_date_end="2000-12-31"), SEARCH.format(w="last_name ILIKE '%customer#0000001%' AND gender = 'male' AND birth_date BETWEEN '1940-01-01' AND '2000-12-31'"), ("patients",))
add("tool01_search_patients_state", lambda p: tools.search_patients(p, state="asia", city="nation", race="as"), SEARCH.format(w="lower(state) = 'asia' AND city ILIKE '%nation%' AND race ILIKE '%as%'"), ("patients",))
add("gov05_search_masked", lambda p: tools.search_patients(p, role="billing", gender="female"), SEARCH.format(w="gender = 'female'").replace("first_name, last_name", "CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name", 1), ("patients",))
add("tool06_search_drugs", lambda d: tools.search_drugs(d, drug_name="RING", drug_class="eco"), "SELECT * FROM drugs WHERE primary_drug_name ILIKE '%ring%' AND drug_class_l3 ILIKE '%eco%' ORDER BY primary_drug_name, ingredient_rxcui LIMIT 50", ("drugs",))
MEDS = """, top AS (SELECT * FROM medications WHERE {w} ORDER BY prescribed_ts DESC, source_fhir_id {cut}), e AS (SELECT lower(primary_drug_name) AS k, arg_min(d, ingredient_rxcui) AS d FROM drugs d GROUP BY 1)
    SELECT source_fhir_id, patient_id, medication_name, status, prescribed_date, prescriber, d.ingredient_rxcui AS rxcui, d.therapeutic_class_l2 AS therapeutic_class, d.drug_class_l3 AS drug_class
    FROM top LEFT JOIN e ON lower(medication_name) = k {having} ORDER BY prescribed_ts DESC, source_fhir_id LIMIT 50"""
add("tool05_medication_history", lambda m, d: tools.medication_history(m, d, status="active", prescribed_date_start="1996-01-01"), MEDS.format(w="status = 'active' AND prescribed_ts >= TIMESTAMP '1996-01-01'", cut="LIMIT 50", having=""), ("medications", "drugs"))
add("tool05_medication_history_class", lambda m, d: tools.medication_history(m, d, medication_name="widget", drug_class="promo"), MEDS.format(w="medication_name ILIKE '%widget%'", cut="", having="WHERE d.drug_class_l3 ILIKE '%promo%'"), ("medications", "drugs"))
add("join04_enrich_medications", lambda m, d: joins.enrich_medications(m, d).groupBy(F.col("drug.drug_class_l3").alias("drug_class")).agg(F.count("*").alias("count")),
    ", e AS (SELECT lower(primary_drug_name) AS k, arg_min(drug_class_l3, ingredient_rxcui) AS drug_class FROM drugs GROUP BY 1) SELECT drug_class, COUNT(*) AS count FROM medications LEFT JOIN e ON lower(medication_name) = k GROUP BY 1", ("medications", "drugs"))
REPORTS = "SELECT source_fhir_id, patient_id, report_type, report_date, length(clinical_summary) AS summary_chars FROM diagnostic_reports WHERE {w} ORDER BY report_date DESC, source_fhir_id LIMIT 50"
add("tool10_diagnostic_reports", lambda r: tools.reports(r, report_type="EN", start="2012-01-01", end="2018-12-31"), REPORTS.format(w="report_type ILIKE '%en%' AND report_date BETWEEN '2012-01-01' AND '2018-12-31'"), ("diagnostic_reports",))
add("tool11_search_reports", lambda r: tools.reports(r, search_text="worthless|ñado"), REPORTS.format(w="regexp_matches(clinical_summary, '(?i)worthless|ñado')"), ("diagnostic_reports",))

TIMELINE = " UNION ALL ".join(
    f"SELECT patient_id, '{s}' AS event_type, {at} AS event_ts, {name} AS event_name, source_fhir_id AS source_id, (CASE WHEN {d[0]} IS NULL THEN 0 ELSE 1 END{''.join(f' + CASE WHEN {x} IS NULL THEN 0 ELSE 1 END' for x in d[1:])}) AS n_details FROM {s}"
    for s, (at, name, d) in timeline.SOURCES.items()
)


def _timeline(*frames, **params):
    out = timeline.timeline(dict(zip(timeline.SOURCES, frames, strict=True)), **params)
    return out.select("patient_id", "event_type", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_name", "source_id", F.size("details").cast("long").alias("n_details"))


def _timeline_sql(where: str) -> str:
    return f", t AS ({TIMELINE}) SELECT patient_id, event_type, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_time, event_name, source_id, CAST(n_details AS BIGINT) AS n_details FROM t WHERE {where} ORDER BY event_ts DESC NULLS LAST, event_type, source_id LIMIT 100"


add("tool02_timeline", lambda *f: _timeline(*f, patient_id="7"), _timeline_sql("patient_id = '7'"), tuple(timeline.SOURCES))
add("tool02_timeline_types", lambda *f: _timeline(*f, patient_id="11", event_types=["conditions", "medications"], start="1996-01-01", end="1999-12-31"), _timeline_sql("patient_id = '11' AND event_type IN ('conditions', 'medications') AND event_ts >= TIMESTAMP '1996-01-01' AND event_ts < TIMESTAMP '2000-01-01'"), tuple(timeline.SOURCES))
add("set01_timeline_counts", lambda *f: timeline.timeline(dict(zip(timeline.SOURCES, f, strict=True)), limit=None).groupBy("event_type").agg(F.count("*").alias("count")), f", t AS ({TIMELINE}) SELECT event_type, COUNT(*) AS count FROM t GROUP BY 1", tuple(timeline.SOURCES))

# ---- record and pattern tools ----


def _quoted(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _where(spec, params: dict) -> str:
    parts = [f"{c} = {_quoted(params[p])}" for p, c in spec.equal.items() if p in params] + [f"{c} ILIKE '%{params[p]}%'" for p, c in spec.contain.items() if p in params]
    if isinstance(spec, tools.Get):
        parts += [f"{c} IN ({', '.join(map(_quoted, params[p]))})" for p, c in spec.listed.items() if p in params]
        for kind, (c, low, high) in spec.range_.items():
            date = kind.startswith("date")
            if low in params:
                parts.append(f"{c} >= " + (f"TIMESTAMP '{params[low]}'" if date else repr(params[low])))
            if high in params:
                parts.append(f"{c} < TIMESTAMP '{params[high]}' + INTERVAL 1 DAY" if date else f"{c} <= {params[high]!r}")
    return " AND ".join(parts) or "true"


def _get(name: str, tool: str, ascending: bool = False, limit: int | None = None, **params) -> None:
    spec = tools.GETS[tool]
    order = "ASC" if ascending else "DESC"
    sql = f"SELECT {', '.join(spec.columns)} FROM {spec.entity} WHERE {_where(spec, params)} ORDER BY {spec.at} {order} NULLS LAST, {spec.key} LIMIT {limit or spec.limit}"
    add(name, lambda d: tools.get(spec, d, ascending, limit, **params), sql, (spec.entity,))


def _analyze(name: str, tool: str, by: str, limit: int | None = None, min_count: int = 1, **params) -> None:
    spec = tools.ANALYSES[tool]
    unit = {"time_period": "month"}.get(by, by)
    key = spec.groups.get(by) or f"CAST(CAST(date_trunc('{unit}', {spec.at}) AS DATE) AS VARCHAR)"
    v = spec.value
    extra = f", ROUND(AVG({v}), 4) AS average, ROUND(MIN({v}), 2) AS minimum, ROUND(MAX({v}), 2) AS maximum, ROUND(SUM({v}), 2) AS total" if v else ""
    sql = f"SELECT {key} AS group_key, COUNT(*) AS count, COUNT(DISTINCT patient_id) AS patient_count{extra} FROM {spec.entity} WHERE {_where(spec, params)} GROUP BY 1 HAVING COUNT(*) >= {min_count} ORDER BY 2 DESC, 1 LIMIT {limit or spec.limit}"
    add(name, lambda d: tools.analyze(spec, d, by, limit, min_count, **params), sql, (spec.entity,))


_get("tool08_care_plans", "get_patient_care_plans", status="active", plan_name="urgent", period_start="1996-01-01", period_end="1999-01-01")
_get("stub01_patient_allergies", "get_patient_allergies", category="food", severity="high", allergy_name="gen 1", recorded_date_start="1996-05-01")
_analyze("stub02_allergy_patterns", "analyze_allergy_patterns", "allergy")
_get("stub03_patient_conditions", "get_patient_conditions", condition_name="URGENT", verification_status="confirmed", onset_date_start="1996-01-01", onset_date_end="1996-12-31")
_analyze("stub04_condition_patterns", "analyze_condition_patterns", "time_period", status="active")
_get("stub07_patient_immunizations", "get_patient_immunizations", vaccine_name="view", status="completed", administration_date_start="2024-01-05", administration_date_end="2024-01-20")
_analyze("stub08_immunization_patterns", "analyze_immunization_patterns", "location", status="completed")
_get("stub09_vaccine_history", "get_vaccine_history", patient_id="5", vaccine_types=["view", "click"])
_get("stub11_patient_observations", "get_patient_observations", observation_type="lab_result", status="final", unit="U1", value_min=5.0, value_max=50.0)
_analyze("stub12_observation_patterns", "analyze_observation_patterns", "test_name", status="final")
_get("stub14_lab_results", "get_lab_results", observation_type="lab_result", status="final", lab_test_names=["purchase", "error"], test_date_end="2024-01-15")
_get("stub16_patient_procedures", "get_patient_procedures", procedure_category="surgical", status="completed", procedure_name="eco")
_analyze("stub17_procedure_patterns", "analyze_procedure_patterns", "procedure_name", status="completed")
_get("stub18_procedure_history", "get_procedure_history", ascending=True, patient_id="3", procedure_types=["ECONOMY", "PROMO"])
_analyze("stub20_procedure_statistics", "get_procedure_statistics", "quarter", procedure_category="diagnostic")
_get("stub21_patient_encounters", "get_patient_encounters", encounter_type="emergency", status="finished", visit_reason="promo", start_date="1997-01-01", end_date="1998-01-01")
_analyze("stub22_encounter_patterns", "analyze_encounter_patterns", "provider", status="finished")
_get("stub23_encounter_history", "get_encounter_history", ascending=True, patient_id="9", encounter_types=["emergency", "inpatient"])
_analyze("stub24_visit_reasons", "analyze_visit_reasons", "visit_reason", min_count=2, encounter_type="ambulatory")
_get("stub25_provider_encounters", "get_provider_encounters", provider="000000007", status="finished")
_get("stub26_patient_claims", "get_patient_claims", status="active", insurance_provider="auto", min_amount=1000.0, max_amount=90000.0)
_analyze("stub27_claims_patterns", "analyze_claims_patterns", "facility", status="active")
_analyze("stub29_insurance_utilization", "analyze_insurance_utilization", "week", min_count=3, insurance_provider="furn")
_analyze("stub30_claim_totals", "calculate_claim_totals", "year")
_get("stub31_patient_eobs", "get_patient_eobs", outcome="complete", min_submitted_amount=10000.0, billable_start_date="1999-01-01")
_analyze("stub32_eob_patterns", "analyze_eob_patterns", "facility", outcome="complete")
_analyze("stub35_eob_totals", "calculate_eob_totals", "month")
add("stub05_condition_details", lambda c: tools.condition_details(c, "42", True), """SELECT 'exact' AS match, source_fhir_id, patient_id, condition_name, onset_date FROM conditions WHERE source_fhir_id = '42' UNION ALL SELECT * FROM (
    SELECT 'similar', source_fhir_id, patient_id, condition_name, onset_date FROM conditions WHERE condition_name IN (SELECT condition_name FROM conditions WHERE source_fhir_id = '42') AND source_fhir_id <> '42' ORDER BY source_fhir_id LIMIT 10)""", ("conditions",))
add("stub06_condition_prevalence", lambda c, p: A.prevalence(c, p), """SELECT condition_name, COUNT(DISTINCT patient_id) AS patients, ROUND(COUNT(DISTINCT patient_id) * 100.0 / (SELECT COUNT(DISTINCT patient_id) FROM patients), 4) AS prevalence FROM conditions
    WHERE status = 'active' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", ("conditions", "patients"))
add("stub10_vaccination_status", lambda i: A.missing_from_schedule(i, [("view", 0, 99), ("polio", 0, 17), ("mumps", 0, 99), ("click", 18, 60)], 40), "SELECT v AS vaccine_name FROM (VALUES ('view'), ('mumps'), ('click')) s(v) WHERE v NOT IN (SELECT vaccine_name FROM immunizations)", ("immunizations",))
add("stub13_vital_signs", lambda o: tools.vital_signs(o, kinds=["view"]), """SELECT source_fhir_id, patient_id, test_name, value, test_date, ROUND(value - lag(value) OVER (PARTITION BY patient_id, test_name ORDER BY test_ts, source_fhir_id), 4) AS change
    FROM observations WHERE observation_type = 'vital_sign' AND test_name = 'view' ORDER BY test_ts DESC, source_fhir_id LIMIT 100""", ("observations",))
add("stub14_abnormal_labs", tools.abnormal_labs, """, n AS (SELECT test_name, AVG(value) AS m, stddev_samp(value) AS sd FROM observations WHERE observation_type = 'lab_result' AND status = 'final' GROUP BY 1)
    SELECT source_fhir_id, test_name, value, ROUND((value - m) / sd, 3) AS z FROM observations JOIN n USING (test_name) WHERE observation_type = 'lab_result' AND status = 'final' AND abs(ROUND((value - m) / sd, 3)) > 1.5 ORDER BY test_ts DESC, source_fhir_id LIMIT 50""", ("observations",))
add("stub15_measurement_trends", lambda o: A.trends(o, "week"), """, b AS (SELECT test_name, CAST(CAST(date_trunc('week', test_ts) AS DATE) AS VARCHAR) AS period, COUNT(*) AS count, ROUND(AVG(value), 4) AS average, ROUND(MIN(value), 2) AS minimum, ROUND(MAX(value), 2) AS maximum FROM observations GROUP BY 1, 2)
    SELECT *, ROUND(average - lag(average) OVER (PARTITION BY test_name ORDER BY period), 4) AS change FROM b ORDER BY test_name, period LIMIT 20""", ("observations",))
add("stub19_procedure_outcomes", tools.procedure_outcomes, """SELECT procedure_name, CAST(CAST(date_trunc('year', performed_ts) AS DATE) AS VARCHAR) AS period, COUNT(*) AS count, ROUND(AVG(CASE WHEN outcome = 'success' THEN 100.0 ELSE 0.0 END), 2) AS success_rate,
    ROUND(AVG(CASE WHEN outcome = 'complication' THEN 100.0 ELSE 0.0 END), 2) AS complication_rate FROM procedures GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20""", ("procedures",))
add("stub28_claim_details", lambda t: A.claim_items(t).select("claim_id", F.size("items").cast("long").alias("n_items"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["net_value"]), 2).alias("net")),
    "SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, COUNT(*) AS n_items, ROUND(SUM(l_extendedprice), 2) AS net FROM lineitem GROUP BY 1", tables=("lineitem",))
add("stub33_eob_details", A.eob_details, "SELECT eob_id, claim_reference, 'paid' AS category, adjudicated_value AS amount FROM eobs UNION ALL SELECT eob_id, claim_reference, 'denied', denied_value FROM eobs", ("eobs",))
add("stub33_eob_details_of_claim", lambda e: A.eob_details(e, claim_reference="7", category="paid"), "SELECT eob_id, claim_reference, 'paid' AS category, adjudicated_value AS amount FROM eobs WHERE claim_reference = '7'", ("eobs",))
add("stub34_payment_patterns", A.adjudications, """SELECT insurer_display, CAST(CAST(date_trunc('month', billable_ts) AS DATE) AS VARCHAR) AS period, ROUND(SUM(adjudicated_value), 2) AS paid, ROUND(SUM(denied_value), 2) AS denied FROM eobs GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 25""", ("eobs",))

# ---- joins ----
add("join01_conditions_patients", A.conditions_by_place, "SELECT city, COUNT(*) AS count FROM conditions JOIN patients USING (patient_id) GROUP BY 1", ("conditions", "patients"))
add("join02_orphans", lambda o, p: joins.orphans(o, p.where("patient_id <> '7'"), "patient_id", "patient_id").groupBy("patient_id").agg(F.count("*").alias("count")), "SELECT patient_id, COUNT(*) AS count FROM observations WHERE patient_id NOT IN (SELECT patient_id FROM patients WHERE patient_id <> '7') GROUP BY 1", ("observations", "patients"))
add("join03_twins", lambda c: joins.having_twins(c, ["patient_id", "condition_name", "onset_date"]).select("source_fhir_id"), "SELECT source_fhir_id FROM conditions QUALIFY COUNT(*) OVER (PARTITION BY patient_id, condition_name, onset_date) > 1", ("conditions",))
add("join05_nest", lambda p, c: joins.nested_record(p.select("patient_id"), conditions=c.select("patient_id", "source_fhir_id", "status")).select("patient_id", F.size("conditions").cast("long").alias("n"), F.array_join(F.transform("conditions", lambda x: x["source_fhir_id"]), ",").alias("ids")),
    "SELECT patient_id, COUNT(source_fhir_id) AS n, coalesce(string_agg(source_fhir_id, ',' ORDER BY source_fhir_id), '') AS ids FROM patients LEFT JOIN conditions USING (patient_id) GROUP BY 1", ("patients", "conditions"))
add("join06_patient_summary", joins.patient_summary, "SELECT patient_id, last_name, coalesce(c, 0) AS condition_count, coalesce(m, 0) AS medication_count FROM patients LEFT JOIN (SELECT patient_id, COUNT(*) AS c FROM conditions GROUP BY 1) USING (patient_id) LEFT JOIN (SELECT patient_id, COUNT(*) AS m FROM medications GROUP BY 1) USING (patient_id)", ("patients", "conditions", "medications"))
add("join07_unknown_only", lambda c: quality.unknown_only(c, quality.hashed(c.where("status = 'active'"), ["patient_id", "condition_name"]), ["patient_id", "condition_name"]).select("source_fhir_id"), "SELECT source_fhir_id FROM conditions WHERE (patient_id, condition_name) NOT IN (SELECT patient_id, condition_name FROM conditions WHERE status = 'active')", ("conditions",))
add("join08_lookup_unwind", lambda p, c: joins.unwind(joins.lookup(p.select("patient_id"), c.select(F.col("patient_id").alias("owner"), "status"), "patient_id", "owner", "found"), "found").groupBy("found.status").agg(F.count("*").alias("count")), "SELECT status, COUNT(*) AS count FROM patients JOIN conditions USING (patient_id) GROUP BY 1", ("patients", "conditions"))
add("snk01_upsert", lambda p: joins.upsert(p.select("patient_id", "city", "state"), p.select("patient_id", F.when(F.col("gender") == "male", "moved").alias("city"), F.when(F.col("gender") != "female", F.lit("new")).alias("state"), "gender"), "patient_id"),
    "SELECT patient_id, CASE WHEN gender = 'male' THEN 'moved' ELSE city END AS city, CASE WHEN gender <> 'female' THEN 'new' ELSE state END AS state, gender FROM patients", ("patients",))
add("snk08_latest_per_key", lambda c: joins.latest_per_key(c.select("patient_id", "onset_ts", "source_fhir_id"), "patient_id", "onset_ts").select("patient_id", "source_fhir_id"), "SELECT patient_id, arg_max(source_fhir_id, (onset_ts, source_fhir_id)) AS source_fhir_id FROM conditions GROUP BY 1", ("conditions",))
add("snk11_export_markdown", lambda p: sinks.to_markdown_rows(p.select("patient_id", "city", "birth_date")), "SELECT '| ' || patient_id || ' | ' || city || ' | ' || coalesce(birth_date, '') || ' |' AS markdown FROM patients", ("patients",))
add("snk15_json_round_trip", lambda p: sinks.from_json_rows(sinks.to_json_rows(p.select("patient_id", "city", "birth_date", "balance")), "patient_id string, city string, birth_date string, balance double"), "SELECT patient_id, city, birth_date, balance FROM patients", ("patients",))

# ---- scalar functions ----
SP = r"[ \t\n\r\f]+"
add("str04_clean_text", lambda p: p.select("page_id", F.sha2(S.clean_text(F.col("html")), 256).alias("clean")),
    rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, 'https?://[^ \t\n\r\f]+', '', 'g'), '<[^>]+>', '', 'g'), '{SP}', ' ', 'g'))) AS clean FROM pages", tables=("pages",))
add("str05_base64", lambda d: d.select("doc_id", F.sha2(S.decode_base64(F.base64(F.col("text").cast("binary"))), 256).alias("text")), "SELECT doc_id, sha256(text) AS text FROM documents", tables=("documents",))
add("str01_coding_text", lambda c: c.select("c_custkey", S.coding_text(F.struct(F.array(F.struct(F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name")).alias("display"))).alias("coding"), F.col("c_mktsegment").alias("text"))).alias("name")),
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer", tables=("customer",))
add("str02_reference_id", lambda c: c.select("c_custkey", S.reference_id(F.concat(F.when(F.col("c_custkey") % 2 == 0, "urn:uuid:").otherwise("Patient/"), F.col("c_custkey").cast("string"))).alias("id")), "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer", tables=("customer",))
add("str06_observation_type", lambda p: p.select("p_partkey", S.observation_type(F.concat("p_name", F.when(F.col("p_size") > 25, " Heart Rate").otherwise(""))).alias("kind")), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'vital_sign' ELSE 'lab_result' END AS kind FROM part", tables=("part",))
add("str07_labels", lambda l: l.groupBy(S.label("encounter_class", F.when(F.col("l_returnflag") == "R", "EMER").when(F.col("l_returnflag") == "A", "ACUTE")).alias("kind")).agg(F.count("*").alias("count")), "SELECT CASE l_returnflag WHEN 'R' THEN 'emergency' WHEN 'A' THEN 'inpatient' ELSE 'ambulatory' END AS kind, COUNT(*) AS count FROM lineitem GROUP BY 1", tables=("lineitem",))
add("str09_escape_regex", lambda d: d.select("doc_id", F.sha2(S.escape_regex(F.col("text")), 256).alias("escaped")), r"SELECT doc_id, sha256(regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS escaped FROM documents", tables=("documents",))
add("str10_masks", lambda c: c.select("c_custkey", S.mask_value(F.col("c_name")).alias("masked"), S.mask_session(F.col("c_name")).alias("session"), S.shorten(F.repeat("c_name", 4)).alias("short")),
    "SELECT c_custkey, c_name[1:2] || '***' || right(c_name, 2) AS masked, c_name[1:4] || '...' || right(c_name, 4) AS session, repeat(c_name, 4)[1:47] || '...' AS short FROM customer", tables=("customer",))
add("str13_collapse_lower", lambda d: d.select("doc_id", F.sha2(S.collapse_lower(F.col("text")), 256).alias("low")), rf"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '{SP}', ' ', 'g')))) AS low FROM documents", tables=("documents",))
add("str14_dangerous", lambda p: p.select("page_id", S.dangerous(F.col("url")).alias("url_bad"), S.dangerous(F.col("html")).alias("html_bad")), r"SELECT page_id, regexp_matches(url, '\.\.|[\x00-\x1F\x7F-\x9F]|(?i:<script|javascript:)') AS url_bad, regexp_matches(html, '\.\.|[\x00-\x1F\x7F-\x9F]|(?i:<script|javascript:)') AS html_bad FROM pages", tables=("pages",))
add("str15_formats", lambda c: c.select("c_custkey", S.is_email(F.concat("c_mktsegment", F.lit("@ex.org"))).alias("email"), S.is_id(F.col("c_name")).alias("id"), S.is_name(F.col("c_mktsegment")).alias("name")), "SELECT c_custkey, true AS email, regexp_full_match(c_name, '[a-zA-Z0-9_-]+') AS id, regexp_full_match(c_mktsegment, '[a-zA-Z0-9 ''-]+') AS name FROM customer", tables=("customer",))
add("str16_resource_type", lambda c: c.select("c_custkey", S.resource_type_of(F.concat(F.element_at(F.array(F.lit("search_patients"), F.lit("get_Drug_x"), F.lit("claims"), F.lit("audit_it"), F.lit("other")), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("kind")),
    "SELECT c_custkey, ['patient', 'medication', 'financial', 'audit', 'unknown'][c_custkey % 5 + 1] AS kind FROM customer", tables=("customer",))
add("flt17_medically_relevant", lambda d: d.select("doc_id", S.medically_relevant(F.col("text")).alias("relevant")), r"SELECT doc_id, coalesce(length(text) >= 3 AND NOT regexp_full_match(text, '[A-Z0-9_-]+') AND NOT regexp_matches(text, '^(https?://|urn:)') AND NOT regexp_matches(text, 'snomed\.info|loinc\.org|hl7\.org|terminology\.'), false) AS relevant FROM documents", tables=("documents",))
add("flt02_text_contains", lambda d: d.where(L.contains("text", "ñado|THER")).agg(F.count("*").alias("count")), "SELECT COUNT(*) AS count FROM documents WHERE regexp_matches(text, '(?i)ñado|THER')", tables=("documents",))
add("flt13_literal_search", lambda d: d.where(L.contains_literal(["text", "source"], "the.")).agg(F.count("*").alias("count")), "SELECT COUNT(*) AS count FROM documents WHERE contains(lower(text), 'the.') OR contains(lower(source), 'the.')", tables=("documents",))
for _p, _params, _w, _e in (
    ("active_conditions", {"condition_type": "1-URGENT"}, "status = 'active' AND condition_name = '1-URGENT'", "conditions"), ("patient_medications", {"patient_id": "5", "status": "active"}, "patient_id = '5' AND status = 'active'", "medications"),
    ("date_range", {"date_field": "onset_date", "start_date": "1996-01-01", "end_date": "1996-02-01"}, "onset_date BETWEEN '1996-01-01' AND '1996-02-01'", "conditions"), ("text_search", {"search_term": "Urg", "field1": "condition_name", "field2": "status"}, "contains(lower(condition_name), 'urg') OR contains(lower(status), 'urg')", "conditions"),
    ("recent_encounters", {"patient_id": "3", "date_threshold": "1999-01-01"}, "patient_id = '3' AND start_date >= '1999-01-01'", "encounters"), ("lab_results", {"patient_id": "3"}, "patient_id = '3' AND observation_type = 'lab_result' AND status = 'final'", "observations"), ("patient_demographics", {"gender": "male", "state": "ASIA"}, "gender = 'male' AND state = 'ASIA'", "patients"),
):
    add(f"flt12_{_p}", lambda d, p=_p, q=_params: d.where(L.pattern(p, q)).agg(F.count("*").alias("count"), F.min("patient_id").alias("least")), f"SELECT COUNT(*) AS count, MIN(patient_id) AS least FROM {_e} WHERE {_w}", (_e,))
add("flt08_exists_or_range", lambda p: p.where(L.all_of(F.col("birth_date").isNotNull() | (F.col("gender") == "male"), L.one_of("state", ["ASIA", "EUROPE"]), L.number_range("balance", 0))).select("patient_id"), "SELECT patient_id FROM patients WHERE (birth_date IS NOT NULL OR gender = 'male') AND state IN ('ASIA', 'EUROPE') AND balance >= 0", ("patients",))
add("flt03_year_month_range", lambda c: c.where(L.year_range("onset_ts", 1997, 12)).agg(F.count("*").alias("count")), "SELECT COUNT(*) AS count FROM conditions WHERE year(onset_ts) = 1997 AND month(onset_ts) = 12", ("conditions",))
add("dt05_periods", lambda o: o.groupBy(*(S.period(F.col("o_orderdate"), u).alias(u) for u in ("week", "month", "quarter", "year"))).agg(F.count("*").alias("count")), "SELECT " + ", ".join(f"CAST(CAST(date_trunc('{u}', o_orderdate) AS DATE) AS VARCHAR) AS {u}" for u in ("week", "month", "quarter", "year")) + ", COUNT(*) AS count FROM orders GROUP BY 1, 2, 3, 4", tables=("orders",))
add("dt01_parse_end_of_day", lambda e: e.select("event_id", F.date_format(S.end_of_day(S.parse_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last")), "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') || ' 23:59:59.999999' AS last FROM events", tables=("events",))
add("dt04_implausible", lambda o: o.groupBy(F.coalesce(S.implausible_date(F.col("o_orderdate").cast("timestamp"), "2000-01-01 00:00:00"), F.lit("fine")).alias("verdict")).agg(F.count("*").alias("count")), "SELECT CASE WHEN o_orderdate > TIMESTAMP '2000-01-02' THEN 'future' WHEN o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 54750 DAY THEN 'too_old' ELSE 'fine' END AS verdict, COUNT(*) AS count FROM orders GROUP BY 1", tables=("orders",))
add("mth01_age_groups", lambda p: p.select("patient_id", S.age_group(S.age(F.col("birth_date"), AS_OF)).alias("grp"), S.age_group_private(S.age(F.col("birth_date"), AS_OF)).alias("private")),
    f" SELECT patient_id, {GROUP_CASE.format(34, 35, 54, 55, 74, 75)} AS grp, {GROUP_CASE.format(29, 30, 49, 50, 69, 70)} AS private FROM (SELECT *, floor(({AGE}) / 12) AS a FROM patients)", ("patients",))
add("mth03_percentage", lambda p: p.select("p_partkey", S.percentage(F.col("p_size"), F.col("p_partkey") % 7).alias("share")), "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE greatest(least(ROUND(p_size * 100.0 / (p_partkey % 7), 2), 100.0), 0.0) END::DOUBLE AS share FROM part", tables=("part",))
add("mth04_backoff", lambda p: p.select("p_partkey", *(S.backoff(s, 0.5, F.col("p_partkey") % 9).alias(s) for s in ("immediate", "linear", "exponential")), S.dlq_delay(F.col("p_partkey") % 5).alias("dlq")), "SELECT p_partkey, 0.0::DOUBLE AS immediate, least(0.5 * (p_partkey % 9 + 1), 60.0)::DOUBLE AS linear, least(0.5 * pow(2, p_partkey % 9), 60.0)::DOUBLE AS exponential, 300.0 * pow(2, p_partkey % 5) AS dlq FROM part", tables=("part",))
add("mth06_complexity", lambda p: p.select("p_partkey", S.complexity_score(F.col("p_size") > 25, (F.col("p_size") % 6).cast("int"), F.when(F.col("p_partkey") % 2 == 0, "aggregate").otherwise("find"), (F.col("p_size") % 5).cast("int"), F.col("p_partkey") % 3 == 0, F.col("p_size") * 10).cast("long").alias("score")),
    "SELECT p_partkey, CAST(greatest(0, least(10, (CASE WHEN p_size > 25 THEN 2 ELSE 0 END) + least(p_size % 6, 3) + (CASE WHEN p_partkey % 2 = 0 THEN 3 + least(p_size % 5, 3) ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) - (CASE WHEN p_size * 10 > 0 AND p_size * 10 < 100 THEN 1 ELSE 0 END))) AS BIGINT) AS score FROM part", tables=("part",))
add("jsn01_json_path", lambda e: e.groupBy(S.json_text(F.col("props"), "$.k", "0").cast("long").alias("k")).agg(F.count("*").alias("count")), "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COUNT(*) AS count FROM events GROUP BY 1", tables=("events",))
add("hsh01_content_hash", lambda c: c.select("c_custkey", S.content_hash(["c_name", "c_mktsegment"]).alias("hash")), "SELECT c_custkey, sha256('c_mktsegment:' || lower(c_mktsegment) || '|' || 'c_name:' || lower(c_name)) AS hash FROM customer", tables=("customer",))
add("arr03_map_or_null", lambda l: A.claim_items(l).select("claim_id", F.size(F.coalesce(S.map_or_null(F.col("items"), lambda i: i["net_value"] > 50000, lambda i: i["product"]), F.array().cast("array<bigint>"))).cast("long").alias("n"), S.first_where(F.col("items"), lambda i: i["net_value"] > 50000)["line"].cast("long").alias("line")),
    "SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, COUNT(*) FILTER (l_extendedprice > 50000) AS n, CAST(arg_min(l_linenumber, (l_linenumber, l_partkey)) FILTER (l_extendedprice > 50000) AS BIGINT) AS line FROM lineitem GROUP BY 1", tables=("lineitem",))

# ---- quality and dedup ----
add("dq01_completeness", lambda p: quality.summary(quality.validate(p, quality.default_rules(AS_OF)["patients"])), "SELECT 'patient_required_fields' AS rule_name, COUNT(*) AS count FROM patients WHERE birth_date IS NULL HAVING COUNT(*) > 0", ("patients",))
add("dq02_formats", lambda p: quality.summary(quality.validate(p, [quality.format_rule("seg", "first_name", "^(AUTO|MACH)", 1, 9)]), "message"), "SELECT 'pattern' AS message, COUNT(*) AS count FROM patients WHERE NOT regexp_matches(first_name, '^(AUTO|MACH)') UNION ALL SELECT 'too long', COUNT(*) FROM patients WHERE length(first_name) > 9 HAVING COUNT(*) > 0", ("patients",))
add("dq04_dates", lambda p: quality.summary(quality.validate(p, [quality.date_consistency("d", ["birth_date"], "1990-01-01 00:00:00")]), "message"), "SELECT 'in the future' AS message, COUNT(*) AS count FROM patients WHERE CAST(birth_date AS TIMESTAMP) > TIMESTAMP '1990-01-02'", ("patients",))
add("agg17_quality_score", lambda p: quality.score(quality.validate(p, quality.default_rules(AS_OF)["patients"])), "SELECT COUNT(*) AS total, COUNT(birth_date) AS valid, ROUND(COUNT(birth_date) * 100.0 / COUNT(*), 4) AS quality_score FROM patients", ("patients",))
add("dq03_reference_findings", lambda o, p: quality.reference_findings(o, p.where("patient_id > '5'"), "ref").agg(F.count("*").alias("count")), "SELECT COUNT(*) AS count FROM observations WHERE patient_id NOT IN (SELECT patient_id FROM patients WHERE patient_id > '5')", ("observations", "patients"))
add("agg19_profile", lambda p: quality.profile(p, ["patient_id", "birth_date", "gender"]), " UNION ALL ".join(f"SELECT '{c}' AS field, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(*) FILTER (trim({c}) = '') AS blanks, least(COUNT(DISTINCT {c}), 100) AS distinct_values, ROUND(COUNT({c}) * 100.0 / COUNT(*), 2) AS completeness FROM patients" for c in ("patient_id", "birth_date", "gender")), ("patients",))
add("agg20_exact_duplicates", lambda c: quality.exact_duplicates(c, ["patient_id", "condition_name", "onset_date"]), "SELECT COUNT(*) - COUNT(DISTINCT (patient_id, condition_name, onset_date)) AS duplicates FROM conditions", ("conditions",))
add("agg21_type_histogram", lambda p: quality.type_histogram(p, ["birth_date", "balance"]), "SELECT 'birth_date' AS field, CASE WHEN birth_date IS NULL THEN 'null' ELSE 'string' END AS type, COUNT(*) AS count FROM patients GROUP BY 1, 2 UNION ALL SELECT 'balance', 'double', COUNT(*) FROM patients", ("patients",))
H = "sha256('condition_name:' || lower(condition_name) || '|patient_id:' || patient_id)"
add("agg16_duplicate_groups", lambda c: quality.duplicate_groups(c, quality.DEDUP_FIELDS["conditions"], "source_fhir_id", 30), f"SELECT {H} AS content_hash, COUNT(*) AS count, MIN(source_fhir_id) AS original FROM conditions GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY 2 DESC, 1 LIMIT 30", ("conditions",))
for _s, _o in (("first", "source_fhir_id"), ("last", "source_fhir_id DESC"), ("newest", "onset_ts DESC, source_fhir_id"), ("oldest", "onset_ts, source_fhir_id")):
    add(f"win01_keep_{_s}", lambda c, s=_s: quality.keep(c, quality.DEDUP_FIELDS["conditions"], "source_fhir_id", s, "onset_ts").select("source_fhir_id", "content_hash"), f"SELECT source_fhir_id, {H} AS content_hash FROM conditions QUALIFY row_number() OVER (PARTITION BY patient_id, condition_name ORDER BY {_o}) = 1", ("conditions",))
add("dq09_dedup_summary", lambda c: quality.dedup_summary(c, quality.DEDUP_FIELDS["conditions"]), "SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS contents, COUNT(*) FILTER (n > 1) AS groups, CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM (SELECT COUNT(*) AS n FROM conditions GROUP BY patient_id, condition_name)", ("conditions",))

# ---- governance ----
add("gov01_mask_clinician", lambda c: governance.mask(c, "clinician"), "SELECT patient_id, condition_name, status, onset_date FROM conditions", ("conditions",))
add("gov01_mask_read_only", lambda p: governance.mask(p, "read_only"), "SELECT patient_id, first_name, last_name, gender, birth_date, city, state FROM patients", ("patients",))
add("gov03_de_identify", lambda p: governance.de_identify(p, AS_OF), f" SELECT gender, race, ethnicity, balance, birth_date[1:4] AS birth_year, {GROUP_CASE.format(29, 30, 49, 50, 69, 70)} AS age_group FROM (SELECT *, floor(({AGE}) / 12) AS a FROM patients)", ("patients",))
add("gov04_minimum_necessary", lambda p: governance.minimum_necessary(p, "researcher", AS_OF), f" SELECT gender, birth_date[1:4] AS birth_year, {GROUP_CASE.format(29, 30, 49, 50, 69, 70)} AS age_group FROM (SELECT *, floor(({AGE}) / 12) AS a FROM patients)", ("patients",))
add("gov08_audit_record", lambda c: governance.audit_record(c.where("status = 'active'"), "patient_id", "search", "billing"), "SELECT 'search' AS operation, 'billing' AS role, COUNT(*) AS result_count, (SELECT list(p ORDER BY p) FROM (SELECT DISTINCT patient_id AS p FROM conditions WHERE status = 'active' ORDER BY 1 LIMIT 10)) AS id_sample FROM conditions WHERE status = 'active'", ("conditions",))
add("gov07_phi_tables", lambda p: p.select("p_partkey", governance.is_phi(F.element_at(F.array(F.lit("Patients"), F.lit("drugs"), F.lit("claim")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("phi")), "SELECT p_partkey, p_partkey % 3 <> 1 AS phi FROM part", tables=("part",))

# ---- pipelines ----


def _pipe(name: str, stages: list, sql: str, entities: tuple[str, ...]) -> None:
    add(name, lambda *f: pipeline.compile_pipeline(f[0], stages, dict(zip(entities, f, strict=True)).__getitem__), sql, entities)


_pipe("pipe01_match_group_sort", [{"$match": {"status": {"$in": ["active", "resolved"]}, "onset_date": {"$gte": "1996-01-01"}}}, {"$group": {"_id": "$condition_name", "n": {"$sum": 1}, "people": {"$addToSet": "$status"}}}, {"$match": {"n": {"$gt": 10}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 3}],
      "SELECT condition_name AS _id, COUNT(*) AS n, list(DISTINCT status ORDER BY status) AS people FROM conditions WHERE status IN ('active', 'resolved') AND onset_date >= '1996-01-01' GROUP BY 1 HAVING COUNT(*) > 10 ORDER BY 2 DESC, 1 LIMIT 3", ("conditions",))
_pipe("pipe02_project_fields", [{"$match": {"$or": [{"status": "active"}, {"patient_id": "3"}]}}, {"$addFields": {"year": {"$year": "$onset_ts"}, "open": {"$cond": [{"$eq": ["$status", "active"]}, 1, 0]}}}, {"$project": {"source_fhir_id": 1, "year": 1, "open": 1, "label": {"$concat": ["$status", ":", "$condition_name"]}}}],
      "SELECT source_fhir_id, year(onset_ts) AS year, CASE WHEN status = 'active' THEN 1 ELSE 0 END AS open, status || ':' || condition_name AS label FROM conditions WHERE status = 'active' OR patient_id = '3'", ("conditions",))
_pipe("pipe06_skip_limit_count", [{"$sort": {"source_fhir_id": 1}}, {"$skip": 100}, {"$limit": 250}, {"$match": {"status": {"$ne": "active"}}}, {"$count": "n"}], "SELECT COUNT(*) AS n FROM (SELECT * FROM conditions ORDER BY source_fhir_id LIMIT 250 OFFSET 100) WHERE status <> 'active'", ("conditions",))
_pipe("pipe08_lookup_unwind", [{"$match": {"status": "active"}}, {"$lookup": {"from": "patients", "localField": "patient_id", "foreignField": "patient_id", "as": "p"}}, {"$unwind": "$p"}, {"$group": {"_id": "$p.state", "n": {"$sum": 1}}}], "SELECT state AS _id, COUNT(*) AS n FROM conditions JOIN patients USING (patient_id) WHERE status = 'active' GROUP BY 1", ("conditions", "patients"))
FACETS = [{"$facet": {
    "top": [{"$group": {"_id": "$condition_name", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 3}],
    "active": [{"$match": {"status": "active"}}, {"$count": "n"}], "none": [{"$match": {"status": "no such"}}, {"$count": "n"}],
    "kinds": [{"$match": {"condition_name": {"$ne": None}}}, {"$group": {"_id": "$status", "n": {"$sum": 1}, "last": {"$max": "$condition_name"}}}],
}}]
add("pipe10_facet_once", lambda c: pipeline.compile_pipeline(c, FACETS).select(*(F.to_json(x).alias(x) for x in ("top", "active", "none", "kinds"))),
    """SELECT (SELECT '[' || string_agg('{"_id":"' || condition_name || '","n":' || n || '}', ',' ORDER BY n DESC, condition_name) || ']' FROM (SELECT condition_name, COUNT(*) AS n FROM conditions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS top,
      (SELECT '[{"n":' || COUNT(*) || '}]' FROM conditions WHERE status = 'active') AS active, '[{"n":0}]' AS none,
      (SELECT '[' || string_agg('{"_id":"' || status || '","n":' || n || ',"last":"' || last || '"}', ',' ORDER BY status) || ']' FROM (SELECT status, COUNT(*) AS n, MAX(condition_name) AS last FROM conditions WHERE condition_name IS NOT NULL GROUP BY 1)) AS kinds""", ("conditions",))
add("pipe10_facet_buckets", lambda c: pipeline.compile_pipeline(c, [{"$facet": {"sizes": [{"$bucket": {"groupBy": "$total_value", "boundaries": [0, 10000, 100000, 200000], "default": "more"}}], "states": [{"$group": {"_id": "$status", "n": {"$sum": 1}}}, {"$sort": {"_id": -1}}, {"$skip": 1}, {"$limit": 1}]}}]).select(*(F.to_json(x).alias(x) for x in ("sizes", "states"))),
    """SELECT (SELECT '[' || string_agg('{"_id":"' || k || '","count":' || n || '}', ',' ORDER BY k) || ']' FROM (SELECT CASE WHEN total_value >= 0 AND total_value < 10000 THEN '0' WHEN total_value >= 10000 AND total_value < 100000 THEN '10000' WHEN total_value >= 100000 AND total_value < 200000 THEN '100000' ELSE 'more' END AS k, COUNT(*) AS n FROM claims GROUP BY 1)) AS sizes,
      (SELECT '[' || string_agg('{"_id":"' || status || '","n":' || n || '}', ',') || ']' FROM (SELECT status, COUNT(*) AS n FROM claims GROUP BY 1 ORDER BY 1 DESC LIMIT 1 OFFSET 1)) AS states""", ("claims",))
_pipe("pipe10_facet", [{"$facet": {"by_status": [{"$group": {"_id": "$status", "n": {"$sum": 1}}}], "total": [{"$count": "n"}]}}, {"$project": {"n_status": {"$size": "$by_status"}, "n_total": {"$size": "$total"}}}], "SELECT CAST(COUNT(DISTINCT status) AS INT) AS n_status, 1 AS n_total FROM conditions", ("conditions",))
_pipe("pipe11_bucket", [{"$bucket": {"groupBy": "$value", "boundaries": [0, 5, 50, 200], "default": "more", "output": {"n": {"$sum": 1}, "top": {"$max": "$value"}}}}], "SELECT CASE WHEN value >= 0 AND value < 5 THEN '0' WHEN value >= 5 AND value < 50 THEN '5' WHEN value >= 50 AND value < 200 THEN '50' ELSE 'more' END AS _id, COUNT(*) AS n, MAX(value) AS top FROM observations GROUP BY 1", ("observations",))
_pipe("pipe18_switch", [{"$group": {"_id": {"$switch": {"branches": [{"case": {"$lt": ["$value", 10]}, "then": "low"}, {"case": {"$and": [{"$gte": ["$value", 10]}, {"$lt": ["$value", 100]}]}, "then": "mid"}], "default": "high"}}, "total": {"$sum": {"$cond": [{"$eq": ["$status", "final"]}, 1, 0]}}, "mean": {"$avg": "$value"}}}, {"$project": {"total": 1, "mean": {"$cond": [{"$gt": ["$mean", 0]}, "yes", "no"]}}}],
      "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS _id, CAST(SUM(CASE WHEN status = 'final' THEN 1 ELSE 0 END) AS BIGINT) AS total, 'yes' AS mean FROM observations GROUP BY 1", ("observations",))
_pipe("agg35_many_conditions", [{"$group": {"_id": "$patient_id", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 12}}}, {"$sort": {"n": -1, "_id": 1}}], "SELECT patient_id AS _id, COUNT(*) AS n FROM conditions GROUP BY 1 HAVING COUNT(*) >= 12", ("conditions",))
_pipe("agg36_most_prescribed", [{"$group": {"_id": "$medication_name", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 20}], "SELECT medication_name AS _id, COUNT(*) AS n FROM medications GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", ("medications",))
add("pipe12_sample", lambda c: pipeline.sample(c.select("source_fhir_id"), 25).agg(F.count_distinct("source_fhir_id").alias("n")), "SELECT least(25, COUNT(*)) AS n FROM conditions", ("conditions",))
add("pipe20_find", lambda c: pipeline.execute(lambda _: c.orderBy("source_fhir_id"), "conditions", '{"status": "active", "condition_name": {"$regex": "urgent", "$options": "i"}}', "find", {"source_fhir_id": 1, "status": 1}, 1000), "SELECT source_fhir_id, status FROM conditions WHERE status = 'active' AND condition_name ILIKE '%urgent%' ORDER BY source_fhir_id LIMIT 500", ("conditions",))
add("pipe21_bulk", lambda c: pipeline.bulk(lambda _: c, [{"collection": "c", "pipeline": [{"$match": {"status": s}}, {"$group": {"_id": "$condition_name", "n": {"$sum": 1}}}]} for s in ("active", "resolved")])[0], "SELECT i AS query_idx, condition_name AS _id, COUNT(*) AS n FROM conditions JOIN (VALUES (0, 'active'), (1, 'resolved')) v(i, s) ON status = s GROUP BY 1, 2", ("conditions",))
add("pipe22_pagination", lambda c: pipeline.paginate(c.select("source_fhir_id", "status"), [F.asc("source_fhir_id")], 40, 30), "SELECT source_fhir_id, status FROM conditions ORDER BY source_fhir_id LIMIT 30 OFFSET 40", ("conditions",))
add("src14_batch_read", lambda c: pipeline.batches(c.select("source_fhir_id"), "source_fhir_id", 300, 5000).groupBy("batch_number").agg(F.count("*").alias("n"), F.min("source_fhir_id").alias("least")), "SELECT (r - 1) // 300 AS batch_number, COUNT(*) AS n, MIN(source_fhir_id) AS least FROM (SELECT source_fhir_id, row_number() OVER (ORDER BY source_fhir_id) AS r FROM conditions) WHERE r <= 5000 GROUP BY 1", ("conditions",))
add("src17_schema_paths", lambda c: observe.schema_paths(c.select("patient_id", F.struct("status", F.struct("onset_date").alias("inner")).alias("s"))), "SELECT * FROM (VALUES ('patient_id', 'string'), ('s', 'struct<status:string,inner:struct<onset_date:string>>'), ('s.status', 'string'), ('s.inner', 'struct<onset_date:string>'), ('s.inner.onset_date', 'string')) v(path, type)", ("conditions",))
add("src21_counts", lambda o, c: observe.table_counts({"orders": o, "customer": c}), "SELECT 'orders' AS table_name, COUNT(*) AS n FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer", tables=("orders", "customer"))

# ---- observability, state and windows ----
TRACES = F.struct  # traces are read from events: type = kind of query, value = milliseconds


def _traces(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("query_type"), F.col("value").alias("execution_time_ms"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 == 0).alias("contains_phi"), (F.col("event_id") % 5 != 0).alias("query_validated"), (F.col("event_id") % 7 != 0).alias("security_checks_passed"), "ts")


add("agg22_histogram", lambda e: observe.histogram(e, "value"), " UNION ALL ".join(f"SELECT '{b}' AS le, COUNT(*) FILTER (value <= {b}) AS count FROM events" for b in observe.BUCKETS) + " UNION ALL SELECT '+Inf', COUNT(value) FROM events", tables=("events",))
add("agg24_performance_report", lambda e: observe.performance_report(_traces(e)), """SELECT COUNT(*) AS total, COUNT(*) FILTER (event_type <> 'error') AS succeeded, COUNT(*) FILTER (event_type = 'error') AS failed, ROUND(AVG(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END), 2) AS success_rate,
    ROUND(AVG(value), 4) AS average_ms, MIN(value) AS min_ms, MAX(value) AS max_ms, (list(value ORDER BY value))[CAST(floor(COUNT(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events""", tables=("events",))
add("agg25_by_type", lambda e: observe.by_type(_traces(e), "query_type", "execution_time_ms"), "SELECT event_type AS query_type, COUNT(*) AS count, ROUND(AVG(value), 4) AS average_ms FROM events GROUP BY 1", tables=("events",))
_RATE = "ROUND(AVG(CASE WHEN {c} THEN 100.0 ELSE 0.0 END), 2)"
add("agg26_security_summary", lambda e: observe.security_summary(_traces(e)), "SELECT COUNT(*) AS total, COUNT(*) FILTER (event_id % 3 = 0) AS phi_queries, COUNT(*) FILTER (event_id % 5 <> 0) AS validated, COUNT(*) FILTER (event_id % 7 <> 0) AS passed, " + ", ".join(f"{_RATE.format(c=c)} AS {n}" for c, n in (("event_id % 3 = 0", "phi_rate"), ("event_id % 5 <> 0", "validation_rate"), ("event_id % 7 <> 0", "pass_rate"))) + " FROM events", tables=("events",))
add("agg27_tool_stats", lambda e: observe.tool_stats(_traces(e), "query_type", "execution_time_ms", F.col("execution_time_ms") > 100), "SELECT event_type AS query_type, COUNT(*) AS calls, ROUND(SUM(value), 2) AS total_ms, ROUND(MIN(value), 2) AS min_ms, ROUND(MAX(value), 2) AS max_ms, ROUND(AVG(value), 4) AS average_ms, COUNT(*) FILTER (value > 100) AS errors FROM events GROUP BY 1", tables=("events",))
add("agg28_session_report", lambda e: observe.session_report(_traces(e), "session_id", "query_type", "execution_time_ms"), "SELECT CAST(user_id AS VARCHAR) AS session_id, COUNT(*) AS steps, list(DISTINCT event_type ORDER BY event_type) AS tools, ROUND(SUM(value), 2) AS total_ms, ROUND(AVG(value), 4) AS average_ms, MIN(value) AS min_ms, MAX(value) AS max_ms FROM events GROUP BY 1", tables=("events",))
add("srt06_last_five", lambda e: observe.last_n(e, "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id"), "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5", tables=("events",))
add("win06_tool_sequence", lambda c: observe.tool_sequence(c, "conv_id", "turn", "role"), "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS sequence FROM conversations GROUP BY 1", tables=("conversations",))
add("agg31_error_samples", lambda e: observe.error_samples(e, "event_type", "props"), "SELECT event_type, COUNT(*) AS count, list(DISTINCT props ORDER BY props)[1:3] AS samples FROM events GROUP BY 1", tables=("events",))


def _checkpoints(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderpriority").alias("pipeline_stage"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("in_progress").alias("status"), F.col("o_custkey").alias("records_processed"), (F.col("o_orderkey") % 4).alias("records_failed"), (F.col("o_orderkey") % 5).alias("retry_count"), F.col("o_orderdate").alias("start_time"))


CHECK = "WITH c AS (SELECT o_orderkey AS checkpoint_id, o_orderpriority AS pipeline_stage, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'in_progress' END AS status, o_custkey AS p, o_orderkey % 4 AS f, o_orderkey % 5 AS retry_count, o_orderdate FROM orders) "
add("agg14_checkpoint_stats", lambda o: observe.checkpoint_stats(_checkpoints(o)), CHECK + "SELECT pipeline_stage, status, grouping(pipeline_stage, status) AS level, COUNT(*) AS count, CAST(SUM(p) AS BIGINT) AS processed, CAST(SUM(f) AS BIGINT) AS failed FROM c GROUP BY GROUPING SETS ((pipeline_stage, status), (pipeline_stage), (status), ())", tables=("orders",))
add("agg15_dead_letter_stats", lambda o: observe.dead_letter_stats(_checkpoints(o).select(F.col("pipeline_stage").alias("collection_name"), F.when(F.col("checkpoint_id") % 2 == 0, "insert").otherwise("update").alias("operation"), "status", "retry_count")),
    CHECK + "SELECT collection_name, operation, status, grouping(collection_name, operation, status) AS level, COUNT(*) AS count, CAST(SUM(retry_count) AS BIGINT) AS retries FROM (SELECT pipeline_stage AS collection_name, CASE WHEN checkpoint_id % 2 = 0 THEN 'insert' ELSE 'update' END AS operation, status, retry_count FROM c) GROUP BY GROUPING SETS ((collection_name, operation, status), (collection_name), (operation), (status), ())", tables=("orders",))
add("set02_resume_points", lambda o: observe.resume_points(_checkpoints(o)).select("checkpoint_id", "status"), CHECK + "SELECT * FROM (SELECT checkpoint_id, status FROM c WHERE status = 'in_progress' ORDER BY o_orderdate DESC, checkpoint_id LIMIT 50) UNION ALL SELECT * FROM (SELECT checkpoint_id, status FROM c WHERE status = 'failed' AND retry_count < 3 ORDER BY o_orderdate DESC, checkpoint_id LIMIT 50)", tables=("orders",))
add("snk09_retention", lambda o: observe.without_old(_checkpoints(o), ["completed"], "start_time", "2000-01-01 00:00:00", 30).agg(F.count("*").alias("count")), CHECK + "SELECT COUNT(*) AS count FROM c WHERE NOT (status = 'completed' AND o_orderdate < TIMESTAMP '1999-12-02')", tables=("orders",))


def _letters(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "retry_scheduled").otherwise("archived").alias("status"), (F.col("o_orderkey") % 5).alias("retry_count"), F.lit(3).cast("long").alias("max_retries"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date").cast("string")).alias("next_retry_at"))


add("flt19_retry_candidates", lambda o: observe.retry_candidates(_letters(o), "1998-01-01").select("entry_id", "status"), "SELECT o_orderkey AS entry_id, CASE o_orderstatus WHEN 'F' THEN 'pending' ELSE 'retry_scheduled' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 5 < 3 AND (o_orderkey % 2 <> 0 OR o_orderdate <= DATE '1998-01-01')", tables=("orders",))
add("stm05_after_failure", lambda o: observe.after_failure(_letters(o), "2024-01-01 00:00:00").select("entry_id", "status", "retry_count", "next_retry_at"), "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 5 + 1 < 3 THEN 'retry_scheduled' ELSE 'archived' END AS status, o_orderkey % 5 + 1 AS retry_count, CASE WHEN o_orderkey % 5 + 1 < 3 THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * CAST(300 * pow(2, o_orderkey % 5) AS BIGINT), '%Y-%m-%d %H:%M:%S') END AS next_retry_at FROM orders", tables=("orders",))
add("win03_requests_in_window", lambda e: limits.requests_in_window(e, "user_id", "ts", 3600).select("event_id", "in_window"), "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events", tables=("events",))
# the folds, event by event and all keys at once; with a limit of two the state is the last two allowed times
LIMIT_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (
      SELECT event_id, user_id, ts, n, true AS allowed, s AS last, CAST(NULL AS BIGINT) AS before FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.ts, e.n, v.ok, CASE WHEN v.ok THEN e.s ELSE f.last END, CASE WHEN v.ok THEN f.last ELSE f.before END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT f.before IS NULL OR e.s - f.before >= 7200000000 AS ok) v
    ) """
add("stm02_rate_limit_batch", lambda e: limits.rate_limit(e.select("event_id", "user_id", "ts"), "user_id", "ts", 2, 7200.0, "event_id").select("event_id", "allowed"), LIMIT_SQL + "SELECT event_id, allowed FROM f", tables=("events",))
add("stm03_circuit_breaker_batch", lambda e: limits.circuit_breaker(e.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok")), "user_id", "ts", "ok", 2, 36000.0, 2, tie="event_id").select("event_id", "state"),
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (
      SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, user_id, '' AS met, 'closed' AS state, 0 AS failed, 0 AS won, CAST(0 AS BIGINT) AS since FROM e WHERE n = 1
      UNION ALL SELECT e.n, e.event_id, e.user_id, m.met,
        CASE WHEN m.met = 'closed' AND NOT e.ok AND f.failed + 1 >= 2 THEN 'open' WHEN m.met = 'half_open' AND NOT e.ok THEN 'open' WHEN m.met = 'half_open' AND m.won + 1 >= 2 THEN 'closed' ELSE m.met END,
        CASE WHEN m.met = 'closed' THEN CASE WHEN e.ok THEN 0 ELSE f.failed + 1 END WHEN m.met = 'half_open' AND e.ok AND m.won + 1 >= 2 THEN 0 ELSE f.failed END,
        CASE WHEN m.met = 'half_open' AND e.ok THEN m.won + 1 ELSE m.won END,
        CASE WHEN NOT e.ok AND (m.met = 'half_open' OR m.met = 'closed' AND f.failed + 1 >= 2) THEN e.s ELSE f.since END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1,
        LATERAL (SELECT CASE WHEN f.state = 'open' AND e.s - f.since >= 36000000000 THEN 'half_open' ELSE f.state END AS met, CASE WHEN f.state = 'open' AND e.s - f.since >= 36000000000 THEN 0 ELSE f.won END AS won) m
    ) SELECT event_id, met AS state FROM f WHERE n > 0""", tables=("events",))
add("win03_requests_in_blocks", lambda e: limits.requests_in_blocks(e, "user_id", "ts", 3600, 24).select("event_id", "in_window"), _SQL["win03_requests_in_window"], tables=("events",))
add("stm02_rate_limit_blocks", lambda e: limits.rate_limit_blocks(e.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 7200.0, 24).select("event_id", "allowed"), _SQL["stm02_rate_limit_batch"], tables=("events",))
add("stm03_circuit_breaker_blocks", lambda e: limits.circuit_breaker_blocks(e.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok")), "user_id", "ts", "ok", "event_id", 2, 36000.0, 2, seconds=864_000.0).select("event_id", "state"), _SQL["stm03_circuit_breaker_batch"], tables=("events",))
add("win07_numbered_events", lambda e: scans.numbered_steps(e, "event_type", ["ts", "event_id"]).select("event_id", "step"), "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events", tables=("events",))
add("udf06_variance_by_type", lambda e: user.user_aggregate(e, ["event_type"], "value", user.VARIANCE, "variance").select("event_type", F.round("variance", 4).alias("variance")), "SELECT event_type, ROUND(VAR_POP(value), 4) AS variance FROM events GROUP BY 1", tables=("events",))
add("udf06_sessions", lambda e: user.sessions(e.select("user_id", "ts"), "user_id", "ts", 43_200.0).select("user", "session", "start", "end", "n"),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
      SELECT user_id AS "user", CAST(session AS BIGINT) AS session, MIN(ts) AS start, MAX(ts) AS "end", COUNT(*) AS n FROM s GROUP BY 1, 2""", tables=("events",))
add("stm07_sessions", lambda e: limits.sessions_expired(e.withColumn("ip", F.col("event_id") % 2), "user_id", "ts", "ip").agg(F.count_if("expired").alias("expired"), F.count_if("moved").alias("moved")), "SELECT COUNT(*) FILTER (gap > 1800000000) AS expired, COUNT(*) FILTER (moved) AS moved FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, event_id % 2 <> first_value(event_id % 2) OVER w AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))", tables=("events",))
add("agg33_health", lambda e: observe.health(_traces(e), "success"), "SELECT COUNT(*) AS checks, ROUND(AVG(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END), 2) AS success_rate, AVG(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END) >= 80 AS healthy FROM events", tables=("events",))
add("agg38_audit_summary", lambda e: observe.audit_summary(_traces(e).select("ts", "success", F.col("execution_time_ms").alias("result_count"), F.col("session_id").alias("user_id")), "2024-01-30 00:00:00"), "SELECT COUNT(*) AS access_events, COUNT(*) FILTER (event_type = 'error') AS failures, COUNT(*) FILTER (value > 50) AS high_volume, COUNT(DISTINCT user_id) AS unique_users FROM events WHERE ts >= TIMESTAMP '2024-01-23'", tables=("events",))
add("agg39_counters", lambda e: observe.counters(e, "event_type", "user_id"), "SELECT event_type, user_id, COUNT(*) AS events, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2", tables=("events",))
add("snk12_prometheus", lambda e: observe.prometheus(e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")).select("name", F.lit("counter").alias("kind"), F.lit("events").alias("help"), "value")), "SELECT unnest(['# HELP ' || n || ' events', '# TYPE ' || n || ' counter', n || ' ' || c]) AS line FROM (SELECT event_type AS n, COUNT(*) AS c FROM events GROUP BY 1)", tables=("events",))
add("srt02_page_of_months", lambda c: A.conditions_by_month(c, 7), "SELECT year(onset_ts) AS year, month(onset_ts) AS month, COUNT(*) AS condition_count, COUNT(DISTINCT patient_id) AS patient_count, COUNT(DISTINCT condition_name) AS unique_conditions, COUNT(*) FILTER (status = 'active') AS active_count FROM conditions GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 7", ("conditions",))
add("src13_scan_filter_project", lambda l: l.where("l_shipdate >= '1998-01-01' AND l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey"), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 40", tables=("lineitem",))

# ---- runtime ----
add("prj01_include", lambda c: runtime.include(c, ["source_fhir_id", "status", "absent"]), "SELECT source_fhir_id, status FROM conditions", ("conditions",))
add("prj01_exclude", lambda p: runtime.exclude(p, ["first_name", "last_name", "balance"]), "SELECT * EXCLUDE (first_name, last_name, balance) FROM patients", ("patients",))
add("prj05_nested", lambda p: p.select("patient_id", F.struct("city", F.col("birth_date").alias("born")).alias("a")).transform(lambda d: d.select("patient_id", runtime.nested(d, "a.born", "none").alias("born"), runtime.nested(d, "a.zip", "none").alias("zip"))), "SELECT patient_id, coalesce(birth_date, 'none') AS born, 'none' AS zip FROM patients", ("patients",))
add("flt18_list_checkpoints", lambda o: runtime.listed(_checkpoints(o), "start_time", "checkpoint_id", 50, status="failed", pipeline_stage="1-URGENT").select("checkpoint_id", "status"), CHECK + "SELECT checkpoint_id, status FROM c WHERE status = 'failed' AND pipeline_stage = '1-URGENT' ORDER BY o_orderdate DESC, checkpoint_id LIMIT 50", tables=("orders",))
add("flt20_failures", lambda e: runtime.failures(e.select("event_id", F.when(F.col("event_type") == "error", "bad").alias("error_message"), F.struct(F.when(F.col("value") > 100, "slow").alias("error")).alias("tool_call"))).select("event_id", "error"), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'slow' END AS error FROM events WHERE event_type = 'error' OR value > 100", tables=("events",))
add("flt21_by_id", lambda c: runtime.by_id(c.where("status = 'active'"), c, "source_fhir_id", "42").select("source_fhir_id", "patient_id"), "SELECT source_fhir_id, patient_id FROM conditions WHERE source_fhir_id = '42'", ("conditions",))
add("hsh03_checkpoint_key", lambda c: c.select("source_fhir_id", runtime.checkpoint_key("patient_id", "condition_name", "status", "onset_date").alias("key")), "SELECT source_fhir_id, concat_ws('|', patient_id, condition_name, status, onset_date) AS key FROM conditions", ("conditions",))
add("srt09_common_fields", lambda p: runtime.common_fields(p.select("patient_id", "birth_date", "gender"), 2), "SELECT * FROM (SELECT 'patient_id' AS field, COUNT(patient_id) AS filled FROM patients UNION ALL SELECT 'birth_date', COUNT(birth_date) FROM patients UNION ALL SELECT 'gender', COUNT(gender) FROM patients) ORDER BY 2 DESC, 1 LIMIT 2", ("patients",))
add("dt06_expired", lambda e: e.where(runtime.expired(F.col("ts").cast("timestamp"), "2024-01-20 00:00:00", 90)).agg(F.count("*").alias("count")), "SELECT COUNT(*) AS count FROM events WHERE ts < TIMESTAMP '2024-01-19 22:30:00'", tables=("events",))
add("stm06_bad_transitions", lambda e: runtime.bad_transitions(e.select(F.col("user_id").alias("checkpoint_id"), F.col("event_id").alias("at"), F.element_at(F.array(*map(F.lit, ("started", "in_progress", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"))).agg(F.count("*").alias("count")),
    """SELECT COUNT(*) AS count FROM (SELECT ['started', 'in_progress', 'completed', 'failed'][event_id % 4 + 1] AS s, lag(['started', 'in_progress', 'completed', 'failed'][event_id % 4 + 1]) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    WHERE NOT coalesce((b IS NULL AND s = 'started') OR (b = 'started' AND s IN ('in_progress', 'failed')) OR (b = 'in_progress' AND s IN ('in_progress', 'completed', 'failed')) OR (b = 'failed' AND s = 'in_progress'), false)""", tables=("events",))
add("agg30_enrichment_stats", lambda p: fhir.enrichment_stats(p, "patients", ["birth_date", "city"]), "SELECT 'patients' AS collection, 'birth_date' AS field, COUNT(birth_date) AS count, MIN(birth_date) AS sample FROM patients UNION ALL SELECT 'patients', 'city', COUNT(city), MIN(city) FROM patients", ("patients",))
add("udf04_clinical_summary", lambda d: d.select("doc_id", F.sha2(fhir.clinical_summary(F.col("text")), 256).alias("summary")),
    rf"SELECT doc_id, CASE WHEN length(c) < 20 THEN NULL ELSE sha256(c) END AS summary FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r\f]+', '', 'g'), '<[^>]+>', '', 'g'), '{SP}', ' ', 'g')) AS c FROM documents)", tables=("documents",))
add("agg40_collection_counters", lambda o: observe.counters(_checkpoints(o), "pipeline_stage", "status", value="records_processed"), CHECK + "SELECT pipeline_stage, status, COUNT(*) AS events, CAST(SUM(p) AS BIGINT) AS total FROM c GROUP BY 1, 2", tables=("orders",))
add("srt10_keep_last_fifty", lambda e: observe.last_n(e, "event_type", [F.desc("event_id")], 50).select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 50", tables=("events",))
add("agg23_metrics_summary", lambda e: observe.metrics_summary(_traces(e), "success", "execution_time_ms"), "SELECT ROUND(AVG(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END), 2) AS success_rate, ROUND(AVG(value), 4) AS average_duration, COUNT(*) AS operations FROM events", tables=("events",))

# ---- streams, run over what is there ----


def _stream(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, mode: str = "append") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = read_table(spark, sf_dir, "events").schema
        return bounded.drain(make(stateful.file_stream(spark, f"{sf_dir}/events.parquet", schema)), mode)

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


_stream("stm01_windowed_counts", lambda e: stateful.windowed_counts(e, "ts", "event_type", "1 day", "1 hour").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "count"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS count FROM events GROUP BY 1, 2", "complete")
_stream("stm02_rate_limit_stream", lambda e: stateful.rate_limit(e.select("user_id", "ts"), "user_id", "ts", 2, 7200.0), LIMIT_SQL + "SELECT CAST(user_id AS VARCHAR) AS key, ts, allowed FROM f")
catalog_state.add("stm02_rate_limit_machine", lambda: machines.RateLimit(2, 7200.0), lambda: "request", LIMIT_SQL + "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS tie, epoch_us(ts) AS micros, CASE WHEN allowed THEN 'allowed' ELSE 'refused' END AS what FROM f")
_stream("stm09_dedup_stream", lambda e: stateful.dedup(e.select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | catalog_etl.QUERIES | catalog_state.QUERIES | catalog_requests.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_etl.SQL | catalog_state.SQL | catalog_requests.SQL
