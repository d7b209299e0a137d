"""Clinical entities over the star-schema tables, as views.

The texts run in Spark SQL and in DuckDB alike: names in braces stand for tables. Each entity carries
its dates twice, as the stored string and as a typed ``*_ts`` on which range filters are pushed down.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ENTITIES = {
    "patients": """
        SELECT CAST(c.c_custkey AS STRING) AS patient_id, c.c_mktsegment AS first_name, c.c_name AS last_name,
          CASE c.c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' ELSE 'unknown' END AS gender,
          CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(1930 + c.c_custkey % 90 AS STRING) || '-0' || CAST(1 + c.c_custkey % 9 AS STRING) || '-15' END AS birth_date,
          n.n_name AS city, r.r_name AS state, r.r_name AS race, n.n_name AS ethnicity, c.c_acctbal AS balance
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "conditions": """
        SELECT CAST(o_orderkey AS STRING) AS source_fhir_id, CAST(o_custkey AS STRING) AS patient_id, o_orderpriority AS condition_name,
          CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'resolved' ELSE 'inactive' END AS status,
          CASE o_orderkey % 3 WHEN 0 THEN 'provisional' ELSE 'confirmed' END AS verification_status,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS onset_date, o_orderdate AS onset_ts, o_orderdate AS recorded_ts
        FROM {orders}""",
    "claims": """
        SELECT CAST(o.o_orderkey AS STRING) AS claim_id, CAST(o.o_custkey AS STRING) AS patient_id, c.c_name AS patient_display_name,
          o.o_totalprice AS total_value, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS billable_period_start, o.o_orderdate AS billable_ts,
          c.c_mktsegment AS insurance_display, n.n_name AS facility_display,
          CASE o.o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'cancelled' ELSE 'draft' END AS status
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "eobs": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS eob_id, CAST(o.o_custkey AS STRING) AS patient_id,
          CAST(l.l_orderkey AS STRING) AS claim_reference, s.s_name AS insurer_display, 'NATION_' || CAST(s.s_nationkey AS STRING) AS facility_display,
          CASE l.l_linestatus WHEN 'O' THEN 'active' ELSE 'cancelled' END AS status,
          CASE l.l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'partial' ELSE 'complete' END AS outcome,
          l.l_extendedprice AS total_submitted_value, l.l_extendedprice * (1 - l.l_discount) AS adjudicated_value, l.l_extendedprice * l.l_tax AS denied_value,
          CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS billable_period_start, l.l_shipdate AS billable_ts
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "medications": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS source_fhir_id, CAST(o.o_custkey AS STRING) AS patient_id,
          p.p_name || ' ' || CAST(p.p_partkey AS STRING) AS medication_name, CASE l.l_linestatus WHEN 'O' THEN 'active' ELSE 'stopped' END AS status,
          CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS prescribed_date, l.l_shipdate AS prescribed_ts, s.s_name AS prescriber
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "drugs": """
        SELECT CAST(p_partkey AS STRING) AS ingredient_rxcui, p_name || ' ' || CAST(p_partkey AS STRING) AS primary_drug_name, p_brand AS therapeutic_class_l2, p_type AS drug_class_l3,
          'S' || CAST(p_size AS STRING) AS drug_subclass_l4 FROM {part}""",
    "observations": """
        SELECT CAST(event_id AS STRING) AS source_fhir_id, CAST(user_id AS STRING) AS patient_id, event_type AS test_name, value, 'U' || CAST(event_id % 3 AS STRING) AS unit,
          CASE WHEN event_id % 11 = 0 THEN 'preliminary' ELSE 'final' END AS status,
          CASE WHEN event_type IN ('view', 'click') THEN 'vital_sign' ELSE 'lab_result' END AS observation_type,
          CAST(CAST(ts AS DATE) AS STRING) AS test_date, ts AS test_ts, props FROM {events}""",
    "encounters": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS source_fhir_id, CAST(o.o_custkey AS STRING) AS patient_id,
          CASE l.l_returnflag WHEN 'R' THEN 'emergency' WHEN 'A' THEN 'ambulatory' ELSE 'inpatient' END AS encounter_type, p.p_type AS visit_reason,
          CASE l.l_linestatus WHEN 'O' THEN 'finished' ELSE 'planned' END AS status, s.s_name AS provider, 'NATION_' || CAST(s.s_nationkey AS STRING) AS location,
          CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS start_date, l.l_shipdate AS start_ts
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "procedures": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS source_fhir_id, CAST(o.o_custkey AS STRING) AS patient_id,
          p.p_type AS procedure_name, CASE WHEN p.p_size < 17 THEN 'surgical' WHEN p.p_size < 34 THEN 'diagnostic' ELSE 'therapeutic' END AS procedure_category,
          CASE l.l_linestatus WHEN 'O' THEN 'completed' ELSE 'in-progress' END AS status, 'NATION_' || CAST(s.s_nationkey AS STRING) AS location,
          CASE l.l_returnflag WHEN 'N' THEN 'success' WHEN 'A' THEN 'partial' ELSE 'complication' END AS outcome,
          CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS performed_date, l.l_shipdate AS performed_ts
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "immunizations": """
        SELECT CAST(event_id AS STRING) AS source_fhir_id, CAST(user_id AS STRING) AS patient_id, event_type AS vaccine_name,
          CASE WHEN event_id % 13 = 0 THEN 'not-done' ELSE 'completed' END AS status, 'site ' || CAST(user_id % 10 AS STRING) AS location,
          CAST(CAST(ts AS DATE) AS STRING) AS administration_date, ts AS administration_ts FROM {events}""",
    "allergies": """
        SELECT CAST(o_orderkey AS STRING) AS source_fhir_id, CAST(o_custkey AS STRING) AS patient_id, 'allergen ' || CAST(o_orderkey % 20 AS STRING) AS allergy_name,
          CASE o_orderkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'medication' WHEN 2 THEN 'environment' ELSE 'biologic' END AS category,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'moderate' END AS severity,
          CASE o_orderstatus WHEN 'F' THEN 'active' ELSE 'resolved' END AS status,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS recorded_date, o_orderdate AS recorded_ts FROM {orders}""",
    "care_plans": """
        SELECT CAST(o_orderkey AS STRING) AS source_fhir_id, CAST(o_custkey AS STRING) AS patient_id, 'Plan ' || o_orderpriority || ' ' || CAST(o_orderkey % 7 AS STRING) AS plan_name,
          CASE o_orderstatus WHEN 'F' THEN 'active' ELSE 'inactive' END AS status,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS start_date, o_orderdate AS start_ts FROM {orders}""",
    "diagnostic_reports": """
        SELECT CAST(doc_id AS STRING) AS source_fhir_id, CAST(doc_id % 150 AS STRING) AS patient_id, lang AS report_type, text AS clinical_summary,
          CAST(2010 + doc_id % 12 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) || '-1' || CAST(doc_id % 10 AS STRING) AS report_date FROM {documents}""",
}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", ENTITIES[name])))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A clinical entity as a DataFrame; Catalyst prunes what a query leaves out."""
    return spark.sql(ENTITIES[name], **{t: read_table(spark, sf_dir, t) for t in tables_of(name)})


def entity_sql(*names: str) -> str:
    """The entities as a WITH clause for an SQL engine that has the tables."""
    return "WITH " + ",\n".join(f"{n} AS ({ENTITIES[n].format(**{t: t for t in tables_of(n)})})" for n in names) + "\n"
