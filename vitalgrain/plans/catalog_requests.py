"""Entries of checks, names and layouts, over logs of requests made from ``events`` and other given tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.operators import observe, runtime, scans, sinks, text_index
from vitalgrain.operators import request_log as R
from vitalgrain.plans import catalog_etl as T
from vitalgrain.plans import pipeline
from vitalgrain.sources import fhir
from vitalgrain.sources.entities import entity, read_table
from vitalgrain.streaming.bounded import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(read_table(spark, sf_dir, table))
    SQL[name] = sql


def pick(column: str, *values):
    """One of the values by a number."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(column) % len(values) + 1).cast("int"))


def sql_pick(column: str, *values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{column} % {len(values)} + 1]"


IDS, NAMES, STARTS, ENDS = ("p-1", "a b", None, "x_2", ""), ("Ann", "O'Neil", "a_b", None), ("2024-01-05", None, "2024-02-30", "5 May"), ("2024-01-04", "2024-06-01", None)
add("flt15_validators", "events", lambda e: e.select("event_id", pick("event_id", *IDS).alias("p"), pick("event_id", *NAMES).alias("n"), (F.col("event_id") % 700).alias("l"), pick("event_id", *STARTS).alias("s"), pick("event_id", *ENDS).alias("e"))
    .select("event_id", F.array_join(R.problems("p", "n", "l", "s", "e"), ",").alias("problems"), R.capped("l").alias("limit")),
    f"""SELECT event_id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(p, '[a-zA-Z0-9_-]+') THEN 'patient_id' END, CASE WHEN n = 'a_b' THEN 'name' END, CASE WHEN l < 1 THEN 'limit' END, CASE WHEN s IN ('2024-02-30', '5 May') THEN 'start' END, CASE WHEN s = '2024-01-05' AND e = '2024-01-04' THEN 'range' END], lambda x: x IS NOT NULL), ',') AS problems, least(l, 500) AS "limit"
    FROM (SELECT event_id, event_id % 700 AS l, {sql_pick('event_id', *IDS)} AS p, {sql_pick('event_id', *NAMES)} AS n, {sql_pick('event_id', *STARTS)} AS s, {sql_pick('event_id', *ENDS)} AS e FROM events)""")  # fmt: skip

PIPES = {
    '[{"$match": {"status": "active"}}]': (3, 1, 0, 0, "minimal"), '[{"$group": {"_id": "$a"}}, {"$sort": {"a": 1}}]': (3, 2, 0, 3, "low"), '[{"$lookup": {}}, {"$facet": {"x": [{"$match": {}}]}}, {"$sort": {}}]': (6, 3, 0, 7, "medium"),
    '[{"$out": "x"}, {}, {"$what": 1}]': (2, 3, 3, 0, None), '{"a": [{"b": {"c": 1}}]}': (4, 0, 1, 0, None), "no JSON": (0, 0, 1, 0, None),
}


def _pipes(name: str, columns: dict[str, Callable]) -> None:
    values = ", ".join(f"({i}, {', '.join('NULL' if x is None else repr(x) for x in v)})" for i, v in enumerate(PIPES.values()))
    add(name, "events", lambda e: R.query_checks(e.select("event_id", pick("event_id", *PIPES).alias("query")), "query").select("event_id", *(c().alias(n) for n, c in columns.items())),
        f"SELECT event_id, {', '.join(columns)} FROM events JOIN (VALUES {values}) v(i, depth, stages, problems, weight, complexity) ON event_id % {len(PIPES)} = i")


_pipes("flt16_depth", {"depth": lambda: F.col("depth")})
_pipes("pipe14_checked", {"stages": lambda: F.col("stages")})
_pipes("pipe15_problems", {"problems": lambda: F.size("problems")})
_pipes("pipe16_estimate", {"weight": lambda: F.col("weight"), "complexity": lambda: F.col("complexity")})

ROLES, WANTS = ("admin", "clinician", "researcher", "billing", "read_only"), ("read_phi", "read_financial", "read_aggregates")
add("gov06_permissions", "events", lambda e: e.select(pick("user_id", *ROLES).alias("role"), pick("event_id", *WANTS).alias("permission")).withColumn("allowed", R.permitted("role", "permission")).groupBy("role", "permission", "allowed").agg(F.count("*").alias("n")),
    f"""SELECT role, permission, role = 'admin' OR role || permission IN ('clinicianread_phi', 'researcherread_aggregates', 'billingread_financial') AS allowed, COUNT(*) AS n
    FROM (SELECT {sql_pick('user_id', *ROLES)} AS role, {sql_pick('event_id', *WANTS)} AS permission FROM events) GROUP BY 1, 2, 3""")  # fmt: skip
add("hsh02_cache_key", "events", lambda e: e.select("event_id", F.col("event_type").alias("o"), F.when(F.col("event_id") % 2 == 0, F.format_string('{"b": %d, "a": "x"}', "user_id")).otherwise(F.format_string('{"a": "x", "b": %d}', "user_id")).alias("p"), pick("user_id", *ROLES).alias("r")).select("event_id", R.cache_key("o", "p", "r").alias("key")),
    f"""SELECT event_id, sha256('["' || event_type || '", {{"a": "x", "b": ' || user_id || '}}, "' || {sql_pick('user_id', *ROLES)} || '"]') AS key FROM events""")

FAULTS = (None, "timeout", "validation", "not_found", "rate", "access", "strange")
CODES = (None, "source_error", "validation_error", "not_found", "rate_limited", "access_denied", "engine_error")
_faults = lambda e: e.select("event_id", R.envelope("k", "props", "event_type").alias("e"), "k")
add("err01_envelope", "events", lambda e: _faults(e.withColumn("k", pick("event_id", *FAULTS))).select("event_id", "e.success", "e.message", "e.operation"),
    f"SELECT event_id, event_id % 7 = 0 AS success, CASE WHEN event_id % 7 <> 0 THEN props END AS message, event_type AS operation FROM events")  # noqa: F541
add("err02_kinds", "events", lambda e: _faults(e.withColumn("k", pick("event_id", *FAULTS))).groupBy(F.col("e.error").alias("error")).agg(F.count("*").alias("n")), f"SELECT {sql_pick('event_id', *CODES)} AS error, COUNT(*) AS n FROM events GROUP BY 1")
RAW = sorted(fhir.RAW_NAMES.values())
add("err03_table_names", "events", lambda e: e.select("event_id", pick("event_id", *RAW).alias("raw")).withColumn("final", R.renamed("raw", fhir.FINAL_NAMES)).withColumn("back", R.renamed("final", {v: k for k, v in fhir.FINAL_NAMES.items()})).groupBy("raw", "final", "back").agg(F.count("*").alias("n")),
    f"""SELECT raw, CASE raw WHEN 'allergyintolerances' THEN 'allergies' WHEN 'medicationrequests' THEN 'medications' WHEN 'careplans' THEN 'care_plans' ELSE raw END AS final, raw AS back, COUNT(*) AS n FROM (SELECT {sql_pick('event_id', *RAW)} AS raw FROM events) GROUP BY 1""")


def _registry(resources: DataFrame) -> DataFrame:
    """What each registered transform makes of the resources that are there: rows, and those whose first column is filled."""
    there = {fhir.final_name(fhir.RAW_NAMES[r[0]]) for r in resources.select("resource_type").distinct().collect() if r[0] in fhir.RAW_NAMES}
    out = None
    for name, df in ((n, d) for n, d in fhir.transform(resources).items() if n in there):
        one = df.agg(F.count("*").alias("n"), F.count(df.columns[0]).alias("filled")).select(F.lit(name).alias("table_name"), F.lit(df.columns[0]).alias("first_column"), "n", "filled")
        out = one if out is None else out.unionAll(one)
    return out


QUERIES["udf02_registry"] = lambda spark, sf_dir: _registry(fhir.parse(T.bundles(spark, sf_dir, ["Condition", "Patient"])))
SQL["udf02_registry"] = f"SELECT 'conditions' AS table_name, 'condition_name' AS first_column, COUNT(*) AS n, COUNT(condition_name) AS filled FROM ({T.SQL['udf01_conditions']}) UNION ALL SELECT 'patients', 'patient_id', COUNT(*), COUNT(patient_id) FROM ({T.SQL['udf01_patients']})"


def _flaky(row: dict, attempt: int) -> str:
    """Stands for a service that some rows reach at once, some later and some never."""
    if row["c_custkey"] % 11 == 0:
        raise ValueError("bad row")
    if attempt <= row["c_custkey"] % 4:
        raise TimeoutError("not yet")
    return row["c_mktsegment"].lower()


add("stm04_retry", "customer", lambda c: R.tried(c.select("c_custkey", "c_mktsegment"), _flaky, "answer", 3).drop("c_mktsegment"),
    "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 4 < 3 THEN lower(c_mktsegment) END AS answer, CAST(CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE least(c_custkey % 4 + 1, 3) END AS INT) AS tries, CASE WHEN c_custkey % 11 = 0 THEN 'engine_error' WHEN c_custkey % 4 = 3 THEN 'source_error' END AS error FROM customer")

def _batches(c: DataFrame) -> DataFrame:
    """Batches of 100 rows in order; no task has all rows."""
    numbered = scans.prefix_scan(c.select(F.lit(1).alias("all"), "c_custkey"), "all", ["c_custkey"], number="place")
    return numbered.groupBy(F.floor((F.col("place") - 1) / 100).alias("batch")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))


add("src15_cursor", "customer", _batches, "SELECT (r - 1) // 100 AS batch, COUNT(*) AS n, MIN(c_custkey) AS least FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) GROUP BY 1")


def _upper(frame):
    frame = frame.assign(segment=frame["c_mktsegment"].str.upper())
    return frame[["c_custkey", "segment"]]


add("udf05_stream_transformer", "customer", lambda c: R.transformed(c.select("c_custkey", "c_mktsegment"), _upper, "c_custkey long, segment string", 100), "SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that the catalog lists, with their rows."""
    views = {f"vg_{t}": read_table(spark, sf_dir, t) for t in ("nation", "region", "events")}
    return T._with_views(spark, views, lambda: observe.table_counts({t: spark.table(t) for t in runtime.tables(spark) if t.startswith("vg_")}))


QUERIES["src16_tables"] = _tables
SQL["src16_tables"] = "SELECT 'vg_nation' AS table_name, COUNT(*) AS n FROM nation UNION ALL SELECT 'vg_region', COUNT(*) FROM region UNION ALL SELECT 'vg_events', COUNT(*) FROM events"


def _paths(df: DataFrame) -> DataFrame:
    """Paths of the schema with how many rows fill them; one scan."""
    paths = observe.schema_paths(df).collect()  # a row per field of the schema
    one = df.agg(*(F.count(r.path).alias(str(i)) for i, r in enumerate(paths)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r.path).alias("path"), F.lit(r.type).alias("type"), F.col(str(i)).alias("filled")) for i, r in enumerate(paths)))).alias("p")).select("p.*")


add("src17_schema_paths", "events", lambda e: _paths(e.select("event_id", F.when(F.col("event_type") != "error", F.struct("user_id", F.struct(F.when(F.col("value") > 5, F.col("value")).alias("value")).alias("inner"))).alias("s"))),
    """SELECT * FROM (SELECT 'event_id' AS path, 'bigint' AS type, COUNT(*) AS filled FROM events UNION ALL SELECT 's', 'struct<user_id:bigint,inner:struct<value:double>>', COUNT(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 's.user_id', 'bigint', COUNT(*) FROM events WHERE event_type <> 'error'
      UNION ALL SELECT 's.inner', 'struct<value:double>', COUNT(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 's.inner.value', 'double', COUNT(*) FROM events WHERE event_type <> 'error' AND value > 5)""")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table's layout, and what a query for one key's bucket reads of it."""
    name = f"scratch_{shared_folder(spark).rsplit('/', 1)[-1]}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        sinks.bucketed(entity(spark, sf_dir, "conditions").select("source_fhir_id", "patient_id", "status"), f"{name}.rows", "patient_id", 8)
        facts = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}.rows").collect()}
        rows = spark.table(f"{name}.rows").groupBy("status").agg(F.count("*").alias("n")).collect()  # a row per status
    finally:
        sinks.drop_database(spark, name)
    return spark.createDataFrame([(r.status, r.n, facts["Num Buckets"], facts["Bucket Columns"]) for r in rows], "status string, n long, buckets string, columns string")


QUERIES["idx01_table_layout"] = _layout
SQL["idx01_table_layout"] = T.entity_sql("conditions") + "SELECT status, COUNT(*) AS n, '8' AS buckets, '[`patient_id`]' AS columns FROM conditions GROUP BY 1"


def _join_of_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed alike are joined without a shuffle of either; rows, and the shuffles that the plan has."""
    name = f"scratch_{shared_folder(spark).rsplit('/', 1)[-1]}"
    spark.sql(f"CREATE DATABASE {name}")
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        sinks.bucketed(entity(spark, sf_dir, "conditions").select("source_fhir_id", "patient_id"), f"{name}.a", "patient_id", 4)
        sinks.bucketed(entity(spark, sf_dir, "patients").select("patient_id", "gender"), f"{name}.b", "patient_id", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(f"{name}.a").join(spark.table(f"{name}.b"), "patient_id")
        shuffles = joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        rows = joined.groupBy("gender").agg(F.count("*").alias("n")).collect()  # a row per gender
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
        sinks.drop_database(spark, name)
    return spark.createDataFrame([(r.gender, r.n, shuffles) for r in rows], "gender string, n long, shuffles int")


QUERIES["snk06_bucketed"] = _join_of_buckets
SQL["snk06_bucketed"] = T.entity_sql("conditions", "patients") + "SELECT gender, COUNT(*) AS n, 0 AS shuffles FROM conditions JOIN patients USING (patient_id) GROUP BY 1"


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of a database, counted and then dropped with it."""
    name = f"scratch_{shared_folder(spark).rsplit('/', 1)[-1]}"
    spark.sql(f"CREATE DATABASE {name}")
    counts = []
    try:
        for t in ("orders", "events"):
            read_table(spark, sf_dir, t).write.saveAsTable(f"{name}.{t}")
            counts.append((t, spark.table(f"{name}.{t}").count()))
    finally:
        sinks.drop_database(spark, name)
    return spark.createDataFrame([(t, n, spark.catalog.tableExists(f"{name}.{t}")) for t, n in counts], "table_name string, n long, there boolean")


QUERIES["snk10_drop_database"] = _dropped
SQL["snk10_drop_database"] = "SELECT 'orders' AS table_name, COUNT(*) AS n, false AS there FROM orders UNION ALL SELECT 'events', COUNT(*), false FROM events"


def _explained(lineitem: DataFrame) -> DataFrame:
    """What the plan of a pipeline reads and pushes down, beside its result."""
    stages = [{"$match": {"l_quantity": {"$gt": 40}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}]
    found = pipeline.analyze(lineitem, stages)
    return pipeline.compile_pipeline(lineitem, stages).select("_id", "n", F.lit(found["scans"]).alias("scans"), F.lit(any("l_quantity" in p for p in found["pushed_filters"])).alias("pushed"), F.lit(len(found["hints"])).alias("hints"))


add("pipe17_explained", "lineitem", _explained, 'SELECT l_returnflag AS _id, COUNT(*) AS n, 1 AS scans, true AS pushed, 0 AS hints FROM lineitem WHERE l_quantity > 40 GROUP BY 1')
add("pipe13_add_fields", "lineitem", lambda l: pipeline.compile_pipeline(l, [{"$addFields": {"month": {"$month": "$l_shipdate"}, "large": {"$cond": [{"$lt": ["$l_quantity", 25]}, "no", "yes"]}}}, {"$group": {"_id": "$large", "n": {"$sum": 1}, "last": {"$max": "$month"}}}]),
    "SELECT CASE WHEN l_quantity < 25 THEN 'no' ELSE 'yes' END AS _id, COUNT(*) AS n, MAX(month(l_shipdate)) AS last FROM lineitem GROUP BY 1")



def _searched(term: str, literal: bool):
    def make(d: DataFrame) -> DataFrame:
        at = f"{shared_folder(d.sparkSession)}/trigrams"
        rows = d.select("doc_id", "text")
        text_index.build(rows, "doc_id", "text", at)
        return text_index.search(rows, "doc_id", "text", at, term, literal).select("doc_id")

    return make


add("flt13_indexed_search", "documents", _searched("the.", True), "SELECT doc_id FROM documents WHERE contains(lower(text), 'the.')")
add("tool11_indexed_pattern", "documents", _searched("@mail[0-9]\\.example", False), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)@mail[0-9]\\.example')")
