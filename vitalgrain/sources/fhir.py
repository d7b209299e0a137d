"""Health-record bundles: scan, routing and the twelve flattening transforms, all as Column expressions.

A file is one JSON document, a bundle or a single resource. Resources stay JSON text until their type's
schema is applied, so unknown fields cost nothing and a bad field is null rather than an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.functions import scalars as S

#: Resource type -> raw table -> clean table.
RAW_NAMES = {
    "AllergyIntolerance": "allergyintolerances", "Condition": "conditions", "Observation": "observations", "MedicationRequest": "medicationrequests",
    "Immunization": "immunizations", "Procedure": "procedures", "Encounter": "encounters", "CarePlan": "careplans", "Patient": "patients",
    "DiagnosticReport": "diagnosticreports", "Claim": "claims", "ExplanationOfBenefit": "explanationofbenefits",
}
FINAL_NAMES = {"allergyintolerances": "allergies", "medicationrequests": "medications", "careplans": "care_plans"}
VERSION = "1.0"

CODE = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"
REF = "struct<reference:string,display:string>"
PERIOD = "struct<start:string,`end`:string>"
MONEY = "struct<value:string,currency:string>"
#: The fields that each transform reads.
SCHEMAS = {
    "AllergyIntolerance": f"id string, code {CODE}, category array<string>, criticality string, clinicalStatus {CODE}, recordedDate string, patient {REF}",
    "Condition": f"id string, code {CODE}, clinicalStatus {CODE}, verificationStatus {CODE}, onsetDateTime string, recordedDate string, subject {REF}",
    "Observation": f"id string, code {CODE}, valueQuantity struct<value:string,unit:string>, status string, effectiveDateTime string, issued string, subject {REF}",
    "MedicationRequest": f"id string, medicationCodeableConcept {CODE}, medicationReference {REF}, status string, authoredOn string, requester {REF}, subject {REF}",
    "Immunization": f"id string, vaccineCode {CODE}, occurrenceDateTime string, location {REF}, status string, patient {REF}",
    "Procedure": f"id string, code {CODE}, status string, performedPeriod {PERIOD}, performedDateTime string, location {REF}, subject {REF}",
    "Encounter": f"id string, type array<{CODE}>, `class` struct<code:string>, period {PERIOD}, location array<struct<location:{REF}>>, participant array<struct<individual:{REF}>>, status string, subject {REF}",
    "CarePlan": f"id string, category array<{CODE}>, status string, activity array<struct<detail:struct<code:{CODE},status:string,location:{REF}>>>, period {PERIOD}, subject {REF}",
    "Patient": f"id string, name array<struct<use:string,given:array<string>,family:string>>, birthDate string, gender string, address array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>, "
    f"telecom array<struct<system:string,value:string>>, extension array<struct<url:string,extension:array<struct<url:string,valueString:string>>>>, maritalStatus {CODE}, communication array<struct<language:{CODE}>>",
    "DiagnosticReport": f"id string, presentedForm array<struct<data:string>>, code {CODE}, effectiveDateTime string, issued string, subject {REF}",
    "Claim": f"id string, patient {REF}, billablePeriod {PERIOD}, created string, status string, type {CODE}, total {MONEY}, facility {REF}, provider {REF}, insurance array<struct<coverage:{REF}>>, "
    f"diagnosis array<struct<diagnosisReference:{REF}>>, item array<struct<productOrService:{CODE},encounter:array<{REF}>>>",
    "ExplanationOfBenefit": f"id string, patient {REF}, billablePeriod {PERIOD}, created string, status string, outcome string, type {CODE}, total array<struct<amount:{MONEY}>>, facility {REF}, provider {REF}, insurer {REF}, claim {REF}, "
    f"insurance array<struct<coverage:{REF}>>, item array<struct<category:{CODE},servicedPeriod:{PERIOD},locationCodeableConcept:{CODE},net:{MONEY},adjudication:array<struct<category:{CODE},amount:{MONEY}>>>>",
}


# ---- scan ----
def find_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, file, bytes) of the JSON files that lie directly in the folders; the contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folders)
    return found.select("path", F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"))


def parse(files: DataFrame) -> DataFrame:
    """(file, resource_type, resource, fhir_id, ingestion_metadata) of the JSON texts ``value``; what isn't JSON has a null type."""
    head = files.withColumn("h", F.from_json("value", "resourceType string, entry array<struct<resource:string>>"))
    is_bundle = F.col("h.resourceType") == "Bundle"
    inside = F.transform(F.coalesce(F.col("h.entry"), F.array().cast("array<struct<resource:string>>")), lambda e: e["resource"])
    one = head.select("file", F.explode_outer(F.when(is_bundle, inside).otherwise(F.array("value"))).alias("resource"))
    kind = F.nullif(F.get_json_object("resource", "$.resourceType"), F.lit(""))
    return one.where("resource IS NOT NULL").select(
        "file", kind.alias("resource_type"), "resource", F.get_json_object("resource", "$.id").alias("fhir_id"),
        F.struct(F.current_timestamp().alias("ingested_at"), F.lit(VERSION).alias("ingestion_version")).alias("ingestion_metadata"),
    )


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The resources of all JSON files below the paths."""
    return parse(spark.read.text(paths, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value"))


def ingest(resources: DataFrame, path: str) -> DataFrame:
    """Write the resources once, a folder per type, and read them back: a transform then reads its own type alone."""
    resources.write.mode("overwrite").partitionBy("resource_type").parquet(path)
    schema = "file string, resource string, fhir_id string, ingestion_metadata struct<ingested_at:timestamp,ingestion_version:string>, resource_type string"
    return resources.sparkSession.read.schema(schema).parquet(path)


def failed_files(resources: DataFrame) -> DataFrame:
    """Files of which nothing could be read."""
    return resources.groupBy("file").agg(F.count("resource_type").alias("n")).where("n = 0").select("file")


def route(resources: DataFrame, resource_type: str) -> DataFrame:
    """The rows of one type, parsed by its schema; a resource without id keeps a hash of its text as key."""
    rows = resources.where(F.col("resource_type") == resource_type)
    return rows.select(F.coalesce("fhir_id", F.sha2("resource", 256)).alias("row_key"), F.from_json("resource", SCHEMAS[resource_type]).alias("r")).select("row_key", "r.*")


def by_raw_table(resources: DataFrame) -> DataFrame:
    """(raw_table, count): where each resource goes; types without a table are counted under null."""
    pairs = F.create_map(*(F.lit(x) for pair in RAW_NAMES.items() for x in pair))
    return resources.groupBy(F.element_at(pairs, F.coalesce("resource_type", F.lit(""))).alias("raw_table")).agg(F.count("*").alias("count"))


def final_name(raw: str) -> str:
    return FINAL_NAMES.get(raw, raw)


def ingestion_name(final: str) -> str:
    """The raw table behind a clean one."""
    return next((raw for raw, name in FINAL_NAMES.items() if name == final), final)


def ingest_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("resource_type").agg(F.count("*").alias("count"))


# ---- transforms ----
def _first_code(c: str) -> Column:
    return S.first_of(F.col(c)["coding"])["code"]


def _subject(c: str = "subject") -> Column:
    return S.reference_id(F.col(f"{c}.reference"))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _done(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns, F.col("id").alias("source_fhir_id"), F.lit(VERSION).alias("transformation_version"))


def _named(df: DataFrame, name: Column) -> DataFrame:
    """Rows with a name that means something."""
    return df.withColumn("_name", name).where((F.col("_name") != "") & S.medically_relevant(F.col("_name")))


def allergies(df: DataFrame) -> DataFrame:
    return _done(
        _named(df, S.coding_text(F.col("code"))), F.col("_name").alias("allergy_name"), S.label("allergy_category", S.first_of(F.col("category"))).alias("category"),
        F.when(F.col("criticality").isNull(), "low").otherwise(S.label("criticality", F.col("criticality"))).alias("severity"),
        S.label("allergy_status", _first_code("clinicalStatus")).alias("status"), F.coalesce("recordedDate", F.lit("")).alias("recorded_date"), _subject("patient").alias("patient_id"),
    )


def conditions(df: DataFrame) -> DataFrame:
    onset = F.coalesce("onsetDateTime", F.lit(""))
    return _done(
        _named(df, S.coding_text(F.col("code"))), F.col("_name").alias("condition_name"), S.label("condition_status", _first_code("clinicalStatus")).alias("status"), onset.alias("onset_date"),
        F.coalesce(_or_null(F.col("recordedDate")), onset).alias("recorded_date"), F.coalesce(_or_null(_first_code("verificationStatus")), F.lit("confirmed")).alias("verification_status"), _subject().alias("patient_id"),
    )


def _tested(df: DataFrame) -> Column:
    return F.coalesce(_or_null(F.col("effectiveDateTime")), _or_null(F.col("issued")), F.lit(""))


def observations(df: DataFrame) -> DataFrame:
    value = S.to_number(_or_null(F.col("valueQuantity.value")))
    return _done(
        _named(df, S.coding_text(F.col("code"))).where(value.isNotNull()), F.col("_name").alias("test_name"), value.alias("value"), F.col("valueQuantity.unit").alias("unit"),
        F.coalesce(_or_null(F.col("status")), F.lit("final")).alias("status"), _tested(df).alias("test_date"), _subject().alias("patient_id"), S.observation_type(F.col("_name")).alias("observation_type"),
    )


def medications(df: DataFrame) -> DataFrame:
    name = F.coalesce(_or_null(S.coding_text(F.col("medicationCodeableConcept"))), S.display_text(F.col("medicationReference")))
    return _done(
        _named(df, name), F.col("_name").alias("medication_name"), S.label("medication_status", F.col("status")).alias("status"), F.coalesce("authoredOn", F.lit("")).alias("prescribed_date"),
        _or_null(S.display_text(F.col("requester"))).alias("prescriber"), _subject().alias("patient_id"),
    )


def immunizations(df: DataFrame) -> DataFrame:
    return _done(
        _named(df, S.coding_text(F.col("vaccineCode"))), F.col("_name").alias("vaccine_name"), F.coalesce("occurrenceDateTime", F.lit("")).alias("administration_date"),
        _or_null(S.display_text(F.col("location"))).alias("location"), F.coalesce(_or_null(F.col("status")), F.lit("completed")).alias("status"), _subject("patient").alias("patient_id"),
    )


def procedures(df: DataFrame) -> DataFrame:
    return _done(
        _named(df, S.coding_text(F.col("code"))), F.col("_name").alias("procedure_name"), F.coalesce(_or_null(F.col("status")), F.lit("completed")).alias("status"),
        F.coalesce(_or_null(F.col("performedPeriod.start")), _or_null(F.col("performedDateTime")), F.lit("")).alias("performed_date"), _or_null(F.col("performedPeriod.end")).alias("end_date"),
        _or_null(S.display_text(F.col("location"))).alias("location"), _subject().alias("patient_id"),
    )


def encounters(df: DataFrame) -> DataFrame:
    return _done(
        df, S.label("encounter_class", F.col("class.code")).alias("encounter_type"), _or_null(S.coding_text(S.first_of(F.col("type")))).alias("visit_reason"),
        F.coalesce("period.start", F.lit("")).alias("start_date"), _or_null(F.col("period.end")).alias("end_date"), _or_null(S.display_text(S.first_of(F.col("location"))["location"])).alias("location"),
        _or_null(S.display_text(S.first_of(F.col("participant"))["individual"])).alias("provider"), F.coalesce(_or_null(F.col("status")), F.lit("finished")).alias("status"), _subject().alias("patient_id"),
    )


def care_plans(df: DataFrame) -> DataFrame:
    names = F.transform("category", lambda c: S.coding_text(c))
    name = S.first_where(names, lambda n: S.medically_relevant(n) & (F.length(n) > 10))
    activities = S.map_or_null(
        F.col("activity"),
        lambda a: S.medically_relevant(S.coding_text(a["detail"]["code"])),
        lambda a: F.struct(
            S.coding_text(a["detail"]["code"]).alias("activity_name"), F.coalesce(_or_null(a["detail"]["status"]), F.lit("in-progress")).alias("status"), _or_null(S.display_text(a["detail"]["location"])).alias("location")
        ),
    )
    kept = df.withColumn("_name", name).withColumn("_activities", activities).where("_name IS NOT NULL AND _activities IS NOT NULL")
    return _done(
        kept, F.col("_name").alias("plan_name"), S.label("care_plan_status", F.col("status")).alias("status"), F.col("_activities").alias("activities"), F.coalesce("period.start", F.lit("")).alias("start_date"),
        _or_null(F.col("period.end")).alias("end_date"), _subject().alias("patient_id"),
    )


def _extension(url: str) -> Column:
    """The text of the last extension whose url holds a word."""
    found = F.filter("extension", lambda e: e["url"].contains(url))
    texts = F.transform(found, lambda e: S.first_where(e["extension"], lambda x: x["url"] == "text")["valueString"])
    return F.try_element_at(F.filter(texts, lambda x: x.isNotNull()), F.lit(-1))


def patients(df: DataFrame) -> DataFrame:
    name = S.first_where(F.col("name"), lambda n: F.coalesce(n["use"], F.lit("official")) == "official")
    kept = df.withColumn("_n", name).where((F.coalesce(S.first_of(F.col("_n.given")), F.lit("")) != "") & (F.coalesce("_n.family", F.lit("")) != ""))
    place = S.first_of(F.col("address"))
    address = F.when(
        place.isNotNull(),
        F.struct(
            F.nullif(F.array_join(place["line"], ", "), F.lit("")).alias("street"), place["city"].alias("city"), place["state"].alias("state"), place["postalCode"].alias("postal_code"),
            F.coalesce(place["country"], F.lit("US")).alias("country"),
        ),
    )
    return _done(
        kept, F.col("id").alias("patient_id"), S.first_of(F.col("_n.given")).alias("first_name"), F.col("_n.family").alias("last_name"), F.col("birthDate").alias("birth_date"), S.label("gender", F.col("gender")).alias("gender"),
        address.alias("address"), S.first_where(F.col("telecom"), lambda t: t["system"] == "phone")["value"].alias("phone"), _extension("us-core-race").alias("race"), _extension("us-core-ethnicity").alias("ethnicity"),
        F.coalesce(_or_null(S.coding_text(S.first_of(F.col("communication"))["language"])), F.lit("English")).alias("language"), _or_null(S.coding_text(F.col("maritalStatus"))).alias("marital_status"),
    )


def diagnostic_reports(df: DataFrame) -> DataFrame:
    texts = F.transform("presentedForm", lambda p: S.clean_text(S.decode_base64(p["data"])))
    kept = df.withColumn("_text", S.first_where(texts, lambda x: x != "")).where(F.length("_text") >= 20)
    return _done(
        kept, F.coalesce(_or_null(S.coding_text(F.col("code"))), F.lit("Clinical Report")).alias("report_type"), F.col("_text").alias("clinical_summary"), _tested(df).alias("report_date"), _subject().alias("patient_id")
    )


def _billed(df: DataFrame) -> list[Column]:
    return [
        _subject("patient").alias("patient_id"), _or_null(S.display_text(F.col("patient"))).alias("patient_display_name"), F.col("billablePeriod.start").alias("billable_period_start"),
        F.col("billablePeriod.end").alias("billable_period_end"), F.col("created").alias("created_date"), F.col("status"), _or_null(S.coding_text(F.col("type"))).alias("type"),
        _or_null(S.display_text(F.col("facility"))).alias("facility_display"), _or_null(S.display_text(F.col("provider"))).alias("provider_display"),
        _or_null(S.display_text(S.first_of(F.col("insurance"))["coverage"])).alias("insurance_display"),
    ]


def _with_patient(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(_subject("patient"), F.lit("")) != "")


def claims(df: DataFrame) -> DataFrame:
    items = S.map_or_null(
        F.col("item"),
        lambda i: S.medically_relevant(S.coding_text(i["productOrService"])),
        lambda i: F.struct(
            _or_null(S.coding_text(i["productOrService"])).alias("product_or_service_display"), i["productOrService"]["text"].alias("product_or_service_text"),
            S.reference_id(S.first_of(i["encounter"])["reference"]).alias("encounter_reference"),
        ),
    )
    diagnoses = S.map_or_null(
        F.col("diagnosis"), lambda d: F.coalesce(S.reference_id(d["diagnosisReference"]["reference"]), F.lit("")) != "", lambda d: S.reference_id(d["diagnosisReference"]["reference"])
    )
    return _done(
        _with_patient(df), *_billed(df), S.to_number(F.col("total.value")).alias("total_value"), F.coalesce("total.currency", F.lit("USD")).alias("total_currency"), diagnoses.alias("diagnosis_references"), items.alias("items")
    )


def explanations(df: DataFrame) -> DataFrame:
    amount = S.first_of(F.col("total"))["amount"]

    def item(i: Column) -> Column:
        adjudications = S.map_or_null(
            i["adjudication"],
            lambda a: (S.coding_text(a["category"]) != "") & S.to_number(a["amount"]["value"]).isNotNull(),
            lambda a: F.struct(
                S.coding_text(a["category"]).alias("category_display"), S.to_number(a["amount"]["value"]).alias("amount_value"), F.coalesce(a["amount"]["currency"], F.lit("USD")).alias("amount_currency")
            ),
        )
        return F.struct(
            _or_null(S.coding_text(i["category"])).alias("category_display"), i["servicedPeriod"]["start"].alias("serviced_period_start"), i["servicedPeriod"]["end"].alias("serviced_period_end"),
            _or_null(S.coding_text(i["locationCodeableConcept"])).alias("location_display"), S.to_number(i["net"]["value"]).alias("net_value"), F.coalesce(i["net"]["currency"], F.lit("USD")).alias("net_currency"),
            adjudications.alias("adjudications"),
        )

    return _done(
        _with_patient(df), *_billed(df), F.col("outcome"), S.to_number(amount["value"]).alias("total_submitted_value"), F.coalesce(amount["currency"], F.lit("USD")).alias("total_submitted_currency"),
        S.reference_id(F.col("provider.reference")).alias("provider_reference"), _or_null(S.display_text(F.col("insurer"))).alias("insurer_display"), S.reference_id(F.col("claim.reference")).alias("claim_reference"),
        S.map_or_null(F.col("item"), lambda i: i.isNotNull(), item).alias("items"),
    )


#: Resource type -> transform.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "AllergyIntolerance": allergies, "Condition": conditions, "Observation": observations, "MedicationRequest": medications, "Immunization": immunizations, "Procedure": procedures,
    "Encounter": encounters, "CarePlan": care_plans, "Patient": patients, "DiagnosticReport": diagnostic_reports, "Claim": claims, "ExplanationOfBenefit": explanations,
}


def transform(resources: DataFrame) -> dict[str, DataFrame]:
    """Clean table -> its rows. Over what ``ingest`` gave, each table reads the folder of its type alone."""
    return {final_name(RAW_NAMES[kind]): f(route(resources, kind)) for kind, f in TRANSFORMS.items()}


def transform_stats(resources: DataFrame, kind: str) -> DataFrame:
    """Rows read, kept and skipped of one type."""
    read = route(resources, kind).select(F.lit(1).alias("r"), F.lit(0).alias("k"))
    kept = TRANSFORMS[kind](route(resources, kind)).select(F.lit(0).alias("r"), F.lit(1).alias("k"))
    both = read.unionAll(kept).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("processed"), F.coalesce(F.sum("k"), F.lit(0)).alias("transformed"))
    return both.select(F.lit(kind).alias("resource_type"), "processed", "transformed", (F.col("processed") - F.col("transformed")).alias("skipped"))


def enrichment_stats(df: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """How many rows carry each enrichment field, with the least value as a sample."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(F.explode(pairs).alias("p")).where("trim(p.value) <> ''").groupBy("p.field").agg(F.count("*").alias("count"), F.min("p.value").alias("sample")).select(F.lit(table).alias("collection"), "*")


def clinical_summary(text: Column, model: Callable[[Column], Column] | None = None) -> Column:
    """Null under 20 characters, the clean text under 500; longer texts are the model's, or stay whole without one."""
    clean = S.clean_text(text)
    return F.when(F.length(clean) < 20, F.lit(None)).when(F.length(clean) < 500, clean).otherwise(model(clean) if model else clean)
