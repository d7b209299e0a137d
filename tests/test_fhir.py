"""Bundles with the edge rows that the transforms have rules for."""

import base64
import json

import pytest

from vitalgrain.sources import drug_classes, fhir


def coded(text, code="c"):
    return {"coding": [{"code": code, "display": text}], "text": "fallback text"}


REPORT = "Patient seen for a <b>routine</b>  check, see https://x.y/z now."
BUNDLE = [
    {"resourceType": "Patient", "id": "p1", "name": [{"use": "usual", "given": ["Nick"], "family": "Name"}, {"given": ["María"], "family": "García"}], "birthDate": "1980-01-02", "gender": "female", "address": [{"line": ["1 Main", "Apt 2"], "city": "Ames"}], "telecom": [{"system": "email", "value": "e"}, {"system": "phone", "value": "555"}], "extension": [{"url": "http://x/us-core-race", "extension": [{"url": "text", "valueString": "White"}]}]},
    {"resourceType": "Patient", "id": "p2", "name": [{"use": "usual", "given": ["Only"], "family": "Usual"}]},
    {"resourceType": "Condition", "id": "c1", "code": coded("Asthma"), "clinicalStatus": {"coding": [{"code": "relapse"}]}, "onsetDateTime": "2020-01-01", "subject": {"reference": "urn:uuid:p1"}},
    {"resourceType": "Condition", "id": "c2", "code": coded("ABC-12")},
    {"resourceType": "Condition", "id": "c3"},
    {"resourceType": "Observation", "id": "o1", "code": coded("Body Weight"), "valueQuantity": {"value": 0, "unit": "kg"}, "issued": "2020-02-02", "subject": {"reference": "Patient/p1"}},
    {"resourceType": "Observation", "id": "o2", "code": coded("Glucose"), "valueString": "x"},
    {"resourceType": "MedicationRequest", "id": "m1", "medicationReference": {"display": " Aspirin "}, "status": "on-hold", "subject": {"reference": "p1"}},
    {"resourceType": "Immunization", "id": "i1", "vaccineCode": coded("Influenza"), "patient": {"reference": "urn:uuid:p1"}},
    {"resourceType": "Procedure", "id": "r1", "code": coded("Appendectomy"), "performedPeriod": {"start": "2020-03-03", "end": "2020-03-04"}, "subject": {"reference": "p1"}},
    {"resourceType": "Encounter", "id": "e1", "class": {"code": "EMER"}, "type": [coded("Emergency visit")], "participant": [{"individual": {"display": "Dr. A"}}]},
    {"resourceType": "CarePlan", "id": "k1", "category": [coded("ABC-1"), coded("Diabetes management")], "status": "revoked", "activity": [{"detail": {"code": coded("Exercise")}}, {"detail": {"code": coded("X-1")}}]},
    {"resourceType": "CarePlan", "id": "k2", "category": [coded("Diabetes management")], "activity": [{"detail": {"code": coded("X-1")}}]},
    {"resourceType": "DiagnosticReport", "id": "d1", "presentedForm": [{"data": base64.b64encode(b"\xff\xfe").decode()}, {"data": base64.b64encode(REPORT.encode() + b"\xff").decode()}]},
    {"resourceType": "DiagnosticReport", "id": "d2", "presentedForm": [{"data": base64.b64encode(b"short").decode()}]},
    {"resourceType": "Claim", "id": "x1", "patient": {"reference": "urn:uuid:p1"}, "total": {"value": 12.5}, "item": [{"productOrService": coded("ABC-9")}, {"productOrService": coded("Office visit"), "encounter": [{"reference": "urn:uuid:e1"}]}], "diagnosis": [{"diagnosisReference": {"reference": "urn:uuid:c1"}}]},
    {"resourceType": "Claim", "id": "x2"},
    {"resourceType": "ExplanationOfBenefit", "id": "b1", "patient": {"reference": "p1"}, "total": [{"amount": {"value": 99, "currency": "EUR"}}], "item": [{"category": coded("Lab"), "net": {"value": 5}, "adjudication": [{"category": coded("Paid"), "amount": {"value": 3}}, {"category": coded("None")}]}]},
    {"resourceType": "AllergyIntolerance", "id": "a1", "code": coded("Peanut"), "category": ["food"], "criticality": "unable-to-assess", "patient": {"reference": "p1"}},
    {"resourceType": "Mystery", "id": "z"},
]


@pytest.fixture(scope="module")
def resources(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bundles")
    (at / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in BUNDLE]}))
    (at / "bare.json").write_text(json.dumps({"resourceType": "AllergyIntolerance", "code": coded("Dust mite"), "patient": {"reference": "p9"}}))
    (at / "none.json").write_text(json.dumps({"resourceType": "Bundle"}))
    (at / "broken.json").write_text("{no json")
    return fhir.scan(spark, [str(at)])


def one(resources, table, key):
    rows = {r.source_fhir_id: r for r in fhir.transform(resources)[table].collect()}
    return rows[key], set(rows)


def test_scan(resources):
    assert {r.resource_type: r["count"] for r in fhir.ingest_counts(resources).collect()}["AllergyIntolerance"] == 2
    assert [r.file for r in fhir.failed_files(resources).collect()] == ["broken.json"]
    keys = [r.row_key for r in fhir.route(resources, "AllergyIntolerance").collect()]
    assert "a1" in keys and any(len(k) == 64 for k in keys)


def test_transforms(resources):
    p, ids = one(resources, "patients", "p1")
    assert ids == {"p1"} and (p.first_name, p.last_name, p.gender, p.phone, p.race, p.language) == ("María", "García", "female", "555", "White", "English")
    assert (p.address.street, p.address.country) == ("1 Main, Apt 2", "US")
    c, ids = one(resources, "conditions", "c1")
    assert ids == {"c1"} and (c.status, c.recorded_date, c.verification_status, c.patient_id) == ("active", "2020-01-01", "confirmed", "p1")
    o, ids = one(resources, "observations", "o1")
    assert ids == {"o1"} and (o.value, o.observation_type, o.test_date, o.patient_id) == (0.0, "vital_sign", "2020-02-02", "p1")
    m, _ = one(resources, "medications", "m1")
    assert (m.medication_name, m.status, m.prescriber) == ("Aspirin", "active", None)
    assert one(resources, "immunizations", "i1")[0].status == "completed"
    assert one(resources, "procedures", "r1")[0].end_date == "2020-03-04"
    e, _ = one(resources, "encounters", "e1")
    assert (e.encounter_type, e.provider, e.status) == ("emergency", "Dr. A", "finished")
    k, ids = one(resources, "care_plans", "k1")
    assert ids == {"k1"} and (k.plan_name, k.status, [a.activity_name for a in k.activities]) == ("Diabetes management", "inactive", ["Exercise"])
    d, ids = one(resources, "diagnosticreports", "d1")
    assert ids == {"d1"} and d.clinical_summary == "Patient seen for a routine check, see now." and d.report_type == "Clinical Report"
    x, ids = one(resources, "claims", "x1")
    assert ids == {"x1"} and (x.total_value, x.total_currency, x.diagnosis_references, [i.encounter_reference for i in x["items"]]) == (12.5, "USD", ["c1"], ["e1"])
    b, _ = one(resources, "explanationofbenefits", "b1")
    assert (b.total_submitted_value, b.total_submitted_currency, [a.amount_value for a in b["items"][0].adjudications]) == (99.0, "EUR", [3.0])
    a, _ = one(resources, "allergies", "a1")
    assert (a.category, a.severity) == ("food", "moderate")
    assert fhir.transform_stats(resources, "Condition").first().skipped == 2


def test_drug_classes(spark):
    tree = {"rxclassTree": [{"rxclassMinConceptItem": {"classId": "A", "className": "Alimentary"}, "rxclassTree": [{"rxclassMinConceptItem": {"classId": "A10", "className": "Diabetes drugs"}, "rxclassTree": [{"rxclassMinConceptItem": {"classId": "A10B"}, "rxclassTree": [{"rxclassMinConceptItem": {"classId": "A10BA", "className": "Biguanides"}}]}]}]}]}
    nodes = drug_classes.edges(spark.createDataFrame([(json.dumps(tree),)], "body string"))
    classes = drug_classes.level_4(nodes)
    assert tuple(classes.first()) == ("A10BA", "Diabetes drugs", "A10B", "Biguanides")
    assert {r.path for r in drug_classes.recursive_paths(spark, nodes).collect()} == {"A", "A/A10", "A/A10/A10B", "A/A10/A10B/A10BA"}
    layouts = [
        {"drugMemberGroup": {"drugMember": [{"minConcept": {"rxcui": "1", "name": "Metformin", "tty": "IN"}}, {"minConcept": {"rxcui": "2", "name": "Brand", "tty": "BN"}}]}},
        {"rxclassMinConceptList": {"rxclassMinConcept": [{"rxcui": "3", "name": " Other "}, {"rxcui": "", "name": "x"}]}},
    ]
    found = drug_classes.members(spark.createDataFrame([("A10BA", json.dumps(x)) for x in layouts], "atc_code string, body string"))
    assert {(r.rxcui, r.name) for r in found.collect()} == {("1", "Metformin"), ("3", "Other")}
    assert drug_classes.drugs(drug_classes.drug_rows(found, classes)).count() == 2


def test_member_layouts(spark):
    inner = {"rxcui": "7", "name": "Inner", "tty": "IN"}
    bodies = [
        {"rxclassDrugInfoList": {"rxclassDrugInfo": [{"minConceptItem": inner}, {"drugMember": {"rxcui": "8", "name": "Own", "tty": "IN"}}, {"rxclassMinConcept": {"rxcui": "9", "name": ""}}]}},
        {"drugMemberGroup": {"drugMember": [{"rxcui": "10", "name": "Direct"}]}}, {"drugMemberGroup": {"drugMember": []}, "rxclassMinConceptList": {"rxclassMinConcept": [inner]}}, {}, "no object",
    ]
    found = drug_classes.members(spark.createDataFrame([(f"A{i}", json.dumps(b)) for i, b in enumerate(bodies)] + [("none", None)], "atc_code string, body string"))
    assert {(r.atc_code, r.rxcui, r.name) for r in found.collect()} == {("A0", "7", "Inner"), ("A0", "8", "Own"), ("A1", "10", "Direct"), ("A2", "7", "Inner")}


def test_rest_source_and_extract(spark):
    """A local server that fails the first time it is asked for an address, and knows one class by ingredients and one only whole."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    node = lambda code, name, kids=(): {"rxclassMinConceptItem": {"classId": code, "className": name}, "rxclassTree": list(kids)}
    deep = node("A10BB", "Deep")
    for i in range(12):  # a tree of more levels than the classification has
        deep = node(f"x{i}", "filler", [deep])
    tree = {"rxclassTree": [node("A", "Alimentary", [node("A10", "Diabetes", [node("A10B", "Oral", [node("A10BA", "Biguanides")])]), deep])]}
    seen, asked = set(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            q = parse_qs(url.query)
            asked.append(self.path)
            if self.path not in seen:
                seen.add(self.path)
                return self.send_error(503)
            member = lambda i, t: {"minConcept": {"rxcui": i, "name": f"drug {i}", "tty": t}}
            body = tree if url.path.endswith("classTree.json") else {"A10BA": {"drugMemberGroup": {"drugMember": [member("1", "IN")]}}, "A10BB": {} if "ttys" in q else {"drugMemberGroup": {"drugMember": [member("2", "BN")]}}}[q["classId"][0]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        got = drug_classes.extract(spark, base, ("A",), delay=0.0)
        assert {(r.ingredient_rxcui, r.atc_code, r.therapeutic_class_l2, r.drug_class_l3) for r in got.collect()} == {("1", "A10BA", "Diabetes", "Oral"), ("2", "A10BB", "Diabetes", "Oral")}
        gone = drug_classes.rest(spark, ["http://127.0.0.1:9/none"], delay=0.0, retries=0).collect()
        assert [(r.url, r.body) for r in gone] == [("http://127.0.0.1:9/none", None)]
    finally:
        server.shutdown()
    assert any("ttys=IN" in a for a in asked) and any("classType=ATC1-4" in a for a in asked)


def test_ingested_types_are_read_alone(resources, tmp_path):
    """A transform over ingested resources scans the folder of its type only, and gives the same rows."""
    stored = fhir.ingest(resources, f"{tmp_path}/raw")
    plan = fhir.transform(stored)["conditions"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(resource_type" in plan and "resource_type#" in plan
    for table, rows in fhir.transform(stored).items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, fhir.transform(resources)[table].collect()))
    assert fhir.ingestion_name("allergies") == "allergyintolerances" and fhir.final_name("claims") == "claims"


def test_long_reports_stay_whole(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("short",), ("w" * 30,), ("long " * 400,)], "t string")
    got = [r.s for r in df.select(fhir.clinical_summary(F.col("t")).alias("s")).collect()]
    assert got == [None, "w" * 30, ("long " * 400).strip()]
    assert df.select(fhir.clinical_summary(F.col("t"), lambda c: F.upper(F.substring(c, 1, 4))).alias("s")).collect()[2].s == "LONG"


def test_synthetic_bundles(spark, tmp_path):
    from vitalgrain.sources import synthetic

    n = synthetic.write_bundles(str(tmp_path), patients=3)
    resources = fhir.scan(spark, [str(tmp_path)])
    assert resources.count() == n
    assert {t: df.count() for t, df in fhir.transform(resources).items()} == {
        "patients": 3, "encounters": 24, "conditions": 15, "observations": 150, "medications": 30, "allergies": 6, "procedures": 12,
        "immunizations": 24, "care_plans": 9, "diagnosticreports": 18, "claims": 12, "explanationofbenefits": 12,
    }
