"""Deterministic health-record bundles for tests and the benchmark: one file per patient."""

from __future__ import annotations

import base64
import json
import os
import random

#: Resources per hundred patients.
VOLUME = {
    "Encounter": 800, "Condition": 500, "Observation": 5000, "MedicationRequest": 1000, "AllergyIntolerance": 200, "Procedure": 400,
    "Immunization": 800, "CarePlan": 300, "DiagnosticReport": 600, "Claim": 400, "ExplanationOfBenefit": 400,
}
NAMES = {
    "Condition": ["Asthma", "Hypertension", "Diabetes", "Migraine"], "Observation": ["Body Weight", "Heart Rate", "Glucose", "Hemoglobin"], "MedicationRequest": ["Aspirin 81 MG", "Metformin 500 MG", "Lisinopril 10 MG"],
    "AllergyIntolerance": ["Peanut", "Dust mite", "Penicillin"], "Procedure": ["Appendectomy", "Colonoscopy"], "Immunization": ["Influenza", "Tetanus booster"], "Encounter": ["Emergency visit", "General examination"],
}


def _code(text: str) -> dict:
    return {"coding": [{"system": "http://example.org/codes", "code": str(len(text)), "display": text}], "text": text}


def resource(kind: str, number: int, patient: str, rng: random.Random) -> dict:
    """One resource with the fields that its transform reads."""
    name, day = rng.choice(NAMES.get(kind, ["General"])), f"20{rng.randrange(10, 24)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}"
    out = {"resourceType": kind, "id": f"{patient}-{kind}-{number}", "subject": {"reference": f"urn:uuid:{patient}"}, "patient": {"reference": f"urn:uuid:{patient}"}, "status": "final"}
    money = {"value": round(rng.random() * 1000, 2), "currency": "USD"}
    return out | {
        "Condition": {"code": _code(name), "clinicalStatus": _code("active"), "onsetDateTime": day},
        "Observation": {"code": _code(name), "valueQuantity": {"value": round(rng.random() * 100, 1), "unit": "kg"}, "effectiveDateTime": day},
        "MedicationRequest": {"medicationCodeableConcept": _code(name), "authoredOn": day, "requester": {"display": "Dr. A"}},
        "AllergyIntolerance": {"code": _code(name), "category": ["food"], "criticality": "low", "recordedDate": day},
        "Procedure": {"code": _code(name), "performedPeriod": {"start": day, "end": day}},
        "Immunization": {"vaccineCode": _code(name), "occurrenceDateTime": day},
        "Encounter": {"class": {"code": "AMB"}, "type": [_code(name)], "period": {"start": day, "end": day}},
        "CarePlan": {"category": [_code("Diabetes self management plan")], "activity": [{"detail": {"code": _code("Exercise")}}], "period": {"start": day}},
        "DiagnosticReport": {"code": _code("Summary"), "effectiveDateTime": day, "presentedForm": [{"data": base64.b64encode(f"Seen on {day} for {name}, no findings of note.".encode()).decode()}]},
        "Claim": {"total": money, "billablePeriod": {"start": day}, "item": [{"productOrService": _code("Office visit")}], "insurance": [{"coverage": {"display": "Plan A"}}]},
        "ExplanationOfBenefit": {"total": [{"amount": money}], "billablePeriod": {"start": day}, "item": [{"category": _code("Lab work"), "net": money, "adjudication": [{"category": _code("Paid"), "amount": money}]}]},
    }[kind]


def write_bundles(folder: str, patients: int = 100, seed: int = 1) -> int:
    """Write one bundle per patient; the number of resources."""
    os.makedirs(folder, exist_ok=True)
    total = 0
    for p in range(patients):
        rng, patient = random.Random(seed * 1_000_003 + p), f"p{p}"
        entry = [{"resourceType": "Patient", "id": patient, "name": [{"use": "official", "given": ["Ann"], "family": f"Name{p}"}], "birthDate": "1970-01-01", "gender": rng.choice(["male", "female"]), "address": [{"city": "Ames", "state": "IA"}]}]
        for kind, n in VOLUME.items():
            entry += [resource(kind, i, patient, rng) for i in range(n // 100)]
        total += len(entry)
        with open(f"{folder}/{patient}.json", "w") as f:
            json.dump({"resourceType": "Bundle", "type": "collection", "entry": [{"resource": r} for r in entry]}, f)
    return total
