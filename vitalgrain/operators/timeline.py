"""Unified patient timelines: a union of normalised sources, each pruned by its literal event type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import filters as L

#: Source -> (time column, name column, detail columns).
SOURCES = {
    "encounters": ("start_ts", "visit_reason", ["location", "provider", "encounter_type", "status"]),
    "conditions": ("onset_ts", "condition_name", ["status", "verification_status"]),
    "medications": ("prescribed_ts", "medication_name", ["prescriber", "status"]),
    "procedures": ("performed_ts", "procedure_name", ["location", "status", "outcome"]),
    "immunizations": ("administration_ts", "vaccine_name", ["location", "status"]),
    "observations": ("test_ts", "test_name", ["value", "unit", "observation_type", "status"]),
}


def events(source: str, df: DataFrame) -> DataFrame:
    at, name, details = SOURCES[source]
    sparse = F.map_filter(F.create_map(*(x for c in details for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    return df.select("patient_id", F.lit(source).alias("event_type"), F.col(at).alias("event_ts"), F.col(name).alias("event_name"), F.col("source_fhir_id").alias("source_id"), sparse.alias("details"))


def timeline(sources: dict[str, DataFrame], patient_id: str | None = None, start: str | None = None, end: str | None = None, event_types: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Newest first, missing times last; the limit holds over all sources together."""
    chosen = [s for s in SOURCES if s in sources and (not event_types or s in event_types)]
    if not chosen:
        raise ValueError("no such event types")
    parts = (events(s, L.apply(sources[s], L.equals("patient_id", patient_id), L.date_range(SOURCES[s][0], start, end))) for s in chosen)
    both = reduce(DataFrame.unionByName, parts)
    ordered = both.orderBy(F.desc_nulls_last("event_ts"), "event_type", "source_id")
    return ordered if limit is None else ordered.limit(limit)
