"""Joins of the document model: nests, enrichment, existence checks and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Left outer nest: the matching rows of ``other`` as an array of structs, empty without a match."""
    nested = other.groupBy(F.col(foreign).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*sorted(other.columns)))).alias(name))
    joined = df.join(nested, F.col(local) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def unwind(df: DataFrame, field: str) -> DataFrame:
    """One row per element; rows of empty or missing arrays go."""
    return df.withColumn(field, F.explode(field))


def enrich_medications(medications: DataFrame, drugs: DataFrame) -> DataFrame:
    """Left outer join by lower-cased name; of several drugs of one name the smallest id counts.

    A file of drugs says little about their size in memory, so they are never sent whole to a task: both sides are dealt by name,
    and only a task's share of the drugs is held. The names' lengths are a second key, for which the drugs are dealt anew after their
    grouping; so a frequent name can be split.
    """
    info = F.struct(*(F.col(c) for c in ("ingredient_rxcui", "primary_drug_name", "therapeutic_class_l2", "drug_class_l3", "drug_subclass_l4")))
    by_name = drugs.groupBy(F.lower("primary_drug_name").alias("_name")).agg(F.min_by(info, "ingredient_rxcui").alias("drug"))
    name = F.lower("medication_name")
    return medications.join(by_name.hint("shuffle_hash"), (name == F.col("_name")) & (F.length(name) == F.length("_name")), "left").drop("_name")


def orphans(df: DataFrame, reference: DataFrame, field: str, key: str) -> DataFrame:
    """Rows whose reference is there but leads nowhere."""
    return df.where(F.col(field).isNotNull()).join(reference.select(F.col(key).alias(field)).distinct(), field, "left_anti")


def having_twins(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that share all the fields, none of them null, with another row."""
    known = df.dropna(subset=fields)
    return known.join(known.groupBy(*fields).count().where("count > 1").drop("count"), fields, "left_semi")


def patient_summary(patients: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """Counts per patient, zero included; each side is summed up before it is joined."""
    out = patients.select("patient_id", "last_name")
    for name, df in (("condition_count", conditions), ("medication_count", medications)):
        out = out.join(df.groupBy("patient_id").agg(F.count("*").alias(name)), "patient_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def nested_record(patients: DataFrame, **parts: DataFrame) -> DataFrame:
    """A patient with one array per part."""
    for name, df in parts.items():
        patients = lookup(patients, df, "patient_id", "patient_id", name).withColumn(name, F.transform(name, lambda x: x.dropFields("patient_id")))
    return patients


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fields of ``new`` that aren't null go over those of ``old``; rows without a counterpart stay.

    Of several new rows of one key the last by all columns counts. Rows of a null key never meet.
    """
    by = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in new.columns if c != key))
    latest = new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").unionByName(new.where(F.col(key).isNull()))
    a, b = old.alias("a"), latest.alias("b")
    columns = list(dict.fromkeys(old.columns + new.columns))
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, d in (("b", new), ("a", old)) if c in d.columns)).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*map(pick, columns))


def upsert_by_first_key(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_fhir_id", "patient_id", "_id")) -> DataFrame:
    """``upsert`` by the first of the keys that a row has."""
    own = lambda df: df.withColumn("_key", F.coalesce(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys if k in df.columns)))
    return upsert(own(old), own(new), "_key").drop("_key")


def latest_per_key(log: DataFrame, key: str, at: str) -> DataFrame:
    """The state of each key from an append-only log; ties go to the larger row."""
    rest = [c for c in log.columns if c not in (key, at)]
    state = F.max(F.struct(F.col(at), *(F.col(c) for c in rest))).alias("s")
    return log.groupBy(key).agg(state).select(key, *(F.col(f"s.{c}").alias(c) for c in (at, *rest)))
