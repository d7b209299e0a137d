"""Checks of requests as columns over a log of them: parameters, query texts, permissions, errors, names and retries.

The same rules as the functions that a single call goes through; query texts are looked at once per different text of a batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalgrain.functions import errors
from vitalgrain.functions import filters as L
from vitalgrain.functions import scalars as S
from vitalgrain.operators import governance, runtime

MOST_LIMIT = 500


def problems(patient_id: str, name: str, limit: str, start: str, end: str) -> Column:
    """What is wrong with a request's parameters, as the names of the checks that refuse it; null parameters aren't given."""
    given = lambda c, fine: F.col(c).isNotNull() & ~F.coalesce(fine, F.lit(False))
    day = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull()
    checks = {
        "patient_id": given(patient_id, S.is_id(F.col(patient_id)) & (F.length(patient_id) <= 100)),
        "name": given(name, F.col(name).rlike(r"^[a-zA-Z0-9\s\-']{1,100}$")),
        "limit": given(limit, F.col(limit) >= 1),
        "start": given(start, day(start)),
        "end": given(end, day(end)),
        "range": F.coalesce(day(start) & day(end) & (F.col(start) > F.col(end)), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in checks.items())))


def capped(limit: str, most: int = MOST_LIMIT) -> Column:
    return F.least(F.col(limit), F.lit(most))


def query_checks(df: DataFrame, query: str) -> DataFrame:
    """Adds what a pipeline's text comes to: depth, stages, problems, weight and name of the estimate; a text that is no JSON has one problem."""
    from vitalgrain.plans import pipeline

    kind = "depth int, stages int, problems array<string>, weight int, complexity string"

    def one(text: str | None) -> dict:
        try:
            parsed = json.loads(text or "")
        except ValueError:
            return {"depth": 0, "stages": 0, "problems": ["no JSON"], "weight": 0, "complexity": None}
        found = pipeline.problems_of(parsed)
        weight, name = (0, None) if found else pipeline.estimate(parsed)
        return {"depth": L.query_depth(parsed), "stages": len(parsed) if isinstance(parsed, list) else 0, "problems": found, "weight": weight, "complexity": name}

    return df.withColumns(_per_text(query, one, kind))


def _per_text(column: str, one: Callable[[str | None], dict], kind: str) -> dict[str, Column]:
    names = StructType.fromDDL(kind).names

    @F.pandas_udf(kind)
    def checked(texts: pd.Series) -> pd.DataFrame:
        known = {t: one(t) for t in texts.drop_duplicates()}
        return pd.DataFrame([known[t] for t in texts], columns=names)

    whole = checked(F.col(column))
    return {n: whole[n] for n in names}


def cache_key(operation: str, params: str, role: str) -> Column:
    """The key of a request's result; ``params`` holds JSON text, whose fields may stand in any order."""
    @F.pandas_udf("string")
    def made(o: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([runtime.cache_key(a, json.loads(b), c) for a, b, c in zip(o, p, r, strict=True)])

    return made(F.col(operation), F.col(params), F.col(role))


def permitted(role: str, permission: str) -> Column:
    """Whether a role has a permission."""
    known = F.create_map(*(x for r, some in governance.PERMISSIONS.items() for x in (F.lit(r), F.array(*map(F.lit, sorted(some))))))
    return (F.col(role) == "admin") | F.coalesce(F.array_contains(F.element_at(known, F.col(role)), F.col(permission)), F.lit(False))


#: Kinds of errors as they are written in a log, and an error of each.
KINDS = {"timeout": TimeoutError("x"), "connection": ConnectionError("x"), "validation": errors.ValidationError("x"), "not_found": errors.NotFoundError("x"), "rate": errors.RateLimitError("x"), "access": errors.AccessError("x"), "other": RuntimeError("x")}


def envelope(kind: str, message: str, operation: str) -> Column:
    """What a caller gets: success, error (the code of the kind), message, operation; no kind is a success."""
    codes = F.create_map(*(F.lit(x) for k, e in KINDS.items() for x in (k, errors.convert(e).code)))
    failed = F.col(kind).isNotNull()
    code = F.coalesce(F.element_at(codes, F.col(kind)), F.lit(errors.EngineError.code))
    return F.struct((~failed).alias("success"), F.when(failed, code).alias("error"), F.when(failed, F.col(message)).alias("message"), F.col(operation).alias("operation"))


def renamed(column: str, names: dict[str, str]) -> Column:
    """A name by a table of names, itself where it has no other."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col(column)), F.col(column))


def tried(df: DataFrame, f: Callable[[dict, int], object], out: str, attempts: int = 3, base: float = 0.0, on: tuple = (ConnectionError, TimeoutError)) -> DataFrame:
    """Adds ``out`` (string), tries and error: ``f(row, attempt)`` until it succeeds. Errors of other kinds aren't tried again; a row that
    fails stays, with the error's code, so one bad row fails no task."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, StringType, StructField

    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField("tries", IntegerType()), StructField("error", StringType())])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                for n in range(1, attempts + 1):
                    try:
                        made.append((str(f(row, n)), n, None))
                        break
                    except on as e:
                        if n == attempts:
                            made.append((None, n, errors.convert(e).code))
                        else:
                            time.sleep(base * 2 ** (n - 1))
                    except Exception as e:  # noqa: BLE001
                        made.append((None, n, errors.convert(e).code))
                        break
            values, tries, codes = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string()), pa.array(tries, pa.int32()), pa.array(codes, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def transformed(df: DataFrame, f: Callable, schema: str, size: int = 1000) -> DataFrame:
    """A stream transformer over all rows: ``f`` gets pandas frames of at most ``size`` rows, wherever they lie, and gives frames of ``schema``."""

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), size):
                yield f(frame.iloc[a : a + size])

    return df.mapInPandas(run, schema)
