"""Compiler from JSON aggregation pipelines to DataFrame plans.

Stages become DataFrame operations one by one, so Catalyst sees the whole query; nothing is executed
here. Filters on year and month become ranges in ``functions.filters``. A missing field is null.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import filters as L
from vitalgrain.functions.errors import ValidationError
from vitalgrain.operators.joins import lookup

#: Stages that are allowed, operations that aren't, limits, and weights of the estimate.
STAGES = ("$match", "$project", "$group", "$sort", "$limit", "$skip", "$count", "$lookup", "$unwind", "$facet", "$bucket", "$sample", "$addFields")
DESTRUCTIVE = frozenset(("$out", "$merge", "$delete", "$insert", "$replace"))
MOST_STAGES, MOST_ROWS, MOST_QUERIES, MOST_PIPELINES = 20, 500, 100, 50
WEIGHTS = {"$lookup": 3, "$facet": 3, "$group": 2, "$bucket": 2, "$sort": 1, "$match": 0, "$project": 0}
QUERY_TYPES = ("find", "aggregate", "count", "distinct")


# ---- validation ----
def build(stages: list[dict], validate: bool = True) -> list[dict]:
    """The checked pipeline; raises ValidationError."""
    if validate and (problems := problems_of(stages)):
        raise ValidationError("; ".join(problems), problems=problems)
    return stages


def problems_of(stages) -> list[str]:
    if not isinstance(stages, list) or not stages:
        return ["a pipeline is a list of stages"]
    found = [f"more than {MOST_STAGES} stages"] if len(stages) > MOST_STAGES else []
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            found.append(f"stage {i} isn't an object with one key")
            continue
        name = next(iter(stage))
        if name in DESTRUCTIVE:
            found.append(f"stage {i}: {name} writes")
        elif name not in STAGES:
            found.append(f"stage {i}: {name} is unknown")
    return found


def estimate(stages: list[dict]) -> tuple[int, str]:
    """Weight of a pipeline and what it is called."""
    total = sum(WEIGHTS.get(next(iter(s)), 1) for s in stages)
    return total, next((name for most, name in ((2, "minimal"), (5, "low"), (10, "medium")) if total <= most), "high")


def parse_query(query: str, query_type: str):
    """A JSON text of one of the four types, without writing operations."""
    if query_type not in QUERY_TYPES:
        raise ValidationError(f"query type {query_type} isn't one of {', '.join(QUERY_TYPES)}")
    try:
        parsed = json.loads(query) if isinstance(query, str) else query
    except ValueError as e:
        raise ValidationError(f"no JSON: {e}") from e
    if (query_type == "aggregate") != isinstance(parsed, list):
        raise ValidationError("aggregate takes a list of stages, the other types an object")

    def keys(x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield k
                yield from keys(v)
        elif isinstance(x, list):
            for v in x:
                yield from keys(v)

    if bad := DESTRUCTIVE & set(keys(parsed)):
        raise ValidationError(f"writing operations: {', '.join(sorted(bad))}")
    L.validate_depth(parsed)
    return parsed


# ---- expressions ----
def expression(e) -> Column:
    """A value, "$field" or an operator object."""
    if isinstance(e, str) and e.startswith("$"):
        return F.col(e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    if len(e) != 1 or not next(iter(e)).startswith("$"):
        return F.struct(*(expression(v).alias(k) for k, v in e.items()))
    (op, arg), = e.items()
    args = [expression(a) for a in arg] if isinstance(arg, list) else None
    two = {
        "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$gt": lambda a, b: a > b,
        "$gte": lambda a, b: a >= b, "$subtract": lambda a, b: a - b, "$divide": lambda a, b: F.try_divide(a, b),
    }
    if op in two:
        return two[op](*args)
    if op in ("$and", "$or"):
        return reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), args)
    if op in ("$add", "$multiply"):
        return reduce((lambda a, b: a + b) if op == "$add" else (lambda a, b: a * b), args)
    if op == "$cond":
        test, yes, no = ([arg["if"], arg["then"], arg["else"]] if isinstance(arg, dict) else arg)
        return F.when(expression(test), expression(yes)).otherwise(expression(no))
    if op == "$switch":
        out = F
        for branch in arg["branches"]:
            out = out.when(expression(branch["case"]), expression(branch["then"]))
        return out.otherwise(expression(arg["default"])) if "default" in arg else out
    if op == "$ifNull":
        return F.coalesce(*args)
    if op == "$concat":
        return F.concat(*args)
    if op == "$slice":
        return F.slice(args[0], 1, arg[1]) if len(arg) == 2 else F.slice(args[0], arg[1] + 1, arg[2])
    one = {"$size": F.size, "$year": lambda c: F.year(c).cast("long"), "$month": lambda c: F.month(c).cast("long"), "$toLower": F.lower, "$toUpper": F.upper, "$not": lambda c: ~c}
    if op in one:
        return one[op](expression(arg[0] if isinstance(arg, list) else arg))
    raise ValidationError(f"unknown expression {op}")


def condition(match: dict) -> Column:
    """A filter document as a Column; an empty one holds everywhere."""
    parts: list[Column] = []
    for field, want in match.items():
        if field in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if field == "$and" else (lambda a, b: a | b), map(condition, want)))
            continue
        c = F.col(field)
        if not isinstance(want, dict):
            parts.append(c.isNull() if want is None else c == want)
            continue
        for op, v in want.items():
            if op == "$options":
                continue
            if op == "$regex":
                parts.append(c.rlike(("(?iu)" if "i" in want.get("$options", "") else "") + v))
            elif op == "$ne":
                parts.append(c.isNotNull() if v is None else (c != v) | c.isNull())
            elif op == "$exists":
                parts.append(c.isNotNull() if v else c.isNull())
            elif op in ("$in", "$nin"):
                parts.append(c.isin(v) if op == "$in" else ~F.coalesce(c.isin(v), F.lit(False)))
            elif op in ("$gt", "$gte", "$lt", "$lte", "$eq"):
                parts.append({"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v, "$eq": c == v}[op])
            else:
                raise ValidationError(f"unknown filter {op}")
    return L.all_of(*parts) if parts else F.lit(True)


def accumulator(spec: dict) -> Column:
    (op, arg), = spec.items()
    c = expression(arg)
    if op == "$sum":
        return F.count("*") if arg == 1 else F.coalesce(F.sum(c), F.lit(0))
    if op == "$push":
        return F.sort_array(F.collect_list(c))
    if op == "$addToSet":
        return F.sort_array(F.collect_set(c))
    found = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.min, "$count": lambda _: F.count("*")}.get(op)
    if found is None:
        raise ValidationError(f"unknown accumulator {op}")
    return found(c)  # $first without an order is the least value, so that it is the same in any run


def project(df: DataFrame, spec: dict) -> DataFrame:
    """1 keeps, 0 drops, anything else is computed; _id stays unless dropped."""
    drops = [k for k, v in spec.items() if v in (0, False) and not isinstance(v, (dict, str))]
    made = [expression(v).alias(k) for k, v in spec.items() if isinstance(v, (dict, str))]
    keeps = [k for k, v in spec.items() if v in (1, True) and not isinstance(v, (dict, str))]
    if not keeps and not made:
        return df.drop(*drops)
    own = ["_id"] if "_id" in df.columns and "_id" not in spec else []
    return df.select(*own, *(F.col(k).alias(k.split(".")[-1]) for k in keeps), *made)


# ---- stages ----
def compile_pipeline(df: DataFrame, stages: list[dict], tables=None) -> DataFrame:
    """The plan of a pipeline over ``df``; ``tables`` finds the other side of a $lookup by name."""
    todo = list(build(stages))
    while todo:
        (name, arg), = todo.pop(0).items()
        if name == "$lookup" and todo and todo[0] in ({"$unwind": f"${arg['as']}"}, {"$unwind": {"path": f"${arg['as']}"}}):
            todo.pop(0)
            df = _join(df, arg, tables)
        else:
            df = _STAGE[name](df, arg, tables)
    return df


def _join(df, arg, tables):
    """A $lookup whose array is unwound at once: an inner join, without any array."""
    other = tables(arg["from"])
    side = other.select(F.col(arg["foreignField"]).alias("_key"), F.struct(*sorted(other.columns)).alias(arg["as"]))
    return df.join(side, F.col(arg["localField"]) == F.col("_key")).drop("_key")


def _group(df, arg, _):
    key = arg["_id"]
    aggs = [accumulator(v).alias(k) for k, v in arg.items() if k != "_id"]
    if key is None:
        return df.agg(*(aggs or [F.count("*").alias("count")]))
    keys = expression(key).alias("_id")
    return df.groupBy(keys).agg(*aggs) if aggs else df.select(keys).distinct()


def _sort(df, arg, _):
    return df.orderBy(*(F.asc_nulls_first(k) if v == 1 else F.desc_nulls_last(k) for k, v in arg.items()))


def _unwind(df, arg, _):
    path = (arg["path"] if isinstance(arg, dict) else arg).removeprefix("$")
    outer = isinstance(arg, dict) and arg.get("preserveNullAndEmptyArrays")
    return df.withColumn(path, (F.explode_outer if outer else F.explode)(path))


def _lookup(df, arg, tables):
    return lookup(df, tables(arg["from"]), arg["localField"], arg["foreignField"], arg["as"])


def _grouped(stages: list[dict]) -> dict | None:
    """A facet's part as matches, one grouping, and what is kept of its rows; None if it has another shape."""
    names = [next(iter(x)) for x in stages]
    n = next((i for i, x in enumerate(names) if x != "$match"), len(names))
    if n == len(names) or names[n] not in ("$group", "$count", "$bucket") or names[n + 1 :] != [x for x in ("$sort", "$skip", "$limit") if x in names[n + 1 :]]:
        return None
    (kind, arg), rest = next(iter(stages[n].items())), {k: v for x in stages[n + 1 :] for k, v in x.items()}
    if kind == "$count":
        key, aggs = None, {arg: {"$sum": 1}}
    elif kind == "$bucket":
        key, aggs = bucket_of(arg), arg.get("output", {"count": {"$sum": 1}})
    else:
        key, aggs = None if arg["_id"] is None else expression(arg["_id"]), {k: v for k, v in arg.items() if k != "_id"}
        if key is None:  # one row, also of nothing
            return None
    if not aggs or any(next(iter(a)) in ("$push", "$addToSet") for a in aggs.values()):
        return None
    matches = [condition(next(iter(x.values()))) for x in stages[:n]]
    return {"match": L.all_of(*matches) if matches else F.lit(True), "key": key, "aggs": aggs, "count": kind == "$count", "sort": rest.get("$sort"), "skip": rest.get("$skip", 0), "limit": rest.get("$limit")}


def facet_rows(df: DataFrame, parts: dict[str, dict]) -> DataFrame:
    """One scan for all parts: (part, a struct of its columns per part, place). A row goes to each part that it matches, and is summed up by (part, key)
    before it is shuffled; of a part with a limit only so many of its groups stay."""
    from pyspark.sql import Window

    tags = F.array_compact(F.array(*(F.when(p["match"], F.lit(i)) for i, p in enumerate(parts.values()))))
    rows = df.withColumn("_part", F.explode(tags))
    keys = {f"_k{i}": F.when(F.col("_part") == i, p["key"]) for i, p in enumerate(parts.values()) if p["key"] is not None}
    aggs = [accumulator(spec).alias(f"_a{i}_{name}") for i, p in enumerate(parts.values()) for name, spec in p["aggs"].items()]
    summed = rows.groupBy("_part", *(c.alias(k) for k, c in keys.items())).agg(*aggs)
    order = []
    for i, p in enumerate(parts.values()):
        columns = {"_id": F.col(f"_k{i}")} if p["key"] is not None else {}
        columns |= {name: F.col(f"_a{i}_{name}") for name in p["aggs"]}
        p["row"] = F.struct(*(c.alias(k) for k, c in columns.items()))
        sort = p["sort"] or {}
        wanted = [(columns[k], v) for k, v in sort.items() if k in columns] + [(c, 1) for k, c in columns.items() if k not in sort]
        order += [(F.asc_nulls_first if v == 1 else F.desc_nulls_last)(F.when(F.col("_part") == i, c)) for c, v in wanted]
    placed = summed.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    kept = F.lit(False)
    for i, p in enumerate(parts.values()):
        kept = kept | ((F.col("_part") == i) & (F.col("_place") > p["skip"]) & (F.lit(True) if p["limit"] is None else F.col("_place") <= p["skip"] + p["limit"]))
    return placed.where(kept)


def _facet(df, arg, tables):
    """Each part's rows as one array, in one row. Parts that match and group share one scan and one grouping; others are planned one by one.

    An array is as long as its part's limit, or as its groups; ``facet_rows`` gives the same without arrays.
    """
    shapes = {name: _grouped(stages) for name, stages in arg.items()}
    shared = {name: p for name, p in shapes.items() if p is not None}
    out = None
    if len(shared) > 1:
        rows = facet_rows(df, shared)
        arrays = []
        for i, (name, p) in enumerate(shared.items()):
            found = F.transform(F.sort_array(F.collect_list(F.when(F.col("_part") == i, F.struct("_place", p["row"].alias("row"))))), lambda x: x["row"])
            if p["count"]:  # the count of nothing is a row, too
                found = F.when(F.size(found) == 0, F.array(F.struct(*(F.lit(0).cast("long").alias(c) for c in p["aggs"])))).otherwise(found)
            arrays.append(found.alias(name))
        out = rows.agg(*arrays).withColumn("_one", F.lit(1))
    for name, stages in arg.items():
        if len(shared) > 1 and name in shared:
            continue
        part = compile_pipeline(df, stages, tables)
        one = part.agg(F.sort_array(F.collect_list(F.struct(*part.columns))).alias(name)).withColumn("_one", F.lit(1))
        out = one if out is None else out.join(one, "_one")
    return out.select(*arg)


def bucket_of(arg: dict) -> Column:
    c, bounds = expression(arg["groupBy"]), arg["boundaries"]
    key = F
    for low, high in zip(bounds, bounds[1:], strict=False):
        key = key.when((c >= low) & (c < high), F.lit(str(low)))
    return key.otherwise(F.lit(str(arg["default"]) if "default" in arg else None))


def _bucket(df, arg, _):
    key = bucket_of(arg)
    output = arg.get("output", {"count": {"$sum": 1}})
    return df.groupBy(key.alias("_id")).agg(*(accumulator(v).alias(k) for k, v in output.items()))


def sample(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Rows in order of a hash of all their columns: random in effect, the same in any run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(size)


_STAGE = {
    "$match": lambda df, a, _: df.where(condition(a)),
    "$project": lambda df, a, _: project(df, a),
    "$group": _group,
    "$sort": _sort,
    "$limit": lambda df, a, _: df.limit(a),
    "$skip": lambda df, a, _: df.offset(a),
    "$count": lambda df, a, _: df.agg(F.count("*").alias(a)),
    "$lookup": _lookup,
    "$unwind": _unwind,
    "$facet": _facet,
    "$bucket": _bucket,
    "$sample": lambda df, a, _: sample(df, a["size"]),
    "$addFields": lambda df, a, _: df.withColumns({k: expression(v) for k, v in a.items()}),
}


# ---- execution ----
def execute(tables, table: str, query, query_type: str = "find", projection: dict | None = None, limit: int = 100) -> DataFrame:
    """find, aggregate, count or distinct over a named table, with a capped limit."""
    parsed, df = parse_query(query, query_type), tables(table)
    if query_type == "count":
        return df.where(condition(parsed)).agg(F.count("*").alias("count"))
    if query_type == "distinct":
        field = parsed["field"]
        values = df.where(condition(parsed.get("query", {}))).select(F.col(field).alias("value"))
        if values.schema["value"].dataType.typeName() == "array":
            values = values.select(F.explode("value").alias("value"))
        return values.distinct()
    out = compile_pipeline(df, parsed, tables) if query_type == "aggregate" else df.where(condition(parsed))
    if projection and query_type == "find":
        out = project(out, projection)
    return out.limit(min(limit, MOST_ROWS))


def bulk(tables, queries: list[dict], limit: int = 100) -> tuple[DataFrame | None, list[dict]]:
    """Results of several finds or pipelines, tagged with query_idx, and an error envelope per query that failed to plan."""
    from vitalgrain.functions.errors import convert

    most = MOST_PIPELINES if any("pipeline" in q for q in queries) else MOST_QUERIES
    if len(queries) > most:
        raise ValidationError(f"more than {most} queries")
    parts, errors = [], []
    for i, q in enumerate(queries):
        try:
            kind, body = ("aggregate", q["pipeline"]) if "pipeline" in q else ("find", q.get("filter", {}))
            part = execute(tables, q["collection"], body, kind, q.get("projection"), q.get("limit", limit))
            parts.append(part.select(F.lit(i).alias("query_idx"), "*"))
        except Exception as e:
            errors.append({"query_idx": i} | convert(e).as_dict("bulk"))
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None), errors


def paginate(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """A page; the limit lies between 1 and 1000."""
    return df.orderBy(*order).offset(max(0, skip)).limit(max(1, min(limit, 1000)))


def batches(df: DataFrame, order: str, size: int = 1000, limit: int = 10_000) -> DataFrame:
    """Rows in order up to the limit with the number of their batch; the limit is a top-k, so one task numbers at most that many."""
    from pyspark.sql import Window

    first = df.orderBy(order).limit(min(limit, 100_000))
    return first.withColumn("batch_number", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def analyze(df: DataFrame, stages: list[dict], tables=None) -> dict:
    """Weight, pushed filters and columns read, with hints where a scan gets no filter."""
    plan = compile_pipeline(df, stages, tables)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    pushed = [line.split("PushedFilters: ")[1].split("], ")[0] + "]" for line in scans if "PushedFilters: " in line]
    weight, name = estimate(stages)
    hints = ["no filter reaches the scan: match on a stored column first"] if scans and all(p == "[]" for p in pushed) else []
    return {"weight": weight, "complexity": name, "scans": len(scans), "pushed_filters": pushed, "shuffles": plan.count("Exchange hashpartitioning"), "hints": hints}
