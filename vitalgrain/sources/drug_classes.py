"""Drug classification: a recursive class tree, its members, and the table of drugs.

The service answers are rows of JSON text, whether they come from files or from the REST reader.
"""

from __future__ import annotations

import math
import time
import urllib.request
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from vitalgrain.functions import scalars as S
from vitalgrain.streaming.bounded import shared_folder

#: The anatomical roots, the names that members stand under, and the shape of a code on each level.
ROOTS = ("A", "B", "C", "D", "G", "H", "J", "L", "M", "N", "P", "R", "S", "V")
CONCEPTS = ("minConcept", "rxclassMinConcept", "minConceptItem")
LEVEL_2, LEVEL_3, LEVEL_4 = r"^[A-Z]\d{2}$", r"^[A-Z]\d{2}[A-Z]$", r"^[A-Z]\d{2}[A-Z]{2}$"


class RestSource(DataSource):
    """spark.read.format("rest_json").option("urls", "a b c"): one row (url, body) per address, with retries, a null body where they fail.

    A filter on url (equal, or in a list) reaches the source, so other addresses aren't asked.
    """

    @classmethod
    def name(cls):
        return "rest_json"

    def schema(self):
        return "url string, body string"

    def reader(self, schema):
        return RestReader(self.options)


class Share(InputPartition):
    """The addresses of one task, and its share of a host's schedule: the slots ``first``, ``first + step``, ... of ``delay`` seconds from ``begin``."""

    def __init__(self, urls: list[str], begin: float, delay: float, first: int, step: int):
        self.value, self.urls, self.begin, self.delay, self.first, self.step = None, urls, begin, delay, first, step

    def wait(self, last: int) -> int:
        """Sleep until the task's next slot after ``last`` that isn't over; its number. No two tasks share a slot."""
        now = max(last + 1, math.floor((time.time() - self.begin) / self.delay) + 1) if self.delay > 0 else last + 1
        slot = now + (self.first - now) % self.step
        time.sleep(max(0.0, self.begin + slot * self.delay - time.time()))
        return slot


class RestReader(DataSourceReader):
    """Requests to a host go out at most one per ``delay`` seconds, whatever the number of tasks: the tasks of a host (``per_host``) take turns
    in one schedule by the clock. A try that fails waits for a later turn, longer each time."""

    def __init__(self, options):
        self.urls = list(dict.fromkeys(options.get("urls", "").split()))
        self.delay, self.retries, self.per_host = float(options.get("delay", "0.3")), int(options.get("retries", "3")), int(options.get("per_host", "4"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u == f.value]
            elif isinstance(f, In) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u in set(f.value)]
            else:
                yield f

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        begin, out = time.time(), []
        for urls in hosts.values():
            n = max(1, min(self.per_host, len(urls)))
            out += [Share(urls[i::n], begin, self.delay, i, n) for i in range(n)]
        return out or [Share([], begin, self.delay, 0, 1)]

    def read(self, partition):
        slot = -1
        for url in partition.urls:
            for attempt in range(self.retries + 1):
                if attempt:
                    time.sleep(0.4 * 1.8**attempt)
                slot = partition.wait(slot)
                try:
                    with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
                        yield url, answer.read().decode("utf-8", "replace")
                    break
                except OSError:
                    if attempt == self.retries:
                        yield url, None  # a failed address is a row without body


def edges(trees: DataFrame, body: str = "body", most_levels: int = 100) -> DataFrame:
    """(parent, code, name) from nested class trees, unfolded one level per step until no level is left.

    A level is written once, so that the next one doesn't parse those above it again.
    """
    spark, at = trees.sparkSession, shared_folder(trees.sparkSession)
    nodes = lambda c, path: F.explode(F.from_json(F.get_json_object(c, path), "array<string>"))
    level, parts = trees.select(F.lit(None).cast("string").alias("parent"), nodes(body, "$.rxclassTree").alias("node")), []
    for k in range(most_levels):
        here = level.select("parent", F.get_json_object("node", "$.rxclassMinConceptItem.classId").alias("code"), F.get_json_object("node", "$.rxclassMinConceptItem.className").alias("name"), "node")
        here.write.parquet(f"{at}/level-{k}")
        here = spark.read.schema(here.schema).parquet(f"{at}/level-{k}")
        if here.isEmpty():
            break
        parts.append(f"{at}/level-{k}")
        level = here.select(F.col("code").alias("parent"), nodes("node", "$.rxclassTree").alias("node"))
    found = spark.read.schema("parent string, code string, name string").parquet(*(parts or [f"{at}/level-0"]))
    return found.where("code IS NOT NULL").distinct()


def level_4(nodes: DataFrame) -> DataFrame:
    """Codes of level 4 with the names of their levels 2 and 3; a missing name is the code.

    A code's ancestors are prefixes of it, so the hierarchy is two joins, no recursion.
    """
    named = nodes.groupBy("code").agg(F.min("name").alias("name")).withColumn("name", F.coalesce("name", "code"))
    two = named.where(F.col("code").rlike(LEVEL_2)).select(F.col("code").alias("l2"), F.col("name").alias("therapeutic_class_l2"))
    three = named.where(F.col("code").rlike(LEVEL_3)).select(F.col("code").alias("l3"), F.col("name").alias("drug_class_l3"))
    four = named.where(F.col("code").rlike(LEVEL_4)).select(F.col("code").alias("atc_code"), F.col("name").alias("drug_subclass_l4"))
    return (
        four.withColumn("l2", F.substring("atc_code", 1, 3)).withColumn("l3", F.substring("atc_code", 1, 4)).join(two, "l2", "left").join(three, "l3", "left")
        .select("atc_code", F.coalesce("therapeutic_class_l2", "l2").alias("therapeutic_class_l2"), F.coalesce("drug_class_l3", "l3").alias("drug_class_l3"), "drug_subclass_l4")
    )


def recursive_paths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(code, path, depth) of every class below the roots, by a recursive query."""
    return spark.sql(
        """WITH RECURSIVE walk(code, path, depth) AS (
             SELECT code, code, 0 FROM {n} WHERE parent IS NULL
             UNION ALL SELECT e.code, walk.path || '/' || e.code, walk.depth + 1 FROM walk JOIN {n} e ON e.parent = walk.code
           ) SELECT * FROM walk""",
        n=nodes,
    )


def members(answers: DataFrame, body: str = "body") -> DataFrame:
    """(atc_code, rxcui, name) from answers in three layouts, the first that has members; ingredients only where there are any.

    A member stands by itself or under one of the names in ``CONCEPTS``, whichever first has an id and a name.
    """
    concept = "rxcui:string,name:string,tty:string"
    member = f"struct<{concept},{','.join(f'{c}:struct<{concept}>' for c in CONCEPTS)},drugMember:struct<{concept}>>"
    parsed = answers.select(
        "atc_code",
        F.from_json(body, f"drugMemberGroup struct<drugMember:array<{member}>>, rxclassDrugInfoList struct<rxclassDrugInfo:array<{member}>>, rxclassMinConceptList struct<rxclassMinConcept:array<{member}>>").alias("b"),
    )

    def named(m):
        return F.coalesce((F.trim(m["rxcui"]) != "") & (F.trim(m["name"]) != ""), F.lit(False))

    def own(m):
        places = [m["drugMember"], *(m[c] for c in CONCEPTS), F.struct(m["rxcui"], m["name"], m["tty"])]
        return F.coalesce(*(F.when(named(p), p) for p in places))

    layouts = [F.col("b.drugMemberGroup.drugMember"), F.col("b.rxclassDrugInfoList.rxclassDrugInfo"), F.col("b.rxclassMinConceptList.rxclassMinConcept")]
    valid = [F.filter(F.transform(a, own), lambda m: m.isNotNull()) for a in layouts]
    chosen = F.coalesce(*(F.when(F.size(a) > 0, a) for a in valid))
    only = F.filter(chosen, lambda m: m["tty"] == "IN")
    listed = parsed.select("atc_code", F.explode(F.when(F.size(only) > 0, only).otherwise(chosen)).alias("m"))
    return listed.select("atc_code", F.trim("m.rxcui").alias("rxcui"), F.trim("m.name").alias("name")).dropDuplicates(["rxcui", "atc_code"])


def rest(spark: SparkSession, urls: list[str], delay: float = 0.3, retries: int = 3, per_host: int = 4) -> DataFrame:
    """(url, body) of each address."""
    spark.dataSource.register(RestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("rest_json").option("urls", " ".join(urls)).option("delay", delay).option("retries", retries).option("per_host", per_host).load()


def fetch_members(spark: SparkSession, codes: list[str], base: str, **options) -> DataFrame:
    """(atc_code, rxcui, name) of some thousand classes: ingredients alone are asked for first, and all members where there are none."""
    from urllib.parse import quote

    def asked(some: list[str], suffix: str) -> DataFrame:
        address = {f"{base}/rxclass/classMembers.json?classId={quote(c)}&relaSource=ATC{suffix}": c for c in some}
        found = rest(spark, list(address), **options)
        return members(found.select(F.element_at(F.create_map(*(F.lit(x) for pair in address.items() for x in pair)), F.col("url")).alias("atc_code"), "body"))

    at = shared_folder(spark)
    asked(codes, "&ttys=IN").write.parquet(f"{at}/ingredients")  # asked once
    first = spark.read.schema("atc_code string, rxcui string, name string").parquet(f"{at}/ingredients")
    missing = sorted(set(codes) - {r.atc_code for r in first.select("atc_code").distinct().collect()})  # of the codes given
    return first.unionByName(asked(missing, "")) if missing else first


def extract(spark: SparkSession, base: str, roots: tuple[str, ...] = ROOTS, **options) -> DataFrame:
    """The drug table by way of the service: the trees of the roots, then the members of their classes."""
    trees = rest(spark, [f"{base}/rxclass/classTree.json?classId={r}&classType=ATC1-4" for r in roots], **options)
    classes = level_4(edges(trees))
    codes = sorted(r.atc_code for r in classes.select("atc_code").collect())  # the classification has a few thousand codes
    return drug_rows(fetch_members(spark, codes, base, **options), classes)


def drug_table(trees: DataFrame, answers: DataFrame) -> DataFrame:
    """The long table from stored answers: class trees (body), and members by class (atc_code, body)."""
    return drug_rows(members(answers), level_4(edges(trees)))


def drug_rows(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The long table: one row per ingredient and class."""
    return found.join(classes, "atc_code").select(
        F.col("rxcui").alias("ingredient_rxcui"), F.col("name").alias("primary_drug_name"), "therapeutic_class_l2", "drug_class_l3", "drug_subclass_l4", "atc_code"
    )


def valid_drugs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): id and name must not be blank."""
    fine = F.coalesce((F.trim("ingredient_rxcui") != "") & (F.trim("primary_drug_name") != ""), F.lit(False))
    return rows.where(fine).withColumns({c: S.blank_to_null(F.col(c)) for c in ("ingredient_rxcui", "primary_drug_name")}), rows.where(~fine)


def drugs(long: DataFrame) -> DataFrame:
    """One row per ingredient: that of the smallest class code."""
    rest = [c for c in long.columns if c != "ingredient_rxcui"]
    return long.groupBy("ingredient_rxcui").agg(F.min_by(F.struct(*rest), "atc_code").alias("d")).select("ingredient_rxcui", "d.*")
