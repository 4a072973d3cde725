"""Search texts, question routing, catalogues, release diffs, explanations, sync."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def search_text(resources: DataFrame) -> DataFrame:
    """The text that a resource is found by: names and tags for all kinds, and what its kind adds from its spec."""
    common = [F.col("name"), F.col("display_name"), F.col("description"), F.array_join("tags", " ")]
    by_kind = (
        F.when(F.col("kind") == "Metric", F.concat_ws(" ", F.col("spec")["aggregation"], F.col("spec")["measure"]))
        .when(F.col("kind") == "Dimension", F.concat_ws(" ", F.col("spec")["field"], F.col("spec")["data_type"]))
        .when(F.col("kind") == "PhysicalDataset", F.col("spec")["physical_name"])
        .otherwise(F.array_join(F.map_values("spec"), " "))
    )
    return resources.withColumn("search_text", F.concat_ws(" ", *common, by_kind))


def of_kinds(resources: DataFrame, kinds: list[str]) -> DataFrame:
    """resources of allowed kinds; the filter reaches the scan."""
    return resources.where(F.col("kind").isin(kinds))


def compare(field: str, op: str, value) -> Column:
    """a predicate on a graph field; combine with & | ~."""
    c = F.col(field)
    return {"==": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op] if op in ("==", "!=", ">", ">=", "<", "<=") else {"CONTAINS": lambda: c.contains(value), "STARTS WITH": lambda: c.startswith(value), "IN": lambda: c.isin(list(value))}[op]()


def route_questions(questions: DataFrame, vocabulary: DataFrame, scenes: DataFrame, fallback: DataFrame, per_kind: int = 3) -> DataFrame:
    """Cards of each question: vocabulary matches, the scenes of matched metrics, else hits of the fallback search.

    questions(qid, question), vocabulary(card, term, kind), scenes(metric, scene), fallback(qid, card, kind, score): at
    most ``per_kind`` of each kind and question.
    """
    from orrery.operators.retrieval import metric_scenes, vocabulary_match

    kinds = vocabulary.select("card", "kind").distinct()
    hits = vocabulary_match(questions, vocabulary.select("card", "term")).join(kinds, "card")
    owners = metric_scenes(hits.select("qid", "card", F.col("card").alias("metric")), scenes)
    found = hits.select("qid", "card", "kind", "score", F.lit("vocabulary").alias("way")).unionByName(owners.select("qid", "card", F.lit("scene").alias("kind"), "score", F.lit("scene").alias("way")))
    rest = fallback.join(found.select("qid").distinct(), "qid", "left_anti").select("qid", "card", "kind", "score", F.lit("search").alias("way"))
    rank = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "card"))
    return found.unionByName(rest).withColumn("r", rank).where(F.col("r") <= per_kind).drop("r")


def template_tools(templates: DataFrame, tools: DataFrame) -> DataFrame:
    """Templates with the tool of their resource at their revision."""
    return templates.join(tools, ["resource_id", "revision_id"])


def release_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(resource_id, change): added, removed, changed revision."""
    j = old.select("resource_id", F.col("revision_id").alias("was")).join(new.select("resource_id", F.col("revision_id").alias("is")), "resource_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return j.select("resource_id", change.alias("change")).where("change is not null")


def explain_fact(derived: DataFrame, terms: list[str]) -> DataFrame:
    """Rule of one derived fact, or that it was asserted."""
    test = reduce(lambda a, b: a & b, [F.col(f"t{i}") == t for i, t in enumerate(terms)])
    return derived.where(test).withColumn("how", F.when(F.col("rule_id").isNull(), "asserted").otherwise("derived"))


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k highest, ties by key; planned as a top-k of each partition, without a full sort."""
    return df.orderBy(F.desc(score), key).limit(k)


def by_length(terms: Column) -> Column:
    """Terms by length and text, both falling."""
    return F.array_sort(terms, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, 1).when(a > b, -1).otherwise(0))


def register_functions(spark: SparkSession) -> None:
    """SQL functions for users of the engine, as SQL expressions that the optimizer sees through."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION orrery_mask(s STRING) RETURNS STRING RETURN CASE WHEN length(s) <= 4 THEN '****' ELSE concat(substring(s, 1, 2), '****', substring(s, -2, 2)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION orrery_digest(s STRING) RETURNS STRING RETURN concat('sha256:', sha2(s, 256))")


def sync_plan(local: DataFrame, remote: DataFrame, strategy: str) -> DataFrame:
    """What to do with each key (key, hash, updated_at): upload, download, conflict.

    Strategies: local (ours wins), remote (theirs wins), merge (the later wins), manual (conflicts are listed).
    """
    j = local.select("key", F.col("hash").alias("h1"), F.col("updated_at").alias("u1")).join(remote.select("key", F.col("hash").alias("h2"), F.col("updated_at").alias("u2")), "key", "full_outer")
    both = {"local": F.lit("upload"), "remote": F.lit("download"), "merge": F.when(F.col("u1") >= F.col("u2"), "upload").otherwise("download"), "manual": F.lit("conflict")}[strategy]
    action = F.when(F.col("h2").isNull(), "upload").when(F.col("h1").isNull(), "download").when(F.col("h1") != F.col("h2"), both)
    return j.select("key", action.alias("action")).where("action is not null")


class Cached:
    """Results of named computations, persisted once and dropped by least recent use beyond ``most`` names."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, {}

    def get(self, name: str, compute) -> DataFrame:
        if name in self.held:
            self.held[name] = self.held.pop(name)
        else:
            self.held[name] = compute().persist()
            while len(self.held) > self.most:
                self.held.pop(next(iter(self.held))).unpersist()
        return self.held[name]
