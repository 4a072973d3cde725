"""Smaller operators: references, schemas, linting, regression cases, routing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: which document kinds are read as they are, and which need a parsing engine.
DIRECT, ENGINE = ("txt", "md", "json", "jsonl", "csv", "html"), ("pdf", "docx", "pptx", "xlsx", "png", "jpg")


def parse_route(path: Column, engine: bool) -> Column:
    """Direct, engine, fallback (no engine here) or unsupported."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin(*DIRECT), "direct").when(end.isin(*ENGINE), F.lit("engine" if engine else "fallback")).otherwise("unsupported")


def label_page(nodes: DataFrame, labels: list[str], skip: int, limit: int) -> DataFrame:
    """nodes with any of some labels, a page of them."""
    return nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))).orderBy("id").offset(skip).limit(limit)


def table_references(texts: DataFrame, tables: DataFrame, id_col: str, text_col: str, most: int = 8) -> DataFrame:
    """Names of known tables that a text holds, full or bare, at most ``most`` in order. An equi-join on words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"([a-z_][\w]*(?:\.[a-z_][\w]*)?)"), 1))
    found = texts.select(id_col, F.explode(words).alias("word"))
    names = tables.select("table", F.explode(F.array_distinct(F.array(F.lower("table"), F.regexp_extract(F.lower("table"), r"([^.]+)$", 1)))).alias("word"))
    hits = found.join(names, "word").select(id_col, "table").distinct()
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("table"))
    return hits.withColumn("r", rank).where(F.col("r") <= most).groupBy(id_col).agg(F.sort_array(F.collect_list("table")).alias("tables"))


def instance_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Instances of each class by is_a."""
    e = edges.where("relation = 'is_a'")
    j = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("class")), "dst")
    return j.groupBy("class").agg(F.count_distinct("src").alias("n"))


def history(runs: DataFrame, by: str) -> DataFrame:
    """Runs, share that succeeded, bytes, by a column."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "success").cast("int")).alias("success_rate"), F.sum("bytes").alias("bytes"))


def refresh_average(runs: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """0.9 of the average so far and 0.1 of the new value, from the first value on.

    The weights are powers, so it is one weighted sum a key and no fold: x1 * 0.9^(n-1) + sum of 0.1 * 0.9^(n-i) * xi.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = runs.select(key, F.col(value).alias("x"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    weight = F.pow(F.lit(keep), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(1 - keep)
    return rows.groupBy(key).agg(F.sum(F.col("x") * weight).alias("average"))


def guard_tokens(cases: DataFrame) -> DataFrame:
    """K6: all tokens that cases must contain."""
    return cases.select(F.explode("must_contain").alias("token")).distinct()


def schema_faults(value: Column, schema: dict[str, str], required: list[str], additional: bool = True) -> Column:
    """K7: faults of a JSON object: missing, unknown, or of another type (a boolean is no number)."""
    kinds = {"string": "^STRING$", "integer": r"^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
    parsed = F.try_parse_json(value)
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    out = []
    for name in required:
        out.append(F.when(~F.array_contains(keys, name), F.lit(f"missing:{name}")))
    for name, kind in sorted(schema.items()):
        is_kind = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f'$["{name}"]', "variant")).rlike(kinds[kind]), F.lit(False))
        out.append(F.when(F.array_contains(keys, name) & ~is_kind, F.lit(f"type:{name}")))
    faults = F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
    if additional:
        return faults
    known = F.array(*[F.lit(k) for k in sorted(schema)]).cast("array<string>")
    return F.concat(faults, F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k)))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """K9: (id, n, title, body) of the sections under Markdown headings."""
    parts = docs.select(id_col, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n#{1,6}\s+")).alias("n", "part")).where("n > 0")
    return parts.select(id_col, "n", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.btrim(F.regexp_replace("part", r"^[^\n]*\n?", ""), F.lit(" \t\r\n")).alias("body"))


def questions(docs: DataFrame, id_col: str, text_col: str, most: int = 6, least: int = 8) -> DataFrame:
    """K9: the first questions of ``least`` characters and more."""
    found = F.filter(F.transform(F.regexp_extract_all(text_col, F.lit(r"([^.!?。！？\n]+[?？])"), 1), lambda q: F.trim(q)), lambda q: F.length(q) >= least)
    return docs.select(id_col, F.slice(found, 1, most).alias("questions"))


def regression_cases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """SQL statements of a text with the comment before them and the tokens that an answer must contain."""
    from orrery.functions.text import sql_tables

    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    from orrery.sources.documents import question_hints

    return question_hints(lines, id_col).select(id_col, "n", "hint", F.col("line").alias("expected_sql"), sql_tables(F.col("line")).alias("must_contain"))


def contract_regressions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Cases whose SQL or ids differ from what is expected, or that are gone. (case_id, sql, ids)"""
    a = actual.select("case_id", F.col("sql").alias("sql_now"), F.sort_array("ids").alias("ids_now"))
    j = expected.select("case_id", "sql", F.sort_array("ids").alias("ids")).join(a, "case_id", "left")
    fault = F.when(F.col("sql_now").isNull(), "missing").when(F.col("sql") != F.col("sql_now"), "sql").when(F.col("ids") != F.col("ids_now"), "ids")
    return j.select("case_id", fault.alias("fault")).where("fault is not null")


def config_faults(rows: DataFrame, ranges: dict[str, tuple[float, float]], required: list[str], key: str) -> DataFrame:
    """Required fields that are null, numbers out of range."""
    out = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    out += [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(f"range:{c}")) for c, (low, high) in sorted(ranges.items())]
    return rows.select(key, F.explode(F.array_compact(F.array(*out))).alias("fault"))


def action_allowed(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """By action: role and purpose allowed, impacted objects within the limit."""
    j = requests.join(policies, "action", "left")
    ok = F.array_contains("roles", F.col("role")) & F.array_contains("purposes", F.col("purpose")) & (F.col("impacted") <= F.col("max_impacted"))
    return j.select("request_id", F.coalesce(ok, F.lit(False)).alias("allowed"))
