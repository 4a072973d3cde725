"""Documents and pages: titles, links, parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_titles(pages: DataFrame) -> DataFrame:
    """The text of <title>, else of the first <h1>."""
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return pages.withColumn("title", F.coalesce(part("title"), part("h1")))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): every href."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


def sniff(path: Column, content: Column) -> Column:
    """Kind by ending, else by content."""
    ends = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in {"csv": "csv", "json": "json", "jsonl": "jsonl", "sql": "sql", "md": "markdown", "ipynb": "jupyter", "xml": "xml", "yaml": "yaml", "yml": "yaml", "py": "code", "java": "code", "ttl": "turtle"}.items() for x in kv])
    yaml_score = F.regexp_count(content, F.lit(r"(?m)^[\w-]+:\s")) + F.regexp_count(content, F.lit(r"(?m)^\s*-\s"))
    by_content = (
        F.when(content.contains('"cells"') & content.contains('"metadata"'), "jupyter").when(content.contains("```"), "markdown").when(F.ltrim(content).startswith("{") | F.ltrim(content).startswith("["), "json").when(F.ltrim(content).startswith("<"), "xml").when(yaml_score >= 3, "yaml").otherwise("text")
    )
    return F.coalesce(known[ends], by_content)


def fenced_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, kind, language, body): text and code records of a Markdown text in order."""
    split = F.split(F.col(text_col), "(?m)^```")
    parts = docs.select(id_col, F.posexplode(split).alias("n", "part"))
    code = F.col("n") % 2 == 1
    body = F.when(code, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    language = F.when(code, F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)))
    out = parts.select(id_col, "n", F.when(code, "code").otherwise("text").alias("kind"), language.alias("language"), F.btrim(body, F.lit(" \t\r\n")).alias("body"))
    return out.where("body <> ''")


NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:string>>>"


def notebook_cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One record per cell; a source that is a list of lines is joined."""
    cells = docs.select(id_col, F.posexplode(F.from_json(text_col, NOTEBOOK)["cells"]).alias("n", "c"))
    lines = F.from_json(F.col("c.source"), "array<string>")
    body = F.when(F.col("c.source").startswith("["), F.array_join(lines, "")).otherwise(F.col("c.source"))
    return cells.select(id_col, "n", F.col("c.cell_type").alias("kind"), F.coalesce(body, "c.source").alias("body"))


def xml_snippets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """<snippet>, <example> and <sample> elements with their code, annotation and tags."""
    blocks = F.regexp_extract_all(text_col, F.lit(r"(?s)<(?:snippet|example|sample)\b[^>]*>(.*?)</(?:snippet|example|sample)>"), 1)
    out = docs.select(id_col, F.posexplode(blocks).alias("n", "b"))
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("b", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    tags = F.filter(F.transform(F.split(part("tags"), ","), lambda x: F.trim(x)), lambda t: t != "")
    return out.select(id_col, "n", part("code").alias("code"), part("annotation").alias("annotation"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))


def yaml_records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The items of a YAML list, or of its data, examples or samples; fields by their usual names."""
    import pandas as pd

    def run(frames):
        import yaml

        for f in frames:
            out = []
            for key, text in zip(f[id_col], f["__text"], strict=True):
                try:
                    value = yaml.safe_load(text or "")
                except yaml.YAMLError:
                    continue
                if isinstance(value, dict):
                    value = next((value[k] for k in ("data", "examples", "samples") if isinstance(value.get(k), list)), [value])
                for n, item in enumerate(value if isinstance(value, list) else []):
                    item = item if isinstance(item, dict) else {"code": str(item)}
                    pick = lambda *names, item=item: next((str(item[k]) for k in names if item.get(k) is not None), None)
                    out.append((key, n, pick("code", "snippet", "source", "body"), pick("annotation", "description", "comment", "text")))
            yield pd.DataFrame(out, columns=[id_col, "n", "code", "annotation"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInPandas(run, f"{id_col} {kind}, n int, code string, annotation string")


def comment_blocks(docs: DataFrame, id_col: str, text_col: str, mark: str = r"^\s*(#|//|--)") -> DataFrame:
    """Alternating runs of comment and code lines (gaps and islands inside the row's array; no shuffle)."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")
    typed = F.transform(lines, lambda x: F.struct(x.rlike(mark).alias("c"), x.alias("t")))
    start = F.array().cast("array<struct<kind:string,body:string>>")

    def step(acc: Column, x: Column) -> Column:
        kind = F.when(x["c"], F.lit("comment")).otherwise(F.lit("code"))
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(last["kind"] == kind, F.lit(False))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        grown = F.concat(head, F.array(F.struct(kind.alias("kind"), F.concat_ws("\n", last["body"], x["t"]).alias("body"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(kind.alias("kind"), x["t"].alias("body")))))

    return docs.select(id_col, F.posexplode(F.aggregate(typed, start, step)).alias("n", "b")).select(id_col, "n", "b.kind", "b.body")


def link_annotation(records: DataFrame, id_col: str) -> DataFrame:
    """Code with the record before it, if that is a comment."""
    w = Window.partitionBy(id_col).orderBy("n")
    return records.withColumn("annotation", F.when((F.col("kind") == "code") & (F.lag("kind").over(w) == "comment"), F.lag("body").over(w)))


def question_hints(lines: DataFrame, id_col: str, back: int = 8) -> DataFrame:
    """For each line that begins a SELECT, the nearest comment within ``back`` lines before it."""
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(-back, 0)
    comment = F.when(F.trim("line").startswith("--"), F.trim(F.regexp_replace("line", r"^\s*--\s*", "")))
    out = lines.withColumn("hint", F.last(comment, ignorenulls=True).over(w))
    return out.where(F.lower(F.ltrim("line")).startswith("select"))


def chunks(docs: DataFrame, id_col: str, least: int = 10) -> DataFrame:
    """The first non-empty of text, content, chunk and body, and a summary, of more than ``least`` characters."""
    names = {c.lower(): c for c in docs.columns}
    fields = [F.nullif(F.trim(F.col(names[c])), F.lit("")) for c in ("text", "content", "chunk", "body") if c in names]
    parts = [F.coalesce(*fields)] + [F.col(names[c]) for c in ("summary", "description") if c in names]
    out = docs.select(id_col, F.explode(F.array(*parts)).alias("chunk"))
    return out.where(F.length("chunk") > least)


def discover(files: DataFrame, least: int = 1, most_bytes: int = 100 << 20) -> DataFrame:
    """Supported files by directory. files(path, length), as the binaryFile source gives them."""
    ok = files.where(F.lower("path").rlike(r"\.(csv|json|jsonl|md|txt|html|sql|xml|ya?ml|ipynb)$") & (F.col("length") <= most_bytes))
    by = ok.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("bytes"))
    return by.where(F.col("file_count") >= least).orderBy(F.desc("file_count"), "directory")


def sequence_gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """Integers that are missing between the first and the last, by runs of neighbours."""
    w = Window.partitionBy(key).orderBy(number)
    gaps = df.select(key, number).distinct().withColumn("next", F.lead(number).over(w)).where(F.col("next") > F.col(number) + 1)
    return gaps.select(key, F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"))
