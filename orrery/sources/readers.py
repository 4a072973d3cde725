"""Readers and connectors (S1-S3, S10-S16, S21, S25, S26). Every path goes through Spark's readers, so any store works."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.plans.query_plane import Registry


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header, all strings."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, record): items of an array or of its ``data``; an object or scalar is one record.

    Records are canonical JSON text; a scalar in an array becomes {"_index", "value"}.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("v"))
    parsed = F.try_parse_json(F.col("v"))
    data = F.get_json_object("v", "$.data")
    items = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).when(data.startswith("["), F.from_json(data, "array<string>")).otherwise(F.array(F.to_json(parsed)))
    out = whole.select("path", F.posexplode(items).alias("index", "item"))
    is_object = F.col("item").startswith("{")
    # from_json gives a string item without its quotes; what does not parse is such a string.
    value = F.when(F.try_parse_json("item").isNotNull(), F.col("item")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col("item").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))
    record = F.when(is_object, F.to_json(F.try_parse_json("item"))).otherwise(F.concat(F.lit('{"_index":'), F.col("index"), F.lit(',"value":'), value, F.lit("}")))
    return out.select("path", "index", record.alias("record"))


_SQL_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)
_SQL_INSERT = re.compile(r"(?is)^\s*insert\s+into\s+([\w.`\"]+)\s*(?:\(([^)]*)\))?\s*values\s*(.*)$")


def sql_statements(text: str) -> Iterator[tuple[str, str]]:
    """Statements up to semicolons that stand in no string, and the semicolon if there is one; comments go."""
    held: list[str] = []
    for m in _SQL_TOKEN.finditer(text):
        if m[0] == ";":
            yield "".join(held).strip(), ";"
            held = []
        elif not m[0].startswith(("--", "/*")):
            held.append(m[0])
    yield "".join(held).strip(), ""


def sql_records(text: str) -> list[tuple[str, list[str] | None, str]]:
    """(table, columns, values) of each INSERT; without any, (first table, None, text) of each SELECT."""
    statements = [(s, end) for s, end in sql_statements(text) if s]
    found = [m for s, _ in statements if (m := _SQL_INSERT.match(s))]
    if found:
        bare = lambda name: re.sub('[`"]', "", name.strip())
        return [(bare(m[1]), None if m[2] is None else [bare(c) for c in m[2].split(",")], m[3].strip()) for m in found]
    first = lambda s: (m[1] if (m := re.search(r"(?is)\bfrom\s+([\w.]+)", s)) else "")
    return [(first(s), None, s + end) for s, end in statements if s.lower().startswith("select")]


def read_sql_dump(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """S3: (table, columns, values_sql) of each INSERT, with or without a list of columns; a text without one gives its
    SELECTs with their first table. Semicolons and brackets in strings don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column(0) for r in sql_records(t.as_py() or "")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["table", "columns", "values_sql"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "table string, columns array<string>, values_sql string")


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


@dataclass(frozen=True)
class Batch:
    """What a connector fetched: rows, the cursor after them, whether they are the whole source."""

    rows: DataFrame
    cursor: str
    snapshot: bool


def content_cursor(df: DataFrame) -> str:
    """A hash of all rows, whatever their order or partitions."""
    h = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    row = df.agg(F.count(F.lit(1)), *parts).first()
    import hashlib

    return "sha256:" + hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


def jsonl_connector(spark: SparkSession, path: str, roots: list[str]) -> Callable[[str | None], Batch]:
    """A file below one of the allowed roots is one snapshot."""
    if ".." in path.split("/") or not any(path.startswith(r.rstrip("/") + "/") for r in roots):
        raise PermissionError(f"outside the allowed roots: {path}")

    def fetch(cursor: str | None) -> Batch:
        rows = spark.read.json(path)
        now = content_cursor(rows)
        return Batch(rows.limit(0) if now == cursor else rows, now, True)

    return fetch


def table_connector(spark: SparkSession, url: str, name: str, key: str, parts: int = 8, bounds: tuple[int, int] = (0, 1 << 31), **options: str) -> Callable[[str | None], Batch]:
    """A database table by JDBC, read in ``parts`` ranges of its key."""
    from orrery.plans.model import guard_identifier

    guard_identifier(name)

    def fetch(cursor: str | None) -> Batch:
        rows = spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
        now = content_cursor(rows)
        return Batch(rows.limit(0) if now == cursor else rows, now, True)

    return fetch


class JsonPages(DataSource):
    """Pages of {records, next_cursor} from an endpoint, as ``spark.read.format("json_pages")``.

    Options: endpoint with {cursor} in it, cursor (first), and pages (the most that one read follows, all if it is not
    given; the last row's next_cursor tells where to go on). The pages of a chain can only be fetched one after the
    other. A cursor that comes back is an error, as the chain would never end.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "record string, next_cursor string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _JsonPagesReader(dict(self.options))


class _JsonPagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str | None]]:
        cursor, seen = self.options.get("cursor", ""), set()
        most = self.options.get("pages")
        while most is None or len(seen) < int(most):
            if cursor in seen:
                raise ValueError(f"cursor {cursor!r} comes back")
            seen.add(cursor)
            with urllib.request.urlopen(self.options["endpoint"].replace("{cursor}", cursor), timeout=30) as answer:
                page = json.load(answer)
            following = page.get("next_cursor")
            for record in page.get("records", []):
                yield json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":")), following
            if not following:
                return
            cursor = following


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON-line files; Spark's checkpoint holds the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def connectors() -> Registry:
    """Connectors by source type."""
    out = Registry()
    for name, make in (("jsonl", jsonl_connector), ("table", table_connector), ("events", event_stream)):
        out.register(name, make)
    return out


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime, etag) below a prefix; contents are not read into rows for the list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.sha2(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("string")), 256).alias("etag"))


#: SQL types and the XML Schema types they become.
XSD_TYPES = {
    "varchar": "string", "char": "string", "text": "string", "string": "string", "int": "integer", "integer": "integer", "bigint": "long", "long": "long", "smallint": "short", "float": "float",
    "double": "double", "decimal": "decimal", "numeric": "decimal", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "dateTime", "timestamp": "dateTime", "timestamp_ntz": "dateTime",
    "time": "time", "blob": "base64Binary", "bytea": "base64Binary", "binary": "base64Binary",
}


def schema_to_ontology(tables: dict[str, DataFrame], foreign_keys: dict[tuple[str, str], str] | None = None) -> list[dict[str, str]]:
    """A class for a table, a datatype property for a column, an object property for a foreign key."""

    def pascal(name: str) -> str:
        return "".join(w.capitalize() for w in re.sub("^(tbl_|table_|t_)", "", name.lower()).split("_"))

    out = []
    for name, df in sorted(tables.items()):
        out.append({"kind": "class", "name": pascal(name), "domain": "", "range": ""})
        for f in df.schema:
            target = (foreign_keys or {}).get((name, f.name))
            base = re.sub(r"\(.*\)", "", f.dataType.simpleString())
            out.append({"kind": "object_property" if target else "datatype_property", "name": f.name, "domain": pascal(name), "range": pascal(target) if target else "xsd:" + XSD_TYPES.get(base, "string")})
    return out


def ontology_diff(old: list[dict], new: list[dict]) -> dict[str, list[str]]:
    """Entries that came and went."""
    key = lambda e: f"{e['kind']}:{e['domain']}:{e['name']}:{e['range']}"
    a, b = {key(e) for e in old}, {key(e) for e in new}
    return {"added": sorted(b - a), "removed": sorted(a - b)}


def normalise_result(df: DataFrame, json_col: str) -> DataFrame:
    """Id, name, type and text of a result by the names that they go under, flat or one level down."""

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(json_col, f"$.{w}{n}") for w in ("", "node.", "data.", "payload.") for n in names])

    fields = [pick("id", "node_id", "uuid").alias("id"), pick("name", "title", "label").alias("name"), F.coalesce(pick("type", "kind", "category"), F.lit("unknown")).alias("type"), pick("text", "chunk_text", "content", "description").alias("text")]
    return df.select(*[c for c in df.columns if c != json_col], *fields)
