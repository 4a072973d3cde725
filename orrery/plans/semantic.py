"""The metrics layer: a typed intent (metrics, dimensions, filters, limit) becomes one grouped DataFrame plan.

The plan is declarative: Catalyst prunes the scan to the columns in use and pushes the filters to it. ``compile_sql``
gives the same intent as parameterised text, with sorted filters and :p1, :p2, ... so that equal intents have equal text
and digest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.model import Release, Resource, digest, guard_identifier

#: Filter operators, their SQL, and aggregations.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in")
SQL_OPERATORS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
AGGREGATIONS = ("sum", "count", "avg", "min", "max", "count_distinct")


@dataclass(frozen=True)
class Filter:
    dimension: str
    operator: str
    value: Any

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")
        if self.operator == "in" and not (isinstance(self.value, (list, tuple)) and self.value):
            raise ValueError("in needs a list that is not empty")


@dataclass(frozen=True)
class Intent:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    limit: int | None = None

    def canonical(self) -> dict[str, Any]:
        filters = sorted(([f.dimension, f.operator, f.value] for f in self.filters), key=lambda f: (f[0], f[1], str(f[2])))
        return {"metrics": list(self.metrics), "dimensions": list(self.dimensions), "filters": filters, "limit": self.limit}


@dataclass(frozen=True)
class Compiled:
    dataset: str
    sql: str
    parameters: dict[str, Any]
    intent: Intent
    metrics: tuple[Resource, ...]
    dimensions: dict[str, Resource]

    @property
    def digest(self) -> str:
        return digest({"dataset": self.dataset, "sql": self.sql, "parameters": {k: str(v) for k, v in self.parameters.items()}})


def _alias(name: str) -> str:
    return guard_identifier(name.replace("-", "_"))


def _quoted(name: str) -> str:
    return ".".join(f'"{p}"' for p in guard_identifier(name).split("."))


def compile_intent(release: Release, intent: Intent) -> Compiled:
    """Resolve names against a release, check them, and fix the text. Exactly one dataset may be in use."""
    if not intent.metrics:
        raise ValueError("an intent needs a metric")
    named = {(r.kind, r.name): r for r in release.resources}
    metrics = []
    for m in intent.metrics:
        r = named.get(("Metric", m))
        if r is None:
            raise KeyError(f"no metric {m}")
        if r.spec["aggregation"] not in AGGREGATIONS or (r.spec["measure"] == "*" and r.spec["aggregation"] != "count"):
            raise ValueError(f"bad aggregation of {m}")
        metrics.append(r)
    wanted = {*intent.dimensions, *(f.dimension for f in intent.filters)}
    missing = sorted(d for d in wanted if ("Dimension", d) not in named)
    if missing:
        raise KeyError(f"no dimension {missing}")
    dims = {d: named["Dimension", d] for d in sorted(wanted)}
    datasets = {d for r in [*metrics, *dims.values()] for d in r.depends_on}
    if len(datasets) != 1:
        raise ValueError(f"exactly one dataset is needed, not {sorted(datasets)}")
    dataset = release.by_id()[datasets.pop()].spec["physical_name"]
    select = [f'{_quoted(dims[d].spec["field"])} AS {_quoted(dims[d].spec["field"])}' for d in intent.dimensions]
    for m in metrics:
        what = "*" if m.spec["measure"] == "*" else _quoted(m.spec["measure"])
        call = f"COUNT(DISTINCT {what})" if m.spec["aggregation"] == "count_distinct" else f'{m.spec["aggregation"].upper()}({what})'
        select.append(f'{call} AS "{_alias(m.name)}"')
    clauses, parameters = [], {}
    for dim, op, value in intent.canonical()["filters"]:
        column = _quoted(dims[dim].spec["field"])
        names = []
        for v in value if op == "in" else [value]:
            names.append(f":p{len(parameters) + 1}")
            parameters[names[-1][1:]] = v
        clauses.append(f'{column} IN ({", ".join(names)})' if op == "in" else f"{column} {SQL_OPERATORS[op]} {names[0]}")
    keys = ", ".join(_quoted(dims[d].spec["field"]) for d in intent.dimensions)
    sql = f'SELECT {", ".join(select)} FROM {_quoted(dataset)}'
    sql += f' WHERE {" AND ".join(clauses)}' if clauses else ""
    sql += f" GROUP BY {keys} ORDER BY {keys}" if keys else ""
    sql += f" LIMIT {int(intent.limit)}" if intent.limit is not None else ""
    return Compiled(dataset, sql, parameters, intent, tuple(metrics), dims)


def predicate(column: Column, op: str, value: Any) -> Column:
    """F2 as a Column, which Catalyst can push to the scan."""
    if op == "in":
        return column.isin(list(value))
    return {"eq": column == value, "ne": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def aggregate(spec: dict[str, str]) -> Column:
    kind, measure = spec["aggregation"], spec["measure"]
    column = F.lit(1) if measure == "*" else F.col(measure)
    return {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[kind](column)


def run(compiled: Compiled, data: DataFrame, having: Column | None = None) -> DataFrame:
    """The plan of a compiled intent over its dataset."""
    intent = compiled.intent
    filters = [predicate(F.col(compiled.dimensions[f.dimension].spec["field"]), f.operator, f.value) for f in intent.filters]
    if filters:
        data = data.where(reduce(lambda a, b: a & b, filters))
    aggregates = [aggregate(m.spec).alias(_alias(m.name)) for m in compiled.metrics]
    keys = [compiled.dimensions[d].spec["field"] for d in intent.dimensions]
    out = data.groupBy(*keys).agg(*aggregates) if keys else data.agg(*aggregates)
    if having is not None:
        out = out.where(having)
    if keys:
        out = out.orderBy(*keys)
    return out if intent.limit is None else out.limit(intent.limit)


# --- beyond one dataset: declared relation bindings -------------------------------------------------------------------


@dataclass(frozen=True)
class Binding:
    """How the rows of two datasets meet: equal keys, optionally a range on the left column, or the last one before."""

    kind: str  # inner, left, left_semi, left_anti, range, as_of
    keys: tuple[tuple[str, str], ...]
    left_column: str = ""
    low: str = ""
    high: str = ""


def bind(left: DataFrame, right: DataFrame, b: Binding) -> DataFrame:
    """Join by a binding (J23). Key columns of the right side are dropped; both sides keep their other names."""
    marked = right.select(*[F.col(c).alias(f"__{c}") if c in {r for _, r in b.keys} else F.col(c) for c in right.columns])
    on = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"__{r}") for a, r in b.keys])
    drop = [f"__{r}" for _, r in b.keys]
    if b.kind in ("inner", "left", "left_semi", "left_anti"):
        return left.join(marked, on, b.kind).drop(*drop)
    if b.kind == "range":
        return left.join(marked, on & (F.col(b.left_column) >= F.col(b.low)) & (F.col(b.left_column) < F.col(b.high))).drop(*drop)
    if b.kind == "as_of":
        return as_of(left, right, [a for a, _ in b.keys], [r for _, r in b.keys], b.left_column, b.low)
    raise ValueError(f"unknown binding {b.kind}")


def as_of(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_time: str, right_time: str) -> DataFrame:
    """For each left row the right row of the same keys with the latest time not after its own, or nulls.

    One shuffle: both sides are stacked, and the last right row is carried forward in time order, so rows are not
    multiplied as they would be by a range join. Right times must be unique in their keys.
    """
    from pyspark.sql import Window

    values = [c for c in right.columns if c not in right_keys]
    a = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__r"))
    packed = F.struct(*[F.col(c) for c in values])
    keyed = [F.col(r).alias(k) for k, r in zip(left_keys, right_keys, strict=True)]
    b = right.select(*keyed, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), packed.alias("__r"))
    order = Window.partitionBy(*left_keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    stacked = a.drop("__r").unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__r", ignorenulls=True).over(order))
    rows = stacked.where("__side = 1")
    return rows.select(*left.columns, *[F.col(f"__last.{c}").alias(c if c not in left.columns else f"right_{c}") for c in values])
