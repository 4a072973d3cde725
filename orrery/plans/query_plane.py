"""The governed query plane: capabilities, policy, plans pinned by digest, federated steps, receipts (driver-side).

Data stays in lazy DataFrames; what lives here is metadata-sized.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.model import Release, digest, topological

CAPABILITIES = ("semantic_sql", "semantic_search", "graph_neighbourhood", "sparql", "reasoning", "template")
#: Findings that no waiver lifts.
NEVER_WAIVED = frozenset({"tenant_mismatch", "role_denied"})


class Registry:
    """Named entries without overwriting: executors, connectors, generators, views, graph backends, tasks."""

    def __init__(self) -> None:
        self._entries: dict[str, Any] = {}

    def register(self, name: str, entry: Any, replace: bool = False) -> None:
        if name in self._entries and not replace:
            raise ValueError(f"{name} is registered already")
        self._entries[name] = entry

    def get(self, name: str) -> Any:
        if name not in self._entries:
            raise KeyError(f"nothing is registered as {name}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def execute(self, name: str, *args: Any, **kwargs: Any) -> Any:
        return self.get(name)(*args, **kwargs)


@dataclass(frozen=True)
class Policy:
    """Who may ask what, for what, how much, and of which resources and fields."""

    roles: frozenset[str]
    purposes: frozenset[str]
    max_rows: int = 10_000
    allow: frozenset[str] | None = None
    deny: frozenset[str] = frozenset()
    fields: frozenset[str] | None = None
    waivers: frozenset[str] = frozenset()

    def evaluate(self, role: str, purpose: str, limit: int, resources: list[str], fields: list[str] = ()) -> dict[str, Any]:
        found = []
        if role not in self.roles:
            found.append("role_denied")
        if purpose not in self.purposes:
            found.append("purpose_denied")
        if limit > self.max_rows:
            found.append("limit_exceeded")
        found += [f"resource_denied:{r}" for r in sorted(resources) if r in self.deny or (self.allow is not None and r not in self.allow)]
        found += [f"field_denied:{f}" for f in sorted(fields) if self.fields is not None and f not in self.fields]
        kept = [f for f in found if f.split(":")[0] in NEVER_WAIVED or f.split(":")[0] not in self.waivers]
        return {"allowed": not kept, "findings": kept, "waived": [f for f in found if f not in kept]}


def allowed_purposes(grants: list[list[str]]) -> list[str]:
    """Purposes that every grant has."""
    return sorted(set.intersection(*map(set, grants))) if grants else []


@dataclass(frozen=True)
class Plan:
    capability: str
    release_digest: str
    request: dict[str, Any]
    policy: dict[str, Any]

    @property
    def digest(self) -> str:
        return digest({"capability": self.capability, "release": self.release_digest, "request": self.request, "policy": self.policy})


@dataclass
class QueryPlane:
    """Plans are made against one release, checked by policy, and run only under the digest that they were made with."""

    release: Release
    policy: Policy
    executors: Registry = field(default_factory=Registry)

    def plan(self, capability: str, request: dict[str, Any], role: str, purpose: str, limit: int, resources: list[str]) -> Plan:
        if capability not in CAPABILITIES:
            raise ValueError(f"unknown capability {capability}")
        closed = [r.resource_id for r in self.release.closure(resources)]
        verdict = self.policy.evaluate(role, purpose, limit, closed)
        if not verdict["allowed"]:
            raise PermissionError(", ".join(verdict["findings"]))
        return Plan(capability, self.release.digest, request | {"limit": limit, "resources": closed}, verdict)

    def execute(self, plan: Plan, pinned: str) -> DataFrame:
        """Run a plan whose digest is ``pinned``; one row more than the limit is asked for, so that a caller sees it."""
        if plan.digest != pinned or plan.release_digest != self.release.digest:
            raise ValueError("the plan is not the pinned one")
        return row_cap(self.executors.execute(plan.capability, plan), plan.request["limit"])

    def federated(self, steps: dict[str, dict[str, Any]]) -> dict[str, DataFrame]:
        """Steps {name: {capability, request, needs}} in topological order over this one release."""
        out: dict[str, DataFrame] = {}
        for name in topological({k: list(v.get("needs", [])) for k, v in steps.items()}):
            step = steps[name]
            inputs = {n: out[n] for n in step.get("needs", [])}
            out[name] = self.executors.execute(step["capability"], step["request"], inputs)
        return out


def row_cap(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` + 1 rows; ``check_cap`` refuses the extra one."""
    return df.limit(most + 1)


def check_cap(rows: list, most: int) -> list:
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


#: How a read-only query may begin, and words that may not stand as a clause of it.
READ_STARTS = {"sql": ("select", "with"), "sparql": ("select", "ask", "construct", "describe", "prefix", "base"), "cypher": ("match", "optional match", "return", "with", "unwind", "call")}
WRITE_WORDS = {
    "sql": ("insert", "update", "delete", "drop", "create", "alter", "merge", "truncate", "grant", "revoke", "attach", "pragma", "detach"),
    "sparql": ("insert", "delete", "load", "clear", "drop", "create", "add", "move", "copy"),
    "cypher": ("create", "delete", "detach", "set", "remove", "merge", "drop", "load", "foreach"),
}


def guard_read_only(text: str, language: str = "sql") -> str:
    """refuses what is not one balanced reading statement. Quoted strings and comments don't count.

    A word counts only as a clause: not as a function's name, a part of a dotted or quoted name, a prefix or a variable.
    """
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";").strip()
    low = re.sub(r"<[^>\s]*>", " ", bare.lower()) if language == "sparql" else bare.lower()
    if not low.startswith(READ_STARTS[language]):
        raise ValueError("not a reading query")
    if ";" in low and language != "sparql":
        raise ValueError("more than one statement")
    for a, b in ("()", "[]", "{}"):
        if low.count(a) != low.count(b):
            raise ValueError("brackets don't match")
    # Cypher writes MERGE (n); elsewhere a bracket after a word makes it a function.
    after = r"[.:,=<>+*/-]" if language == "cypher" else r"[(.:,=<>+*/-]"
    bad = [w for w in WRITE_WORDS[language] if re.search(rf"(?<![\w.?$:]){w}\b(?!\s*{after}|\s+(?:from|as|is|in|and|or|between|like)\b|\s*$)", low)]
    if bad:
        raise ValueError(f"not allowed: {bad}")
    return text


def guard_plan(spark: SparkSession, text: str) -> str:
    """F11 for SQL that Spark is to run: its parsed plan may hold no command and no write."""
    guard_read_only(text)
    jvm = spark.sparkContext._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            raise ValueError(f"not a reading plan: {node.nodeName()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return text


def render(template: str, values: dict[str, Any]) -> str:
    """Fill ${name}; a name without value, or one that stays, is an error."""
    names = re.findall(r"\$\{(\w+)\}", template)
    missing = sorted(set(names) - set(values))
    if missing:
        raise KeyError(f"no value for {missing}")
    out = re.sub(r"\$\{(\w+)\}", lambda m: str(values[m[1]]), template)
    if "${" in out:
        raise ValueError("unresolved placeholder")
    return out


def scoped(df: DataFrame, id_col: str, visible: list[str], fields: list[str]) -> DataFrame:
    """visible resources only, allowed fields only."""
    return df.where(F.col(id_col).isin(visible)).select(*[c for c in df.columns if c in fields])


def federated_evidence(parts: list[DataFrame]) -> DataFrame:
    """U8: evidence of all steps, once by id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["evidence_id"])
