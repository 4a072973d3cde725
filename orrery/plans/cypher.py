"""A reading subset of Cypher over nodes(id, labels, properties...) and edges(src, dst, relation).

MATCH of one path of node and relationship patterns, WHERE with comparisons, CONTAINS, STARTS WITH, IN, AND, OR and NOT,
RETURN of properties and count(*), DISTINCT, ORDER BY, SKIP, LIMIT. A path is a chain of equi-joins, which Catalyst orders.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.query_plane import guard_read_only, render

#: Ready queries by name; ${...} is filled by ``template``.
TEMPLATES = {
    "nodes_by_label": "MATCH (n:${label}) RETURN n.id ORDER BY n.id LIMIT ${limit}",
    "neighbours": "MATCH (n)-[r]->(m) WHERE n.id = ${id} RETURN m.id, r.relation ORDER BY m.id",
    "relation_counts": "MATCH (n)-[r]->(m) RETURN r.relation, count(*) ORDER BY r.relation",
    "label_search": "MATCH (n:${label}) WHERE n.name CONTAINS '${text}' RETURN n.id, n.name ORDER BY n.id LIMIT ${limit}",
    "two_hops": "MATCH (a)-[r]->(b)-[s]->(c) WHERE a.id = ${id} RETURN c.id ORDER BY c.id",
}
_CLAUSES = re.compile(r"(?is)^\s*MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<ret>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+SKIP\s+(?P<skip>\d+))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*$")
_NODE = re.compile(r"\(\s*(\w*)\s*(?::(\w+))?\s*\)")
_REL = re.compile(r"(<?)-\[\s*(\w*)\s*(?::(\w+))?\s*\]-(>?)")
_WORD = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<prop>\w+\.\w+)|(?P<op><>|<=|>=|=|<|>|\(|\)|\[|\]|,)|(?P<word>\w+))""")


def _where(text: str) -> Column:
    """Recursive descent: OR of ANDs of NOTs of comparisons."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"can't read at {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    i = 0

    def is_word(*words: str) -> bool:
        return all(i + k < len(tokens) and tokens[i + k][0] == "word" and tokens[i + k][1].upper() == w for k, w in enumerate(words))

    def literal() -> object:
        nonlocal i
        kind, value = tokens[i]
        i += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            return float(value) if "." in value else int(value)
        if kind == "word" and value.lower() in ("true", "false"):
            return value.lower() == "true"
        raise ValueError(f"not a value: {value}")

    def compare() -> Column:
        nonlocal i
        if tokens[i] == ("op", "("):
            i += 1
            out = either()
            if tokens[i] != ("op", ")"):
                raise ValueError(") is missing")
            i += 1
            return out
        kind, value = tokens[i]
        if kind != "prop":
            raise ValueError(f"not a property: {value}")
        i += 1
        left = F.col(value.replace(".", "__"))
        if is_word("CONTAINS"):
            i += 1
            return left.contains(literal())
        if is_word("STARTS", "WITH"):
            i += 2
            return left.startswith(literal())
        if is_word("IN"):
            i += 2
            values = []
            while tokens[i] != ("op", "]"):
                if tokens[i] == ("op", ","):
                    i += 1
                values.append(literal())
            i += 1
            return left.isin(values)
        op = tokens[i][1]
        i += 1
        if i < len(tokens) and tokens[i][0] == "prop":
            right = F.col(tokens[i][1].replace(".", "__"))
            i += 1
        else:
            right = F.lit(literal())
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]

    def negated() -> Column:
        nonlocal i
        if is_word("NOT"):
            i += 1
            return ~negated()
        return compare()

    def both() -> Column:
        nonlocal i
        out = negated()
        while is_word("AND"):
            i += 1
            out = out & negated()
        return out

    def either() -> Column:
        nonlocal i
        out = both()
        while is_word("OR"):
            i += 1
            out = out | both()
        return out

    result = either()
    if i != len(tokens):
        raise ValueError("something is left over")
    return result


def run(query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Run a query; result columns are named as they are returned, with _ for the dot, and ``count``."""
    guard_read_only(query, "cypher")
    m = _CLAUSES.match(query.strip().rstrip(";"))
    if not m:
        raise ValueError("not in the subset")
    pattern = m["match"].strip()
    first = _NODE.match(pattern)
    if not first:
        raise ValueError("a path begins with a node")

    def node(name: str, label: str | None) -> DataFrame:
        d = nodes if label is None else nodes.where(F.array_contains("labels", label))
        return d.select(*[F.col(c).alias(f"{name}__{c}") for c in nodes.columns])

    count = 0

    def named(given: str) -> str:
        nonlocal count
        count += 1
        return given or f"_{count}"

    here = named(first[1])
    out, at = node(here, first[2]), first.end()
    while at < len(pattern):
        rel = _REL.match(pattern, at)
        nxt = rel and _NODE.match(pattern, rel.end())
        if not nxt or (rel[1] and rel[4]):
            raise ValueError("not a path")
        r, there = named(rel[2]), named(nxt[1])
        e = edges if rel[3] is None else edges.where(F.col("relation") == rel[3])
        e = e.select(*[F.col(c).alias(f"{r}__{c}") for c in edges.columns])
        near, far = ("dst", "src") if rel[1] else ("src", "dst")
        if not rel[1] and not rel[4]:
            e = e.unionByName(e.select(*[F.col(f"{r}__{'dst' if c == 'src' else 'src' if c == 'dst' else c}").alias(f"{r}__{c}") for c in edges.columns]))
        out = out.join(e, F.col(f"{here}__id") == F.col(f"{r}__{near}")).join(node(there, nxt[2]), F.col(f"{r}__{far}") == F.col(f"{there}__id"))
        here, at = there, nxt.end()
    if m["where"]:
        out = out.where(_where(m["where"]))
    items = [x.strip() for x in m["ret"].split(",")]
    distinct = items[0].upper().startswith("DISTINCT ")
    items[0] = re.sub(r"(?i)^DISTINCT\s+", "", items[0])
    plain = [x for x in items if not re.fullmatch(r"(?i)count\(\s*\*?\w*\s*\)", x)]
    columns = [F.col(x.replace(".", "__")).alias(x.replace(".", "_")) for x in plain]
    out = out.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")) if len(plain) < len(items) else out.select(*columns)
    out = out.distinct() if distinct else out
    if m["order"]:
        keys = []
        for k in m["order"].split(","):
            name, _, way = k.strip().partition(" ")
            c = F.col("count" if name.lower().startswith("count") else name.replace(".", "_"))
            keys.append(c.desc() if way.strip().upper() == "DESC" else c.asc())
        out = out.orderBy(*keys)
    if m["skip"]:
        out = out.offset(int(m["skip"]))
    return out.limit(int(m["limit"])) if m["limit"] else out


def template(name: str, values: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A ready query with its values; values may hold only letters, digits, spaces and - _ . characters."""
    for v in values.values():
        if not re.fullmatch(r"[\w .\-]*", str(v)):
            raise ValueError(f"not a plain value: {v!r}")
    return run(render(TEMPLATES[name], values), nodes, edges)
