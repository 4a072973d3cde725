"""RDF as DataFrames: reading, basic graph patterns, shapes, vocabularies.

triples(s, p, o, kind, datatype, lang): kind is iri, blank or literal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.graph import closure

#: Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = RDF + "type"
SCHEMA = "s string, p string, o string, kind string, datatype string, lang string"

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<type>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w-]+)
    |(?P<name>[\w-]*:[\w.-]*[\w-]|[\w-]*:)|(?P<word>[A-Za-z]+)|(?P<punct>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text)


def parse_turtle(text: str) -> list[tuple]:
    """A subset of Turtle, which has all of N-Triples: prefixes, ; and , lists, blank nodes in brackets, literals."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read at {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    prefixes, out, blanks, i = {}, [], 0, 0

    def expand(name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}")
        return prefixes[prefix] + local

    def node() -> tuple[str, str, str | None, str | None]:
        nonlocal i, blanks
        kind, value = tokens[i]
        i += 1
        if kind == "iri":
            return value[1:-1], "iri", None, None
        if kind == "name":
            return expand(value), "iri", None, None
        if kind == "blank":
            return value, "blank", None, None
        if kind == "num":
            return value, "literal", XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "decimal" if "e" not in value.lower() else "double"), None
        if kind in ("str", "long"):
            body = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                i += 1
                return body, "literal", None, tokens[i - 1][1][1:]
            if i < len(tokens) and tokens[i][0] == "type":
                i += 1
                return body, "literal", node()[0], None
            return body, "literal", XSD + "string", None
        if kind == "word" and value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        if (kind, value) == ("punct", "["):
            blanks += 1
            name = f"_:b{blanks}"
            if tokens[i] != ("punct", "]"):
                predicates(name)
            if tokens[i] != ("punct", "]"):
                raise ValueError("] is missing")
            i += 1
            return name, "blank", None, None
        raise ValueError(f"unexpected {value!r}")

    def predicates(subject: str) -> None:
        nonlocal i
        while True:
            if tokens[i] == ("word", "a"):
                i += 1
                p = TYPE
            else:
                p = node()[0]
            while True:
                out.append((subject, p, *node()))
                if tokens[i] != ("punct", ","):
                    break
                i += 1
            while tokens[i] == ("punct", ";"):
                i += 1
            if tokens[i] in (("punct", "."), ("punct", "]")):
                return

    while i < len(tokens):
        kind, value = tokens[i]
        if kind in ("lang", "word") and value.lower().lstrip("@") in ("prefix", "base"):
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
            i += 3
            if i < len(tokens) and tokens[i] == ("punct", "."):
                i += 1
            continue
        subject = node()[0]
        if tokens[i] != ("punct", "."):
            predicates(subject)
        i += 1
    return out


_XML_LANG, _XML_BASE = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"


def parse_rdf_xml(text: str) -> list[tuple]:
    """RDF/XML without containers and collections: node elements, property elements and attributes, literals."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    out, made, rdf = [], 0, "{" + RDF + "}"
    iri = lambda tag: tag[1:].replace("}", "")
    outer = root.get(_XML_BASE, "")
    literal = lambda s, p, value, kind, lang: out.append((s, p, value, "literal", kind or (None if lang else XSD + "string"), lang))

    def blank() -> str:
        nonlocal made
        made += 1
        return f"_:x{made}"

    def node(e: ElementTree.Element, lang: str | None) -> str:
        lang = e.get(_XML_LANG, lang)
        if (about := e.get(rdf + "about")) is not None:
            s = about if ":" in about else outer + about
        elif (name := e.get(rdf + "ID")) is not None:
            s = f"{outer}#{name}"
        else:
            s = "_:" + e.get(rdf + "nodeID") if e.get(rdf + "nodeID") else blank()
        if e.tag != rdf + "Description":
            out.append((s, TYPE, iri(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((rdf, "{http://www.w3.org/XML")):
                literal(s, iri(k), v, None, lang)
        for p in e:
            own = p.get(_XML_LANG, lang)
            if (target := p.get(rdf + "resource")) is not None:
                out.append((s, iri(p.tag), target if ":" in target else outer + target, "iri", None, None))
            elif p.get(rdf + "nodeID"):
                out.append((s, iri(p.tag), "_:" + p.get(rdf + "nodeID"), "blank", None, None))
            elif p.get(rdf + "parseType") == "Resource":
                o = blank()
                out.append((s, iri(p.tag), o, "blank", None, None))
                inner = ElementTree.Element(rdf + "Description", {rdf + "nodeID": o[2:]})
                inner.extend(list(p))
                node(inner, own)
            elif len(p):
                for child in p:
                    o = node(child, own)
                    out.append((s, iri(p.tag), o, "blank" if o.startswith("_:") else "iri", None, None))
            else:
                literal(s, iri(p.tag), p.text or "", p.get(rdf + "datatype"), None if p.get(rdf + "datatype") else own)
        return s

    if root.tag == rdf + "RDF":
        for e in root:
            node(e, root.get(_XML_LANG))
    else:
        node(root, None)
    return out


def parse_json_ld(text: str) -> list[tuple]:
    """JSON-LD with a context of its own: prefixes, terms (also {"@id", "@type"}), @vocab, @graph, nested nodes, lists of
    values, value objects. Remote contexts are refused."""
    data = json.loads(text)
    out, made = [], 0

    def blank() -> str:
        nonlocal made
        made += 1
        return f"_:j{made}"

    def expand(term: str, context: dict, key: bool) -> str | None:
        known = context.get(term)
        if key and known is not None:
            known = known.get("@id", term) if isinstance(known, dict) else known
            return expand(known, context, False) if known != term else known
        prefix, colon, rest = term.partition(":")
        if colon and not rest.startswith("//") and isinstance(context.get(prefix), str):
            return context[prefix] + rest
        if colon:
            return term
        return context["@vocab"] + term if key and "@vocab" in context else (None if key else term)

    def value(s: str, p: str, v: Any, context: dict, how: Any) -> None:
        if isinstance(v, list):
            for x in v:
                value(s, p, x, context, how)
        elif isinstance(v, dict) and "@value" in v:
            literal = v["@value"]
            kind = expand(v["@type"], context, True) or v["@type"] if "@type" in v else None if "@language" in v else None
            out.append((s, p, *scalar(literal, kind, v.get("@language"))))
        elif isinstance(v, dict) and "@list" in v:
            value(s, p, v["@list"], context, how)
        elif isinstance(v, dict):
            o = node(v, context)
            out.append((s, p, o, "blank" if o.startswith("_:") else "iri", None, None))
        elif v is not None and how == "@id":
            out.append((s, p, expand(v, context, False), "blank" if v.startswith("_:") else "iri", None, None))
        elif v is not None:
            out.append((s, p, *scalar(v, expand(how, context, True) or how if how else None, None)))

    def scalar(v: Any, kind: str | None, lang: str | None) -> tuple:
        if isinstance(v, bool):
            return str(v).lower(), "literal", kind or XSD + "boolean", None
        if isinstance(v, (int, float)):
            return json.dumps(v), "literal", kind or XSD + ("integer" if isinstance(v, int) else "double"), None
        return str(v), "literal", kind or (None if lang else XSD + "string"), lang

    def node(d: dict, context: dict) -> str:
        if "@context" in d:
            own = d["@context"] if isinstance(d["@context"], list) else [d["@context"]]
            for c in own:
                if not isinstance(c, dict):
                    raise ValueError("remote contexts are not read")
                context = context | c
        s = expand(d["@id"], context, False) if "@id" in d else blank()
        if "@graph" in d:
            for x in d["@graph"]:
                node(x, context)
        types = d.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            out.append((s, TYPE, expand(t, context, True) or t, "iri", None, None))
        for k, v in d.items():
            p = None if k.startswith("@") else expand(k, context, True)
            if p is not None:
                how = context.get(k)
                value(s, p, v, context, how.get("@type") if isinstance(how, dict) else None)
        return s

    for d in data if isinstance(data, list) else [data]:
        if not isinstance(d, dict):
            raise ValueError("not a JSON-LD document")
        node(d, {})
    return out


#: Tried in this order; Turtle has N-Triples, and what is read of N3.
FORMATS = {"turtle": parse_turtle, "xml": parse_rdf_xml, "json-ld": parse_json_ld}


def parse_any(text: str, format_: str | None = None) -> list[tuple]:
    """Triples of a text in the named format, or in the first that reads it."""
    if not text.strip():
        return []
    errors = []
    for name, parse in FORMATS.items():
        if format_ in (None, name):
            try:
                return parse(text)
            except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
                errors.append(f"{name}: {e}")
    raise ValueError("; ".join(errors) or f"unknown format {format_}")


def read_rdf(texts: DataFrame, text_col: str = "text", format_: str | None = None) -> DataFrame:
    """Triples of whole texts, one file a row; blank nodes get the file's number. A null text has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*(f"{x}_{n}" if isinstance(x, str) and x.startswith("_:") else x for x in t),) for n, text in zip(f["n"], f["text"], strict=True) for t in parse_any(text or "", format_)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "kind", "datatype", "lang"])

    return texts.select(F.xxhash64(text_col).alias("n"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def read_turtle(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return read_rdf(texts, text_col, "turtle")


def from_rows(df: DataFrame, subject: Column, base: str) -> DataFrame:
    """A triple for each non-null column of a table."""
    kinds = {"bigint": "integer", "int": "integer", "double": "double", "string": "string"}
    cells = F.array(*[F.struct(F.lit(base + f.name).alias("p"), F.col(f.name).cast("string").alias("o"), F.lit(XSD + kinds.get(f.dataType.simpleString(), "string")).alias("datatype")) for f in df.schema])
    out = df.select(subject.alias("s"), F.explode(cells).alias("c")).where("c.o is not null")
    return out.select("s", "c.p", "c.o", F.lit("literal").alias("kind"), "c.datatype", F.lit(None).cast("string").alias("lang"))


def to_property_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with label, type and properties; edges); ends of edges without triples of their own are nodes too."""
    plain = triples.where("kind = 'literal'").groupBy("s", "p").agg(F.min("o").alias("o")).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "o")))).alias("properties"))
    edges = triples.where(f"kind <> 'literal' and p <> '{TYPE}'").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("relation")).distinct()
    types = triples.where(f"p = '{TYPE}'").groupBy("s").agg(F.min("o").alias("type"))
    ids = triples.select("s").unionByName(edges.select(F.col("dst").alias("s"))).distinct()
    nodes = ids.join(plain, "s", "left").join(types, "s", "left")
    label = F.coalesce(F.col("properties")[RDFS + "label"], F.regexp_extract("s", r"([^/#]+)$", 1))
    return nodes.select(F.col("s").alias("id"), label.alias("label"), F.coalesce("type", F.lit("unknown")).alias("type"), "properties"), edges


# --- basic graph patterns ---------------------------------------------------------------------------------------------


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of ?variables: self-joins of the triples, each filtered by its constants first, in an order in which
    each pattern shares a variable with those before it (where there is one)."""
    from orrery.operators.datalog import connected_order

    out = None
    for i in connected_order([{t for t in p if t.startswith("?")} for p in patterns]):
        d, seen = triples, {}
        for column, term in zip(("s", "p", "o"), patterns[i], strict=True):
            if not term.startswith("?"):
                d = d.where(F.col(column) == term)
            elif term in seen:
                d = d.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        d = d.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])
        out = d if out is None else _meet(out, d)
    return out


def _meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    on = sorted(set(a.columns) & set(b.columns))
    return a.join(b, on, how) if on else a.join(b, how="cross" if how == "inner" else how)


def _closing(text: str, at: int, pair: str) -> int:
    """Where the bracket that opens at ``at`` closes."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    raise ValueError("brackets don't match")


_TERM = r"""(\?\w+|<[^>]*>|"[^"]*"(?:@[\w-]+|\^\^\S+)?|[\w-]*:[\w.-]*\w|a|-?\d[\d.]*)"""
_AGGREGATE = re.compile(r"(?is)\(\s*(COUNT|SUM|MIN|MAX|AVG)\s*\(\s*(DISTINCT\s+)?(\*|\?\w+)\s*\)\s*AS\s+\?(\w+)\s*\)")


@dataclass
class _Sparql:
    triples: DataFrame
    prefixes: dict[str, str]

    def term(self, t: str) -> str:
        if t.startswith("?"):
            return t
        if t == "a":
            return TYPE
        if t.startswith("<"):
            return t[1:-1]
        if t[:1] in "\"'":
            return t[1 : t.rindex(t[0])]
        prefix, _, local = t.partition(":")
        return self.prefixes[prefix] + local if prefix in self.prefixes else t

    def patterns(self, block: str) -> list[tuple[str, str, str]]:
        """Triples between dots; ; and , go on with the last subject, or subject and predicate."""
        out, terms = [], re.findall(_TERM + r"|([.;,])", block)
        held: list[str] = []
        for term, mark in [*terms, ("", ".")]:
            if term:
                held.append(self.term(term))
                continue
            if len(held) == 3:
                out.append(tuple(held))
            elif held:
                raise ValueError(f"not in the subset: {' '.join(held)}")
            held = held[: {".": 0, ";": 1, ",": 2}[mark]]
        return out

    def solve(self, body: str) -> DataFrame:
        """Bindings of a group: patterns, { } UNION { }, OPTIONAL { }, FILTER( )."""
        plain, unions, optional, filters, i = "", [], [], [], 0
        while i < len(body):
            if m := re.match(r"(?is)OPTIONAL\s*(?=\{)", body[i:]):
                end = _closing(body, i + m.end(), "{}")
                optional.append(body[i + m.end() + 1 : end])
            elif m := re.match(r"(?is)FILTER\s*(?:regex\s*)?(?=\()", body[i:]):
                end = _closing(body, i + m.end(), "()")
                inner = body[i + m.end() + 1 : end]
                filters.append(f"regex({inner})" if "regex" in m[0].lower() else inner)
            elif body[i] == "{":
                end = _closing(body, i, "{}")
                unions.append([body[i + 1 : end]])
                while m := re.match(r"(?is)\s*UNION\s*(?=\{)", body[end + 1 :]):
                    at = end + 1 + m.end()
                    end = _closing(body, at, "{}")
                    unions[-1].append(body[at + 1 : end])
            else:
                quoted = re.match(r'<[^>\s]*>|"[^"]*"', body[i:])
                plain += quoted[0] if quoted else body[i]
                i += len(quoted[0]) if quoted else 1
                continue
            i = end + 1
            plain += " . "
        found = self.patterns(plain)
        out = bgp(self.triples, found) if found else None
        for parts in unions:
            d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.solve(p) for p in parts])
            out = d if out is None else _meet(out, d)
        if out is None:
            raise ValueError("an empty group")
        for block in optional:
            out = _meet(out, self.solve(block), "left")
        for f in filters:
            out = out.where(self.test(f))
        return out

    def test(self, f: str) -> Column:
        if r := re.match(r'(?is)\s*regex\s*\(\s*(?:str\()?\?(\w+)\)?\s*,\s*"([^"]*)"\s*(?:,\s*"(\w*)")?\s*\)', f):
            return F.col(r[1]).rlike(("(?i)" if "i" in (r[3] or "") else "") + r[2])
        r = re.match(r"""\s*\?(\w+)\s*(=|!=|<=|>=|<|>)\s*("[^"]*"|<[^>]*>|-?[\d.]+|\?\w+|[\w-]*:[\w-]+)\s*$""", f)
        if not r:
            raise ValueError(f"not in the subset: FILTER({f})")
        number = re.fullmatch(r"-?[\d.]+", r[3])
        left = F.expr(f"try_cast(`{r[1]}` as double)") if number else F.col(r[1])
        right = F.lit(float(r[3])) if number else F.col(r[3][1:]) if r[3].startswith("?") else F.lit(self.term(r[3]))
        return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[r[2]]


def sparql(triples: DataFrame, query: str) -> DataFrame:
    """D11, subset: SELECT, ASK, CONSTRUCT and DESCRIBE over groups of patterns, UNION, OPTIONAL and FILTER, with aggregates,
    GROUP BY, ORDER BY, LIMIT and OFFSET.

    SELECT gives a column a variable, ASK one row ``answer``; CONSTRUCT and DESCRIBE give distinct triples (s, p, o). An
    aggregate over numbers takes literals as doubles.
    """
    from orrery.plans.query_plane import guard_read_only

    guard_read_only(query, "sparql")
    run = _Sparql(triples, dict(re.findall(r"(?i)PREFIX\s+(\w*):\s*<([^>]*)>", query)))
    text = re.sub(r"(?is)^\s*(?:PREFIX\s+\w*:\s*<[^>]*>\s*)*", "", query)
    form = text.split(None, 1)[0].upper().rstrip("{")
    template = None
    if form == "CONSTRUCT":
        start = text.index("{")
        end = _closing(text, start, "{}")
        template, text = run.patterns(text[start + 1 : end]), text[end + 1 :]
    if "{" not in text and form == "DESCRIBE":
        return _described(triples, [run.term(t) for t in re.findall(r"<[^>]*>|[\w-]*:[\w-]+", text)], None)
    start = text.index("{")
    end = _closing(text, start, "{}")
    head, body, tail = text[:start], text[start + 1 : end], text[end + 1 :]
    out = run.solve(body)
    if form == "ASK":
        return out.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    if form == "CONSTRUCT":
        cell = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
        rows = [out.select(*[cell(t).alias(c) for c, t in zip("spo", p, strict=True)]) for p in template]
        return reduce(DataFrame.unionByName, rows).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    if form == "DESCRIBE":
        names = re.findall(r"\?(\w+)", head)
        return _described(triples, [run.term(t) for t in re.findall(r"<[^>]*>", head)], out.select(F.explode(F.array(*names)).alias("s")) if names else None)
    grouped = re.search(r"(?is)GROUP\s+BY\s+((?:\?\w+\s*)+)", tail)
    wanted = _AGGREGATE.findall(head)
    names = re.findall(r"\?(\w+)", _AGGREGATE.sub(" ", head))
    if wanted:
        number = lambda v: F.expr(f"try_cast(`{v[1:]}` as double)")
        plain = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}

        def aggregate(kind: str, distinct: str, v: str) -> Column:
            if kind.upper() != "COUNT":
                return plain[kind.upper()](number(v))
            return F.count(F.lit(1)) if v == "*" else F.count_distinct(F.col(v[1:])) if distinct else F.count(F.col(v[1:]))

        keys = re.findall(r"\?(\w+)", grouped[1]) if grouped else []
        out = out.groupBy(*keys).agg(*[aggregate(k, d, v).alias(n) for k, d, v, n in wanted]).select(*names, *[n for *_, n in wanted])
    else:
        out = out.select(*names) if names else out
    out = out.distinct() if re.match(r"(?is)\s*SELECT\s+DISTINCT", head) else out
    if m := re.search(r"(?is)ORDER\s+BY\s+((?:(?:ASC|DESC)?\s*\(?\s*\?\w+\s*\)?\s*)+)", tail):
        out = out.orderBy(*[F.desc(n) if d.upper() == "DESC" else F.asc(n) for d, n in re.findall(r"(?i)(ASC|DESC)?\s*\(?\s*\?(\w+)", m[1])])
    if m := re.search(r"(?i)OFFSET\s+(\d+)", tail):
        out = out.offset(int(m[1]))
    m = re.search(r"(?i)LIMIT\s+(\d+)", tail)
    return out.limit(int(m[1])) if m else out


def _described(triples: DataFrame, named: list[str], bound: DataFrame | None) -> DataFrame:
    """All triples of the resources that are named or bound."""
    own = triples.select("s", "p", "o")
    parts = [own.where(F.col("s").isin(named))] if named else []
    if bound is not None:
        parts.append(own.join(bound.distinct(), "s", "left_semi"))
    return reduce(DataFrame.unionByName, parts).distinct()


# --- shapes -----------------------------------------------------------------------------------------------------------


@dataclass
class PropertyShape:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    cls: str | None = None
    node_kind: str | None = None
    allowed: list[str] | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None


@dataclass
class Shape:
    name: str
    target_class: str | None = None
    target_node: str | None = None
    subjects_of: str | None = None
    objects_of: str | None = None
    properties: list[PropertyShape] = field(default_factory=list)


def instances(triples: DataFrame, cls: str) -> DataFrame:
    """Ids of a class or any of its subclasses."""
    sub = triples.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    below = closure(sub).where(F.col("dst") == cls).select(F.col("src").alias("o"))
    below = below.unionByName(triples.sparkSession.range(1).select(F.lit(cls).alias("o"))).distinct()
    return triples.where(F.col("p") == TYPE).join(below, "o", "left_semi").select(F.col("s").alias("id")).distinct()


def targets(triples: DataFrame, shape: Shape) -> DataFrame:
    """D12."""
    parts = []
    if shape.target_class:
        parts.append(instances(triples, shape.target_class))
    if shape.target_node:
        parts.append(triples.sparkSession.range(1).select(F.lit(shape.target_node).alias("id")))
    if shape.subjects_of:
        parts.append(triples.where(F.col("p") == shape.subjects_of).select(F.col("s").alias("id")))
    if shape.objects_of:
        parts.append(triples.where(F.col("p") == shape.objects_of).select(F.col("o").alias("id")))
    return reduce(DataFrame.unionByName, parts).distinct()


def validate(triples: DataFrame, shape: Shape) -> DataFrame:
    """(focus, path, component) of every violation: one aggregate for counts, one filter for values, a property."""
    focus, out = targets(triples, shape), []
    for p in shape.properties:
        values = triples.where(F.col("p") == p.path).select(F.col("s").alias("id"), "o", "kind", "datatype")
        joined = focus.join(values, "id", "left")
        counts = joined.groupBy("id").agg(F.count("o").alias("n"))
        number = F.expr("try_cast(o as double)")
        tests = [
            ("datatype", p.datatype, ~F.coalesce(F.col("datatype") == p.datatype, F.lit(False))),
            ("nodeKind", p.node_kind, F.col("kind") != (p.node_kind or "")),
            ("in", p.allowed, ~F.col("o").isin(p.allowed or [""])),
            ("minInclusive", p.min_inclusive, F.coalesce(number < (p.min_inclusive or 0.0), F.lit(True))),
            ("maxInclusive", p.max_inclusive, F.coalesce(number > (p.max_inclusive or 0.0), F.lit(True))),
            ("minLength", p.min_length, F.length("o") < (p.min_length or 0)),
            ("maxLength", p.max_length, F.length("o") > (p.max_length or 0)),
            ("pattern", p.pattern, ~F.col("o").rlike(p.pattern or "")),
        ]
        found = [F.when(bad, name) for name, wanted, bad in tests if wanted is not None]
        if p.min_count is not None:
            out.append(counts.where(F.col("n") < p.min_count).select("id", F.lit("minCount").alias("component"), F.lit(p.path).alias("path")))
        if p.max_count is not None:
            out.append(counts.where(F.col("n") > p.max_count).select("id", F.lit("maxCount").alias("component"), F.lit(p.path).alias("path")))
        if found:
            bad = joined.where("o is not null").select("id", F.explode(F.array_compact(F.array(*found))).alias("component"))
            out.append(bad.select("id", "component", F.lit(p.path).alias("path")))
        if p.cls is not None:
            strangers = joined.where("o is not null").select("id", "o").join(instances(triples, p.cls).withColumnRenamed("id", "o"), "o", "left_anti")
            out.append(strangers.select("id", F.lit("class").alias("component"), F.lit(p.path).alias("path")))
    return reduce(DataFrame.unionByName, out).select(F.col("id").alias("focus"), "path", "component")


def disjoint_conflicts(triples: DataFrame) -> DataFrame:
    """Ids with types of two disjoint classes."""
    pairs = triples.where(F.col("p") == OWL + "disjointWith").select(F.col("s").alias("left"), F.col("o").alias("right"))
    types = triples.where(F.col("p") == TYPE).select("s", "o").distinct()
    a = types.select("s", F.col("o").alias("left")).join(pairs, "left")
    return a.join(types.select("s", F.col("o").alias("right")), ["s", "right"]).select(F.col("s").alias("id"), "left", "right").distinct()


def functional_conflicts(triples: DataFrame, properties: list[str]) -> DataFrame:
    """Functional properties with more than one value."""
    return triples.where(F.col("p").isin(properties)).groupBy("s", "p").agg(F.count_distinct("o").alias("n")).where("n > 1")


def skos_findings(triples: DataFrame) -> DataFrame:
    """Repeated preferred labels of a language, self-broader, deprecated without replacement, broader cycles."""
    labels = triples.where(F.col("p") == SKOS + "prefLabel").groupBy("s", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count_distinct("o").alias("n")).where("n > 1")
    broader = triples.where(F.col("p") == SKOS + "broader").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    gone = triples.where((F.col("p") == OWL + "deprecated") & (F.col("o") == "true")).select("s").distinct()
    replaced = triples.where(F.col("p").endswith("isReplacedBy")).select("s")
    mark = lambda d, c, text: d.select(F.col(c).alias("id"), F.lit(text).alias("finding"))
    parts = [mark(labels, "s", "duplicate_pref_label"), mark(broader.where("src = dst"), "src", "self_broader"), mark(gone.join(replaced, "s", "left_anti"), "s", "deprecated_without_replacement"), mark(closure(broader.where("src <> dst")).where("src = dst"), "src", "broader_cycle")]
    return reduce(DataFrame.unionByName, parts).distinct()


# --- bundles ----------------------------------------------------------------------------------------------------------


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (source, target) to no page, with or without .md."""
    known = pages.select(F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.md$", "")))).alias("target")).distinct()
    return links.join(known, "target", "left_anti").select("source", "target")


def bundle_duplicates(pages: DataFrame) -> DataFrame:
    """Pages of one (type, title), or one content, as others."""
    by_title = pages.groupBy("type", "title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("title").alias("kind"), F.concat_ws(":", "type", "title").alias("key"), "n")
    by_text = pages.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("content").alias("kind"), F.col("h").alias("key"), "n")
    return by_title.unionByName(by_text)


def unique_title_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """K1: links by title resolve if exactly one page has it, and that is another one; others are counted as ambiguous."""
    titles = pages.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    j = links.join(titles, links["target"] == titles["title"]).where("source <> path or n > 1")
    return j.select("source", "target", F.when(F.col("n") == 1, F.col("path")).alias("path"), (F.col("n") > 1).alias("ambiguous"))


def property_conflicts(claims: DataFrame) -> DataFrame:
    """(entity, property) with more than one value."""
    return claims.groupBy("entity", "property").agg(F.count_distinct("value").alias("n")).where("n > 1")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
