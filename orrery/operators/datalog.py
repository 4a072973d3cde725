"""Safe stratified Datalog with negation over DataFrames.

A predicate is one DataFrame of string columns t0, t1, ... Rule bodies become equi-joins on shared variables, negated
atoms left anti joins. Recursive strata run semi-naive: each round joins only the facts that the last one found, in
each recursive position in turn; rounds are cut to the checkpoint folder and fetch one emptiness test.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import cut

#: Rounds after which a union of what they found is written as one table.
ROUNDS = 8
ATOM = re.compile(r"^\s*(not\s+)?([A-Za-z_][\w:-]*)\s*\((.*)\)\s*$", re.S)


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    head: Atom
    body: tuple[Atom, ...]


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term[:1] == "_"


def constant(term: str) -> str:
    return term[1:-1] if len(term) > 1 and term[0] == term[-1] and term[0] in "'\"" else term


def _atom(text: str) -> Atom:
    m = ATOM.match(text)
    if not m:
        raise ValueError(f"not an atom: {text!r}")
    terms = tuple(t.strip() for t in re.findall(r"""'[^']*'|"[^"]*"|[^,]+""", m[3]) if t.strip())
    return Atom(m[2], terms, bool(m[1]))


def parse(program: str, ruleset: str = "ruleset") -> list[Rule]:
    """Rules ``head :- a, not b.``, one a line, # comments. Ids carry the line number. Unsafe rules are refused."""
    out = []
    for number, raw in enumerate(program.splitlines(), 1):
        line = raw.split("#")[0].strip()
        if not line:
            continue
        if not line.endswith(".") or ":-" not in line:
            raise ValueError(f"line {number} is no rule")
        head, body = line[:-1].split(":-", 1)
        atoms = tuple(_atom(p) for p in re.findall(r"(?:not\s+)?[A-Za-z_][\w:-]*\s*\([^)]*\)", body))
        rule = Rule(f"{ruleset}:rule-{number}", _atom(head), atoms)
        bound = {t for a in atoms if not a.negated for t in a.terms if is_variable(t)}
        loose = {t for a in (rule.head, *[a for a in atoms if a.negated]) for t in a.terms if is_variable(t)} - bound
        if loose or not atoms or rule.head.negated:
            raise ValueError(f"line {number} is unsafe: {sorted(loose)}")
        out.append(rule)
    return out


def stratify(rules: list[Rule]) -> dict[str, int]:
    """A stratum for each predicate; one more across negation; refuses cycles through negation."""
    level = {a.predicate: 0 for r in rules for a in (r.head, *r.body)}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            need = max((level[a.predicate] + a.negated for a in r.body), default=0)
            if level[r.head.predicate] < need:
                level[r.head.predicate], changed = need, True
        if not changed:
            return level
    raise ValueError("a cycle goes through negation")


def _bound(atom: Atom, facts: DataFrame) -> DataFrame:
    """Facts of an atom with a column for each variable: constants filter, repeated variables must be equal."""
    out, first = facts, {}
    for i, t in enumerate(atom.terms):
        if not is_variable(t):
            out = out.where(F.col(f"t{i}") == constant(t))
        elif t in first:
            out = out.where(F.col(f"t{i}") == F.col(f"t{first[t]}"))
        else:
            first[t] = i
    return out.select(*[F.col(f"t{i}").alias(f"v_{t}") for t, i in first.items()]) if first else out.select(F.lit(1).alias("v__any")).limit(1)


def connected_order(wanted: list[set[str]]) -> list[int]:
    """An order in which each set of variables meets those before it, where there is one; else as written."""
    out, left, seen = [], list(range(len(wanted))), set()
    while left:
        at = next((i for i in left if not out or wanted[i] & seen), left[0])
        left.remove(at)
        out.append(at)
        seen |= wanted[at]
    return out


def body_bindings(body: tuple[Atom, ...], relations: list[DataFrame]) -> DataFrame:
    """Bindings of the variables; relations are the facts of each atom.

    Atoms are joined in an order in which each shares a variable with those before it. Only a body whose parts share none
    has a product, which its rule asks for.
    """
    positive = [(a, r) for a, r in zip(body, relations, strict=True) if not a.negated]
    out = None
    for i in connected_order([{t for t in a.terms if is_variable(t)} for a, _ in positive]):
        b = _bound(*positive[i])
        if out is None:
            out = b
            continue
        on = sorted(set(out.columns) & set(b.columns))
        out = out.join(b, on) if on else out.join(b)
    for a, r in ((a, r) for a, r in zip(body, relations, strict=True) if a.negated):
        b = _bound(a, r).distinct()
        on = sorted(set(out.columns) & set(b.columns))
        out = out.join(b, on, "left_anti") if on else out.join(b.limit(1).withColumn("v__gone", F.lit(1)), how="left").where("v__gone is null").select(*out.columns)
    return out


def _head(rule: Rule, bindings: DataFrame) -> DataFrame:
    return bindings.select(*[(F.col(f"v_{t}") if is_variable(t) else F.lit(constant(t))).alias(f"t{i}") for i, t in enumerate(rule.head.terms)])


def empty(spark: SparkSession, arity: int) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"t{i} string" for i in range(arity)))


def infer(spark: SparkSession, program: str, facts: dict[str, DataFrame], proofs: bool = False) -> dict[str, DataFrame]:
    """All facts by predicate after the fixed point.

    With ``proofs`` each derived predicate has a rule_id column too: of the rules that first derive a fact (in the
    earliest round) the least id; null for asserted facts.
    """
    rules = parse(program)
    level = stratify(rules)
    arity = {a.predicate: len(a.terms) for r in rules for a in (r.head, *r.body)}
    known: dict[str, DataFrame] = {p: cut(d.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(d.columns)]).distinct()) for p, d in facts.items()}
    why: dict[str, DataFrame] = {}
    for p, n in arity.items():
        known.setdefault(p, empty(spark, n))
    for stratum in range(max(level.values(), default=0) + 1):
        active = [r for r in rules if level[r.head.predicate] == stratum]
        heads = {r.head.predicate for r in active}
        delta: dict[str, DataFrame] | None = None
        number = 0
        while active:
            number += 1
            found: dict[str, list[DataFrame]] = {}
            for r in active:
                recursive = [i for i, a in enumerate(r.body) if not a.negated and a.predicate in heads]
                if delta is None:
                    variants = [[known[a.predicate] for a in r.body]]
                else:
                    variants = [[delta[a.predicate] if j == i else known[a.predicate] for j, a in enumerate(r.body)] for i in recursive if r.body[i].predicate in delta]
                for relations in variants:
                    found.setdefault(r.head.predicate, []).append(_head(r, body_bindings(r.body, relations)).withColumn("rule_id", F.lit(r.rule_id)))
            fresh = {}
            for p, parts in found.items():
                keys = [f"t{i}" for i in range(arity[p])]
                new = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min("rule_id").alias("rule_id")).join(known[p], keys, "left_anti")
                new = cut(new)
                if not new.isEmpty():
                    fresh[p] = new
            if not fresh:
                break
            for p, new in fresh.items():
                known[p] = known[p].unionByName(new.drop("rule_id"))
                # The new facts are cut; their union with the others is only now and then.
                known[p] = cut(known[p]) if number % ROUNDS == 0 else known[p]
                why[p] = new if p not in why else why[p].unionByName(new)
            delta = {p: d.drop("rule_id") for p, d in fresh.items()}
            if not any(a.predicate in heads and not a.negated for r in active for a in r.body):
                break
    if not proofs:
        return known
    out = {}
    for p, d in known.items():
        keys = d.columns
        out[p] = d.join(why[p], keys, "left").select(*keys, "rule_id") if p in why else d.withColumn("rule_id", F.lit(None).cast("string"))
    return out


def extend(spark: SparkSession, program: str, known: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Facts that are closed under a program without negation, and new ones: (all facts, those that were not known).

    Semi-naive from the new facts on: a rule runs only with a new fact in one of its places.
    """
    rules = parse(program)
    if any(a.negated for r in rules for a in r.body):
        raise ValueError("with negation a new fact may undo old ones")
    arity = {a.predicate: len(a.terms) for r in rules for a in (r.head, *r.body)}
    known = {p: known.get(p, empty(spark, n)) for p, n in arity.items()}
    fresh = {p: empty(spark, n) for p, n in arity.items()}
    found = {p: d.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(d.columns)]).distinct() for p, d in new.items() if p in arity}
    while found:
        delta = {}
        for p, d in found.items():
            d = cut(d.join(known[p], [f"t{i}" for i in range(arity[p])], "left_anti"))
            if not d.isEmpty():
                delta[p] = d
                known[p], fresh[p] = cut(known[p].unionByName(d)), cut(fresh[p].unionByName(d))
        parts: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, a in enumerate(r.body):
                if a.predicate in delta:
                    relations = [delta[a.predicate] if j == i else known[b.predicate] for j, b in enumerate(r.body)]
                    parts.setdefault(r.head.predicate, []).append(_head(r, body_bindings(r.body, relations)))
        found = {p: reduce(DataFrame.unionByName, ds).distinct() for p, ds in parts.items()}
    return known, fresh


def fold(changes: DataFrame) -> DataFrame:
    """The facts that stand after all changes, by effective time and change id, whatever order they arrive in.

    changes(change_id, effective_at, op 'assert' or 'retract', predicate, t0, t1, ...). A change counts once.
    """
    terms = [c for c in changes.columns if re.fullmatch(r"t\d+", c)]
    key = ["predicate", *terms]
    # Within one change retractions win.
    last = changes.groupBy(*key).agg(F.max_by("op", F.struct("effective_at", "change_id", F.col("op") == "retract")).alias("op"))
    return last.where("op = 'assert'").select(*key)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts added and removed, with a change column."""
    return after.subtract(before).withColumn("change", F.lit("added")).unionByName(before.subtract(after).withColumn("change", F.lit("removed")))


def apply_overlay(baseline: DataFrame, assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    """(baseline + assertions) - retractions."""
    return baseline.unionByName(assertions).distinct().join(retractions.distinct(), baseline.columns, "left_anti")


def simulate(spark: SparkSession, program: str, facts: dict[str, DataFrame], assertions: dict[str, DataFrame], retractions: dict[str, DataFrame], outcome: str, blocking: str | None = None) -> tuple[DataFrame, bool]:
    """Outcome facts that a change would add or remove, and whether a blocking predicate would hold."""
    changed = dict(facts)
    for p in {*assertions, *retractions}:
        base = facts.get(p, next(d.limit(0) for d in (assertions.get(p), retractions.get(p)) if d is not None))
        changed[p] = apply_overlay(base, assertions.get(p, base.limit(0)), retractions.get(p, base.limit(0)))
    a, b = infer(spark, program, facts), infer(spark, program, changed)
    blocked = blocking is not None and not b[blocking].isEmpty()
    return delta(a[outcome], b[outcome]), blocked


def bind_rows(rows: DataFrame, bindings: list[tuple[str, list[str], str | None]]) -> dict[str, DataFrame]:
    """Facts from rows: (predicate, columns, column that must be positive or None)."""
    out = {}
    for predicate, columns, positive in bindings:
        d = rows if positive is None else rows.where(F.col(positive) > 0)
        out[predicate] = d.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(columns)]).distinct()
    return out


def latest_version(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Newest version of each rule set."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("__r = 1").drop("__r")
