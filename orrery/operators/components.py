"""Joins on keys that many rows may have, and connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum (combined map-side) and an equi-join of narrow rows, cut to the shared folder; links,
labels and components stay distributed. Rounds grow with the logarithm of the number of nodes of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut, tidy

#: Frequent keys hold at least 1/TRACKED of all rows, so there are at most TRACKED of them.
TRACKED = 4096
#: Places to which the neighbours of a node are dealt.
SALTS = 8


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, tracked: int = TRACKED) -> DataFrame:
    """rows joined with keyed, which has each key once, with the number of rows that have it in column ``count``.

    Keys with at least 1/tracked of all rows, so at most tracked of them, are broadcast; the rows of others are
    shuffled, and no key among these has many rows. Rows whose key is not in keyed go. Both are read twice.
    """
    total = F.broadcast(keyed.agg(F.sum(count).alias("all_rows")))
    marked = keyed.join(total).withColumn("is_hot", F.col(count) * tracked >= F.col("all_rows")).drop("all_rows")
    hot, cold = (marked.where(c).drop("is_hot", count) for c in ("is_hot", "NOT is_hot"))
    own = [c for c in keyed.columns if c not in (count, *keys)]
    out = [*rows.columns, *own]
    there = rows.join(F.broadcast(hot), keys).select(*out)
    return there.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).select(*out))


def _salted(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(b, m) of edges (a, b) and the minimum m of each a. A hub's rows are dealt to SALTS places, each of which has m."""
    at = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    dealt = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return at.join(dealt, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over undirected edges (a, b), given once each with a > b."""
    if large:
        # Every node links its larger neighbours to its smallest neighbour (itself included).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = _salted(both.where("b > a"), least)
    else:
        # Every node links its smaller neighbours and itself to the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = _salted(edges, least).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, tidied: bool = False) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (columns a and b, of one type with an order) can reach.

    Nodes without edges do not appear; null ends and loops are ignored. ``max_rounds`` is a guard against a fault, not
    a cut-off: if the rounds do not end by then, it raises. ``tidied``: each round's files go before the next.
    """
    now = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = cut(now)
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        # Stable when every node has one, smaller, neighbour and no hub is itself a leaf.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(state)
        if tidied:
            tidy(edges.sparkSession)
    raise RuntimeError("the components did not settle")
