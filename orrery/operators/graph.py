"""Property-graph operators over edges(src, dst[, relation]) and nodes(id, ...).

Loops run on the driver but fetch only counts; each round's state is cut to the checkpoint folder. Ids may be of any
orderable type. Rounds whose state comes from joins with itself store it: a checkpoint keeps the size that Spark estimated
for its plan, each join multiplies the sizes of its sides, and after a few rounds the numbers alone fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.session import cut, store

#: Rounds after which a union of what they found is written as one table.
ROUNDS = 8


def degrees(edges: DataFrame) -> DataFrame:
    """G1: in, out and total degree of every node with an edge, in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N, m, directed density, mean, least and largest degree, weak components; one row."""
    d = nodes.select("id").join(degrees(edges).select("id", "degree"), "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    n = d.agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    comps = weak_components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    return n.join(m).join(comps).select("n", "m", (F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"), "avg_degree", "min_degree", "max_degree", "components")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each weak component.

    Large-star and small-star rounds, logarithmic in a component's size; narrow rows only.
    """
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, k: int | None = None, block: int = 5) -> DataFrame:
    """PageRank with dangling mass spread over all nodes; stops at an L1 change below n * tolerance in a round.

    The solution is y = damping * A y + 1, brought to sum 1: spreading the dangling mass only scales the constant. So
    a round is one join and one grouped sum, without a global sum, and ``block`` rounds make one plan.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("w"))
    links = cut(edges.join(out, "src").select("src", "dst", (damping / F.col("w")).alias("share")))
    ids = cut(nodes.select("id"))
    state = ids.withColumn("y", F.lit(1.0))
    for done in range(0, rounds, block):
        for _ in range(min(block, rounds - done)):
            ranks = state.select(F.col("id").alias("src"), F.col("y").alias("from"))
            got = links.join(ranks, "src").groupBy("dst").agg(F.sum(F.col("from") * F.col("share")).alias("got"))
            state = state.select("id", F.col("y").alias("old")).join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", (1 + F.coalesce("got", F.lit(0.0))).alias("y"), "old")
        state = cut(state)
        s = state.agg(F.sum("y").alias("y"), F.sum("old").alias("old")).first()
        moved = state.agg(F.sum(F.abs(F.col("y") / s["y"] - F.col("old") / s["old"]))).first()[0]
        if moved < n * tolerance:
            break
        state = state.drop("old")
    out = state.select("id", (F.col("y") / s["y"]).alias("rank")).orderBy(F.desc("rank"), "id")
    return out if k is None else out.limit(k)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree / (n - 1)."""
    total = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    d = nodes.select("id").join(degrees(edges).select("id", "degree"), "id", "left")
    return d.join(total).select("id", F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): breadth-first hops from each id in ``sources`` (column id), all roots at once."""
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(sources.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = front.join(e, front["id"] == e["src"]).select("root", F.col("dst").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        front = cut(nxt.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        # The front is cut; its union with the others is only now and then.
        seen = cut(seen.unionByName(front)) if depth % ROUNDS == 0 else seen.unionByName(front)
    return seen


def closeness(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """In-distance closeness of ``targets`` with the Wasserman-Faust factor.

    It holds a row for each target and node that reaches it, so ``targets`` should be few on a large connected graph.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    total = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    reach = distances(back, targets).groupBy("root").agg(F.sum("depth").alias("sum"), (F.count(F.lit(1)) - 1).alias("r"))
    score = F.when((F.col("sum") > 0) & (F.col("n") > 1), F.col("r") / F.col("sum") * F.col("r") / (F.col("n") - 1)).otherwise(0.0)
    return reach.join(total).select(F.col("root").alias("id"), score.alias("closeness"))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 100) -> DataFrame:
    """Brandes' dependencies summed over the first ``pivots`` ids by hash (all, if there are no more), scaled to all
    and by 1 / ((n - 1)(n - 2)). Layers of all pivots advance together, so a round is one join."""
    n = nodes.count()
    roots = nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots)
    k = min(pivots, n)
    d = cut(distances(edges, roots))
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    a, b = d.select("root", F.col("id").alias("src"), F.col("depth").alias("d")), d.select("root", F.col("id").alias("dst"), F.col("depth").alias("e"))
    tree = cut(a.join(e, "src").join(b, ["root", "dst"]).where("e = d + 1").select("root", "src", "dst", "e"))
    last = d.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    sigma = cut(d.where("depth = 0").select("root", "id", F.lit(1.0).alias("sigma")))
    for layer in range(1, last + 1):
        step = tree.where(F.col("e") == layer).join(sigma.withColumnRenamed("id", "src"), ["root", "src"])
        sigma = cut(sigma.unionByName(step.groupBy("root", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))))
    delta = cut(d.where(F.col("depth") == last).select("root", "id", F.lit(0.0).alias("delta")))
    for layer in range(last, 0, -1):
        part = tree.where(F.col("e") == layer)
        part = part.join(sigma.select("root", F.col("id").alias("src"), F.col("sigma").alias("s")), ["root", "src"])
        part = part.join(sigma.select("root", F.col("id").alias("dst"), F.col("sigma").alias("t")), ["root", "dst"])
        part = part.join(delta.select("root", F.col("id").alias("dst"), "delta"), ["root", "dst"])
        got = part.groupBy("root", F.col("src").alias("id")).agg(F.sum(F.col("s") / F.col("t") * (1 + F.col("delta"))).alias("delta"))
        upper = d.where(F.col("depth") == layer - 1).select("root", "id").join(got, ["root", "id"], "left").select("root", "id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = cut(delta.unionByName(upper))
    scale = (n / k if k else 0.0) / max(1, (n - 1) * (n - 2))
    total = delta.where("root <> id").groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.select("id").join(total, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6, block: int = 4) -> DataFrame:
    """Power iteration on in-edges (with the vector itself added, which only shifts the spectrum), length 1."""
    n = nodes.count()
    x = cut(nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("x")))
    e = cut(edges.select("src", "dst"))
    for _ in range(0, rounds, block):
        state = x.select("id", F.col("x").alias("y"))
        for _ in range(block):
            got = e.join(state.select(F.col("id").alias("src"), "y"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("y").alias("got"))
            state = state.select("id", F.col("y").alias("old")).join(got, "id", "left").select("id", "old", (F.col("old") + F.coalesce("got", F.lit(0.0))).alias("y"))
        state = cut(state)
        s = state.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("y"), F.sqrt(F.sum(F.col("old") * F.col("old"))).alias("old")).first()
        y, old = s["y"] or 1.0, s["old"] or 1.0
        moved = state.agg(F.sum(F.abs(F.col("y") / y - F.col("old") / old))).first()[0] or 0.0
        x = state.select("id", (F.col("y") / y).alias("x"))
        if moved < n * tolerance:
            break
    return x.select("id", F.col("x").alias("eigenvector"))


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """One row: path (array of ids) and exists. Of equal paths, the least by ids at each step back."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    e = cut(edges.select("src", "dst").distinct())
    known = e.where((F.col("src") == F.lit(source)) | (F.col("dst") == F.lit(source))).limit(1).count() > 0
    front = cut(spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path")).where(F.lit(known)))
    seen = front.select("id")
    while not front.isEmpty():
        hit = front.where(F.col("id") == F.lit(target)).limit(1).collect()
        if hit:
            return spark.createDataFrame([(hit[0]["path"], True)], f"path array<{kind}>, exists boolean")
        step = front.join(e, front["id"] == e["src"]).join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        front = cut(step.groupBy("dst").agg(F.min("path").alias("p")).select(F.col("dst").alias("id"), F.concat("p", F.array("dst")).alias("path")))
        seen = cut(seen.unionByName(front.select("id")))
    return spark.createDataFrame([(None, False)], f"path array<{kind}>, exists boolean")


def all_paths(edges: DataFrame, source, target, max_depth: int = 5) -> DataFrame:
    """Simple paths of at most ``max_depth`` edges (path array), each once."""
    e = edges.select("src", "dst").distinct()
    paths = e.where(F.col("src") == F.lit(source)).select(F.array("src", "dst").alias("path"))
    done = None
    for _ in range(max_depth):
        hit = paths.where(F.element_at("path", -1) == F.lit(target))
        done = hit if done is None else done.unionByName(hit)
        on = paths.where(F.element_at("path", -1) != F.lit(target)).select("path", F.element_at("path", -1).alias("src")).join(e, "src")
        paths = cut(on.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
    return done.dropDuplicates(["path"])


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): every node that src reaches by at least one edge, with the least depth. Semi-naive.

    The result has a row for each pair, so it can grow with the square of a connected part.
    """
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(e.withColumn("depth", F.lit(1)))
    front, depth = seen, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        # The front is cut; its union with the others is only now and then.
        seen = cut(seen.unionByName(front)) if depth % ROUNDS == 0 else seen.unionByName(front)
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """Ids that reach themselves."""
    return closure(edges).where("src = dst").select(F.col("src").alias("id"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """(root, id, depth) within 1..max_depth hops along, against or across the edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = {"out": edges.select("src", "dst"), "in": back, "both": edges.select("src", "dst").unionByName(back)}[direction]
    return distances(e, seeds, max_depth).where("depth > 0")


def incident(edges: DataFrame, node, direction: str = "both", relations: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Edges at a node, once each, in order of their text."""
    test = {"out": F.col("src") == F.lit(node), "in": F.col("dst") == F.lit(node), "both": (F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node))}[direction]
    out = edges.where(test)
    if relations:
        out = out.where(F.col("relation").isin(relations))
    return out.select("src", "relation", "dst").distinct().orderBy(F.col("src").cast("string"), "relation", F.col("dst").cast("string")).limit(limit)


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' nodes; edges without one fall out. nodes(id, label, type)."""
    s = nodes.select(F.col("id").alias("src"), F.col("label").alias("source"), F.col("type").alias("source_type"))
    d = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"), F.col("type").alias("target_type"))
    return edges.select("src", "dst", F.coalesce("relation", F.lit("related_to")).alias("relation")).join(s, "src").join(d, "dst")


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, mid, dst) of two edges that follow each other, without going straight back."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").where("src <> dst").select("src", "mid", "dst")


def induced(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges among the seeds and their neighbours."""
    s = seeds.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = s.unionByName(out).unionByName(into).distinct()
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected neighbours, once per pair and relation."""
    both = edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))
    return both.distinct()


def _undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; an edge that stands more than once counts as often."""
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Labels of which every node has one that is commonest around it.

    A node whose label is not takes the greatest of the commonest ones. Nodes move in turn, in two classes, so neighbours do
    not swap labels for ever: those that edges only leave, those that edges only reach, and of the others one half or the
    other by a hash of id and round. ``rounds`` is a guard: labels that are not settled by then are an error.
    """
    both = store(adjacency(edges.withColumn("relation", F.lit(""))).where("src <> dst").select("src", "dst"))
    ends = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("side")))).alias("e")).select("e.*")
    sides = ends.groupBy("id").agg(F.min("side").alias("low"), F.max("side").alias("high")).select("id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("side"))
    labels = store(nodes.select("id", F.col("id").alias("label")).join(sides, "id", "left"))
    for number in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", F.col("label").alias("new"))).alias("best"))
        own = labels.join(best, labels["id"] == best["src"], "left").join(votes.select(F.col("src").alias("id"), "label", F.col("n").alias("mine")), ["id", "label"], "left")
        now = store(own.select("id", "label", "side", F.col("best.new").alias("new"), (F.col("best.n") > F.coalesce("mine", F.lit(0))).alias("open")))
        if now.where("open").isEmpty():
            return now.select("id", "label")
        turn = F.coalesce("side", F.pmod(F.xxhash64(F.lit(number), "id"), F.lit(2)).cast("int")) == number % 2
        labels = now.select("id", F.when(F.coalesce(F.col("open"), F.lit(False)) & turn, F.col("new")).otherwise(F.col("label")).alias("label"), "side")
    raise RuntimeError("the labels did not settle")


def _coarse(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links(src, dst, w) between labels; a label's inner weight stands in both directions, as (c, c)."""
    j = links.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return j.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def _quality(links: DataFrame, labels: DataFrame, total: float, resolution: float) -> float:
    c = _coarse(links, labels)
    inner = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))).alias("inner")
    by = c.groupBy("src").agg(F.sum("w").alias("k"), inner)
    return by.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / total - resolution * F.pow(F.col("k") / total, 2))).first()[0] or 0.0


def _moved(links: DataFrame, state: DataFrame, total: float, resolution: float, number: int) -> DataFrame:
    """state (id, label, k: a node's weight) after those of one half of the nodes (by a hash of id and number) moved that
    gain by it."""
    volume = state.groupBy("label").agg(F.sum("k").alias("v"))
    mine = state.join(volume, "label")
    into = links.where("src <> dst").join(state.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    both = into.join(volume.select(F.col("label").alias("to"), F.col("v").alias("other")), "to").join(mine, "id")
    # A node's own weight does not count against its own community.
    own = F.col("to") == F.col("label")
    gain = both.select("id", "to", own.alias("own"), "k", "v", (F.col("w") - resolution * F.col("k") * (F.col("other") - F.when(own, F.col("k")).otherwise(0.0)) / total).alias("g"))
    # A node none of whose neighbours is in its community gains that community's weight without it.
    alone = -resolution * F.first("k") * (F.first("v") - F.first("k")) / total
    choice = gain.groupBy("id").agg(F.max(F.struct("g", "to")).alias("best"), F.coalesce(F.max(F.when(F.col("own"), F.col("g"))), alone).alias("stay"))
    moves = choice.where((F.col("best.g") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64(F.lit(number), "id"), F.lit(2)) == 0)).select("id", F.col("best.to").alias("new"))
    return state.join(moves, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "k")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-7, rounds: int = 100) -> DataFrame:
    """(id, label): communities by Louvain's method. Local moves until modularity grows by less than ``tolerance``,
    then communities become nodes and it begins again, until nothing moves.

    In a round first one half of the nodes (by a hash of id and round), then another, moves to the neighbouring community of
    the largest gain, if it is a gain; a round that gains no modularity, as moves are made at once, is taken back.
    """
    links = store(_undirected(edges))
    whole = store(nodes.select("id", F.col("id").alias("label")))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return whole
    best = _quality(links, whole, total, resolution)
    while True:
        labels = store(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("label"), "k"))
        start, misses = best, 0
        for number in range(0, 2 * rounds, 2):
            tried = labels
            for half in (number, number + 1):
                tried = store(_moved(links, tried, total, resolution, half))
            now = _quality(links, tried, total, resolution)
            if now > best + tolerance:
                labels, best, misses = tried, now, 0
            else:
                misses += 1
                if misses == 2:  # with other halves too
                    break
        if best <= start + tolerance:
            return whole
        whole = store(whole.join(labels.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        links = store(_coarse(links, labels))


def greedy_modularity(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 1000) -> DataFrame:
    """(id, label): communities by merging. In a round every community names the neighbour whose merger gains most
    modularity (the least of equals); pairs that name each other merge, until no merger gains.

    The pair of the largest gain of all always names each other, so a round makes the merger that the sequential method
    would make, and others that do not touch it.
    """
    links = store(_undirected(edges))
    whole = store(nodes.select("id", F.col("id").alias("label")))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return whole
    for _ in range(rounds):
        volume = links.groupBy("src").agg(F.sum("w").alias("k"))
        pairs = links.where("src <> dst").join(volume, "src").join(volume.select(F.col("src").alias("dst"), F.col("k").alias("l")), "dst")
        gain = pairs.select("src", "dst", (F.col("w") - resolution * F.col("k") * F.col("l") / total).alias("g")).where("g > 1e-12")
        # Of equal gains the pair with the least ends, so that a cycle of equal wishes has one that is mutual.
        ends = F.struct(-F.col("g"), F.least("src", "dst"), F.greatest("src", "dst"))
        wish = store(gain.groupBy("src").agg(F.min_by("dst", ends).alias("dst")))
        back = wish.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        merged = store(wish.join(back, ["src", "dst"]).where("src > dst"))
        if merged.isEmpty():
            return whole
        labels = merged.select(F.col("src").alias("label"), F.col("dst").alias("new"))
        whole = store(whole.join(labels, "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        every = links.select(F.col("src").alias("id")).distinct().join(labels.withColumnRenamed("label", "id"), "id", "left").select("id", F.coalesce("new", "id").alias("label"))
        links = store(_coarse(links, every))
    raise RuntimeError("mergers did not end")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a labelling of the undirected graph; one row."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    j = e.join(la, "a").join(lb, "b")
    ends = j.select(F.explode(F.array("la", "lb")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    inside = j.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("l"))
    m = F.broadcast(e.agg(F.count(F.lit(1)).alias("m")))
    q = F.coalesce("l", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)
    return ends.join(inside, "label", "left").join(m).agg(F.sum(q).alias("modularity"))


METHODS = {"louvain": louvain, "label_propagation": label_propagation, "greedy_modularity": greedy_modularity}


def communities(nodes: DataFrame, edges: DataFrame, top: int = 10, method: str = "label_propagation") -> DataFrame:
    """Size, density, mean PageRank and the top members of each community, the largest first."""
    labels = cut(METHODS[method](nodes, edges))
    ranks = pagerank(nodes, edges)
    members = labels.join(ranks, "id")
    best = members.withColumn("__r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("rank"), "id"))).where(F.col("__r") <= top)
    tops = best.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "id"))), lambda s: s["id"]).alias("top"))
    j = edges.where("src <> dst").join(labels.select(F.col("id").alias("src"), F.col("label").alias("label")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst")
    inner = j.where("label = other").groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("rank").alias("avg_rank"))
    density = F.when(F.col("size") > 1, F.coalesce("m", F.lit(0)) / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return sizes.join(inner, "label", "left").join(tops, "label").select("label", "size", density.alias("density"), "avg_rank", "top").orderBy(F.desc("size"), "label")


def path_retrieval(nodes: DataFrame, edges: DataFrame, scored_seeds: DataFrame, one: int = 8, total: int = 16) -> DataFrame:
    """1-hop paths at 1.0 (at most ``one``), 2-hop at 0.6 (``total`` in all) times seed score / 10, to 3 places."""
    s = scored_seeds.select("id", F.col("score").alias("seed"))
    first = s.join(edges, s["id"] == edges["src"]).select(F.array("src", "dst").alias("path"), F.array("relation").alias("relations"), F.lit(1).alias("hops"), "seed")
    first = first.orderBy(F.desc("seed"), "path").limit(one)
    mid = edges.select(F.col("src").alias("m"), F.col("dst").alias("end"), F.col("relation").alias("r2"))
    second = s.join(edges, s["id"] == edges["src"]).join(mid, F.col("dst") == F.col("m")).where("end <> src")
    second = second.select(F.array("src", "dst", "end").alias("path"), F.array("relation", "r2").alias("relations"), F.lit(2).alias("hops"), "seed").dropDuplicates(["path"])
    second = second.orderBy(F.desc("seed"), "path").limit(total - one)
    both = first.unionByName(second)
    score = F.round(F.when(F.col("hops") == 1, 1.0).otherwise(0.6) * F.col("seed") / 10, 3)
    return both.select("path", "relations", "hops", score.alias("score")).orderBy("hops", F.desc("score"), "path")


def seeds(nodes: DataFrame, candidates: DataFrame, top: int = 5) -> DataFrame:
    """Nodes for entity candidates by the ladder 10 equal, 6 * len share (name holds candidate), 2 both ways short,
    5 * len share (candidate holds name); at least 2; ``top`` nodes.

    ``candidates`` (column c) come from one question. They are gathered to one row, which goes to every task, and each
    node is scored against all of them in its row.
    """
    gathered = F.broadcast(candidates.select(F.lower("c").alias("c")).where("c <> ''").agg(F.collect_set("c").alias("cs")))
    name, size = F.lower("label"), F.length("label")

    def ladder(c: Column) -> Column:
        # The ladder's numbers.
        return F.when(name == c, 10.0).when(name.contains(c), F.greatest(F.lit(2.0), 6.0 * F.length(c) / size)).when(c.contains(name) & (size > 1), 5.0 * size / F.greatest(F.lit(1), F.length(c))).otherwise(0.0)

    score = F.aggregate(F.transform("cs", ladder), F.lit(0.0), lambda a, b: F.greatest(a, F.coalesce(b, F.lit(0.0))))
    return nodes.select("id", "label").join(gathered).select("id", score.alias("score")).where("score >= 2").orderBy(F.desc("score"), "id").limit(top)


def domain_rollup(is_a: DataFrame, domains: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered cross-domain pairs with their number of edges. is_a(src, dst) leads to ids in domains(id)."""
    up = closure(is_a).join(domains.withColumnRenamed("id", "dst"), "dst", "left_semi")
    best = up.groupBy("src").agg(F.min_by("dst", F.struct("depth", "dst")).alias("domain"))
    root = best.unionByName(domains.select(F.col("id").alias("src"), F.col("id").alias("domain")))
    j = edges.join(root.select("src", F.col("domain").alias("d1")), "src").join(root.select(F.col("src").alias("dst"), F.col("domain").alias("d2")), "dst")
    return j.groupBy(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).agg(F.count(F.lit(1)).alias("n"))
