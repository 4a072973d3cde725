"""Retrieval: fusion, layered de-duplication, term search and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as X

#: Routes up to which they are broadcast.
ROUTES = 4096
RRF_K, MAX_TYPE_SHARE, PER_PAGE, TOP_OF_PAGE, SAME_TEXT = 60, 0.6, 2, 3, 0.85


def rrf(hits: DataFrame) -> DataFrame:
    """Fuse ranked lists. hits(list, rank from 0, slug, chunk_text, type, score) -> one row per key, by score.

    The key is the slug and the first 50 characters; the first list's row stays as payload.
    """
    key = F.concat(F.col("slug"), F.lit(":"), F.substring("chunk_text", 1, 50))
    out = hits.groupBy(key.alias("key")).agg(F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))).alias("score"), F.min_by(F.struct("slug", "chunk_text", "type"), F.struct("list", "rank")).alias("p"))
    return out.select("key", "p.*", "score")


def top_of_page(hits: DataFrame, order: list[Column], n: int = TOP_OF_PAGE) -> DataFrame:
    """The n best of each slug."""
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy("slug").orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def type_cap(hits: DataFrame, order: list[Column], total: int, share: float = MAX_TYPE_SHARE) -> DataFrame:
    """Of each type at most max(1, int(total * share + 0.999))."""
    most = max(1, int(total * share + 0.999))
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def drop_similar(hits: DataFrame, threshold: float = SAME_TEXT) -> DataFrame:
    """In order of pos, drop a hit whose words are too similar to one that was kept.

    ``hits`` is one answer page (bounded by the caller's limit, columns pos and chunk_text). Similar pairs come from an
    equi-join on shared words; then, as every decision depends on earlier ones, rounds settle those that depend on
    settled rows only. A round is a pair of joins on narrow rows.
    """
    from orrery.session import cut

    words = hits.select("pos", F.array_distinct(F.filter(F.split(F.lower("chunk_text"), r"\s+"), lambda w: w != "")).alias("w"))
    each = words.select("pos", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = each.select(F.col("pos").alias("early"), F.col("n").alias("n1"), "word"), each.select(F.col("pos").alias("late"), F.col("n").alias("n2"), "word")
    shared = a.join(b, "word").where("early < late").groupBy("early", "late", "n1", "n2").agg(F.count(F.lit(1)).alias("c"))
    pairs = cut(shared.where(F.col("c") / (F.col("n1") + F.col("n2") - F.col("c")) > threshold).select("early", "late"))
    dropped = None
    open_ = pairs
    kept = cut(hits.select("pos").join(pairs.select(F.col("late").alias("pos")), "pos", "left_anti"))
    while True:
        gone = open_.join(kept.select(F.col("pos").alias("early")), "early", "left_semi").select(F.col("late").alias("pos")).distinct()
        gone = cut(gone)
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(gone.select(F.col("pos").alias("late")), "late", "left_anti").join(gone.select(F.col("pos").alias("early")), "early", "left_anti")
        newly = open_.select("late").distinct().join(gone.select(F.col("pos").alias("late")), "late", "left_anti").join(rest.select("late").distinct(), "late", "left_anti")
        open_ = cut(rest)
        kept = cut(newly.select(F.col("late").alias("pos")))
    return hits if dropped is None else hits.join(F.broadcast(dropped.distinct()), "pos", "left_anti")


def tf_cosine(docs: DataFrame, query: str, id_col: str, text_col: str, mention: str | None = None) -> DataFrame:
    """Cosine of term counts, to 8 places; kept if positive.

    The query's counts are a literal map; each document is one row of work, with no shuffle.
    """
    import re

    counts: dict[str, int] = {}
    for w in re.findall(f"[a-z0-9_-]+|[{X.CJK}]", query.lower()):
        counts[w] = counts.get(w, 0) + 1
    norm_q = sum(v * v for v in counts.values())
    words = X.tokens(F.col(text_col))
    exploded = docs.select(id_col, F.explode(words).alias("w")).groupBy(id_col, "w").agg(F.count(F.lit(1)).alias("c"))
    weight = F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]) if counts else F.create_map(F.lit(""), F.lit(0))
    scored = exploded.groupBy(id_col).agg(F.sum(F.col("c") * F.coalesce(weight[F.col("w")], F.lit(0))).alias("dot"), F.sum(F.col("c") * F.col("c")).alias("n2"))
    return scored.where("dot > 0").select(id_col, F.round(F.col("dot") / F.sqrt(F.col("n2") * F.lit(float(norm_q))), 8).alias("score"))


#: The search modes, and the kinds that each is restricted to (none: all).
MODES = {"vector": (), "rag": (), "skill": ("ActionType", "Workflow", "Function")}


def sparse_search(resources: DataFrame, query: str, mode: str = "vector", limit: int = 10) -> DataFrame:
    """resources(resource_id, kind, name, text) by cosine, and at 0 those whose name the query mentions (X4) though they
    share no word. By score and id."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    some = resources.where(F.col("kind").isin(*MODES[mode])) if MODES[mode] else resources
    low, text = F.lower("name"), F.lit(query.lower())
    alone = F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9_])\\Q"), low, F.lit("\\E(?![a-z0-9_])")))
    named = some.where((F.length("name") > 0) & F.when(F.length("name") == F.octet_length("name"), alone).otherwise(text.contains(low)))
    hits = tf_cosine(some, query, "resource_id", "text").unionByName(named.select("resource_id", F.lit(0.0).alias("score")))
    return hits.groupBy("resource_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "resource_id").limit(limit)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, n: int = 3, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold all words (of n letters and more) of the query, scored by BM25 over the words' grams.

    Matching and counting are per row; only the document frequencies of the query's grams are gathered (one row).
    """
    words = [w for w in query.lower().split() if len(w) >= n]
    if not words:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(text_col)
    rows = docs.select(id_col, low.alias("low"), F.greatest(F.length(low) - n + 1, F.lit(0)).alias("len"))
    tf = [((F.length("low") - F.length(F.replace("low", F.lit(w)))) / len(w)).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = rows.select(id_col, "len", *tf)
    stats = rows.agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    match = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("total") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.where(match).join(F.broadcast(stats)).select(id_col, F.round(score, 6).alias("score"))


def trigram_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings (gram, id, tf, len) of the lower-cased texts' trigrams, to be written once and searched often."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2))
    grams = F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substring(low, i, F.lit(3))))
    each = docs.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    sizes = docs.select(F.col(id_col).alias("id"), F.greatest(F.length(low) - 2, F.lit(0)).alias("len"))
    return each.join(sizes, "id").select("gram", "id", "tf", "len")


def trigram_search(postings: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): rows that have every trigram of every word of the query (words of less than three letters don't
    count), by BM25 over these trigrams. Only postings of the query's trigrams are read."""
    grams = sorted({w[i : i + 3] for w in query.lower().split() if len(w) >= 3 for i in range(len(w) - 2)})
    if not grams:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    sizes = postings.select("id", "len").distinct().agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("mean"))
    some = postings.where(F.col("gram").isin(grams))
    df = some.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # One row a trigram of the query, and one row of sizes.
    rows = some.join(F.broadcast(df), "gram").join(F.broadcast(sizes))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    by = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("score"))
    return by.where(F.col("n") == len(grams)).select("id", F.round("score", 6).alias("score"))


def contains_search(docs: DataFrame, needle: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Case-free substring, by id."""
    return docs.where(F.lower(text_col).contains(needle.lower())).select(id_col).orderBy(id_col).limit(limit)


def weighted_search(df: DataFrame, words: list[str], fields: dict[str, Column], id_col: str, limit: int) -> DataFrame:
    """Weighted substrings, by score and id."""
    return df.select(id_col, X.weighted_substrings(words, fields).alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(limit)


def or_fallback(df: DataFrame, words: list[str], fields: dict[str, Column], id_col: str, limit: int) -> DataFrame:
    """Where no row has all words, rows with any of them at 0.6 of their weight, flagged partial.

    Both are computed in one pass; whether a full match exists is one aggregate row.
    """
    each = [X.weighted_substrings([w], fields) for w in words]
    any_ = reduce(lambda a, b: a + b, each)
    rows = df.select(id_col, X.weighted_substrings(words, fields).alias("full"), any_.alias("any")).where("any > 0")
    state = F.broadcast(rows.agg(F.coalesce(F.max("full"), F.lit(0.0)).alias("best")))
    out = rows.join(state).where(((F.col("best") > 0) & (F.col("full") > 0)) | ((F.col("best") == 0) & (F.lit(len(words)) > 1)))
    score = F.when(F.col("best") > 0, F.col("full")).otherwise(F.col("any") * 0.6)
    return out.select(id_col, score.alias("score"), (F.col("best") == 0).alias("partial")).orderBy(F.desc("score"), id_col).limit(limit)


def longest_prefix(df: DataFrame, routes: DataFrame, path_col: str, fallback: str) -> DataFrame:
    """the route whose prefix is the longest that the path begins with (of equal prefixes the greatest route).

    A prefix can only match at its own length, so it is an equi-join of each path's beginnings, one for each length that
    routes have, with the routes: no theta join. Paths are joined by shuffle only: what grows with them is never broadcast.
    """
    routes = routes.groupBy("prefix").agg(F.max("route").alias("route"))
    lengths = F.broadcast(routes.agg(F.collect_set(F.length("prefix")).alias("lengths")))
    fit = F.filter("lengths", lambda n: n <= F.length(path_col))
    cuts = df.select(path_col).distinct().join(lengths).select(path_col, F.explode(fit).alias("n"))
    cuts = cuts.withColumn("prefix", F.substring(F.col(path_col), F.lit(1), F.col("n")))
    if routes.limit(ROUTES + 1).count() <= ROUTES:
        routes = F.broadcast(routes)
    else:
        cuts = cuts.hint("merge")
    best = cuts.join(routes, "prefix").groupBy(path_col).agg(F.max_by("route", F.length("prefix")).alias("route"))
    return df.join(best.hint("merge"), path_col, "left").withColumn("route", F.coalesce("route", F.lit(fallback)))


def _keys(words: DataFrame) -> DataFrame:
    """(lt, g): what terms (lt, lower case) are met on: all 3-grams of a CJK term, of another the one that fewest terms have."""
    grams = F.when(F.length("lt") < 3, F.array("lt")).otherwise(X.ngrams(F.col("lt"), 3))
    every = words.select("lt", _partial("lt").alias("cjk")).distinct().withColumn("g", F.explode(F.array_distinct(grams)))
    seldom = every.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    one = every.where("NOT cjk").join(seldom, "g").groupBy("lt").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    return every.where("cjk").select("lt", "g").unionByName(one)


def _partial(term: str) -> Column:
    """Whether a part of the term counts too."""
    return F.col(term).rlike(f"[{X.CJK}]") & (F.length(term) >= 4)


def vocabulary_match(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Best term of each card that a question holds: 1.0 for the whole term, 0.6 for one of its 3-grams of a CJK term.

    Terms and questions meet on 3-grams (or whole short terms), an equi-join, before the exact test. A CJK term can be met on
    each of its 3-grams; another only counts whole, so it is met on the one that the fewest terms have. Each different
    question is matched once.
    """
    def parts(c: Column) -> Column:
        # Everything that a term's key can be: 3-grams, and 1- and 2-grams for terms that short.
        return F.array_distinct(F.concat(X.ngrams(c, 3), X.ngrams(c, 2), X.ngrams(c, 1)))

    cards = terms.select("card", "term", F.lower("term").alias("lt"))
    q = questions.select("qid", F.lower("question").alias("lq"))
    asked = q.select("lq").distinct()
    met = asked.select("lq", F.explode(parts(F.col("lq"))).alias("g")).join(_keys(cards), "g").select("lq", "lt").distinct()
    score = F.when(F.col("lq").contains(F.col("lt")), 1.0).when(_partial("lt"), 0.6).otherwise(0.0)
    held = met.withColumn("score", score).where("score > 0").join(cards, "lt")
    rank = F.struct("score", F.length("term").alias("len"), "term")
    best = held.groupBy("lq", "card").agg(F.max(rank).alias("b"))
    return q.join(best, "lq").groupBy("qid", "card").agg(F.max("b").alias("b")).select("qid", "card", "b.term", "b.score")


def metric_scenes(routed: DataFrame, scenes: DataFrame) -> DataFrame:
    """The scene that owns a metric comes along at 0.8, unless it was found itself."""
    more = routed.join(scenes, "metric").select("qid", F.col("scene").alias("card")).distinct()
    seen = routed.select("qid", "card")
    return more.join(seen, ["qid", "card"], "left_anti").withColumn("score", F.lit(0.8))


def precedents(decisions: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """Share of the wanted tags, then the latest."""
    tags = F.array(*[F.lit(w) for w in wanted])
    score = F.size(F.array_intersect(F.array_distinct("tags"), tags)) / len(set(wanted))
    return decisions.withColumn("similarity", score).where("similarity > 0").orderBy(F.desc("similarity"), F.desc("recorded_at"), "id").limit(limit)


def public_search(claims: DataFrame, revoked: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """Claims that hold all words and were not revoked."""
    every = reduce(lambda a, b: a & b, [F.lower(text_col).contains(w.lower()) for w in words])
    return claims.where(every).join(revoked, id_col, "left_anti")


def bundle_search(pages: DataFrame, words: list[str], limit: int) -> DataFrame:
    """16 title, 8 tag, 4 type, 2 text a word; by score and title."""
    score = F.lit(0)
    for w in (x.lower() for x in words):
        score = score + F.when(F.lower("title").contains(w), 16).otherwise(0) + F.when(F.exists("tags", lambda t: F.lower(t) == w), 8).otherwise(0)
        score = score + F.when(F.lower("type") == w, 4).otherwise(0) + F.when(F.lower("text").contains(w), 2).otherwise(0)
    return pages.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "title").limit(limit)


def dedup_layers(fused: DataFrame) -> DataFrame:
    """Fused hits (key, slug, type, chunk_text, score) through the four layers, with their place ``pos``.

    The three best of a page; no text too like one before it; a type's share; two of a page.
    """
    from orrery.session import cut

    best = top_of_page(fused, [F.desc("score"), F.asc("key")])
    hits = cut(best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "key"))))
    hits = cut(drop_similar(hits))
    return top_of_page(type_cap(hits, [F.asc("pos")], hits.count()), [F.asc("pos")], PER_PAGE)


def hybrid(lists: DataFrame, offset: int, limit: int) -> DataFrame:
    """Each route's list to min(2 * limit, 100) hits, fused, then all four layers over every fused hit, then the page.

    lists has ``list`` and ``rank`` (from 0). What is fused is bounded by that number and the number of routes.
    """
    inner = min(2 * limit, 100)
    kept = dedup_layers(rrf(lists.where(F.col("rank") < inner)))
    return kept.orderBy("pos").offset(offset).limit(limit).select("key", "slug", "type", "score")


def with_provenance(hits: DataFrame, k: int = 600) -> DataFrame:
    """Text to 600 characters, score to 4 places."""
    return hits.select("slug", F.substring("chunk_text", 1, k).alias("text"), F.round("score", 4).alias("score"), "list")


def mapping_search(entries: DataFrame, query: str, limit: int) -> DataFrame:
    """Relevance of mapping entries (key, name, description, alias, kind); patterns at 0.8."""
    s = F.when((F.col("kind") == "pattern") & F.lower("name").contains(query.lower()), 0.8).otherwise(X.mapping_relevance(F.lit(query), F.col("key"), F.col("name"), F.col("description"), F.col("alias")))
    return entries.withColumn("score", s).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def strategies(results: dict[str, DataFrame]) -> str:
    """The strategy with the most rows (one aggregate over the union), the first by name of equals."""
    both = None
    for name, df in sorted(results.items()):
        one = df.select(F.lit(name).alias("s"))
        both = one if both is None else both.unionByName(one)
    row = both.groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").first()
    return row["s"] if row else min(results)


def expand_query(query: str, model=None) -> list[str]:
    """The query and a model's rewordings; without a model, or below three words, the query alone."""
    return [query, *model(query)] if model is not None and len(query.split()) >= 3 else [query]


def ground(question: str, names: dict[str, list[str]]) -> list[str]:
    """Resources whose name or alias the question mentions; refuses digits, times and comparisons."""
    import re

    low = question.lower()
    if re.search(r"\d|\b(today|yesterday|last|between|before|after|more than|less than|greater|compare)\b", low):
        raise ValueError("the question needs filters that a mention can't give")
    found = []
    for rid, labels in sorted(names.items()):
        if any(re.search(rf"(?<![a-z0-9_]){re.escape(x.lower())}(?![a-z0-9_])", low) if x.isascii() else x in low for x in labels):
            found.append(rid)
    return found
