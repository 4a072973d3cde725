"""Training samples from graphs, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as X

#: Role names and what they become; limits on questions and answers in characters.
ROLES = {"customer": "user", "user": "user", "human": "user", "patient": "user", "agent": "assistant", "assistant": "assistant", "support": "assistant", "system": "system"}
QUESTION, ANSWER, CONTEXTS = (5, 500), (10, 8000), 20


def role(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in sorted(ROLES.items()) for x in kv])
    return F.coalesce(names[F.lower(c)], F.lit("user"))


def conversations(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, messages) with mapped roles, in order. A conversation is one sample, so it is one row."""
    m = F.struct(F.col(order).alias("o"), role(F.col("role")).alias("role"), F.col("text").alias("content"))
    got = messages.groupBy(session).agg(F.sort_array(F.collect_list(m)).alias("m"))
    return got.select(session, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def sft_reason(messages: Column) -> Column:
    """The first reason against a sample, in order, or null."""
    user = F.element_at(F.filter(messages, lambda m: m["role"] == "user"), 1)["content"]
    answer = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    has_user = F.exists(messages, lambda m: m["role"] == "user")
    q = F.when(has_user, F.length(F.trim(F.coalesce(user, F.lit(""))))).otherwise(0)
    a = F.length(F.trim(F.coalesce(answer, F.lit(""))))
    return (
        F.when(F.size(messages) == 0, "empty_messages")
        .when(~has_user, "no_user_message")
        .when(q < QUESTION[0], "question_too_short")
        .when(q > QUESTION[1], "question_too_long")
        .when(a < ANSWER[0], "answer_too_short")
        .when(a > ANSWER[1], "answer_too_long")
    )


def rag_reason(question: Column, answer: Column, contexts: Column) -> Column:
    """D19 for retrieval samples."""
    longest = F.coalesce(F.array_max(F.transform(contexts, F.length)), F.lit(0))
    return (
        F.when(F.length(question) < QUESTION[0], "question_too_short")
        .when(F.length(question) > QUESTION[1], "question_too_long")
        .when(F.length(answer) < ANSWER[0], "answer_too_short")
        .when(F.length(answer) > ANSWER[1], "answer_too_long")
        .when(F.size(contexts) == 0, "no_contexts")
        .when(longest < CONTEXTS, "contexts_too_short")
    )


def tool_reason(tools: Column, calls: Column) -> Column:
    """D19 for tool samples; names only."""
    return F.when(F.size(tools) == 0, "no_tools").when(F.size(calls) == 0, "no_tool_calls").when(F.size(F.array_except(calls, tools)) > 0, "tool_call_mismatch")


def quality_report(samples: DataFrame, key: Column, reason: Column) -> DataFrame:
    """Counts by reason; of samples that pass, repeats of a key count as duplicate."""
    marked = samples.select(key.alias("k"), F.coalesce(reason, F.lit("passed")).alias("reason"))
    bad = marked.where("reason <> 'passed'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = marked.where("reason = 'passed'").groupBy("k").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    rows = good.select(F.explode(F.array(F.struct(F.lit("passed").alias("reason"), F.col("kept").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("all") - F.col("kept")).alias("n")))).alias("x")).select("x.*")
    return bad.unionByName(rows)


def diversity(texts: DataFrame, id_col: str, text_col: str, sample: int = 100) -> DataFrame:
    """1 less the mean trigram Jaccard of all pairs among the first ``sample`` texts by hash, to 3 places.

    The sample is the operator's own bound; pairs come from one list against itself on at most ``sample`` rows.
    """
    chosen = texts.orderBy(F.sha2(F.col(id_col).cast("string"), 256), id_col).limit(sample).select(F.col(id_col).alias("a"), X.ngrams(F.lower(text_col), 3).alias("g"))
    packed = chosen.agg(F.sort_array(F.collect_list(F.struct("a", "g"))).alias("all"))
    pairs = packed.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(sample))).alias("y"))
    return pairs.agg(F.round(F.coalesce(1 - F.avg(X.jaccard(F.col("x.g"), F.col("y.g"), 1.0)), F.lit(1.0)), 3).alias("diversity"))


def exact_split(samples: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Split sizes int(n * ratio), the remainder is test. The order is a keyed hash.

    Cut points are found without sorting all rows in one task: rows are counted by 2^16 hash buckets, and only rows of
    the buckets in which a cut falls are ranked.
    """
    # 60 bits of a digest that any SQL engine can make again.
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = samples.withColumn("__h", h).withColumn("__b", F.shiftrightunsigned(F.col("__h"), 44))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("__b", "c", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("start"))
    total = F.broadcast(samples.agg(F.count(F.lit(1)).alias("n")))
    cuts = before.join(total).select("__b", "start", "c", F.floor(F.col("n") * train).alias("t"), (F.floor(F.col("n") * train) + F.floor(F.col("n") * val)).alias("v"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col)) - 1
    # At most 2^16 rows of counts.
    out = rows.join(F.broadcast(cuts), "__b").withColumn("__at", F.col("start") + rank)
    split = F.when(F.col("__at") < F.col("t"), "train").when(F.col("__at") < F.col("v"), "val").otherwise("test")
    return out.withColumn("split", split).drop("__h", "__b", "__at", "start", "c", "t", "v")


def _pick(templates: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(F.xxhash64(key), F.lit(len(templates))) + 1).cast("int"))


def _sample(question: Column, answer: Column) -> Column:
    m = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(m("user", question), m("assistant", answer))


def entity_qa(nodes: DataFrame, attributes: list[str], least: int = 10, most: int = 5) -> DataFrame:
    """M1: a question on each described node, and one on each of its first ``most`` scalar attributes."""
    described = nodes.where(F.length("description") >= least)
    about = described.select("id", F.lit("entity").alias("kind"), _sample(F.format_string("What is %s?", "label"), F.col("description")).alias("messages"))
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("v")) for a in attributes[:most]]), lambda p: p["v"].isNotNull())
    each = nodes.select("id", "label", F.explode(pairs).alias("p"))
    attr = each.select("id", F.lit("attribute").alias("kind"), _sample(F.format_string("What is the %s of %s?", "p.a", "label"), F.format_string("The %s of %s is %s.", "p.a", "label", "p.v")).alias("messages"))
    return about.unionByName(attr)


def relation_qa(triples: DataFrame) -> DataFrame:
    """M2: a question for each triple (source, relation, target)."""
    verb = F.replace("relation", F.lit("_"), F.lit(" "))
    return triples.select("src", "dst", _sample(F.format_string("How is %s related to %s?", "source", "target"), F.format_string("%s %s %s.", "source", verb, "target")).alias("messages"))


def summaries(docs: DataFrame, id_col: str, text_col: str, least: int = 100, sentences: int = 3, most: int = 800) -> DataFrame:
    """M3: the first sentences of a text of ``least`` characters and more as its summary."""
    parts = F.filter(F.split(text_col, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")
    first = F.array_join(F.slice(parts, 1, sentences), " ")
    return docs.where(F.length(text_col) >= least).select(id_col, _sample(F.concat(F.lit("Summarise this text:\n"), F.substring(text_col, 1, most)), first).alias("messages"))


def multi_turn(triples: DataFrame, neighbours: int = 2, most: int = 3) -> DataFrame:
    """M4: a conversation on each node of at least ``neighbours`` neighbours: two messages a neighbour, one to close."""
    w = Window.partitionBy("src").orderBy("dst", "relation")
    # Only the first few rows of a node are gathered, so a hub stays small.
    some = triples.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    turn = F.struct("n", F.format_string("What does %s have to do with %s?", "source", "target").alias("q"), F.format_string("%s %s %s.", "source", F.replace("relation", F.lit("_"), F.lit(" ")), "target").alias("a"))
    got = some.groupBy("src").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("source").alias("source")).where(F.size("t") >= neighbours)
    pairs = F.flatten(F.transform("t", lambda x: _sample(x["q"], x["a"])))
    return got.select("src", F.concat(pairs, F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Thank you. That is all on "), F.col("source"), F.lit(".")).alias("content")))).alias("messages"))


def rag_factual(triples: DataFrame) -> DataFrame:
    """M5: question, answer, context and difficulty of each triple."""
    fact = F.format_string("%s %s %s.", "source", F.replace("relation", F.lit("_"), F.lit(" ")), "target")
    return triples.select("src", "dst", F.format_string("What does %s %s?", "source", "relation").alias("question"), F.col("target").alias("answer"), F.array(fact).alias("contexts"), F.lit("factual").alias("query_type"), F.lit("easy").alias("difficulty"))


def rag_aggregational(nodes: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """M5: how many nodes of each label, with up to ``most`` of them as context."""
    w = Window.partitionBy("type").orderBy("id")
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    some = nodes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("type").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]).alias("contexts"))
    j = counts.join(some, "type").where(F.col("n") >= least)
    return j.select("type", F.format_string("How many %s are there?", "type").alias("question"), F.col("n").cast("string").alias("answer"), "contexts", F.lit("aggregational").alias("query_type"), F.when(F.col("n") > most, "hard").otherwise("medium").alias("difficulty"))


def rag_reasoning(hops: DataFrame) -> DataFrame:
    """M5: two-hop questions from (a, r1, b, r2, c)."""
    return hops.select("a", "c", F.format_string("What does that which %s %s %s?", "a", "r1", "r2").alias("question"), F.col("c").alias("answer"), F.array(F.format_string("%s %s %s.", "a", "r1", "b"), F.format_string("%s %s %s.", "b", "r2", "c")).alias("contexts"), F.lit("reasoning").alias("query_type"), F.lit("hard").alias("difficulty"))


def tool_samples(nodes: DataFrame) -> DataFrame:
    """M6: a look-up call for each node, as JSON."""
    call = F.to_json(F.struct(F.lit("lookup").alias("name"), F.struct(F.col("label").alias("query")).alias("arguments")))
    return nodes.select("id", _sample(F.format_string("Look up %s.", "label"), call).alias("messages"), F.array(F.lit("lookup")).alias("tools"), F.array(call).alias("tool_calls"))


def satisfactory(iterations: DataFrame, least: float) -> DataFrame:
    """M8: samples of iterations with a score of ``least`` and more."""
    return iterations.where(F.col("score") >= least).select("run", "number", _sample(F.col("question"), F.col("answer")).alias("messages"))


def pipeline(parts: dict[str, DataFrame], total: int, seed: int = 42) -> DataFrame:
    """M9: each generator gives at most total // k samples (by keyed hash); bad and repeated ones go; then the split."""
    each, out = max(1, total // max(1, len(parts))), None
    for name, df in sorted(parts.items()):
        one = df.select(F.lit(name).alias("generator"), "messages", F.sha2(F.to_json("messages"), 256).alias("key"))
        one = one.where(sft_reason(F.col("messages")).isNull()).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "key"), 256), "key").limit(each)
        out = one if out is None else out.unionByName(one)
    kept = out.groupBy("key").agg(F.min_by("generator", "generator").alias("generator"), F.min("messages").alias("messages"))
    return exact_split(kept, "key", seed=seed)


def explicit_usage(calls: DataFrame, registry: DataFrame, tool: str) -> DataFrame:
    """K3: uses of assets by calls of a tool; arguments that are no JSON are skipped."""
    args = F.from_json("arguments", "struct<asset:string>")
    used = calls.where(F.col("tool") == tool).select("call_id", args["asset"].alias("asset")).where("asset is not null")
    return used.join(registry, "asset", "left")


def implicit_usage(responses: DataFrame, names: list[str]) -> DataFrame:
    """K4: names that a response holds, relevance min(0.1 * count, 1). ``names`` is a registry's, metadata-sized."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), ((F.length(low) - F.length(F.replace(low, F.lit(n.lower())))) / len(n)).alias("c")) for n in names]), lambda x: x["c"] > 0)
    return responses.select("id", F.explode(found).alias("x")).select("id", "x.name", F.least(F.lit(1.0), F.col("x.c") * 0.1).alias("relevance"))


def feedback_candidates(iterations: DataFrame, n: int) -> DataFrame:
    """K5: the first n terms of the latest iteration that has unmatched ones, by run."""
    last = iterations.where("unmatched_count > 0").groupBy("run").agg(F.max_by("terms", "number").alias("terms"))
    return last.select("run", F.posexplode(F.slice("terms", 1, n)).alias("pos", "term"))
