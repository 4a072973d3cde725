"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import chat, embedding_dedup, exact_dedup, line_dedup, mixing, pieces, quality, sharding, simhash, token_counts
from orrery.session import table

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tools of the traffic that op1_chat makes from the table.
TOOLS = chat.SCHEMAS | {
    "find": {"properties": {"n": "integer", "query": "string"}, "required": ["query"], "additional": False},
    "check": {"properties": {"answer": "string", "limit": "integer"}, "required": ["answer"], "additional": True},
}


def tool_traffic(chats: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with tool calls and results for every assistant message of chats.

    Turn t makes a message with three calls: ``find-t``, which needs the ``find`` two turns before; ``check-t``, which needs
    ``find-t`` and stands before it where t mod 4 is 1 or 2; and a call of an unknown tool whose id ``turn-1`` every turn
    uses again. Lengths of texts decide which arguments are missing or of a wrong type, which results are missing and
    which stand alone, and whether white space precedes the JSON.
    """
    t, x, n = F.col("turn"), F.col("text"), F.length("text")
    name = lambda tool, at: F.concat(F.lit(f"{tool}-"), at)
    call = lambda i, tool, arguments, *needs: F.to_json(F.struct(arguments.alias("arguments"), F.array(*needs).cast("array<string>").alias("depends_on"), i.alias("id"), F.lit(tool).alias("name")))
    find = call(name("find", t), "find", F.struct(t.alias("n"), F.when(t % 4 == 3, t).alias("page"), F.when(n % 5 != 0, x).alias("query")), name("find", t - 2))
    check = lambda limit: call(name("check", t), "check", F.struct(x.alias("answer"), limit.alias("limit")), name("find", t))
    check = F.when(n % 3 == 0, check(t.cast("string"))).otherwise(check(t))
    note = call(F.lit("turn-1"), "note", F.struct(t.alias("turn")))
    calls = F.when((t % 4).isin(1, 2), F.concat_ws(",", check, find, note)).otherwise(F.concat_ws(",", find, check, note))
    result = lambda i, content: F.to_json(F.struct(content.alias("content"), i.alias("tool_call_id")))
    messages = F.array(
        F.struct(F.lit("assistant").alias("role"), F.concat(F.when(n % 2 == 0, " \n").otherwise(""), F.lit('{"tool_calls":['), calls, F.lit("]}")).alias("text")),
        F.when(F.coalesce(n % 7 != 5, F.lit(True)), F.struct(F.lit("tool").alias("role"), result(name("find", t), x).alias("text"))),
        F.struct(F.lit("tool").alias("role"), result(F.lit("turn-1"), F.concat(F.lit("turn "), t)).alias("text")),
        F.when(n % 7 == 0, F.struct(F.lit("tool").alias("role"), result(name("lost", t), F.lit("-")).alias("text"))),
    )
    made = chats.where(F.lower("role") == "assistant").select("conv_id", "turn", F.explode(F.array_compact(messages)).alias("m"))
    return made.select("conv_id", "turn", "m.role", "m.text")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's plain exchanges, and tool calls made from them."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    linked = chat.link(chats.unionByName(tool_traffic(chats)), TOOLS, each=True)
    return linked.select("conv_id", "turn", "place", "layer", "status", "call_id", "tool", "n_calls", "n_results", "valid", F.array_join("errors", ",").alias("errors"), F.sha2("record", 256).alias("record_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = token_counts.token_counts(docs)
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), F.col("fits")[0].alias("chars_within_limit"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations a document, decoded again and compared with the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, verify=True)
    return coded.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {
    "op1_chat": op1_chat,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_simhash": op10_simhash,
}
ORACLES = {
    "op1_chat": """
        WITH RECURSIVE m AS (SELECT conv_id, turn, lower(role) AS role, text, length(text) AS n FROM conversations),
        a AS (FROM m WHERE role = 'assistant'),
        call AS (
            SELECT conv_id, true AS plain, 'turn-' || turn AS call_id, turn, 0 AS place, 'respond' AS tool, CASE WHEN text IS NULL THEN '{}' ELSE json_object('prompt', text)::VARCHAR END AS body,
                   CASE WHEN text IS NULL THEN 'missing:prompt' ELSE '' END AS errors FROM m WHERE role = 'user'
            UNION ALL
            SELECT conv_id, false, 'find-' || turn, turn, CASE WHEN turn % 4 IN (1, 2) THEN 1 ELSE 0 END, 'find',
                   '{' || concat_ws(',', '"n":' || turn, CASE WHEN turn % 4 = 3 THEN '"page":' || turn END, CASE WHEN n % 5 <> 0 THEN '"query":' || to_json(text)::VARCHAR END) || '}',
                   concat_ws(',', CASE WHEN coalesce(n % 5 = 0, true) THEN 'missing:query' END, CASE WHEN turn % 4 = 3 THEN 'unknown:page' END) FROM a
            UNION ALL
            SELECT conv_id, false, 'check-' || turn, turn, CASE WHEN turn % 4 IN (1, 2) THEN 0 ELSE 1 END, 'check',
                   '{' || concat_ws(',', '"answer":' || to_json(text)::VARCHAR, '"limit":' || CASE WHEN n % 3 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END) || '}',
                   concat_ws(',', CASE WHEN text IS NULL THEN 'missing:answer' END, CASE WHEN n % 3 = 0 THEN 'type:limit' END) FROM a
            UNION ALL
            SELECT conv_id, false, 'turn-1', turn, 2, 'note', '{"turn":' || turn || '}', 'unknown_tool' FROM a),
        result AS (
            SELECT conv_id, true AS plain, 'turn-' || (turn - 1) AS call_id, turn, text AS content FROM a
            UNION ALL SELECT conv_id, false, 'find-' || turn, turn, text FROM a WHERE coalesce(n % 7 <> 5, true)
            UNION ALL SELECT conv_id, false, 'turn-1', turn, 'turn ' || turn FROM a
            UNION ALL SELECT conv_id, false, 'lost-' || turn, turn, '-' FROM a WHERE n % 7 = 0),
        c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, plain, call_id ORDER BY turn, place, tool, left(body, 64), sha256(body)) AS k
              FROM (SELECT conv_id, plain, call_id, turn, place, tool, body, errors, count(*) AS n_calls FROM call GROUP BY ALL)),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, plain, call_id ORDER BY turn, left(content, 64) NULLS LAST, sha256(content)) AS k
              FROM (SELECT conv_id, plain, call_id, turn, content, count(*) AS n_results FROM result GROUP BY ALL)),
        chain AS (SELECT DISTINCT conv_id, turn, 0 AS steps FROM a WHERE (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM a)
                  UNION SELECT a.conv_id, a.turn, steps + 1 FROM chain JOIN a ON a.conv_id = chain.conv_id AND a.turn = chain.turn + 2),
        late AS (SELECT DISTINCT conv_id FROM a WHERE turn % 4 IN (1, 2)),
        j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.place, 0) AS place, coalesce(c.call_id, r.call_id) AS call_id,
                     c.tool, c.n_calls, r.n_results, c.body, c.errors, r.content, coalesce(c.plain, r.plain) AS plain
              FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.plain = r.plain AND c.call_id = r.call_id AND c.k = r.k)
        SELECT j.conv_id, j.turn, place,
               CASE WHEN plain OR late.conv_id IS NULL OR n_calls IS NULL OR tool = 'note' THEN 0 WHEN tool = 'find' THEN steps ELSE steps + 1 END AS layer,
               CASE WHEN n_calls IS NULL THEN 'result_without_call' WHEN n_results IS NULL THEN 'call_without_result' ELSE 'linked' END AS status,
               call_id, tool, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
               CASE WHEN n_calls IS NOT NULL THEN errors = '' END AS valid, CASE WHEN n_calls IS NOT NULL THEN errors END AS errors,
               sha256('{' || concat_ws(',', '"arguments":' || body, '"id":"' || call_id || '"', '"name":"' || tool || '"', '"result":' || to_json(content)::VARCHAR) || '}') AS record_sha256
        FROM j LEFT JOIN late USING (conv_id) LEFT JOIN chain ON chain.conv_id = j.conv_id AND chain.turn = j.turn
        UNION ALL
        SELECT conv_id, turn, 0, 0, 'context', NULL, NULL, 0, 0, NULL, NULL,
               sha256(CASE WHEN text IS NULL THEN '{"role":' || to_json(role)::VARCHAR || '}'
                      ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' END)
        FROM m WHERE role NOT IN ('user', 'assistant')""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op4_line_dedup": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UP}', '{LOW}') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        s AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keep_id AS gone FROM k LEFT JOIN f USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM s GROUP BY rid""",
}
