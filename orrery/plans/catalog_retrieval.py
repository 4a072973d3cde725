"""Queries of text functions and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import retrieval as R
from orrery.plans.catalog import add
from orrery.session import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@add("x2_slug", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_\\-一-鿿 ]+', '_', 'g'), '[_ ]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def x2(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.slug(F.col("url")).alias("slug"))


@add("x3_tokens", "SELECT item_id, len(regexp_extract_all(lower(text), '([a-z0-9_-]+|[一-鿿])')) AS n_tokens, list_aggregate(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_-]+|[一-鿿])')), 'max') AS last FROM benchmark")
def x3(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.array_max(t).alias("last"))


@add("x4_mentions", "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])license($|[^a-z0-9_])') AS m FROM documents")
def x4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.mentions(F.col("text"), "License").alias("m"))


GRAMS = "list_distinct([substr({0}, i::INT, 3) FOR i IN range(1, length({0}) - 1)])"


@add("x7_trigram_jaccard", f"""WITH h AS (SELECT item_id, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM benchmark), g AS (SELECT item_id, {GRAMS.format('a')} AS g, {GRAMS.format('b')} AS h FROM h)
    SELECT item_id, round(CASE WHEN len(g) + len(h) = 0 THEN 1 ELSE len(list_intersect(g, h)) / len(list_distinct(g || h)) END, 6) AS j FROM g""")
def x7(spark, sf_dir):
    """The first half of each text with its second."""
    half = F.floor(F.length("text") / 2).cast("int")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"))
    return b.select("item_id", F.round(X.jaccard(X.ngrams(F.col("a"), 3), X.ngrams(F.col("b"), 3), 1.0), 6).alias("j"))


@add("x15_sql_smells", """SELECT p_partkey, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'select_star' END, CASE WHEN p_partkey % 3 = 0 THEN 'unbounded' END, CASE WHEN p_partkey % 5 = 0 THEN 'many_joins' END], lambda x: x IS NOT NULL) AS smells FROM part""")
def x15(spark, sf_dir):
    k = F.col("p_partkey")
    sql = F.concat(F.when(k % 2 == 0, "SELECT  * FROM t").otherwise("select p_name from t"), F.when(k % 5 == 0, " join a JOIN b join c Join d").otherwise(" join a join b join c"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" WHERE k = "), k)).otherwise(" limit 5"))
    return table(spark, sf_dir, "part").select("p_partkey", X.sql_smells(sql).alias("smells"))


@add("x22_class_name", "SELECT p_partkey, string_agg(upper(w[1]) || w[2:], '' ORDER BY i) AS class FROM (SELECT p_partkey, unnest(string_split(lower(replace(p_type, ' ', '_')), '_')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY 1")
def x22(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.class_name(F.concat(F.lit("tbl_"), F.replace("p_type", F.lit(" "), F.lit("_")))).alias("class"))


@add("x24_strip_markup", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '<[^>]+>', ' ', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`#>|]+', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_sha256 FROM pages")
def x24(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.sha2(X.strip_markup(F.col("html")), 256).alias("text_sha256"))


@add("x31_json_access", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def x31(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@add("x6_tf_cosine", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_-]+|[一-鿿])')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS c FROM w GROUP BY ALL),
    q AS (SELECT * FROM (VALUES ('the', 2), ('of', 1), ('which', 1)) t(w, q)),
    s AS (SELECT item_id, sum(c * coalesce(q, 0)) AS dot, sum(c * c) AS n2 FROM c LEFT JOIN q USING (w) GROUP BY 1)
    SELECT item_id, round(dot / sqrt(n2 * 6.0), 8) AS score FROM s WHERE dot > 0""")
def x6(spark, sf_dir):
    return R.tf_cosine(table(spark, sf_dir, "benchmark"), "the of the which", "item_id", "text")


def _lists(spark, sf_dir):
    """Two ranked lists of 100 hits, the most that a hybrid search takes from a route."""
    d = docs(spark, sf_dir)
    common = ["slug", "chunk_text", "type"]
    hits = d.select(F.col("source").alias("slug"), F.col("text").alias("chunk_text"), F.col("lang").alias("type"), "doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("e")))).alias("tf"))

    def ranked(number, score):
        best = hits.orderBy(F.desc(score), "doc_id").limit(100)
        return best.select(F.lit(number).alias("list"), (F.row_number().over(Window.orderBy(F.desc(score), "doc_id")) - 1).alias("rank"), *common)

    return ranked(1, "tf").unionByName(ranked(2, "n_chars"))


LISTS = """l AS (SELECT 1 AS list, row_number() OVER (ORDER BY length(text) - length(replace(text, 'e', '')) DESC, doc_id) - 1 AS rank, source AS slug, text AS chunk_text, lang AS type FROM documents
    UNION ALL SELECT 2, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1, source, text, lang FROM documents),
    f AS (SELECT slug || ':' || substr(chunk_text, 1, 50) AS key, sum(1.0::DOUBLE / (60 + rank)) AS score, arg_min(slug, list * 1000 + rank) AS slug, arg_min(chunk_text, list * 1000 + rank) AS chunk_text, arg_min(type, list * 1000 + rank) AS type FROM l WHERE rank < 100 GROUP BY 1)"""


@add("n1_rrf", f"WITH {LISTS} SELECT key, slug, type, round(score, 9) AS score FROM f")
def n1(spark, sf_dir):
    return R.rrf(_lists(spark, sf_dir)).select("key", "slug", "type", F.round("score", 9).alias("score"))


@add("n2_top_of_page", f"WITH {LISTS} SELECT key, slug FROM f QUALIFY row_number() OVER (PARTITION BY slug ORDER BY score DESC, key) <= 3")
def n2(spark, sf_dir):
    return R.top_of_page(R.rrf(_lists(spark, sf_dir)), [F.desc("score"), F.asc("key")]).select("key", "slug")


@add("n3_type_cap", "SELECT doc_id, lang AS type FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 24")
def n3(spark, sf_dir):
    return R.type_cap(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("type")), [F.asc("doc_id")], 40)


@add("n4_page_cap", "SELECT doc_id, source AS slug FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2")
def n4(spark, sf_dir):
    return R.top_of_page(docs(spark, sf_dir).select("doc_id", F.col("source").alias("slug")), [F.asc("doc_id")], 2)


@add("n5_keep_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def n5(spark, sf_dir):
    return R.keep_first(docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h")), ["h"], [F.asc("doc_id")]).select("doc_id")


@add("r8_hybrid_search")
def r8(spark, sf_dir):
    """Three routes over the parts: BM25, cosine and graph paths from a supplier's lines to what they hold."""
    from orrery.operators import graph

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("slug"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_partkey").alias("chunk_text"), F.col("p_type").alias("type"))
    limit = 20
    ranked = lambda number, hits: hits.orderBy(F.desc("score"), "id").limit(2 * limit).select(F.lit(number).alias("list"), (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank"), "slug", "chunk_text", "type")
    words = R.bm25(p, "red promo", "id", "chunk_text").join(p, "id")
    cosine = R.tf_cosine(p, "red ring of promo", "id", "chunk_text").join(p, "id")
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_partkey").cast("string").alias("dst"), F.lit("delivers").alias("relation")).distinct()
    paths = graph.path_retrieval(p, line, spark.createDataFrame([("s1", 10.0), ("s2", 6.0)], "id string, score double"))
    ends = paths.select(F.element_at("path", -1).alias("id"), "score").groupBy("id").agg(F.max("score").alias("score")).join(p, "id")
    return R.hybrid(ranked(1, words).unionByName(ranked(2, cosine)).unionByName(ranked(3, ends)), 0, limit)


@add("r1_bm25", """WITH d AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents),
    f AS (SELECT doc_id, len, (length(t) - length(replace(t, 'license', ''))) / 7 AS a, (length(t) - length(replace(t, 'the', ''))) / 3 AS b FROM d),
    s AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
    SELECT doc_id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m)), 6) AS score FROM f, s WHERE a > 0 AND b > 0""")
def r1(spark, sf_dir):
    return R.bm25(docs(spark, sf_dir), "license the", "doc_id", "text")


def _fields():
    return {"name": F.col("source"), "tags": F.col("lang"), "search_text": F.col("text")}


@add("r2_weighted_substring", "SELECT doc_id, 0.0 + CASE WHEN lower(source) LIKE '%src1%' THEN 8 ELSE 0 END + CASE WHEN lower(lang) LIKE '%src1%' THEN 4 ELSE 0 END + CASE WHEN lower(text) LIKE '%src1%' THEN 1 ELSE 0 END + CASE WHEN lower(source) LIKE '%en%' THEN 8 ELSE 0 END + CASE WHEN lower(lang) LIKE '%en%' THEN 4 ELSE 0 END + CASE WHEN lower(text) LIKE '%en%' THEN 1 ELSE 0 END AS score FROM documents WHERE (lower(source) LIKE '%src1%' OR lower(lang) LIKE '%src1%' OR lower(text) LIKE '%src1%') AND (lower(source) LIKE '%en%' OR lower(lang) LIKE '%en%' OR lower(text) LIKE '%en%') ORDER BY score DESC, doc_id LIMIT 50")
def r2(spark, sf_dir):
    return R.weighted_search(docs(spark, sf_dir), ["src1", "en"], _fields(), "doc_id", 50)


@add("r3_or_fallback", "SELECT doc_id, 0.6::DOUBLE * (CASE WHEN lower(source) LIKE '%src1%' THEN 8 ELSE 0 END + CASE WHEN lower(lang) LIKE '%src1%' THEN 4 ELSE 0 END + CASE WHEN lower(text) LIKE '%src1%' THEN 1 ELSE 0 END) AS score, true AS partial FROM documents WHERE lower(source) LIKE '%src1%' OR lower(text) LIKE '%src1%' ORDER BY score DESC, doc_id LIMIT 30")
def r3(spark, sf_dir):
    return R.or_fallback(docs(spark, sf_dir), ["src1", "zzqqxx"], _fields(), "doc_id", 30)


@add("r5_contains", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' ORDER BY doc_id LIMIT 100")
def r5(spark, sf_dir):
    return R.contains_search(docs(spark, sf_dir), "LICENSE", "doc_id", "text", 100)


@add("r13_bundle_search", "SELECT page_id, CASE WHEN lower(url) LIKE '%1%' THEN 16 ELSE 0 END + CASE WHEN lower(html) LIKE '%1%' THEN 2 ELSE 0 END AS score FROM pages WHERE lower(url) LIKE '%1%' OR lower(html) LIKE '%1%' ORDER BY score DESC, url LIMIT 25")
def r13(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.col("url").alias("title"), F.array().cast("array<string>").alias("tags"), F.lit("page").alias("type"), F.col("html").alias("text"))
    return R.bundle_search(p, ["1"], 25).select("page_id", "score")


@add("r14_precedents", "SELECT o_orderkey AS id, len(list_intersect(list_distinct([o_orderstatus, o_orderpriority]), ['F', '1-URGENT'])) / 2 AS similarity FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' ORDER BY similarity DESC, o_orderdate DESC, o_orderkey LIMIT 20")
def r14(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_orderdate").alias("recorded_at"))
    return R.precedents(d, ["F", "1-URGENT"], 20).select("id", "similarity")


@add("r15_public_search", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' AND lower(text) LIKE '%the%' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def r15(spark, sf_dir):
    revoked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return R.public_search(docs(spark, sf_dir).select("doc_id", "text"), revoked, ["license", "the"], "doc_id", "text").select("doc_id")


@add("f14_longest_prefix", "SELECT page_id, coalesce((SELECT arg_max(r, length(p)) FROM (VALUES ('http', 'web'), ('https://', 'secure'), ('https://www', 'www')) t(p, r) WHERE starts_with(url, p)), 'private') AS route FROM pages")
def f14(spark, sf_dir):
    routes = spark.createDataFrame([("http", "web"), ("https://", "secure"), ("https://www", "www")], "prefix string, route string")
    return R.longest_prefix(pages(spark, sf_dir).select("page_id", "url"), routes, "url", "private").select("page_id", "route")


@add("j14_vocabulary_match", "WITH t AS (SELECT DISTINCT p_type AS card, p_type AS term FROM part UNION SELECT DISTINCT 'name:' || p_name, p_name FROM part) SELECT p_partkey AS qid, card, term, 1.0 AS score FROM part, t WHERE contains(lower('is the ' || p_name || ' of ' || p_type || '?'), lower(term))")
def j14(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("is the "), "p_name", F.lit(" of "), "p_type", F.lit("?")).alias("question"))
    terms = p.select(F.col("p_type").alias("card"), F.col("p_type").alias("term")).union(p.select(F.concat(F.lit("name:"), "p_name"), "p_name")).distinct()
    return R.vocabulary_match(q, terms)


@add("f10_node_search", "SELECT c_custkey FROM customer WHERE contains(c_name, '42')")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").contains("42")).select("c_custkey")


@add("s17_page_titles", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '')) AS title FROM pages")
def s17(spark, sf_dir):
    from orrery.sources.documents import page_titles

    return page_titles(pages(spark, sf_dir)).select("page_id", "title")


@add("j10_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def j10(spark, sf_dir):
    from orrery.sources.documents import page_links

    return page_links(pages(spark, sf_dir))
