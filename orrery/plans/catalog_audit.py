"""Queries over events as audit records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orrery.operators import audit, metrics
from orrery.plans.catalog import add
from orrery.session import table

SQL = """(SELECT event_id, ts, user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
          json_extract_string(props, '$.k') AS client_ip, value AS duration_ms FROM events)"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), F.get_json_object("props", "$.k").alias("client_ip"), F.col("value").alias("duration_ms")
    )


@add("f5_audit_filter", f"SELECT event_id, user_id, action FROM {SQL} WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' AND status = 'success' AND action IN ('click', 'view', 'purchase') AND action ILIKE '%IC%'")
def f5(spark, sf_dir):
    return audit.audit_filter(events(spark, sf_dir), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12), {"status": "success"}, ["click", "view", "purchase"], "IC").select("event_id", "user_id", "action")


@add("t6_audit_page", f"SELECT event_id, ts FROM {SQL} ORDER BY ts DESC, event_id LIMIT 51 OFFSET 100")
def t6(spark, sf_dir):
    return audit.page(events(spark, sf_dir).select("event_id", "ts"), 100, 51, [F.desc("ts"), F.asc("event_id")])


@add("a3_activity", f"SELECT action, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (status = 'failure') AS errors, sum(coalesce(duration_ms, 0)) / count(*) AS avg_duration FROM {SQL} GROUP BY 1")
def a3(spark, sf_dir):
    return audit.activity(events(spark, sf_dir), "action")


@add("a3_hour_histogram", f"SELECT h.hour::INT AS hour, count(e.event_id) AS n FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN {SQL} e ON hour(e.ts) = h.hour GROUP BY 1")
def a3h(spark, sf_dir):
    return audit.hour_histogram(events(spark, sf_dir))


@add("a3_top_users", f"SELECT user_id, count(*) AS n FROM {SQL} GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def a3t(spark, sf_dir):
    return audit.top(events(spark, sf_dir), "user_id")


@add("a4_frequent_failures", f"SELECT action, count(*) AS n, min(ts) AS first, max(ts) AS last FROM {SQL} WHERE status = 'failure' GROUP BY 1 HAVING count(*) >= 3")
def a4(spark, sf_dir):
    return audit.frequent_failures(events(spark, sf_dir), 3)


@add(
    "a5_login_anomalies",
    f"""WITH i AS (SELECT user_id, client_ip, count(*) AS n, count(*) FILTER (hour(ts) < 6 OR hour(ts) > 22) AS odd, count(*) FILTER (status = 'failure') AS f FROM {SQL} GROUP BY ALL),
        u AS (SELECT user_id, sum(n) AS n, max(n) AS most, sum(odd) AS odd_hours, sum(f) AS f FROM i GROUP BY 1 HAVING sum(n) >= 5)
        SELECT u.user_id, u.n::BIGINT AS n, odd_hours::BIGINT AS odd_hours, count(*) FILTER (i.n < greatest(1, most // 3)) AS rare_ips, any_value(u.f / u.n > 0.3) AS failing FROM u JOIN i USING (user_id) GROUP BY ALL""",
)
def a5(spark, sf_dir):
    return audit.anomalies(events(spark, sf_dir))


@add("a6_security_report", f"SELECT ts::DATE AS day, count(*) AS n, round(100 * count(*) FILTER (status <> 'failure') / count(*), 2) AS success_pct, count(*) FILTER (status = 'failure') / count(*) > 0.1 AS alert FROM {SQL} GROUP BY 1")
def a6(spark, sf_dir):
    return audit.security_report(events(spark, sf_dir))


@add("a8_nearest_rank", f"SELECT action, count(duration_ms) AS n, list_sort(list(duration_ms))[1 + round_even((count(duration_ms) - 1) * 0.5, 0)::INT] AS p50, list_sort(list(duration_ms))[1 + round_even((count(duration_ms) - 1) * 0.95, 0)::INT] AS p95 FROM {SQL} WHERE duration_ms IS NOT NULL GROUP BY 1")
def a8(spark, sf_dir):
    return audit.nearest_rank(events(spark, sf_dir), "action", "duration_ms", (0.5, 0.95))


@add(
    "a9_slo",
    f"""WITH r AS (SELECT action, count(*) FILTER (status = 'failure') / count(*) AS error_rate, list_sort(list(duration_ms)) AS v FROM {SQL} GROUP BY 1)
        SELECT action, error_rate, v[1 + round_even((len(v) - 1) * 0.5, 0)::INT] AS p50, v[1 + round_even((len(v) - 1) * 0.95, 0)::INT] AS p95, v[1 + round_even((len(v) - 1) * 0.99, 0)::INT] AS p99,
               error_rate > 0.01 AS error_breach, v[1 + round_even((len(v) - 1) * 0.95, 0)::INT] > 80 AS latency_breach FROM r""",
)
def a9(spark, sf_dir):
    return audit.slo(events(spark, sf_dir), "action", 0.01, 80.0)


@add("f7_log_minimisation", "SELECT 'sha256:' || substr(sha256(c_name), 1, 16) AS username, CASE WHEN length(c_mktsegment) <= 4 THEN '****' ELSE substr(c_mktsegment, 1, 2) || '****' || substr(c_mktsegment, -2, 2) END AS token, c_custkey FROM customer")
def f7(spark, sf_dir):
    return audit.minimise(table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_mktsegment").alias("token"), "c_custkey"))


@add("f8_value_class", "SELECT doc_id, CASE WHEN lower(text) LIKE '%sk-%' OR lower(text) LIKE '%bearer %' OR lower(text) LIKE '%-----begin%' THEN 'restricted' ELSE 'public' END AS class FROM documents")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", audit.value_class(F.col("text")).alias("class"))


@add("f9_leak_check", "SELECT s AS sentinel, (SELECT count(*) FROM part WHERE contains(p_name, s) OR contains(p_brand, s) OR contains(p_type, s)) > 0 AS leaked FROM (SELECT unnest(['SENTINEL-', 'ring', 'Brand#1']) AS s)")
def f9(spark, sf_dir):
    """Marks that are in no string of a table, and marks that are."""
    part, rows = table(spark, sf_dir, "part"), []
    for mark in ("SENTINEL-", "ring", "Brand#1"):
        try:
            audit.leak_check(part, mark).count()
            rows.append((mark, False))
        except Exception as e:  # noqa: BLE001 - the error of the job tells
            if "a sentinel leaked" not in str(e):
                raise
            rows.append((mark, True))
    return spark.createDataFrame(rows, "sentinel string, leaked boolean")


@add("f15_retention", f"SELECT event_id, (floor(epoch_us(TIMESTAMP '2024-02-01') / 86400000000 - epoch_us(ts) / 86400000000 - t.ttl) + 1)::BIGINT AS expired_by FROM {SQL} e JOIN (VALUES ('click', 7), ('view', 14), ('error', 28)) t(a, ttl) ON e.action = t.a WHERE (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000 >= t.ttl")
def f15(spark, sf_dir):
    return audit.expired(events(spark, sf_dir), {"click": 7, "view": 14, "error": 28}, dt.datetime(2024, 2, 1), "action").select("event_id", "expired_by")


@add("w6_csv_guard", "SELECT doc_id, sha256(CASE WHEN regexp_matches(ltrim(text), '^[=+\\-@\\t\\r]') THEN '''' ELSE '' END || text) AS cell FROM documents")
def w6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(audit.csv_guard(F.col("text")), 256).alias("cell"))


@add("n12_bounded_history", f"SELECT user_id, event_id FROM {SQL} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20")
def n12(spark, sf_dir):
    return audit.last_n(events(spark, sf_dir).select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.asc("event_id")], 20).select("user_id", "event_id")


@add("z10_rate_limit", f"SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 3 AS allowed FROM {SQL} WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def z10(spark, sf_dir):
    return audit.within_rate(events(spark, sf_dir), "user_id", 3600, 3).select("event_id", "in_window", "allowed")


@add("a17_quota", "SELECT c_custkey, 100000.0::DOUBLE AS \"limit\", coalesce(sum(o_totalprice), 0) AS used, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 0) AS reserved, round(100 * coalesce(sum(o_totalprice), 0) / 100000.0, 2) AS percent, 100000.0 - coalesce(sum(o_totalprice), 0) - coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 0) AS available FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a17(spark, sf_dir):
    usage = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0).alias("reserved"))
    return audit.quota(usage, table(spark, sf_dir, "customer").select("c_custkey", F.lit(100000.0).alias("limit")), "c_custkey")


@add("a13_weighted_score", "SELECT l_orderkey, l_linenumber, round(l_discount * 0.4 + l_quantity * 0.5 + l_tax * 0.2, 2) AS score FROM lineitem")
def a13(spark, sf_dir):
    return metrics.weighted_score(table(spark, sf_dir, "lineitem"), {"l_quantity": 0.5, "l_discount": 0.4, "l_tax": 0.2}).select("l_orderkey", "l_linenumber", "score")


@add("a16_buckets", "SELECT CASE WHEN lower(text) LIKE '%license%' OR lower(text) LIKE '%copyright%' THEN 'legal' WHEN lower(text) LIKE '%@%' THEN 'contact' ELSE 'other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def a16(spark, sf_dir):
    return metrics.buckets(table(spark, sf_dir, "documents"), "text", [("legal", ["license", "copyright"]), ("contact", ["@"])])


@add("a18_pass_rates", "SELECT lang, count(*) AS n, avg((n_chars > 100)::INT) AS long_enough, avg((n_chars < 8000)::INT) AS short_enough, avg((n_chars > 100 AND n_chars < 8000)::INT) AS all_checks FROM documents GROUP BY 1")
def a18(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") > 100).alias("long_enough"), (F.col("n_chars") < 8000).alias("short_enough"))
    return metrics.pass_rates(d, "lang", ["long_enough", "short_enough"])


@add(
    "a20_class_stability",
    """WITH a AS (SELECT DISTINCT o_orderpriority AS c, o_custkey AS i FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT o_orderpriority AS c, o_custkey AS i FROM orders WHERE o_orderkey % 3 <> 1),
       j AS (SELECT coalesce(a.c, b.c) AS c, a.i IS NOT NULL AS was, b.i IS NOT NULL AS now FROM a FULL JOIN b ON a.c = b.c AND a.i = b.i)
       SELECT c AS o_orderpriority, count(*) FILTER (now) AS n, count(*) FILTER (NOT was) / count(*) FILTER (now) AS saturation_gap, count(*) FILTER (NOT (was AND now)) / count(*) AS instability FROM j GROUP BY 1""",
)
def a20(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return metrics.stability(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"), "o_orderpriority", "o_custkey")


@add(
    "a12_attribution",
    """WITH it AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, value AS score, event_type FROM events),
       f AS (SELECT run, event_type AS asset, min(number) AS first, count(*) AS n_changes FROM it GROUP BY ALL)
       SELECT it.run, asset, round(avg(score) FILTER (number < first), 7) AS before, round(avg(score) FILTER (number >= first), 7) AS after, any_value(n_changes) AS n_changes,
              round(coalesce(avg(score) FILTER (number >= first), 0) - coalesce(avg(score) FILTER (number < first), 0), 7) AS improvement, least(any_value(n_changes) * 0.2::DOUBLE, 1.0::DOUBLE) AS confidence FROM it JOIN f ON it.run = f.run GROUP BY ALL""",
)
def a12(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    it = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("number"), F.col("value").alias("score"), F.col("event_type").alias("asset"), F.col("event_type").alias("change_type"))
    out = metrics.attribution(it.select("run", "number", "score"), it.select("run", "number", "asset", "change_type"))
    return out.withColumns({c: F.round(c, 7) for c in ("before", "after", "improvement")})


@add("a22_review_summary", "SELECT event_type AS state, count(*) AS resources, sum(k) AS findings, sum(k // 2) AS waived, sum(k - k // 2) AS unresolved FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def a22(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("resource"), "ts", F.col("event_id").alias("review_id"), F.col("event_type").alias("state"), k.alias("findings"), F.floor(k / 2).alias("waived"))
    return metrics.review_summary(r)


@add("z17_checkpoint_drift", "WITH s AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, s.n AS stored, a.n AS actual FROM s FULL JOIN a USING (user_id) WHERE s.n IS DISTINCT FROM a.n")
def z17(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    count = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return audit.checkpoint_drift(count(e.where("event_id % 50 <> 0")), count(e), "user_id", "n")


@add("a14_counts_by_kind", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a14(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
