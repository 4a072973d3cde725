"""Audit and service-level analytics over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Field names by class of protection, and beginnings of values that are always restricted.
RESTRICTED = ("password", "secret", "token", "api_key", "apikey", "authorization", "private_key")
CONFIDENTIAL = ("email", "phone", "username", "client_ip", "user_id", "address")
SECRET_MARKS = ("sk-", "bearer ", "-----begin")


def audit_filter(events: DataFrame, since=None, until=None, equal: dict | None = None, actions: list[str] | None = None, keyword: str | None = None, columns: tuple[str, ...] = ("action", "error_message", "username")) -> DataFrame:
    """inclusive time range, equalities, a set of actions, a keyword in any of some columns."""
    tests = []
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since))
    if until is not None:
        tests.append(F.col("ts") <= F.lit(until))
    tests += [F.col(c) == v for c, v in (equal or {}).items()]
    if actions:
        tests.append(F.col("action").isin(actions))
    if keyword:
        tests.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{keyword}%") for c in columns if c in events.columns]))
    return events.where(reduce(lambda a, b: a & b, tests)) if tests else events


def page(events: DataFrame, offset: int, limit: int, order: list[Column]) -> DataFrame:
    """A page, newest first; one row more than asked for tells that there are others."""
    return events.orderBy(*order).offset(offset).limit(limit)


def activity(events: DataFrame, by: str) -> DataFrame:
    """A3: rows, users, failures and mean duration (over all rows, null as 0) by a column."""
    return events.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("status") == "failure").alias("errors"),
        (F.sum(F.coalesce("duration_ms", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_duration"),
    )


def hour_histogram(events: DataFrame) -> DataFrame:
    """A3: 24 rows, hours without events at 0."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def top(events: DataFrame, by: str, k: int = 10) -> DataFrame:
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), by).limit(k)


def frequent_failures(events: DataFrame, least: int) -> DataFrame:
    """A4."""
    out = events.where("status = 'failure'").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.where(F.col("n") >= least).orderBy(F.desc("n"), "action")


def anomalies(events: DataFrame, least: int = 5) -> DataFrame:
    """A5: per user with enough events: odd hours (before 6, after 22), rare addresses, failure share above 30 %.

    An address is rare if the user has it less often than max(1, a third of the count of the commonest). Counts are
    combined map-side; the second aggregation sees a row for each user and address.
    """
    by_ip = events.groupBy("user_id", "client_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.hour("ts") < 6) | (F.hour("ts") > 22)).alias("odd"),
        F.count_if(F.col("status") == "failure").alias("failures"),
    )
    per_user = by_ip.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("odd").alias("odd_hours"), F.sum("failures").alias("failures"))
    per_user = per_user.where(F.col("n") >= least)
    limit = F.greatest(F.lit(1), F.floor(F.col("most") / 3))
    rare = by_ip.join(per_user.select("user_id", limit.alias("limit")), "user_id").groupBy("user_id").agg(F.count_if(F.col("n") < F.col("limit")).alias("rare_ips"))
    return per_user.join(rare, "user_id").select("user_id", "n", "odd_hours", "rare_ips", (F.col("failures") / F.col("n") > 0.3).alias("failing"))


def security_report(events: DataFrame, failure_alert: float = 0.1) -> DataFrame:
    """Success rate in percent and alerts, by day."""
    out = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.count_if(F.col("status") != "failure") / F.count(F.lit(1)), 2).alias("success_pct"), (F.count_if(F.col("status") == "failure") / F.count(F.lit(1))).alias("share")
    )
    return out.select("day", "n", "success_pct", (F.col("share") > failure_alert).alias("alert"))


def nearest_rank(df: DataFrame, by: str, value: str, ps: tuple[float, ...]) -> DataFrame:
    """The value at round-half-even((n - 1) * p) of the sorted values, exact and without collecting a group.

    Values are counted first, so a group's rows are its distinct values; running counts find the one that covers
    the rank.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    run = counted.select(by, value, F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("n"))
    at = [F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps]
    return run.groupBy(by).agg(F.max("n").alias("n"), *at)


def slo(events: DataFrame, by: str, error_target: float, p95_target: float) -> DataFrame:
    """Error rate and percentiles against targets."""
    ranks = nearest_rank(events, by, "duration_ms", (0.5, 0.95, 0.99))
    rate = events.groupBy(by).agg((F.count_if(F.col("status") == "failure") / F.count(F.lit(1))).alias("error_rate"))
    return rate.join(ranks, by).select(by, "error_rate", "p50", "p95", "p99", (F.col("error_rate") > error_target).alias("error_breach"), (F.col("p95") > p95_target).alias("latency_breach"))


def value_class(c: Column) -> Column:
    """F8: restricted if a secret's mark is in it."""
    low = F.lower(c)
    return F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in SECRET_MARKS]), "restricted").otherwise("public")


def mask(c: Column) -> Column:
    """ab****yz, or **** for four characters and fewer."""
    return F.when(F.length(c) <= 4, "****").otherwise(F.concat(F.substring(c, 1, 2), F.lit("****"), F.substring(c, -2, 2)))


def pseudonym(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c, 256), 1, 16))


def minimise(df: DataFrame) -> DataFrame:
    """every string column by the class of its name; arrays of strings by element."""
    out = []
    for f in df.schema:
        kind, low = f.dataType.simpleString(), f.name.lower()
        rule = mask if low in RESTRICTED else pseudonym if low in CONFIDENTIAL else None
        if rule is None or kind not in ("string", "array<string>"):
            out.append(F.col(f.name))
        else:
            out.append((F.transform(f.name, rule) if kind.startswith("array") else rule(F.col(f.name))).alias(f.name))
    return df.select(*out)


def leak_check(df: DataFrame, sentinel: str) -> DataFrame:
    """raises when a string holds the sentinel."""
    strings = [F.col(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
    found = reduce(lambda a, b: a | b, [F.coalesce(c.contains(sentinel), F.lit(False)) for c in strings], F.lit(False))
    return df.where(F.when(found, F.raise_error(F.lit("a sentinel leaked"))).otherwise(F.lit(True)).cast("boolean"))


def expired(df: DataFrame, ttl: dict[str, int], now, class_col: str = "class", ts_col: str = "ts") -> DataFrame:
    """rows whose age in days reaches the time to live of their class. The table of classes is a literal map."""
    days = F.create_map(*[F.lit(x) for kv in sorted(ttl.items()) for x in kv])
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts_col).cast("timestamp"))) / F.lit(86_400_000_000)
    out = df.withColumn("ttl", days[F.col(class_col)]).withColumn("age", age)
    return out.where(F.col("age") >= F.col("ttl")).withColumn("expired_by", (F.floor(F.col("age") - F.col("ttl")) + 1).cast("long")).drop("ttl", "age")


def csv_guard(c: Column) -> Column:
    """A quote before cells that a spreadsheet would run."""
    return F.when(F.ltrim(c).rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n latest rows of each key (limited before the shuffle)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def within_rate(df: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Z10, batch form: whether at most ``most`` requests of the key fall into the window that ends at each."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_window") <= most)


def checkpoint_drift(stored: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Stored counters that differ from the counted ones."""
    a, s = actual.select(key, F.col(value).alias("actual")), stored.select(key, F.col(value).alias("stored"))
    return s.join(a, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("actual")))


def quota(usage: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Used, limit, percent, available."""
    used = usage.groupBy(key).agg(F.sum("amount").alias("used"), F.sum("reserved").alias("reserved"))
    out = limits.join(used, key, "left").select(key, "limit", F.coalesce("used", F.lit(0.0)).alias("used"), F.coalesce("reserved", F.lit(0.0)).alias("reserved"))
    return out.withColumn("percent", F.round(100 * F.col("used") / F.col("limit"), 2)).withColumn("available", F.col("limit") - F.col("used") - F.col("reserved"))
