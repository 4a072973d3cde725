"""Queries of the metrics layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.plans import semantic
from orrery.plans.catalog import add
from orrery.plans.model import Release, Resource
from orrery.plans.semantic import Binding, Filter, Intent
from orrery.session import table


def _resources(dataset: str, metrics: dict[str, tuple[str, str]], dimensions: list[str]) -> list[Resource]:
    base = f"sem://demo/sales/physicaldataset/{dataset}"
    out = [Resource(base, "PhysicalDataset", dataset, spec={"physical_name": dataset})]
    for name, (kind, measure) in metrics.items():
        out.append(Resource(f"sem://demo/sales/metric/{name}", "Metric", name, depends_on=(base,), spec={"aggregation": kind, "measure": measure}))
    for d in dimensions:
        out.append(Resource(f"sem://demo/sales/dimension/{d}", "Dimension", d, depends_on=(base,), spec={"field": d, "data_type": "string"}))
    return out


LINEITEM = Release(
    "r1",
    tuple(
        _resources(
            "lineitem",
            {
                "revenue": ("sum", "l_extendedprice"),
                "order-count": ("count_distinct", "l_orderkey"),
                "line_count": ("count", "*"),
                "avg_qty": ("avg", "l_quantity"),
                "min_ship": ("min", "l_shipdate"),
                "max_tax": ("max", "l_tax"),
            },
            ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"],
        )
    ),
)


def _run(spark, sf_dir, intent):
    return semantic.run(semantic.compile_intent(LINEITEM, intent), table(spark, sf_dir, "lineitem"))


@add(
    "a1_metric_aggregates",
    """SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS revenue, count(DISTINCT l_orderkey) AS order_count, count(*) AS line_count,
              avg(l_quantity) AS avg_qty, min(l_shipdate) AS min_ship, max(l_tax) AS max_tax
       FROM lineitem GROUP BY ALL ORDER BY 1, 2""",
)
def a1(spark, sf_dir):
    return _run(spark, sf_dir, Intent(("revenue", "order-count", "line_count", "avg_qty", "min_ship", "max_tax"), ("l_returnflag", "l_linestatus")))


@add("a2_global_aggregate", "SELECT sum(l_extendedprice) AS revenue, count(*) AS line_count FROM lineitem")
def a2(spark, sf_dir):
    return _run(spark, sf_dir, Intent(("revenue", "line_count")))


@add(
    "f2_semantic_filters",
    """SELECT l_returnflag, sum(l_extendedprice) AS revenue, count(*) AS line_count FROM lineitem
       WHERE l_linestatus IN ('F', 'O') AND l_quantity >= 10 AND l_quantity < 40 AND l_returnflag <> 'A' AND l_shipdate > TIMESTAMP '1994-01-01'
       GROUP BY ALL ORDER BY 1 LIMIT 5""",
)
def f2(spark, sf_dir):
    filters = (
        Filter("l_quantity", "gte", 10.0),
        Filter("l_quantity", "lt", 40.0),
        Filter("l_returnflag", "ne", "A"),
        Filter("l_linestatus", "in", ["F", "O"]),
        Filter("l_shipdate", "gt", dt.datetime(1994, 1, 1)),
    )
    return _run(spark, sf_dir, Intent(("revenue", "line_count"), ("l_returnflag",), filters, 5))


@add("t1_semantic_order_limit", "SELECT l_shipdate, count(*) AS line_count FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20")
def t1(spark, sf_dir):
    return _run(spark, sf_dir, Intent(("line_count",), ("l_shipdate",), (), 20))


@add(
    "j23_bound_star_join",
    """SELECT n_name, r_name, sum(o_totalprice) AS revenue, count(*) AS orders FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def j23_star(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # The two small tables have a row a nation and region of the world: Spark broadcasts them by their size on disk.
    by_customer = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    j = semantic.bind(by_customer, t("customer").select("c_custkey", "c_nationkey"), Binding("inner", (("o_custkey", "c_custkey"),)))
    j = j.groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    j = semantic.bind(j, t("nation"), Binding("inner", (("c_nationkey", "n_nationkey"),)))
    j = semantic.bind(j, t("region"), Binding("inner", (("n_regionkey", "r_regionkey"),)))
    return j.groupBy("n_name", "r_name").agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))


@add("j23_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS has_large FROM customer")
def j23_semi(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey")
    on = (("c_custkey", "o_custkey"),)
    yes = semantic.bind(customer, large, Binding("left_semi", on)).withColumn("has_large", F.lit(True))
    return yes.unionByName(semantic.bind(customer, large, Binding("left_anti", on)).withColumn("has_large", F.lit(False)))


@add(
    "j23_as_of",
    """SELECT p.event_id, p.user_id, v.ts AS view_ts, v.value AS view_value FROM (FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def j23_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("view_value")).select("user_id", F.col("ts").alias("view_ts"), "view_value")
    return semantic.as_of(p, v, ["user_id"], ["user_id"], "ts", "view_ts").select("event_id", "user_id", "view_ts", "view_value")


@add(
    "j23_range_join",
    """WITH b AS (SELECT l_returnflag AS flag, min(l_quantity) AS low, avg(l_quantity) AS high FROM lineitem GROUP BY 1)
       SELECT flag, count(*) AS n FROM lineitem JOIN b ON l_returnflag = flag AND l_quantity >= low AND l_quantity < high GROUP BY 1""",
)
def j23_range(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    bands = line.groupBy(F.col("l_returnflag").alias("flag")).agg(F.min("l_quantity").alias("low"), F.avg("l_quantity").alias("high"))
    # Counted by value first: the join then meets one row for each flag and quantity, not each line.
    counted = line.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    joined = semantic.bind(counted, bands, Binding("range", (("l_returnflag", "flag"),), "l_quantity", "low", "high"))
    return joined.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("n").alias("n"))


@add("a26_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS g, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a26(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("int").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@add("a26_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a26c(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@add("a25_exact_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a25(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@add(
    "n14_ranking_frames",
    """SELECT o_orderkey, row_number() OVER w AS rn, sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, lag(o_orderkey) OVER w AS before
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def n14(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.sum("o_totalprice").over(w.rowsBetween(-2, 0)).alias("moving"), F.lag("o_orderkey").over(w).alias("before"))


@add(
    "u10_set_operators",
    """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""",
)
def u10(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@add(
    "a19_finance_variance",
    """SELECT n_name AS region, strftime(o_orderdate, '%Y-%m') AS period, sum(coalesce(o_totalprice, 0)) - sum(coalesce(c_acctbal, 0)) AS variance,
              sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS outstanding
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def a19(spark, sf_dir):
    from orrery.operators.metrics import finance_variance

    t = lambda n: table(spark, sf_dir, n)
    facts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = facts.select(F.col("n_name").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("revenue"), F.col("c_acctbal").alias("budget"), F.col("c_acctbal").alias("outstanding"))
    return finance_variance(facts)
