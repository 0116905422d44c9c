"""The relational shapes a workload must contain: each as a DataFrame and as the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import JoinQuery
from tessera.operators.predicates import Tree, leaf
from tessera.operators.rewrites import Aggregate, GroupedQuery, disjoint, diversified
from tessera.plans.catalogue_queries import over_views
from tessera.registry import register
from tessera.sources.tables import FOREIGN_KEYS, read, schema_classes

KEYS = {f"{k.table}.{k.column}": k for k in FOREIGN_KEYS}


def _edges(*names: str):
    return tuple(KEYS[n] for n in names)


def shape(sql: str):
    """Register the decorated DataFrame query under its name with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        register(f.__name__, f, sql)
        return f

    return add


# Inner joins along foreign keys, counted.

_RANGE = leaf("lineitem", "l_quantity", "range", (10.0, 30.0))
_IN = leaf("customer", "c_mktsegment", "in", ("BUILDING", "MACHINERY"))
JOINS = {
    "join_star_count": JoinQuery("lineitem", _edges("lineitem.l_orderkey", "lineitem.l_partkey", "lineitem.l_suppkey"), _RANGE, ("orders.o_orderdate", "part.p_brand", "supplier.s_name")),
    "join_snowflake_count": JoinQuery("lineitem", _edges("lineitem.l_orderkey", "orders.o_custkey", "customer.c_nationkey", "nation.n_regionkey"), Tree("and", (_RANGE, _IN)), ("customer.c_name", "orders.o_orderstatus", "region.r_name")),
    "join_two_paths_count": JoinQuery("lineitem", _edges("lineitem.l_orderkey", "lineitem.l_suppkey", "orders.o_custkey", "customer.c_nationkey", "supplier.s_nationkey"), None, ("nation.n_name", "supplier.s_name")),
    "join_labels_count": JoinQuery("labels", _edges("labels.doc_id"), leaf("documents", "lang", "equality", ("en",)), ("documents.source", "labels.quality")),
    "pred_eq": JoinQuery("orders", _edges("orders.o_custkey"), leaf("orders", "o_orderstatus", "equality", ("F",)), ("customer.c_name", "orders.o_orderkey")),
    "pred_in": JoinQuery("lineitem", _edges("lineitem.l_partkey"), leaf("part", "p_size", "in", (1, 7, 15, 23)), ("part.p_name", "lineitem.l_tax")),
    "pred_range": JoinQuery("orders", _edges("orders.o_custkey"), leaf("customer", "c_acctbal", "range", (0.0, 2500.0)), ("customer.c_name", "orders.o_orderkey")),
    "pred_like": JoinQuery("lineitem", _edges("lineitem.l_partkey"), leaf("part", "p_name", "like", ("ea",)), ("part.p_name", "lineitem.l_tax")),
    "pred_not_like": JoinQuery("lineitem", _edges("lineitem.l_partkey"), leaf("part", "p_type", "not_like", ("A",)), ("part.p_name", "lineitem.l_tax")),
    "pred_or_tree": JoinQuery("lineitem", _edges("lineitem.l_orderkey", "lineitem.l_partkey"), Tree("or", (Tree("and", (_RANGE, leaf("part", "p_size", "range", (1, 20)))), leaf("orders", "o_orderpriority", "equality", ("1-URGENT",)))), ("orders.o_orderkey", "part.p_partkey")),
}
for _name, _query in JOINS.items():
    register(_name, _query.to_df, _query.to_sql())


@shape("SELECT n_name, COUNT(*) AS n, COUNT(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def outer_join_left(spark, sf_dir):
    large = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_orders"))


@shape("SELECT COUNT(*) AS n, COUNT(c_custkey) AS n_left, COUNT(o_orderkey) AS n_right FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey")
def outer_join_full(spark, sf_dir):
    a, b = read(spark, sf_dir, "customer").where("c_acctbal > 0"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return a.join(b, a.c_custkey == b.o_custkey, "full").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_left"), F.count("o_orderkey").alias("n_right"))


@shape("SELECT COUNT(*) AS n, COUNT(c_custkey) AS n_left FROM (SELECT * FROM customer WHERE c_nationkey < 10) c RIGHT JOIN orders ON c_custkey = o_custkey")
def outer_join_right(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_nationkey < 10").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_left"))


@shape("SELECT a.p_brand AS p_brand, COUNT(*) AS n FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY a.p_brand")
def self_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    a, b = part.alias("a"), part.alias("b")
    on = (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(b, on).groupBy(F.col("a.p_brand").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))


@shape("SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey < n_regionkey GROUP BY r_name")
def inequality_join(spark, sf_dir):
    # The left side has one row per region; the join condition has no equality to hash on.
    region = read(spark, sf_dir, "region")
    return region.join(read(spark, sf_dir, "nation"), F.col("r_regionkey") < F.col("n_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@shape("SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 60 DAY")
def range_join(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.expr("o_orderdate + INTERVAL 60 DAY"))).agg(F.count(F.lit(1)).alias("n"))


@shape("SELECT event_id, prev_purchase FROM (SELECT e.event_id, p.event_id AS prev_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts)")
def asof_join(spark, sf_dir):
    # The last purchase at or before each other event of the user: one sorted pass, no join.
    events = read(spark, sf_dir, "events")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("prev_purchase", F.last(bought, ignorenulls=True).over(upto)).where("event_type <> 'purchase'").select("event_id", "prev_purchase")


@shape("SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY c_mktsegment")
def nested_join_in(spark, sf_dir):
    rich = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey")
    return read(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@shape("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
def nested_join_exists(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return read(spark, sf_dir, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@shape("SELECT s_suppkey, s_name FROM supplier SEMI JOIN (SELECT * FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 50) l ON s_suppkey = l_suppkey")
def semi_join(spark, sf_dir):
    these = read(spark, sf_dir, "lineitem").where("l_discount = 0.1D AND l_quantity = 50").select("l_suppkey")
    return read(spark, sf_dir, "supplier").join(these, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@shape("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def antijoin(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return read(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


_NOT_IN = "SELECT COUNT(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)"
register("antijoin_not_in_nulls", over_views(_NOT_IN), _NOT_IN)


@shape("SELECT o_orderkey, o_custkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, AVG(o_totalprice) OVER (PARTITION BY o_custkey) AS mean FROM orders")
def window_function(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    last = by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.sum("o_totalprice").over(last).alias("moving"), F.avg("o_totalprice").over(by).alias("mean"))


_EDGE = """SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n_large, COUNT(nullif(o_orderpriority, '1-URGENT')) AS n_calm,
SUM(CASE WHEN o_totalprice IS NULL THEN 1 WHEN o_totalprice < 0 THEN -1 ELSE 0 END) AS odd, MAX(CAST(o_custkey AS {text})) AS last_text, COUNT(DISTINCT o_orderpriority) AS n_priorities
FROM orders WHERE nullif(o_custkey, 3) IS NOT DISTINCT FROM o_custkey GROUP BY o_orderstatus"""
register("edge_case", over_views("SELECT o_orderstatus, n_large, n_calm, CAST(odd AS BIGINT) AS odd, last_text, n_priorities FROM (" + _EDGE.format(text="STRING") + ")"), "SELECT o_orderstatus, n_large, n_calm, CAST(odd AS BIGINT) AS odd, last_text, n_priorities FROM (" + _EDGE.format(text="VARCHAR") + ")")

_SIMPLE = "WITH RECURSIVE chain(k, hop) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT CAST(k * 2 + 1 AS BIGINT), hop + 1 FROM chain WHERE hop < 10) SELECT k, hop FROM chain"
register("recursive_query_simple", over_views(_SIMPLE), _SIMPLE)
_COMPLEX = "WITH RECURSIVE sizes(s) AS (SELECT 1 UNION ALL SELECT s + 7 FROM sizes WHERE s < 43) SELECT p_brand, COUNT(*) AS n, CAST(SUM(s) AS BIGINT) AS total FROM sizes JOIN part ON p_size = s JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand"
register("recursive_query_complex", over_views(_COMPLEX), _COMPLEX)

# Grouping by one to six keys: plain, ordered and rolled up.

_GROUP_KEYS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_suppkey")
_GROUP_AGGREGATES = (Aggregate("count", "*", "n"), Aggregate("count_distinct", "l_orderkey", "n_orders"), Aggregate("min", "l_shipdate", "first_ship"), Aggregate("max", "l_quantity", "most"))
for _n in (1, 2, 3, 4, 6):
    _keys = _GROUP_KEYS[:_n]
    for _kind, _how, _ordered in (("group_by", "", False), ("group_by_order_by", "", True), ("group_by_rollup", "rollup", False)):
        _q = GroupedQuery("lineitem", _keys, _keys, _GROUP_AGGREGATES, _how, _ordered)
        register(f"{_kind}_{_n}", _q.to_df, _q.sql())
_q = GroupedQuery("orders", ("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "o_orderpriority"), (Aggregate("count", "*", "n"), Aggregate("max", "o_totalprice", "most")), "cube")
register("group_by_cube", _q.to_df, _q.sql())
_SETS = "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
register("grouping_sets", over_views(_SETS), _SETS)

# Rewrites, each as the rewritten query on both sides.

_REWRITE_SCHEMA = {"lineitem": {"l_returnflag": "STRING", "l_linestatus": "STRING", "l_quantity": "FLOAT", "l_shipdate": "TIME", "l_comment_free": "INT", "l_tax": "FLOAT", "l_partkey": "INT"}}
_base = GroupedQuery("lineitem", ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linestatus"), (Aggregate("count", "l_quantity", "n_quantity"), Aggregate("count", "*", "n")))
for _name, _q in (("rewrite_disjoint", disjoint(_base, _REWRITE_SCHEMA)), ("rewrite_diversified", diversified(_base, _REWRITE_SCHEMA, 7))):
    register(_name, _q.to_df, _q.sql())


def _set_query(op: str, distinct: str) -> str:
    return f"SELECT COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 {op}{distinct} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 2000)"


@shape(_set_query("UNION", ""))
def union_distinct(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return a.union(b).distinct().agg(F.count(F.lit(1)).alias("n"))


@shape(_set_query("UNION", " ALL"))
def union_all(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return a.union(b).agg(F.count(F.lit(1)).alias("n"))


@shape(_set_query("INTERSECT", ""))
def intersect(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n"))


@shape(_set_query("EXCEPT", ""))
def except_distinct(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return a.subtract(b).agg(F.count(F.lit(1)).alias("n"))


@shape(_set_query("EXCEPT", " ALL"))
def except_all(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("n"))


def _two_sides(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return a, read(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("k"))


@shape("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_topk(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@shape("SELECT c_custkey, c_acctbal, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
def scalar_subqueries(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    most = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    mean = customer.agg(F.avg("c_acctbal").alias("mean"))
    return customer.crossJoin(F.broadcast(mean)).where("c_acctbal > mean").join(most, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", "most")


@shape("SELECT user_id, MIN(ts) AS began, COUNT(*) AS n FROM (SELECT *, SUM(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY user_id, session")
def sessions(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts").cast("timestamp") - F.lag("ts").over(by).cast("timestamp")
    marked = read(spark, sf_dir, "events").withColumn("starts", F.when(gap <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1))
    return marked.withColumn("session", F.sum("starts").over(by)).groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).drop("session")


__all__ = ["JOINS", "schema_classes"]
