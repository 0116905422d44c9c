"""Queries over statistics, workload shaping and execution metrics."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.catalogue import CATEGORIES
from tessera.functions.classify import OPERATORS, functions_of, plain_name
from tessera.functions.taxonomy import by_spelling
from tessera.operators import execution, statistics, workload
from tessera.operators.graph import JoinQuery, KeyGraph
from tessera.operators.predicates import PredicateMaker, random_tree
from tessera.plans.augment import ShapeClient, augment
from tessera.plans.shapes import JOINS
from tessera.registry import register
from tessera.sources.tables import TABLES, columns_of, read, schema_classes, type_class
from tessera.sources.tables import register as register_tables

BINS = 10
#: Columns whose statistics are queried, by table and type class.
PROFILED = {
    "num": ("lineitem", ("l_quantity", "l_extendedprice", "l_discount")),
    "int": ("lineitem", ("l_orderkey", "l_linenumber", "l_suppkey")),
    "str": ("part", ("p_name", "p_brand", "p_type")),
    "ts": ("orders", ("o_orderdate",)),
}


def _freq(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    table, columns = PROFILED[kind]
    return statistics.frequencies(read(spark, sf_dir, table), list(columns))


def _each(kind: str, sql: str) -> str:
    table, columns = PROFILED[kind]
    return " UNION ALL ".join(sql.format(c=c, t=table) for c in columns)


_QUANTILES = "list_distinct(quantile_disc({c}, [" + ", ".join(f"CAST({i} AS DOUBLE) / {BINS}" for i in range(1, BINS + 1)) + "]))"
for _kind in PROFILED:
    register(f"stats_distinct_nulls_{_kind}", lambda s, d, k=_kind: statistics.counts(_freq(s, d, k)), _each(_kind, "SELECT '{c}' AS \"column\", COUNT(*) AS table_size, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count FROM {t}"))
    register(f"hist_equi_height_{_kind}", lambda s, d, k=_kind: statistics.histogram(_freq(s, d, k), BINS), _each(_kind, f"SELECT '{{c}}' AS \"column\", unnest({_QUANTILES}) AS bound FROM {{t}}"))
    register(
        f"stats_mcv_{_kind}",
        lambda s, d, k=_kind: statistics.common_values(_freq(s, d, k), 5),
        _each(_kind, "SELECT '{c}' AS \"column\", place, value, n FROM (SELECT CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS place, {c} AS value, COUNT(*) AS n FROM {t} GROUP BY {c}) WHERE place <= 5"),
    )
    register(
        f"hist_excl_mcv_{_kind}",
        lambda s, d, k=_kind: statistics.histogram_without_common(_freq(s, d, k), BINS, 5),
        _each(_kind, f"SELECT '{{c}}' AS \"column\", unnest({_QUANTILES}) AS bound FROM {{t}} WHERE {{c}} NOT IN (SELECT {{c}} FROM {{t}} GROUP BY {{c}} ORDER BY COUNT(*) DESC, {{c}} LIMIT 5) HAVING COUNT(*) > 0"),
    )

register(
    "substr_support",
    lambda s, d: statistics.substring_support(read(s, d, "part"), "p_name", 0.1, 5),
    """WITH r AS (SELECT p_partkey, p_name AS s FROM part WHERE p_name IS NOT NULL),
e AS (SELECT DISTINCT p_partkey, substring(s, i, l) AS substring, l FROM r, generate_series(1, 25) a(l), generate_series(1, 40) b(i) WHERE i + l - 1 <= length(s)),
c AS (SELECT substring, CAST(l AS INTEGER) AS length, COUNT(*) AS support FROM e GROUP BY ALL HAVING COUNT(*) >= (SELECT greatest(1, floor(COUNT(*) * 0.1)) FROM r)),
t AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY support DESC, substring) AS place FROM c QUALIFY place <= 5),
u AS (SELECT *, dense_rank() OVER (ORDER BY length) AS nth FROM t QUALIFY nth = length)
SELECT substring, length, support FROM u a WHERE support >= coalesce((SELECT max(support) FROM u b WHERE b.length > a.length), 0)""",
)


def all_stats(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """All statistics of a table, one row per column; common_substrings is null where a column is no string."""
    df = read(spark, sf_dir, table)
    stats = statistics.column_stats(df, table, BINS, 5)
    strings = [f.name for f in df.schema.fields if type_class(f.dataType) == "STRING"]
    mined = [statistics.substring_support(df, c, 0.1, 5).agg(F.sort_array(F.collect_list(F.struct("length", "substring", "support"))).alias("__s"), F.lit(c).alias("column")) for c in strings]
    if not mined:
        return stats.withColumn("common_substrings", F.lit(None).cast("array<struct<substring: string, support: bigint, support_probability: double>>"))
    share = lambda x: F.struct(x["substring"].alias("substring"), x["support"].alias("support"), (x["support"] / F.col("sample_size")).alias("support_probability"))
    return stats.join(reduce(DataFrame.unionByName, mined), "column", "left").select(*stats.columns, F.transform("__s", share).alias("common_substrings"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of a table, one row per column."""
    return all_stats(spark, sf_dir, "customer")


register("column_stats", column_stats)
register(
    "redundant_bins",
    lambda s, d: statistics.histogram(_freq(s, d, "num"), BINS).groupBy("column").agg(F.sort_array(F.collect_list("bound")).alias("h")).select("column", F.posexplode(statistics.redundant_bins(F.col("h"), 23, F.lit(0.0))).alias("pos", "bound")),
    "WITH h AS (" + _each("num", f"SELECT '{{c}}' AS \"column\", list_sort({_QUANTILES}) AS h FROM {{t}}") + """), p AS (SELECT "column", h, CAST(unnest(generate_series(0, 22)) AS INTEGER) AS pos FROM h)
SELECT "column", pos, CASE WHEN pos < (23 % len(h)) * (23 // len(h) + 1) THEN h[CAST(pos // (23 // len(h) + 1) + 1 AS INTEGER)] ELSE h[CAST((23 % len(h)) + (pos - (23 % len(h)) * (23 // len(h) + 1)) // (23 // len(h)) + 1 AS INTEGER)] END AS bound FROM p""",
)


def _stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload table made of orders: a query per order, its price as cardinality, its priority as template."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.floor("o_totalprice").alias("count_star"), F.col("o_orderpriority").alias("query_folder"), F.col("o_orderkey").alias("relative_path"))


_BIN = "CAST(least(ceil(floor(o_totalprice) / (400000 / 20)), 21) AS INTEGER)"
register("bins_equiwidth", lambda s, d: _stand_in(s, d).groupBy(workload.bin_of(F.col("count_star"), 400_000, 20).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_BIN} AS bin, COUNT(*) AS n FROM orders GROUP BY 1")
register("stratified_counts", lambda s, d: workload.cherry_pick(_stand_in(s, d), 400_000, 20, 30).groupBy("bin").agg(F.count(F.lit(1)).alias("n")), f"SELECT bin, least(COUNT(*), 30) AS n FROM (SELECT {_BIN} AS bin FROM orders WHERE floor(o_totalprice) > 0) GROUP BY bin")
register(
    "template_cap",
    lambda s, d: workload.template_cap(_stand_in(s, d), {"1-URGENT": 10, "5-LOW": 3}).groupBy("query_folder").agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("total")),
    "SELECT query_folder, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderpriority AS query_folder, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders) WHERE place <= CASE query_folder WHEN '1-URGENT' THEN 10 WHEN '5-LOW' THEN 3 ELSE 1000000000 END GROUP BY 1",
)
register(
    "log_histogram",
    lambda s, d: workload.log_histogram(_stand_in(s, d), "count_star"),
    "WITH l AS (SELECT log10(floor(o_totalprice)) AS v FROM orders WHERE floor(o_totalprice) > 0), s AS (SELECT min(v) AS lo, max(v) AS hi FROM l) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, COUNT(*) AS n FROM l, s GROUP BY 1",
)
register(
    "collapsed_templates",
    lambda s, d: _stand_in(s, d).groupBy(workload.collapsed_template(F.col("query_folder"), [("1-*", "first"), ("?-H*", "high")]).alias("template")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN o_orderpriority LIKE '1-%' THEN 'first' WHEN o_orderpriority LIKE '_-H%' THEN 'high' ELSE o_orderpriority END AS template, COUNT(*) AS n FROM orders GROUP BY 1",
)
register("numbered_files", lambda s, d: workload.numbered_files(read(s, d, "customer").select(F.col("c_mktsegment").alias("template"), F.col("c_name").alias("name"))), "SELECT c_mktsegment AS template, c_name AS name, c_mktsegment || '-' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) || '.sql' AS new_name FROM customer")
_SCHEMA = "SELECT table_name, column_name, {} FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
register("schema_tables", lambda s, d: s.createDataFrame([(t, c, k) for t, cs in schema_classes(s, d).items() for c, k in cs.items()], "table_name string, column_name string, kind string"), _SCHEMA.format("CASE data_type WHEN 'BIGINT' THEN 'INT' WHEN 'INTEGER' THEN 'INT' WHEN 'DOUBLE' THEN 'FLOAT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIME' ELSE 'OTHER' END AS kind"))
register("schema_columns", lambda s, d: s.createDataFrame([(t, *c) for t in TABLES for c in columns_of(read(s, d, t))], "table_name string, column_name string, type string, nullable boolean"), _SCHEMA.format("CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type, is_nullable = 'YES' AS nullable"))

_UNION = [JOINS["pred_eq"].to_sql(), JOINS["pred_range"].to_sql()]
for _name, _distinct in (("union_of_queries", True), ("union_all_of_queries", False)):
    _sql = workload.union_query(_UNION, _distinct)

    def _run(spark: SparkSession, sf_dir: str, sql: str = _sql) -> DataFrame:
        register_tables(spark, sf_dir)
        return spark.sql(sql)

    register(_name, _run, _sql)
_limited = workload.with_limit("SELECT COUNT(*) AS n FROM orders", 100)
register("limit_wrapped", lambda s, d: (register_tables(s, d, ("orders",)), s.sql(_limited))[1], _limited)


def generated(spark: SparkSession, sf_dir: str, n: int = 6, seed: int = 42) -> list[tuple[JoinQuery, str]]:
    """Random queries along the foreign keys of lineitem, with predicates from the statistics of the tables customer and part; and their signatures."""
    rng, graph = random.Random(seed), KeyGraph()
    stats = [r.asDict(recursive=True) for t in ("customer", "part") for r in all_stats(spark, sf_dir, t).orderBy("column").collect()]
    maker = PredicateMaker(stats)
    out = []
    for part in graph.parts(rng, "lineitem", 3, 0.5, n):
        query = JoinQuery("lineitem", tuple(part))
        tree = random_tree(rng, maker.draw(rng, query.tables, 2), 0.3)
        counted = tuple(f"{t}.{rng.choice(read(spark, sf_dir, t).columns)}" for t in query.tables)
        out.append((JoinQuery("lineitem", tuple(part), tree, counted), graph.signature(part)))
    return out


def synthetic_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random foreign-key queries, each run for its cardinality as a DataFrame and as SQL text, which must agree; without a time limit."""
    register_tables(spark, sf_dir)
    check, rows = execution.Validator(spark, None), []
    for k, (q, s) in enumerate(generated(spark, sf_dir)):
        count, error = check.counted(q.to_sql())
        rows.append((k, q.to_sql(), count, q.to_df(spark, sf_dir).first()[0], s, error))
    return spark.createDataFrame(rows, "query_id int, sql string, count_star long, count_star_df long, subgraph_signature string, error string")


register("synthetic_workload", synthetic_workload)


def plan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of executed queries, from their plans; each is run without a time limit, and one that fails keeps its row."""
    register_tables(spark, sf_dir)
    return execution.outcomes_table(spark, [execution.traced(spark, q.to_sql(), None) for q in JOINS.values()])


register("plan_metrics", plan_metrics)
register("plan_operators", lambda s, d: execution.operator_totals(plan_metrics(s, d)))
register("plan_vocabulary", lambda s, d: execution.vocabulary_totals(plan_metrics(s, d)))


def classify_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and operators of the catalogue's queries by category."""
    from tessera.functions.catalogue import category_queries

    rows = [(name, *f.values()) for name, (sql, _) in category_queries().items() for f in functions_of(sql)]
    return spark.createDataFrame(rows, "query string, category string, subcategory string, name string, expression string").groupBy("category", "subcategory", "name").agg(F.count(F.lit(1)).alias("n"))


register("classify_functions", classify_functions)


def augmented_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base queries brought into random shapes by the offline client, with whether Spark runs them."""
    register_tables(spark, sf_dir)
    check = execution.Validator(spark)
    done = augment(ShapeClient(), {name: q.to_sql() for name, q in JOINS.items()}, 12, check.is_valid)
    return spark.createDataFrame([(a.name, a.shape, a.sql, a.error) for a in done], "name string, shape string, sql string, error string")


register("augmented_workload", augmented_workload)


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier says of a call in each further spelling."""
    rows = [(call, f["category"], f["subcategory"], f["name"]) for call in by_spelling() for f in functions_of(f"SELECT {call}(a, b) FROM t")]
    return spark.createDataFrame(rows, "spelling string, category string, subcategory string, name string")


_SPELT = ", ".join(f"('{call}', '{category}', '{sub}', '{name}')" for call, (category, sub, name) in by_spelling().items())
register("function_spellings", spellings, f"SELECT * FROM (VALUES {_SPELT}) AS v(spelling, category, subcategory, name)")


def _entry(f: dict[str, str]) -> tuple[str, str, str]:
    """A finding as the catalogue would name it."""
    name = f["name"] + ("Over" if (f["category"], f["subcategory"]) == ("window", "aggregate") else "")
    return f["category"], f["subcategory"], plain_name(name)


#: Entries whose examples are composed of other functions, or of brackets, in both engines.
_COMPOSED = ("RegexpSplit", "Week", "ArrayFirst", "ArrayLast", "Dot", "MapSize")


def classified_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's entries that the classifier finds in their examples, Spark's or the other engine's."""
    rows = []
    for group, lines in CATEGORIES.items():
        for name, example, other, _ in lines:
            if name in _COMPOSED:
                continue
            texts = [(example, "spark"), *([(other, "other")] if other and other != "=" else [])]
            found = {_entry(f) for text, dialect in texts for f in functions_of(f"SELECT {text} AS x FROM t", dialect)}
            rows += [e for e in found if f"{e[0]}.{e[1]}" == group and e[2] == plain_name(name)]
    return spark.createDataFrame(sorted(rows), "category string, subcategory string, name string")


_ENTRIES = ", ".join(f"('{g.partition('.')[0]}', '{g.partition('.')[2]}', '{plain_name(name)}')" for g, lines in CATEGORIES.items() for name, *_ in lines if name not in _COMPOSED)
register("classified_catalogue", classified_catalogue, f"SELECT * FROM (VALUES {_ENTRIES}) AS v(category, subcategory, name)")


def operator_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier says of each operator between two columns."""
    rows = [(sign, f["category"], f["subcategory"], f["name"]) for sign in OPERATORS if sign not in ("NOT", "~") for f in functions_of(f"SELECT a {sign} 'b' FROM t", "other")]
    return spark.createDataFrame(rows, "sign string, category string, subcategory string, name string")


_SIGNS = ", ".join(f"('{sign}', '{c}', '{sub}', '{name}')" for sign, (c, sub, name) in OPERATORS.items() if sign not in ("NOT", "~"))
register("operator_signs", operator_signs, f"SELECT * FROM (VALUES {_SIGNS}) AS v(sign, category, subcategory, name)")
