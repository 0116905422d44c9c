"""Unit tests of the operators that no query shows whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.classify import functions_of
from tessera.operators import execution, rewrites, statistics, workload
from tessera.operators.graph import JoinQuery, KeyGraph, kinds
from tessera.operators.predicates import KINDS, Predicate, PredicateMaker, Tree, leaf, random_tree
from tessera.plans.augment import ShapeClient, augment_batch, augment_one, extract_sql, prompt, sample_queries
from tessera.plans.shapes import JOINS
from tessera.sources.tables import FOREIGN_KEYS, export, read, register, type_class


def test_graph_is_the_same_in_every_run():
    a, b = KeyGraph(), KeyGraph(tuple(reversed(FOREIGN_KEYS)))
    assert a.edges == b.edges and a.is_leaf("region") and not a.is_leaf("lineitem")
    parts = list(a.parts(random.Random(1), "lineitem", 3, 0.5, 5))
    assert parts == list(b.parts(random.Random(1), "lineitem", 3, 0.5, 5))
    assert len({a.signature(p) for p in parts}) == len(parts) == 5
    assert all(len(set(p)) == len(p) for p in parts)
    assert list(a.parts(random.Random(1), "region", 3, 1.0, 5)) == []
    assert len(list(a.parts(random.Random(1), "labels", 3, 1.0, 5))) == 1


def test_edges_that_do_not_hang_together(spark, small):
    keys = {k.table: k for k in FOREIGN_KEYS}
    with pytest.raises(ValueError, match="hang together"):
        JoinQuery("lineitem", (keys["labels"],)).joined(spark, small)


def test_predicates_as_columns_and_as_text(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, None), (4, "it's")], "k int, s string")
    df.createOrReplaceTempView("t")
    for p, keys in ((Predicate("t", "s", "like", ("%",)), [1]), (Predicate("t", "s", "not_like", ("%",)), [2, 4]), (Predicate("t", "s", "equality", ("it's",)), [4]), (Predicate("t", "k", "in", (1, 3)), [1, 3]), (Predicate("t", "k", "range", (2, 3)), [2, 3])):
        assert sorted(r.k for r in df.where(p.column(F.col(p.name))).collect()) == keys
        assert sorted(r.k for r in spark.sql(f"SELECT k FROM t WHERE {p.sql()}").collect()) == keys


def test_predicate_maker():
    stats = [
        {"table": "t", "column": "n", "dtype": "INT", "distinct_count": 9, "sample_size": 10, "histogram": [str(i) for i in range(10)], "most_common_values": [{"value": "3", "count": 5}], "histogram_mcv": ["1", "2"], "common_substrings": None},
        {"table": "t", "column": "s", "dtype": "STRING", "distinct_count": 9, "sample_size": 10, "histogram": ["a", "b"], "most_common_values": [], "histogram_mcv": [], "common_substrings": [{"substring": "ab", "support": 5, "support_probability": 0.5}]},
        {"table": "t", "column": "c", "dtype": "INT", "distinct_count": 1, "sample_size": 10, "histogram": ["1"], "most_common_values": [], "histogram_mcv": [], "common_substrings": None},
    ]
    drawn = PredicateMaker(stats).draw(random.Random(2), ["t"], 20)
    assert len(drawn) == 20 and {p.name for p in drawn} == {"n", "s"} and {p.kind for p in drawn} >= {"equality", "in", "range", "like"}
    assert all(p.values[0] < p.values[1] for p in drawn if p.kind == "range")
    assert drawn == PredicateMaker(stats).draw(random.Random(2), ["t"], 20)
    assert PredicateMaker(stats, least_equality=0.6, weights={"equality": 1.0}).draw(random.Random(2), ["t"], 1) == []
    tree = random_tree(random.Random(1), drawn[:5], 0.5)
    assert sorted(map(repr, tree.leaves())) == sorted(map(repr, drawn[:5])) and sum(kinds(tree).values()) == 5 and random_tree(random.Random(1), [], 0.5) is None


def test_statistics_give_all_kinds_of_predicates(spark, small):
    from tessera.plans.workload_queries import all_stats

    names = [r.c_name for r in read(spark, small, "customer").collect()]
    stats = [r.asDict(recursive=True) for t in ("customer", "part") for r in all_stats(spark, small, t).collect()]
    assert {r["column"] for r in stats if r["common_substrings"]} == {r["column"] for r in stats if r["dtype"] == "STRING"}
    (mined,) = [r["common_substrings"] for r in stats if r["column"] == "c_name"]
    assert all(s["support"] == sum(s["substring"] in x for x in names) and s["support_probability"] == s["support"] / len(names) for s in mined)
    assert {p.kind for p in PredicateMaker(stats).draw(random.Random(1), ["customer", "part"], 60)} == set(KINDS)


def test_bins(spark):
    counts = [0, 1, 5, 10, 11, 99, 100, 101, 10_000]
    df = spark.createDataFrame([(c,) for c in counts], "n long").select(workload.bin_of(F.col("n"), 100, 10))
    assert [r[0] for r in df.collect()] == [0, 1, 1, 1, 2, 10, 10, 11, 11]


def test_histograms_of_odd_columns(spark):
    df = spark.createDataFrame([(None, "x")] * 3 + [(1, None)] * 2, "a int, s string")
    freq = statistics.frequencies(df, ["a"])
    assert [tuple(r) for r in statistics.histogram(freq, 4).collect()] == [("a", 1)]
    assert statistics.counts(freq).first().asDict() == {"column": "a", "table_size": 5, "null_count": 3, "distinct_count": 1}
    assert statistics.histogram_without_common(freq, 4, 1).count() == 0
    stats = {r.column: r for r in statistics.column_stats(df, "t", 4, 2).collect()}
    assert stats["s"].histogram == ["x"] and stats["s"].histogram_mcv == [] and stats["s"].most_common_values[0]["count"] == 3
    assert statistics.describe_stats(statistics.column_stats(df, "t", 4, 2)).count() == 2


def test_substrings(spark):
    rows = ["turquoise"] * 60 + ["midnight blue"] * 30 + ["lavender"] * 10
    out = {r.substring: r.support for r in statistics.substring_support(spark.createDataFrame([(r,) for r in rows], "s string"), "s", 0.25, 3).collect()}
    assert out["turquoise"] == 60 and all("lavender" not in s for s in out)


def test_samples_and_caps(spark, small):
    orders = read(spark, small, "orders")
    a, b = (statistics.repeatable_sample(orders.repartition(n), ["o_orderkey"], 17) for n in (2, 5))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 17
    assert workload.template_cap(orders, {}) is orders
    assert len(workload.parameter_grid(a=[1, 2], b=[3, 4, 5])) == 6


def test_unions():
    same = [{"subgraph_signature": "1", "relative_path": str(k), "sql": JOINS[q].to_sql()} for k, q in enumerate(("pred_eq", "pred_range"))]
    found = workload.unions([*same, {"subgraph_signature": "2", "relative_path": "x", "sql": same[0]["sql"]}], 4, 0.0)
    assert len(found) == 1 and " UNION ALL " in found[0]["sql"]
    assert " UNION SELECT" in workload.unions(same, 4, 1.0)[0]["sql"]
    with pytest.raises(ValueError, match="two counted"):
        workload.counted_columns("SELECT COUNT(*), COUNT(a) FROM t")


def test_rewrites():
    q = rewrites.GroupedQuery("t", ("a", "b"), ("a",), (rewrites.Aggregate("count", "*", "n"),))
    schema = {"t": {"a": "INT", "b": "INT", "c": "INT"}}
    out = rewrites.disjoint(q, schema)
    assert not set(out.select) & set(out.keys) and out.aggregates[-1].column == "c"
    with pytest.raises(ValueError, match="no column left"):
        rewrites.disjoint(q, {"t": {"a": "INT", "b": "INT"}})
    assert rewrites.owner_of("t.a", schema) == "t" and rewrites.owner_of("zz", schema) is None
    assert rewrites.diversified(q, schema).aggregates == q.aggregates


def test_limits():
    assert workload.with_limit("SELECT 1;", 5) == "WITH limited AS (SELECT 1) SELECT * FROM limited LIMIT 5"
    assert workload.with_limit("SELECT 1", 0) == "SELECT 1"


def test_files(tmp_path, spark, small):
    files = workload.QueryFiles(str(tmp_path))
    path = files.in_batch(1, "orders", 2, 3, "SELECT 1")
    assert (tmp_path / path).read_text() == "SELECT 1"
    with pytest.raises(FileExistsError):
        files.in_batch(1, "orders", 2, 3, "SELECT 2")
    assert files.query("orders", 1, 1, "x") and files.extension("self_join", 4, "a/b.sql", "x") == "self_join/4_a_b.sql"
    import tomllib

    values = {"a": 1, "b": [1.5, 2.0], "c": 'q"\\\n', "d": True, "e": {"f": "g"}}
    assert tomllib.loads(workload.to_toml(values)) == values
    region = read(spark, small, "region")
    out = export(region, str(tmp_path), "region")
    assert spark.read.parquet(out).count() == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export(region, str(tmp_path), "region")


def test_validation(spark, small):
    register(spark, small)
    check = execution.Validator(spark, 20)
    assert check.is_valid("SELECT * FROM region") == (True, None)
    assert not check.is_valid("SELECT nothing FROM region")[0]
    assert check.output_size("SELECT * FROM nation", 10)[0] == 25 and check.cardinality("SELECT COUNT(*) FROM nation") == 25 and check.cardinality("SELECT oops") == -1
    assert execution.shape_output(check, "SELECT * FROM nation", 10, True).endswith("LIMIT 10")
    assert execution.shape_output(check, "SELECT * FROM nation WHERE n_nationkey < 0", 10, True) is None
    assert execution.shape_output(check, "SELECT * FROM nation WHERE n_nationkey < 0", 0, False)
    late = execution.run_with_timeout(spark, lambda: spark.range(0, 10**12).selectExpr("sum(sin(id))"), 1.0)
    assert not late.ok and "more than" in late.error and late.seconds < 30


def test_failed_queries_keep_their_rows(spark, small, monkeypatch):
    from tessera.plans import workload_queries

    limits, run = [], execution.run_with_timeout

    def first_fails(spark, df_of, seconds, take=None):
        limits.append(seconds)
        return execution.Outcome(False, [], "lost", 1.5) if len(limits) == 1 else run(spark, df_of, seconds, take)

    monkeypatch.setattr(execution, "run_with_timeout", first_fails)
    rows = workload_queries.plan_metrics(spark, small).collect()
    assert len(rows) == len(JOINS) == len(limits) and set(limits) == {None}
    (failed,) = [r for r in rows if not r.trace_success]
    assert (failed.error, failed.latency, failed.operator_distribution) == ("lost", 1.5, None) and failed.query_size_bytes > 0
    assert all(r.error is None and r.query_plan_size > 0 for r in rows if r.trace_success)
    limits.clear()
    rows = workload_queries.synthetic_workload(spark, small).collect()
    assert [(r.count_star, r.error) for r in rows][0] == (-1, "lost") and set(limits) == {None}
    assert all(r.error is None and r.count_star == r.count_star_df for r in rows[1:])
    assert isinstance(execution.traced(spark, "SELECT oops FROM region", 9), execution.Failure)


def test_traces(spark, small):
    register(spark, small)
    sql = JOINS["join_snowflake_count"].to_sql()
    metrics = execution.plan_metrics(execution.trace(spark, sql))
    assert metrics["output_cardinality"] == 1 and metrics["query_plan_size"] > metrics["query_plan_length"] > 4 and metrics["cumulative_rows_scanned"] > 0
    assert metrics["query_keywords"][0] == "SELECT" and any(f["name"] == "Count" for f in metrics["functions"])
    assert execution.traced_or_original(spark, "SELECT oops FROM region", "SELECT 1 AS x")[1] is False


def test_pushdown(spark, small):
    plan = JOINS["pred_range"].to_df(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,0.0)" in plan and "c_mktsegment" not in plan.split("ReadSchema")[1]


def test_classification(spark):
    found = {(f["category"], f["subcategory"], f["name"]) for f in functions_of("SELECT rank() OVER (ORDER BY a), sum(b) OVER (PARTITION BY c), upper(d), count(*), a + 1, CASE WHEN x LIKE 'a(b' THEN 1 END FROM t")}
    assert found >= {("window", "ranking", "Rank"), ("window", "aggregate", "Sum"), ("scalar", "string", "Upper"), ("agg", "core", "Count"), ("scalar", "arithmetic", "Add"), ("conditional", "case", "Case"), ("scalar", "pattern_matching", "Like")}
    assert functions_of("SELECT FROM WHERE (") == []
    named = functions_of("SELECT /* upper( */ `lower(x)`, sum(b) OVER w, current_date, 'trim(y)' FROM t -- min(\nWINDOW w AS (PARTITION BY c)")
    assert [(f["category"], f["name"]) for f in named if f["category"] != "scalar"] == [("window", "Sum")] and [f["expression"] for f in named] == ["sum(b)", "current_date"]


def test_classification_of_signs_and_brackets(spark):
    names = lambda q, dialect="spark": [f["name"] for f in functions_of(q, dialect)]
    assert names("SELECT filter(a, x -> x > -1), sum(b) FILTER (WHERE c > 0), CAST(e AS DECIMAL(10, 2)), f IS NOT DISTINCT FROM g FROM t") == ["ArrayFilter", "Sum", "Cast", "GT", "Neg", "GT", "NullSafeEQ"]
    assert names("WITH c(a) AS (SELECT 1) SELECT a - 1, -a, +a, count(*) FROM c GROUP BY a") == ["Count", "Sub", "Neg"]
    assert names("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x), array_join(a, ','), element_at(a, 1) FROM t") == ["PercentileCont", "ArrayToString", "ElementAt"]
    assert names("SELECT a->>'k', b->'k', c <-> d, e -|- f, g SIMILAR TO 'h' FROM t", "duckdb") == ["JSONExtractScalar", "JSONExtract", "Distance", "Adjacent", "SimilarTo"]
    assert names("SELECT a SIMILAR TO 'h' FROM t") == []  # Spark's parser does not take it


def test_augmentation():
    base = {"a/b.sql": JOINS["pred_eq"].to_sql()}
    sampled = sample_queries(base, 3, examples=2)
    assert len(sampled) == 3 and "```sql" in prompt(sampled[0])[1]["content"]
    assert extract_sql("<think>```sql no```</think> ```sql\nSELECT 1\n``` ```sql\nSELECT 2\n```") == "SELECT 2" and extract_sql("none") is None
    asked = []

    class Fails:
        def query(self, messages):
            asked.append(len(messages))
            return "```sql\nSELECT 1\n```"

    out = augment_one(Fails(), 7, sampled[0], lambda sql: (False, "bad"), retries=2)
    assert out.sql is None and asked == [2, 4, 6] and out.error == "bad" and out.name == "7_a_b.sql"
    rounds = []

    def submit(requests):
        rounds.append(len(requests))
        return {i: ShapeClient().query(m) for i, m in requests.items()}

    done = augment_batch(submit, base, 5, lambda sql: (True, None), chunk=2)
    assert rounds == [2, 2, 1] and all(a.sql for a in done)


def test_types(spark):
    df = spark.sql("SELECT 1 a, 1.5 b, 'x' c, DATE '2020-01-01' d, array(1) e")
    assert [type_class(f.dataType) for f in df.schema.fields] == ["INT", "FLOAT", "STRING", "TIME", "OTHER"]
    assert isinstance(leaf("t", "a", "equality", (1,)), Tree)


def test_streamed_frequencies(spark, small, tmp_path):
    from tessera.streaming.frequency import follow_frequencies

    events = read(spark, small, "events").select("event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow_frequencies(stream, ["event_type"], "followed", str(tmp_path / "at")).awaitTermination()
    same = lambda df: sorted(map(tuple, df.select("column", "value", "n").collect()))
    assert same(spark.table("followed")) == same(statistics.frequencies(events, ["event_type"]))


def test_rewrites_of_text():
    schema = {"t": {"a": "INT", "b": "INT", "c": "TEXT", "d": "INT"}, "u": {"e": "TEXT"}}
    text = "SELECT t.a AS k, COUNT(*), (SELECT max(e) FROM u) FROM t WHERE c <> 'x FROM y, z' GROUP BY t.a HAVING COUNT(b) > 1"
    assert rewrites.disjoint_sql(text, schema) == "SELECT COUNT(t.d) AS count_d, COUNT(*), (SELECT max(e) FROM u) FROM t WHERE c <> 'x FROM y, z' GROUP BY t.a HAVING COUNT(b) > 1"
    for same in ("SELECT a FROM t", "SELECT a, COUNT(*) FROM t GROUP BY a ORDER BY a", "not sql", "", "SELECT 'GROUP BY a' FROM t"):
        assert rewrites.disjoint_sql(same, schema) == same
    with pytest.raises(ValueError, match="no column left"):
        rewrites.disjoint_sql("SELECT e, COUNT(*) FROM u GROUP BY e", schema)
    seen = {rewrites.diversified_sql("SELECT COUNT(t.a), COUNT(*) FROM t", schema, k) for k in range(40)}
    assert seen == {f"SELECT {x}, COUNT(*) FROM t" for x in ("COUNT(t.a)", "COUNT(DISTINCT t.a)", "MIN(t.a)", "MAX(t.a)")}
    assert {rewrites.diversified_sql("SELECT COUNT(c) FROM t HAVING COUNT(a) > 1", schema, k) for k in range(40)} == {f"SELECT {x} FROM t HAVING COUNT(a) > 1" for x in ("COUNT(c)", "COUNT(DISTINCT c)")}
    assert rewrites.diversified_sql("SELECT COUNT(a) OVER () FROM t", schema, 1) == "SELECT COUNT(a) OVER () FROM t"


def test_plan_vocabulary(spark, small):
    """Operators of plans whose shape is known, by their vocabulary names; all names are there."""
    register(spark, small, ("orders", "customer", "nation"))
    of = lambda sql: {k: n for k, n in execution.plan_metrics(execution.trace(spark, sql))["vocabulary_distribution"].items() if n}
    assert len(execution.VOCABULARY) == len(set(execution.VOCABULARY)) == 82
    counted = of("SELECT COUNT(*) FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey")
    assert counted["TABLE_SCAN"] == 3 and counted["HASH_JOIN"] == 2 and counted["UNGROUPED_AGGREGATE"] == 1 and "HASH_GROUP_BY" not in counted
    grouped = of("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC")
    assert grouped["HASH_GROUP_BY"] == 1 and grouped["ORDER_BY"] == 1 and grouped["ROOT"] == grouped["RESULT_COLLECTOR"] == 1
    assert of("SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer")["UNION"] == 1
    assert of("SELECT n_name, rank() OVER (ORDER BY n_regionkey) AS r FROM nation")["WINDOW"] == 1
    assert of("SELECT explode(array(1, 2)) AS x FROM nation")["UNNEST"] == 1
    assert of("SELECT a.n_name FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")["NESTED_LOOP_JOIN"] == 1
