"""A workload's life through the commands, over the smallest tables."""

from __future__ import annotations

import random

import pytest

from tessera.__main__ import COMMANDS, Parameters, main
from tessera.operators.graph import KeyGraph
from tessera.sources.schemas import FACTS, keys_of


def test_schemas():
    assert [len(keys_of(s)) for s in ("tpch", "tpcds", "job")] == [9, 90, 22]
    for schema in ("tpch", "tpcds", "job", "driver"):
        graph = KeyGraph(keys_of(schema))
        assert all(list(graph.parts(random.Random(1), f, 2, 0.9, 2)) for f in FACTS[schema] if graph.of(f))


def test_commands(spark, small, tmp_path):
    first = Parameters(data=small, output=str(tmp_path / "a"), tables=("part", "customer"), bins=5, common_values=3, mine_substrings=("part.p_name",), redundant_length=7)
    stats = COMMANDS["make-histograms"](spark, first)
    assert stats.count() == 11 and all(len(r.redundant_histogram) == 7 for r in stats.collect())
    assert stats.where("common_substrings IS NOT NULL").count() == 1
    made = COMMANDS["synthetic-queries"](spark, Parameters(data=small, output=str(tmp_path / "b"), statistics=str(tmp_path / "a/histogram"), fact_tables=("orders",), signatures=2, max_hops=(1, 2)))
    assert made.count() >= 2 and made.where("count_star < 0").count() == 0 and (tmp_path / "b" / made.first().relative_path).exists()
    kept = COMMANDS["filter-synthetic"](spark, Parameters(output=str(tmp_path / "c"), workload=str(tmp_path / "b/workload"), drop_empty=False, per_bin=3))
    assert 0 < kept.count() <= made.count()
    more = COMMANDS["extensions"](spark, Parameters(data=small, output=str(tmp_path / "d"), workload=str(tmp_path / "b/workload"), requests=3))
    assert more.count() >= 3
    metrics = COMMANDS["get-metrics"](spark, Parameters(data=small, output=str(tmp_path / "e"), workload=str(tmp_path / "d/extensions"), drop_empty=False))
    assert metrics.count() >= 3 and metrics.where("query_plan_size < 1").count() == 0


def test_fix_transform(spark, small, tmp_path):
    there = COMMANDS["export-tables"](spark, Parameters(data=small, output=str(tmp_path / "x"), tables=("region", "nation")))
    assert there.count() == 2 and spark.read.parquet(str(tmp_path / "x/nation")).count() == 25
    rows = [
        ("a", "group_by_1", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey"),
        ("b", "group_by_1", "SELECT n_name FROM nation"),
        ("c", "empty", "SELECT n_name FROM nation WHERE n_nationkey < 0"),
        ("d", "broken", "SELECT FROM WHERE"),
        ("e", "group_by_1", "SELECT COUNT(n_name) AS n FROM nation"),
    ]
    spark.createDataFrame(rows, "relative_path string, query_folder string, sql string").write.parquet(str(tmp_path / "w"))
    p = Parameters(data=small, output=str(tmp_path / "f"), workload=str(tmp_path / "w"), make_disjoint=True, make_diverse=True, most_rows=10)
    fixed = {r.relative_path: r for r in COMMANDS["fix-transform"](spark, p).collect()}
    assert set(fixed) == {"a", "b", "e"} and fixed["a"].changed and "SELECT n_regionkey" not in fixed["a"].sql
    assert spark.sql(fixed["b"].sql).count() == 10 and spark.read.parquet(str(tmp_path / "f/traces")).count() == 3
    few = Parameters(data=small, output=str(tmp_path / "m"), workload=str(tmp_path / "f/fixed"), template_limits={"group_by_1": 2})
    assert COMMANDS["get-metrics"](spark, few).count() == 2


def test_parameters(tmp_path):
    (tmp_path / "p.toml").write_text('bins = 7\ntables = ["part"]\n')
    assert Parameters.read(str(tmp_path / "p.toml")) == Parameters(bins=7, tables=("part",))
    (tmp_path / "p.toml").write_text("nothing = 1\n")
    with pytest.raises(ValueError, match="nothing"):
        Parameters.read(str(tmp_path / "p.toml"))
    assert main(["oops"]) == 2
