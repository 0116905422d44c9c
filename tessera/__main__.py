"""Command line: python -m tessera COMMAND parameters.toml, one command for each stage of a workload's life."""

from __future__ import annotations

import random
import sys
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import execution, rewrites
from tessera.operators import statistics as profile
from tessera.operators import workload as shaping
from tessera.operators.graph import JoinQuery, KeyGraph, kinds
from tessera.operators.predicates import PredicateMaker, random_tree
from tessera.plans.augment import ShapeClient, augment
from tessera.sources.schemas import FACTS, keys_of
from tessera.sources.tables import TABLES, export, read, register, schema_classes


@dataclass(frozen=True)
class Parameters:
    """All commands' parameters; each reads what it needs."""

    data: str = "/root/testdata/sf0.01"
    output: str = "workload"
    schema: str = "driver"
    statistics: str = ""
    workload: str = ""
    tables: tuple[str, ...] = TABLES
    fact_tables: tuple[str, ...] = ()
    bins: int = profile.BINS
    common_values: int = profile.COMMON_VALUES
    redundant_length: int = 0
    mine_substrings: tuple[str, ...] = ()  # table.column
    support: float = 0.1
    per_length: int = 5
    max_hops: tuple[int, ...] = (2,)
    extra_predicates: tuple[int, ...] = (2,)
    retention: tuple[float, ...] = (0.2,)
    keep_edge: tuple[float, ...] = (0.5,)
    least_equality: float = 0.0
    or_probability: float = 0.0
    least_like: float = 0.1
    signatures: int = 5
    variants: int = 1
    upper_bound: int = 1_000_000
    cardinality_bins: int = 10
    per_bin: int = 20
    drop_empty: bool = True
    unions: int = 5
    union_probability: float = 0.5
    requests: int = 20
    retries: int = 1
    most_rows: int = 100
    make_disjoint: bool = False
    make_diverse: bool = False
    template_limits: dict[str, int] = field(default_factory=dict)
    seconds: float = 20.0
    seed: int = 42

    @classmethod
    def read(cls, path: str) -> "Parameters":
        import tomllib

        told = tomllib.loads(Path(path).read_text())
        unknown = told.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"there are no parameters {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def export_tables(spark: SparkSession, p: Parameters) -> DataFrame:
    """The tables of data as temporary views, and written as one folder each under output; existing folders are an error."""
    register(spark, p.data, p.tables)
    return spark.createDataFrame([(t, export(spark.table(t), p.output, t)) for t in p.tables], "table string, path string")


def make_histograms(spark: SparkSession, p: Parameters) -> DataFrame:
    """Statistics of all tables that have columns for them, stored under output."""
    parts = []
    for table in p.tables:
        df = read(spark, p.data, table)
        plain = [c for c, t in df.dtypes if not t.startswith("array")]
        parts.append(profile.column_stats(df.select(*plain), table, p.bins, p.common_values))
    out = reduce(DataFrame.unionByName, parts)
    mined = [
        profile.substring_support(read(spark, p.data, name.split(".")[0]), name.split(".")[1], p.support, p.per_length).agg(
            F.collect_list(F.struct("substring", "support")).alias("s"), F.lit(name.split(".")[0]).alias("table"), F.lit(name.split(".")[1]).alias("column")
        )
        for name in p.mine_substrings
    ]
    if mined:
        share = lambda x: F.struct(x["substring"].alias("substring"), x["support"].alias("support"), (x["support"] / F.col("sample_size")).alias("support_probability"))
        out = out.join(reduce(DataFrame.unionByName, mined), ["table", "column"], "left").withColumn("common_substrings", F.transform("s", share)).drop("s")
    if p.redundant_length:
        filler = F.when(F.col("dtype") == "STRING", "A").when(F.col("dtype") == "TIME", "1970-01-01").otherwise("0")
        out = out.withColumn("redundant_histogram", profile.redundant_bins(F.col("histogram"), p.redundant_length, filler))
    out.write.parquet(f"{p.output}/histogram")
    return spark.read.parquet(f"{p.output}/histogram")


def synthetic_queries(spark: SparkSession, p: Parameters) -> DataFrame:
    """Random foreign-key queries over the parameter grid, with their cardinalities, stored batch by batch."""
    register(spark, p.data)
    check, files, graph = execution.Validator(spark, p.seconds), shaping.QueryFiles(p.output), KeyGraph(keys_of(p.schema))
    stats = [r.asDict(recursive=True) for r in spark.read.parquet(p.statistics).collect()]
    for batch, at in enumerate(shaping.parameter_grid(max_hops=list(p.max_hops), extra=list(p.extra_predicates), retention=list(p.retention), keep=list(p.keep_edge))):
        rng = random.Random(p.seed + batch)  # each batch has joins of its own
        maker, rows = PredicateMaker(stats, at["retention"], p.least_equality, p.least_like), []
        for fact in p.fact_tables or FACTS[p.schema]:
            for template, edges in enumerate(graph.parts(rng, fact, at["max_hops"], at["keep"], p.signatures)):
                for variant in range(p.variants):
                    query = JoinQuery(fact, tuple(edges), counted=())
                    tree = random_tree(rng, maker.draw(rng, query.tables, at["extra"]), p.or_probability)
                    counted = tuple(f"{t}.{rng.choice(read(spark, p.data, t).columns)}" for t in query.tables)
                    sql = JoinQuery(fact, tuple(edges), tree, counted).to_sql()
                    count = check.cardinality(sql)
                    if count < 0:
                        continue
                    path, by = files.in_batch(batch, fact, template, variant, sql), kinds(tree)
                    rows.append((f"{batch}-{fact}-{template}-{variant}", path, sql, count, batch, template, variant, at["extra"], fact, at["max_hops"], at["retention"], p.least_equality, p.or_probability, p.least_like, at["keep"], len(edges), by["range"], by["in"], by["equality"], by["like"], by["not_like"], graph.signature(edges)))
        shaping.append_batch(spark.createDataFrame(rows, shaping.FIELDS), f"{p.output}/workload")
    return spark.read.parquet(f"{p.output}/workload")


def filter_synthetic(spark: SparkSession, p: Parameters) -> DataFrame:
    """The workload without empty results, and some queries of each cardinality bin."""
    out = shaping.cherry_pick(spark.read.parquet(p.workload), p.upper_bound, p.cardinality_bins, p.per_bin, p.drop_empty, p.seed)
    out.write.parquet(f"{p.output}/filtered")
    return spark.read.parquet(f"{p.output}/filtered")


def extensions(spark: SparkSession, p: Parameters) -> DataFrame:
    """Unions of like queries, and base queries brought into other shapes by the offline client; only valid ones."""
    register(spark, p.data)
    check, files = execution.Validator(spark, p.seconds), shaping.QueryFiles(p.output)
    base = [r.asDict() for r in spark.read.parquet(p.workload).orderBy("query_id").collect()]
    rows: list[tuple[Any, ...]] = []
    for k, u in enumerate(shaping.unions(base, p.unions, p.union_probability, p.seed)):
        if check.is_valid(u["sql"])[0]:
            rows.append((files.extension("union", k, u["members"][0], u["sql"]), "union", u["sql"]))
    for a in augment(ShapeClient(), {r["relative_path"]: r["sql"] for r in base}, p.requests, check.is_valid, p.retries, p.seed):
        if a.sql:
            rows.append((files._write(f"{a.shape}/{a.name}", a.sql), a.shape, a.sql))
    spark.createDataFrame(rows, "relative_path string, query_folder string, sql string").write.parquet(f"{p.output}/extensions")
    return spark.read.parquet(f"{p.output}/extensions")


def fix_transform(spark: SparkSession, p: Parameters) -> DataFrame:
    """Queries made disjoint and diverse where asked for, and put under their row limit. Each is run; where its changed form fails,
    the original takes its place, and where that fails too it is left out. Stores the queries (fixed) and their measures (traces)."""
    register(spark, p.data, p.tables)
    check, schema = execution.Validator(spark, p.seconds), schema_classes(spark, p.data, p.tables)
    workload = spark.read.parquet(p.workload)
    if "query_folder" not in workload.columns:
        workload = workload.withColumn("query_folder", F.lit(""))
    rows, traces = [], []
    for k, r in enumerate(workload.orderBy("relative_path").select("relative_path", "query_folder", "sql").collect()):
        sql = r.sql
        if p.make_disjoint:
            try:
                sql = rewrites.disjoint_sql(sql, schema)
            except ValueError:  # no column is left to stand for a key
                sql = r.sql
        if p.make_diverse:
            sql = rewrites.diversified_sql(sql, schema, p.seed + k)
        limited = execution.shape_output(check, sql, p.most_rows, p.drop_empty)
        plain = limited if sql == r.sql else execution.shape_output(check, r.sql, p.most_rows, p.drop_empty)
        if not (limited or plain):
            continue
        found, changed = execution.traced_or_original(spark, limited or plain, plain or limited, p.seconds)
        if found:
            rows.append((r.relative_path, r.query_folder, found.sql, r.sql, found.sql != r.sql and changed))
            traces.append(found)
    spark.createDataFrame(rows, "relative_path string, query_folder string, sql string, original_sql string, changed boolean").write.parquet(f"{p.output}/fixed")
    execution.metrics_table(spark, traces).write.parquet(f"{p.output}/traces")
    return spark.read.parquet(f"{p.output}/fixed")


def get_metrics(spark: SparkSession, p: Parameters) -> DataFrame:
    """Queries under their row limit, run and measured; those that fail are left out."""
    register(spark, p.data)
    check, traces = execution.Validator(spark, p.seconds), []
    workload = spark.read.parquet(p.workload)
    if p.template_limits:
        workload = shaping.template_cap(workload, p.template_limits)
    for r in workload.orderBy("relative_path").select("sql").collect():
        sql = execution.shape_output(check, r.sql, p.most_rows, p.drop_empty)
        found = execution.traced_or_original(spark, sql, r.sql, p.seconds)[0] if sql else None
        traces += [found] if found else []
    execution.metrics_table(spark, traces).write.parquet(f"{p.output}/metrics")
    return spark.read.parquet(f"{p.output}/metrics")


COMMANDS = {"export-tables": export_tables, "make-histograms": make_histograms, "synthetic-queries": synthetic_queries, "filter-synthetic": filter_synthetic, "extensions": extensions, "fix-transform": fix_transform, "get-metrics": get_metrics}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in COMMANDS:
        print(f"{__doc__}\nCommands: {', '.join(COMMANDS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = COMMANDS[args[0]](spark, Parameters.read(args[1]))
    print(f"{out.count()} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
