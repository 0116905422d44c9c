"""Running queries under a time limit, and what a run's physical plan shows: shape, operators, rows, estimates and errors."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.vocabulary import VOCABULARY, distribution, kind_of


@dataclass(frozen=True)
class Outcome:
    ok: bool
    rows: list[Any]
    error: str | None = None
    seconds: float = 0.0


def run_with_timeout(spark: SparkSession, df_of, seconds: float | None, take: int | None = None) -> Outcome:
    """Collect (the first take rows of) df_of(); a run past its time (None: no limit) is cancelled by its tag, without a process of its own."""
    tag = f"tessera-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    began = time.monotonic()
    spark.sparkContext.addJobTag(tag)
    if timer:
        timer.start()
    try:
        df = df_of()
        rows = df.take(take) if take is not None else df.collect()
        return Outcome(True, rows, None, time.monotonic() - began)
    except Exception as e:  # noqa: BLE001  any failure of the query is its outcome
        return Outcome(False, [], f"more than {seconds} s" if late.is_set() else str(e).split("\n")[0], time.monotonic() - began)
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class Validator:
    """Whether queries run, how many rows they give, and what they count."""

    def __init__(self, spark: SparkSession, seconds: float | None = 20.0):
        self.spark, self.seconds = spark, seconds

    def is_valid(self, sql: str) -> tuple[bool, str | None]:
        out = run_with_timeout(self.spark, lambda: self.spark.sql(sql).agg(F.count(F.lit(1))), self.seconds)
        return out.ok, out.error

    def output_size(self, sql: str, limit: int) -> tuple[int, str | None]:
        """Rows, counted up to limit + 100."""
        out = run_with_timeout(self.spark, lambda: self.spark.sql(sql).limit(limit + 100).agg(F.count(F.lit(1))), self.seconds)
        return (out.rows[0][0], None) if out.ok else (-1, out.error)

    def cardinality(self, sql: str) -> int:
        """First cell of a counting query, -1 if it fails or runs too long."""
        return self.counted(sql)[0]

    def counted(self, sql: str) -> tuple[int, str | None]:
        """First cell of a counting query, or -1 and why it has none."""
        out = run_with_timeout(self.spark, lambda: self.spark.sql(sql), self.seconds, take=1)
        return (int(out.rows[0][0]), None) if out.ok and out.rows else (-1, out.error or "no rows")


def shape_output(validator: Validator, sql: str, most: int, drop_empty: bool) -> str | None:
    """The query, under a limit if it gives more than most rows (0: any number); None if it fails, or is empty and those go."""
    from tessera.operators.workload import with_limit

    size, error = validator.output_size(sql, most)
    if error or drop_empty and size == 0:
        return None
    return with_limit(sql, most) if most and size > most else sql


@dataclass
class PlanNode:
    """A physical operator: its name, rows put out (if counted), rows estimated (if known), and its inputs."""

    name: str
    rows: int | None
    estimate: int | None
    children: list["PlanNode"] = field(default_factory=list)
    kind: str | None = None  # its name in the vocabulary

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def size(self) -> int:
        return sum(1 for _ in self.walk())

    @property
    def depth(self) -> int:
        """Edges on the longest path down."""
        return 1 + max((c.depth for c in self.children), default=-1)


def _node(jvm: Any, plan: Any) -> PlanNode:
    name = re.split(r"[ (]", plan.nodeName().strip())[0]
    if name == "AdaptiveSparkPlan":
        return _node(jvm, plan.executedPlan())
    if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
        return _node(jvm, plan.plan())
    if name in ("WholeStageCodegen", "InputAdapter"):
        return _node(jvm, plan.children().apply(0))
    metric = plan.metrics().get("numOutputRows")
    link = plan.logicalLink()
    estimate = None
    if link.isDefined():
        count = link.get().stats().rowCount()
        estimate = int(str(count.get())) if count.isDefined() else None
    children = plan.children()
    ungrouped = name.endswith("Aggregate") and plan.groupingExpressions().isEmpty()
    local = name == "Sort" and not getattr(plan, "global")()
    kind = kind_of(name, ungrouped, local, plan.nodeName())
    return PlanNode(name, int(metric.get().value()) if metric.isDefined() else None, estimate, [_node(jvm, children.apply(k)) for k in range(children.size())], kind)


@dataclass(frozen=True)
class Trace:
    sql: str
    plan: PlanNode
    seconds: float
    output_rows: int


@dataclass(frozen=True)
class Failure:
    """A query that failed or ran too long."""

    sql: str
    seconds: float
    error: str


def traced(spark: SparkSession, sql: str, seconds: float | None) -> Trace | Failure:
    """Run a query and read its executed plan; None: no limit."""
    try:
        df: DataFrame = spark.sql(sql)
    except PySparkException as e:
        return Failure(sql, 0.0, str(e).split("\n")[0])
    out = run_with_timeout(spark, lambda: df, seconds)
    if not out.ok:
        return Failure(sql, out.seconds, out.error or "failed")
    return Trace(sql, _node(spark._jvm, df._jdf.queryExecution().executedPlan()), out.seconds, len(out.rows))


def trace(spark: SparkSession, sql: str, seconds: float = 15.0) -> Trace | None:
    """Run a query and read its executed plan; None if it fails or runs too long."""
    found = traced(spark, sql, seconds)
    return found if isinstance(found, Trace) else None


def traced_or_original(spark: SparkSession, changed: str, original: str, seconds: float = 15.0) -> tuple[Trace | None, bool]:
    """The trace of the changed query, or of the original if that fails; and whether the change held."""
    first = trace(spark, changed, seconds) if changed != original else None
    return (first, True) if first else (trace(spark, original, seconds), changed == original)


_TOKEN = re.compile(r"--[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|\d+(?:\.\d+)?|\w+|<=>|[<>!=]=|<>|\|\||[^\s\w]")
KEYWORDS = frozenset(
    "ALL AND ANTI ANY AS ASC BETWEEN BY CASE CAST CROSS CUBE CURRENT DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FILTER FOLLOWING FROM FULL GROUP GROUPING HAVING ILIKE IN INNER INTERSECT INTERVAL IS JOIN"
    " LATERAL LEFT LIKE LIMIT NATURAL NOT NULL NULLS OFFSET ON OR ORDER OUTER OVER PARTITION PRECEDING RANGE RECURSIVE RIGHT ROLLUP ROW ROWS SELECT SEMI SETS THEN UNBOUNDED UNION USING VALUES WHEN WHERE WINDOW WITH".split()
)


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith("--")]


def keywords(sql: str) -> list[str]:
    return [t.upper() for t in tokens(sql) if t.upper() in KEYWORDS]


def _q_error(estimate: int, actual: int) -> float:
    return max((estimate + 1) / (actual + 1), (actual + 1) / (estimate + 1))


def plan_metrics(t: Trace) -> dict[str, Any]:
    """What a trace says of its query; the fields of METRICS."""
    from tessera.functions.classify import functions_of

    nodes = list(t.plan.walk())
    operators: dict[str, int] = {}
    for n in nodes:
        operators[n.name] = operators.get(n.name, 0) + 1
    rows = sum(n.rows or 0 for n in nodes)
    scanned = sum(n.rows or 0 for n in nodes if "Scan" in n.name)
    known = [n for n in nodes if n.rows is not None and n.estimate is not None]
    estimated, actual = sum(n.estimate for n in known), sum(n.rows for n in known)
    below: dict[int, list[float]] = {}
    for n in known:
        below.setdefault(n.size - 1, []).append(_q_error(n.estimate, n.rows))
    return {
        "latency": t.seconds,
        "cumulative_cardinality": rows,
        "cumulative_rows_scanned": scanned,
        "cardinality_over_rows_scanned": rows / scanned if scanned else None,
        "query_plan_size": t.plan.size,
        "query_plan_length": t.plan.depth,
        "query_size_bytes": len(t.sql.encode()),
        "query_size_tokens": len(tokens(t.sql)),
        "output_cardinality": t.output_rows,
        "query_keywords": keywords(t.sql),
        "operator_distribution": operators,
        "vocabulary_distribution": distribution(t.plan),
        "qerror": max(estimated / actual, actual / estimated) if estimated and actual else None,
        "qerror_downstream_operators": [{"downstream_operators": k, "qerrors": v} for k, v in sorted(below.items())],
        "functions": functions_of(t.sql),
    }


METRICS = (
    "latency double, cumulative_cardinality long, cumulative_rows_scanned long, cardinality_over_rows_scanned double, query_plan_size int, query_plan_length int, query_size_bytes int,"
    " query_size_tokens int, output_cardinality long, query_keywords array<string>, operator_distribution map<string, long>, vocabulary_distribution map<string, long>, qerror double,"
    " qerror_downstream_operators array<struct<downstream_operators: int, qerrors: array<double>>>, functions array<struct<category: string, subcategory: string, name: string, expression: string>>"
)


def metrics_table(spark: SparkSession, traces: list[Trace]) -> DataFrame:
    """One row of METRICS per trace. The plans were walked on the driver; they are metadata, not data."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )(?![^<]*>)", METRICS)]
    return spark.createDataFrame([tuple(plan_metrics(t)[n] for n in names) for t in traces], METRICS)


def outcomes_table(spark: SparkSession, found: list[Trace | Failure]) -> DataFrame:
    """One row of METRICS per query, with its sql, trace_success and error; a failed one has its time and what its text tells."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )(?![^<]*>)", METRICS)]
    rows = []
    for t in found:
        if isinstance(t, Trace):
            rows.append((t.sql, True, None, *(plan_metrics(t)[n] for n in names)))
        else:
            known = {"latency": t.seconds, "query_size_bytes": len(t.sql.encode()), "query_size_tokens": len(tokens(t.sql)), "query_keywords": keywords(t.sql)}
            rows.append((t.sql, False, t.error, *(known.get(n) for n in names)))
    return spark.createDataFrame(rows, "sql string, trace_success boolean, error string, " + METRICS)


def operator_totals(metrics: DataFrame) -> DataFrame:
    """(operator, n) over all queries, most frequent first."""
    return metrics.select(F.explode("operator_distribution").alias("operator", "n")).groupBy("operator").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "operator")


def vocabulary_totals(metrics: DataFrame) -> DataFrame:
    """(operator, n) over all queries for every name of the vocabulary, those that never occur included."""
    spark = metrics.sparkSession
    names = spark.createDataFrame([(n,) for n in VOCABULARY], "operator string")
    found = metrics.select(F.explode("vocabulary_distribution").alias("operator", "n")).groupBy("operator").agg(F.sum("n").alias("n"))
    return names.join(found, "operator", "left").select("operator", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
