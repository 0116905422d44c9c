"""Shaping a workload: cardinality bins, stratified samples, caps per template, unions of like queries, limits, and query files."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from itertools import product
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a workload row.
FIELDS = (
    "query_id string, relative_path string, sql string, count_star long, batch_number int, template_number int, predicate_number int, extra_predicates int, fact_table string, max_hops int,"
    " row_retention_probability double, equality_lower_bound_probability double, or_probability double, minimum_like_support_probability double, keep_edge_probability double, total_subgraph_edges int,"
    " predicates_range int, predicates_in_values int, predicates_equality int, predicates_like int, predicates_not_like int, subgraph_signature string"
)


def bin_of(count: Column, upper: int, bins: int) -> Column:
    """min(ceil(count / (upper / bins)), bins + 1)."""
    return F.least(F.ceil(count / F.lit(upper / bins)), F.lit(bins + 1)).cast("int")


def not_empty(workload: DataFrame, apply: bool = True) -> DataFrame:
    return workload.where("count_star > 0") if apply else workload


def stratified(workload: DataFrame, by: list[str], k: int, key: list[str], seed: int = 42) -> DataFrame:
    """min(k, size) rows of each stratum, without replacement: those of least hash of their key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key))
    return workload.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def cherry_pick(workload: DataFrame, upper: int, bins: int, k: int, drop_empty: bool = True, seed: int = 42) -> DataFrame:
    """The workload's bins (column bin), without empty results, and k queries of each."""
    return stratified(not_empty(workload, drop_empty).withColumn("bin", bin_of(F.col("count_star"), upper, bins)), ["bin"], k, ["query_id"], seed)


def template_cap(traces: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most limits[template] rows of a template in order of path; other templates stay whole."""
    if not limits:
        return traces
    cap = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("query_folder")]
    place = F.row_number().over(Window.partitionBy("query_folder").orderBy("relative_path"))
    return traces.withColumns({"__cap": cap, "__place": place}).where("__cap IS NULL OR __place <= __cap").drop("__cap", "__place")


def collapsed_template(column: Column, rules: list[tuple[str, str]]) -> Column:
    """column under the first rule (pattern with * and ?, name) that fits it whole, else as it is."""
    out = column
    for pattern, name in reversed(rules):
        regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        out = F.when(column.rlike(f"^{regex}$"), F.lit(name)).otherwise(out)
    return out


def log_histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal bins of the decimal logarithm of positive values between their extremes."""
    logs = values.where(F.col(column) > 0).select(F.log10(column).alias("v"))
    span = logs.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1)))
    return logs.crossJoin(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def parameter_grid(**choices: list[Any]) -> list[dict[str, Any]]:
    """Every combination of the parameters' values, the last one changing fastest."""
    return [dict(zip(choices, values)) for values in product(*choices.values())]


# Unions of counting queries with the same tables.


@dataclass(frozen=True)
class Counting:
    """What a counting query counts: its columns, and the text from FROM on that gives the rows."""

    columns: tuple[str, ...]
    source: str

    @classmethod
    def of(cls, sql: str) -> Counting:
        """Read from the outermost select list. A call's name is what stands before its bracket."""
        columns: list[str] = []
        opened: list[tuple[str, int]] = []
        for m in _PIECE.finditer(sql):
            if m[0].endswith("("):
                opened.append((m[0][:-1].strip().upper(), m.end()))
            elif m[0] == ")" and opened:
                call, at = opened.pop()
                inside = sql[at : m.start()].strip()
                if call == "COUNT" and not opened and inside and inside != "*":
                    columns.append(inside)
            elif m[0].upper() == "FROM" and not opened:
                return cls(tuple(columns), sql[m.start() :])
        return cls((), "")

    def rows(self) -> str:
        """A query for the values themselves, named by their places."""
        return "SELECT " + ", ".join(f"{c} AS column_{k}" for k, c in enumerate(self.columns, 1)) + " " + self.source


_PIECE = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|\w*\s*\(|\)|\bFROM\b", re.I)


def counted_columns(sql: str) -> list[str]:
    """The columns that a query counts; at least two are needed for a union."""
    columns = Counting.of(sql).columns
    if len(columns) < 2:
        raise ValueError("a query needs two counted columns for a union")
    return list(columns)


def union_query(queries: list[str], distinct: bool) -> str:
    """The counts over the union of what the queries count; they must count equally many columns."""
    parts = [Counting.of(q) for q in queries if counted_columns(q)]
    width = len(parts[0].columns)
    if any(len(p.columns) != width for p in parts):
        raise ValueError("the queries count different numbers of columns")
    together = (" UNION " if distinct else " UNION ALL ").join(p.rows() for p in parts)
    return f"SELECT COUNT(*) AS count_star{''.join(f', COUNT(column_{k}) AS count_{k}' for k in range(1, width + 1))} FROM ({together}) AS together"


def unions(workload: list[dict[str, Any]], most: int, probability: float, seed: int = 42) -> list[dict[str, Any]]:
    """One union for each signature with two queries or more, of 2 to most of them; UNION with the probability, else UNION ALL."""
    rng, groups = random.Random(seed), {}
    for row in workload:
        groups.setdefault(row["subgraph_signature"], []).append(row)
    out = []
    for signature, rows in sorted(groups.items()):
        if len(rows) >= 2:
            chosen = rng.sample(rows, rng.randint(2, min(most, len(rows))))
            distinct = rng.random() < probability
            out.append({"subgraph_signature": signature, "members": [r["relative_path"] for r in chosen], "sql": union_query([r["sql"] for r in chosen], distinct)})
    return out


def with_limit(sql: str, limit: int) -> str:
    """The query inside a CTE and a limit; 0 means no limit."""
    return f"WITH limited AS ({sql.strip().rstrip(';')}) SELECT * FROM limited LIMIT {limit}" if limit else sql


class QueryFiles:
    """Query files under a folder on the driver; an existing file is never overwritten."""

    def __init__(self, root: str):
        self.root = Path(root)

    def _write(self, relative: str, text: str) -> str:
        path = self.root / relative
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("x", encoding="utf-8") as f:
            f.write(text)
        return relative

    def query(self, fact: str, template: int, predicate: int, sql: str) -> str:
        return self._write(f"{fact}/{template}_{predicate}.sql", sql)

    def in_batch(self, batch: int, fact: str, template: int, predicate: int, sql: str) -> str:
        return self._write(f"batch_{batch}/{fact}_{template}_{predicate}.sql", sql)

    def extension(self, kind: str, count: int, original: str, sql: str) -> str:
        return self._write(f"{kind}/{extension_name(count, original)}", sql)

    def parameters(self, values: dict[str, Any]) -> str:
        return self._write("parameters.toml", to_toml(values))


def extension_name(count: int, original: str) -> str:
    return f"{count}_{original.replace('/', '_')}"


def to_toml(values: dict[str, Any]) -> str:
    """Scalars, lists of scalars and tables of them as TOML."""

    def one(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if isinstance(v, str) else repr(v)

    flat = [f"{k} = {one(v)}" for k, v in values.items() if not isinstance(v, dict) and v is not None]
    nested = [f"\n[{k}]\n{to_toml(v)}" for k, v in values.items() if isinstance(v, dict)]
    return "\n".join([*flat, *nested]) + "\n"


def from_toml(text: str, kind: type) -> Any:
    """TOML as an instance of a dataclass."""
    import tomllib

    return kind(**tomllib.loads(text))


def append_batch(rows: DataFrame, path: str) -> None:
    """Add a batch's rows to the stored workload; what is there already isn't written again."""
    rows.write.mode("append").partitionBy("batch_number").parquet(path)


def numbered_files(paths: DataFrame) -> DataFrame:
    """(template, name) -> new_name <template>-<i>.sql, counted by name."""
    place = F.row_number().over(Window.partitionBy("template").orderBy("name"))
    return paths.select("template", "name", F.format_string("%s-%d.sql", "template", place).alias("new_name"))
