"""Predicates drawn from column statistics, each as a Column and as SQL text."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("equality", "in", "range", "like", "not_like")
Value = int | float | str | datetime


def literal(value: Value) -> str:
    """SQL text of a typed value."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)


def typed(value: str, kind: str) -> Value:
    """A statistic's text as a value of its type class."""
    if kind == "INT":
        return int(value)
    if kind == "FLOAT":
        return float(value)
    return datetime.fromisoformat(value) if kind == "TIME" else value


@dataclass(frozen=True)
class Predicate:
    """One test of table.name; values: one for equality and likes, two for a range, any number for in."""

    table: str
    name: str
    kind: str
    values: tuple[Value, ...]

    def column(self, c: Column) -> Column:
        if self.kind == "equality":
            return c == F.lit(self.values[0])
        if self.kind == "in":
            return c.isin(*self.values)
        if self.kind == "range":
            return c.between(F.lit(self.values[0]), F.lit(self.values[1]))
        inside = c.contains(F.lit(self.values[0]))  # wildcards in a mined text are plain characters
        return inside if self.kind == "like" else ~inside

    def sql(self) -> str:
        c = f"{self.table}.{self.name}"
        if self.kind == "equality":
            return f"{c} = {literal(self.values[0])}"
        if self.kind == "in":
            return f"{c} IN ({', '.join(map(literal, self.values))})"
        if self.kind == "range":
            return f"{c} BETWEEN {literal(self.values[0])} AND {literal(self.values[1])}"
        text = str(self.values[0])
        for x in "!%_":
            text = text.replace(x, "!" + x)
        return f"{c} {'NOT ' * (self.kind == 'not_like')}LIKE {literal(f'%{text}%')} ESCAPE '!'"


@dataclass(frozen=True)
class Tree:
    """Predicates joined by AND or OR."""

    op: str  # "leaf", "and", "or"
    parts: tuple[Any, ...]

    def leaves(self) -> list[Predicate]:
        return [self.parts[0]] if self.op == "leaf" else [p for t in self.parts for p in t.leaves()]

    def column(self, of: Callable[[Predicate], Column]) -> Column:
        if self.op == "leaf":
            return self.parts[0].column(of(self.parts[0]))
        a, b = (t.column(of) for t in self.parts)
        return a & b if self.op == "and" else a | b

    def sql(self) -> str:
        return self.parts[0].sql() if self.op == "leaf" else f"({self.parts[0].sql()} {self.op.upper()} {self.parts[1].sql()})"


def leaf(*args: Any) -> Tree:
    return Tree("leaf", (Predicate(*args),))


def random_tree(rng: random.Random, predicates: list[Predicate], or_probability: float) -> Tree | None:
    """A random binary tree over the predicates."""
    trees = [Tree("leaf", (p,)) for p in predicates]
    while len(trees) > 1:
        k = rng.randrange(len(trees) - 1)
        trees[k : k + 2] = [Tree("or" if rng.random() < or_probability else "and", (trees[k], trees[k + 1]))]
    return trees[0] if trees else None


@dataclass
class PredicateMaker:
    """Draws predicates from rows of statistics, given as dicts (collected metadata, one row per column).

    retention: share of a histogram's bins that a range covers; least_equality: least share of rows for a value of = and IN;
    least_like: least share of rows with a LIKE's substring, and one less it the most for NOT LIKE.
    """

    stats: list[dict[str, Any]]
    retention: float = 0.2
    least_equality: float = 0.0
    least_like: float = 0.1
    more_in_values: int = 5
    weights: dict[str, float] | None = None
    most_attempts: int = 100

    def __post_init__(self) -> None:
        self.stats = [r for r in self.stats if r["histogram"] and r["distinct_count"] > 1]

    def draw(self, rng: random.Random, tables: list[str], n: int) -> list[Predicate]:
        """Up to n predicates over the tables' columns."""
        weights = self.weights or dict.fromkeys(KINDS, 1.0)
        out: list[Predicate] = []
        for _ in range(n * self.most_attempts):
            if len(out) == n:
                break
            kind = rng.choices(list(weights), list(weights.values()))[0]
            rows = [r for r in self.stats if r["table"] in tables and (r["dtype"] == "STRING" or "like" not in kind)]
            if rows and (found := self._try(rng, kind, rng.choice(rows))):
                out.append(found)
        return out

    def _try(self, rng: random.Random, kind: str, row: dict[str, Any]) -> Predicate | None:
        values: tuple[Value, ...] | None
        if kind == "range":
            values = self._range(rng, row)
        elif kind in ("equality", "in"):
            values = self._equal(rng, row, kind == "in")
        else:
            values = self._like(rng, row, kind)
        return Predicate(row["table"], row["column"], kind, values) if values else None

    def _range(self, rng: random.Random, row: dict[str, Any]) -> tuple[Value, ...] | None:
        bins = [typed(x, row["dtype"]) for x in row["histogram"]]
        size = math.ceil(self.retention * len(bins))
        start = rng.randrange(max(1, len(bins) - size + 1))
        low, high = bins[start], bins[min(start + size, len(bins) - 1)]
        return None if low == high else (low, high)

    def _equal(self, rng: random.Random, row: dict[str, Any], more: bool) -> tuple[Value, ...] | None:
        common = [v["value"] for v in row.get("most_common_values") or [] if v["count"] / max(1, row["sample_size"]) >= self.least_equality]
        if not common:
            return None
        chosen = [rng.choice(common)]
        if more:
            rest = row.get("histogram_mcv") or []
            chosen += rng.sample(rest, min(self.more_in_values, len(rest)))
        return tuple(typed(v, row["dtype"]) for v in dict.fromkeys(chosen))

    def _like(self, rng: random.Random, row: dict[str, Any], kind: str) -> tuple[Value, ...] | None:
        mined = row.get("common_substrings") or []
        fits = [s for s in mined if (s["support_probability"] >= self.least_like if kind == "like" else s["support_probability"] <= 1 - self.least_like)]
        return (rng.choices([s["substring"] for s in fits], [len(s["substring"]) for s in fits])[0],) if fits else None
