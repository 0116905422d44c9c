"""Rewrites of aggregate queries, held as a small query specification that gives a DataFrame and SQL text."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read


@dataclass(frozen=True)
class Aggregate:
    """function(column), written as alias. count_distinct, count, min, max, sum, avg."""

    function: str
    column: str
    alias: str

    def sql(self) -> str:
        call = f"COUNT(DISTINCT {self.column})" if self.function == "count_distinct" else f"{self.function.upper()}({self.column})"
        return f"{call} AS {self.alias}"

    def apply(self):
        return getattr(F, self.function)(F.lit(1) if self.column == "*" else self.column).alias(self.alias)


@dataclass(frozen=True)
class GroupedQuery:
    """SELECT columns and aggregates FROM a table GROUP BY keys [ROLLUP or CUBE]; columns that aren't keys need any_value."""

    table: str
    select: tuple[str, ...]
    keys: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    how: str = ""  # "", "rollup", "cube"
    ordered: bool = False

    def sql(self) -> str:
        items = [*self.select, *[a.sql() for a in self.aggregates]]
        by = ", ".join(self.keys)
        return f"SELECT {', '.join(items)} FROM {self.table} GROUP BY {f'{self.how.upper()}({by})' if self.how else by}" + f" ORDER BY {by}" * self.ordered

    def to_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, self.table)
        grouped = getattr(df, self.how)(*self.keys) if self.how else df.groupBy(*self.keys)
        out = grouped.agg(*[a.apply() for a in self.aggregates]).select(*self.select, *[a.alias for a in self.aggregates])
        return out.orderBy(*self.keys) if self.ordered else out


def repeated_columns(query: GroupedQuery) -> list[str]:
    """Columns that are selected and grouped by."""
    return [c for c in query.select if c in query.keys]


def owner_of(column: str, schema: dict[str, dict[str, str]]) -> str | None:
    """The first table that has the column; a prefix with the table's name counts."""
    table, _, name = column.rpartition(".")
    return table if table in schema else next((t for t, columns in schema.items() if name in columns), None)


def disjoint(query: GroupedQuery, schema: dict[str, dict[str, str]]) -> GroupedQuery:
    """The query with each selected key replaced by the count of another column of its table, so that no column is both."""
    taken = {*query.select, *query.keys, *(a.column for a in query.aggregates)}
    added = list(query.aggregates)
    for c in repeated_columns(query):
        table = owner_of(c, schema)
        free = [x for x in schema.get(table or "", {}) if x not in taken]
        if not free:
            raise ValueError(f"{table} has no column left beside {sorted(taken)}")
        taken.add(free[-1])
        added.append(Aggregate("count", free[-1], f"count_{free[-1]}"))
    return replace(query, select=tuple(c for c in query.select if c not in query.keys), aggregates=tuple(added))


def diversified(query: GroupedQuery, schema: dict[str, dict[str, str]], seed: int = 42) -> GroupedQuery:
    """COUNT(column) becomes itself, COUNT(DISTINCT column) or, for numbers, MIN or MAX; COUNT(*) stays."""
    rng = random.Random(seed)

    def one(a: Aggregate) -> Aggregate:
        if a.function != "count" or a.column == "*":
            return a
        numeric = schema.get(owner_of(a.column, schema) or "", {}).get(a.column.rpartition(".")[2]) in ("INT", "FLOAT")
        return replace(a, function=rng.choice(["count", "count_distinct", *["min", "max"] * numeric]))

    return replace(query, aggregates=tuple(map(one, query.aggregates)))


# The same two rewrites on SQL text, for queries that came from elsewhere. Only the outermost SELECT list is changed.

_WORD_OR_OTHER = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|[^\s\w]", re.S)
_COLUMN = re.compile(r"(?:\w+\.)?[A-Za-z_]\w*")
_COUNTED = re.compile(r"\bCOUNT\s*\(\s*((?:\w+\.)?[A-Za-z_]\w*)\s*\)(?!\s*(?:OVER|FILTER)\b)", re.I)


def _outermost(sql: str) -> tuple[tuple[int, int], list[tuple[int, int]], tuple[int, int] | None] | None:
    """Spans of the last SELECT list outside parentheses, of its items, and of its GROUP BY list; None if there is no such list."""
    depth, select, end, commas, group, stop = 0, None, None, [], None, None
    for m in _WORD_OR_OTHER.finditer(sql):
        word = m.group().upper()
        depth += (word == "(") - (word == ")")
        if depth:
            continue
        if word == "SELECT":
            select, end, commas, group, stop = m.end(), None, [], None, None
        elif word == "FROM" and select is not None and end is None:
            end = m.start()
        elif word == "," and select is not None and end is None:
            commas.append(m.start())
        elif word == "BY" and end is not None and re.search(r"\bGROUP\s*$", sql[: m.start()], re.I):
            group = m.end()
        elif word in ("HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", ";") and group is not None and stop is None:
            stop = m.start()
    if select is None or end is None:
        return None
    edges = [select - 1, *commas, end]
    return (select, end), [(a + 1, b) for a, b in zip(edges, edges[1:])], (group, stop if stop is not None else len(sql)) if group is not None else None


def disjoint_sql(sql: str, schema: dict[str, dict[str, str]]) -> str:
    """disjoint() on text: each selected plain column that is a group key becomes the count of another column of its table.

    Queries that order their rows, use GROUPING or windows, or have no GROUP BY, stay as they are."""
    found = _outermost(sql)
    if not found or not found[2] or re.search(r"\bORDER\s+BY\b|\bGROUPING\s*\(|\bOVER\b", sql, re.I):
        return sql
    bare = lambda c: c.rpartition(".")[2].lower()
    keys = {bare(c) for c in _COLUMN.findall(sql[slice(*found[2])])}
    items = [sql[a:b].strip() for a, b in found[1]]
    taken = keys | {bare(c) for item in items for c in _COLUMN.findall(item)}
    for k, item in enumerate(items):
        column = re.split(r"\s+", item)[0]
        if not _COLUMN.fullmatch(column) or "(" in item or bare(column) not in keys:
            continue
        table = owner_of(column, schema) or owner_of(bare(column), schema)
        free = [c for c in schema.get(table or "", {}) if c.lower() not in taken]
        if not free:
            raise ValueError(f"{table} has no column left beside {sorted(taken)}")
        taken.add(free[-1].lower())
        prefix = column[: len(column) - len(bare(column))]
        items[k] = f"COUNT({prefix}{free[-1]}) AS count_{free[-1]}"
    (a, b), _, _ = found
    return f"{sql[:a]} {', '.join(items)} {sql[b:]}"


def diversified_sql(sql: str, schema: dict[str, dict[str, str]], seed: int = 42) -> str:
    """diversified() on text: COUNT(column) in the SELECT list may become COUNT(DISTINCT column), or MIN or MAX of a number."""
    found = _outermost(sql)
    if not found:
        return sql
    rng = random.Random(seed)

    def one(m: re.Match[str]) -> str:
        column = m.group(1)
        name = column.rpartition(".")[2]
        numeric = schema.get(owner_of(column, schema) or owner_of(name, schema) or "", {}).get(name) in ("INT", "FLOAT")
        return rng.choice([m.group(), f"COUNT(DISTINCT {column})", *[f"MIN({column})", f"MAX({column})"] * numeric])

    (a, b), _, _ = found
    return sql[:a] + _COUNTED.sub(one, sql[a:b]) + sql[b:]
