"""The graph of foreign keys, random connected parts of it, and joins along them as DataFrames and as SQL."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.predicates import Predicate, Tree
from tessera.sources.tables import FOREIGN_KEYS, ForeignKey, read


class KeyGraph:
    """Edges by their table; ids follow the sorted order of tables and keys, so they are the same in every run."""

    def __init__(self, keys: tuple[ForeignKey, ...] = FOREIGN_KEYS):
        self.edges = tuple(sorted(set(keys), key=lambda k: (k.table, k.column, k.to_table, k.to_column)))
        self.number = {e: i for i, e in enumerate(self.edges)}

    def of(self, table: str) -> list[ForeignKey]:
        return [e for e in self.edges if e.table == table]

    def is_leaf(self, table: str) -> bool:
        return not self.of(table)

    def signature(self, edges: list[ForeignKey]) -> str:
        """A bit for each edge, as decimal digits; large schemas pass 64 bits."""
        return str(sum(1 << self.number[e] for e in set(edges)))

    def random_part(self, rng: random.Random, fact: str, max_hops: int, keep: float) -> list[ForeignKey]:
        """Edges met breadth-first from fact over at most max_hops, each kept with probability keep, none twice."""
        found: list[ForeignKey] = []
        level, seen = [fact], {fact}
        for _ in range(max_hops):
            reached: list[str] = []
            for table in level:
                for e in self.of(table):
                    if e not in found and rng.random() < keep:
                        found.append(e)
                        if e.to_table not in seen:
                            seen.add(e.to_table)
                            reached.append(e.to_table)
            level = reached
        return found

    def parts(self, rng: random.Random, fact: str, max_hops: int, keep: float, most: int, tries: int = 1000) -> Iterator[list[ForeignKey]]:
        """Up to most parts with different signatures; ends when tries in a row bring nothing new."""
        seen: set[str] = set()
        while len(seen) < most:
            for _ in range(tries):
                part = self.random_part(rng, fact, max_hops, keep)
                if part and self.signature(part) not in seen:
                    break
            else:
                return
            seen.add(self.signature(part))
            yield part


@dataclass(frozen=True)
class JoinQuery:
    """An inner join along foreign keys with predicates, counted: all rows, and the non-null values of one column per table."""

    fact: str
    edges: tuple[ForeignKey, ...]
    predicates: Tree | None = None
    counted: tuple[str, ...] = field(default=())

    @property
    def tables(self) -> list[str]:
        return sorted({self.fact, *(t for e in self.edges for t in (e.table, e.to_table))})

    def joined(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The join as a DataFrame. Tables are added as edges reach them; Catalyst orders and prunes."""
        name = lambda t, c: f"{t}__{c}"
        frames = {}
        for t in self.tables:
            df = read(spark, sf_dir, t)
            frames[t] = df.select(*[F.col(c).alias(name(t, c)) for c in df.columns])
        out, seen, left = frames[self.fact], {self.fact}, list(self.edges)
        while left:
            edge = next((e for e in left if e.table in seen or e.to_table in seen), None)
            if edge is None:
                raise ValueError("the edges don't hang together")
            new = {edge.table, edge.to_table} - seen
            # All edges between what is there and the new table make one join condition.
            these = [e for e in left if {e.table, e.to_table} <= seen | new and (not new or {e.table, e.to_table} & new)]
            on = [F.col(name(e.table, e.column)) == F.col(name(e.to_table, e.to_column)) for e in these]
            condition: Column = on[0]
            for c in on[1:]:
                condition = condition & c
            out = out.join(frames[next(iter(new))], condition) if new else out.where(condition)
            seen |= new
            left = [e for e in left if e not in these]
        return out.where(self.predicates.column(lambda p: F.col(name(p.table, p.name)))) if self.predicates else out

    def to_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = [F.count(F.col(c.replace(".", "__"))).alias(f"count_{i + 1}") for i, c in enumerate(self.counted)]
        return self.joined(spark, sf_dir).agg(F.count(F.lit(1)).alias("count_star"), *counts)

    def to_sql(self) -> str:
        counts = ["COUNT(*) AS count_star", *[f"COUNT({c}) AS count_{i + 1}" for i, c in enumerate(self.counted)]]
        where = [f"{e.table}.{e.column} = {e.to_table}.{e.to_column}" for e in self.edges]
        if self.predicates:
            where.append(f"({self.predicates.sql()})")
        return f"SELECT {', '.join(counts)} FROM {', '.join(self.tables)}" + (" WHERE " + " AND ".join(where) if where else "")


def kinds(tree: Tree | None) -> dict[str, int]:
    """How many predicates of each kind a tree has."""
    out = {k: 0 for k in ("equality", "in", "range", "like", "not_like")}
    for p in tree.leaves() if tree else []:
        out[p.kind] += 1
    return out


__all__ = ["JoinQuery", "KeyGraph", "Predicate", "kinds"]
