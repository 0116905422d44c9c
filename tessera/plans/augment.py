"""Augmenting a workload: sampled base queries are handed to a client with a prompt, and what comes back is validated and retried.

The client is a protocol; ShapeClient answers without any network by fixed rewrites of the base query into the requested shape.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from tessera.functions.catalogue import CATEGORIES
from tessera.operators.workload import counted_columns, extension_name

Message = dict[str, str]
#: Relative weights of the shapes that are asked for.
WEIGHTS = {
    "self_join": 10, "outer_join": 10, "nested_join_in": 5, "nested_join_exists": 5, "window_function": 10, "inequality_join": 10, "recursive_query_simple": 5, "recursive_query_complex": 5, "edge_case": 20, "semi_join": 5, "antijoin": 5,
    **{f"group_by_{n}": w for n, w in zip((1, 2, 3, 4, 6), (7, 7, 7, 4, 1))}, **{f"group_by_order_by_{n}": w for n, w in zip((1, 2, 3, 4, 6), (3, 3, 3, 2, 1))}, **{f"group_by_rollup_{n}": 1 for n in (1, 2, 3, 4, 6)},
}


class Client(Protocol):
    def query(self, messages: list[Message]) -> str:
        """The answer to a conversation."""


@dataclass(frozen=True)
class Sampled:
    path: str
    sql: str
    shape: str
    examples: tuple[tuple[str, str], ...] = ()


@dataclass
class Augmented:
    name: str
    shape: str
    sql: str | None
    messages: list[Message] = field(default_factory=list)
    error: str | None = None


def sample_queries(base: dict[str, str], n: int, weights: dict[str, int] | None = None, examples: int = 0, seed: int = 42) -> list[Sampled]:
    """n base queries (path -> SQL) with replacement, each with a shape by weight and some function examples."""
    rng, weights = random.Random(seed), weights or WEIGHTS
    known = [(name, spark) for lines in CATEGORIES.values() for name, spark, _, _ in lines]
    paths = sorted(base)
    return [Sampled(p, base[p], rng.choices(list(weights), list(weights.values()))[0], tuple(rng.sample(known, examples))) for p in (rng.choice(paths) for _ in range(n))]


def prompt(sampled: Sampled, schema: str = "") -> list[Message]:
    lines = "\n".join(f"- {name}: {example}" for name, example in sampled.examples)
    system = "You rewrite SQL queries for Spark. Answer with one ```sql block." + (f"\nTables:\n{schema}" if schema else "")
    return [{"role": "system", "content": system}, {"role": "user", "content": f"shape: {sampled.shape}\n" + (f"Use some of:\n{lines}\n" if lines else "") + f"```sql\n{sampled.sql}\n```"}]


def extract_sql(answer: str) -> str | None:
    """The last ```sql block after any thinking."""
    found = re.findall(r"```sql\s*(.*?)```", answer.rpartition("</think>")[2], re.S | re.I)
    return found[-1].strip() if found else None


def with_feedback(messages: list[Message], answer: str, error: str) -> list[Message]:
    return [*messages, {"role": "assistant", "content": answer}, {"role": "user", "content": f"That query failed: {error}\nAnswer with a corrected ```sql block."}]


def augment_one(client: Client, count: int, sampled: Sampled, valid: Callable[[str], tuple[bool, str | None]], retries: int = 1, schema: str = "") -> Augmented:
    """Ask, extract and validate, at most retries + 1 times."""
    out = Augmented(extension_name(count, sampled.path), sampled.shape, None, prompt(sampled, schema))
    for _ in range(retries + 1):
        answer = client.query(out.messages)
        sql = extract_sql(answer)
        ok, out.error = valid(sql) if sql else (False, "there is no sql block")
        if ok:
            out.sql = sql
            out.messages = [*out.messages, {"role": "assistant", "content": answer}]
            return out
        out.messages = with_feedback(out.messages, answer, out.error or "")
    return out


def augment(client: Client, base: dict[str, str], n: int, valid: Callable[[str], tuple[bool, str | None]], retries: int = 1, seed: int = 42) -> list[Augmented]:
    return [augment_one(client, k, s, valid, retries) for k, s in enumerate(sample_queries(base, n, seed=seed))]


def augment_batch(submit: Callable[[dict[str, list[Message]]], dict[str, str]], base: dict[str, str], n: int, valid: Callable[[str], tuple[bool, str | None]], retries: int = 1, chunk: int = 100, seed: int = 42) -> list[Augmented]:
    """As augment(), with requests sent in chunks under ids, round by round, until none has failed or retries run out."""
    sampled = sample_queries(base, n, seed=seed)
    done = {f"q{k}": Augmented(extension_name(k, s.path), s.shape, None, prompt(s)) for k, s in enumerate(sampled)}
    left = list(done)
    for _ in range(retries + 1):
        answers: dict[str, str] = {}
        for k in range(0, len(left), chunk):
            answers |= submit({i: done[i].messages for i in left[k : k + chunk]})
        for i in left:
            answer = answers.get(i, "")
            sql = extract_sql(answer)
            ok, done[i].error = valid(sql) if sql else (False, "there is no sql block")
            done[i].sql = sql if ok else None
            if not ok:
                done[i].messages = with_feedback(done[i].messages, answer, done[i].error or "")
        left = [i for i in left if done[i].sql is None]
        if not left:
            break
    return list(done.values())


class ShapeClient:
    """Answers offline: the base counting query over FROM a, b WHERE ... is wrapped into the requested shape."""

    def query(self, messages: list[Message]) -> str:
        asked = next(m["content"] for m in messages if m["role"] == "user")
        shape, sql = re.search(r"shape: (\w+)", asked)[1], extract_sql(asked)
        return f"```sql\n{self.reshape(shape, sql)}\n```"

    def reshape(self, shape: str, sql: str) -> str:
        columns, (_, tail) = counted_columns(sql), re.split(r"\sFROM\s", sql, maxsplit=1, flags=re.I)
        base = f"SELECT {', '.join(f'{c} AS column_{i + 1}' for i, c in enumerate(columns))} FROM {tail}"
        one = f"WITH base AS ({base})"
        if m := re.fullmatch(r"group_by_(order_by_|rollup_)?(\d)", shape):
            keys = ", ".join(f"column_{i + 1}" for i in range(min(int(m[2]), len(columns))))
            by = f"ROLLUP({keys})" if m[1] == "rollup_" else keys
            return f"{one} SELECT {keys}, COUNT(*) AS n FROM base GROUP BY {by}" + f" ORDER BY {keys}" * (m[1] == "order_by_")
        return {
            "self_join": f"{one} SELECT COUNT(*) AS n FROM (SELECT DISTINCT column_1 FROM base) a JOIN (SELECT DISTINCT column_1 FROM base) b ON a.column_1 = b.column_1",
            "outer_join": f"{one} SELECT COUNT(*) AS n FROM base a LEFT JOIN (SELECT DISTINCT column_1 AS k FROM base) b ON a.column_1 = b.k",
            "nested_join_in": f"{one} SELECT COUNT(*) AS n FROM base WHERE column_1 IN (SELECT column_1 FROM base WHERE column_2 IS NOT NULL)",
            "nested_join_exists": f"{one} SELECT COUNT(*) AS n FROM base a WHERE EXISTS (SELECT 1 FROM base b WHERE b.column_1 = a.column_1)",
            "window_function": f"{one} SELECT column_1, row_number() OVER (PARTITION BY column_1 ORDER BY column_2) AS place FROM base",
            "inequality_join": f"{one}, k AS (SELECT MIN(column_1) AS low FROM base) SELECT COUNT(*) AS n FROM base JOIN k ON column_1 > low",
            "recursive_query_simple": "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 10) SELECT COUNT(*) AS n FROM r",
            "recursive_query_complex": f"WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 10), base AS ({base}) SELECT i, COUNT(*) AS n FROM base JOIN r ON length(CAST(column_1 AS STRING)) = i GROUP BY i",
            "semi_join": f"{one} SELECT COUNT(*) AS n FROM base a LEFT SEMI JOIN base b ON a.column_1 = b.column_1",
            "antijoin": f"{one} SELECT COUNT(*) AS n FROM base a LEFT ANTI JOIN (SELECT column_1 FROM base WHERE column_2 IS NULL) b ON a.column_1 = b.column_1",
        }.get(shape, f"{one} SELECT COUNT(*) FILTER (WHERE column_1 IS NOT NULL) AS n, COUNT(DISTINCT column_1) AS d FROM base")
