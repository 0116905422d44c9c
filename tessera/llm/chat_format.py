"""Chat formatting by a small template language that is compiled to Python closures.

The language: text, {{ expression }}, {% for x in xs %}, {% if e %} {% elif e %} {% else %} {% endif %}, {% endfor %},
{% set x = e %}, {% generation %} ... {% endgeneration %} (what the model is trained to write), {# comments #}; a dash
inside a tag strips the white space beside it. Expressions: literals, names, a.b, a[b], + - * // % ~, comparisons, in, not in, and, or,
not, e if c else d, and filters from a fixed table. Sandboxed: no calls, no attributes of Python objects
(a.b reads mappings alone and loop variables), no imports. Source is parsed to a tree, constant parts are folded, and the tree
becomes closures.

The control strings of a template must not occur in message texts; escape() breaks them up reversibly with a
backslash. parse_back() reads turns and the loss mask from the formatted string alone.

Defined results: a null text is empty and a null role is the role "user"; rows of a conversation are in order of turn, then role
and text; repeated rows are turns of their own; an empty table gives the added conversation alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, slices

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[GEN]", "[/GEN]")
TEMPLATE = """\
{%- for m in messages -%}
{%- if m.role == 'user' -%}
<s>[INST] {{ m.text | escape }} [/INST]
{%- elif m.role == 'assistant' -%}
[GEN]{% generation %}{{ m.text | escape }}{% endgeneration %}[/GEN]</s>
{%- else -%}
<s>[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>
{%- endif -%}
{%- endfor -%}
"""
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "first": lambda x: x[0] if x else "",
    "last": lambda x: x[-1] if x else "",
    "string": str,
}
_FOLDABLE = frozenset(FILTERS)


class TemplateError(ValueError):
    pass


# Tree: every node is one of these; Const is what folding aims at.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    """An operation on expressions: its name and its operands."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>().\[\]|,]))")
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none", "True", "False", "None"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, string, word, sign = m.groups()
            if number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            elif word:
                self.tokens.append(("word" if word in _WORDS else "name", word))
            else:
                self.tokens.append(("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def all(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected here")
        return out

    def choice(self) -> Any:
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("choose", (test, out, self.choice()))
        return out

    def _chain(self, below: Callable[[], Any], signs: tuple[str, ...]) -> Any:
        out = below()
        while sign := self.take(*signs):
            out = Op(sign, (out, below()))
        return out

    def either(self) -> Any:
        return self._chain(self.both, ("or",))

    def both(self) -> Any:
        return self._chain(self.negated, ("and",))

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.sums()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                out = Op(sign, (out, self.sums()))
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                out = Op("not", (Op("in", (out, self.sums())),))
            else:
                return out

    def sums(self) -> Any:
        return self._chain(self.products, ("+", "-", "~"))

    def products(self) -> Any:
        return self._chain(self.filtered, ("*", "//", "%"))

    def filtered(self) -> Any:
        out = self.signed()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "nothing")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            self.at += 1
            out = Op("filter", (Const(name), out))
        return out

    def signed(self) -> Any:
        return Op("-", (Const(0), self.signed())) if self.take("-") else self.member()

    def member(self) -> Any:
        out = self.atom()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"{name!r} can't be read from a value")
                self.at += 1
                out = Op("get", (out, Const(name)))
            elif self.take("["):
                out = Op("get", (out, self.choice()))
                self.need("]")
            else:
                return out

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Name(value)
        if value.lower() in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value.lower()])
        raise TemplateError(f"{value!r} is not expected here")


def parse(source: str) -> tuple:
    """The tree of a template: a tuple of statements."""
    parts = _TAG.split(source)
    items: list[tuple[str, str]] = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if k and parts[k - 1][-3] == "-":
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1][2] == "-":
                part = part.rstrip()
            if part:
                items.append(("text", part))
        elif part[1] != "#":
            items.append(("out" if part[1] == "{" else "tag", part[2:-2].strip("-").strip()))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        body: list[Any] = []
        while at < len(items):
            kind, value = items[at]
            at += 1
            if kind == "text":
                body.append(Output(Const(value)))
            elif kind == "out":
                body.append(Output(_Expression(value).all()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(body), value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"can't read {value!r}")
                    body.append(For(m[1], _Expression(m[2]).all(), block("endfor")[0]))
                elif word == "if":
                    arms, other, test = [], (), rest
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((_Expression(test).all(), inner))
                        if end.startswith("elif"):
                            test = end[4:]
                            continue
                        if end == "else":
                            other = block("endif")[0]
                        break
                    body.append(If(tuple(arms), other))
                elif word == "set":
                    name, _, given = rest.partition("=")
                    body.append(Set(name.strip(), _Expression(given).all()))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"there is no statement {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    return block()[0]


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key, "")
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else ""
    raise TemplateError(f"{key!r} can't be read from a {type(value).__name__}")


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not isinstance(a, str) and not isinstance(b, str) else _no_text(),
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if not isinstance(a, str) else _no_text(),
    "~": lambda a, b: f"{_text(a)}{_text(b)}",
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "get": _get,
}


def _no_text() -> Any:
    raise TemplateError("texts can't be multiplied or formatted")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node: Any) -> Any:
    """The node with constant parts worked out, decided branches taken and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(_text(out[-1].value.value) + _text(y.value.value)))
                        continue
                    y = Output(Const(_text(y.value.value)))
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.kind == "choose" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_expression(Op(node.kind, args))({}))
            except Exception:  # noqa: BLE001  it is raised again when the template runs, if it gets there
                pass
        return Op(node.kind, args)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms: list[tuple] = []
        other = node.other
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const):
                if test.value:
                    other = body
                    break
                continue
            arms.append((test, fold(body)))
        return If(tuple(arms), fold(other)) if arms else fold(other)
    return node


def _expression(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name, "")
    kind, args = node.kind, [_expression(a) for a in node.args]
    if kind == "filter":
        use, inner = FILTERS[node.args[0].value], args[1]
        return lambda scope: use(inner(scope))
    if kind == "choose":
        test, yes, no = args
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if kind == "not":
        (inner,) = args
        return lambda scope: not inner(scope)
    a, b = args
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    apply = _BINARY[kind]
    return lambda scope: apply(a(scope), b(scope))


Emit = Callable[[dict, list, list], None]


def _statements(body: tuple) -> Emit:
    steps = [_statement(x) for x in body]

    def run(scope: dict, out: list, marks: list) -> None:
        for step in steps:
            step(scope, out, marks)

    return run


def _statement(node: Any) -> Emit:
    """A closure that appends texts to out, and (piece, +1 or -1) to marks where generation begins and ends."""
    if isinstance(node, Output):
        value = _expression(node.value)
        return lambda scope, out, marks: out.append(_text(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value)
        return lambda scope, out, marks: scope.__setitem__(name, value(scope))
    if isinstance(node, For):
        name, over, inner = node.name, _expression(node.over), _statements(node.body)

        def loop(scope: dict, out: list, marks: list) -> None:
            items = list(over(scope))
            for k, item in enumerate(items):
                inner({**scope, name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k + 1 == len(items), "length": len(items)}}, out, marks)

        return loop
    if isinstance(node, If):
        arms, other = [(_expression(t), _statements(b)) for t, b in node.arms], _statements(node.other)

        def branch(scope: dict, out: list, marks: list) -> None:
            for test, body in arms:
                if test(scope):
                    return body(scope, out, marks)
            return other(scope, out, marks)

        return branch
    inner = _statements(node.body)

    def generation(scope: dict, out: list, marks: list) -> None:
        marks.append((len(out), 1))
        inner(scope, out, marks)
        marks.append((len(out), -1))

    return generation


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function of the variables, giving the rendered text and the (start, end) of each generated span in it."""
    run = _statements(fold(parse(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        run(dict(variables), out, marks)
        at = [0]
        for x in out:
            at.append(at[-1] + len(x))
        begin = [at[k] for k, way in marks if way == 1]
        end = [at[k] for k, way in marks if way == -1]
        return "".join(out), list(zip(begin, end))

    return render


def parse_back(text: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a string that TEMPLATE rendered, read from the string alone."""
    turns: list[tuple[str, str]] = []
    at = 0
    find = lambda control, start: text.index(control, start)
    while at < len(text):
        if text.startswith("<s>[INST] ", at):
            end = find(" [/INST]", at + 10)
            turns.append(("user", unescape(text[at + 10 : end])))
            at = end + 8
        elif text.startswith("[GEN]", at):
            end = find("[/GEN]</s>", at + 5)
            turns.append(("assistant", unescape(text[at + 5 : end])))
            at = end + 10
        elif text.startswith("<s>[ROLE]", at):
            end = find("[/ROLE]", at + 9)
            role = unescape(text[at + 9 : end])
            stop = find("</s>", end + 7)
            turns.append((role, unescape(text[end + 7 : stop])))
            at = stop + 4
        else:
            raise ValueError(f"no turn begins at {at}")
    return turns


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation: conv_id, formatted (string), loss (array<struct<start, end>>, code points)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in slices(batches, 256):
            done = [render({"messages": m}) for m in batch.column("messages").to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([t for t, _ in done], pa.string()), loss], names=["conv_id", "formatted", "loss"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start: long, end: long>>")


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted string and its loss spans: the digests of its turns and of its loss."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in chunks(batches, column="formatted"):
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                turns = parse_back(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(text)))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in schema.split(", ")])

    return rendered.mapInArrow(run, schema)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(added.columns)
    return read_back(formatted(table.unionByName(added)))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE|GEN)\]')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(escaped + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 15 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
