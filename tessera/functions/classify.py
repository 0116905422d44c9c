"""Functions and operators of a query by category, found in the parser's own tree of it."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import SparkSession

from tessera.functions.catalogue import CATEGORIES
from tessera.functions.taxonomy import BARE, by_spelling

#: SQL operators, as their text: (category, subcategory, name).
OPERATORS = {
    "||": ("scalar", "string", "DPipe"), "+": ("scalar", "arithmetic", "Add"), "-": ("scalar", "arithmetic", "Sub"), "*": ("scalar", "arithmetic", "Mul"), "/": ("scalar", "arithmetic", "Div"),
    "%": ("scalar", "arithmetic", "Mod"), "&": ("scalar", "bitwise", "BitwiseAnd"), "|": ("scalar", "bitwise", "BitwiseOr"), "^": ("scalar", "bitwise", "BitwiseXor"), "~": ("scalar", "bitwise", "BitwiseNot"),
    "=": ("scalar", "comparison", "EQ"), "<>": ("scalar", "comparison", "NEQ"), "!=": ("scalar", "comparison", "NEQ"), "<": ("scalar", "comparison", "LT"), "<=": ("scalar", "comparison", "LTE"),
    ">": ("scalar", "comparison", "GT"), ">=": ("scalar", "comparison", "GTE"), "<=>": ("scalar", "comparison", "NullSafeEQ"),
    "LIKE": ("scalar", "pattern_matching", "Like"), "ILIKE": ("scalar", "pattern_matching", "ILike"), "NOT": ("scalar", "logical", "Not"), "IS": ("scalar", "comparison", "Is"),
    "DIV": ("scalar", "arithmetic", "IntDiv"), "RLIKE": ("scalar", "regex", "RLike"), "<<": ("scalar", "bitwise", "BitwiseLeftShift"), ">>": ("scalar", "bitwise", "BitwiseRightShift"), ">>>": ("scalar", "bitwise", "BitwiseRightShift"),
    "IS NOT DISTINCT FROM": ("scalar", "comparison", "NullSafeEQ"), "IS DISTINCT FROM": ("scalar", "comparison", "NullSafeNEQ"),
    "GLOB": ("scalar", "pattern_matching", "Glob"), "SIMILAR TO": ("scalar", "pattern_matching", "SimilarTo"), "ESCAPE": ("scalar", "pattern_matching", "Escape"),
    "->": ("scalar", "json", "JSONExtract"), "->>": ("scalar", "json", "JSONExtractScalar"), "<->": ("scalar", "distance", "Distance"), ":=": ("scalar", "struct_access", "PropertyEQ"),
    "-|-": ("scalar", "range", "Adjacent"), "OVERLAPS": ("scalar", "range", "Overlaps"), "&<": ("scalar", "range", "ExtendsLeft"), "&>": ("scalar", "range", "ExtendsRight"),
}
_WINDOW = {"rank": "ranking", "dense_rank": "ranking", "row_number": "ranking", "ntile": "ranking", "lag": "navigation", "lead": "navigation", "first_value": "navigation", "last_value": "navigation", "nth_value": "navigation", "cume_dist": "distribution", "percent_rank": "distribution"}
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_SIGN = re.compile(r"<=>|->>|->|-\|-|<->|<<|>>>|>>|<=|>=|<>|!=|\|\||&<|&>|:=|[-+*/%&|^~=<>]|\b(?:IS\s+(?:NOT\s+)?DISTINCT\s+FROM|SIMILAR\s+TO|LIKE|ILIKE|RLIKE|GLOB|ESCAPE|OVERLAPS|NOT|IS|DIV)\b", re.I)
#: What a sign follows that has no left operand.
_NO_OPERAND = re.compile(r"(?:^|[(,\[]|[-+*/%&|^~=<>]|\b(?:SELECT|DISTINCT|WHERE|HAVING|ON|AND|OR|NOT|BETWEEN|WHEN|THEN|ELSE|CASE|BY|IN|LIKE|RETURN|DIV|LIMIT|OFFSET|VALUES))\s*$", re.I)
#: A struct's field, taken from an expression.
_FIELD = re.compile(r"\)\s*\.\s*[A-Za-z_]\w*(?!\s*\()")
_NOT_CALLS = frozenset("GROUP WITHIN RECURSIVE LATERAL PARTITION ORDER WINDOW QUALIFY ESCAPE SIMILAR TO RLIKE ILIKE AND OR IN ON AS FROM WHERE SELECT EXISTS OVER VALUES USING BY THEN ELSE WHEN NOT ALL ANY WITH UNION JOIN ROLLUP CUBE SETS GROUPING LIKE INTERVAL IS HAVING LIMIT END CASE BETWEEN DISTINCT".split())


@cache
def _known() -> dict[str, tuple[str, str, str]]:
    """Function name -> (category, subcategory, name): calls in the catalogue's examples that are named as their entry, and the further spellings."""
    out: dict[str, tuple[str, str, str]] = {}
    for group, lines in CATEGORIES.items():
        category, _, sub = group.partition(".")
        for name, example, _, _ in lines:
            for call in _CALL.findall(example):
                if plain_name(call) == plain_name(name):
                    out.setdefault(call.lower(), (category, sub, name))
    return out | by_spelling()


def plain_name(name: str) -> str:
    """name without case and underscores."""
    return name.replace("_", "").lower()


def _close(text: str, at: int) -> int:
    """Where the bracket that opens before at closes."""
    depth, quote = 1, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return k
    return len(text)


_HIDDEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_BARE = re.compile(r"(?<![\w.])(?:" + "|".join(BARE) + r")\b(?!\s*\()", re.I)


def _without_strings(sql: str) -> str:
    """The text with blanks for what strings, quoted names and comments hold, so that every place stays where it is."""
    return _HIDDEN.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "'\"`" else " " * len(m[0]), sql)


def parses(sql: str) -> bool:
    """Whether Spark's parser takes the text; without a session, brackets alone are looked at."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return sql.count("(") == sql.count(")")
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # noqa: BLE001  any error means that it does not parse
        return False
    return True


def _is_call(plain: str, m: re.Match, end: int) -> bool:
    """Whether a name before a bracket is a function's: no keyword, filter clause, type, alias, or common table's column list."""
    before = plain[: m.start()].rstrip()
    if m[1].upper() in _NOT_CALLS or m[1].upper() == "FILTER" and before.endswith(")"):
        return False
    if re.search(r"\bAS$", before, re.I):
        return False
    return not (re.search(r"(?:\bWITH|\bRECURSIVE|,)$", before, re.I) and re.match(r"\s*AS\s*\(", plain[end:], re.I))


def functions_of(sql: str, dialect: str = "spark") -> list[dict[str, str]]:
    """category, subcategory, name and expression of each function and operator of a query; none if it doesn't parse.

    Of dialects other than spark, which Spark's parser does not know, only the brackets are looked at."""
    if not (parses(sql) if dialect == "spark" else sql.count("(") == sql.count(")")):
        return []
    plain, out = _without_strings(sql), []
    add = lambda kind, text: out.append(dict(zip(("category", "subcategory", "name", "expression"), (*kind, text))))
    for m in _CALL.finditer(plain):
        end = _close(plain, m.end()) + 1
        if not _is_call(plain, m, end):
            continue
        name = m[1].lower()
        over = re.match(r"\s*(?:FILTER\s*\([^)]*\)\s*)?OVER\b", plain[end:], re.I)
        kind = _known().get(name, ("scalar", "other", m[1]))
        if over:
            kind = ("window", _WINDOW.get(name, "aggregate"), kind[2])
        add(kind, sql[m.start() : end])
    for m in _BARE.finditer(plain):
        add(_known().get(m[0].lower(), ("scalar", "datetime", m[0])), m[0])
    for m in re.finditer(r"\bCASE\b", plain, re.I):
        add(("conditional", "case", "Case"), sql[m.start() : m.end()])
    for m in _FIELD.finditer(plain):
        add(("scalar", "struct_access", "Dot"), sql[m.start() : m.end()])
    for m in _SIGN.finditer(plain):
        sign, before = " ".join(m[0].upper().split()), plain[: m.start()]
        if sign == "*" and re.search(r"(?:\(|SELECT|DISTINCT|,|\.)\s*$", before, re.I):
            continue  # the star of count(*) and select lists
        if sign == "->" and not re.match(r"\s*['$]", plain[m.end() :]):
            continue  # a lambda's arrow
        if sign in "+-" and _NO_OPERAND.search(before):
            if sign == "-":
                add(("scalar", "arithmetic", "Neg"), sql[m.start() : m.end()])
            continue
        add(OPERATORS[sign], sql[m.start() : m.end()])
    return out
