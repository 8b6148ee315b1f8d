"""Generators that turn small fixed rule lists into Column expressions.

Every phrase test is a plain substring test on lower-cased text (``"bp"``
matches inside ``"subpar"``), never a token or regex match.  The rule lists
are short and fixed, so each generator emits one expression that Catalyst
compiles into the scan's whole-stage-codegen span: no join, no shuffle, no
Python on the executors.

Each generator has a ``sql_*`` twin that emits the same logic as DuckDB SQL
text for the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def lower_join(*cols: Column | str, sep: str = " ") -> Column:
    """lower(c1 + sep + c2 ...) with nulls treated as ''."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.lower(F.concat_ws(sep, *parts))


def any_contains(text: Column, phrases: Iterable[str]) -> Column:
    phrases = list(phrases)
    cond = F.lit(False)
    for p in phrases:
        cond = cond | text.contains(p)
    return cond


def first_match(text: Column, rules: Sequence[tuple[Sequence[str], object]], default: Column) -> Column:
    """Value of the first rule whose phrases occur in ``text``; else ``default``."""
    expr = None
    for phrases, value in rules:
        cond = any_contains(text, phrases)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return default if expr is None else expr.otherwise(default)


def points(text: Column, table: Sequence[tuple[Sequence[str], int]]) -> Column:
    """Sum of the points of every rule with at least one phrase present."""
    total = F.lit(0)
    for phrases, pts in table:
        total = total + F.when(any_contains(text, phrases), F.lit(pts)).otherwise(F.lit(0))
    return total


def found(text: Column, phrases: Sequence[str]) -> Column:
    """array<string> of the phrases present, in list order."""
    return F.filter(
        F.array(*[F.when(text.contains(p), F.lit(p)) for p in phrases]),
        lambda x: x.isNotNull(),
    )


def band(score: Column, bands: Sequence[tuple], default, pick: int = 1) -> Column:
    """``bands`` = [(lower_bound, v1, v2...)] checked top-down with >=."""
    expr = None
    for b in bands:
        cond = score >= F.lit(b[0])
        expr = F.when(cond, F.lit(b[pick])) if expr is None else expr.when(cond, F.lit(b[pick]))
    return expr.otherwise(F.lit(default))


# --- SQL twins (DuckDB) ------------------------------------------------------

def q(value: str) -> str:
    """SQL string literal."""
    return "'" + str(value).replace("'", "''") + "'"


def sql_lit(value) -> str:
    if isinstance(value, str):
        return q(value)
    if value is None:
        return "NULL"
    return repr(value)


def sql_lower_join(*cols: str, sep: str = " ") -> str:
    return "lower(concat_ws(" + q(sep) + ", " + ", ".join(f"coalesce({c}, '')" for c in cols) + "))"


def sql_any_contains(text: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def sql_first_match(text: str, rules: Sequence[tuple[Sequence[str], object]], default: str) -> str:
    whens = " ".join(f"WHEN {sql_any_contains(text, p)} THEN {sql_lit(v)}" for p, v in rules)
    return f"(CASE {whens} ELSE {default} END)"


def sql_points(text: str, table: Sequence[tuple[Sequence[str], int]]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {sql_any_contains(text, p)} THEN {pts} ELSE 0 END)" for p, pts in table) + ")"


def sql_found(text: str, phrases: Sequence[str]) -> str:
    items = ", ".join(f"CASE WHEN contains({text}, {q(p)}) THEN {q(p)} END" for p in phrases)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sql_band(score: str, bands: Sequence[tuple], default, pick: int = 1) -> str:
    whens = " ".join(f"WHEN {score} >= {b[0]} THEN {sql_lit(b[pick])}" for b in bands)
    return f"(CASE {whens} ELSE {sql_lit(default)} END)"
