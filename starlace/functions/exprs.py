"""Constraints as Spark columns and as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import Expr

_BUILD: dict[str, Callable[..., Column]] = {
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a,
    "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "%": lambda a, b: a % b,
}
_SQL = {"and": "AND", "or": "OR", "=": "=", "!=": "<>", "<": "<", ">=": ">=", "%": "%"}


def _divides(e: Expr) -> bool:
    return any(x.kind == "%" and x.args[1].kind != "int" for x in e.walk())


def to_column(e: Expr, name: Callable[[int], Column] = lambda n: F.col(f"u{n}")) -> Column:
    """and, or evaluate the right side only where the left leaves it open if it could divide by zero."""
    if e.kind == "vertex":
        return name(e.value)
    if e.kind == "int":
        return F.lit(e.value).cast("bigint")
    if e.kind == "bool":
        return F.lit(e.value)
    args = [to_column(a, name) for a in e.args]
    if e.kind == "and" and _divides(e.args[1]):
        return F.when(args[0], args[1]).otherwise(F.lit(False))
    if e.kind == "or" and _divides(e.args[1]):
        return F.when(args[0], F.lit(True)).otherwise(args[1])
    return _BUILD[e.kind](*args)


def to_sql(e: Expr, name: Callable[[int], str] = lambda n: f"u{n}") -> str:
    if e.kind == "vertex":
        return name(e.value)
    if e.kind == "int":
        return f"CAST({e.value} AS BIGINT)"
    if e.kind == "bool":
        return "TRUE" if e.value else "FALSE"
    if e.kind == "not":
        return f"(NOT {to_sql(e.args[0], name)})"
    return f"({to_sql(e.args[0], name)} {_SQL[e.kind]} {to_sql(e.args[1], name)})"
