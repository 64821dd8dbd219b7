"""Syntax of patterns: vertices, arcs, edges and one boolean constraint."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

#: Operators of two arguments by their sign: (type of the arguments, type of the result).
BINARY = {
    "and": ("bool", "bool"), "or": ("bool", "bool"),
    "<": ("int", "bool"), ">=": ("int", "bool"), "=": ("int", "bool"), "!=": ("int", "bool"), "%": ("int", "int"),
}


@dataclass(frozen=True)
class Expr:
    """kind: vertex, int, bool, not, or a sign of BINARY; value: of the first three."""

    kind: str
    value: int | bool | None = None
    args: tuple[Expr, ...] = ()

    def vertices(self) -> frozenset[int]:
        if self.kind == "vertex":
            return frozenset([self.value])
        return frozenset().union(*(a.vertices() for a in self.args))

    def renamed(self, names: dict[int, int]) -> Expr:
        if self.kind == "vertex":
            return Expr("vertex", names.get(self.value, self.value))
        return Expr(self.kind, self.value, tuple(a.renamed(names) for a in self.args))

    def walk(self) -> Iterator[Expr]:
        yield self
        for a in self.args:
            yield from a.walk()

    def __str__(self) -> str:
        if self.kind == "vertex":
            return f"u{self.value}"
        if self.kind == "int":
            return str(self.value)
        if self.kind == "bool":
            return "#t" if self.value else "#f"
        return f"({self.kind} {' '.join(map(str, self.args))})"


def vertex(n: int) -> Expr:
    return Expr("vertex", n)


def integer(n: int) -> Expr:
    return Expr("int", n)


def boolean(x: bool) -> Expr:
    return Expr("bool", x)


def op(kind: str, *args: Expr) -> Expr:
    return Expr(kind, None, args)


@dataclass(frozen=True)
class PatternAst:
    """vertices: (id, label); arcs and edges: (id, id, label), in the order of the text."""

    vertices: tuple[tuple[int, int], ...]
    arcs: tuple[tuple[int, int, int], ...] = ()
    edges: tuple[tuple[int, int, int], ...] = ()
    where: Expr | None = None

    def __str__(self) -> str:
        parts = ["(vertices " + " ".join(f"(u{u} {k})" for u, k in self.vertices) + ")"]
        for name, some in (("arcs", self.arcs), ("edges", self.edges)):
            if some:
                parts.append(f"({name} " + " ".join(f"(u{a} u{b} {k})" for a, b, k in some) + ")")
        if self.where is not None:
            parts.append(f"(where {self.where})")
        return f"(match {' '.join(parts)})"


@dataclass
class Cursor:
    """A place in a list of tokens."""

    tokens: list[tuple[str, int]]
    text: str
    at: int = 0
    depth: int = field(default=0)
