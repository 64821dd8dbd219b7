"""The pattern graph, built from text or by hand."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import PatternGraphError
from .ast import Expr, PatternAst
from .parser import parse_pattern
from .rewrite import conjuncts
from .validate import type_of, validate


@dataclass(frozen=True)
class Pair:
    """What two different pattern vertices ask of their images, seen from the first: labels of
    edges that come in, that go out, and that may do either."""

    incoming: frozenset[int] = frozenset()
    outgoing: frozenset[int] = frozenset()
    either: frozenset[int] = frozenset()

    def turned(self) -> Pair:
        return Pair(self.outgoing, self.incoming, self.either)

    def size(self) -> int:
        return len(self.incoming) + len(self.outgoing) + len(self.either)

    def labels(self) -> frozenset[int]:
        return self.incoming | self.outgoing | self.either


@dataclass
class Pattern:
    labels: dict[int, int] = field(default_factory=dict)
    pairs: dict[tuple[int, int], Pair] = field(default_factory=dict)  # both ways
    loops: dict[int, frozenset[int]] = field(default_factory=dict)
    constraints: list[Expr] = field(default_factory=list)

    def elabels(self) -> set[int]:
        """Labels of edges between different vertices."""
        return {k for x in self.pairs.values() for k in x.labels()}

    # building

    def add_vertex(self, u: int, label: int) -> Pattern:
        if u in self.labels:
            raise PatternGraphError(f"u{u} is declared twice")
        self.labels[u] = label
        return self

    def _known(self, *some: int) -> None:
        for u in some:
            if u not in self.labels:
                raise PatternGraphError(f"u{u} isn't declared")

    def _put(self, a: int, b: int, pair: Pair) -> None:
        self.pairs[a, b], self.pairs[b, a] = pair, pair.turned()

    def add_arc(self, a: int, b: int, label: int) -> Pattern:
        self._known(a, b)
        if a == b:
            self.loops[a] = self.loops.get(a, frozenset()) | {label}
            return self
        p = self.pairs.get((a, b), Pair())
        if label in p.outgoing:
            raise PatternGraphError("an arc is declared twice")
        self._put(a, b, Pair(p.incoming, p.outgoing | {label}, p.either))
        return self

    def add_edge(self, a: int, b: int, label: int) -> Pattern:
        self._known(a, b)
        if a == b:
            raise PatternGraphError(f"an edge from u{a} to itself")
        p = self.pairs.get((a, b), Pair())
        if label in p.either:
            raise PatternGraphError("an edge is declared twice")
        self._put(a, b, Pair(p.incoming, p.outgoing, p.either | {label}))
        return self

    def add_constraint(self, e: Expr) -> Pattern:
        if type_of(e, frozenset(self.labels)) != "bool":
            raise PatternGraphError("a constraint must be boolean")
        self.constraints += conjuncts(e)
        return self

    def add_vertex_constraint(self, u: int, e: Expr) -> Pattern:
        self._known(u)
        if not e.vertices() <= {u}:
            raise PatternGraphError(f"the constraint isn't on u{u} alone")
        return self.add_constraint(e)

    def add_edge_constraint(self, a: int, b: int, e: Expr) -> Pattern:
        self._known(a, b)
        if (a, b) not in self.pairs:
            raise PatternGraphError(f"u{a} and u{b} aren't neighbours")
        if not e.vertices() <= {a, b}:
            raise PatternGraphError(f"the constraint isn't on u{a} and u{b} alone")
        return self.add_constraint(e)

    def remove_vertex(self, u: int) -> Pattern:
        self._known(u)
        del self.labels[u]
        self.loops.pop(u, None)
        self.pairs = {k: p for k, p in self.pairs.items() if u not in k}
        self.constraints = [e for e in self.constraints if u not in e.vertices()]
        return self

    # reading

    def vertices(self) -> list[tuple[int, int]]:
        return sorted(self.labels.items())

    def arcs(self) -> list[tuple[int, int, int]]:
        return sorted([(a, b, k) for (a, b), p in self.pairs.items() for k in p.outgoing] + [(u, u, k) for u, some in self.loops.items() for k in some])

    def edges(self) -> list[tuple[int, int, int]]:
        return sorted((a, b, k) for (a, b), p in self.pairs.items() if a < b for k in p.either)

    def vlabel(self, u: int) -> int | None:
        return self.labels.get(u)

    def neighbors(self, u: int) -> dict[int, Pair]:
        return {b: p for (a, b), p in sorted(self.pairs.items()) if a == u}

    def in_deg(self, u: int) -> int:
        return sum(len(p.incoming) for p in self.neighbors(u).values())

    def out_deg(self, u: int) -> int:
        return sum(len(p.outgoing) for p in self.neighbors(u).values())

    def undirected_deg(self, u: int) -> int:
        return sum(len(p.either) for p in self.neighbors(u).values())

    def on_vertex(self, u: int) -> list[Expr]:
        return [e for e in self.constraints if e.vertices() == {u}]

    def on_pair(self, a: int, b: int) -> list[Expr]:
        return [e for e in self.constraints if e.vertices() == {a, b} and (a, b) in self.pairs]

    def components(self) -> list[list[int]]:
        """Connected parts, each sorted, by their least vertex."""
        left, out = set(self.labels), []
        while left:
            some, front = set(), [min(left)]
            while front:
                u = front.pop()
                if u not in some:
                    some.add(u)
                    front += self.neighbors(u)
            out.append(sorted(some))
            left -= some
        return out

    def restricted(self, some: list[int]) -> Pattern:
        keep = set(some)
        return Pattern(
            {u: k for u, k in self.labels.items() if u in keep}, {k: p for k, p in self.pairs.items() if set(k) <= keep},
            {u: k for u, k in self.loops.items() if u in keep}, [e for e in self.constraints if e.vertices() and e.vertices() <= keep],
        )

    def injective(self) -> Pattern:
        """The same, with pairwise different images of vertices that have one label."""
        from .ast import op, vertex

        out = Pattern(dict(self.labels), dict(self.pairs), dict(self.loops), list(self.constraints))
        some = out.vertices()
        out.constraints += [op("!=", vertex(a), vertex(b)) for k, (a, x) in enumerate(some) for b, y in some[k + 1 :] if x == y]
        return out

    def last_wins(self) -> Pattern:
        """Only the last constraint of each vertex and of each pair of neighbours; no others."""
        last: dict[frozenset[int], Expr] = {}
        for e in self.constraints:
            on = e.vertices()
            if len(on) == 1 or len(on) == 2 and tuple(on) in self.pairs:
                last[on] = e
        return Pattern(dict(self.labels), dict(self.pairs), dict(self.loops), list(last.values()))


def build_pattern(ast: PatternAst) -> Pattern:
    p = Pattern()
    for u, k in ast.vertices:
        p.add_vertex(u, k)
    for a, b, k in ast.arcs:
        p.add_arc(a, b, k)
    for a, b, k in ast.edges:
        p.add_edge(a, b, k)
    p.constraints = conjuncts(ast.where)
    return p


def as_pattern(text: str | Pattern) -> Pattern:
    return text if isinstance(text, Pattern) else build_pattern(validate(parse_pattern(text)))
