"""A pattern as ANSI SQL over v(vid, vlabel), e(src, dst, elabel) and ed, e without repeats."""

from __future__ import annotations

from ..functions.exprs import to_sql
from .pattern import Pattern, as_pattern


def _pair(p: Pattern, a: int, b: int) -> str:
    want = p.pairs[a, b]
    out = lambda k, t="ed": f"SELECT src AS u{a}, dst AS u{b} FROM {t} WHERE elabel = {k}"
    back = lambda k, t="ed": f"SELECT dst AS u{a}, src AS u{b} FROM {t} WHERE elabel = {k}"
    parts = [out(k) for k in sorted(want.outgoing)] + [back(k) for k in sorted(want.incoming)]
    for k in sorted(want.either):
        used = int(k in want.outgoing) + int(k in want.incoming)
        if not used:
            parts.append(f"SELECT * FROM ({out(k)} UNION {back(k)})")
        else:
            parts.append(f"SELECT u{a}, u{b} FROM ({out(k, 'e')} UNION ALL {back(k, 'e')}) GROUP BY u{a}, u{b} HAVING count(*) - {used} >= 1")
    return " INTERSECT ".join(f"({x})" for x in parts)


def body(p: Pattern) -> str:
    """FROM and WHERE."""
    done: list[int] = []
    text = ""
    left = [k for k in sorted(p.pairs) if k[0] < k[1]]
    while left:
        k = next((k for k in left if set(k) & set(done)), left[0])
        left.remove(k)
        on = [f"u{n}" for n in k if n in done]
        sub = f"({_pair(p, *k)}) AS p{k[0]}_{k[1]}"
        text += (f" JOIN {sub} USING ({', '.join(on)})" if on else f" CROSS JOIN {sub}") if text else f"FROM {sub}"
        done += [n for n in k if n not in done]
    for n, label in p.vertices():
        scan = f"(SELECT vid AS u{n} FROM v WHERE vlabel = {label}) AS v{n}"
        text += (f" JOIN {scan} USING (u{n})" if n in done else f" CROSS JOIN {scan}") if text else f"FROM {scan}"
    where = [f"EXISTS (SELECT 1 FROM ed WHERE src = u{n} AND dst = u{n} AND elabel = {k})" for n, some in sorted(p.loops.items()) for k in sorted(some)]
    where += [to_sql(e) for e in p.constraints]
    return text + (" WHERE " + " AND ".join(where) if where else "")


def rows(pattern: str | Pattern) -> str:
    p = as_pattern(pattern)
    return f"SELECT {', '.join(f'u{n}' for n, _ in p.vertices())} {body(p)}"


def count(pattern: str | Pattern) -> str:
    return f"SELECT count(*)::BIGINT AS n {body(as_pattern(pattern))}"


def elabels(pattern: str | Pattern) -> set[int]:
    p = as_pattern(pattern)
    return p.elabels() | {k for some in p.loops.values() for k in some}
