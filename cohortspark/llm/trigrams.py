"""Boolean trigram queries that every match of a regular expression must satisfy."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: Largest set of exact strings kept while a pattern is read, and of clauses of a query.
MOST = 64

Clause = frozenset[str]
#: A disjunction of conjunctions of trigrams; an empty clause is always true.
Query = frozenset[Clause]

ANY: Query = frozenset([frozenset()])


def trigrams(text: str) -> Clause:
    return frozenset(text[n : n + 3] for n in range(len(text) - 2))


def either(a: Query, b: Query) -> Query:
    """Disjunction; clauses that another one implies go."""
    every = a | b
    least = frozenset(c for c in every if not any(d < c for d in every))
    return least if len(least) <= MOST else ANY


def both(a: Query, b: Query) -> Query:
    """Conjunction; an operand is left out where the product would grow too large."""
    if len(a) * len(b) > MOST:
        return a if len(a) <= len(b) else b
    return either(frozenset(c | d for c in a for d in b), frozenset())


def _of_strings(strings: set[str]) -> Query:
    out: Query = frozenset()
    for text in strings:
        out = either(out, frozenset([trigrams(text)]))
    return out


class _Sequence:
    """Exact strings read so far in a row, and the query of all that came before them."""

    def __init__(self):
        self.exact, self.query = {""}, ANY

    def add(self, exact: set[str] | None, query: Query) -> None:
        self.query = both(self.query, query)
        if exact is None or len(self.exact) * len(exact) > MOST:
            self.flush()
            self.exact = {""} if exact is None or len(exact) > MOST else set(exact)
        else:
            self.exact = {a + b for a in self.exact for b in exact}

    def flush(self) -> None:
        self.query = both(self.query, _of_strings(self.exact))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _read(items) -> tuple[set[str] | None, Query]:
    """Exact strings of a parsed pattern, if few, and its query."""
    row, exact_all = _Sequence(), True
    for kind, value in items:
        exact, query = None, ANY
        if kind is op.LITERAL:
            exact = {chr(value).lower()}
        elif kind is op.IN:
            exact = _class(value)
        elif kind is op.SUBPATTERN:
            exact, query = _read(value[3])
        elif kind is op.BRANCH:
            parts = [_read(branch) for branch in value[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                query = frozenset()
                for e, q in parts:
                    query = either(query, q if e is None else _of_strings(e))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            e, q = _read(inner)
            if (least, most) == (0, 1) and e is not None:
                exact = e | {""}
            elif least:
                row.add(e, q)  # one occurrence at least, then anything
                for _ in range(min(least, 4) - 1):
                    row.add(e, ANY)
                if least == most and least <= 4:
                    exact_all = exact_all and e is not None
                    continue
        elif kind is op.AT:
            exact = {""}
        exact_all = exact_all and exact is not None
        row.add(exact, query)
    if exact_all and len(row.exact) <= MOST and row.query == ANY:
        return row.exact, ANY
    row.flush()
    return None, row.query


def required(pattern: str) -> Query:
    """Trigrams of the lower-cased text that any match needs; ``ANY`` if there are none."""
    exact, query = _read(parser.parse(pattern, re.ASCII))
    return _of_strings(exact) if exact is not None else query
