"""Boolean trigram queries from regular expressions.

A query is a set of alternatives, each a set of trigrams: a text can match the
expression only if it holds all trigrams of one alternative. Letters are folded to
lower case, so the query asks for no more than the expression does. An expression
without mandatory trigrams gives the alternative without any: it matches all.
"""

from __future__ import annotations

from itertools import product
from re import _constants as c
from re import _parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_STRINGS = 64  # exact strings followed at once; beyond that the expression counts as free there
_ALTERNATIVES = 256


def query(expression: str) -> Query:
    words, asked = _sequence(_parser.parse(expression))
    return _simple(_and(asked, _of_words(words)))


def _of_words(words: set[str]) -> Query:
    return frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)


def _and(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= _ALTERNATIVES else a


def _simple(q: Query) -> Query:
    """Alternatives that ask for more than another one say nothing new."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _sequence(tree) -> tuple[set[str], Query]:
    """Strings the end of the sequence may be, exact as far as known, and what was asked before it."""
    words, asked = {""}, ANY
    for op, arg in tree:
        exact = _exact(op, arg)
        if exact is not None and len(words) * len(exact) <= _STRINGS:
            words = {w + e for w in words for e in exact}
            continue
        asked = _and(asked, _of_words(words))
        words = {""}
        if exact is not None and len(exact) <= _STRINGS:
            words = exact
        else:
            asked = _and(asked, _inside(op, arg))
    return words, asked


def _exact(op, arg) -> set[str] | None:
    """All strings a node matches, lower case, if they are few."""
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.IN:
        chars = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                chars.add(chr(value).lower())
            elif kind is c.RANGE and value[1] - value[0] < 8:
                chars.update(chr(x).lower() for x in range(value[0], value[1] + 1))
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is c.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is c.BRANCH:
        found = [_exact_sequence(b) for b in arg[1]]
        return None if any(f is None for f in found) else set().union(*found)
    if op is c.MAX_REPEAT and arg[1] != c.MAXREPEAT and arg[1] <= 3:
        inner = _exact_sequence(arg[2])
        if inner is None or len(inner) ** arg[1] > _STRINGS:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    if op is c.AT:
        return {""}
    return None


def _exact_sequence(tree) -> set[str] | None:
    words = {""}
    for op, arg in tree:
        exact = _exact(op, arg)
        if exact is None or len(words) * len(exact) > _STRINGS:
            return None
        words = {w + e for w in words for e in exact}
    return words


def _inside(op, arg) -> Query:
    """What a node asks for by itself."""
    if op is c.SUBPATTERN:
        words, asked = _sequence(arg[-1])
        return _and(asked, _of_words(words))
    if op is c.BRANCH:
        out: Query = frozenset()
        for branch in arg[1]:
            words, asked = _sequence(branch)
            out |= _and(asked, _of_words(words))
        return _simple(out)
    if op is c.MAX_REPEAT and arg[0] > 0:
        words, asked = _sequence(arg[2])
        return _and(asked, _of_words(words))
    return ANY
