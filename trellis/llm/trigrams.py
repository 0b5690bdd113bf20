"""Boolean trigram queries of regular expressions, after Cox (Regular Expression Matching with a Trigram Index, 2012).

A part of a regex is known by the strings it may be exactly (where they are few), or else by the strings that it may begin and
end with, and by what any match must hold: a formula in disjunctive form, a list of alternatives, each a set of trigrams. All
is in lower case. What isn't understood is taken as any text at all, so that a query may be too weak, never too strong.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

#: Strings, and alternatives of a formula, that are carried along; more of them are made fewer by weakening.
MOST_STRINGS, MOST_ALTERNATIVES, MOST_CHARS = 16, 64, 16
Formula = frozenset  # of frozensets of trigrams: any of them, all of its trigrams; {{}} holds always
ALWAYS: Formula = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    must: Formula


ANY = Part(None, frozenset([""]), frozenset([""]), ALWAYS)


def _least(formula: Formula) -> Formula:
    """Without alternatives that another one implies; weakened to always if there are too many."""
    out = frozenset(a for a in formula if not any(b < a for b in formula))
    return out if len(out) <= MOST_ALTERNATIVES else ALWAYS


def _both(a: Formula, b: Formula) -> Formula:
    if len(a) * len(b) > MOST_ALTERNATIVES**2:
        return a if len(a) <= len(b) else b
    both = _least(frozenset(x | y for x, y in product(a, b)))
    return both if both != ALWAYS else a if a != ALWAYS else b


def _either(a: Formula, b: Formula) -> Formula:
    return _least(a | b)


def _held(strings: frozenset[str]) -> Formula:
    """A text holds one of the strings: their trigrams; always, if one of them has none."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _shorter(part: Part) -> Part:
    """Sets of strings of bounded size; what is cut off is kept as trigrams."""
    exact, begins, ends, must = part.exact, part.begins, part.ends, part.must
    if exact is not None and (len(exact) > MOST_STRINGS or any(len(s) > MOST_CHARS for s in exact)):
        must = _both(must, _held(exact))
        exact, begins, ends = None, exact, exact
    if exact is None:
        must = _both(must, _both(_held(begins), _held(ends)))
        for size in (2, 1, 0):
            begins = frozenset(s[:size] for s in begins) if any(len(s) > size for s in begins) and (size == 2 or len(begins) > MOST_STRINGS) else begins
            ends = frozenset(s[len(s) - size :] if len(s) > size else s for s in ends) if any(len(s) > size for s in ends) and (size == 2 or len(ends) > MOST_STRINGS) else ends
    return Part(exact, begins, ends, must)


def _kept(part: Part) -> Part:
    """The part with what its exact strings hold, for when they are about to be mixed."""
    return part if part.exact is None else Part(part.exact, part.begins, part.ends, _both(part.must, _held(part.exact)))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        both = frozenset(x + y for x, y in product(a.exact, b.exact))
        return _shorter(Part(both, both, both, _both(a.must, b.must)))
    a, b = _kept(a), _kept(b)
    begins = frozenset(x + y for x, y in product(a.exact, b.begins)) if a.exact is not None else a.begins
    ends = frozenset(x + y for x, y in product(a.ends, b.exact)) if b.exact is not None else b.ends
    across = _held(frozenset(x + y for x, y in product(a.ends, b.begins)))
    return _shorter(Part(None, begins, ends, _both(_both(a.must, b.must), across)))


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        return _shorter(Part(a.exact | b.exact, a.exact | b.exact, a.exact | b.exact, _either(a.must, b.must)))
    a, b = (Part(None, p.begins, p.ends, _both(p.must, _held(p.exact)) if p.exact is not None else p.must) for p in (a, b))
    return _shorter(Part(None, a.begins | b.begins, a.ends | b.ends, _either(a.must, b.must)))


def _exactly(strings: frozenset[str]) -> Part:
    return _shorter(Part(strings, strings, strings, ALWAYS))


def _letters(items) -> frozenset[str] | None:
    """The characters of a class in lower case, where they are few and plain."""
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL" and value < 128:
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] < 128:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if 0 < len(out) <= MOST_STRINGS else None


def _sequence(tree) -> Part:
    out = _exactly(frozenset([""]))
    for kind, value in tree:
        out = _then(out, _part(str(kind), value))
    return out


def _part(kind: str, value) -> Part:
    if kind == "LITERAL":
        return _exactly(frozenset([chr(value).lower()])) if value < 128 else ANY
    if kind == "IN" and (letters := _letters(value)):
        return _exactly(letters)
    if kind == "SUBPATTERN":
        return _sequence(value[3])
    if kind == "BRANCH":
        out = _sequence(value[1][0])
        for other in value[1][1:]:
            out = _or(out, _sequence(other))
        return out
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        one = _sequence(inner)
        if low == 0:
            return _or(_exactly(frozenset([""])), one) if high == 1 else ANY
        out = one
        for _ in range(min(low, MOST_CHARS) - 1):
            out = _then(out, one)
        return out if low == high and low <= MOST_CHARS else _then(out, ANY)
    if kind == "AT":  # a place, not a text
        return _exactly(frozenset([""]))
    if kind in ("ASSERT", "ASSERT_NOT"):
        return _exactly(frozenset([""]))
    return ANY


#: What Java and this parser read alike: no classes in classes, no other escapes than these, no flags but i, m and s.
_UNLIKE = re.compile(r"&&|\\[^dDwWsSbBAxtnrf\W]|\[[^\]]*\[|\(\?[a-zA-Z]*-|\(\?(?![ims]*[:)]|[=!]|<[=!])|\[\^?\]")


@lru_cache(maxsize=1024)
def _query(pattern: str) -> tuple[tuple[str, ...], ...]:
    from re import _parser

    if _UNLIKE.search(pattern):
        return ()
    try:
        whole = _sequence(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError, ValueError):
        return ()  # not a regex that is understood here
    must = _both(whole.must, _held(whole.exact) if whole.exact is not None else _both(_held(whole.begins), _held(whole.ends)))
    return () if frozenset() in must else tuple(sorted(tuple(sorted(a)) for a in must))


def query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams, of which any match of the regex holds all of at least one; none: any text may match."""
    return [list(a) for a in _query(pattern)]


#: Letters from the most to the least frequent in prose; all else is rarer.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def rarest_first(grams: list[str]) -> list[str]:
    """In an order in which a text that lacks one is likely found out at once."""
    common = lambda g: sum(len(_FREQUENT) - _FREQUENT.index(c) for c in g if c in _FREQUENT)
    return sorted(grams, key=lambda g: (common(g), g))
