"""Which trigrams a text must hold if a regular expression matches it.

The answer is a set of sets: the text has all trigrams of at least one of them.  The set that
holds the empty set says nothing, and the text has to be looked at.  Case is folded: trigrams
are those of the text in lower case.  Derived from the parsed expression by what is known of
its parts: the few strings that a part can be, or those that it starts and ends with, and
the trigrams that it needs inside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])

# More strings than this are not followed, and more alternatives are not combined; either only makes the query weaker.
MOST_STRINGS = 32
MOST_ALTERNATIVES = 256
MOST_CHARACTERS = 8


@dataclass(frozen=True)
class Part:
    """What is known of the texts that a part matches: all of them, or how they start and end."""

    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    needs: Query


NOTHING = frozenset([""])
UNKNOWN = Part(None, NOTHING, NOTHING, ANYTHING)


def _exactly(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, ANYTHING)


def simplest(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(one for one in query if not any(other < one for other in query))


def both(a: Query, b: Query) -> Query:
    joined = simplest(frozenset(x | y for x, y in product(a, b)))
    return joined if len(joined) <= MOST_ALTERNATIVES else a


def either(a: Query, b: Query) -> Query:
    joined = simplest(a | b)
    return joined if len(joined) <= MOST_ALTERNATIVES else ANYTHING


def held(strings: frozenset[str]) -> Query:
    """The trigrams of a text that contains one of the strings."""
    return simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _open(part: Part) -> Part:
    """The same part with its strings turned into trigrams."""
    return part if part.exact is None else Part(None, part.exact, part.exact, both(part.needs, held(part.exact)))


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= MOST_STRINGS else None


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        strings = _cross(a.exact, b.exact)
        if strings is not None:
            return _exactly(strings)
    middle = _cross(a.ends, b.starts)
    starts = _cross(a.exact, b.starts) if a.exact is not None else a.starts
    ends = _cross(a.ends, b.exact) if b.exact is not None else b.ends
    needs = both(_open(a).needs, _open(b).needs)
    if middle is not None:
        needs = both(needs, held(middle))
    return Part(None, a.exact if starts is None else starts, b.exact if ends is None else ends, needs)


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _exactly(a.exact | b.exact)
    a, b = _open(a), _open(b)
    starts, ends = a.starts | b.starts, a.ends | b.ends
    return Part(
        None,
        starts if len(starts) <= MOST_STRINGS else NOTHING,
        ends if len(ends) <= MOST_STRINGS else NOTHING,
        either(a.needs, b.needs),
    )


def _characters(members: list) -> Part:
    """A set of characters."""
    found: set[str] = set()
    for kind, value in members:
        name = str(kind)
        if name == "LITERAL":
            found.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 2 * MOST_CHARACTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    return _exactly(frozenset(found)) if len(found) <= MOST_CHARACTERS else UNKNOWN


def _repeated(least: int, most: int, inner: Part) -> Part:
    if least == 0:
        return _or(_exactly(NOTHING), inner) if most == 1 else UNKNOWN
    if least == most == 1:
        return inner
    once = _open(inner)
    return Part(None, once.starts, once.ends, once.needs)


def _part(node: tuple) -> Part:
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return _exactly(frozenset([chr(value).lower()]))
    if kind == "IN":
        return _characters(value)
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "ATOMIC_GROUP":
        return _sequence(value)
    if kind == "BRANCH":
        return reduce(_or, [_sequence(branch) for branch in value[1]])
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return _repeated(int(value[0]), int(value[1]), _sequence(value[2]))
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return _exactly(NOTHING)
    return UNKNOWN


def _sequence(nodes) -> Part:
    return reduce(_then, [_part(node) for node in nodes], _exactly(NOTHING))


def trigram_query(pattern: str) -> Query:
    """The trigrams that a matched text needs, as alternatives of which one is there whole."""
    return _open(_sequence(re._parser.parse(pattern))).needs
