"""Boolean trigram queries derived from regular expressions.

A query is True (no demand), or a tuple ("and" | "or", parts) whose leaves are trigrams. It holds for every text, in
lower case, in which the expression matches; the converse is left to verification.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser

Query = bool | str | tuple
MOST = 24  # strings that a stretch may stand for before it is cut
MANDATORY = 2  # trigrams of a conjunction that a thinned query keeps
#: The letters by falling frequency in English prose.
_FREQUENT = "etaoinsrhdlucmfywgpbvkxqjz"


def _all(parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        if p is not True:
            flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = sorted(set(flat), key=repr)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    flat = sorted(set(parts), key=repr)
    demands = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
    flat = [p for p in flat if not any(demands[q] < demands[p] for q in flat)]  # what demands more is implied
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of_strings(strings: set[str]) -> Query:
    """Some of these strings occurs."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _set_members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is kinds.LITERAL:
            out.add(chr(arg).lower())
        elif op is kinds.RANGE and arg[1] - arg[0] < MOST:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _exact(node: tuple) -> set[str] | None:
    """All strings the node stands for, if few."""
    op, arg = node
    if op is kinds.LITERAL:
        return {chr(arg).lower()}
    if op is kinds.IN:
        return _set_members(arg)
    if op is kinds.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is kinds.BRANCH:
        found = [_exact_sequence(x) for x in arg[1]]
        joined = None if any(x is None for x in found) else set().union(*found)
        return joined if joined is not None and len(joined) <= MOST else None
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[1] != kinds.MAXREPEAT and arg[1] <= 2:
        one = _exact_sequence(arg[2])
        if one is None:
            return None
        out, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
        return out if len(out) <= MOST else None
    return None


def _exact_sequence(nodes) -> set[str] | None:
    strings = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(strings) * len(more) > MOST:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _sequence(nodes) -> Query:
    demands: list[Query] = []
    strings = {""}
    for node in nodes:
        op, arg = node
        more = _exact(node)
        if more is not None and len(strings) * len(more) <= MOST:
            strings = {a + b for a in strings for b in more}
            continue
        demands.append(_of_strings(strings))
        strings = {""} if more is None else more
        if more is not None:
            continue
        if op is kinds.SUBPATTERN:
            demands.append(_sequence(arg[3]))
        elif op is kinds.BRANCH:
            demands.append(_any([_sequence(x) for x in arg[1]]))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] > 0:
            demands.append(_sequence(arg[2]))
    return _all([*demands, _of_strings(strings)])


def trigram_query(pattern: str) -> Query:
    """The query of a regular expression; lower case, as the index holds trigrams of lower-cased text."""
    return _sequence(parser.parse(pattern, re.ASCII))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _rarity(gram: str) -> tuple[int, str]:
    return -sum(_FREQUENT.index(c) if c in _FREQUENT else len(_FREQUENT) for c in gram), gram


def thinned(query: Query) -> Query:
    """A query that the given one implies, with the ``MANDATORY`` trigrams of each conjunction that prose has least."""
    if not isinstance(query, tuple):
        return query
    if query[0] == "or":
        return _any([thinned(p) for p in query[1]])
    grams = sorted((p for p in query[1] if isinstance(p, str)), key=_rarity)
    return _all([*grams[:MANDATORY], *(thinned(p) for p in query[1] if not isinstance(p, str))])
