"""Boolean trigram queries of regular expressions.

``query(pattern)`` gives a set of clauses, each a set of trigrams: whatever the pattern matches holds,
in lower case, all trigrams of at least one clause. ``None`` says that no trigram is mandatory. Strings
are followed through literals, alternatives, optional parts and small classes; anything else ends them.
"""

from __future__ import annotations

from re import _constants as C, _parser

Clauses = frozenset[frozenset[str]]
_MOST_STRINGS, _MOST_CLASS = 64, 8


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _either(clauses) -> Clauses | None:
    """The clauses without those that another one makes needless; None if one of them asks for nothing."""
    clauses = set(clauses)
    if frozenset() in clauses:
        return None
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return a if b is None else b
    made = _either(x | y for x in a for y in b)
    return made if made is None or len(made) <= _MOST_STRINGS else min(a, b, key=len)


def _of(strings: set[str]) -> Clauses | None:
    return _either(_trigrams(s) for s in strings)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < _MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= _MOST_CLASS else None


def _walk(parsed) -> tuple[set[str] | None, Clauses | None]:
    """(all strings it can match, if they are few; clauses that hold for what it matches)."""
    run: set[str] = {""}
    whole, need = True, None
    for op, arg in parsed:
        strings, clauses = _node(op, arg)
        need = _both(need, clauses)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        need = _both(need, _of(run))
        run, whole = (strings if strings is not None else {""}), False
    return (run, None) if whole else (None, _both(need, _of(run)))


def _node(op, arg) -> tuple[set[str] | None, Clauses | None]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, None
    if op is C.IN:
        return _class(arg), None
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        parts = [_walk(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            made = set().union(*(s for s, _ in parts))
            if len(made) <= _MOST_STRINGS:
                return made, None
        each = [_of(s) if s is not None else q for s, q in parts]
        return None, None if any(q is None for q in each) else _either(c for q in each for c in q)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, sub = arg
        strings, clauses = _walk(sub)
        if (least, most) == (0, 1):
            return (strings | {""} if strings is not None else None), None
        if least == most and strings is not None and len(strings) ** least <= _MOST_STRINGS:
            made = {""}
            for _ in range(least):
                made = {a + b for a in made for b in strings}
            return made, None
        return None, clauses if least and strings is None else (_of(strings) if least and strings is not None else None)
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}, None
    return None, None


def query(pattern: str) -> Clauses | None:
    strings, clauses = _walk(_parser.parse(pattern))
    return clauses if strings is None else _of(strings)
