"""Boolean trigram queries of regular expressions.

``query(pattern)`` gives a formula that every text matching the pattern satisfies, over
trigrams of the ASCII-lower-cased UTF-8 text: ``ALL`` (nothing is mandatory), a trigram (int code),
``("and", parts)`` or ``("or", parts)``.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

import numpy as np

ALL = ("and", ())
#: Largest set of alternative literal strings that is carried along a concatenation.
MOST_STRINGS = 64


def code(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def both(parts) -> object:
    flat: dict[object, None] = {}
    for p in parts:
        if isinstance(p, tuple) and p[0] == "and":
            flat.update(dict.fromkeys(p[1]))
        else:
            flat[p] = None
    return next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def either(parts) -> object:
    flat: dict[object, None] = {}
    for p in parts:
        if p == ALL:
            return ALL
        if isinstance(p, tuple) and p[0] == "or":
            flat.update(dict.fromkeys(p[1]))
        else:
            flat[p] = None
    return next(iter(flat)) if len(flat) == 1 else ("or", tuple(flat))


def of_strings(strings: set[bytes]) -> object:
    """One of these strings occurs."""
    return either(both(code(s[i : i + 3]) for i in range(len(s) - 2)) for s in sorted(strings))


def _chars(op, arg) -> set[bytes] | None:
    """The few characters a single-character node stands for, else None."""
    if op is C.LITERAL:
        return {bytes([arg]).lower()} if 0 < arg < 128 else None
    if op is C.IN:
        out: set[bytes] = set()
        for kind, a in arg:
            if kind is C.LITERAL and 0 < a < 128:
                out.add(bytes([a]).lower())
            elif kind is C.RANGE and 0 < a[0] and a[1] < 128 and a[1] - a[0] < 8:
                out |= {bytes([x]).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _walk(nodes) -> tuple[set[bytes] | None, object]:
    """(all strings the sequence stands for, or None; what is mandatory besides)."""
    current: set[bytes] = {b""}
    whole, must = True, ALL

    def flush() -> None:
        nonlocal current, whole, must
        must = both([must, of_strings(current)])
        current, whole = {b""}, False

    def append(strings: set[bytes]) -> None:
        nonlocal current
        if len(current) * len(strings) > MOST_STRINGS:
            flush()
        if len(strings) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}

    for op, arg in nodes:
        if op is C.AT or op is C.ASSERT_NOT or op is C.ASSERT:
            continue
        if (chars := _chars(op, arg)) is not None:
            append(chars)
        elif op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            strings, rest = _walk(arg[-1] if op is C.SUBPATTERN else arg)
            must = both([must, rest])
            append(strings) if strings is not None else flush()
        elif op is C.BRANCH:
            alternatives = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in alternatives):
                append(set().union(*(s for s, _ in alternatives)))
            else:
                flush()
                must = both([must, either(both([rest, of_strings(s)] if s is not None else [rest]) for s, rest in alternatives)])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, sub = arg
            strings, rest = _walk(sub)
            if least == 0:
                if strings is not None and most == 1:
                    append(strings | {b""})
                else:
                    flush()
                continue
            must = both([must, rest])
            if strings is None:
                flush()
                continue
            for _ in range(min(least, 3)):
                append(strings)
            if most != least or least > 3:
                flush()
        else:
            flush()
    if whole:
        return current, must
    return None, both([must, of_strings(current)])


def query(pattern: str, flags: int = 0) -> object:
    strings, must = _walk(P.parse(pattern, flags | re.ASCII))
    return both([must, of_strings(strings)]) if strings is not None else must


def named(q: object) -> set[int]:
    """Every trigram that a query names."""
    return {q} if isinstance(q, int) else set().union(*(named(p) for p in q[1]))


def trigram_pairs(texts: list[bytes], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, text number), sorted and distinct, over lower-cased UTF-8 texts; ``wanted`` is a mask of 2^24 trigrams."""
    flat = np.frombuffer(b"\0\0".join(texts) + b"\0\0", dtype=np.uint8)
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = flat[:-2].astype(np.int32) << 16
    codes |= flat[1:-1].astype(np.int32) << 8
    codes |= flat[2:]
    at = np.flatnonzero(wanted[codes]) if wanted is not None else np.flatnonzero((flat[:-2] != 0) & (flat[1:-1] != 0) & (flat[2:] != 0))
    ends = np.cumsum([len(t) + 2 for t in texts])
    doc = np.searchsorted(ends, at, side="right")
    pairs = np.unique(codes[at].astype(np.int64) << 32 | doc)
    return pairs >> 32, pairs & 0xFFFFFFFF


def matching(q: object, postings: dict[int, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Text numbers that satisfy a query: postings are intersected for "and", united for "or"."""
    if isinstance(q, int):
        return postings.get(q, np.empty(0, np.int64))
    kind, parts = q
    if not parts:
        return everything
    sets = sorted((matching(p, postings, everything) for p in parts), key=len)
    out = sets[0]
    for s in sets[1:]:
        out = np.intersect1d(out, s, assume_unique=True) if kind == "and" else np.union1d(out, s)
    return out
