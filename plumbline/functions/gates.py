"""Words without which an expression can't match, so that a scan runs it on few texts.

A text's words are looked up anyway; which rules can match at all follows from them. required() reads the parsed
expression: where its literals hold whole words, every match holds one of these words. What it can't tell isn't a
condition, so an expression of which nothing is known is run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # an interpreter without this parser: nothing is known of any expression
    _parser = None

#: Marks in expanded strings: a word boundary, and what isn't known.
_EDGE, _ANY = "\x01", "\x02"
_MOST = 4096
_RUN = re.compile(r"[0-9A-Za-z_]+")
#: Other characters that are or become ASCII letters when case is ignored or lowered. Of texts with one, words tell nothing.
FOLDED = "İıſK"


class _TooMany(Exception):
    pass


def _nonword(item: tuple) -> bool:
    """Whether a member of a class is white space or a character that is in no word."""
    op, x = item
    return (op is _c.LITERAL and not re.match(r"\w", chr(x))) or (op is _c.CATEGORY and x is _c.CATEGORY_SPACE)


def _one(op: object, x: object) -> set[str]:
    """The strings that an element stands for; white space and stops of a class as one space."""
    if op is _c.LITERAL:
        c = chr(x)
        return {c.lower()} if c.isascii() and c not in (_EDGE, _ANY) else {_ANY if re.match(r"\w", c) else " "}
    if op is _c.IN:
        return {" "} if all(map(_nonword, x)) else {_ANY}
    if op is _c.AT:
        return {_EDGE} if x is _c.AT_BOUNDARY else {_ANY}
    if op is _c.SUBPATTERN and not x[1] and not x[2]:
        return _strings(x[3])
    if op is _c.BRANCH:
        return set().union(*map(_strings, x[1]))
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = x
        if high == 1:
            return _strings(inner) | ({""} if low == 0 else set())
        if len(inner) == 1 and inner[0][0] in (_c.IN, _c.LITERAL) and _one(*inner[0]) == {" "}:
            return {" "} if low else {"", " "}
    return {_ANY}


def _strings(sequence: Iterable) -> set[str]:
    out = {""}
    for op, x in sequence:
        more = _one(op, x)
        if len(out) * len(more) > _MOST:
            raise _TooMany
        out = {a + b for a in out for b in more}
    return out


def _whole(s: str) -> str | None:
    """The longest run of letters that is a word of its own in every match of s; None if there is none."""
    best = None
    for m in _RUN.finditer(s):
        before, after = s[m.start() - 1 : m.start()] or _ANY, s[m.end() : m.end() + 1] or _ANY
        if _ANY not in (before, after) and (best is None or len(m[0]) > len(best)):
            best = m[0]
    return best


def required(regex: str, flags: int = re.I | re.M) -> list[frozenset[str]]:
    """Sets of lower-case words; every match in a text without FOLDED characters holds one of each set as a whole word."""
    if _parser is None:
        return []
    parsed = _parser.parse(regex, flags)
    if parsed.state.flags & (re.A | re.L):
        return []
    found: list[frozenset[str]] = []
    part = {_ANY}

    def close() -> None:
        words = {_whole(s + _ANY) for s in part}
        if None not in words:
            found.append(frozenset(words))

    for op, x in parsed:
        try:
            more = _one(op, x)
        except _TooMany:
            more = {_ANY}
        if more == {_ANY} or len(part) * len(more) > _MOST:
            close()
            part = {_ANY}
        if more != {_ANY} and len(more) <= _MOST:
            part = {a + b for a in part for b in more}
    close()
    return found


def longest(regex: str, flags: int = re.I | re.M) -> int:
    """The most characters of a match; very many where there is no bound or none is known."""
    return int(_parser.parse(regex, flags).getwidth()[1]) if _parser else 1 << 32


class Gates:
    """The conditions of many expressions, as bits of words."""

    def __init__(self, regexes: Iterable[str | None]) -> None:
        sets = [required(r) if r else [] for r in regexes]
        number = {s: k for k, s in enumerate(dict.fromkeys(s for each in sets for s in each))}
        self.columns = max(1, -(-len(number) // 64))
        self.words: dict[str, list[int]] = {}  # the sets in which a word is
        for s, k in number.items():
            for w in s:
                self.words.setdefault(w, []).append(k)
        self.masks = np.zeros((len(sets), self.columns), np.uint64)
        for i, each in enumerate(sets):
            for s in each:
                self.masks[i, number[s] // 64] |= np.uint64(1 << number[s] % 64)

    def bits(self, word: str) -> list[int] | None:
        """The word's bits, column by column; None for a word in no set."""
        sets = self.words.get(word)
        if sets is None:
            return None
        out = [0] * self.columns
        for k in sets:
            out[k // 64] |= 1 << k % 64
        return out

    def may_match(self, bits: np.ndarray) -> np.ndarray:
        """Expressions x texts, from the texts' bits (texts x columns)."""
        return ((bits[None] & self.masks[:, None]) == self.masks[:, None]).all(axis=2)


def united(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bits of all words from each start to the next; none for texts without words."""
    out = np.zeros((len(starts) - 1, bits.shape[1]), np.uint64)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = np.bitwise_or.reduceat(bits, starts[some], axis=0)
    return out
