"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one byte NFA; subset construction and minimisation make transition
arrays of it. One pass over the bytes finds the ends of all rules' matches: a block of texts is cut into
lanes that advance together, one numpy step for each byte position. A lane starts a little before its
share, and one whose state then differs from the end of the lane before it runs again, so that the result
is that of a single left-to-right pass. From the few ends found, a rule's reversed automaton walks back to
the start. Matches of a rule are leftmost-longest and don't overlap.

Rules use the part of regular-expression syntax that automata need: literals, classes, groups, |, ?, *, +,
{m,n}, the escapes s d w, and a word boundary at the start or end of the whole rule. They work on ASCII
bytes; any other byte counts as no word character, as in RE2 and DuckDB. In (?i:...) letters stand for both cases.

Null and empty texts hold no secret. A row with a null doc_id is scanned like any other. Repeated rows
give repeated findings. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import END, blocks, bounded, joined, mix, table

_KEYS = r"(?i:(?:(?:access|api|app|auth|aws|client|db|github|hub|my|private|secret|slack|user|x)_)?(?:token|secret|passwd|password|key)|apikey)"
#: A run that may hold a hyphen lets every other rule begin within it, and its count multiplies the automaton's states:
#: so what is counted is free of them.
RULES: tuple[tuple[str, str], ...] = (
    ("assigned_token", r"\b" + _KEYS + r"[\"']?[ ]{0,2}[:=][ ]{0,2}[\"'][0-9A-Za-z_]{16,}[0-9A-Za-z_+/.=\-]*[\"']"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("bare_token", r"\b" + _KEYS + r"[ ]{0,2}[:=][ ]{0,2}[0-9A-Za-z_]{20,}\b"),
    ("github_token", r"\bgh[opusr]_[0-9A-Za-z]{36}\b"),
    ("gitlab_token", r"\bglpat-[0-9A-Za-z_]{20}"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_]{4,}[0-9A-Za-z_\-]*"),
    ("hub_token", r"\bhf_[0-9A-Za-z]{34}\b"),
    ("jwt", r"\beyJ[0-9A-Za-z_]{4,}[0-9A-Za-z_\-]*\.eyJ[0-9A-Za-z_]{4,}[0-9A-Za-z_\-]*\.[0-9A-Za-z_]+[0-9A-Za-z_\-]*"),
    ("npm_token", r"\bnpm_[0-9A-Za-z]{36}\b"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    ("shop_token", r"\bshp(?:at|ca|pa|ss)_[0-9A-Fa-f]{32}\b"),
    ("slack_token", r"\bxox[abprs]-[0-9]{8,13}-[0-9A-Za-z]{12,48}\b"),
    ("stripe_key", r"\b[rs]k_live_[0-9A-Za-z]{24,64}\b"),
    ("url_password", r"\b(?:https?|ftp|postgres|mysql|redis|mongodb|amqp)://[0-9A-Za-z_.]+:[0-9A-Za-z_.!$%]+@"),
)
SCHEMA = "doc_id bigint, rule string, start_char int, end_char int, secret string"
_WORDS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_ANY = frozenset(range(END))
_ESCAPES = {"d": frozenset(b"0123456789"), "w": _WORDS, "s": frozenset(b" \t\n\r\x0c"), "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
_ESCAPES |= {k.upper(): _ANY - v for k, v in _ESCAPES.items() if k in "dws"}


class _Parser:
    """Regular expression to a tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", tree, least, most or None)."""

    def __init__(self, rule: str) -> None:
        self.head, self.tail = rule.startswith(r"\b"), rule.endswith(r"\b")
        self.fold = False
        self.s, self.i = rule[2 * self.head : len(rule) - 2 * self.tail], 0
        self.tree = self.alt()
        if self.i < len(self.s):
            raise ValueError(f"can't read {rule!r} at {self.i}")

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return ("cat", *parts)

    def repeat(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                least, _, most = self.s[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(least), int(most or least) if most or "," not in self.s[self.i - 2 - len(least) - len(most) : self.i] else None)
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?:", self.i):
                self.i += 2
            elif self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            tree = self.alt()
            self.fold = before
            if self.take() != ")":
                raise ValueError("a group isn't closed")
            return tree
        if c == "[":
            return self.set(self.members())
        if c == ".":
            return ("set", _ANY - {10})
        if c == "\\":
            return ("set", self.escape(self.take()))
        if c in "^$" or ord(c) > 126:
            raise ValueError(f"{c!r} isn't supported")
        return self.set(frozenset({ord(c)}))

    def set(self, members: frozenset[int]):
        if self.fold:
            members |= {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}
        return ("set", members)

    @staticmethod
    def escape(c: str) -> frozenset[int]:
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c.isalnum():
            raise ValueError(f"the escape {c!r} isn't supported")
        return frozenset({ord(c)})

    def members(self) -> frozenset[int]:
        out: set[int] = set()
        negated = self.peek() == "^"
        self.i += negated
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            if c == "\\":
                out |= self.escape(self.take())
            elif self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                out |= set(range(ord(c), ord(self.take()) + 1))
            else:
                out.add(ord(c))
        self.take()
        return frozenset(_ANY - out if negated else out)


def _turned(tree):
    if tree[0] == "cat":
        return ("cat", *[_turned(x) for x in reversed(tree[1:])])
    if tree[0] == "alt":
        return ("alt", *[_turned(x) for x in tree[1:]])
    return ("rep", _turned(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Builds the tree from state at; returns the state after it."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            if self.arcs[at] is not None:
                fresh = self.state()
                self.eps[at].append(fresh)
                at = fresh
            self.arcs[at] = (tree[1], to)
            return to
        if kind == "cat":
            for x in tree[1:]:
                at = self.add(x, at)
            return at
        end = self.state()
        if kind == "alt":
            for x in tree[1:]:
                self.eps[at].append(start := self.state())
                self.eps[self.add(x, start)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            at = self.add(x, at)
        if most is None:
            self.eps[at].append(loop := self.state())
            self.eps[self.add(x, loop)].append(loop)
            self.eps[loop].append(end)
        else:
            self.eps[at].append(end)
            for _ in range(most - least):
                self.eps[at].append(start := self.state())
                at = self.add(x, start)
                self.eps[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _classes(nfa: _Nfa, extra: list[frozenset[int]]) -> np.ndarray:
    """A class for each byte; bytes that every arc treats alike share one."""
    sets = list({a[0] for a in nfa.arcs if a} | set(extra))
    key: dict[tuple[bool, ...], int] = {}
    return np.array([key.setdefault(tuple(b in s for s in sets), len(key)) for b in range(256)], np.uint8)


def _minimised(trans: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partition refinement: the smaller table, its labels, and each old state's new one. Rows are compared by 64-bit hashes."""
    odd = mix(np.arange(1, trans.shape[1] + 2, dtype=np.uint64)) | np.uint64(1)
    part = np.unique(label, return_inverse=True)[1].ravel()
    while True:
        spread = mix(part.astype(np.uint64) + np.uint64(1))
        new = np.unique(spread * odd[0] + (spread[trans] * odd[1:]).sum(axis=1, dtype=np.uint64), return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    first = np.unique(part, return_index=True)[1]
    return part[trans[first]], label[first], part


class Automaton:
    """Transition arrays of all rules together.

    trans[state, class of byte] is the next state; hit[state] is a bit mask of the rules of which a match
    ended just before the byte that led there (one byte of look-ahead decides the boundary). END leads
    back to the start.
    """

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES) -> None:
        if len(rules) > 63:
            raise ValueError("at most 63 rules in one automaton")
        self.rules = tuple(rules)
        nfa = _Nfa()
        outside, inside = nfa.state(), nfa.state()  # the byte before is no word character, or is one
        nonword, final = frozenset(range(256)) - _WORDS, {}
        self.back = []
        for k, (_, rule) in enumerate(rules):
            p = _Parser(rule)
            if 0 in nfa.closure([nfa.add(p.tree, nfa.state())]):
                raise ValueError(rule)
            start = nfa.state()
            nfa.eps[outside].append(start)
            if not p.head:
                nfa.eps[inside].append(start)
            end = nfa.add(p.tree, start)
            if end in nfa.closure([start]):
                raise ValueError(f"{rule!r} matches the empty text")
            final[end] = (k, p.tail)
            self.back.append(_Back(_turned(p.tree), p.head))
        cls = _classes(nfa, [_WORDS, frozenset({END})])
        sample = {int(c): int(b) for b, c in reversed(list(enumerate(cls)))}
        index, todo, rows, hits = {}, [], [], []
        bits = lambda states: sum(1 << x for x in nfa.closure(states))
        begin = [bits({outside}) if b == END or b in nonword else bits({inside}) for _, b in sorted(sample.items())]
        after = {  # of the states that have an arc or end a rule: where each class leads, as bits
            x: [bits({nfa.arcs[x][1]}) if nfa.arcs[x] and b != END and b in nfa.arcs[x][0] else 0 for _, b in sorted(sample.items())] for x in range(len(nfa.arcs)) if nfa.arcs[x] or x in final
        }
        live = sum(1 << x for x in after)

        def number(states: int, hit: int) -> int:
            key = (states & live, hit)
            if key not in index:
                index[key] = len(index)
                todo.append(key)
            return index[key]

        number(bits({outside}), 0)
        ended = [b in nonword for _, b in sorted(sample.items())]
        while len(rows) < len(todo):
            states, hit = todo[len(rows)]
            hits.append(hit)
            to, some, at_end = list(begin), 0, 0
            while states:
                low = states & -states
                states ^= low
                x = low.bit_length() - 1
                to = list(map(or_, to, after[x]))
                if x in final:
                    k, tail = final[x]
                    at_end |= 1 << k
                    some |= 0 if tail else 1 << k
            rows.append([number(y, at_end if end else some) for y, end in zip(to, ended)])
        trans, label, part = _minimised(np.array(rows, np.int32), np.array(hits, np.int64))
        start = part[0]
        order = np.r_[start, np.delete(np.arange(len(trans)), start)]  # the start is state 0
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        self.hit, self.cls, self.subsets = label[order], cls, len(rows)
        self.width = len(sample)
        self.flat = (where[trans[order]] * self.width).astype(np.int32).ravel()  # rows' offsets, to add the class to
        self.hit_at = self.hit != 0

    def run(self, buf: np.ndarray, lanes: int = 2048, before: int = 192) -> tuple[np.ndarray, np.ndarray]:
        """Where a match ended (exclusive), in order, and the mask of rules."""
        n = len(buf)
        lanes = max(1, min(lanes, n // 256))
        size = -(-n // lanes)
        cls = np.full(before + lanes * size, self.cls[END], np.uint8)
        cls[before : before + n] = self.cls[buf]
        view = np.lib.stride_tricks.as_strided(cls, (lanes, before + size), (size, 1))
        steps = np.ascontiguousarray(view.T)
        state, at, masks = np.zeros(lanes, np.int32), [], []
        width = self.width
        begin = state
        for t in range(before + size):
            if t == before:
                begin = state
            state = self.flat[state + steps[t]]
            if t >= before:
                h = self.hit_at[state // width]
                if h.any():
                    lane = np.flatnonzero(h)
                    at.append(lane * size + (t - before))
                    masks.append(self.hit[state[lane] // width])
        at_all = np.concatenate(at) if at else np.zeros(0, np.int64)
        mask_all = np.concatenate(masks) if masks else np.zeros(0, np.int64)
        end = state.copy()
        for k in range(1, lanes):  # a lane that began in another state than the one before it ended in
            if begin[k] != end[k - 1]:
                keep = at_all // size != k
                at_all, mask_all = at_all[keep], mask_all[keep]
                s, more, kinds = int(end[k - 1]), [], []
                for i, c in enumerate(cls[before + k * size : before + (k + 1) * size].tolist()):
                    s = int(self.flat[s + c])
                    if self.hit_at[s // width]:
                        more.append(k * size + i)
                        kinds.append(self.hit[s // width])
                end[k] = s
                at_all, mask_all = np.r_[at_all, np.array(more, np.int64)], np.r_[mask_all, np.array(kinds, np.int64)]
        order = np.argsort(at_all, kind="stable")
        return at_all[order], mask_all[order]

    def matches(self, text: bytes, ends: list[int], rule: int) -> list[tuple[int, int]]:
        """The rule's leftmost-longest matches in text, of which all ends are given in order."""
        out: list[tuple[int, int]] = []
        low, walk, later = 0, list(ends), []
        best: tuple[int, int] | None = None
        while walk:
            for e in walk:
                s = self.back[rule].start(text, e, low)
                if s is None:
                    continue
                if best is None or s <= best[0]:
                    best = (s, e)
                elif s >= best[1]:
                    out.append(best)
                    low, best = best[1], (s, e)
                    later = [x for x in later if x > low]
                    if later:  # ends that only overlapped what has just been taken
                        for x in later:
                            y = self.back[rule].start(text, x, low)
                            if y is not None and y <= best[0]:
                                best = (y, x) if y < best[0] or x > best[1] else best
                        later = []
                else:
                    later.append(e)
            walk = []
            if best is not None:
                out.append(best)
                low, best = best[1], None
                walk, later = [x for x in later if x > low], []
        return out


class _Back:
    """A rule's reversed automaton, its states made as they are met."""

    def __init__(self, tree, head: bool) -> None:
        self.nfa, self.head = _Nfa(), head
        start = self.nfa.state()
        self.end = self.nfa.add(tree, start)
        self.first = self.nfa.closure([start])
        self.memo: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def start(self, text: bytes, end: int, low: int) -> int | None:
        """The leftmost start, low or later, of a match that ends at end."""
        state, found, i = self.first, None, end
        while i > low:
            i -= 1
            key = (state, text[i])
            nxt = self.memo.get(key)
            if nxt is None:
                arcs = (self.nfa.arcs[s] for s in state)
                nxt = self.memo[key] = self.nfa.closure([a[1] for a in arcs if a and text[i] in a[0]])
            if not nxt:
                break
            state = nxt
            if self.end in state and (not self.head or i == 0 or text[i - 1] not in _WORDS):
                found = i
        return found


@lru_cache(maxsize=4)
def automaton(rules: tuple[tuple[str, str], ...] = RULES) -> Automaton:
    return Automaton(rules)


def findings(auto: Automaton, buf: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(text's number, its matches as (start, end, rule) in bytes, in order) for each text with a match."""
    at, mask = auto.run(buf)
    owner = np.searchsorted(starts, at, side="right") - 1
    for row in np.unique(owner):
        lo, hi = np.searchsorted(owner, [row, row + 1])
        text = buf[starts[row] : starts[row + 1] - 1].tobytes()
        ends, masks = (at[lo:hi] - starts[row]).tolist(), mask[lo:hi].tolist()
        found = []
        for k in range(len(auto.rules)):
            own = [e for e, m in zip(ends, masks) if m >> k & 1]
            if own:
                found += [(s, e, k) for s, e in auto.matches(text, own, k)]
        if found:
            yield int(row), sorted(found)


def scan(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each match in docs (doc_id, text): rule, character offsets and the matched text."""
    model = docs.sparkSession.sparkContext.broadcast(automaton(tuple(rules)))

    def run(batches):
        auto = model.value
        for part, text in blocks(batches):
            buf, starts = joined(text)
            ids = part.column(0).to_pylist()
            rows: list[tuple] = []
            for row, found in findings(auto, buf, starts):
                raw = buf[starts[row] : starts[row + 1] - 1].tobytes()
                last = chars = 0
                for s, e, k in sorted(found):
                    chars += len(raw[last:s].decode()) if s >= last else -len(raw[s:last].decode())
                    last = s
                    rows.append((ids[row], auto.rules[k][0], chars, chars + e - s, raw[s:e].decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "rule", "start_char", "end_char", "secret"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """docs with every match in text replaced by <rule>, overlapping ones by the first's; n_chars follows where there is one.

    All rows and columns stay, in the same order of columns; a null text stays null.
    """
    model = docs.sparkSession.sparkContext.broadcast(automaton(tuple(rules)))
    names = docs.columns
    col, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        auto = model.value
        for part, text in blocks(batches):
            buf, starts = joined(text)
            new = {}
            for row, found in findings(auto, buf, starts):
                raw, out, last = buf[starts[row] : starts[row + 1] - 1].tobytes(), [], 0
                for s, e, k in found:
                    if s >= last:
                        out += [raw[last:s], b"<", auto.rules[k][0].encode(), b">"]
                    last = max(last, e)
                new[row] = b"".join([*out, raw[last:]]).decode()
            if new:
                arrays = list(part.columns)
                texts = text.to_pylist()
                for row, x in new.items():
                    texts[row] = x
                arrays[col] = pa.array(texts, text.type)
                if size >= 0:
                    sizes = arrays[size].to_pylist()
                    for row, x in new.items():
                        sizes[row] = len(x)
                    arrays[size] = pa.array(sizes, part.schema.field(size).type)
                part = pa.RecordBatch.from_arrays(arrays, schema=part.schema)
            yield part

    return bounded(docs).mapInArrow(run, docs.schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    one = (
        "SELECT doc_id, '{name}' AS rule, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT doc_id, regexp_extract_all(text, '{rule}') AS m, "
        "regexp_split_to_array(text, '{rule}') AS g FROM documents) WHERE len(m) > 0"
    )
    every = " UNION ALL ".join(one.format(name=n, rule=r.replace("'", "''")) for n, r in RULES)
    return (
        f"WITH hits AS ({every}), placed AS (SELECT doc_id, rule, m[i] AS secret, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_char FROM hits) "
        "SELECT doc_id, rule, start_char, CAST(start_char + length(secret) AS INTEGER) AS end_char, secret FROM placed"
    )


ORACLE = _sql()
