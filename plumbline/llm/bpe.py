"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that byte-pair encoding produces. It begins
as one state with a loop for each byte. Each merge (u, v) in order adds its gadget: an arc labelled uv that
leads from every state with an arc u to where v leads; and the state after u, split from whatever else leads
there, loses its arc v, for a v after that u would have been merged. All arcs with one label lead to one state,
and labels with arcs from the same states form a class, so that the automaton is three arrays: target[label],
column[label] and a bit matrix states x classes of the arcs that exist.

A pre-split word's tokens are the labels on the only path that spells it. Every prefix of it has one such
path too, so states are filled in from left to right: all labels that lie somewhere in a word are found in a
trie, and one that begins at a position is taken if the state there has the arc. All distinct words of a block
walk in step, as numpy arrays; a word of more than 64 bytes goes by itself. Words are told by 64-bit hashes, and
what a block's labels decode to is held against its bytes: two words of one hash are spelled each. Decoding emits
the labels' bytes.

A list of merges is compiled if each merge's result is a token of its own, as in every list that training
makes; another one raises ValueError.

Pre-splitting is the usual one for byte-level vocabularies: contractions, runs of letters, digits or other
signs with a blank before, runs of white space; a text is cut where the kinds of its signs change. Special tokens' strings in a text are ordinary text.

A null text has null tokens, n_tokens 0 and round_trip true; an empty one has no tokens. Rows are encoded one
by one, so repeated rows repeat. Other columns aren't read.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, lists, span_hashes, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PRE_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SCHEMA = "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean"
LONG = 64
#: Distinct words that a task remembers at a time, some 40 bytes each.
REMEMBERED = 1_000_000
#: Bytes of words that walk in step.
SLICE = 1 << 18


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., n[0] of them, then those of begin[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def packed(keys: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie (sorted node << 8 | byte, child) as base, owner and next: node's child by a byte is next[x], for x = base[node] + byte, if owner[x] is node. The sign 256 has no child."""
    node, byte = keys >> 8, (keys & 255).tolist()
    cut = np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)
    base, at = np.zeros(len(keys) + 1, np.int32), np.zeros(len(keys), np.int64)
    used, low = bytearray(1024), 256  # the last places are always free; nothing before low is tried for a node's first child
    for g in np.argsort(-np.diff(cut), kind="stable").tolist():
        a, b = int(cut[g]), int(cut[g + 1])
        x, tries = low, 0
        while True:
            x = used.find(0, x)
            if len(used) < x + 256:
                used.extend(bytes(len(used)))
            if not any(used[x + k - byte[a]] for k in byte[a + 1 : b]):
                break
            x, tries = x + 1, tries + 1
        if tries > 32 or b - a == 1:
            low = x
        base[node[a]] = x - byte[a]
        for k in range(a, b):
            at[k] = x + byte[k] - byte[a]
            used[at[k]] = 1
    owner, following = np.full(int(base.max()) + 257, -1, np.int32), np.zeros(int(base.max()) + 257, np.int32)
    owner[at], following[at] = node, child
    return base, owner, following


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: 0 white space, 1 letters, 2 digits, 3 other signs, as PRE_SPLIT has them."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.full(len(every), 3, np.uint8)
    for k, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    return kind


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What PRE_SPLIT finds: all texts' bytes, how many bytes each piece has, and how many pieces each text has."""
    text = "".join(texts)
    data = np.frombuffer(text.encode(), np.uint8)
    char = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(char)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    edge = np.zeros(n + 4, bool)  # a text begins, or all are over
    edge[bounds] = True
    edge[n:] = True
    kind = kinds()[char]
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == 0
    ends = start[1 : n + 1] & ~edge[1 : n + 1]  # the next sign is of another kind, in this text
    start[:n] |= space & ends  # the last of white space before others is cut off
    blank = np.flatnonzero((char == 32) & ends)
    start[blank + 1] = False
    for i in np.flatnonzero((char == 39) & start[:n] & ends):
        word = "".join(map(chr, char[i + 1 : i + 3]))
        size = 2 if word[:1] in tuple("sdmt") else 3 if word in ("ll", "ve", "re") and not edge[i + 2] else 0
        if size:
            start[i + 1], start[i + size] = False, True
    first = np.flatnonzero(start[:n])
    sizes = np.diff(np.searchsorted(first, bounds))
    if char is not data:
        width = np.cumsum(1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF))
        first = np.r_[0, width][first]
    return data, np.diff(np.r_[first, len(data)]), sizes


class Automaton:
    def __init__(self, base: list[bytes], merges: list[tuple[bytes, bytes]]) -> None:
        label = {b: i for i, b in enumerate(base)}
        target, column = [0] * len(base), [0] * len(base)
        into, of = [len(base) + 1], [len(base)]  # how many labels lead to a state (and the start), are of a class
        self.bytes = list(base)
        gadgets: list[tuple[int, int, int, int]] = []  # state and class to copy, state and class whose arc goes
        for u_bytes, v_bytes in merges:
            u, v, x = label[u_bytes], label[v_bytes], len(self.bytes)
            if label.setdefault(u_bytes + v_bytes, x) != x:
                raise ValueError(f"two merges make {u_bytes + v_bytes!r}")
            self.bytes.append(u_bytes + v_bytes)
            target.append(target[v])
            into[target[v]] += 1
            q = target[u]
            if into[q] > 1:  # the state after u becomes its own
                into[q] -= 1
                target[u] = len(into)
                into.append(1)
            if u != v:
                column.append(column[u])
                of[column[u]] += 1
            c = column[v]
            if of[c] > 1:  # and so does the class of v
                of[c] -= 1
                column[v] = len(of)
                of.append(1)
            if u == v:  # uv can't follow u either
                column.append(column[u])
                of[column[u]] += 1
            gadgets.append((q, c, target[u], column[v]))
        states, classes = len(into), len(of)
        arcs = np.zeros((states, classes), bool)
        arcs[0, 0] = True
        rows = cols = 1
        for q, c, to, k in gadgets:
            if to == rows:
                arcs[to] = arcs[q]
                rows += 1
            if k == cols:
                arcs[:rows, k] = arcs[:rows, c]
                cols += 1
            arcs[to, k] = False
        target, column = np.array(target, np.int32), np.array(column, np.int32)
        self.target, self.column, self.classes = target, column, classes
        self.arcs = np.packbits(arcs, axis=1)
        # the trie: children in order of node * 256 + byte
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, token in enumerate(self.bytes):
            at = 0
            for b in token:
                at = nodes.setdefault(at << 8 | b, len(nodes) + 1)
            ends[at] = i
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order].astype(np.int32)
        self.base, self.owner, self.next = packed(self.keys, self.child)
        self.token_at = np.full(len(nodes) + 1, -1, np.int32)
        self.token_at[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.bytes), default=1)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lens = np.array([len(b) for b in self.bytes], np.int64)
        self.offsets = np.cumsum(self.lens) - self.lens
        own, counts = self.encode(self.bytes)
        if (counts != 1).any() or (own != np.arange(len(own))).any():
            raise ValueError("a merge's result is no token of its own, as in a list that training makes")

    def has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether the states have arcs with these labels."""
        c = self.column[labels]
        at = states.astype(np.int64) * self.arcs.shape[1] + (c >> 3)
        return (self.arcs.reshape(-1)[at] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' labels one after another, and how many each word has."""
        return self.spell(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))

    def spell(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie one after another in data."""
        ends = np.cumsum(lens)
        counts, labels = np.zeros(len(lens), np.int64), []
        short = np.flatnonzero(lens <= LONG)
        size = np.cumsum(lens[short])
        for i in range(0, int(size[-1]) if len(size) else 0, SLICE):
            rows = short[np.searchsorted(size, i, "right") : np.searchsorted(size, i + SLICE, "right")]
            part, counts[rows] = self._short(data[spans(ends[rows] - lens[rows], lens[rows])], lens[rows])
            labels.append(part)
        flat, long = np.concatenate(labels) if labels else np.zeros(0, np.int32), np.flatnonzero(lens > LONG)
        if not len(long):
            return flat, counts
        each = [self._one(data[ends[i] - lens[i] : ends[i]].tobytes()) for i in long]
        counts[long] = [len(x) for x in each]
        begin, out = np.cumsum(counts) - counts, np.empty(counts.sum(), np.int32)
        out[spans(begin[short], counts[short])] = flat
        out[spans(begin[long], counts[long])] = np.concatenate(each)
        return out, counts

    def _short(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(lens + 1) - lens - 1  # of each word, after which stands a sign that no label has
        text = np.full(len(data) + len(lens), 256, np.int32)
        pos = spans(first, lens)
        text[pos] = data
        place = np.zeros(len(text), np.uint8)
        place[pos] = pos - np.repeat(first, lens)
        # every label that lies somewhere, whatever the state there is
        node, begins, ends, tokens = np.zeros(len(pos), np.int32), [], [], []
        for j in range(self.longest):
            at = self.base[node] + text[pos + j]
            ok = self.owner[at] == node
            pos, node = pos[ok], self.next[at[ok]]
            if not len(pos):
                break
            token = self.token_at[node]
            t = np.flatnonzero(token >= 0)
            begins.append(pos[t])
            ends.append(pos[t] + j + 1)
            tokens.append(token[t])
        last = np.full(len(text), -1, np.int32)  # the label that ends before a position
        state = np.zeros(len(text), np.int32)
        if begins:
            begin, end, token = map(np.concatenate, (begins, ends, tokens))
            order = np.argsort(place[begin], kind="stable")
            cut = np.cumsum(np.bincount(place[begin]))
            begin, end, token = begin[order], end[order], token[order]
            for a, b in zip(np.r_[0, cut], cut):
                ok = self.has(state[begin[a:b]], token[a:b])
                e, t = end[a:b][ok], token[a:b][ok]
                last[e], state[e] = t, self.target[t]
        taken = np.zeros(len(text), bool)
        at, low = (first + lens)[lens > 0], first[lens > 0]
        while len(at):
            token = last[at]
            if (token < 0).any():
                raise ValueError("no path spells a word")
            taken[at] = True
            at = at - self.lens[token]
            more = at > low
            at, low = at[more], low[more]
        before = np.r_[0, np.cumsum(taken)]
        return last[taken], before[first + lens + 1] - before[first]

    def _one(self, word: bytes) -> np.ndarray:
        children, n = self._children(), len(word)
        last, state = [-1] * (n + 1), [0] * (n + 1)
        token_at, column, target, arcs = self.token_at, self.column, self.target, self.arcs
        for i in range(n):
            node, row = 0, arcs[state[i]]
            for j in range(i, n):
                node = children.get(node << 8 | word[j], 0)
                if not node:
                    break
                token = int(token_at[node])
                if token >= 0:
                    c = int(column[token])
                    if row[c >> 3] >> (7 - (c & 7)) & 1:
                        last[j + 1], state[j + 1] = token, int(target[token])
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("no path spells a word")
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return np.array(out[::-1], np.int32)

    def _children(self) -> dict[int, int]:
        if not hasattr(self, "_dict"):
            self._dict = dict(zip(self.keys.tolist(), self.child.tolist()))
        return self._dict

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dict"}

    def decode(self, labels: np.ndarray) -> bytes:
        """The labels' bytes, one after another."""
        return self.flat[spans(self.offsets[labels], self.lens[labels])].tobytes()


class Encoder:
    """The automaton with a vocabulary file's token ids, and the words that it has met, by their hashes."""

    def __init__(self, auto: Automaton, ids: np.ndarray) -> None:
        self.auto, self.ids = auto, ids
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the hashes
        self.flat, self.begin, self.counts, self.lens = np.zeros(0, np.int32), *(np.zeros(0, np.int32) for _ in range(3))

    def labels(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' labels, and how many each text has."""
        return self.coded(text)[:2]

    def coded(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
        """The same, the texts' bytes one after another, and what the labels decode to."""
        data, lens, sizes = pieces([t or "" for t in text.to_pylist()])
        which = self._slots(data, lens)
        n = self.counts[which].astype(np.int64)
        labels = self.flat[spans(self.begin[which], n)]
        raw, back = data.tobytes(), self.auto.decode(labels)
        if back != raw or (self.lens[which] != lens).any():  # two words share a hash
            labels, n = self.auto.spell(data, lens)
            back = self.auto.decode(labels)
        total = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]
        return labels, np.diff(total), raw, back

    def _slots(self, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The remembered words that the pieces of data are; new ones are spelled."""
        ends = np.cumsum(lens)
        h = span_hashes(data, ends)
        order = np.argsort(h)
        fresh = np.r_[True, h[order[1:]] != h[order[:-1]]] if len(h) else np.zeros(0, bool)
        one = order[fresh]
        keys = h[one]
        if len(self.known) > REMEMBERED:
            self.forget()
        k = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = k < len(self.known)
        new[inside] = self.known[k[inside]] != keys[inside]
        new = np.flatnonzero(new)
        if len(new):
            w = one[new]
            flat, counts = self.auto.spell(data[spans(ends[w] - lens[w], lens[w])], lens[w])
            slots = np.arange(len(self.counts), len(self.counts) + len(new), dtype=np.int32)
            self.begin = np.r_[self.begin, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)]
            self.flat, self.counts, self.lens = np.r_[self.flat, flat], np.r_[self.counts, counts.astype(np.int32)], np.r_[self.lens, lens[w].astype(np.int32)]
            self.known, self.slot = np.insert(self.known, k[new], keys[new]), np.insert(self.slot, k[new], slots)
            k = np.searchsorted(self.known, keys)
        which = np.empty(len(h), np.int32)
        which[order] = self.slot[k][np.cumsum(fresh) - 1]
        return which


@lru_cache(maxsize=2)
def load(path: str = TOKENIZER) -> tuple[Automaton, np.ndarray]:
    """The automaton of a byte-level vocabulary file, and each label's token id there."""
    model = json.loads(Path(path).read_text())["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    auto = Automaton([bytes([b]) for b in range(256)], merges)
    ids = {raw(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
    return auto, np.array([ids[b] for b in auto.bytes], np.int32)


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """A row for each of docs (doc_id, text): its tokens, and whether decoding them gives the text back."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        encoder = Encoder(*model.value)
        for part, text in blocks(batches):
            labels, counts, raw, back = encoder.coded(text)
            if back == raw:
                same = np.ones(len(text), bool)
            else:
                raw, ends = pc.cast(text, pa.binary()).to_pylist(), np.r_[0, np.cumsum(counts)]
                same = np.array([encoder.auto.decode(labels[a:b]) == (x or b"") for a, b, x in zip(ends, ends[1:], raw)])
            tokens = lists(encoder.ids[labels], counts, pa.int32())
            if text.null_count:
                tokens = pc.if_else(text.is_valid(), tokens, pa.scalar(None, tokens.type))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int32)), tokens, pa.array(same)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """tokens (doc_id, tokens) as doc_id and text: the arc labels of the token ids. Null tokens give a null text, a null or unknown id nothing."""
    model = tokens.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        auto, ids = model.value
        label = np.full(int(ids.max()) + 1, -1, np.int64)
        label[ids] = np.arange(len(ids))
        for part in batches:
            texts = []
            for x in part.column(1).to_pylist():
                known = None if x is None else [i for i in x if i is not None and 0 <= i < len(label)]
                y = None if known is None else label[np.array(known, np.int64)]
                texts.append(None if y is None else auto.decode(y[y >= 0]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bounded(tokens).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id bigint, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
