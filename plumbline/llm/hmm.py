"""A hidden Markov language model.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. Sentences end at . ! ? and
line ends; each is a sequence of its own, whatever its length, so a document's likelihood is its sentences'
product. The vocabulary has every word that occurs at least twice in the whole corpus; any other word becomes one of
UNKNOWN symbols by its length. Words, their counts and their emissions are tables in the shared folder, in files by
the hash's first bits, of which a task reads what its own words need; neither driver nor broadcast holds them.

Training is Baum-Welch until it converges. States begin apart, by hash; a sample is trained first, where rounds are
cheap, and tells each state's share of a word. Rounds over one of PART documents and then over all documents follow, each
kind until the log-likelihood gains less than its tolerance of itself and the gains don't grow: while states are still
alike gains are small, but they grow. In each round every partition runs forward and backward over its sentences and adds up
expected starts, transitions and emissions; the sums over all partitions, taken by Spark, make the next model.
Its size grows with the corpus's vocabulary. Scoring is the scaled forward recursion,
whose scales' logarithms add up to the exact log-likelihood. Sentences of a block advance together, word by word. A long
one advances as pieces of MOST words at once: each piece's matrix, from the state before it to that at its end, gives
what the piece before leaves to it, and what the piece after does in the backward recursion, so nothing is cut off.

A null or empty text has n_words 0, log_likelihood 0 and a null perplexity, as one without words. Repeated
rows count as often as they are there. A corpus without words gives a uniform model. Other columns aren't read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, byte_table, joined, lists, mix, release, shared_dir, table, word_hashes

STATES, MOST, UNKNOWN = 8, 128, 16
#: Of a word's hash, at least and at most, that tell its bucket: two buckets for each partition of the documents within these bounds.
LEAST_BITS, MOST_BITS = 6, 13
#: Training ends when a round's relative gain in log-likelihood is under TOLERANCE and no more than that of the round before.
TOLERANCE = 5e-4
#: The same for the sample and for the part, whose rounds cost little: they leave the plateau on which states are still alike.
SAMPLE_TOLERANCE, PART_TOLERANCE = 1e-5, 1e-4
#: Words, about, on which the first states are trained until they differ; of so many documents one is in the rounds that follow.
SAMPLE, PART = 500_000, 16
#: Added to every expected count.
SMOOTH = 0.01
SCHEMA = "doc_id bigint, n_words bigint, log_likelihood double, perplexity double"
_STOP = byte_table(b".!?\n\r", high=False)


@dataclass
class Model:
    words: np.ndarray  # the vocabulary's hashes in order; symbols UNKNOWN and up
    start: np.ndarray
    move: np.ndarray  # from state to state
    emit: np.ndarray  # symbols x states

    @classmethod
    def first(cls, words: np.ndarray, counts: np.ndarray, states: int = STATES) -> Model:
        """States that differ much, by hash, from the words' frequencies."""
        rng = np.random.default_rng(7)
        share = (counts + SMOOTH) / (counts + SMOOTH).sum()
        emit = share[:, None] * _noise(np.r_[np.arange(UNKNOWN, dtype=np.uint64), words], states)
        move = 1 + rng.random((states, states))
        return cls(words, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def local(self, names: np.ndarray) -> Model:
        return Model(self.words, self.start, self.move, self.emit[names])

    def next(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        up = lambda x, axis: (x + SMOOTH) / (x + SMOOTH).sum(axis=axis, keepdims=True)
        return Model(self.words, up(start, 0), up(move, 1), up(emit, 0))


def _noise(names: np.ndarray, states: int) -> np.ndarray:
    """Positive numbers far apart, by hash: names x states."""
    u = np.column_stack([(mix(names + np.uint64((k + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(40)).astype(np.float64) / (1 << 24) for k in range(states)])
    return (0.05 - np.log(u + 2**-24)) ** 3


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def _read(uri: str, kind: type) -> np.ndarray:
    """A file's numbers; a local file is mapped, so that only the pages in use are read."""
    system, path = _files(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _write(uri: str, values: np.ndarray) -> None:
    """Whole or not at all, so that a task may run twice."""
    system, path = _files(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(values).data)
    system.move(part, path)


@dataclass
class Vocabulary:
    """Tables of words and counts in the folder: bucket b has the symbols from offsets[b] on, UNKNOWN ones first."""

    folder: str
    offsets: np.ndarray
    total: float  # of the counts
    bits: int = LEAST_BITS

    def rows(self, names: np.ndarray, table_: str, kind: type, width: int = 1) -> np.ndarray:
        """The table's rows for these symbols, which are in order."""
        out = np.empty((len(names), width), kind)
        cut = np.searchsorted(names, self.offsets)
        for b in np.flatnonzero(np.diff(cut)):
            own = slice(cut[b], cut[b + 1])
            out[own] = _read(f"{self.folder}/{table_}/{b}", kind).reshape(-1, width)[names[own] - self.offsets[b]]
        return out

    def symbols(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        names, own = np.unique(h, return_inverse=True)
        found = np.full(len(names), -1)
        cut = np.r_[np.searchsorted(names >> np.uint64(64 - self.bits), np.arange(1 << self.bits)), len(names)]
        for b in np.flatnonzero(np.diff(cut)):
            if self.offsets[b + 1] > self.offsets[b]:
                words, part = _read(f"{self.folder}/words/{b}", np.uint64), names[cut[b] : cut[b + 1]]
                at = np.minimum(np.searchsorted(words, part), len(words) - 1)
                found[cut[b] : cut[b + 1]] = np.where(words[at] == part, at + self.offsets[b], -1)
        return np.where(found[own] >= 0, found[own], np.minimum(length, UNKNOWN) - 1)


@dataclass
class Kept:
    """A model whose emissions are a table of expected counts in the folder."""

    words: Vocabulary
    start: np.ndarray
    move: np.ndarray
    table: str
    sums: np.ndarray  # of the table, by state

    def local(self, names: np.ndarray) -> Model:
        k = len(self.start)
        rows = self.words.rows(names, self.table, np.float64, k)
        return Model(names, self.start, self.move, (rows + SMOOTH) / (self.sums + SMOOTH * self.words.offsets[-1]))

    def drop(self) -> None:
        system, path = _files(f"{self.words.folder}/{self.table}")
        system.delete_dir(path)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, length in bytes and text, and whether it begins a sentence."""
    buf, starts = joined(pc.utf8_lower(text))
    h, s, e = word_hashes(buf)
    owner = np.searchsorted(starts, s, side="right") - 1
    ended = np.cumsum(_STOP[buf], dtype=np.int32)[s] if len(s) else np.zeros(0, np.int32)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (ended[1:] != ended[:-1])
    return h, e - s, owner, fresh


def symbols(words: np.ndarray, h: np.ndarray, length: np.ndarray) -> np.ndarray:
    unknown = np.minimum(length, UNKNOWN) - 1
    if not len(words):
        return unknown
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at + UNKNOWN, unknown)


class Lanes:
    """Pieces of sentences side by side, the longest first: all first words, all second words, and so on."""

    def __init__(self, symbol: np.ndarray, fresh: np.ndarray, most: int = MOST) -> None:
        begin = np.flatnonzero(fresh)
        within = np.arange(len(symbol)) - np.repeat(begin, np.diff(np.r_[begin, len(symbol)]))
        first = np.flatnonzero(within % most == 0)
        size = np.diff(np.r_[first, len(symbol)])
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        longest = int(size.max()) if len(size) else 0
        self.size = size[order]
        self.alive = np.searchsorted(-self.size, -np.arange(longest), side="left")  # pieces longer than t
        self.at = np.r_[0, np.cumsum(self.alive)]
        place = np.arange(len(symbol)) - np.repeat(first, size)
        self.where = self.at[place] + np.repeat(rank, size)  # a word's place in the lanes
        self.symbol = np.empty(len(symbol), np.int64)
        self.symbol[self.where] = symbol
        turn = within[first] // most  # of a piece in its sentence
        self.later = np.sort(rank[turn > 0])  # the lanes that go on with a sentence
        # for each turn, those lanes and the ones before them
        by = np.argsort(turn, kind="stable")
        ends = np.searchsorted(turn[by], np.arange(turn.max() + 2 if len(turn) else 1))
        self.chain = [(rank[x], rank[x - 1]) for x in (by[i:j] for i, j in zip(ends[1:-1], ends[2:]))]

    def _words(self, lanes: np.ndarray) -> Iterator[np.ndarray]:
        """Of lanes in order: where their first words are, then the second words of those that have one, and so on."""
        for t in range(len(self.alive)):
            n = int(np.searchsorted(lanes, self.alive[t]))
            if not n:
                return
            yield self.at[t] + lanes[:n]

    def _joints(self, m: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the later lanes: the matrix from the state before it to that at its end, and the scaled probabilities before it."""
        move, k = m.move.astype(e.dtype), len(m.start)
        through = np.empty((len(self.later), k, k), e.dtype)
        for t, at in enumerate(self._words(self.later)):
            n = len(at)
            x = np.einsum("pij,jk->pik", through[:n], move) if t else np.broadcast_to(move, (n, k, k))
            x = x * e[at][:, None, :]
            through[:n] = x / x.sum(axis=(1, 2), keepdims=True)
        heads = np.sort(self.chain[0][1])
        end = np.empty((len(self.size), k), e.dtype)
        for t, at in enumerate(self._words(heads)):
            x = (np.einsum("pj,jk->pk", end[heads], move) if t else m.start.astype(e.dtype)) * e[at]  # all are full pieces
            end[heads] = x / x.sum(axis=1, keepdims=True)
        for own, prior in self.chain:
            x = np.einsum("pj,pjk->pk", end[prior], through[np.searchsorted(self.later, own)])
            end[own] = x / x.sum(axis=1, keepdims=True)
        before = np.empty((len(self.later), k), e.dtype)
        for own, prior in self.chain:
            before[np.searchsorted(self.later, own)] = end[prior]
        return through, before

    def forward(self, m: Model, kind: type = np.float64, joints: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward probabilities, and scales."""
        move, one = m.move.astype(kind), np.ones(len(m.start), kind)
        e = m.emit.astype(kind)[self.symbol]
        alpha, scale = np.empty_like(e), np.empty(len(e), kind)
        before = None
        # a matrix product's rounding depends on a row's neighbours; scores of equal texts must be equal
        product = np.matmul if kind is np.float32 else lambda a, b, out: np.einsum("ij,jk->ik" if b.ndim == 2 else "ij,j->i", a, b, out=out)
        for t, n in enumerate(self.alive):
            now, here = alpha[self.at[t] : self.at[t + 1]], slice(self.at[t], self.at[t + 1])
            if before is None:
                np.multiply(e[here], m.start.astype(kind), out=now)
                if len(self.later):
                    prior = (joints or self._joints(m, e))[1]
                    now[self.later] = np.einsum("pj,jk->pk", prior, move) * e[here][self.later]
            else:
                product(before[:n], move, out=now)
                now *= e[here]
            product(now, one, out=scale[here])
            now /= scale[here, None]
            before = now
        return e, alpha, scale

    def expected(self, m: Model, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions, and the log-likelihood; single precision within a sentence, double in the sums."""
        k, move = len(m.start), m.move.astype(np.float32)
        joints = self._joints(m, m.emit.astype(np.float32)[self.symbol]) if len(self.later) else None
        e, gamma, scale = self.forward(m, np.float32, joints)
        log = float(np.log(scale).sum(dtype=np.float64))
        moves, back = np.zeros((k, k)), None
        e /= scale[:, None]
        after = np.ones((len(self.size), k), np.float32)  # backward probabilities at the lanes' ends
        if joints:
            through, before = joints
            for own, prior in reversed(self.chain):
                i = np.searchsorted(self.later, own)
                x = np.einsum("pjk,pk->pj", through[i], after[own])
                after[prior] = x / (x * before[i]).sum(axis=1, keepdims=True)
        for t in range(len(self.alive) - 1, -1, -1):
            lo = self.at[t]
            b = after[: self.alive[t]].copy()
            if back is not None:
                up, more = self.at[t + 1], self.alive[t + 1]
                x = e[up : up + more]
                x *= back
                moves += gamma[lo : lo + more].T @ x
                np.matmul(x, move.T, out=b[:more])
                gamma[up : up + more] *= back
            back = b
        head = np.ones(len(self.size), bool)
        if back is not None:
            gamma[: self.alive[0]] *= back
            if joints:
                head[self.later] = False
                moves += joints[1].T @ (e[self.later] * back[self.later])
        emit = np.column_stack([np.bincount(self.symbol, gamma[:, j], minlength=size) for j in range(k)])
        starts = gamma[: len(head)][head].sum(axis=0, dtype=np.float64) if len(self.alive) else np.zeros(k)
        return starts, moves * m.move, emit, log


def _counted(docs: DataFrame) -> DataFrame:
    """Each word that occurs at least twice, and how often."""

    def run(batches):
        waiting, most = [], 0
        for _, text in blocks(batches):
            h = tokens(text)[0]
            waiting.append(h)
            most += len(h)
            if most > 2_000_000:
                yield counted(waiting)
                waiting, most = [], 0
        if waiting:
            yield counted(waiting)

    def counted(waiting):
        word, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    docs = bounded(docs).select(F.col("text").cast("string").alias("text")).where("text is not null")
    words = docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where("n > 1")


def vocabulary(docs: DataFrame, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in order, and the counts of all symbols, in memory; of the most frequent words only, if size is given."""
    words = _counted(docs)
    top = (words.orderBy(F.desc("n"), "word").limit(size) if size else words).toArrow()
    word = top.column("word").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(word)
    counts = top.column("n").to_numpy()[order] if top.num_rows else np.zeros(0)
    return word[order], np.r_[_unknown(counts), counts].astype(np.float64)


def _unknown(counts: np.ndarray) -> np.ndarray:
    return np.full(UNKNOWN, max(1.0, counts.mean() if len(counts) else 1.0))


def kept_vocabulary(docs: DataFrame, folder: str) -> Vocabulary:
    """The vocabulary as tables in the folder."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(2 * max(1, docs.rdd.getNumPartitions()))))))
    buckets = 1 << bits

    def run(batches):
        found = defaultdict(list)
        for batch in batches:
            word, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bucket = word >> np.uint64(64 - bits)
            for b in np.unique(bucket).tolist():
                found[b].append((word[bucket == b], n[bucket == b]))
        for b, parts in found.items():
            word, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(word)
            word, n = word[order], n[order].astype(np.float64)
            if b == 0:  # real hashes are above these names
                word, n = np.r_[np.arange(UNKNOWN, dtype=np.uint64), word], np.r_[_unknown(n), n]
            _write(f"{folder}/words/{b}", word)
            _write(f"{folder}/counts/{b}", n)
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([len(word)]), pa.array([n.sum()])], ["bucket", "size", "total"])

    words = _counted(docs).withColumn("bucket", F.shiftrightunsigned("word", 64 - bits))
    rows = words.repartition(buckets, "bucket").select("word", "n").mapInArrow(run, "bucket long, size long, total double").collect()
    sizes = np.zeros(buckets, np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["size"]
    if not sizes[0]:
        sizes[0] = UNKNOWN
        _write(f"{folder}/words/0", np.arange(UNKNOWN, dtype=np.uint64))
        _write(f"{folder}/counts/0", np.ones(UNKNOWN))
    return Vocabulary(folder, np.r_[0, np.cumsum(sizes)], sum(r["total"] for r in rows), bits)


def encoded(docs: DataFrame, words: np.ndarray | Vocabulary) -> DataFrame:
    """docs (doc_id, text) as symbols, in order; those that begin a sentence are negative (-1 - symbol)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for part, text in blocks(batches):
            h, length, owner, fresh = tokens(text)
            known = sent.value
            s = (known.symbols(h, length) if isinstance(known, Vocabulary) else symbols(known, h, length)).astype(np.int32)
            counts = np.bincount(owner, minlength=len(text))
            yield pa.RecordBatch.from_arrays([part.column(0), lists(np.where(fresh, -1 - s, s), counts, pa.int32())], ["doc_id", "symbols"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, symbols array<int>")


def packed(docs: DataFrame, words: Vocabulary, block: int = 4 << 20) -> DataFrame:
    """docs as blocks: their doc_ids and numbers of words, the symbols that there are, in order, and each word's place among them (those that begin a sentence -1 - place)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for part, text in blocks(batches, max_bytes=block):
            h, length, owner, fresh = tokens(text)
            names, own = np.unique(sent.value.symbols(h, length), return_inverse=True)
            own = own.ravel().astype(np.int32)
            counts = np.bincount(owner, minlength=len(text))
            one = lambda values, kind: lists(values, np.array([len(values)]), kind)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), part.column(0)), one(counts, pa.int32()), one(names.astype(np.int32), pa.int32()), one(np.where(fresh, -1 - own, own), pa.int32())], ["ids", "lens", "names", "own"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "ids array<bigint>, lens array<int>, names array<int>, own array<int>")


def _lanes(batches, most: int = 600_000):
    """ids, each one's number of symbols, the symbols there are, in order, and the lanes of their places; so many at a time (or one row)."""
    for batch in batches:
        if "own" in batch.schema.names:
            for i in range(batch.num_rows):
                ids, lens, names, own = (batch.column(c)[i].values for c in ("ids", "lens", "names", "own"))
                own = own.to_numpy()
                yield ids, lens.to_numpy().astype(np.int64), names.to_numpy().astype(np.int64), Lanes(np.where(own < 0, -1 - own, own), own < 0)
            continue
        lens = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(lens), 0
        while i < len(lens):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            s = batch.column(1).slice(i, j - i).flatten().to_numpy()
            names, own = np.unique(np.where(s < 0, -1 - s, s), return_inverse=True)
            yield batch.column(0).slice(i, j - i), lens[i:j], names, Lanes(own, s < 0)
            i = j


def converged(logs: list[float], tolerance: float = TOLERANCE) -> bool:
    """Whether the last of these rounds' log-likelihoods gained little, and no more than the round before."""
    if len(logs) < 3:
        return False
    before, gain = logs[-2] - logs[-3], logs[-1] - logs[-2]
    return gain <= tolerance * abs(logs[-1]) and gain <= before


def one_of(docs: DataFrame, every: int) -> DataFrame:
    """One of so many documents, by a hash of doc_id and text."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)


def sampled(docs: DataFrame, words: Vocabulary, states: int = STATES, most: int = SAMPLE) -> Kept:
    """A model whose states differ: words' counts, shared out among states as a converged model of a sample of documents does."""
    spark = docs.sparkSession
    some = encoded(one_of(docs, max(1, round(words.total / most))), words).select("symbols").toArrow().column(0)
    s = np.concatenate([np.zeros(0, np.int32), *[c.values.to_numpy() for c in some.chunks if len(c)]])
    names, own = np.unique(np.where(s < 0, -1 - s, s), return_inverse=True)
    lanes = Lanes(own, s < 0)
    counts = words.rows(names, "counts", np.float64)[:, 0]
    emit = counts[:, None] * _noise(words.rows(names, "words", np.uint64)[:, 0], states)
    m, logs = Model.first(np.zeros(0, np.uint64), np.ones(UNKNOWN), states), []
    last, share = m, np.zeros((0, states))
    if len(names):
        m = Model(names, m.start, m.move, emit / emit.sum(axis=0))
        while not converged(logs, SAMPLE_TOLERANCE):
            *sums, log = lanes.expected(m, len(names))
            logs.append(log)
            last, m = m, m.next(*sums)
        share = (sums[2] + SMOOTH) / (sums[2] + SMOOTH).sum(axis=1, keepdims=True)
    sent, table_ = spark.sparkContext.broadcast((names, share)), uuid.uuid4().hex

    def run(batches):
        known, shares = sent.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                lo, hi = words.offsets[b : b + 2]
                if lo == hi:
                    continue
                each = _noise(_read(f"{words.folder}/words/{b}", np.uint64), states)
                each /= each.sum(axis=1, keepdims=True)
                i, j = np.searchsorted(known, [lo, hi])
                each[known[i:j] - lo] = shares[i:j]
                each *= _read(f"{words.folder}/counts/{b}", np.float64)[:, None]
                _write(f"{words.folder}/{table_}/{b}", each)
                yield pa.RecordBatch.from_arrays([pa.array([each.sum(axis=0).tolist()])], ["sums"])

    rows = spark.range(0, 1 << words.bits, 1, 1 << words.bits - 3).mapInArrow(run, "sums array<double>").collect()
    return Kept(words, last.start, last.move, table_, np.sum([r["sums"] for r in rows], axis=0))


def train(symbols_of: DataFrame, model: Model | Kept, rounds: int | None = None, tolerance: float = TOLERANCE) -> Model | Kept:
    """The model after these rounds of Baum-Welch over encoded documents, or, without a number, when it has converged."""
    logs: list[float] = []
    while not converged(logs, tolerance) if rounds is None else len(logs) < rounds:
        before = model
        model, log = step(symbols_of, model)
        logs.append(log)
        if isinstance(before, Kept) and model is not before:
            before.drop()
        release(symbols_of.sparkSession)
    return model


def round_of(symbols_of: DataFrame, model: Model | Kept) -> Model | Kept:
    """The next model: expected counts of all partitions, added up."""
    return step(symbols_of, model)[0]


def _added(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids there are, and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    return ids[order][first], np.add.reduceat(rows[order], first, axis=0)


_PACKED = "bucket int, ids binary, sums binary"


def _packed(bucket: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """A row: symbols by their place in the bucket, in single precision; or, in bucket -1, the sums that aren't a symbol's."""
    ids, rows = (ids.astype(np.int64), rows.astype(np.float64)) if bucket < 0 else (ids.astype(np.int32), rows.astype(np.float32))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], ["bucket", "ids", "sums"])


def _unpacked(bucket: int, ids: bytes, sums: bytes, states: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64 if bucket < 0 else np.int32), np.frombuffer(sums, np.float64 if bucket < 0 else np.float32).reshape(-1, states)


def step(symbols_of: DataFrame, model: Model | Kept) -> tuple[Model | Kept, float]:
    """The next model, and this one's log-likelihood."""
    spark, k = symbols_of.sparkSession, len(model.start)
    sent = spark.sparkContext.broadcast(model)
    offsets = model.words.offsets if isinstance(model, Kept) else np.r_[0, len(model.emit)]

    def run(batches):
        few, waiting, most = np.zeros((k + 2, k)), [], 0  # starts, moves from each state, the log-likelihood

        def flush():
            ids, rows = _added(*(np.concatenate(x) for x in zip(*waiting)))
            cut = np.searchsorted(ids, offsets)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                yield _packed(b, ids[cut[b] : cut[b + 1]] - offsets[b], rows[cut[b] : cut[b + 1]])

        for _, _, names, lanes in _lanes(batches):
            if not len(names):
                continue
            start, move, emit, log = lanes.expected(sent.value.local(names), len(names))
            few += np.vstack([start, move, np.full(k, log)])
            waiting.append((names, emit))
            most += len(names)
            if most > 500_000:
                waiting = [_added(*(np.concatenate(x) for x in zip(*waiting)))]
                most = len(waiting[0][0])
                if most > 250_000:
                    yield from flush()
                    waiting, most = [], 0
        if waiting:
            yield from flush()
        if few.any():
            yield _packed(-1, -1 - np.arange(k + 2), few)

    parts = symbols_of.mapInArrow(run, _PACKED)
    table_ = uuid.uuid4().hex
    if isinstance(model, Kept):
        folder = model.words.folder

        def keep(batches):
            tables, few = {}, []
            for batch in batches:
                for b, ids, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    names, rows = _unpacked(b, ids, sums, k)
                    if b < 0:
                        few.append((names, rows))
                        continue
                    if b not in tables:
                        tables[b] = np.zeros((offsets[b + 1] - offsets[b], k))
                    tables[b][names] += rows
            for b, values in tables.items():
                _write(f"{folder}/{table_}/{b}", values)
                few.append((np.array([-3 - k]), values.sum(axis=0)[None]))  # the table's sums
            if few:
                yield _packed(-1, *_added(*(np.concatenate(x) for x in zip(*few))))

        parts = parts.repartition(1 << model.words.bits, "bucket").mapInArrow(keep, _PACKED)
    emit, found = np.zeros((len(model.emit), k)) if isinstance(model, Model) else None, np.zeros((k + 3, k))
    rows = parts.collect()
    sent.destroy()
    for r in rows:
        names, sums = _unpacked(r["bucket"], r["ids"], r["sums"], k)
        if r["bucket"] < 0:
            found[-1 - names] += sums
        else:
            emit[names] += sums
    if not rows:
        return model, 0.0
    start, move, log = found[0], found[1 : k + 1], float(found[k + 1, 0])
    up = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(axis=-1, keepdims=True)
    if isinstance(model, Kept):
        for b in np.flatnonzero(np.diff(offsets)):
            system, path = _files(f"{folder}/{table_}/{b}")
            if system.get_file_info(path).type == fs.FileType.NotFound:  # none of its symbols was met
                _write(f"{folder}/{table_}/{b}", np.zeros((offsets[b + 1] - offsets[b], k)))
        return Kept(model.words, up(start), up(move), table_, found[k + 2]), log
    return model.next(start, move, emit), log


def score(symbols_of: DataFrame, model: Model | Kept) -> DataFrame:
    """A row for each encoded document: words, log-likelihood and perplexity."""
    sent = symbols_of.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, lens, names, lanes in _lanes(batches):
            logs = np.log(lanes.forward(sent.value.local(names))[2])[lanes.where]
            total = np.bincount(np.repeat(np.arange(len(lens)), lens), logs, minlength=len(lens))
            each = pa.array(np.exp(-total / np.maximum(lens, 1)), mask=lens == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lens), pa.array(total), each], ["doc_id", "n_words", "log_likelihood", "perplexity"])

    return symbols_of.mapInArrow(run, SCHEMA)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """df, whose rows are blocks of some megabytes, written and read again. Each is a row group: the reader holds a group's rows at once, up to 4096."""
    df.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return df.sparkSession.read.parquet(path)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on all documents, and their scores; the encoded documents are kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    words = kept_vocabulary(docs, path)
    rows, part = (_stored(packed(d, words), f"{path}/{name}") for d, name in ((docs, "symbols"), (one_of(docs, PART), "part")))
    return score(rows, train(rows, train(part, sampled(docs, words), tolerance=PART_TOLERANCE)))
