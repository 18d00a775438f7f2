"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. Each window of W
successive hashes of K words keeps its minimum (the rightmost one in a tie), so that any span of
W + K - 1 words that a document shares with a benchmark item has a fingerprint in common with it: both
sides keep the same hash. Common fingerprints are hits; each is extended word by word to both sides as
far as the two texts agree, and spans of at least W + K - 1 words are reported. Every such span is found.

The benchmark's fingerprints and word hashes are broadcast while they have at most `broadcast_words`
words. Beyond it the fingerprints of both sides are joined by a shuffle, and the texts of the pairs that
hit are brought together for the extension.

Null texts and texts with fewer than W + K - 1 words have no span, on either side; so have items with
a null item_id and documents with a null doc_id. The result is a set: repeated rows don't repeat spans.
Columns other than ids and texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, gram_hashes, joined, table, without, word_hashes

K, W = 5, 4
BROADCAST_WORDS = 4_000_000
_KEY = "__plumbline_key"
SCHEMA = "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int"


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words start (and, last, their number)."""
    buf, starts = joined(pc.utf8_lower(text))
    h, at, _ = word_hashes(buf)
    return h, np.searchsorted(at, starts)


def fingerprints(h: np.ndarray, bounds: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Each text's winnowed hashes, and their words' positions in h."""
    g = gram_hashes(h, k)
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, w):
        take = g[j : j + m] <= best
        np.copyto(best, g[j : j + m], where=take)
        at[take] = np.flatnonzero(take) + j
    inside = np.zeros(m, bool)
    for s, e in zip(bounds[:-1], bounds[1:] - (w + k - 2)):
        inside[s : max(s, e)] = True
    at = np.unique(at[inside])
    return g[at], at


def spans(doc: np.ndarray, item: np.ndarray, hits: np.ndarray, k: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal agreeing spans (start in doc, start in item, words) through the hits (position in doc, in item)."""
    reached: dict[int, int] = {}
    for i, j in hits[np.lexsort((hits[:, 0], hits[:, 0] - hits[:, 1]))].tolist():
        if reached.get(i - j, -1) >= i + k:
            continue
        n = min(len(doc) - i, len(item) - j)
        differ = np.flatnonzero(doc[i : i + n] != item[j : j + n])
        after = int(differ[0]) if len(differ) else n
        m = min(i, j)
        differ = np.flatnonzero(doc[i - m : i] != item[j - m : j])
        before = m - 1 - int(differ[-1]) if len(differ) else m
        reached[i - j] = i + after
        if before + after >= least:
            yield i - before, j - before, before + after


@dataclass
class Index:
    """Benchmark items: word hashes, and fingerprints in order with item and position."""

    ids: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    prints: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, items: pa.Table, k: int = K, w: int = W) -> Index:
        h, bounds = words(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()))
        prints, at = fingerprints(h, bounds, k, w)
        item = np.searchsorted(bounds, at, side="right") - 1
        order = np.argsort(prints, kind="stable")
        return cls(items.column("item_id").to_numpy(), h, bounds, prints[order], item[order], (at - bounds[item])[order])

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the print, index into this) of all that are equal."""
        lo, hi = np.searchsorted(self.prints, prints), np.searchsorted(self.prints, prints, side="right")
        n = hi - lo
        own = np.repeat(np.arange(len(prints)), n)
        return own, np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])


def _narrow(df: DataFrame, key: str) -> DataFrame:
    return bounded(df).select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Shared spans of docs (doc_id, text) and benchmark (item_id, text): where they start, in words, and how long they are."""
    docs, items = _narrow(docs, "doc_id"), _narrow(benchmark, "item_id")
    return (_broadcast if _size(items) <= broadcast_words else _shuffled)(docs, items, k, w).distinct()


def _size(items: DataFrame) -> float:
    """At least as many as the words of the items: one takes two characters."""
    return items.agg(F.sum(F.length("text") / 2)).first()[0] or 0


def _found(index: Index, text: pa.Array, k: int, w: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, start in the text, start in the item, words) of all shared spans."""
    h, bounds = words(text)
    prints, at = fingerprints(h, bounds, k, w)
    own, hit = index.hits(prints)
    if not len(own):
        return
    doc = np.searchsorted(bounds, at[own], side="right") - 1
    item = index.item[hit]
    places = np.column_stack([at[own] - bounds[doc], index.at[hit]])
    pair = doc * np.int64(len(index.ids)) + item
    order = np.argsort(pair, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(pair[order])) + 1, len(order)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        d, i = int(doc[order[lo]]), int(item[order[lo]])
        its = index.words[index.bounds[i] : index.bounds[i + 1]]
        for span in spans(h[bounds[d] : bounds[d + 1]], its, places[order[lo:hi]], k, k + w - 1):
            yield d, i, *span


def _broadcast(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(Index.of(items.toArrow(), k, w))

    def run(batches):
        index: Index = model.value
        for part, text in blocks(batches):
            ids = part.column(0).to_numpy(zero_copy_only=False)
            if rows := [(int(ids[d]), int(index.ids[i]), *x) for d, i, *x in _found(index, text, k, w)]:
                yield _rows(rows)

    return docs.mapInArrow(run, SCHEMA)


def _shuffled(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    def prints(key: str):
        def run(batches):
            for part, text in blocks(batches):
                h, bounds = words(text)
                p, at = fingerprints(h, bounds, k, w)
                own = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(p.view(np.int64))], [key, "print"])

        return run

    left = docs.mapInArrow(prints("doc_id"), "doc_id bigint, print bigint")
    right = items.mapInArrow(prints("item_id"), "item_id bigint, print bigint").distinct()
    pairs = left.join(right, "print").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.distinct(), "doc_id").join(items.distinct().withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "text", "item")

    def run(batches):
        for part, text in blocks(batches):
            h, bounds = words(text)
            g, ends = words(part.column(3))
            rows = []
            for r, (d, i) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                own, its = h[bounds[r] : bounds[r + 1]], g[ends[r] : ends[r + 1]]
                p, at = fingerprints(own, np.array([0, len(own)]), k, w)
                q, to = fingerprints(its, np.array([0, len(its)]), k, w)
                order = np.argsort(q, kind="stable")
                lo, hi = np.searchsorted(q[order], p), np.searchsorted(q[order], p, side="right")
                hits = [(at[a], to[order[b]]) for a in np.flatnonzero(hi > lo) for b in range(lo[a], hi[a])]
                if hits:
                    rows += [(d, i, *x) for x in spans(own, its, np.array(hits), k, k + w - 1)]
            if rows:
                yield _rows(rows)

    return both.mapInArrow(run, SCHEMA)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Runs of equal words on a diagonal, found from all shared spans of eight words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
bg AS (SELECT item_id, j - 1 AS j, array_to_string(w[j:j + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS j FROM b WHERE len(w) >= 8)),
hit AS (SELECT DISTINCT doc_id, item_id, i, j FROM dg JOIN bg USING (g)),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS r FROM hit)
SELECT doc_id, item_id, CAST(min(i) AS INTEGER) AS doc_word, CAST(min(j) AS INTEGER) AS item_word, CAST(count(*) + 7 AS INTEGER) AS n_words
FROM run GROUP BY doc_id, item_id, i - j, r
"""


def drop(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs that share no span with the benchmark, with all columns, whatever their doc_id; null texts stay.

    With a benchmark that can be broadcast each row is decided where it is; else texts go by a 64-bit hash.
    """
    items = _narrow(benchmark, "item_id")
    if _size(items) > broadcast_words:
        texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
        return without(docs.withColumn(_KEY, F.xxhash64("text")), contaminated(texts, benchmark, k, w, broadcast_words).select("doc_id").distinct(), _KEY).drop(_KEY)
    model = docs.sparkSession.sparkContext.broadcast(Index.of(items.toArrow(), k, w))

    def run(batches):
        for part, text in blocks(batches):
            clean = np.ones(part.num_rows, bool)
            clean[[d for d, *_ in _found(model.value, text, k, w)]] = False
            yield part.filter(pa.array(clean))

    return bounded(docs).mapInArrow(run, docs.schema)
