"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

Each document is reduced to the statistics named in FEATURES, counted over its whole text. Trees of one depth
are fitted to the logistic loss: features are cut into bins at quantiles, a level's nodes get the sums of
gradients and of curvatures by bin in one count, and each node splits where that gains most. The fitted trees
are three flat arrays (feature, threshold, leaf); all rows walk a tree together, one numpy step for a level.

Training takes a sample of about `max_train_rows` labelled rows by a hash of doc_id (all rows where there are
fewer); rows with a null label or text don't train. A class without rows, or no rows at all, gives the same
score to every document: the share of good labels, or 1. Ties between splits go to the first feature and bin.

A null text counts as an empty one: all its statistics are 0. Repeated rows are scored alike. Columns other than
doc_id, text and quality aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, blocks, bounded, byte_table, gram_hashes, joined, mix, table, word_hashes

MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, SHRINK, LEAST_WEIGHT = 60, 4, 0.15, 64, 1.0, 2.0
#: Documents with a lower probability of good quality are rejected.
LEAST_SCORE = 0.25
SCHEMA = "doc_id bigint, score double, keep boolean"
_KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "bar", "symbol", "other")
FEATURES = (
    "log_chars", "log_words", *[f"share_{k}" for k in _KINDS], "word_length", "word_length_sd", "longest_word", "distinct_words",
    "distinct_pairs", "distinct_lines", "line_length", "top_word", "sentence_words", "symbol_words", "capital_words",
)


def _kinds() -> np.ndarray:
    t = np.full(256, _KINDS.index("other"), np.uint8)
    t[33:127] = _KINDS.index("symbol")
    for k, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t"), ("line", b"\r\n"), ("stop", b".!?"), ("comma", b",;:'\"-()"), ("bar", b"|")):
        t[list(chars)] = _KINDS.index(k)
    return t


_KIND = _kinds()
_NOT_LINE = ~byte_table(b"\n\xff", high=False)


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each owner has, and how often the most frequent is there."""
    _, first, count = np.unique(mix(h + mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, owner[first], count)
    return np.bincount(owner[first], minlength=n), top


def statistics(text: pa.Array) -> np.ndarray:
    """Documents by FEATURES."""
    n = len(text)
    buf, starts = joined(text)
    size = np.diff(starts) - 1
    kind = _KIND[buf].astype(np.int64)
    kind[starts[1:] - 1] = len(_KINDS)
    owner = np.repeat(np.arange(n, dtype=np.int64) * (len(_KINDS) + 1), np.diff(starts))
    counts = np.bincount(owner + kind, minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, : len(_KINDS)]
    share = counts / np.maximum(size, 1)[:, None]
    h, s, e = word_hashes(buf, SOLID)
    own = np.searchsorted(starts, s, side="right") - 1
    words = np.bincount(own, minlength=n)
    some = np.maximum(words, 1)
    length = (e - s).astype(np.float64)
    mean = np.bincount(own, length, minlength=n) / some
    sd = np.sqrt(np.maximum(0, np.bincount(own, length**2, minlength=n) / some - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    distinct, top = _distinct(h, own, n)
    pairs = gram_hashes(h, 2)
    inside = own[1:] == own[:-1]
    pair_owner = own[:-1][inside] if len(own) else own
    distinct_pairs, _ = _distinct(pairs[inside], pair_owner, n)
    lh, ls, le = word_hashes(buf, _NOT_LINE)
    line_owner = np.searchsorted(starts, ls, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    distinct_lines, _ = _distinct(lh, line_owner, n)
    k = _KIND[buf[np.maximum(e - 1, 0)]] if len(e) else np.zeros(0, np.uint8)
    ended = np.bincount(own, k == _KINDS.index("symbol"), minlength=n)
    capital = np.bincount(own, _KIND[buf[s]] == _KINDS.index("upper"), minlength=n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), share, mean, sd, np.log1p(longest), distinct / some, distinct_pairs / np.maximum(words - 1, 1), distinct_lines / lines,
        np.log1p(size / lines), top / some, words / np.maximum(counts[:, _KINDS.index("stop")], 1), ended / some, capital / some,
    ])


@dataclass
class Trees:
    """Trees in flat arrays. A node's children are at 2 i + 1 and 2 i + 2; the left one takes values up to the threshold."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, shrink: float = SHRINK, least: float = LEAST_WEIGHT) -> Trees:
    """Fits trees to rows x with labels y in {0, 1}."""
    inner, width = 2**depth - 1, x.shape[1] if x.ndim == 2 else 1
    share = y.mean() if len(y) else 1.0
    if not 0 < share < 1:
        return Trees(40.0 if share else -40.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            base = (at - first) * bins
            best = np.full(nodes, 1e-9)
            for j in range(width):
                gs = np.bincount(base + code[:, j], g, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                hs = np.bincount(base + code[:, j], h, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + shrink) + (ga - gs) ** 2 / (ha - hs + shrink) - ga**2 / (ha + shrink)
                gain[(hs < least) | (ha - hs < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[t, first + i], threshold[t, first + i] = top[i], j, cuts[j][k[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        gs, hs = np.bincount(at - inner, g, minlength=inner + 1), np.bincount(at - inner, h, minlength=inner + 1)
        leaf[t] = rate * gs / (hs + shrink)
        margin += leaf[t][at - inner]
    return Trees(start, feature, threshold, leaf)


def sample(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels (quality, 0 or 1) of the sampled rows of labels."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    rate = min(1.0, max_train_rows / max(1, labels.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))

    def run(batches):
        for part, text in blocks(batches):
            flat = statistics(text).ravel()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    bodies = bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = bodies.where(chosen & F.col("text").isNotNull()).mapInArrow(run, "doc_id bigint, x array<double>")
    found = rows.join(labels.where(chosen), "doc_id").orderBy("doc_id", "quality").select("x", "quality").toArrow()
    if not found.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return pc.list_flatten(found.column("x").combine_chunks()).to_numpy().reshape(-1, len(FEATURES)), (found.column("quality").to_numpy() > 0).astype(np.float64)


def classify(docs: DataFrame, trees: Trees, least_score: float = LEAST_SCORE) -> DataFrame:
    """A row for each of docs (doc_id, text): the probability that its quality is good, and whether to keep it."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for part, text in blocks(batches):
            score = model.value.score(statistics(text))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score >= least_score)], ["doc_id", "score", "keep"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, boosted(*sample(docs, table(spark, sf_dir, "labels"))))
