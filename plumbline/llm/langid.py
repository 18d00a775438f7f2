"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has, at each of its positions, one bit for each language. An n-gram's k positions,
and-ed, give the mask of all languages that (perhaps) contain it: one look-up answers for every language.
A text's hits per language are the popcounts of that bit over all its n-grams. A filter whose bit is set at
a share p of the positions says yes to a foreign n-gram with probability p**k, so the share of hits is
corrected to (share - p**k) / (1 - p**k); the language with the highest corrected share decides, the
first in alphabetical order in a tie.

N-grams are the successive n bytes of the lower-cased text in which each run of bytes other than letters is
one blank. The filters are fitted on a sample of labelled rows of about max_train_docs a language (by a hash
of doc_id, all rows where there are fewer); an n-gram counts where it occurs in at least the share min_share of a
language's sampled rows, and in one.

A null or empty text, or one without letters, has lang_found null and share 0. Rows with a null text or
label don't train. Without any training row every text has lang_found null. Repeated rows are decided
alike. Columns other than those named aren't read by identify(); keep() hands all columns on as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, byte_table, joined, mix, table

MAX_TRAIN_DOCS = 1500
N, MIN_SHARE, BITS, HASHES = 4, 0.002, 20, 3
#: A text of which no language has this share is rejected.
LEAST_SHARE = 0.4
SCHEMA = "doc_id bigint, lang_found string, share double, margin double, n_grams bigint"
_LETTER = byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def grams(text: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every n-gram of every text, and the number of the text it is from."""
    buf, starts = joined(pc.utf8_lower(text))
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]  # of a run of other bytes, the first
    ends = starts[1:] - 1
    keep[ends] = True  # the END after a text, so that no n-gram spans two
    chars = np.where(letter, buf, np.uint8(32))
    chars[ends] = 0xFF
    before = np.r_[0, np.cumsum(keep)][starts]  # how many are kept before each text
    chars = chars[keep]
    if len(chars) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(chars) - n + 1
    within, blank = chars != 0xFF, chars == 32
    key, whole, blanks = chars[:m].astype(np.uint64), within[:m].copy(), blank[:m].copy()
    for j in range(1, n):
        key <<= np.uint64(8)
        key |= chars[j : j + m]
        whole &= within[j : j + m]
        blanks &= blank[j : j + m]
    whole &= ~blanks
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(np.r_[0, np.cumsum(whole)][np.minimum(before, m)]))
    return mix(key[whole]), owner


def places(h: np.ndarray, bits: int, hashes: int):
    """The positions of each n-gram in the filter, one array for each hash function."""
    fresh = lambda j: mix(h + np.uint64(j)) >> np.uint64(64 - bits)
    own = lambda j: (h >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)
    return [(own(j) if bits * (j + 1) <= 64 else fresh(j)).view(np.int64) for j in range(hashes)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    false: np.ndarray  # probability of a false hit, by language
    n: int = N
    hashes: int = HASHES

    @classmethod
    def of(cls, sets: dict[str, np.ndarray], n: int = N, bits: int = BITS, hashes: int = HASHES) -> Filters:
        """Filters of each language's n-gram hashes."""
        if len(sets) > 64:
            raise ValueError("at most 64 languages")
        kind = next(t for t, size in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(sets) <= size)
        names, slots = sorted(sets), np.zeros(1 << bits, kind)
        for i, name in enumerate(names):
            for at in places(sets[name], bits, hashes):
                slots[np.unique(at)] |= kind(1 << i)
        fill = np.array([((slots >> kind(i)) & kind(1)).mean() for i in range(len(names))])
        return cls(names, slots, fill**hashes, n, hashes)

    def shares(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The corrected share of hits, text by language, and the number of n-grams of each text."""
        h, owner = grams(text, self.n)
        total = np.bincount(owner, minlength=len(text))
        out = np.zeros((len(text), max(1, len(self.languages))))
        if not self.languages:
            return out, total
        at = places(h, len(self.table).bit_length() - 1, self.hashes)
        mask = self.table[at[0]]
        for x in at[1:]:
            mask &= self.table[x]
        # texts by masks, if those are few: a mask's count is a hit for each of its bits
        few = np.bincount(owner * 256 + mask, minlength=256 * len(text)).reshape(-1, 256) if mask.dtype == np.uint8 else None
        for i in range(len(self.languages)):
            if few is None:
                hits = np.bincount(owner, (mask >> mask.dtype.type(i)) & mask.dtype.type(1), minlength=len(text))
            else:
                hits = few @ (np.arange(256) >> i & 1)
            out[:, i] = (hits / np.maximum(total, 1) - self.false[i]) / max(1e-9, 1 - self.false[i])
        out[total == 0] = 0
        return np.clip(out, 0, 1), total


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, n: int = N, min_share: float = MIN_SHARE, bits: int = BITS, hashes: int = HASHES) -> Filters:
    """Filters from docs (doc_id, text, lang)."""
    docs = bounded(docs).select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, size in sorted(sizes.items()):
        rate = min(1.0, max_train_docs / size)
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))))

    def count(batches):
        for part, text in blocks(batches):
            langs = part.column(1)
            h, owner = grams(text, n)
            if not len(h):
                continue
            once = np.unique(mix(h + mix(owner.astype(np.uint64))), return_index=True)[1]
            lang = pc.dictionary_encode(langs)
            h, code = h[once], np.asarray(lang.indices)[owner[once]]
            for c in np.unique(code):
                gram, seen = np.unique(h[code == c], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang.dictionary[int(c)], len(gram)), pa.array(gram.view(np.int64)), pa.array(seen)], ["lang", "gram", "docs"])

    sample = docs.where(chosen & F.col("text").isNotNull())
    seen = sample.select("text", "lang").mapInArrow(count, "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    least = F.lit(0.0)
    for lang, size in sizes.items():
        least = F.when(F.col("lang") == lang, min_share * min(size, max_train_docs)).otherwise(least)
    found = seen.where(F.col("docs") >= least).select("lang", "gram").toArrow()
    code = found.column("lang").to_numpy() if found.num_rows else np.zeros(0, object)
    hashes_found = found.column("gram").to_numpy().view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
    return Filters.of({lang: hashes_found[code == lang] for lang in sizes if (code == lang).any()}, n, bits, hashes)


def _decided(filters: Filters, text: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    share, total = filters.shares(text)
    best = share.argmax(axis=1)
    top = share[np.arange(len(share)), best]
    rest = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
    names = [filters.languages[b] if t > 0 else None for b, t in zip(best, top)]
    return names, top, top - rest, total


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """A row for each of docs (doc_id, text): the language, its corrected share, and the distance to the next one's."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for part, text in blocks(batches):
            names, top, margin, total = _decided(model.value, text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(margin), pa.array(total.astype(np.int64))], ["doc_id", "lang_found", "share", "margin", "n_grams"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, filters: Filters, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs, with all columns, that some language has to the least share.

    A text with letters that is too short for an n-gram can't be judged and stays; null texts and those without letters go.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for part, text in blocks(batches):
            _, top, _, total = _decided(model.value, text)
            short = (total == 0) & np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
            yield part.filter(pa.array((top >= least_share) | short))

    return bounded(docs).mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
