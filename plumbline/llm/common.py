"""What the operators share: tables, the shared folder, byte blocks of text and word hashes."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte that UTF-8 never holds; it stands after each text of a block.
END = 0xFF
#: Of an Arrow batch, and of the texts that are taken apart at a time: numpy needs some 100 bytes for each.
BATCH_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session hold BATCH_BYTES at most from now on, or one row, unless another bound than Spark's own is set."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach, from spark.checkpoint.dir.

    Only in local mode, where the session names none, is one made and set as checkpoint directory; elsewhere ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what nothing refers to any more; it waits for a collection otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", most: int = 5_000_000) -> DataFrame:
    """docs without the rows whose key is in gone (one column of distinct bigints); rows with a null key stay.

    gone is broadcast if it has at most so many rows (8 bytes each); else both sides are shuffled.
    """
    gone = checkpoint(gone.toDF("_gone"))
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.{key}") == F.col("g._gone"), "left_anti")


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches whose text is max_bytes long at most, or one row; the text column comes beside."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        lens = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        ends, i = np.cumsum(lens), 0
        while i < len(lens):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(i, j - i), text.slice(i, j - i)
            i = j


def joined(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with END after each, and where each starts (and, last, the length). Null counts as empty."""
    parts = [x or b"" for x in pc.cast(text, pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()]
    buf = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return buf, starts


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(chars: bytes, high: bool = True) -> np.ndarray:
    """256 booleans: the bytes in chars, and those of non-ASCII characters if high."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    t[0x80:END] = high
    return t


#: Letters, digits and every non-ASCII character make words.
WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Everything but ASCII white space.
SOLID = ~byte_table(b" \t\r\n\x0b\x0c\xff", high=False)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        for k, base in (("r", _R), ("i", _RINV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["r"], _powers["i"]


def _prefix_sums(part: np.ndarray, r: np.ndarray) -> np.ndarray:
    p = np.zeros(len(part) + 1, np.uint64)
    p[1:] = part
    p[1:] += np.uint64(1)
    p[1:] *= r[: len(part)]
    return np.cumsum(p, out=p)


def word_hashes(buf: np.ndarray, word: np.ndarray = WORD, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each run of word bytes. Long buffers go chunk by chunk, cut between words."""
    found, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + chunk)
        while end < len(buf):
            gap = np.flatnonzero(~word[buf[max(at, end - 65536) : end]])
            if len(gap):
                end = max(at, end - 65536) + int(gap[-1]) + 1
                break
            end = min(len(buf), end + 65536)
        part = buf[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = word[part]
        step = np.diff(inside)
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        r, inv = _power(max(len(part), 1))
        p = _prefix_sums(part, r)
        found.append((mix((p[e] - p[s]) * inv[s]), s + at, e + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def span_hashes(buf: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each of the spans of bytes that follow one another in buf up to these ends."""
    found, i, at = [np.zeros(0, np.uint64)], 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, at + chunk, side="right")))
        part, e = buf[at : ends[j - 1]], ends[i:j] - at
        s = np.r_[0, e[:-1]]
        r, inv = _power(len(part) + 1)
        p = _prefix_sums(part, r)
        found.append(mix((p[e] - p[s]) * inv[s]))
        i, at = j, int(ends[j - 1])
    return np.concatenate(found)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive word hashes: len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= np.uint64(_R)
        g += h[j : j + n]
    return mix(g)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: counts[i] of the values for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
