"""Approximate nearest neighbours by additive quantisation: a stated set of queries against all rows.

A vector is approximated by the sum of one entry of each of M full-dimensional codebooks. Codebooks are trained
one after another on the residuals of all rows (Lloyd's sums are added up by Spark); the first one, with about
as many entries as the square root of the rows, also sorts the rows into lists. Encoding is a beam search over
the codebooks. Squared distances are estimated from the codes: the query's inner products with all entries are
tabled once, and a row costs M look-ups and its stored norm. The rows with the least estimates get their
exact distance, and the k nearest remain, ties by vec_id.

How many lists a query visits and how many rows are measured exactly is found on a few queries whose exact
neighbours over all rows are known: enough for the target recall. On clustered vectors that is a small part of the
lists; on vectors without structure hardly any list can be left out.

Lists near each other form groups of about GROUP_ROWS rows. A query goes to the groups of its lists, where only the rows of
these lists are estimated. A group to which too many queries come is there several times, and one with too many rows
is split, each part being asked all its queries, so that no task gets more than its share.

Queries are the rows whose vec_id is divisible by `every`; they search among all rows. Rows with a null vec_id or vector, with null or infinite elements, or of another length than most (of the
longest, in a tie) neither search nor are found. Repeated rows count once; a vec_id with several vectors gets
the nearest to any of them; a row is no neighbour of its own vec_id. Fewer than k others give fewer rows. Other
columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, shared_dir, table

BOOKS, ENTRIES, ROUNDS, BEAM = 8, 256, 2, 4
NEIGHBOURS = 10
TARGET, TRIALS = 0.98, 128
GROUP_ROWS, QUERY_ROWS = 16_384, 65_536
SCHEMA = "vec_id bigint, neighbour_id bigint, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), width)


@dataclass
class Books:
    books: list[np.ndarray]

    def greedy(self, x: np.ndarray) -> np.ndarray:
        """What is left of x after the nearest entry of each book in turn."""
        for book in self.books:
            x = x - book[nearest(x, book)]
        return x

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the approximations."""
        codes, norms = np.empty((len(x), len(self.books)), np.int32), np.empty(len(x), np.float32)
        for s in range(0, len(x), 2048):
            part = x[s : s + 2048]
            n = len(part)
            rest, chosen = part[:, None, :], np.zeros((n, 1, 0), np.int32)
            for book in self.books:
                width = rest.shape[1]
                cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
                cost = cost.reshape(n, -1)
                keep = min(beam, cost.shape[1])
                best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
                at, entry = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, at[:, :, None], 1) - book[entry]
                chosen = np.concatenate([np.take_along_axis(chosen, at[:, :, None], 1) if width else chosen, entry[:, :, None].astype(np.int32)], axis=2)
            codes[s : s + n] = chosen[:, 0]
            norms[s : s + n] = ((part - rest[:, 0]) ** 2).sum(1)
        return codes, norms

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each book, -2 times the inner products of the queries and its entries."""
        return [-2 * q @ book.T for book in self.books]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = 0.5 * (book**2).sum(1)
    return np.concatenate([np.argmax(x[s : s + 8192] @ book.T - half, axis=1) for s in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def estimates(tables: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Queries by rows: the estimated squared distances less the queries' squared norms."""
    out = np.take(tables[0], codes[:, 0], axis=1)
    for t, c in zip(tables[1:], codes.T[1:]):
        out += np.take(t, c, axis=1)
    out += norms
    return out


def rows_of(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that take part (vec_id, x) and their length."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("x")).where("vec_id is not null and x is not null")
    v = v.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("x") > 0))
    sizes = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    width = sizes[0]["n"] if sizes else 0
    return v.where(F.size("x") == width).dropDuplicates(), width


def train(rows: DataFrame, width: int, total: int, books: int = BOOKS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks from Lloyd's rounds over all rows, begun at rows chosen by hash."""
    lists = 1 << max(0, round(np.log2(max(1, total)) / 2))
    seeds = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(lists, entries) + books * entries).toArrow().column("x"), width)
    model, names = Books([]), [f"s{j}" for j in range(width)]
    for b in range(books):
        size = min(len(seeds), lists if not b else entries)
        shift = b * entries % max(1, len(seeds))
        book = model.greedy(np.roll(seeds, -shift, axis=0)[:size])
        for _ in range(rounds + (not b)):
            sent = rows.sparkSession.sparkContext.broadcast((model, book))

            def run(batches, sent=sent):
                sums, counts = None, None
                for batch in batches:
                    prior, now = sent.value
                    x = prior.greedy(_matrix(batch.column(0), width))
                    at = nearest(x, now)
                    if sums is None:
                        sums, counts = np.zeros(now.shape), np.zeros(len(now), np.int64)
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(at) else np.zeros(0, np.int64)
                    if len(first):
                        sums[at[order][first]] += np.add.reduceat(x[order].astype(np.float64), first)
                    counts += np.bincount(at, minlength=len(now))
                if sums is not None:
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *[pa.array(np.ascontiguousarray(sums[some, j])) for j in range(width)]], ["entry", "n", *names])

            schema = "entry bigint, n bigint, " + ", ".join(f"{n} double" for n in names)
            t = rows.select("x").mapInArrow(run, schema).groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).toArrow()
            if t.num_rows:
                book = book.copy()
                book[t.column("entry").to_numpy()] = np.column_stack([t.column(n).to_numpy() for n in names]) / t.column("n").to_numpy()[:, None]
        model.books.append(book.astype(np.float32))
    return model


def encoded(rows: DataFrame, model: Books, width: int, group: np.ndarray) -> DataFrame:
    """rows with codes, norm, and the group of their list."""
    sent = rows.sparkSession.sparkContext.broadcast((model, group))

    def run(batches):
        m, group = sent.value
        for batch in batches:
            codes, norms = m.encode(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(codes), pa.array(norms), pa.array(group[codes[:, 0]])], ["vec_id", "x", "codes", "norm", "grp"])

    return rows.mapInArrow(run, "vec_id bigint, x array<float>, codes array<int>, norm float, grp bigint")


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("...i,...i->...", d, d)


def visits(model: Books, q: np.ndarray) -> np.ndarray:
    """For each query, the lists in the order in which it visits them."""
    return np.argsort((model.books[0] ** 2).sum(1) - 2 * q @ model.books[0].T, axis=1, kind="stable")


def calibrate(enc: DataFrame, model: Books, width: int, k: int, target: float = TARGET, trials: int = TRIALS) -> tuple[int, int]:
    """Lists to visit and rows to measure so that the trial queries find the target share of their neighbours, twice."""
    sample = enc.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(trials).toArrow()
    q, own = _matrix(sample.column("x"), width), sample.column("vec_id").to_numpy()
    sent = enc.sparkSession.sparkContext.broadcast((model, q, own))

    def first(batches):
        m, q, own = sent.value
        best: list[list[np.ndarray]] = []
        for batch in batches:
            ids, x, codes = batch.column(0).to_numpy(), _matrix(batch.column(1), width), _matrix(batch.column(2), len(m.books)).astype(np.int64)
            d = (x**2).sum(1) - 2 * q @ x.T
            d[own[:, None] == ids[None, :]] = np.inf
            est = estimates(m.tables(q), codes, batch.column(3).to_numpy())
            top = np.argpartition(d, min(k, len(ids)) - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(q)), top.shape[1])
            j = top.ravel()
            ok = np.isfinite(d[i, j])
            best.append([i[ok], d[i, j][ok].astype(np.float64), codes[j, 0][ok], est[i, j][ok].astype(np.float64)])
            if len(best) > 8:
                best = [_least(best, k)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(best, k)], ["q", "d", "list", "est"])

    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "list", "est"))), 1, k).alias("near")
    tops = enc.mapInArrow(first, "q bigint, d double, list bigint, est double")  # k rows of each task for each query; k of some tasks, then of all
    some = tops.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(1024)).alias("s")).agg(near).select("q", F.explode("near").alias("n")).select("q", "n.*")
    found = some.groupBy("q").agg(near).collect()
    if not found:
        return 1, 1
    order = np.argsort(visits(model, q), axis=1)  # a list's turn
    turn = np.concatenate([[order[r["q"], n["list"]] for n in r["near"]] for r in found])
    lists = int(np.quantile(turn, target, method="higher")) + 1
    marks = {r["q"]: np.array([n["est"] for n in r["near"]]) for r in found}
    sent2 = enc.sparkSession.sparkContext.broadcast((model, q, marks, order < lists))

    def second(batches):
        m, q, marks, open_to = sent2.value
        counts = np.zeros((len(q), k), np.int64)
        for batch in batches:
            codes = _matrix(batch.column(2), len(m.books)).astype(np.int64)
            est = estimates(m.tables(q), codes, batch.column(3).to_numpy())
            est[~open_to[:, codes[:, 0]]] = np.inf
            for i, at in marks.items():
                counts[i, : len(at)] += np.searchsorted(np.sort(est[i]), at, side="right")
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(counts[i, j])], ["q", "j", "n"])

    ranks = [r["n"] for r in enc.mapInArrow(second, "q bigint, j bigint, n bigint").groupBy("q", "j").agg(F.sum("n").alias("n")).collect()]
    return lists, int(np.quantile(ranks, target, method="higher")) + 1


def _least(parts: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """Of arrays (query, distance, ...), the k rows of least distance for each query."""
    q, d, *rest = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((d, q))
    at = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[at < k]
    return [x[order] for x in (q, d, *rest)]


def grouped(model: Books, total: int, group_rows: int = GROUP_ROWS) -> np.ndarray:
    """A group for each list: nearby lists together."""
    centres = model.books[0]
    n = max(1, min(len(centres), -(-total // group_rows)))
    group = np.zeros(len(centres), np.int64)
    parts = [np.arange(len(centres))]
    while len(parts) < n:  # halve the largest along its widest direction
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        y = centres[own] - centres[own].mean(axis=0)
        order = own[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
        parts += [order[: len(own) // 2], order[len(own) // 2 :]]
    for i, own in enumerate(parts):
        group[own] = i
    return group


def search(model: Books, members: pa.Table, queries: pa.Table, width: int, k: int, lists: int, measured: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's vec_id, neighbour's, squared distance) of the queries' nearest among the members."""
    ids, x = members.column("vec_id").to_numpy(), _matrix(members.column("x"), width)
    codes, norms = _matrix(members.column("codes"), len(model.books)).astype(np.int64), members.column("norm").to_numpy()
    order = np.argsort(codes[:, 0], kind="stable")  # a list's rows side by side
    ids, x, codes, norms = ids[order], x[order], codes[order], norms[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(codes[:, 0])) + 1, len(ids)].tolist()
    names, every = queries.column("vec_id").to_numpy(), _matrix(queries.column("x"), width)
    step = max(1, min(256, (1 << 22) // max(1, len(ids))))
    for s in range(0, len(names), step):
        q, own = every[s : s + step], names[s : s + step]
        tables = model.tables(q)
        if lists < len(model.books[0]):
            est = np.full((len(q), len(ids)), np.inf, np.float32)
            open_to = np.zeros((len(q), len(model.books[0])), bool)
            np.put_along_axis(open_to, visits(model, q)[:, :lists], True, axis=1)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if len(some := np.flatnonzero(open_to[:, codes[lo, 0]])):
                    est[some, lo:hi] = estimates([t[some] for t in tables], codes[lo:hi], norms[lo:hi])
        else:
            est = estimates(tables, codes, norms)
        est[own[:, None] == ids[None, :]] = np.inf
        keep = min(measured, len(ids))
        best = np.argpartition(est, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), (len(q), len(ids)))
        ok = np.isfinite(np.take_along_axis(est, best, 1))
        d = np.full(best.shape, np.inf)
        for i in range(0, len(q), 16):
            d[i : i + 16] = _exact(q[i : i + 16, None, :], x[best[i : i + 16]])
        d[~ok] = np.inf
        if k < d.shape[1]:
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            at_most = np.take_along_axis(d, part, 1).max(axis=1, keepdims=True)
            i, j = np.nonzero((d <= at_most) & np.isfinite(d))  # with ties
        else:
            i, j = np.nonzero(np.isfinite(d))
        yield own[i], ids[best[i, j]], d[i, j]


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, target: float = TARGET, every: int = 1, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest other rows of each query among vectors (vec_id, embedding), by Euclidean distance: (vec_id, rank, neighbour_id, distance)."""
    spark = vectors.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/ann-{uuid.uuid4().hex}"
    rows, width = rows_of(bounded(vectors))
    rows.write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], T.StructType.fromDDL("vec_id bigint, rank int, neighbour_id bigint, distance double"))
    model = train(rows, width, total)
    group = grouped(model, total, group_rows)
    encoded(rows, model, width, group).write.parquet(f"{base}/codes")
    enc = spark.read.parquet(f"{base}/codes")
    lists, measured = calibrate(enc, model, width, k, target)
    sent = spark.sparkContext.broadcast((model, group))

    def sends(batches):
        m, group = sent.value
        groups = int(group.max()) + 1
        for batch in batches:
            x = _matrix(batch.column(1), width)
            for s in range(0, len(x), 1024):
                to = group[visits(m, x[s : s + 1024])[:, :lists]]
                i, g = np.divmod(np.unique(np.arange(len(to))[:, None] * groups + to), groups)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + s)), batch.column(1).take(pa.array(i + s)), pa.array(g)], ["vec_id", "x", "grp"])

    asked = enc.where(F.col("vec_id") % every == 0).select("vec_id", "x").mapInArrow(sends, "vec_id bigint, x array<float>, grp bigint")
    asked.write.parquet(f"{base}/queries")
    queries = spark.read.parquet(f"{base}/queries")
    # a row for each group that is asked, of which there is one for group_rows rows
    parts = enc.groupBy("grp").agg(F.ceil(F.count("*") / (4 * group_rows)).cast("int").alias("parts"))
    shares = queries.groupBy("grp").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares"))
    plan = F.broadcast(parts.join(shares, "grp"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("bigint")).cast("int")
    members = enc.join(plan, "grp").withColumn("part", one("parts")).withColumn("share", each("shares")).drop("parts", "shares")
    queries = queries.join(plan, "grp").withColumn("share", one("shares")).withColumn("part", each("parts")).drop("parts", "shares")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if left.num_rows and right.num_rows:
            out += search(sent.value[0], left, right, width, k, lists, measured)
        return pa.table([np.concatenate(x) for x in zip(*out)], ["vec_id", "neighbour_id", "distance"])

    key = ("grp", "part", "share")
    found = members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, SCHEMA)
    nearest_of = found.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("d")).groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour_id"))), 1, k).alias("near"))
    flat = nearest_of.select("vec_id", F.posexplode("near").alias("pos", "n"))
    return flat.select("vec_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.sqrt("n.d").alias("distance"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose vec_id is divisible by 100 are the queries, all rows are searched."""
    return neighbours(table(spark, sf_dir, "embeddings"), every=100)
