"""All pairs of documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; a text of fewer than n
words has its whole sequence of words as only n-gram. All sets are in one global order: n-grams seen often
come last, by how often, and the rest go by hash. Which n-grams are frequent is found over all documents from
repetitions within windows of a few million n-grams; the order decides how much work there is, never the result.

1. Documents with equal sets (a 64-bit fingerprint of the set stands for it) form a class, which is joined once.
2. Each set hands out its prefix: two sets similar enough have at least `common` n-grams (or all that the
   threshold asks of small sets) in both prefixes. Prefix n-grams meet by a shuffle; those of one set only end there.
3. The n-grams' lists of sets are brought together by their least member, the lists' co-occurrences counted,
   and the counts of a pair added up. Pairs with enough of them, and of sizes that allow the threshold, are
   candidates, and each is given to one of its leaders. Where many of a leader's sets are candidates of one another
   (a dense group) a star of them goes on instead of their pairs; stars that meet, and what is a candidate of a
   set in one, make one group. Pairs within a group are no candidates any more.
4. A leader's sets are put into a prefix tree, whose paths share the overlaps with all other sets, node by
   node; a subtree goes as soon as its remaining length can't bring any set to the threshold. What arrives
   at the leaves are exact overlaps.
5. A group's sets are cut into blocks; each pair of blocks is a task, which takes all overlaps by matrix products and hands
   on each set's number of links and what connects the linked ones: rows grow with the sets, not with their links.

A list of more than LIST sets is cut into blocks by the sets' hash, and each pair of blocks goes on as a leader of
its own: no task gets more than two blocks of a hot n-gram's sets, and no pair is lost. There is no cap on list
lengths, partners or candidates.

linked() gives one row for each document: its class, named by the least doc_id of all documents that links connect
it to, and its number of links: the other documents whose Jaccard similarity to it reaches the threshold, copies
among them. A text without words, and a null one, has no link and its own doc_id as class. Repeated rows (the same
doc_id and set) count once; a doc_id with several texts has a row for each of their sets. Rows with a null doc_id
take part, those with one set as one document; a class of only such has a null class_id. Columns other than doc_id
and text aren't read by linked().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, checkpoint, gram_hashes, joined, lists, mix, release, table, without, word_hashes

N, THRESHOLD, COMMON = 3, 0.5, 8
#: N-grams looked at together for repetitions, and how many repetitions make one frequent.
WINDOW, FREQUENT = 4_000_000, 2
#: Entries of a broadcast table at most (8 to 16 bytes each); beyond, the frequent n-grams kept are the most frequent, and sets are joined without the filter before.
BROADCAST = 2_000_000
#: Sets of one n-gram, about, that are paired in one task.
LIST = 2048
#: Candidates of one another that make a group at least; sets and n-grams in a block of a group, about.
DENSE, BLOCK, BLOCK_GRAMS = 64, 2048, 1_000_000
#: A leader of more sets hands out its pairs one by one.
WIDE = 6144
#: Sorts before every n-gram that is frequent.
_TOP = np.uint64(1 << 63)


def gram_sets(text: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-grams, in order of their hash (63 bits), and where each text's start (and, last, the number)."""
    buf, starts = joined(pc.utf8_lower(text))
    h, at, _ = word_hashes(buf)
    bounds = np.searchsorted(at, starts)
    grams = gram_hashes(h, n)
    found, sizes = [grams[:0]], []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g = grams[s : e - n + 1] if e - s >= n else gram_hashes(h[s:e], e - s) if e > s else grams[:0]
        g = g >> np.uint64(1)
        g.sort()
        found.append(g)
        sizes.append(len(g))
    every, ends = np.concatenate(found), np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    fresh = np.ones(len(every) + 1, bool)
    fresh[1:-1] = every[1:] != every[:-1]
    fresh[ends] = True
    return every[fresh[:-1]], np.r_[0, np.cumsum(fresh[:-1])][ends]


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each set, whatever its order."""
    total = np.r_[np.uint64(0), np.cumsum(mix(flat + np.uint64(0x51ED270B9F5D)), dtype=np.uint64)]
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _narrow(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batches, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, fingerprint (both as Arrow arrays have them), flat sets and bounds of the documents that have words."""
    for part, text in blocks(batches):
        flat, bounds = gram_sets(text, n)
        some = np.diff(bounds) > 0
        bounds = np.r_[bounds[:-1][some], bounds[-1]]
        if some.any():
            yield part.column(0).filter(pa.array(some)), fingerprints(flat, bounds), flat, bounds


def _first_pass(n: int):
    """Rows (kind, a, b): 0, fingerprint and doc_id of every document; 1, n-gram and repetitions of those repeated in a window."""

    def run(batches):
        waiting, size = [], 0

        def repeated():
            every = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            count = np.diff(np.r_[first, len(every)])
            many = count > 1
            return _triples(1, every[first[many]].view(np.int64), count[many])

        for ids, prints, flat, bounds in _sets(batches, n):
            yield _triples(0, prints, ids)
            once = np.unique(prints, return_index=True)[1]
            keep = np.zeros(len(prints), bool)
            keep[once] = True  # copies aren't what makes an n-gram frequent
            waiting.append(flat[np.repeat(keep, np.diff(bounds))])
            size += len(waiting[-1])
            if size > WINDOW:
                yield repeated()
                waiting, size = [], 0
        if waiting:
            yield repeated()

    return run


def _triples(kind: int, a: np.ndarray, b: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])


def prefix_length(size: int, threshold: float, common: int) -> int:
    return min(size, size - math.ceil(threshold * size - 1e-9) + common)


def _prefixes(model, n: int, threshold: float, common: int):
    def run(batches):
        grams, counts = model.value
        for _, prints, flat, bounds in _sets(batches, n):
            at = np.minimum(np.searchsorted(grams, flat), max(0, len(grams) - 1))
            often = np.where(grams[at] == flat, counts[at], 0) if len(grams) else np.zeros(len(flat), np.int64)
            take, owner, seen, every = [], [], set(), prints.tolist()
            frequent = np.r_[0, np.cumsum(often > 0)][bounds]
            some = (frequent[1:] > frequent[:-1]).tolist()
            for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                if every[i] in seen:
                    continue
                seen.add(every[i])
                p = prefix_length(e - s, threshold, common)
                take.append(s + np.argsort(often[s:e], kind="stable")[:p] if some[i] else np.arange(s, s + p))
                owner.append(i)
            if take:
                t, o = np.concatenate(take), np.repeat(owner, [len(x) for x in take])
                size = np.diff(bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(flat[t].view(np.int64)), pa.array(prints[o]), pa.array(size[o])], ["gram", "print", "size"])

    return run


def _runs(batches, key: int = 0) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of a stream sorted by key: a run is never cut."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))
        if kept and kept[-1].column(key)[-1].as_py() != k[0] or cut:
            head = batch.slice(0, cut)
            if head.num_rows:
                kept.append(head)
            if kept:
                yield pa.Table.from_batches(kept)
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _cuts(k: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]


def _lists(most: int):
    """Sorted (gram, print, size) to (leader, cut, prints, sizes) of the n-grams with several sets.

    cut is 0 where all pairs of the row's sets count; else only those of a set before it and one from it on.
    """

    def run(batches):
        for t in _runs(batches):
            gram, prints, size = (t.column(i).to_numpy() for i in range(3))
            order = np.lexsort((prints, gram))
            gram, prints, size = gram[order], prints[order], size[order]
            fresh = np.r_[True, (gram[1:] != gram[:-1]) | (prints[1:] != prints[:-1])]
            gram, prints, size = gram[fresh], prints[fresh], size[fresh]
            cuts = _cuts(gram)
            n = np.diff(cuts)
            many = (n > 1) & (n <= most)
            if many.any():
                rows = np.repeat(many, n)
                first = cuts[:-1][many]
                yield _listed(prints[first], np.zeros(len(first), np.int32), prints[rows], size[rows], n[many])
            for i in np.flatnonzero(n > most).tolist():
                yield from _blocked(prints[cuts[i] : cuts[i + 1]], size[cuts[i] : cuts[i + 1]], most)

    return run


def _listed(leader: np.ndarray, cut: np.ndarray, prints: np.ndarray, size: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leader), pa.array(cut.astype(np.int32)), lists(prints, n, pa.int64()), lists(size, n, pa.int32())], ["leader", "cut", "prints", "sizes"])


def _blocked(prints: np.ndarray, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A long list as a row for each pair of blocks, whose sets are told by hash, so that other lists of the leader have the same ones."""
    parts = 1 << int(np.ceil(np.log2(len(prints) / most)))
    of = (mix(prints.view(np.uint64)) & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(parts + 1))
    own = [order[ends[i] : ends[i + 1]] for i in range(parts)]
    for i in range(parts):
        rows, names, at = [], [], []
        for j in range(i, parts):
            if len(own[i]) and len(own[j]) and (i < j or len(own[i]) > 1):
                rows.append(own[i] if i == j else np.r_[own[i], own[j]])
                names.append((parts << 40) + (i << 20) + j)
                at.append(0 if i == j else len(own[i]))
        if rows:
            every = np.concatenate(rows)
            leader = mix(np.array(names, np.uint64) + mix(prints[:1].view(np.uint64))).view(np.int64)
            yield _listed(leader, np.array(at), prints[every], size[every], np.array([len(r) for r in rows]))


def _spanned(linked_: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links: the least member of each one's component."""
    n = len(linked_)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        seen = np.zeros(n, bool)
        seen[i], front = True, np.array([i])
        while len(front):
            reach = np.zeros(n, bool)
            for s in range(0, len(front), 512):
                reach |= linked_[front[s : s + 512]].any(axis=0)
            front = np.flatnonzero(reach & ~seen)
            seen |= reach
        label[seen] = i
    return label


def _dense(fit: np.ndarray, both: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, threshold: float, common: int, dense: int) -> np.ndarray:
    """For each set the first of its dense group, or -1. fit: which pairs count."""
    n = len(sizes)
    sure = np.empty((n, n), bool)
    for s in range(0, n, 512):
        need = np.minimum(common, np.ceil(threshold * np.maximum(sizes[s : s + 512, None], sizes) - 1e-9))
        sure[s : s + 512] = fit[s : s + 512] & (both[s : s + 512] >= need)
    label = _spanned(sure)
    members = np.bincount(label, minlength=n)
    left = members / 2 if side is None else np.bincount(label, side == 0, minlength=n)
    links = np.bincount(label, sure.sum(axis=1), minlength=n) / 2
    # at least a quarter of the pairs
    yes = (members >= dense) & (links * 4 >= left * (members - (left if side is not None else 1)))
    return np.where(yes[label], label, -1)


def _pairs(threshold: float, common: int, dense: int | None):
    """Sorted (leader, cut, prints, sizes) to pairs (a, b, common, leader) by how many lists of the leader hold both.

    Of a dense group come pairs of its first set and each one, itself too, with common 0, and no other pairs.
    """

    def run(batches):
        for t in _runs(batches):
            leaders, split = t.column(0).to_numpy(), t.column(1).to_numpy()
            flat, size = (t.column(i).combine_chunks().flatten().to_numpy() for i in (2, 3))
            lens = pc.list_value_length(t.column(2)).to_numpy()
            ends = np.r_[0, np.cumsum(lens)]
            cuts = _cuts(leaders)
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = flat[ends[lo] : ends[hi]]
                docs, first, col = np.unique(own, return_index=True, return_inverse=True)
                sizes = size[ends[lo] : ends[hi]][first]
                if len(docs) == 2:
                    if sizes.min() >= threshold * sizes.max() - 1e-9:
                        out.append((docs[:1], docs[1:], np.array([hi - lo]), leaders[lo : lo + 1], sizes.max(keepdims=True)))
                    continue
                side = None
                if split[lo]:  # a set is in the same block in all lists
                    side = np.zeros(len(docs), np.int8)
                    side[col] = np.arange(len(own)) - np.repeat(ends[lo:hi] - ends[lo], lens[lo:hi]) >= np.repeat(split[lo:hi], lens[lo:hi])
                width = min(len(docs), 512)

                def counted(s):
                    both = np.zeros((min(width, len(docs) - s), len(docs)), np.float32)
                    for g in range(lo, hi, 256):  # some lists at a time
                        g_end = min(hi, g + 256)
                        part = slice(ends[g] - ends[lo], ends[g_end] - ends[lo])
                        has = np.zeros((g_end - g, len(docs)), np.float32)
                        has[np.repeat(np.arange(g_end - g), lens[g:g_end]), col[part]] = 1
                        both += has[:, s : s + width].T @ has
                    rows = slice(s, s + width)
                    fit = (both > 0) & (np.minimum(sizes[rows, None], sizes) >= threshold * np.maximum(sizes[rows, None], sizes) - 1e-9)
                    fit[np.arange(len(both)), np.arange(s, s + len(both))] = False
                    if side is not None:
                        fit &= side[rows, None] != side
                    return both, fit

                group = None
                if dense is not None and dense <= len(docs) <= WIDE:
                    parts = list(zip(*((b.astype(np.uint16), f) for b, f in map(counted, range(0, len(docs), width)))))
                    both, fit = (np.concatenate(x) for x in parts)
                    del parts
                    group = _dense(fit, both, sizes, side, threshold, common, dense)
                    some = np.flatnonzero(group >= 0)
                    if len(some):
                        out.append((docs[group[some]], docs[some], np.zeros(len(some)), np.zeros(len(some)), sizes[some]))
                for s in range(0, len(docs), width):
                    near, ok = counted(s) if group is None else (both[s : s + width], fit[s : s + width])
                    if group is not None:
                        ok &= (group[s : s + width, None] != group) | (group < 0)
                    x, y = np.nonzero(ok)
                    x, y = x[x + s < y], y[x + s < y]
                    out.append((docs[x + s], docs[y], near[x, y].astype(np.int64), np.full(len(x), leaders[lo]), np.maximum(sizes[x + s], sizes[y])))
                    if sum(len(o[0]) for o in out) > 200_000:
                        yield _paired(out)
                        out = []
            if out:
                yield _paired(out)

    return run


def _paired(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out), (np.int64, np.int64, np.int32, np.int64, np.int32))], ["a", "b", "common", "leader", "larger"])


def tree_join(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(i, j, overlap) of all pairs of the sets (arrays of distinct n-grams) that reach the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))  # shared n-grams first: long common paths
    code = rank[code]
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(code[order], np.arange(len(count) + 1))
    where = np.r_[0, np.cumsum(size)]
    path = [np.sort(code[where[i] : where[i + 1]]) for i in range(n)]
    leaves = sorted(range(n), key=lambda i: path[i].astype(">i4").tobytes())
    place = np.empty(n, np.int64)
    place[leaves] = np.arange(n)
    posting, size = place[posting], size[leaves]  # from here on sets go by their place among the leaves
    path = [path[i] for i in leaves]
    shared = [0]
    for a, b in zip(path, path[1:]):
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared.append(int(differ[0]) if len(differ) else m)
    shared.append(0)

    def below(tokens: np.ndarray) -> np.ndarray:
        lens = begin[tokens + 1] - begin[tokens]
        ends = np.cumsum(lens)
        at = np.repeat(begin[tokens] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(posting[at], minlength=n)

    nodes = [(0, np.zeros(n, np.int64))]  # depth and overlaps with all sets, along the path
    i = 0
    while i < n:
        while nodes[-1][0] > shared[i]:
            nodes.pop()
        if nodes[-1][0] < shared[i]:
            depth, over = nodes[-1]
            nodes.append((shared[i], over + below(path[i][depth : shared[i]])))
        if shared[i + 1] > nodes[-1][0]:  # a branching below: its subtree may end here
            depth, over = nodes[-1]
            nodes.append((shared[i + 1], over + below(path[i][depth : shared[i + 1]])))
            depth, over = nodes[-1]
            j = i + 1
            while shared[j + 1] >= depth and j + 1 < n:
                j += 1
            most, least = size[i : j + 1].max(), size[i : j + 1].min()
            bound = over + np.minimum(most - depth, size - over)
            alive = bound * (1 + threshold) >= threshold * (size + least) - 1e-9
            alive[i] = False
            if not alive[i:].any():
                i = j + 1
                continue
        depth, over = nodes[-1]
        rest = len(path[i]) - depth
        bound = over[i + 1 :] + np.minimum(rest, size[i + 1 :] - over[i + 1 :])
        if (bound * (1 + threshold) >= threshold * (size[i + 1 :] + size[i]) - 1e-9).any():
            over = (over + below(path[i][depth:]))[i + 1 :]
            for y in np.flatnonzero(over * (1 + threshold) >= threshold * (size[i] + size[i + 1 :]) - 1e-9) + i + 1:
                yield leaves[i], leaves[y], int(over[y - i - 1])
        i += 1


def _overlaps(flat: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each of the left and each of the right sets (by number) have in common."""
    names, code = np.unique(flat, return_inverse=True)
    sizes = np.diff(bounds)
    over = np.zeros((len(left), len(right)), np.float32)

    def entries(some):
        at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some.tolist()])
        row, own = np.repeat(np.arange(len(some)), sizes[some]), code[at]
        return row, own, np.bincount(own, minlength=len(names))

    (row_l, code_l, n_l), (row_r, code_r, n_r) = entries(left), entries(right)
    weight = n_l * n_r
    heavy = weight > max(64, len(left) * len(right) // 128)
    rank = np.cumsum(heavy) - 1

    def by_rank(row, own):
        keep = heavy[own]
        row, own = row[keep], rank[own[keep]]
        order = np.argsort(own, kind="stable")
        return row[order], own[order]

    (x, i), (y, j) = by_rank(row_l, code_l), by_rank(row_r, code_r)
    for c in range(0, int(heavy.sum()), 512):
        a, b = np.zeros((len(left), 512), np.float32), np.zeros((len(right), 512), np.float32)
        for m, rows, cols in ((a, x, i), (b, y, j)):
            own = slice(*np.searchsorted(cols, [c, c + 512]))
            m[rows[own], cols[own] - c] = 1
        over += a @ b.T
    order = np.argsort(code_r, kind="stable")
    posting, begin = row_r[order], np.cumsum(n_r) - n_r
    keep = ~heavy[code_l] & (n_r[code_l] > 0)
    x, i = row_l[keep], code_l[keep]
    ends, flat_over = np.cumsum(n_r[i]), over.reshape(-1)
    s = 0
    while s < len(x):  # the others one by one, a million at a time
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 1_000_000, side="right")))
        n = n_r[i[s:e]]
        at = np.repeat(begin[i[s:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(flat_over, np.repeat(x[s:e] * len(right), n) + posting[at], np.float32(1))
        s = e
    return over


def group_links(flat: np.ndarray, bounds: np.ndarray, side: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set its number of links, where each linked set counts as its copies, and the first set that links connect it to.

    Links are those of sets of side 0 with sets of side 1, or, of sets of side 2, all.
    """
    n, size = len(side), np.diff(bounds)
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    links, square = np.zeros(n), np.zeros((n, n), bool)
    if len(left) and len(right):
        over = _overlaps(flat, bounds, left, right)
        for s in range(0, len(left), 256):
            own = left[s : s + 256]
            near = over[s : s + 256].astype(np.float64) * (1 + threshold) >= threshold * (size[own, None] + size[right]) - 1e-9
            near &= own[:, None] != right
            square[np.ix_(own, right)] = near
            links[own] = near @ copies[right].astype(np.float64)
            if (side != 2).all():
                square[np.ix_(right, own)] = near.T
                links[right] += copies[own].astype(np.float64) @ near
    return links, _spanned(square)


_FOUND = "kind tinyint, a bigint, b bigint, value double"


def _exact(threshold: float):
    """Sorted (leader, print, side, copies, grams) to rows: 0, a, b, jaccard of the pairs of a leader (side 3); of a group's blocks 1, connected sets, and 2, a set and its links."""

    def run(batches):
        for t in _runs(batches):
            leaders, prints, sides, copies = (t.column(i).to_numpy() for i in range(4))
            flat = t.column(4).combine_chunks().flatten().to_numpy().view(np.uint64)
            ends = np.r_[0, np.cumsum(pc.list_value_length(t.column(4)).to_numpy())]
            cuts, rows = _cuts(leaders), []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own, first = np.unique(prints[lo:hi], return_index=True)
                sets = [flat[ends[lo + i] : ends[lo + i + 1]] for i in first.tolist()]
                if sides[lo] != 3:
                    links, root = group_links(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])], sides[lo:hi][first], copies[lo:hi][first], threshold)
                    some = np.flatnonzero(root != np.arange(len(own)))
                    yield _rows(1, own[root[some]], own[some], np.zeros(len(some)))
                    some = np.flatnonzero(links)
                    yield _rows(2, own[some], own[some], links[some])
                    continue
                for x, y, both in tree_join(sets, threshold):
                    a, b = sorted((int(own[x]), int(own[y])))
                    rows.append((a, b, both / (len(sets[x]) + len(sets[y]) - both)))
            if rows:
                yield _rows(0, *(np.array(x, k) for x, k in zip(zip(*rows), (np.int64, np.int64, np.float64))))

    return run


def _rows(kind: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(value)], ["kind", "a", "b", "value"])


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, which is stored, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _groups(candidates: DataFrame, documents: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (print, root), each pair of their blocks (leader, print, side, copies), and the candidates that are in none by themselves."""
    stars, rest = candidates.where("star"), candidates.where("not star")
    core = _small(checkpoint(stars.select(F.col("b").alias("_core")).distinct()), most)
    at = lambda c: F.col(f"{c}._core")
    rest = rest.join(core.alias("x"), F.col("a") == at("x"), "left").join(core.alias("y"), F.col("b") == at("y"), "left")
    rest = checkpoint(rest.select("a", "b", "leader", "larger", (at("x").isNotNull() | at("y").isNotNull()).alias("joins")))
    edges = stars.select("a", "b", "larger").unionByName(rest.where("joins").select("a", "b", "larger"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("print"), "larger").groupBy("print").agg(F.max("larger").alias("size"))
    root = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("print"), F.col("v").alias("root"))
    copies = documents.groupBy("print").agg(F.count("*").alias("copies"))
    nodes = checkpoint(nodes.join(root, "print", "left").join(copies, "print").select("print", F.coalesce("root", "print").alias("root"), "size", "copies"))
    parts = nodes.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)).alias("parts"))
    blocks_ = nodes.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("print"), "parts"))
    blocks_ = blocks_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    blocks_ = blocks_.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("leader"), "print", side.alias("side"), "copies")
    return nodes.select("print", "root"), blocks_, rest.where("not joins")


def members_and_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, common: int = COMMON, broadcast: int = BROADCAST, most: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Documents and their sets (print, id; distinct), and pairs of sets (a, b, jaccard), those of dense groups among them."""
    documents, found = _joined(docs, n, threshold, common, broadcast, most, None)
    return documents, found.select("a", "b", F.col("value").alias("jaccard"))


def _joined(docs: DataFrame, n: int, threshold: float, common: int, broadcast: int, most: int, dense: int | None) -> tuple[DataFrame, DataFrame]:
    """Documents and their sets (print, id; distinct), and, each once, the rows of _exact()."""
    docs, spark = _narrow(docs), docs.sparkSession
    some = docs.where("text is not null")
    first = checkpoint(some.mapInArrow(_first_pass(n), "kind tinyint, a bigint, b bigint"))
    documents = first.where("kind = 0").select(F.col("a").alias("print"), F.col("b").alias("id")).distinct()
    often = first.where("kind = 1").groupBy(F.col("a").alias("gram")).agg(F.sum("b").alias("n")).where(F.col("n") >= FREQUENT)
    found = often.orderBy(F.desc("n"), "gram").limit(broadcast).toArrow()
    grams, counts = (found.column(i).to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64) for i in range(2))
    order = np.argsort(grams)
    model = spark.sparkContext.broadcast((grams[order].view(np.uint64), counts[order]))

    prefixes = some.mapInArrow(_prefixes(model, n, threshold, common), "gram bigint, print bigint, size int")
    by_gram = prefixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(_lists(most), "leader bigint, cut int, prints array<bigint>, sizes array<int>")
    counted = by_gram.repartition("leader").sortWithinPartitions("leader").mapInArrow(_pairs(threshold, common, dense), "a bigint, b bigint, common int, leader bigint, larger int")
    # the set that shares a pair's most lists is its leader; what small sets can't have in common isn't asked
    candidates = counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max_by("leader", "common").alias("leader"), F.max("larger").alias("larger"), (F.min("common") == 0).alias("star"))
    candidates = candidates.where(F.col("star") | (F.col("common") >= F.least(F.lit(common), F.ceil(F.lit(threshold) * F.col("larger") - 1e-9))))
    candidates = checkpoint(candidates.select("a", "b", "leader", "larger", "star"))
    model.destroy()
    del prefixes, by_gram, counted
    release(spark)
    groups = None
    if dense is not None and not candidates.where("star").isEmpty():
        groups, blocks_, candidates = _groups(candidates, documents, broadcast)
    members = candidates.select("leader", F.explode(F.array("a", "b")).alias("print")).distinct().select("leader", "print", F.lit(3).alias("side"), F.lit(0).cast("bigint").alias("copies"))
    if groups is not None:
        members = members.unionByName(blocks_)
    members = checkpoint(members)
    wanted = members.select("print").distinct()
    chosen = None
    if wanted.count() <= broadcast:
        ids = wanted.toArrow().column(0)
        chosen = spark.sparkContext.broadcast(np.sort(ids.to_numpy()) if len(ids) else np.zeros(0, np.int64))

    def sets(batches):
        seen: set[int] = set()
        for _, prints, flat, bounds in _sets(batches, n):
            keep = np.ones(len(prints), bool)
            if chosen is not None:
                all_of = chosen.value
                keep = all_of[np.minimum(np.searchsorted(all_of, prints), len(all_of) - 1)] == prints if len(all_of) else ~keep
            rows = []
            for i in np.flatnonzero(keep).tolist():
                if prints[i] not in seen:
                    seen.add(prints[i])
                    rows.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                size = np.diff(bounds)[rows]
                own = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in rows])
                yield pa.RecordBatch.from_arrays([pa.array(prints[rows]), lists(own.view(np.int64), size, pa.int64())], ["print", "grams"])

    bodies = some.mapInArrow(sets, "print bigint, grams array<bigint>")
    together = members.join(bodies.hint("shuffle_hash") if chosen is None else bodies, "print").select("leader", "print", "side", "copies", "grams")
    found = together.repartition("leader").sortWithinPartitions("leader").mapInArrow(_exact(threshold), _FOUND)
    if groups is None:
        return documents, found.groupBy("kind", "a", "b").agg(F.first("value").alias("value"))
    found = checkpoint(found)
    pairs, groups = found.where("kind = 0").groupBy("kind", "a", "b").agg(F.first("value").alias("value")), _small(groups, broadcast)
    same = pairs.join(groups.select(F.col("print").alias("a"), F.col("root").alias("x")), "a", "left").join(groups.select(F.col("print").alias("b"), F.col("root").alias("y")), "b", "left")
    return documents, same.where("x is null or y is null or x <> y").select("kind", "a", "b", "value").unionByName(found.where("kind > 0"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (u, v) of every node but the components' least, which is v."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        # large star, then small star: every node points at the least that it or its neighbours know
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").unionByName(least.select("u", F.col("low").alias("v"))).distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges
        before = now


def _classes(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Each set that has several documents or is in a pair: print, class_id, n_links (those of one of its documents)."""
    found = checkpoint(found)
    release(found.sparkSession)
    pairs = found.where("kind = 0").select("a", "b")
    sizes = documents.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("print").alias("b"), "size"), "b").select(F.col("a").alias("print"), "size")
    others = others.unionByName(found.where("kind = 2").select(F.col("a").alias("print"), F.col("value").cast("bigint").alias("size")))
    others = others.groupBy("print").agg(F.sum("size").alias("others"))
    pairs = found.where("kind < 2").select("a", "b")
    root = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("print"), F.col("v").alias("root"))
    each = sizes.join(others, "print", "left").where("size > 1 or others is not null").join(root, "print", "left")
    each = checkpoint(each.select("print", F.coalesce("root", "print").alias("root"), "least", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    least = each.groupBy("root").agg(F.min("least").alias("class_id"))
    return each.join(least, "root").select("print", "class_id", "n_links")


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, common: int = COMMON, broadcast: int = BROADCAST, most: int = LIST, dense: int = DENSE) -> DataFrame:
    """(doc_id, class_id, n_links) of every document."""
    documents, found_ = _joined(docs, n, threshold, common, broadcast, most, dense)
    classes = checkpoint(_classes(documents, found_))
    if classes.count() <= broadcast:
        classes = F.broadcast(classes)
    own = F.when(F.col("class_id").isNull() & F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id"))
    found = documents.join(classes, "print", "left").select(F.col("id").alias("doc_id"), own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    # a word is a letter, a digit or a character that isn't ASCII
    rest = _narrow(docs).where(F.col("text").isNull() | ~F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    rest = rest.select("doc_id").distinct()
    return found.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


#: All pairs of documents that share an n-gram, and what links connect.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE k >= 0.5 * (p.n + q.n - k) - 1e-9),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM n UNION SELECT e.x, r.root FROM r JOIN e ON e.y = r.x WHERE r.root < e.x),
m AS (SELECT x, min(root) AS class_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN m ON m.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""

_KEY = "__plumbline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of their own for each row: the doc_id, or where that is null or there several times, a hash with the text, above usual ids.

    Of rows that repeat a doc_id and a text only one stays.
    """
    ids = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd"))
    if ids.isEmpty():
        return docs.withColumn(_KEY, F.col("doc_id").cast("bigint"))
    ids = checkpoint(ids)
    same = lambda: docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("i._odd")), "left_semi")
    plain = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("i._odd")), "left_anti")
    odd = same().withColumn(_KEY, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3))
    once = odd.where("text is not null").dropDuplicates(["doc_id", "text"])
    return plain.withColumn(_KEY, F.col("doc_id").cast("bigint")).unionByName(once).unionByName(odd.where("text is null"))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, common: int = COMMON) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all columns of docs.

    Rows that share a doc_id, or have none, are documents of their own that come after all others; of rows with equal
    doc_id and text one stays. Rows with a null text or without words stay.
    """
    keyed = _keyed(docs)
    links = linked(keyed.select(F.col(_KEY).alias("doc_id"), "text"), n, threshold, common)
    return without(keyed, links.where("doc_id <> class_id").select("doc_id"), _KEY).drop(_KEY)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
