"""HTML extraction by equivalence classes of tokens across a host's pages.

A page is tags and words. A token's role is the token within its path of open tags; a tag counts by its name,
class and id, a comment, script or style as one token. A closing tag closes the last open one of its name, however deep;
p, li, dt, dd, option, tr, td and th end where the next one of their name begins beside them. The occurrence vector of
a role says how often it is in each of the host's pages; roles with equal vectors (equal 64-bit sums of hashed pages and
counts) form a class. A role takes part if it is in at least SUPPORT of its host's pages. Roles that are once in every
page make the root class, without those that change places with another one in some page. Another class counts if at
least LEAST_SIZE roles have its vector, and a tag is among them or half of the pages hold them (words alone that fewer
pages share are copied text), and is valid if in every page its roles come as whole repetitions in one order,
nested in the others: neither a root token nor a part of another class lies across it. Root and valid classes, in the
order of their roles' mean first place, are the host's template. What remains of a page's words between two template
tokens is a slot.

A host's pages are brought together in blocks of about BLOCK_BYTES by a hash, so that a host of any size is spread over
tasks. A role with the support in the whole host has it in one of its blocks; of hosts with several blocks, the roles
that have it in one are counted again in all pages, task by task, for vectors are sums: only then is the support
asked, of all hosts alike. Templates
are joined to pages by host, broadcast if they are few enough; else Spark splits the partitions of large hosts.

Result: (page_id, slot, occurrence, text): slot is the place in the template of the token before it, -1 for
none, occurrence counts the slot's repetitions in the page from 0; empty slots give no row. Pages of hosts with
fewer than LEAST_PAGES pages, or without a host (a null url, too), have all their words in slot -1. A null or
empty html gives no row; a null page_id is kept. Repeated rows count as pages of their own. Tokens of malformed markup are read as far
as they go: a "<" that is never closed is text. A page of any length or depth is read whole. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, blocks, bounded, checkpoint, joined, mix, table, word_hashes
from .ngram_join import _cuts, _runs

LEAST_PAGES, LEAST_SIZE, SUPPORT, BLOCK_BYTES = 4, 2, 0.2, 4 << 20
#: Roles of all templates together (some 40 bytes each) up to which they are broadcast to the pages; beyond, both are shuffled by host.
BROADCAST_ROLES = 1_000_000
#: Hosts up to which their page counts are broadcast to the pages.
BROADCAST_HOSTS = 1_000_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SCHEMA = "page_id bigint, slot int, occurrence int, text string"
_TAG = re.compile(rb"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[!/?]?[A-Za-z][^<>]*>", re.S | re.I)
_NAME = re.compile(rb"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_KEPT = re.compile(rb"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ENDS_ITSELF = frozenset(b"p li dt dd option tr td th".split())
_VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())


def _hash(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Reader:
    """Turns blocks of pages into tokens, and remembers the tags it has met."""

    def __init__(self) -> None:
        self.tags: dict[bytes, tuple[int, bytes | None, bool]] = {}
        self.paths: dict[tuple[int, bytes], int] = {}

    def tag(self, raw: bytes) -> tuple[int, bytes | None, bool]:
        """Hash, name of an element that opens or closes (or None), and whether it closes."""
        found = self.tags.get(raw)
        if found is None:
            m = _NAME.match(raw)
            if raw.startswith(b"<!--") or not m:
                found = (_hash(b"<!--" if raw.startswith(b"<!--") else b"<!"), None, False)
            else:
                name = m[2].lower()
                whole = name in (b"script", b"style") and not m[1]
                found = (_hash(b"<" + m[1] + name + b" ".join(sorted(_KEPT.findall(raw[: raw.find(b">") + 1])))), None if whole or name in _VOID or raw.endswith(b"/>") else name, bool(m[1]))
            if len(self.tags) > 100_000:
                self.tags.clear()
            self.tags[raw] = found
        return found

    def path(self, above: int, name: bytes) -> int:
        key = (above, name)
        found = self.paths.get(key)
        if found is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            found = self.paths[key] = (above * 0x9E3779B97F4A7C15 + _hash(name)) & 0xFFFFFFFFFFFFFFFF
        return found

    def tokens(self, html: pa.Array) -> tuple[np.ndarray, ...]:
        """buf; and of each token, in order: page, role, start, end, and whether it is a word."""
        buf, starts = joined(html)
        data = buf.tobytes()
        at, to, roles, after = [], [], [], []
        for p in range(len(html)):
            stack: list[tuple[bytes, int]] = [(b"", 1)]
            depth: dict[bytes, int] = {}  # how many elements of a name are open
            at.append(starts[p])  # an empty tag, that words at the page's start have their path
            to.append(starts[p])
            roles.append(0)
            after.append(1)
            for m in _TAG.finditer(data, starts[p], starts[p + 1] - 1):
                h, name, closes = self.tag(m[0])
                above = stack[-1][1]
                if name is not None:
                    if not closes:
                        if stack[-1][0] == name and name in _ENDS_ITSELF:
                            stack.pop()
                            depth[name] -= 1
                            above = stack[-1][1]
                        stack.append((name, self.path(above, name)))
                        depth[name] = depth.get(name, 0) + 1
                    elif depth.get(name):
                        while stack[-1][0] != name:
                            depth[stack.pop()[0]] -= 1
                        stack.pop()
                        depth[name] -= 1
                        above = stack[-1][1]
                at.append(m.start())
                to.append(m.end())
                roles.append((h + above) & 0xFFFFFFFFFFFFFFFF)
                after.append(stack[-1][1])
        at, to = np.array(at, np.int64), np.array(to, np.int64)
        inside = np.zeros(len(buf) + 1, np.int32)
        np.add.at(inside, at, 1)
        np.add.at(inside, to, -1)
        masked = np.where(np.cumsum(inside[:-1]) > 0, np.uint8(32), buf)
        h, s, e = word_hashes(masked, SOLID)
        path = np.array(after, np.uint64)[np.searchsorted(to, s, side="right") - 1] if len(s) else np.zeros(0, np.uint64)
        real = to > at
        role = np.r_[mix(np.array(roles, np.uint64)[real]) | np.uint64(1), mix(h + mix(path)) & ~np.uint64(1)]  # odd: a tag
        start, end = np.r_[at[real], s], np.r_[to[real], e]
        word = np.r_[np.zeros(int(real.sum()), bool), np.ones(len(s), bool)]
        order = np.argsort(start, kind="stable")
        start = start[order]
        return buf, np.searchsorted(starts, start, side="right") - 1, role[order], start, end[order], word[order]


def _sums(support: float):
    """Sorted (blk, host, html, page_key, split) to the roles with the support in each block: (host, role, vector, pages, total, first, split)."""

    def run(batches):
        reader = Reader()
        for t in _runs(batches):
            key = t.column("blk").to_numpy()
            cuts = _cuts(key)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = t.slice(lo, hi - lo).combine_chunks()
                _, page, role, start, _, _ = reader.tokens(part.column("html").combine_chunks())
                if not len(role):
                    continue
                keys = part.column("page_key").to_numpy().view(np.uint64)
                place = np.arange(len(page)) - np.searchsorted(page, page)
                order = np.lexsort((page, role))
                r, p = role[order], page[order]
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
                n = np.diff(np.r_[first, len(r)])
                r, p, place = r[first], p[first], np.minimum.reduceat(place[order], first)
                own = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                pages = np.diff(np.r_[own, len(r)])
                vector = np.add.reduceat(mix(keys[p] + n.astype(np.uint64)), own)
                total, place = np.add.reduceat(n, own), np.add.reduceat(place, own)
                keep = pages >= support * (hi - lo)
                host = part.column("host")[0]
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.repeat(host, k), pa.array(r[own][keep].view(np.int64)), pa.array(vector[keep].view(np.int64)), pa.array(pages[keep]), pa.array(total[keep]), pa.array(place[keep]), pa.repeat(part.column("split")[0], k)], ["host", "role", "vector", "pages", "total", "first", "split"])

    return run


def _recounted(batches):
    """Pages with some roles of their host to the sums of these roles over all pages of the task: (host, role, vector, pages, total, first)."""
    reader, found, size = Reader(), {}, 0

    def told():
        for host, (roles, sums) in found.items():
            some = sums[1] > 0
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(host), int(some.sum())), *[pa.array(x[some].view(np.int64)) for x in (roles, *sums)]], ["host", "role", "vector", "pages", "total", "first"])

    for part, html in blocks(batches, "html"):
        _, page, role, _, _, _ = reader.tokens(html)
        ends = np.searchsorted(page, np.arange(part.num_rows + 1))
        keys, hosts = part.column(3).to_numpy().view(np.uint64), part.column(0)
        for i in range(part.num_rows):
            host = hosts[i].as_py()
            if host not in found:
                if size > 1_000_000:
                    yield from told()
                    found, size = {}, 0
                roles = np.sort(part.column(2)[i].values.to_numpy().view(np.uint64))
                found[host] = (roles, [np.zeros(len(roles), np.uint64) for _ in range(4)])
                size += len(roles)
            known, (vector, pages, total, first) = found[host]
            r = role[ends[i] : ends[i + 1]]
            at = np.minimum(np.searchsorted(known, r), len(known) - 1)
            place = np.flatnonzero(known[at] == r)
            own, begin, n = np.unique(at[place], return_index=True, return_counts=True)
            vector[own] += mix(keys[i] + n.astype(np.uint64))
            pages[own] += np.uint64(1)
            total[own] += n.astype(np.uint64)
            first[own] += place[begin].astype(np.uint64)
    yield from told()


def _broken(batches):
    """(host, class, index) of the classes that aren't whole, ordered and nested in some page (index -1), and of the root's roles that change places."""
    reader, told = Reader(), set()
    for part, html in blocks(batches, "html"):
        _, page, role, _, _, _ = reader.tokens(html)
        ends = np.searchsorted(page, np.arange(part.num_rows + 1))
        hosts, out, last = part.column(0), [], None
        for i in range(part.num_rows):
            host = hosts[i].as_py()
            if host != last:
                roles = part.column(2)[i].values.to_numpy().view(np.uint64)
                classes, index, size = (part.column(c)[i].values.to_numpy().tolist() for c in (3, 4, 5))
                order = np.argsort(roles)
                known, last = roles[order], host
            r = role[ends[i] : ends[i + 1]]
            at = np.minimum(np.searchsorted(known, r), len(known) - 1)
            open_: list[list[int]] = []
            bad: set[int] = set()
            met = order[at[known[at] == r]]
            places = np.array(index)[met[np.array(classes)[met] == 0]] if len(met) else met
            moved = places[(np.maximum.accumulate(places) > places) | (np.minimum.accumulate(places[::-1])[::-1] < places)].tolist()
            for j in met.tolist():
                c, k = classes[j], index[j]
                if c == 0:
                    bad.update(x[0] for x in open_)
                    open_ = []
                elif c in bad:
                    continue
                elif k == 0:
                    if any(x[0] == c for x in open_):
                        bad.add(c)
                        open_ = [x for x in open_ if x[0] != c]
                    elif size[j] > 1:
                        open_.append([c, 1])
                elif open_ and open_[-1] == [c, k]:
                    open_[-1][1] += 1
                    if k + 1 == size[j]:
                        open_.pop()
                else:
                    bad.add(c)
                    open_ = [x for x in open_ if x[0] != c]
            bad.update(x[0] for x in open_)
            new = {*((host, c, -1) for c in bad), *((host, 0, k) for k in moved)} - told
            out += new
            told |= new
            if len(told) > 1_000_000:
                told.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32()))], ["host", "class", "index"])


def _slots(batches):
    reader = Reader()
    for part, html in blocks(batches, "html"):
        buf, page, role, start, end, word = reader.tokens(html)
        n = part.num_rows
        ends = np.searchsorted(page, np.arange(n + 1))
        slot = np.full(len(role), -2)
        last = object()
        hosts = part.column(0)
        for i in range(n):
            if not part.column(3)[i].is_valid:
                continue
            host = hosts[i].as_py()
            if host != last:
                roles = part.column(3)[i].values.to_numpy().view(np.uint64)
                order, last = np.argsort(roles), host
                known = roles[order]
            r = role[ends[i] : ends[i + 1]]
            at = np.minimum(np.searchsorted(known, r), len(known) - 1)
            slot[ends[i] : ends[i + 1]] = np.where(known[at] == r, order[at], -2)
        fresh = np.r_[True, page[1:] != page[:-1]] if len(page) else np.zeros(0, bool)
        mark = fresh | (slot >= 0)  # a slot begins at a page's first token or at a template token
        number = np.cumsum(mark) - 1
        begun = np.flatnonzero(mark)
        named = np.maximum(slot[begun], -1)
        w = np.flatnonzero(word & (slot < 0))
        if not len(w):
            continue
        s = number[w]
        cut = _cuts(s)
        first = s[cut[:-1]]
        own = page[begun[first]]
        # repetitions: how many times the slot's token was in the page before
        key = page[begun].astype(np.int64) << 32 | (named + 1)
        by = np.argsort(key, kind="stable")
        runs = np.r_[True, key[by][1:] != key[by][:-1]]
        before = np.empty(len(key), np.int64)
        before[by] = np.arange(len(key)) - np.maximum.accumulate(np.where(runs, np.arange(len(key)), 0))
        data = buf.tobytes()
        texts, a, b = [], start[w].tolist(), end[w].tolist()
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            texts.append(b" ".join([data[a[k] : b[k]] for k in range(x, y)]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(own)), pa.array(named[first].astype(np.int32)), pa.array(before[first].astype(np.int32)), pa.array(texts)], ["page_id", "slot", "occurrence", "text"])


def _narrow(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.col("url").cast("string"), HOST, 1)
    return bounded(pages).select(F.lower(F.when(host != "", host)).alias("host"), F.col("html").cast("string").alias("html"), F.col("page_id").cast("bigint").alias("page_id")).where("html is not null and html <> ''")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT, least_size: int = LEAST_SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each host with a template: host, and its roles, their classes, places in the class and class sizes, in the template's order."""
    rows = _narrow(pages).where("host is not null")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.ceil(F.sum(F.octet_length("html")) / block_bytes).cast("bigint").alias("split")).where(F.col("n") >= least_pages)
    hosts = checkpoint(hosts)
    few = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    placed = rows.join(few.select("host", "split"), "host").withColumn("page_key", F.xxhash64("page_id", "html"))
    placed = placed.select(F.xxhash64("host", F.pmod("page_key", "split")).alias("blk"), "host", "html", "page_key", "split").repartition("blk").sortWithinPartitions("blk")
    sums = checkpoint(placed.mapInArrow(_sums(support), "host string, role bigint, vector bigint, pages bigint, total bigint, first bigint, split bigint"))
    again = sums.where("split > 1").groupBy("host").agg(F.collect_set("role").alias("roles"))
    again = rows.withColumn("page_key", F.xxhash64("page_id", "html")).join(_sent(checkpoint(again)), "host").select("host", "html", "roles", "page_key")
    sums = sums.where("split = 1").drop("split").unionByName(again.mapInArrow(_recounted, "host string, role bigint, vector bigint, pages bigint, total bigint, first bigint"))
    # sums of 64-bit hashes wrap around; Spark's would overflow, so the halves are added
    half = lambda shift: F.sum(F.shiftrightunsigned("vector", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    roles = sums.groupBy("host", "role").agg(half(32).alias("high"), half(0).alias("low"), *[F.sum(c).alias(c) for c in ("pages", "total", "first")])
    roles = roles.join(few.select("host", "n"), "host").where(F.col("pages") >= F.lit(support) * F.col("n"))
    # halves carry over: two sums of one vector have to be equal whatever the blocks
    roles = roles.withColumn("high", F.pmod(F.col("high") + F.shiftright("low", 32), F.lit(1 << 32))).withColumn("low", F.pmod("low", F.lit(1 << 32)))
    root = (F.col("pages") == F.col("n")) & (F.col("total") == F.col("n"))
    one = F.struct((F.col("first") / F.col("pages")).alias("at"), "role")
    classes = roles.groupBy("host", "n", root.alias("root"), "high", "low", "pages", "total").agg(F.array_sort(F.collect_list(one)).alias("roles"))
    layout = (2 * F.col("pages") >= F.col("n")) | F.exists("roles", lambda r: r["role"].bitwiseAND(F.lit(1)) == 1)
    classes = classes.where(F.col("root") | (F.size("roles") >= least_size) & layout)
    listed = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((~F.col("root")).alias("other"), F.col("roles")[0]["at"].alias("at"), F.col("roles")[0]["role"].alias("role"), "roles"))).alias("classes"))
    flat = listed.select("host", F.posexplode("classes").alias("no", "c"))
    # class 0 is the root; where no role is once in every page, there is none
    flat = flat.select("host", F.when(F.col("c.other"), F.col("no") + 1).otherwise(0).alias("class"), F.size("c.roles").alias("size"), F.posexplode("c.roles").alias("index", "r"))
    candidates = checkpoint(_arranged(flat.select("host", "class", "size", "index", F.col("r.at").alias("at"), F.col("r.role").alias("role"))))
    bad = rows.join(_sent(candidates), "host").select("host", "html", "roles", "classes", "indexes", "sizes").mapInArrow(_broken, "host string, class int, index int").distinct()
    kept = candidates.select("host", F.explode(F.arrays_zip("roles", "classes", "indexes", "sizes", "ats")).alias("r"))
    kept = kept.select("host", F.col("r.classes").alias("class"), F.col("r.sizes").alias("size"), F.col("r.indexes").alias("index"), F.col("r.ats").alias("at"), F.col("r.roles").alias("role"))
    gone = (F.col("k.host") == F.col("b.host")) & (F.col("k.class") == F.col("b.class")) & ((F.col("b.index") < 0) | (F.col("b.index") == F.col("k.index")))
    return _arranged(kept.alias("k").join(bad.alias("b"), gone, "left_anti"))


def _sent(found: DataFrame) -> DataFrame:
    size = found.agg(F.sum(F.size("roles"))).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_ROLES else found


def _arranged(roles: DataFrame) -> DataFrame:
    """Rows (host, class, size, index, at, role) as one row of arrays for each host."""
    r = roles.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "role", "class", "index", "size"))).alias("r"))
    return r.select("host", *[F.col(f"r.{c}").alias(name) for c, name in (("role", "roles"), ("class", "classes"), ("index", "indexes"), ("size", "sizes"), ("at", "ats"))])


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The slots of pages (page_id, url, html), by these templates or by their own."""
    found = checkpoint((templates(pages) if found is None else found).select("host", "roles"))
    return _narrow(pages).join(_sent(found), "host", "left").select("host", "html", "page_id", "roles").mapInArrow(_slots, SCHEMA)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
