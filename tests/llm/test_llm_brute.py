"""Operators against brute force, exact round trips, SQL or held-out labels."""

import gzip
import io
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from plumbline.llm import ann, bpe, hmm, langid, ngram_join, quality, queries, secrets, templates, warc, winnow
from plumbline.llm.common import span_hashes, table, word_hashes

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_word_hashes_ignore_where_a_word_is():
    text = b"alpha beta alpha " * 50
    h, s, e = word_hashes(np.frombuffer(text, np.uint8), chunk=64)
    assert [text[a:b] for a, b in zip(s, e)] == text.split() and len(set(h.tolist())) == 2


def test_hmm_counts_are_those_of_all_paths():
    m = hmm.Model.first(np.arange(5, dtype=np.uint64), np.arange(21.0), 3)
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 21, n) for n in (4, 1, 3, 5)]
    fresh = np.concatenate([np.arange(len(q)) == 0 for q in seqs])
    lanes = hmm.Lanes(np.concatenate(seqs), fresh)
    start, move, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((21, 3)), []
    for q in seqs:
        paths = {}
        for z in itertools.product(range(3), repeat=len(q)):
            p = m.start[z[0]] * m.emit[q[0], z[0]]
            for i in range(1, len(q)):
                p *= m.move[z[i - 1], z[i]] * m.emit[q[i], z[i]]
            paths[z] = p
        total = sum(paths.values())
        logs.append(np.log(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for i in range(len(q)):
                emit[q[i], z[i]] += p / total
                if i:
                    move[z[i - 1], z[i]] += p / total
    for got, want in zip(lanes.expected(m, 21), (start, move, emit)):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
    scale = lanes.forward(m)[2][lanes.where]
    assert np.allclose(np.add.reduceat(np.log(scale), np.flatnonzero(fresh)), logs, rtol=1e-12)


def test_hmm_rounds_raise_the_likelihood(spark):
    docs = table(spark, SMALL, "documents")
    words, counts = hmm.vocabulary(docs, 500)
    e = hmm.encoded(docs, words).cache()
    model, seen = hmm.Model.first(words, counts, 4), []
    for _ in range(4):
        seen.append(hmm.score(e, model).selectExpr("sum(log_likelihood)").first()[0])
        model = hmm.round_of(e, model)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    vocab = defaultdict(int)
    for r in docs.collect():
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower()):
            vocab[w] += 1
    top = sorted(vocab.values(), reverse=True)[:500]
    assert sorted(counts[hmm.UNKNOWN :].tolist(), reverse=True) == top


def test_hmm_trains_until_more_rounds_gain_little(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    words = hmm.kept_vocabulary(docs, f"file://{tmp_path}")
    e = hmm.encoded(docs, words).cache()
    log = lambda m: hmm.score(e, m).selectExpr("sum(log_likelihood)").first()[0]
    model = hmm.train(e, hmm.sampled(docs, words))
    end, n = log(model), e.selectExpr("sum(size(symbols))").first()[0]
    counts = words.rows(np.arange(words.offsets[-1]), "counts", np.float64)
    table_ = hmm.Model(np.zeros(0), np.ones(1), np.ones((1, 1)), counts / counts.sum())
    assert (end - log(table_)) / n > 0.3  # far from a table of words' frequencies
    assert log(hmm.round_of(e, model)) - end <= 2 * hmm.TOLERANCE * abs(end)


def test_hmm_keeps_every_word_that_occurs_twice(spark, tmp_path):
    twice = [f"w{i}" for i in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(twice)), (2, " ".join(twice[::-1])), (3, "once w7 w39999")], "doc_id long, text string")
    words = hmm.kept_vocabulary(docs, f"file://{tmp_path}")
    assert words.offsets[-1] == 40_000 + hmm.UNKNOWN
    e = {r["doc_id"]: [-1 - s if s < 0 else s for s in r["symbols"]] for r in hmm.encoded(docs, words).collect()}
    assert e[1] == e[2][::-1] and len(set(e[1])) == 40_000 and min(e[1]) >= hmm.UNKNOWN
    assert e[3] == [3, e[1][7], e[1][39_999]]


def test_hmm_tables_give_the_next_model_of_arrays(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    words = hmm.kept_vocabulary(docs, f"file://{tmp_path}")
    e = hmm.encoded(docs, words).cache()
    kept, every = hmm.sampled(docs, words, 3, 5000), np.arange(words.offsets[-1])
    (a, x), (b, y) = hmm.step(e, kept), hmm.step(e, kept.local(every))
    assert np.allclose(a.start, b.start) and np.allclose(a.move, b.move) and np.allclose(a.local(every).emit, b.emit, rtol=1e-5) and np.isclose(x, y)


def test_hmm_small_gains_that_grow_are_no_end():
    assert not hmm.converged([-1000.0, -999.99, -999.97]) and hmm.converged([-1000.0, -999.97, -999.96])
    assert not hmm.converged([-1000.0, -900.0, -890.0]) and not hmm.converged([-1000.0, -1000.0])


def test_closing_tags_are_found_at_any_depth():
    page = lambda n: "<body><article>" + "<p>x" * n + "</article><footer>end</footer></body>"
    roles = [templates.Reader().tokens(pa.array([page(n)]))[2][-5:].tolist() for n in (2, 31, 32, 400)]
    assert all(r == roles[0] for r in roles)


def test_bpe_is_the_tokenizers_own():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(bpe.TOKENIZER)
    other.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["aaaa" * 40, "<|endoftext|> x", "  ", "a  ", "   x \t\n y", "it'll 's'S", "½ ² 12", "日本語 🤖"]
    texts += ["".join(rng.choice("abtheinor ' \n.é1") for _ in range(rng.randrange(1, 90))) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 700), 0x3042, 32, 10, 0x1F600])) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    auto, ids = bpe.load()
    encoder = bpe.Encoder(auto, ids)
    labels, counts = encoder.labels(pa.array(texts))
    got = np.split(ids[labels], np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert auto.decode(labels) == "".join(texts).encode()


def test_bpe_pieces_are_those_of_the_expression():
    rng = random.Random(11)
    signs = ["'", "'s", "'ll", "'re", "'v", " ", "  ", "\n", "\u00a0", "\u3000", "a", "ll", "é", "5", "²", "-", "\x00", "日", "🤖", "\u0301", "\x1c"]
    texts = ["", "'", " '", "'s", "'l", *("".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(6000)), "x'", "s", "'", "re", " ", "a"]
    data, lens, sizes = bpe.pieces(texts)
    want = [regex.findall(bpe.PRE_SPLIT, t) for t in texts]
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(w) for w in want]
    assert lens.tolist() == [len(p.encode()) for w in want for p in w]
    assert [x.tolist() for x in bpe.pieces([])] == [[], [], []]


def test_bpe_spells_a_word_once_and_minds_equal_hashes(monkeypatch):
    auto, ids = bpe.load()
    spelled = []
    monkeypatch.setattr(bpe.Automaton, "spell", lambda self, data, lens, own=bpe.Automaton.spell: spelled.append(len(lens)) or own(self, data, lens))
    parts = [pa.array([" ".join(f"w{k:x}" for k in range(i, i + 60_000))]) for i in range(0, 240_000, 60_000)]
    encoder = bpe.Encoder(auto, ids)
    first = [encoder.labels(p)[0] for p in parts]
    once = sum(spelled)
    assert all(np.array_equal(a, encoder.labels(p)[0]) for a, p in zip(first, parts)) and sum(spelled) == once
    text = pa.array(["one two three", "", None, "two" + "x" * 99, "'tis 3"])
    labels, counts = bpe.Encoder(auto, ids).labels(text)
    data, ends = np.frombuffer(b"the cat the  the", np.uint8), np.array([3, 7, 11, 12, 12, 16])
    assert np.array_equal(span_hashes(data, ends), span_hashes(data, ends, 1)) and len(set(span_hashes(data, ends).tolist())) == 5
    monkeypatch.setattr(bpe, "span_hashes", lambda buf, ends: np.zeros(len(ends), np.uint64))
    encoder = bpe.Encoder(auto, ids)
    for _ in range(2):
        again, n = encoder.labels(text)
        assert np.array_equal(again, labels) and np.array_equal(n, counts)
    assert auto.decode(again) == "".join(x or "" for x in text.to_pylist()).encode()


def merged(merges, word):
    out = [bytes([x]) for x in word]
    for u, v in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == u and out[i + 1] == v:
                out[i : i + 2] = [u + v]
            i += 1
    return out


def test_bpe_automaton_of_small_lists():
    rng = random.Random(5)
    for _ in range(60):
        text, merges = bytes(rng.choice(b"abc") for _ in range(400)), []
        while len(merges) < 12:
            now = merged(merges, text)
            u, v = rng.choice(list(zip(now, now[1:])))
            if u + v not in {x + y for x, y in merges}:
                merges.append((u, v))
        try:
            auto = bpe.Automaton([b"a", b"b", b"c"], merges)
        except ValueError:
            assert any(merged(merges, u + v) != [u + v] for u, v in merges)
            continue
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + [b"abcab" * 20, b"a" * 99]
        flat, counts = auto.encode(words)
        for w, part in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
            assert [auto.bytes[t] for t in part] == merged(merges, w)


def test_secrets_are_those_of_re():
    auto = secrets.automaton()
    rng = random.Random(1)
    bits = ['token = "', "a" * 20, '"', "AKIA" + "A1" * 8, "ghp_" + "x" * 36, " ", "\n", "é", "xoxb-123456789-" + "q" * 15, "npm_", "z" * 36, "https://u:p@", "eyJ" + "a" * 12, ".", "-----BEGIN RSA PRIVATE KEY-----", "-", "=", "sk_live_" + "9" * 30]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(800)] + ["x" * 70_000 + " AKIA" + "B" * 16 + " "]
    parts = [t.encode() for t in texts]
    buf = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    starts = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
    got = dict(secrets.findings(auto, buf, starts))
    for i, p in enumerate(parts):
        want = sorted((m.start(), m.end(), k) for k, (_, rule) in enumerate(secrets.RULES) for m in re.finditer(rule.encode(), p))
        assert got.get(i, []) == want, texts[i]


def test_lanes_give_what_one_pass_gives():
    auto = secrets.automaton()
    rng = np.random.default_rng(0)
    buf = rng.choice(np.frombuffer(b'token="AKI ' + b"abcdef0123456789", np.uint8), 60_000)
    buf[20_000:20_400] = np.frombuffer(b' token="' + b"a" * 391 + b'"', np.uint8)
    one, many = auto.run(buf, 1), auto.run(buf, 200, 16)
    assert np.array_equal(one[0], many[0]) and np.array_equal(one[1], many[1]) and len(one[0])


def test_language_filters(spark):
    docs = table(spark, SMALL, "documents")
    f = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), f).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 40").collect()
    assert np.mean([r["lang"] == r["lang_found"] for r in rows]) > 0.97
    # exact sets: hits of the filter are at least theirs, and the correction brings the share near
    text = pa.array([r["text"] for r in docs.where("lang = 'en'").limit(20).collect()])
    h, owner = langid.grams(text)
    sets = {"x": np.unique(h[::3]), "y": np.unique(h[1::7])}
    small = langid.Filters.of(sets, bits=14)
    share, total = small.shares(text)
    for i, name in enumerate(small.languages):
        exact = np.bincount(owner, np.isin(h, sets[name]), minlength=len(text)) / total
        assert np.abs(share[:, i] - exact).max() < 0.08 and small.false[i] > 0


def test_long_shared_spans_are_all_found():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(60)] for _ in range(2))
        n = rng.randrange(8, 20)
        i, j = rng.randrange(60 - n), rng.randrange(60 - n)
        b[j : j + n] = a[i : i + n]
        h, bounds = winnow.words(pa.array([" ".join(a), " ".join(b)]))
        x, y = h[: bounds[1]], h[bounds[1] :]
        p, at = winnow.fingerprints(x, np.array([0, 60]))
        q, to = winnow.fingerprints(y, np.array([0, 60]))
        hits = np.array([(u, v) for u, f in zip(at, p) for v, g in zip(to, q) if f == g]).reshape(-1, 2)
        got = set(winnow.spans(x, y, hits, winnow.K, 8))
        want = {(s, t, m) for s in range(60) for t in range(60) if not (s and t and a[s - 1] == b[t - 1]) for m in [next((k for k in range(60 - max(s, t)) if a[s + k] != b[t + k]), 60 - max(s, t))] if m >= 8}
        assert got == want and any(s <= i and s - t == i - j for s, t, _ in got)


def brute_pairs(rows, n=3, threshold=0.5):
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) for i, t in rows if i is not None and t}
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) for i, w in words.items() if w}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    out = {(tuple(sorted(v)), 1.0) for v in classes.values() if len(v) > 1}
    for (a, x), (b, y) in itertools.combinations([(min(v), k) for k, v in classes.items()], 2):
        both = len(a & b) if isinstance(a, frozenset) else len(x & y)
        if both and both / (len(x) + len(y) - both) >= threshold:
            out.add((tuple(sorted((a, b))), both / (len(x) + len(y) - both)))
    return out


def test_tree_join_prunes_nothing_that_counts():
    rng = np.random.default_rng(1)
    for t in (0.3, 0.5, 0.8, 1.0):
        base = rng.choice(200, 40, replace=False).astype(np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 40), replace=False), rng.integers(0, 300, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(60)] + [base, base]
        got = {(min(i, j), max(i, j), n) for i, j, n in ngram_join.tree_join(sets, t)}
        want = {(i, j, n) for i, j in itertools.combinations(range(len(sets)), 2) for n in [len(np.intersect1d(sets[i], sets[j]))] if n >= t * (len(sets[i]) + len(sets[j]) - n) - 1e-9}
        assert got == want


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    x, y = quality.sample(docs, labels)
    trees = quality.boosted(x[::2], y[::2])
    score = trees.score(x[1::2])
    good, bad = score[y[1::2] > 0], score[y[1::2] == 0]
    assert (good[:, None] > bad).mean() > 0.95 and (good >= quality.LEAST_SCORE).mean() > 0.98
    one = [trees.start + sum(_leaf(f, t, v, row) for f, t, v in zip(trees.feature, trees.threshold, trees.leaf)) for row in x[:40]]
    assert np.allclose(one, trees.margin(x[:40]))


def _leaf(feature, threshold, leaf, row):
    at = 0
    while at < len(feature):
        at = 2 * at + (1 if row[feature[at]] <= threshold[at] else 2)
    return leaf[at - len(feature)]


def test_statistics_cover_whole_texts():
    names = list(quality.FEATURES)
    a = quality.statistics(pa.array(["One two. Two!\nOne two. Two!", "x" * 50 + " " + "Y" * 50]))
    assert np.isclose(a[0][names.index("distinct_lines")], 0.5) and np.isclose(a[0][names.index("distinct_words")], 3 / 6)
    assert np.isclose(a[1][names.index("share_upper")], 50 / 101) and np.isclose(a[1][names.index("longest_word")], np.log1p(50))


def test_warc_files_of_others():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"payload " * 40_000
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raw = info + head % (b"response", 1, len(body)) + body + b"\r\n\r\n" + head % (b"request", 2, 5) + b"GET /" + b"\r\n\r\n"
    packed = io.BytesIO(gzip.compress(raw[:200]) + gzip.compress(raw[200:]))
    rows = list(warc.chunks(gzip.GzipFile(fileobj=packed), 100_000))
    assert b"".join(r[3] for r in rows) == b"payload " * 40_000 and [r[1] for r in rows] == [0, 1, 2, 3] and {r[0] for r in rows} == {"urn:x:1"}
    whole = [(r[1], r[3], r[4], r[7]) for r in rows]
    cut = list(warc.chunks(io.BytesIO(raw[:5000])))
    assert [r[6:] for r in cut] == [(False, "the file ends within a record")] and cut[0][3] == (b"payload " * 700)[: len(cut[0][3])] and cut[0][5]
    # what is broken is told, and the records behind it are read
    for broken in (b"no warc\r\n", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nlost\r\n", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\n" + b"y" * (2 << 20) + b"\r\n"):
        first, *rest = list(warc.chunks(io.BytesIO(broken + raw), 100_000))
        assert first[5:7] == (True, False) and first[7] and [(r[1], r[3], r[4], r[7]) for r in rest] == whole
    assert list(warc.chunks(io.BytesIO(b""))) == [] and [r[7] is not None for r in warc.chunks(io.BytesIO(b"WARC/1.0\r\nWARC-Ty"))] == [True]
    torn = gzip.compress(raw * 3)[:-400]
    assert list(warc.chunks(gzip.GzipFile(fileobj=io.BytesIO(torn)), 100_000))[-1][7]


def test_warc_reads_no_more_than_a_block():
    class Source(io.RawIOBase):
        most = sent = 0

        def read(self, n=-1):
            assert 0 < n <= 256 << 10
            piece = (HEAD if not self.sent else b"")[:n] or b"z" * min(n, self.left)
            self.left = (SIZE if not self.sent else self.left - len(piece))
            self.sent += len(piece)
            return piece

    SIZE = 50 << 20
    HEAD = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\n" % SIZE
    total = 0
    for row in warc.chunks(Source(), 64 << 10):
        assert len(row[3]) <= 64 << 10
        total += len(row[3])
    assert total == SIZE


def test_templates_find_lists_and_slots(spark):
    rng = random.Random(1)
    pages, want = [], []
    for i in range(60):
        items = [f"item{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 5))]
        title, body = f"t{rng.randrange(10**6)}", " ".join(f"b{rng.randrange(10**6)}" for _ in range(5))
        html = f"<html><head><title>{title}</title><script>var x = '<b>{i}</b>'</script></head><body><ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in items) + f"</ul><div class='main'><p>{body}</p></div><footer>all rights reserved</footer></body></html>"
        pages.append((i, f"https://www.site.example:80/{i}?q", html))
        want += [(i, 0, title), (i, 0, body), *[(i, k, x) for k, x in enumerate(items)]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for size in (templates.BLOCK_BYTES, 2000):
        got = templates.extract(df, templates.templates(df, block_bytes=size)).collect()
        assert sorted((r["page_id"], r["occurrence"], r["text"]) for r in got) == sorted(want)
    assert len({r["slot"] for r in got}) == 3


@pytest.mark.parametrize("clusters", [0, 12])
def test_neighbours(spark, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    if clusters:
        x = x * 0.1 + rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 1200)].astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(v, 10).collect():
        got[r["vec_id"]].append((r["rank"], r["neighbour_id"], r["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert all(len(got[i]) == 10 for i in range(1200))
    assert np.mean([len({n for _, n, _ in got[i]} & set(near[i].tolist())) / 10 for i in range(1200)]) >= 0.9
    assert all(np.isclose(dist, d[i, n], atol=1e-3) for i in range(50) for _, n, dist in got[i])


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    books = ann.Books([x[:16], (0.5 * rng.normal(size=(16, 8))).astype(np.float32), (0.25 * rng.normal(size=(16, 8))).astype(np.float32)])
    codes, norms = books.encode(x, 4)
    back = sum(b[codes[:, i]] for i, b in enumerate(books.books))
    assert ((x - back) ** 2).sum() <= (books.greedy(x) ** 2).sum() and np.allclose((back**2).sum(1), norms, atol=1e-3)
    est = ann.estimates(books.tables(x[:5]), codes.astype(np.int64), norms)
    assert np.allclose(est + (x[:5] ** 2).sum(1)[:, None], ((x[:5, None] - back) ** 2).sum(2), atol=1e-2)
