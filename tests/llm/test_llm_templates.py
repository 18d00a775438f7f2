"""Template deduction against a naive one, and what it has to reject."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import templates


def deduced(pages, support=templates.SUPPORT):
    """(page_id, slot text) of one host's pages, with lists and dictionaries: tokens and their roles are the reader's."""
    read = []
    for _, html in pages:
        buf, _, role, start, end, word = templates.Reader().tokens(pa.array([html]))
        data = buf.tobytes()
        read.append([(r, data[s:e].decode() if w else None) for r, s, e, w in zip(role.view(np.int64).tolist(), start.tolist(), end.tolist(), word.tolist())])
    n, vector, first = len(pages), defaultdict(lambda: [0] * len(pages)), defaultdict(list)
    for p, tokens in enumerate(read):
        for i, (r, _) in enumerate(tokens):
            if not vector[r][p]:
                first[r].append(i)
            vector[r][p] += 1
    classes = defaultdict(list)
    for r, v in vector.items():
        if sum(map(bool, v)) >= support * n:
            classes[tuple(v)].append((sum(first[r]) / len(first[r]), r))
    root = [r for _, r in sorted(classes.pop((1,) * n, []))]
    others = [[r for _, r in sorted(c)] for v, c in classes.items() if len(c) >= 2 and (2 * sum(map(bool, v)) >= n or any(r & 1 for _, r in c))]

    def crossed(tokens, c):
        """Whether the class isn't whole repetitions in one order, or something lies across it, in one page."""
        places = [(i, c.index(r)) for i, (r, _) in enumerate(tokens) if r in c]
        if [k for _, k in places] != list(range(len(c))) * (len(places) // len(c)):
            return True
        for j in range(0, len(places), len(c)):
            inside = [r for i, (r, _) in enumerate(tokens) if places[j][0] < i < places[j + len(c) - 1][0]]
            if any(r in root for r in inside):
                return True
        return False

    moved = set()
    for tokens in read:
        order = [root.index(r) for r, _ in tokens if r in root]
        moved |= {root[a] for i, a in enumerate(order) for b in order[i + 1 :] if a > b} | {root[b] for i, a in enumerate(order) for b in order[i + 1 :] if a > b}
    known = {r for c in others if not any(crossed(t, c) for t in read) for r in c} | set(root) - moved
    out = []
    for (page, _), tokens in zip(pages, read):
        words: list[str] = []
        for r, w in [*tokens, (None, None)]:
            if r is None or r in known:
                if words:
                    out.append((page, " ".join(words)))
                words = []
            elif w is not None:
                words.append(w)
    return sorted(out)


def run(spark, pages, **options):
    df = spark.createDataFrame([(i, f"http://x.example/{i}", h) for i, h in pages], "page_id bigint, url string, html string").repartition(3)
    return sorted((r["page_id"], r["text"]) for r in templates.extract(df, templates.templates(df, **options)).collect())


def made_up(rng):
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    nav, foot, label = [f"<a href='/{x}'>{x}</a>" for x in (name() for _ in range(3))], name(), name()
    pages = []
    for i in range(rng.randrange(4, 14)):
        body = "".join(f"<p>{' '.join(f'{name()}{rng.randrange(10**6)}' for _ in range(rng.randrange(1, 6)))}" + "</p>" * rng.randrange(2) for _ in range(rng.randrange(1, 4)))
        rows = "".join(f"<div class=row>{label} <b>v{rng.randrange(10**6)}</b> unit</div>" for _ in range(rng.randrange(5)))
        pages.append((i, f"<html><body><nav>{''.join(nav)}</nav><h1>t{rng.randrange(10**6)}</h1>{body}{rows}<footer>{foot} all rights</footer></body></html>"))
    return pages


@pytest.mark.parametrize("seed", range(4))
def test_naive_deduction(spark, seed):
    pages = made_up(random.Random(seed))
    assert run(spark, pages, block_bytes=600 if seed % 2 else templates.BLOCK_BYTES) == deduced(pages)


def test_a_class_that_is_crossed_is_left_as_data(spark):
    """r s come together, but in some pages a root token or another class's part lies between them."""
    fine = lambda i: "<body>top" + f" r x{i} s" * (i % 3) + " mid end</body>"
    pages = [(i, fine(i)) for i in range(12)]
    assert run(spark, pages) == deduced(pages) == sorted((i, f"x{i}") for i in range(12) for _ in range(i % 3))
    broken = [*pages[:-1], (11, "<body>top r x11 mid s r x11 s end</body>")]
    got = run(spark, broken)
    assert got == deduced(broken) and (1, "r x1 s") in got and (11, "r x11") in got
    # two classes with vectors of their own: u v starts within r s and ends behind it
    woven = [(i, "<body>top" + " r s" * (i % 3) + " u v" * (i % 4) + " end</body>") for i in range(11)] + [(11, "<body>top r u s v r s u v u v end</body>")]
    got = run(spark, woven)
    assert (1, "r s") in got and (2, "r s r s") in got and not any("u" in t.split() for i, t in got if i < 11)


def test_root_tokens_that_change_places_are_data(spark):
    pages = [(i, "<body>top " + ("p q" if i % 2 else "q p") + " end</body>") for i in range(6)]
    assert run(spark, pages) == deduced(pages) == [(i, "p q" if i % 2 else "q p") for i in range(6)]


def test_three_layouts_of_a_host(spark):
    """Each is on a third of the pages; on a host of many blocks as on one of a single block."""
    kinds = ["<div class=a><b>price</b> {0} <i>stock</i></div>", "<div class=b><u>author</u> {0} <s>date</s></div>", "<div class=c><em>size</em> {0} <q>end</q></div>"]
    pages = [(i, f"<body>{kinds[i % 3].format(f'x{i}')}</body>") for i in range(90)]
    for size in (templates.BLOCK_BYTES, 500):
        assert run(spark, pages, block_bytes=size) == [(i, f"x{i}") for i in range(90)]


def test_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "word" + "</div>" * 3000
    pages = [(i, f"<body>{deep}<footer>foot {'w%d ' % i * (20_000 if i == 3 else 2)}</footer></body>") for i in range(5)]
    got = dict(run(spark, pages))
    assert sorted(got) == list(range(5)) and len(got[3].split()) == 20_000 and "foot" not in got[1]
