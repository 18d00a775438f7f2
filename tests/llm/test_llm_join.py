"""The n-gram Jaccard join against all pairs."""

import random

import pytest

from plumbline.llm import ngram_join
from plumbline.llm.common import table

from ..conftest import SMALL
from .test_llm_brute import brute_pairs


def brute_links(rows):
    """(doc_id, class_id, n_links) from all pairs; doc_ids are distinct."""
    near, ids = brute_pairs(rows), [i for i, _ in rows]
    copies = {i: {i} for i in ids}
    for group, jaccard in near:
        if jaccard == 1.0:
            copies |= {i: set(group) for i in group}
    links = {i: copies[i] - {i} for i in ids}
    for group, jaccard in near:
        if jaccard < 1.0:
            for x, y in (group, group[::-1]):
                for i in copies[x]:
                    links[i] |= copies[y]
    name = {}
    for i in sorted(ids):
        todo = [i] if i not in name else []
        while todo:
            if (x := todo.pop()) not in name:
                name[x] = i
                todo += links[x]
    return {(i, name[i], len(links[i])) for i in ids}


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("broadcast, most", [(ngram_join.BROADCAST, ngram_join.LIST), (10, 3)])
def test_links_and_classes(spark, broadcast, most):
    docs = table(spark, SMALL, "documents")
    want = brute_links([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(ngram_join.linked(docs, broadcast=broadcast, most=most)) == want and any(n for _, _, n in want)


def families():
    rng, rows = random.Random(4), []
    for size in (3, 6, 30, 80):
        for _ in range(3):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for _ in range(25):
                w = list(base)
                for _ in range(rng.randrange(0, 1 + size // 8)):
                    w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
                rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("most", [ngram_join.LIST, 4])
def test_families(spark, most):
    """Many variants of few texts, short ones among them: all links, and one document of each class."""
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_links(rows)
    assert got(ngram_join.linked(docs, most=most)) == want
    assert sorted(r["doc_id"] for r in ngram_join.deduplicate(docs).collect()) == sorted({name for _, name, _ in want})


def test_pairs_have_their_similarity(spark):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    documents, pairs = ngram_join.members_and_pairs(docs, most=8)
    least = {}
    for r in documents.collect():
        least[r["print"]] = min(r["id"], least.get(r["print"], r["id"]))
    found = {(tuple(sorted((least[r["a"]], least[r["b"]]))), r["jaccard"]) for r in pairs.collect()}
    assert found == {x for x in brute_pairs(rows) if x[1] < 1.0}


def test_one_n_gram_in_thousands_of_sets(spark):
    """Short texts that share a line: the list of its n-gram is cut into blocks, and no link is lost."""
    rows = [(i, f"all rights reserved w{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    result = ngram_join.linked(docs, threshold=0.3, most=100)
    # two texts have the first of two n-grams in common: 1/3 of the three that there are
    assert got(result) == {(i, 0, 2999) for i in range(3000)}


def test_repeated_ids_and_rows_without_one(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "of none but this row alone"
    rows = [(7, a, 0), (7, a, 0), (7, b, 0), (8, b, 0), (None, a, 0), (None, a, 0), (None, c, 0), (None, None, 0), (None, None, 0), (9, c, 0), (10, "!", 0), (10, "!", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, print int")
    rows = sorted((tuple(r) for r in ngram_join.linked(docs).collect()), key=repr)
    assert rows == sorted([(7, 7, 1), (None, 7, 1), (7, 7, 1), (8, 7, 1), (None, 9, 1), (9, 9, 1), (None, None, 0), (10, 10, 0)], key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.deduplicate(docs).collect()), key=repr)
    # 8 is the only plain one with b, 9 with c; a's rows have no plain one, one stays
    assert [x for x in kept if x[1] in (b, c)] == [(8, b), (9, c)]
    assert len([x for x in kept if x[1] == a]) == 1 and len([x for x in kept if x[1] is None]) == 2 and len([x for x in kept if x[1] == "!"]) == 1


@pytest.mark.parametrize("dense, block, most", [(4, 8, ngram_join.LIST), (4, 8, 16), (20, 2048, 4)])
def test_links_of_dense_groups_are_counted_by_blocks(spark, monkeypatch, dense, block, most):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = families()
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[::7])]  # copies count as links
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(ngram_join.linked(docs, most=most, dense=dense)) == brute_links(rows)


def test_rows_of_a_dense_group_do_not_grow_with_its_links(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"v{i}", *base[i % 50 :]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(ngram_join.linked(docs)) == {(i, 0, 299) for i in range(300)}
    _, found = ngram_join._joined(docs, ngram_join.N, 0.5, ngram_join.COMMON, ngram_join.BROADCAST, ngram_join.LIST, ngram_join.DENSE)
    assert found.count() <= 600  # of 44850 pairs
