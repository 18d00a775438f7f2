"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, hmm, langid, ngram_join, quality, secrets, templates, warc, winnow

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, print bigint, gram bigint, _gone bigint, tokens int, share string"
LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", None, None),
    (3, None, "en", "a"),
    (4, "", "fr", None),
    (5, " \n\t ", "fr", None),
    (None, "A row without a name has words as well, has it not?", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "x" * 300_000, "en", "b"),
    (8, "日本語 и русский ß ñ   🤖", "xx", "b"),
    (9, 'token = "0123456789abcdef0123"', "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1, 2, 3, 4, "z") for r in ROWS], SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_hmm(docs, none):
    def scores(d):
        words, counts = hmm.vocabulary(d)
        e = hmm.encoded(d, words)
        return hmm.score(e, hmm.train(e, hmm.Model.first(words, counts), 1))

    rows = scores(docs).collect()
    assert ids(scores(docs)) == ALL and scores(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    for k in (3, 4, 5):
        assert (by[k]["n_words"], by[k]["log_likelihood"], by[k]["perplexity"]) == (0, 0, None)
    assert by[6]["n_words"] == 200_000 and by[6]["log_likelihood"] < 0
    assert by[1]["log_likelihood"] == by[2]["log_likelihood"]


def test_bpe(docs, none):
    rows = bpe.encode(docs).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL and all(r["round_trip"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["tokens"] is None and by[3]["n_tokens"] == 0 and by[4]["tokens"] == []
    assert bpe.encode(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r[0]: r[1] for r in ROWS}


def test_secrets(docs, none):
    assert [(r["doc_id"], r["rule"], r["start_char"]) for r in secrets.scan(docs).collect()] == [(9, "assigned_token", 0)]
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    out = secrets.redact(docs)
    assert out.columns == docs.columns and ids(out) == ALL
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[9]["text"] == "<assigned_token>" and by[9]["n_chars"] == 16 and by[3]["text"] is None and by[6]["text"] == LONG


def test_langid(docs, none):
    f = langid.fit(docs)
    rows = {r["doc_id"]: r for r in langid.identify(docs, f).collect()}
    assert rows[1]["lang_found"] == "en" and rows[3]["lang_found"] is None and rows[4]["share"] == 0
    kept = langid.keep(docs, f)
    assert kept.columns == docs.columns and not {3, 4, 5} & set(ids(kept)) and {1, 2, 6, None} <= set(ids(kept))
    empty = langid.fit(none)
    assert empty.languages == [] and langid.identify(none, empty).count() == 0
    assert {r["lang_found"] for r in langid.identify(docs, empty).collect()} == {None}


def test_winnow(spark, docs, none):
    bench = spark.createDataFrame([(1, ROWS[0][1], 1), (1, ROWS[0][1], 1), (2, None, 1), (3, "", 1), (None, ROWS[0][1], 1), (4, "lorem ipsum dolor sit amet", 1), (5, "lorem ipsum dolor sit amet lorem ipsum dolor", 1)], "item_id bigint, text string, doc_id bigint")
    for words in (winnow.BROADCAST_WORDS, 0):
        got = winnow.contaminated(docs, bench, broadcast_words=words).collect()
        found = {tuple(r)[:2] for r in got}
        assert found == {(1, 1), (2, 1), (6, 5)}
        assert {tuple(r) for r in got if r["item_id"] == 1} == {(1, 1, 0, 0, 12), (2, 1, 0, 0, 12)}
        assert winnow.contaminated(none, bench, broadcast_words=words).count() == winnow.contaminated(docs, bench.limit(0), broadcast_words=words).count() == 0
    for words in (winnow.BROADCAST_WORDS, 0):
        kept = winnow.drop(docs, bench, broadcast_words=words)
        assert kept.columns == docs.columns and ids(kept) == [3, 4, 5, 7, 8, 9, None]
        # a row without a name goes like any other
        named = spark.createDataFrame([(1, ROWS[6][1])], "item_id bigint, text string")
        assert ids(winnow.drop(docs, named, broadcast_words=words)) == [x for x in ALL if x is not None]
        assert winnow.drop(none, bench, broadcast_words=words).count() == 0


def test_ngram_join(docs, none):
    got = sorted((tuple(r) for r in ngram_join.linked(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), *[(i, i, 0) for i in (3, 4, 5, 6, 7, 8, 9)], (None, None, 0)], key=repr)
    assert ngram_join.linked(none).count() == 0
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns and ids(kept) == sorted({x for x in ALL if x not in (1, None)}) + [None]
    assert ngram_join.deduplicate(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id bigint, quality int, text int")
    trees = quality.boosted(*quality.sample(docs, labels))
    rows = quality.classify(docs, trees).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none, quality.boosted(*quality.sample(none, labels))).count() == 0
    assert all(r["keep"] for r in quality.classify(docs, quality.boosted(*quality.sample(docs, labels.limit(0)))).collect())


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "é" * 50_000, 0), (1, None, "twice", 0), (2, "u", None, 0), (None, "v", "", 0)], "page_id bigint, url string, html string, chunk int").coalesce(1)
    rows = warc.read(spark, warc.write(pages, f"file://{tmp_path}/w"), 30_000).collect()
    assert [(r["record_id"], r["chunk_no"], len(r["chunk"]), r["last"], r["valid"]) for r in rows] == [
        ("urn:pages:1", 0, 30_000, False, None), ("urn:pages:1", 1, 30_000, False, None), ("urn:pages:1", 2, 30_000, False, None), ("urn:pages:1", 3, 10_000, True, True),
        ("urn:pages:1", 0, 5, True, True), ("urn:pages:2", 0, 0, True, True), ("urn:pages:null", 0, 0, True, True),
    ]
    assert warc.read(spark, warc.write(pages.limit(0), f"file://{tmp_path}/n")).count() == 0


def test_templates(spark):
    page = "<html><body><h1>{0}</h1><div class='x'>menu {1}</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"title{i}", "a b" if i % 2 else ""), 1) for i in range(6)]
    rows += [(7, "http://h.example/7", None, 1), (8, None, "<p>no host", 1), (9, "http://h.example/9", "", 1), (None, "http://other.example/", "<p>alone < here <b", 1), (0, rows[0][1], rows[0][2], 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, slot int")
    got = sorted(((r["page_id"], r["text"], r["occurrence"]) for r in templates.extract(pages).collect()), key=repr)
    want = [(i, f"title{i}", 0) for i in range(6)] + [(i, "a b", 0) for i in (1, 3, 5)] + [(0, "title0", 0), (8, "no host", 0), (None, "alone < here <b", 0)]
    assert got == sorted(want, key=repr)
    assert templates.extract(pages.limit(0)).count() == 0


def test_ann(spark):
    rows = [(i, [float(i), 0.0], 1) for i in range(20)] + [(3, [3.0, 0.0], 1), (50, None, 1), (51, [1.0], 1), (52, [None, 1.0], 1), (None, [1.0, 1.0], 1), (53, [float("nan"), 0.0], 1), (54, [], 1)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in ann.neighbours(v, 3).collect()}
    assert len(got) == 60 and got[0, 1] == (1, 1.0) and got[5, 1] == (4, 1.0) and got[5, 2] == (6, 1.0)
    assert ann.neighbours(v.limit(0)).count() == 0
    assert ann.neighbours(v.where("vec_id = 1")).count() == 0
    assert ann.neighbours(v.where(F.col("vec_id").isin(1, 2))).count() == 2
