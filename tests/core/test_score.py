"""Scores, findings, suppression and offsets on inline texts."""

import math

import pytest

from plumbline.functions.features import adjacent_similarity, prepare
from plumbline.functions.scoring import score
from plumbline.operators.evidence import findings
from plumbline.plans.planted import SNIPPETS
from plumbline.rules import ALL_IDS, LEXICON, RULES
from plumbline.settings import DIMENSIONS, Settings, resolve

SLOP = " ".join(s for s in (*SNIPPETS[:3], *SNIPPETS[4:6], SNIPPETS[10], SNIPPETS[-1])) * 2
CLEAN = "The crew laid 14 beams on 3 May 1998 near Ghent. Anna Weber wrote it down, and Paul Krause held the lamp for 2 hours. " * 6


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "In today's fast-paced digital landscape, our platform empowers synergy."), (1, None), (2, ""), (3, SLOP), (4, CLEAN), (5, "x" * 100_000), (6, "😀 As an AI language model,  I\tdelve.\r\nIt is robust."), (6, CLEAN)]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, label string").drop("label")


def test_catalogue():
    assert len(RULES) == 63
    assert sum(len(c.terms) for c in LEXICON) == 83
    assert len(ALL_IDS) == len(set(ALL_IDS)) == 72


def test_scores(docs):
    rows = score(docs).select("doc_id", "slop_score", "label", "abstained", "w", *DIMENSIONS).collect()
    by = {r.doc_id: r for r in rows if r.doc_id < 6}
    assert by[0].slop_score == 93.2 and by[0].label == "mild" and by[0].abstained
    assert by[1].w == by[2].w == 0 and by[1].abstained and by[1].slop_score == by[2].slop_score
    assert by[3].slop_score >= 75 and not by[3].abstained and by[3].label == "severe"
    assert by[4].slop_score < 50 and by[4].lexical_markers == 0
    assert len(rows) == 8 and all(0 <= r[d] <= 1 for r in rows for d in DIMENSIONS)


def test_settings_change_what_they_say(docs):
    one = docs.where("doc_id = 3")
    get = lambda s: score(one, s).first().slop_score
    assert get(Settings(strictness="sensitive")) >= get(Settings())
    off = score(one, Settings(disabled_dimensions=frozenset({"prompt_residue"}))).first()
    assert off.prompt_residue == 0
    with pytest.raises(ValueError):
        resolve({"strictness": "none"})
    with pytest.raises(ValueError):
        resolve({}, {"disabled_rules": "ONE"})


def test_spans_are_those_of_the_original(docs):
    prepared = prepare(docs)
    originals = {r.doc_id: r.original for r in prepared.where("doc_id in (3, 6)").select("doc_id", "original").collect()}
    found = findings(prepared.where("doc_id in (3, 6)")).collect()
    assert {"RESIDUE_AS_AN_AI", "LEXICAL_OVERPOLISHED_VERBS"} <= {r.rule_id for r in found}
    for r in found:
        if originals[r.doc_id][:2] in ("😀 ", originals[3][:2]):
            assert originals[r.doc_id][r.start_char : r.end_char] == r.span


def _rules_found(spark, text, **kw):
    return [r.rule_id for r in findings(prepare(spark.createDataFrame([(0, text)], "doc_id long, text string")), Settings(**kw)).collect()]


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("At its core, yes. <!-- plumbline-disable-line FORMULAIC_AT_ITS_CORE -->", 0),
        ("<!-- plumbline-disable-next-line -->\nAt its core, yes.\nAt its core, no.", 1),
        ("<!-- plumbline-disable formulaic_structure -->\nAt its core.\n<!-- plumbline-enable -->\nAt its core.", 1),
        ("At its core.\n<!-- plumbline-disable-file -->\nAt its core.", 1),
        ("<!-- plumbline-disable OTHER -->\nAt its core.", 1),
    ],
)
def test_suppression(spark, text, count):
    assert _rules_found(spark, text).count("FORMULAIC_AT_ITS_CORE") == count


def test_cited_claims_pass(spark):
    assert "CLAIM_AUTHORITY_NO_CITATION" in _rules_found(spark, "The research shows that it works well.")
    assert "CLAIM_AUTHORITY_NO_CITATION" not in _rules_found(spark, "The research shows gains (2019).")


def test_similarity_against_plain_arithmetic():
    a, b = adjacent_similarity(["red cat", "red cat", "dog"])
    assert math.isclose(a, 1.0) and b == 0.0
    assert adjacent_similarity(["!", "?"]) == [0]


def test_one_pass_is_what_the_columns_say(spark):
    """Every dimension by the one pass over batches and by its own expression, on planted texts and odd ones."""
    from pyspark.sql import functions as F

    from plumbline.functions import features
    from plumbline.plans.planted import planted

    odd = ["", None, "...", "A, not b.", "été, Élan vital; Über alles. ", "x—y—z, “q” ‘r’", "One. One. Two? Two!", "the ship, the crew, and the innovation, movement and development", "See 12.5, 1999 and $4 at http://x.y/z. Dr. Who said: Paris is, Of course"]
    extra = spark.createDataFrame([(10_000 + i, t, "en", "x") for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string")
    docs = planted(spark, "/root/testdata/sf0.001").unionByName(extra)
    for settings in (Settings(), Settings(profile="academic", repair=False)):
        prepared = features.prepare(docs, settings)
        want = {r.doc_id: r for r in prepared.select("doc_id", *(F.coalesce(features.registry()[d](settings), F.lit(0.0)).alias(d) for d in DIMENSIONS)).collect()}
        for r in features.dimensions(prepared, settings).select("doc_id", *DIMENSIONS).collect():
            for d in DIMENSIONS:
                assert math.isclose(r[d], want[r.doc_id][d], rel_tol=1e-9, abs_tol=1e-9), (r.doc_id, d, r[d], want[r.doc_id][d])


def test_a_registered_dimension_replaces_the_usual_one(spark, docs):
    from pyspark.sql import functions as F

    from plumbline.functions import features

    usual = features.registry()["genericity"]
    try:
        features.register("genericity")(lambda settings: F.lit(0.25))
        assert {r.genericity for r in score(docs).select("genericity").collect()} == {0.25}
    finally:
        features.register("genericity")(usual)
