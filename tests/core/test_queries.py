"""Queries against their SQL, and metrics against brute force."""

import math

import pytest

from plumbline.operators import evaluate
from plumbline.plans.queries import ORACLES, QUERIES

FAST = ["word_count", "sentences", "dim_lexical_markers", "dim_redundancy", "dim_parallelism", "score_rules", "evidence", "suggestions", "html_prose", "json_strings", "class_quota", "first_of_each", "composition", "suppressed", "calibration", "promotion_gate", "rule_metadata"]


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(same, name):
    assert len(same(QUERIES[name], ORACLES[name]))


def test_metrics(spark):
    rows = [(1, 90.0, False), (0, 80.0, False), (1, 70.0, True), (1, 70.0, False), (0, 70.0, False), (0, 10.0, True), (None, 5.0, False), (1, None, True)]
    df = spark.createDataFrame(rows, "label int, score double, abstained boolean")
    known = [r for r in rows if None not in r]
    pairs = [(p, n) for y, p, _ in known if y == 1 for z, n, _ in known if z == 0]
    assert math.isclose(evaluate.auroc(df).first()[0], round(sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs), 6))
    assert math.isclose(evaluate.brier(df).first()[0], round(sum((p / 100 - y) ** 2 for y, p, _ in known) / len(known), 6), abs_tol=1e-6)
    assert evaluate.tpr_at_fpr(df).first().tpr_at_01 == round(1 / 3, 6)
    assert evaluate.risk_coverage(df).first().coverage == round(4 / 6, 6)
    assert evaluate.auroc(df.where("label = 1")).first()[0] is None


def test_span_match(spark):
    s = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([(0, 4), (0, 4), (9, 12)], [(0, 4), (10, 12)]), ([], []), ([], [(1, 2)])], f"pred {s}, gold {s}")
    assert [(r.matched, r.precision, r.recall) for r in evaluate.span_match(df).collect()] == [(1, 1 / 3, 0.5), (0, 1.0, 1.0), (0, 0.0, 0.0)]
    assert evaluate.span_match(df, 0.6).first().matched == 2


def test_every_rule_is_in_the_planted_sentences():
    import re

    from plumbline.plans.planted import SNIPPETS
    from plumbline.rules import LEXICON, REWRITES, RULES

    texts = [re.sub("[ \t]+", " ", s.replace("\r\n", "\n")) for s in SNIPPETS]
    rules = [*RULES, *(r.rule for r in REWRITES)]
    assert not [r.rule_id for r in rules if not any(re.search(r.regex, t, re.I | re.M) for t in texts)]
    assert all(any(re.search(rf"\b{t}\b", x, re.I) for x in texts for t in c.terms) for c in LEXICON)
