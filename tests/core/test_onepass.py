"""The one pass runs few expressions, holds small batches, and queries make it once."""

import math
import random
import re

import pyarrow as pa
import pytest

from plumbline.functions import features, onepass
from plumbline.functions.gates import required
from plumbline.operators import evaluate
from plumbline.plans.planted import SNIPPETS, planted
from plumbline.plans.queries import QUERIES
from plumbline.rules import REWRITES, RULES
from plumbline.settings import DIMENSIONS, Settings

SMALL = "/root/testdata/sf0.001"
TEXTS = [re.sub("[ \t]+", " ", s.replace("\r\n", "\n")) for s in SNIPPETS]


def test_every_match_holds_its_words():
    known = 0
    for rule in (*RULES, *(r.rule for r in REWRITES)):
        sets = required(rule.regex)
        known += bool(sets)
        for t in TEXTS:
            if re.search(rule.regex, t, re.I | re.M):
                words = set(re.findall(r"\w+", t.lower()))
                assert all(s & words for s in sets), (rule.rule_id, sets)
    assert known >= len(RULES) + len(REWRITES) - 3


@pytest.mark.parametrize(
    ("regex", "sets"),
    [
        (r"\b(?:cat|dog)s? (?:a )?\w+\b", [{"cat", "cats", "dog", "dogs"}]),
        (r"cat", []),  # may stand within a word
        (r"(?a)\bcat\b", []),  # other words than the text's
        (r"\bcat\b[^.]{1,9}?\b(?:red|blue)\b", [{"cat"}, {"red", "blue"}]),
        (r"\b(?:cat)?\b", []),
        (r"\bcat(?!s)\b", []),
        (r"\bcat\s+not[,;]", [{"cat"}]),
        (r"(?:\bcat\b|\d)", []),
    ],
)
def test_required_words(regex, sets):
    assert [set(s) for s in required(regex)] == sets


class Counted:
    def __init__(self, pattern):
        self.pattern, self.wrapped, self.n = pattern.pattern, pattern, 0

    def findall(self, *a):
        self.n += 1
        return self.wrapped.findall(*a)


def test_rules_run_only_on_texts_with_their_words():
    """"in", "not", "as a", "to" are in most texts; the rules with them need rarer words."""
    scanner = onepass.Scanner(Settings())
    scanner.packs = {d: [(Counted(p), *rest) for p, *rest in rules] for d, rules in scanner.packs.items()}
    plain = ["She went in to see the man, as a cat would, and did not stay. The ship let it go to sea in that hour."] * 50
    scanner.values([*plain, TEXTS[0]], [23] * 50 + [16], DIMENSIONS)
    calls = {p.pattern: p.n for rules in scanner.packs.values() for p, *_ in rules}
    assert sum(calls.values()) < 200, calls


def test_places_and_values_come_from_one_pass():
    rng = random.Random(3)
    bits = [*TEXTS, "", "é", "K", "ſ", "İ", "Kept", "reſearch shows", "the first", "one of the", "a little", "$5,000", "1999İ", "ΟΔΟΣ.Α", "movement, innovation, and development", "—", "“", ".", "\n"]
    texts = ["", *(" ".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300))]
    words = [len(t.split()) for t in texts]
    entries = onepass.catalogue(Settings())
    both, alone, values = ([[] for _ in texts] for _ in range(3))
    a = onepass.Scanner(Settings(), entries).values(texts, words, DIMENSIONS, both)
    b = onepass.Scanner(Settings()).values(texts, words, DIMENSIONS)
    onepass.Scanner(Settings(), entries).values(texts, words, (), alone)
    assert both == alone and all((a[d] == b[d]).all() for d in DIMENSIONS)
    for t, found in zip(texts, both):  # each expression by itself, over the whole text
        for i, e in enumerate(entries):
            if r := e["rule"].regex:
                low, anchors = t.lower(), e["rule"].anchors
                want = [m.span() for m in re.finditer(r, t, re.I | re.M)] if not anchors or any(x in low for x in anchors) else []
                assert [(s, x) for s, x, k, *_ in found if k == i] == want, (e["rule_id"], t)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(onepass, "MOST_WORDS", 50)
    scanner, plain = onepass.Scanner(Settings()), onepass.Scanner(Settings())
    for k in range(0, len(TEXTS), 2):
        some = TEXTS[k : k + 2]
        one = scanner.values(some, [20] * len(some), DIMENSIONS)
        monkeypatch.setattr(onepass, "MOST_WORDS", 1 << 18)
        other = plain.values(some, [20] * len(some), DIMENSIONS)
        monkeypatch.setattr(onepass, "MOST_WORDS", 50)
        assert all((one[d] == other[d]).all() for d in DIMENSIONS)
    assert scanner.remembered.words.size < plain.remembered.words.size


def test_arrow_batches_are_bounded(spark):
    QUERIES["report_json"](spark, SMALL)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(onepass.BATCH_BYTES)


def passes(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ArrowEvalPython")


@pytest.mark.parametrize("name", ["brier", "ece", "pr_auc", "risk_coverage", "report_html", "report_json", "report_markdown", "score_ml"])
def test_texts_are_passed_over_once(spark, name):
    assert passes(QUERIES[name](spark, SMALL)) == 1


def test_tasks_grow_in_number_with_the_input(spark):
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # as if there were many splits
        assert planted(spark, SMALL).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_only_documents_with_a_label_are_scored(spark):
    plan = QUERIES["brier"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")  # the join is below it


def test_both_scorers_share_their_dimensions(spark, monkeypatch):
    calls, usual = [], features.dimensions
    monkeypatch.setattr(features, "dimensions", lambda *a, **k: calls.append(1) or usual(*a, **k))
    QUERIES["promotion_gate"](spark, SMALL)
    assert len(calls) == 1


def test_new_findings_reads_what_it_found_once(spark):
    assert passes(QUERIES["new_findings"](spark, SMALL)) == 0  # they are stored


@pytest.mark.parametrize("top", [1.0, 100.0])
def test_calibration_metrics_in_both_scales(spark, top):
    rng = random.Random(int(top))
    rows = [(rng.randrange(2), rng.randrange(1001) / 1000 * top) for _ in range(200)] + [(1, None), (None, 0.5 * top), (0, 0.0), (1, top)]
    df = spark.createDataFrame(rows, "label int, score double")
    known = [(y, s / top) for y, s in rows if y is not None and s is not None]
    assert math.isclose(evaluate.brier(df).first()[0], sum((s - y) ** 2 for y, s in known) / len(known), abs_tol=1e-6)
    bins = {}
    for y, s in [(y, None if s is None else s / top) for y, s in rows if y is not None]:
        bins.setdefault(9 if s is None else min(int(s * 10 // 1), 9), []).append((y, s))
    total = 0.0
    for each in bins.values():
        p = [s for _, s in each if s is not None]
        total += len(p) * abs(sum(p) / len(p) - sum(y for y, _ in each) / len(each))
    assert math.isclose(evaluate.ece(df).first()[0], total / len(known), abs_tol=1e-6)


def test_an_empty_batch():
    assert onepass._placed([]).to_pylist() == [] and pa.types.is_list(onepass._placed([[]]).type)
