"""Command line, API, rule files, language, profiles, authorship and reports."""

import json
import subprocess

import pandas as pd
import pytest

from plumbline import cli
from plumbline.api import Scanner, scan_text
from plumbline.functions.features import prepare
from plumbline.functions.scoring import score
from plumbline.operators import authorship, batch, calibrate, evidence
from plumbline.rules import load_rules
from plumbline.settings import DIMENSIONS, Settings
from plumbline.sinks import reports

from .test_score import CLEAN, SLOP

SPANISH = "El equipo midió las vigas en la obra y no se fue hasta que las notas de los trabajadores estaban en la caja. " * 8


@pytest.fixture
def folder(tmp_path, spark, monkeypatch):
    (tmp_path / "a.txt").write_text(SLOP)
    (tmp_path / "b.md").write_text("# Title\n\n" + CLEAN + "\n\n" + CLEAN)
    (tmp_path / "c.mdx").write_text(SLOP)
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_exit_codes(folder, capsys):
    assert cli.main(["scan", "a.txt"]) == 0
    out = capsys.readouterr().out
    assert "severe" in out and "prompt_residue" in out and "RESIDUE_AS_AN_AI" in out and " more" in out
    assert cli.main(["scan", "a.txt", "--fail-on", "high"]) == 1 and cli.main(["scan", "b.md", "--fail-on", "high"]) == 0
    assert cli.main(["scan", "nothing.txt"]) == 2 and cli.main(["scan", "a.txt", "--config", "none.toml"]) == 2
    (folder / "bad.json").write_text(json.dumps({"rules": [{"rule_id": "X", "dimension": "none", "severity": "low", "regex": "x"}]}))
    assert cli.main(["scan", "a.txt", "--rules", "bad.json"]) == 2 and cli.main(["explain"]) == 0
    pd.DataFrame({"x": [1]}).to_parquet(folder / "wrong.parquet")
    assert cli.main(["scan", "a.txt", "--baseline-file", "wrong.parquet", "--fail-on-new"]) == 2
    assert cli.main(["scan", "a.txt", "--calibration", "wrong.parquet"]) == 2


def test_batch_and_paragraphs(folder, capsys):
    capsys.readouterr()
    assert cli.main(["scan", ".", "--format", "json"]) == 0
    d = json.loads(capsys.readouterr().out)
    assert d["n_files"] == 2 and sum(d["by_label"].values()) == 2 and d["worst"][0]["source"].endswith("a.txt")  # .mdx isn't prose
    assert cli.main(["scan", "b.md", "--by-paragraph"]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) >= 2


def test_baseline_and_profile(folder, capsys):
    assert cli.main(["baseline", "a.txt", "--output", "base.parquet"]) == 0
    assert cli.main(["scan", "a.txt", "--baseline-file", "base.parquet", "--fail-on-new"]) == 0
    (folder / "a.txt").write_text(SLOP + " Furthermore, it plays a vital role.")
    assert cli.main(["scan", "a.txt", "--baseline-file", "base.parquet", "--fail-on-new"]) == 1
    assert cli.main(["calibrate", "b.md", "--output", "own.parquet"]) == 0
    capsys.readouterr()
    assert cli.main(["scan", "a.txt", "--calibration", "own.parquet", "--format", "json"]) == 0
    found = json.loads(capsys.readouterr().out)["deviations"]
    assert len(found) == 5 and [abs(x["z"]) for x in found] == sorted((abs(x["z"]) for x in found), reverse=True) and abs(found[0]["z"]) == 3.0


def test_changed_files(folder):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=folder, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    assert cli.main(["scan", ".", "--diff", "nonsense"]) == 2
    (folder / "b.md").write_text(SLOP)
    from plumbline.sources.readers import changed

    assert [p.rsplit("/", 1)[-1] for p in changed([str(folder)], "HEAD")] == ["b.md"]


def test_eval_prints_json(folder, capsys):
    rows = [{"text": SLOP, "label": 1}, {"text": CLEAN, "label": 0}, {"text": SPANISH, "label": 0, "subgroup": "other"}]
    (folder / "rows.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    capsys.readouterr()
    assert cli.main(["eval", "rows.jsonl"]) == 0
    d = json.loads(capsys.readouterr().out)
    assert d["auroc"] == 1.0 and d["subgroups"]["other"]["n"] == 1


def test_language_is_detected(spark):
    rows = [(1, SPANISH, None), (2, CLEAN, None), (3, SPANISH, "EN"), (4, "la casa", None), (5, "zzz " * 40, None), (6, "Der Trupp hat die Balken gemessen und nicht mit dem Wagen zu der Baustelle gebracht, weil es zu spät war und er sich nicht wohl fühlte.", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: (r.language, r.language_confidence) for r in prepare(docs).select("doc_id", "language", "language_confidence").collect()}
    assert got[1][0] == "es" and got[1][1] > 0.5 and got[2][0] == "en" and got[3] == ("en", 1.0) and got[4] == ("en", 0.5) and got[5] == ("en", 0.5) and got[6][0] == "de"
    by = {r.doc_id: r for r in score(docs.drop("lang")).select("doc_id", "abstained", "abstention_reason").collect()}
    assert by[1].abstained and "'es'" in by[1].abstention_reason and not by[2].abstained


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "1.toml").write_text('[[rules]]\nrule_id = "OWN_TEA"\ndimension = "formulaic_structure"\nseverity = "high"\ntemplate = "cup~ of {tea coffee}"\n')
    (tmp_path / "2.json").write_text(json.dumps([{"rule_id": "OWN_X", "dimension": "parallelism", "severity": "low", "regex": "x{3}", "explanation": "three"}]))
    own = Settings(extra_rules=load_rules(tmp_path))
    docs = spark.createDataFrame([(1, "Two cups of tea and xxx. " + CLEAN)], "doc_id int, text string")
    found = {r.rule_id: r.span for r in evidence.findings(prepare(docs, own), own).collect()}
    assert found["OWN_TEA"] == "cups of tea" and found["OWN_X"] == "xxx"
    assert score(docs, own).first().slop_score > score(docs).first().slop_score
    (tmp_path / "3.json").write_text('[{"rule_id": "BAD", "dimension": "parallelism", "severity": "low", "regex": "("}]')
    with pytest.raises(ValueError):
        load_rules(tmp_path)


def test_unknown_names_are_those_that_did_not_fire(spark):
    text = "<!-- plumbline-disable WEASEL_EXPERTS_ARGUE, FORMULAIC_IN_CONCLUSION, parallelism, NONSENSE -->Experts argue. " + CLEAN
    r = evidence.with_evidence(score(spark.createDataFrame([(1, text)], "doc_id int, text string"))).first()
    assert r.unknown_names == ["FORMULAIC_IN_CONCLUSION", "NONSENSE"] and any("NONSENSE" in w for w in r.warnings)
    assert not [e for e in r.evidence if e.rule_id == "WEASEL_EXPERTS_ARGUE"]


def test_authorship_stands_beside_the_score(spark):
    docs = spark.createDataFrame([(1, SLOP), (2, None)], "doc_id int, text string")
    scored = score(docs)
    rows = {r.doc_id: r for r in authorship.attach(scored, authorship.Undecided()).collect()}
    assert rows[1].authorship.asDict() == {"name": "undecided", "probability": 0.5} and rows[2].authorship.probability is None
    assert rows[1].slop_score == scored.first().slop_score

    class Loud:
        name = "loud"

        def detect(self, texts):
            return texts.str.len() * 1.0

    assert authorship.attach(scored, Loud()).first().authorship.probability == 1.0


def test_api(spark):
    got = scan_text(spark, SLOP)
    assert got["score"]["label"] == "severe" and got["evidence"][0]["span"] and set(got["dimensions"]) == set(DIMENSIONS)
    profile = calibrate.profile(score(spark.createDataFrame([(i, CLEAN + f" {i}") for i in range(5)], "doc_id int, text string")))
    assert len(Scanner(spark, baseline=profile).table(spark.createDataFrame([(1, SLOP)], "doc_id int, text string")).first().deviations) == 5


def test_reports(spark):
    docs = evidence.with_evidence(score(spark.createDataFrame([(1, 'He said "a < b" & ' + SLOP)], "doc_id int, text string")))
    row = docs.select("evidence", reports.to_markdown("doc_id").alias("md"), reports.to_html("doc_id").alias("html"), reports.to_sarif("doc_id").alias("sarif"), reports.to_json(Settings(), "doc_id").alias("json")).first()
    assert "RESIDUE_AS_AN_AI" in row.md and row.md.count("\n- ") >= 3 and "## Warnings" in row.md
    assert row.html.count("<mark") == row.html.count("</mark>") > 5 and "a &lt; b" in row.html and "<script" not in row.html
    log = json.loads(reports.sarif_log([row.sarif]))
    results = log["runs"][0]["results"]
    assert len(results) == len(row.evidence) and {r["ruleId"] for r in results} == {r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]}
    region = results[0]["locations"][0]["physicalLocation"]["region"]
    assert region["startLine"] >= 1 and region["startColumn"] >= 1
    assert len(json.loads(row.json)["evidence"]) == len(row.evidence)


def test_medians_are_exact(spark):
    import random
    from statistics import median

    rng, rows = random.Random(1), []
    for d, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)):
        rows += [(d, rng.choice([0.0, 0.25, 1.0, rng.random()])) for _ in range(n)]
    got = {r.dimension: r.median for r in calibrate.medians(spark.createDataFrame(rows, "dimension string, value double"), 8).collect()}
    assert got == {d: pytest.approx(median(v for x, v in rows if x == d), abs=1e-15) for d in "abcd"}


def test_paragraphs_are_scored_alone(spark):
    docs = spark.createDataFrame([(1, SLOP.replace("\n", " ") + "\n\n" + CLEAN + "\n \n\n"), (2, "one only")], "doc_id int, text string")
    rows = sorted((r.doc_id, r.paragraph, r.slop_score) for r in batch.by_paragraph(docs).collect())
    assert [(a, b) for a, b, _ in rows] == [(1, 0), (1, 1)] and rows[0][2] > rows[1][2]
