"""The pipeline, stage by stage, against brute force."""

import numpy as np

import corpus_pipeline
from plumbline.llm import langid, secrets, winnow
from plumbline.llm.common import table

from ..conftest import SMALL
from .test_llm_brute import brute_pairs


def test_stages(spark, duck, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scans", "bpe"]
    docs, seen = table(spark, SMALL, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        seen.append((docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    for before, after in seen[:4]:
        assert after.columns == before.columns
    before, after = map(rows, seen[0])
    kept = langid.identify(seen[0][0], langid.fit(seen[0][0])).collect()
    assert set(after) == {r["doc_id"] for r in kept if r["share"] >= langid.LEAST_SHARE or not r["n_grams"] and before[r["doc_id"]]["text"].strip()}
    before, after = map(rows, seen[1])
    group = {i: i for i in before}
    for ids, _ in brute_pairs([(i, r["text"]) for i, r in before.items()]):
        low = {group[i] for i in ids}
        group = {k: min(low) if v in low else v for k, v in group.items()}
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert set(after) == set(first.values()) < set(before)
    before, after = map(rows, seen[2])
    hit = {r[0] for r in duck.sql(f"SELECT DISTINCT doc_id FROM ({winnow.ORACLE})").fetchall()}
    assert set(after) == set(before) - hit < set(before)
    before, after = map(rows, seen[3])
    found = {r["doc_id"] for r in secrets.scan(seen[3][0]).collect()}
    assert set(before) == set(after) and {i for i in before if before[i]["text"] != after[i]["text"]} == found
    assert not secrets.scan(seen[3][1]).count() and all(len(r["text"]) == r["n_chars"] for i, r in after.items() if i in found)
    before, after = map(rows, seen[4])
    assert set(before) == set(after) and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in after.values())
    assert np.array_equal(sorted(after), sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and languages, empty and repeated rows, columns of other names, and an empty table: every stage gives rows that keep their columns."""
    from .test_llm_edges import ROWS, SCHEMA

    rows = [(*r, len(r[1] or ""), 0.5, 1, 2, 3, 4, "z") for r in [*ROWS, ROWS[6], (None, ROWS[0][1], "en", "a"), (20, 'my TOKEN = "0123456789abcdef0123"', "en", "b")]]
    for name, docs in (("odd", spark.createDataFrame(rows, SCHEMA)), ("none", spark.createDataFrame([], SCHEMA))):
        seen = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}{k}")
            after = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or after.columns == docs.columns
            docs = after
            seen.append(sorted(((r["doc_id"], r["text"]) if k < 4 else (r["doc_id"], r["n_tokens"]) for r in after.collect()), key=repr))
        if name == "none":
            assert seen == [[]] * 5
            continue
        # texts without letters and null ones go; of repeated and equal rows one stays, with the least doc_id that is its own
        assert not [x for x in seen[0] if not (x[1] or "").strip()]
        assert [x for x in seen[1] if x[1] == ROWS[0][1]] == [(2, ROWS[0][1])] and len([x for x in seen[1] if x[1] == ROWS[6][1]]) == 1
        assert seen[2] == seen[1] and [t for i, t in seen[3] if i == 20] == ["my <assigned_token>"] and len(seen[4]) == len(seen[3])
