"""Extraction of prose and reading of files."""

import json

from pyspark.sql import functions as F

from plumbline.sources import prose
from plumbline.sources.readers import labelled, listing, read_files


def _one(spark, f, text):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


def test_markdown(spark):
    out = _one(spark, prose.markdown, "# Title\n\nA *fine* `code` line\nand more.\n\n```py\nx = 1\n```\n\n> quoted\n\n- item one\n- item two\n\n<!-- plumbline-disable-line -->\n")
    assert "Title" in out and "A fine" in out and "line and more." in out and "item one" in out
    assert "x = 1" not in out and "quoted" not in out and "code" not in out and "plumbline-disable-line" in out
    assert _one(spark, prose.markdown, None) == ""


def test_code(spark):
    assert prose.python_prose('"""Top."""\ndef f():\n    """Inner."""\n    return 1  # note\n') == "Top.\n\nInner.\n\nnote"
    assert prose.python_prose("def (") == ""
    assert _one(spark, prose.script, "/** One\n * two */\nlet u = 'http://x'; // three") == "One two\n\nthree"


def test_json(spark):
    text = json.dumps({"a": {"b": "one", "n": 3}, "t": ["two", {"z": "three"}]})
    assert _one(spark, prose.json_strings, text) == "one\n\ntwo\n\nthree"
    assert _one(spark, prose.json_strings, "{") is None and _one(spark, prose.json_strings, None) is None
    assert _one(spark, lambda c: prose.json_path(c, "$.a.b"), text) == "one"
    assert _one(spark, lambda c: prose.json_path(c, "$.a.n"), text) == ""


def test_html(spark):
    assert _one(spark, prose.html, "<nav>menu</nav><p>Fish &amp; chips</p><script>x()</script><p>End</p>") == "Fish & chips\n\nEnd"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nBody.")
    (tmp_path / "b.py").write_text("# note\n")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.bin").write_bytes(b"1")
    assert [p.rsplit("/", 1)[1] for p in listing(str(tmp_path))] == ["a.md", "b.py", "c.txt"]
    rows = {r.source.rsplit("/", 1)[1]: r for r in read_files(spark, [str(tmp_path)]).collect()}
    assert rows["a.md"].text == "Head\n\nBody." and rows["b.py"].text == "note" and not rows["c.txt"].valid and "d.bin" not in rows


def test_labelled(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a", "label": 1}\n\n{"text": "b", "label": 0, "bucket": "c", "subgroup": "s"}\n')
    assert sorted(tuple(r) for r in labelled(spark, str(tmp_path / "x.jsonl")).collect()) == [("a", 1, "unknown", "general"), ("b", 0, "c", "s")]
