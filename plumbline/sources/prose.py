"""Prose out of Markdown, JSON, HTML and source code, as columns; only Python code and JSON leaves need Python."""

from __future__ import annotations

import ast
import io
import json
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARKDOWN, PYTHON = (".markdown", ".md"), (".py", ".pyi")
SCRIPT = (".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx")
_ENTITY = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
#: Steps of html(), in a form that RE2 reads as well.
HTML_STEPS = [
    (r"(?is)<!--.*?-->", " "), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<nav\b.*?</nav>", " "), (r"(?is)<header\b.*?</header>", " "),
    (r"(?is)<footer\b.*?</footer>", " "), (r"(?is)<aside\b.*?</aside>", " "), (r"(?is)<table\b.*?</table>", " "), (r"(?i)</(p|div|h[1-6]|li|article|section|blockquote)>|<br\s*/?>", "\n\n"), (r"(?s)<[^>]*>", ""),
]

TIDY_STEPS = [("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def source_type(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*MARKDOWN), "markdown").when(s == ".json", "json").when(s.isin(*PYTHON, *SCRIPT), "code").when(s.isin(".htm", ".html"), "website").otherwise("text")


def looks_like_url(value: Column) -> Column:
    return F.rlike(value, F.lit("^https?://"))


def _tidy(text: Column) -> Column:
    for regex, by in TIDY_STEPS:
        text = F.regexp_replace(text, regex, by)
    return text


def html(page: Column) -> Column:
    """Text of a page without scripts, styles, navigation, comments and tables; blocks stand apart by blank lines."""
    text = F.coalesce(page, F.lit(""))
    for regex, by in HTML_STEPS:
        text = F.regexp_replace(text, regex, by)
    for entity, by in _ENTITY.items():
        text = F.replace(text, F.lit(entity), F.lit(by))
    return _tidy(text)


def markdown(md: Column, prefix: str = "plumbline") -> Column:
    """Headings, paragraphs and list items without code, quotes, rules, images and HTML blocks.

    Control comments stay. Covers the common subset; reference links and nested quotes aren't resolved.
    """
    text = F.regexp_replace(F.coalesce(md, F.lit("")), "\r\n?", "\n")
    steps = [
        (r"(?ms)^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\z)", ""),
        (rf"(?s)<!--(?!\s*{prefix}-).*?-->", ""),
        (r"(?m)(?<=\n\n|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\z))+", ""),
        (r"(?m)^[ ]{0,3}>[^\n]*(?:\n(?![ ]{0,3}(?:#|[-*+] |\d+[.)] |```|~~~)|\s*\n)[^\n]+)*", ""),
        (r"(?m)^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),
        (r"(?m)^[ ]{0,3}</?[A-Za-z][^\n]*(?:\n(?!\s*\n)[^\n]+)*", ""),
        (r"(?m)^[ ]{0,3}#{1,6}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", "\n$1\n"),
        (r"(?m)^([^\n]+)\n[ ]{0,3}(?:=+|-{2,})[ \t]*$", "$1\n"),
        (r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", "\n"),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"(`+)(?!`).*?(?<!`)\1(?!`)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])", "$1"),
        (r"(?<![\w])_(?=\S)([^_\n]+?)(?<=\S)_(?![\w])", "$1"),
    ]
    for regex, by in steps:
        text = F.regexp_replace(text, regex, by)
    blocks = F.split(text, r"\n[ \t]*\n\s*", -1)
    # a line that ends within a block is a space; control comments keep their lines
    blocks = F.transform(blocks, lambda b: F.trim(F.when(F.contains(b, F.lit("<!--")), b).otherwise(F.regexp_replace(b, r"[ \t]*\n[ \t]*", " "))))
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def script(source: Column) -> Column:
    """Comments of JavaScript or TypeScript: blocks first, each on a line of its own paragraph, then // comments."""
    src = F.coalesce(source, F.lit(""))
    block = r"(?s)/\*+(.*?)\*+/"
    strip = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\s*\**", ""), r"^\s+|\s+$", "")
    lines = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\r?\n", -1), strip), lambda x: x != ""), " ")
    blocks = F.transform(F.regexp_extract_all(src, F.lit(block), F.lit(1)), lines)
    rest = F.transform(F.regexp_extract_all(F.regexp_replace(src, block, ""), F.lit(r"(?<![:/])//[ \t]?([^\n]*)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(F.concat(blocks, rest), lambda x: x != ""), "\n\n")


def python_prose(source: str) -> str:
    """Docstrings, outermost first, then comments; what can't be parsed has none of either."""
    out = []
    try:
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((ast.get_docstring(node) or "").strip())
    except (SyntaxError, ValueError, RecursionError):
        pass
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.COMMENT:
                out.append(token.string.lstrip("#").strip())
    except (tokenize.TokenError, SyntaxError):
        pass
    return "\n\n".join(filter(None, out))


def python_code(source: Column) -> Column:
    """python_prose() of each row, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda x: python_prose(x or "")), StringType())(source)


def _leaves(node: object) -> Iterator[str]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, (dict, list)):
            todo.extend(reversed(list(x.values() if isinstance(x, dict) else x)))


def _all_strings(raw: pd.Series) -> pd.Series:
    def one(x: object) -> str | None:
        try:
            return "\n\n".join(_leaves(json.loads(x))) if isinstance(x, str) else None
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def json_strings(raw: Column) -> Column:
    """All string leaves in document order, as paragraphs; null where the JSON can't be read."""
    return F.pandas_udf(_all_strings, StringType())(raw)


def json_path(raw: Column, path: str) -> Column:
    """String values at a path of names, indexes and [*], as paragraphs; empty without any."""
    value = F.get_json_object(raw, path)
    many = F.from_json(value, "array<string>")
    if "[*]" in path:
        return F.coalesce(F.array_join(F.filter(many, lambda x: x.isNotNull()), "\n\n"), value, F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    return F.when(kind == "STRING", value).otherwise(F.lit(""))
