"""The fourteen dimensions as columns of a prepared document table.

prepare() adds the columns that all of them read: ``t`` (cleaned text), ``low`` (its lower case), ``w`` (words) and
``sents`` (sentences). No dimension shuffles: everything about a document is computed in its own row. The builders
here say what each is; dimensions() has onepass.py compute those that nothing has replaced, all at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions import language
from plumbline.functions import text as T
from plumbline.rules import LEXICON, SEVERITIES, Rule, pack
from plumbline.settings import DIMENSIONS, Settings

PREPARED = ("t", "low", "w", "sents")
DASH, COMMA, CURLY, STRAIGHT = "[—–]", ",", "[“”‘’]", "[\"']"
PLAIN_VERBS = r"(?i)\b(?:began|bought|built|died|found|gave|held|kept|lost|led|made|moved|ran|said|showed|sold|told|took|tried|used|went|won|wrote)\b"
SUPERLATIVES = r"(?i)\b(?:one of the|the (?:first|largest|last|oldest|only|smallest)|the (?:second|third)\b)"
HEDGES = r"(?i)\b(?:a (?:little|bit)|about|arguably|around|kind of|likely|maybe|nearly|perhaps|roughly|seems? to|sort of|tends? to)\b"
CONCRETE = r"\b\d[\d,.]*\b|\$\d|\b(?:20|19)\d{2}\b"
NUMBER, URL, YEAR = r"\b\d[\d,.]*\b", r"https?://\S+", r"\b(?:20|19)\d{2}\b"
PROPER = r"(?<=[a-z,;:]\s)\p{Lu}\p{Ll}+"
PARTICIPLE = r",\s+([A-Za-z]+ing)\b([^.?!]{0,100})[.?!]"
ANALYSIS = (
    "affirming cementing contributing creating cultivating demonstrating embodying emphasizing enhancing ensuring "
    "fostering highlighting illustrating marking offering positioning reflecting reinforcing representing shaping "
    "showcasing signaling signalling solidifying symbolizing underscoring"
).split()
VAGUE = (
    "commitment community connection culture dedication development future growth heritage identity impact importance "
    "journey landscape legacy nature potential prominence relevance resilience role sense significance spirit values"
).split()
TRICOLON = r"\b(\w+), (\w+),? and (\w+)\b"
ABSTRACT = r"(?:ing|ity|ness|tion|ment|ive|ous|ful|ant|ent|al|ic)$"
FULL = {
    "formulaic_structure": 3.0, "human_writing_signals": 6.0, "lexical_markers": 4.0, "significance_inflation": 3.0,
    "weasel_attribution": 3.0, "unsupported_claims": 3.0, "superficial_analysis": 2.0, "parallelism": 3.0, "copula_avoidance": 4.0,
}
SIMILAR = 0.6

Builder = Callable[[Settings], Column]
_registry: dict[str, Builder] = {}


def register(dimension: str) -> Callable[[Builder], Builder]:
    """Makes a builder the one of its dimension; a second registration replaces the first."""

    def add(builder: Builder) -> Builder:
        _registry[dimension] = builder
        return builder

    return add


def registry() -> dict[str, Builder]:
    return dict(_registry)


def prepare(docs: DataFrame, settings: Settings | None = None, text: str = "text", fences: bool = True) -> DataFrame:
    """docs with the columns of PREPARED, ``original`` (what offsets of findings index), ``language`` and its confidence.

    A ``lang`` column is believed where it says something; else the language is detected by common words. Texts of under
    20 words count as English with confidence 0.5. Null texts are empty. Columns of docs with these names are replaced.
    """
    settings = settings or Settings()
    raw = F.coalesce(F.col(text), F.lit(""))
    raw = T.strip_fences(raw) if fences else raw
    docs = docs.withColumn("original", T.canonical(raw) if settings.repair else raw)
    docs = docs.withColumn("t", T.clean(F.col("original")))
    docs = docs.withColumns({"low": F.lower("t"), "w": T.word_count(F.col("t")), "sents": T.sentences(F.col("t"))})
    given = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    short, known = F.struct(F.lit("en").alias("code"), F.lit(0.5).alias("confidence")), F.struct(F.lower(given).alias("code"), F.lit(1.0).alias("confidence"))
    docs = docs.withColumn("_language", F.when(F.col("w") < 20, short).when(given.isNotNull(), known).otherwise(language.detect(F.col("t"))))
    return docs.withColumns({"language": F.col("_language.code"), "language_confidence": F.col("_language.confidence")}).drop("_language")


def quoted(x: str) -> str:
    """x as a literal of Spark SQL. Rules are put together as SQL: one call for each builds plans far faster."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def may_match(rule: Rule) -> str:
    """Whether the text holds one of the literals without which the rule can't match."""
    return " OR ".join(f"contains(low, {quoted(x)})" for x in rule.anchors) or "true"


def count(rule: Rule) -> str:
    return f"CASE WHEN {may_match(rule)} THEN regexp_count(t, {quoted(rule.java)}) ELSE 0 END"


def counted(regex: str) -> Column:
    return F.regexp_count(F.col("t"), F.lit(regex))


def weighted(rules: list[Rule], repeats: float = 0.0) -> Column:
    """Sum of the rules' counts by severity, and so much more for each repetition of a rule."""
    if repeats:
        each = ", ".join(f"named_struct('n', {count(r)}, 'w', {SEVERITIES[r.severity]})" for r in rules)
        return F.expr(f"aggregate(array({each}), 0D, (a, x) -> a + x.w * x.n + {repeats}D * greatest(x.n - 1, 0))")
    return F.expr("CAST(" + " + ".join(f"{SEVERITIES[r.severity]} * {count(r)}" for r in rules) + " AS DOUBLE)")


def _rate(dimension: str, amount: Column) -> Column:
    return T.saturating(T.per_hundred(amount, F.col("w")), FULL[dimension])


@register("cadence_sameness")
def cadence(settings: Settings) -> Column:
    """1 less the variation of sentence lengths: 0 from a coefficient of variation of 0.6 on, or under 3 sentences."""
    lengths = F.transform("sents", lambda x: T.word_count(x).cast("double"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def of(xs: Column) -> Column:
        mean = total(xs, lambda x: x) / F.size(xs)
        spread = lambda m: F.greatest(F.lit(0.0), 1 - F.sqrt(total(xs, lambda x: (x - m) * (x - m)) / F.size(xs)) / m / 0.6)
        return T.let(mean, lambda m: F.when(m > 0, spread(m)).otherwise(F.lit(0.0)))

    return F.when(F.size("sents") >= 3, T.let(lengths, of)).otherwise(F.lit(0.0))


def dash_signal() -> Column:
    dashes, commas = counted(DASH), counted(COMMA)
    return F.when(dashes >= 2, F.least(F.lit(1.0), dashes / (dashes + commas) / 0.25)).otherwise(F.lit(0.0))


@register("formatting_tells")
def formatting(settings: Settings) -> Column:
    curly, straight = counted(CURLY), counted(STRAIGHT)
    quotes = F.when(curly >= 2, curly / (curly + straight)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.6 * dash_signal() + 0.4 * quotes)


@register("formulaic_structure")
def formulaic(settings: Settings) -> Column:
    """By severity, and 0.5 more for each repetition of a rule."""
    return _rate("formulaic_structure", weighted(pack("formulaic_structure"), repeats=0.5))


@register("human_writing_signals")
def human(settings: Settings) -> Column:
    amount = counted(PLAIN_VERBS) + 1.5 * counted(SUPERLATIVES) + counted(HEDGES) + counted(CONCRETE)
    return _rate("human_writing_signals", amount)


def lexicon_hits(settings: Settings, sentence: Column) -> Column:
    """The sentence's words that are in a category with a weight."""
    terms = [t for c in LEXICON if c.weight_in(settings.profile) > 0 for t in c.terms]
    return F.filter(T.tokens(sentence), lambda x: x.isin(terms))


@register("lexical_markers")
def lexical(settings: Settings) -> Column:
    """Weights of lexicon words, and 0.5 for each sentence with three or more."""
    weights = {t: c.weight_in(settings.profile) for c in LEXICON for t in c.terms}

    def weight(token: Column) -> Column:
        out = F.lit(0.0)
        for value in sorted(set(weights.values()) - {0.0}):
            out = F.when(token.isin([t for t, w in weights.items() if w == value]), F.lit(value)).otherwise(out)
        return out

    hits = F.transform("sents", lambda s: lexicon_hits(settings, s))
    each = F.transform(
        hits,
        lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + weight(x)) + F.when(F.size(h) >= 3, F.lit(0.5)).otherwise(F.lit(0.0)),
    )
    return _rate("lexical_markers", F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def _phrases(dimension: str) -> Builder:
    return lambda settings: _rate(dimension, weighted(pack(dimension)))


for _d in ("significance_inflation", "weasel_attribution", "unsupported_claims", "copula_avoidance"):
    register(_d)(_phrases(_d))


@register("prompt_residue")
def residue(settings: Settings) -> Column:
    """By presence, however long the text."""
    return F.least(F.lit(1.0), weighted(pack("prompt_residue")) / 4.0)


_WORD = re.compile(r"\b\w\w+\b")


def adjacent_similarity(sentences: list[str]) -> list[float]:
    """Cosines of consecutive sentences' TF-IDF vectors (words and pairs, idf smoothed over these sentences)."""
    counts = []
    for s in sentences:
        words = _WORD.findall(s.lower())
        counts.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df = Counter(t for c in counts for t in c)
    n = len(sentences)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    vectors = []
    for c in counts:
        v = {t: k * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return [sum(x * b[t] for t, x in a.items() if t in b) for a, b in zip(vectors, vectors[1:])]


def _redundancy(sentences: pd.Series) -> pd.Series:
    def share(s: object) -> float:
        sims = adjacent_similarity(list(s)) if s is not None else []
        return sum(x >= SIMILAR - 1e-12 for x in sims) / len(sims) if sims else 0.0

    return sentences.map(share).astype("float64")


@register("redundancy")
def redundancy(settings: Settings) -> Column:
    """Share of consecutive sentences that say nearly the same."""
    return F.pandas_udf(_redundancy, DoubleType())(F.col("sents"))


def concrete_items() -> Column:
    """Numbers, addresses, years (which count again) and capitalised words within sentences."""
    digits = F.rlike("t", F.lit("[0-9]"))
    return (
        F.when(digits, counted(NUMBER) + counted(YEAR)).otherwise(F.lit(0))
        + F.when(F.contains("t", F.lit("://")), counted(URL)).otherwise(F.lit(0))
        + counted(PROPER)
    )


@register("genericity")
def genericity(settings: Settings) -> Column:
    """1 without concrete items, 0 from 1.5 a sentence on."""
    return 1 - F.least(F.lit(1.0), concrete_items() / F.greatest(F.size("sents"), F.lit(1)) / 1.5)


def superficial_flags() -> Column:
    """For each ", ...ing ... ." clause, whether it says something vague."""
    lead = F.regexp_extract_all("t", F.lit(PARTICIPLE), F.lit(1))
    clause = F.regexp_extract_all("t", F.lit(PARTICIPLE), F.lit(2))
    pairs = F.arrays_zip(lead.alias("lead"), clause.alias("clause"))
    return F.transform(pairs, lambda x: vague_clause(x["lead"], x["clause"]))


def vague_clause(lead: Column, clause: Column) -> Column:
    words = F.split(F.lower(clause), "[^a-z]+", -1)
    return F.lower(lead).isin(ANALYSIS) | F.arrays_overlap(words, F.array(*map(F.lit, VAGUE)))


@register("superficial_analysis")
def superficial(settings: Settings) -> Column:
    hits = F.size(F.filter(superficial_flags(), lambda x: x))
    return _rate("superficial_analysis", F.when(F.contains("low", F.lit("ing")), hits).otherwise(F.lit(0)))


def abstract_three(a: Column, b: Column, c: Column) -> Column:
    one = lambda x: (F.rlike(F.lower(x), F.lit(ABSTRACT)) & (F.length(x) > 4)).cast("int")
    return one(a) + one(b) + one(c) >= 2


def tricolons() -> Column:
    group = [F.regexp_extract_all("t", F.lit(f"(?U){TRICOLON}"), F.lit(k)).alias(x) for k, x in enumerate("abc", 1)]
    found = F.filter(F.arrays_zip(*group), lambda x: abstract_three(x["a"], x["b"], x["c"]))
    return F.when(F.contains("t", F.lit(" and ")), F.size(found)).otherwise(F.lit(0))


@register("parallelism")
def parallelism(settings: Settings) -> Column:
    return _rate("parallelism", weighted(pack("parallelism")) + tricolons() * SEVERITIES["low"])


_DEFAULTS = registry()


def dimensions(prepared: DataFrame, settings: Settings | None = None, places: bool = False) -> DataFrame:
    """prepared with a column for each dimension; a disabled one is 0 and isn't computed. If asked, ``_located``, which evidence is made of, comes from the same pass."""
    from plumbline.functions.onepass import bounded, measure

    settings = settings or Settings()
    build = registry()
    on = [d for d in DIMENSIONS if d not in settings.disabled_dimensions]
    usual = tuple(d for d in on if build[d] is _DEFAULTS.get(d))
    if usual or places:
        prepared = bounded(prepared).withColumn("_measured", measure(settings, usual, places))
    value = lambda d: F.col(f"_measured.{d}") if d in usual else F.coalesce(build[d](settings), F.lit(0.0)) if d in on else F.lit(0.0)
    located = {"_located": F.col("_measured.located")} if places else {}
    return prepared.withColumns({d: value(d) for d in DIMENSIONS} | located).drop("_measured")


def dimension(prepared: DataFrame, name: str, settings: Settings | None = None) -> DataFrame:
    """prepared with the column of one dimension; no other one is computed."""
    settings = settings or Settings()
    return dimensions(prepared, replace(settings, disabled_dimensions=frozenset(DIMENSIONS) - {name}))
