"""Dimensions to score, label, confidence and abstention, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.functions import text as T
from plumbline.settings import BIAS, CAVEATS, DIMENSIONS, ELEVATED, GAINS, HUMAN, LONE_WEAK, MODEL, MODEL_A, MODEL_B, MODEL_BIAS, WEAK, WEIGHTS, Settings

ABSTAIN_WORDS = 100


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def n_elevated(x: Column) -> Column:
    """How many dimensions of the struct x, other than the human signals, stand out."""
    out = F.lit(0)
    for d in DIMENSIONS:
        if d != HUMAN:
            out = out + (x[d] > ELEVATED).cast("int")
    return out


def damped(dimension: str) -> Column:
    """Whether a weak dimension stands out alone."""
    return (F.col(dimension) > ELEVATED) & (F.col("n_elevated") == 1)


def rules_score(x: Column, n: Column, settings: Settings) -> Column:
    z = F.lit(BIAS)
    for d, weight in WEIGHTS.items():
        part = F.lit(weight * settings.multiplier(d)) * x[d]
        z = z + (F.when((x[d] > ELEVATED) & (n == 1), LONE_WEAK * part).otherwise(part) if d in WEAK else part)
    return F.bround(100 * sigmoid(z * GAINS[settings.strictness]), 1)


def model_score(x: Column) -> Column:
    """The logistic model; strictness and multipliers don't enter it."""
    z = F.lit(MODEL_BIAS)
    for d, weight in MODEL.items():
        z = z + F.lit(weight) * x[d]
    return F.bround(100 * sigmoid(MODEL_A * z + MODEL_B), 1)


def outcome(settings: Settings) -> Column:
    """struct<n_elevated, slop_score>. The dimensions are bound once: a filter on the score that the optimizer
    pushes below this must not hold a copy of their expressions for each use."""

    def use(x: Column) -> Column:
        value = lambda n: model_score(x) if settings.scorer == "ml" else rules_score(x, n, settings)
        return T.let(n_elevated(x), lambda n: F.struct(n.alias("n_elevated"), value(n).alias("slop_score")))

    return T.let(F.struct(*DIMENSIONS), use)


def contributions() -> Column:
    """Map of the model's weighted dimensions."""
    return F.map_from_arrays(F.array(*map(F.lit, MODEL)), F.array(*(F.bround(w * F.col(d), 4) for d, w in MODEL.items())))


def label_of(score: Column) -> Column:
    return F.when(score < 25, "low").when(score < 50, "mild").when(score < 75, "elevated").otherwise("severe")


def confidence(settings: Settings) -> Column:
    w = F.col("w")
    length = F.when(w < 100, 0.25).when(w < settings.min_reliable_words, 0.6).when(w < 1000, 0.85).otherwise(1.0)
    language = F.when(F.col("language") != "en", 0.5).when(F.col("language_confidence") < 0.7, 0.8).otherwise(1.0)
    return F.bround(length * language, 3)


def abstention(settings: Settings) -> Column:
    """Why no confident label is given; null if one is."""
    short = F.format_string(f"Only %d words: too short for a confident label (reliable above ~{settings.min_reliable_words}).", "w")
    foreign = F.format_string("Language '%s': tuned for English, so the label is withheld.", "language")
    return F.when(F.col("w") < ABSTAIN_WORDS, short).when(F.col("language") != "en", foreign)


def warnings(settings: Settings) -> Column:
    """All that applies: damped dimensions, length, language, and the standing caveats."""
    names = F.array_sort(F.filter(F.array(*(F.when(damped(d), F.lit(d)) for d in WEAK)), lambda x: x.isNotNull()))
    w = F.col("w")
    notes = [
        F.when((F.size(names) > 0) & F.lit(settings.scorer == "rules"), F.concat(F.lit("Damped, as nothing corroborates it: "), F.array_join(names, ", "))),
        F.when(w < 100, F.format_string("Very short text (%d words): the score is easily skewed.", "w")).when(
            w < settings.min_reliable_words, F.format_string(f"Short text (%d words, under {settings.min_reliable_words}): indicative only.", "w")
        ),
        F.when(F.col("language") != "en", F.format_string("Language '%s': tuned for English, so confidence is reduced.", "language")),
        *map(F.lit, CAVEATS),
    ]
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def score(docs: DataFrame, settings: Settings | None = None, text: str = "text", prepared: bool = False, places: bool = False) -> DataFrame:
    """docs with dimensions, ``slop_score`` (0 to 100), ``label``, ``confidence``, ``abstained`` and its reason.

    One narrow stage: a document's row is all it needs. Texts that are null or empty have no words, score by their
    lack of concrete items alone, and abstain. With places, the pass over the texts also finds what with_evidence() needs.
    """
    settings = settings or Settings()
    out = docs if prepared else features.prepare(docs, settings, text)
    return judged(features.dimensions(out, settings, places), settings)


def judged(measured: DataFrame, settings: Settings) -> DataFrame:
    """What score() adds to the dimensions of texts, which don't depend on the scorer and the strictness."""
    out = measured.withColumn("_outcome", outcome(settings))
    out = out.withColumns({x: F.col(f"_outcome.{x}") for x in ("n_elevated", "slop_score")}).drop("_outcome")
    out = out.withColumns({"confidence": confidence(settings), "abstention_reason": abstention(settings)})
    raw = T.let(F.col("slop_score"), label_of)
    abstained = F.col("abstention_reason").isNotNull()
    return out.withColumns(
        {
            "abstained": abstained,
            "label": F.when(abstained & raw.isin("elevated", "severe"), "mild").otherwise(raw),
            "warnings": warnings(settings),
        }
    )
