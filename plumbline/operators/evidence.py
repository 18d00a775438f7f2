"""Findings: where rules match, in offsets of the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import onepass
from plumbline.functions import text as T
from plumbline.operators import suppress
from plumbline.settings import Settings

_NONE = "array<struct<start:int,end:int,ord:int,n:int,rule_id:string,dimension:string,severity:string,explanation:string,replacement:string,confidence:double>>"
_META = ("ord", "rule_id", "dimension", "severity", "explanation", "replacement", "confidence")
_KINDS = dict(zip(_META, ("int", "string", "string", "string", "string", "string", "double")))


def hits(settings: Settings, rewrites: bool = False) -> Column:
    """All findings of a prepared row, in cleaned offsets, before suppression; or its rewrites: shorter wordings, which neither suppression nor severities change."""
    entries = onepass.catalogue(settings, rewrites)
    if not entries:
        return F.array().cast(_NONE)
    meta = F.array(*(F.struct(*(F.lit(e[k]).cast(_KINDS[k]).alias(k) for k in _META)) for e in entries))

    def whole(x: Column) -> Column:
        of = F.get(meta, x["i"])
        named = {k: of[k] for k in _META} | {"explanation": F.coalesce(x["note"], of["explanation"])}
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), named["ord"].alias("ord"), x["n"].alias("n"), *(named[k].alias(k) for k in _META[1:]))

    return F.transform(F.col("_rewritten" if rewrites else "_located"), whole)


def with_evidence(prepared: DataFrame, settings: Settings | None = None) -> DataFrame:
    """prepared with ``evidence``, a sorted array of structs, and ``unknown_names`` of its control comments, of which a ``warnings`` column is told.

    A finding's span is the original text between its offsets. What is disabled or suppressed is left out, and the
    score isn't touched by it. Findings are ordered by start, then dimension, rule and match.
    """
    settings = settings or Settings()
    df = prepared.withColumn("_comments", suppress.comments(F.col("original"), settings.comment_prefix))
    df = df.withColumns({"_silent": suppress.ranges(F.col("original"), F.col("_comments")), "_gone": T.collapsed(F.col("original"))})
    if "_located" not in df.columns:
        df = onepass.bounded(df).withColumn("_located", onepass.locate(settings))
    if settings.suggest:
        df = df.withColumn("_rewritten", onepass.locate(settings, rewrites=True))
    df = df.withColumns({"_hits": hits(settings), "_rewrites": hits(settings, rewrites=True) if settings.suggest else F.array().cast(_NONE)})

    df = df.withColumn("unknown_names", suppress.unknown_names(F.col("_comments"), F.transform("_hits", lambda x: x["rule_id"])))
    if "warnings" in df.columns:
        note = F.when(F.size("unknown_names") > 0, F.array(F.concat(F.lit("Control comments name what is no dimension and no rule that fired: "), F.array_join("unknown_names", ", ")))).otherwise(F.array().cast("array<string>"))
        df = df.withColumn("warnings", F.concat("warnings", note))

    def placed(x: Column) -> Column:
        start = T.to_original(x["start"], F.col("_gone"))
        end = T.to_original(x["end"] - 1, F.col("_gone")) + 1
        suggestion = F.when(
            x["replacement"].isNotNull(),
            F.struct(x["replacement"].alias("text"), x["confidence"].alias("confidence"), F.when(x["replacement"] == "", F.lit("delete")).otherwise(F.concat(F.lit("replace with '"), x["replacement"], F.lit("'"))).alias("reasoning")),
        )
        return F.struct(
            start.alias("start_char"), x["ord"].alias("ord"), x["n"].alias("n"), end.alias("end_char"), x["rule_id"].alias("rule_id"), x["dimension"].alias("dimension"), x["severity"].alias("severity"),
            F.substring(F.col("original"), start + 1, end - start).alias("span"), x["explanation"].alias("explanation"), suggestion.alias("suggestion"),
        )

    at = F.transform("_hits", placed)
    kept = F.filter(at, lambda e: ~suppress.silenced(F.col("_silent"), e["start_char"], e["rule_id"], e["dimension"]))
    return df.withColumn("evidence", F.array_sort(F.concat(kept, F.transform("_rewrites", placed)))).drop("_comments", "_silent", "_gone", "_located", "_rewritten", "_hits", "_rewrites")


def findings(prepared: DataFrame, settings: Settings | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each finding, with the keys of its document and its ordinal.

    The outer generator keeps the optimizer from repeating all rules in a filter for non-empty arrays.
    """
    rows = with_evidence(prepared, settings).select(*keys, "evidence")
    return rows.select(*keys, F.posexplode_outer("evidence").alias("ordinal", "e")).where("e is not null").select(*keys, "ordinal", *(F.col(f"e.{x}") for x in ("rule_id", "dimension", "severity", "start_char", "end_char", "span", "explanation", "suggestion")))
