"""Named queries over the driver's tables, with SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.functions import text as T
from plumbline.functions.scoring import contributions, judged, score
from plumbline.operators import baseline, batch, calibrate, evaluate, evidence, suppress, training
from plumbline.operators.stored import stored
from plumbline.plans import oracle as o
from plumbline.plans.planted import PLANTED_SQL, planted
from plumbline.settings import DIMENSIONS, Settings
from plumbline.sinks import reports
from plumbline.sources import prose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return features.prepare(planted(spark, sf))


_SCORED = ["doc_id", "slop_score", "label", "abstained", "confidence"]


def _score(name: str, settings: Settings, **kw: str) -> None:
    sql = f"{o.scores(**kw)} SELECT {', '.join(_SCORED)} FROM s"
    query(name, sql)(lambda spark, sf: score(planted(spark, sf), settings).select(*_SCORED))


_score("score_rules", Settings())
_score("score_ml", Settings(scorer="ml"), scorer="ml")
_score("score_marketing", Settings(profile="marketing"), profile="marketing")
_score("score_academic", Settings(profile="academic"), profile="academic")
_score("score_technical", Settings(profile="technical"), profile="technical")
_score("score_sensitive", Settings(strictness="sensitive"), strictness="sensitive")
_score("score_balanced", Settings(strictness="balanced"), strictness="balanced")


@query("word_count", f"{o.cleaned()} SELECT doc_id, w AS words FROM d")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).select("doc_id", F.col("w").cast("long").alias("words"))


@query("clean_text", f"{o.cleaned()} SELECT doc_id, t AS cleaned FROM d")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).select("doc_id", F.col("t").alias("cleaned"))


@query("sentences", f"{o.cleaned()} SELECT doc_id, unnest(sents) AS sentence FROM d")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).select("doc_id", "sents").select("doc_id", F.explode_outer("sents").alias("sentence")).where("sentence is not null")


@query("paragraphs", f"{o.cleaned()} SELECT doc_id, unnest(list_filter(string_split_regex(t, E'\\n[ \\t]*\\n'), lambda x: regexp_matches(x, '\\S'))) AS paragraph FROM d")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).select("doc_id", F.explode_outer(T.paragraphs(F.col("t"))).alias("paragraph")).where("paragraph is not null")


def _dimension(name: str) -> None:
    sql = f"{o.cleaned()}, {o.REDUNDANCY} SELECT doc_id, round(redundancy, 6) AS redundancy FROM rd" if name == "redundancy" else o.dimension(name)
    query(f"dim_{name}", sql)(lambda spark, sf: features.dimension(prepared(spark, sf), name).select("doc_id", F.round(name, 6).alias(name)))


for _d in DIMENSIONS:
    _dimension(_d)


@query("dim_lexical_academic", o.dimension("lexical_markers", "academic"))
def lexical_academic(spark: SparkSession, sf: str) -> DataFrame:
    return features.dimension(prepared(spark, sf), "lexical_markers", Settings(profile="academic")).select("doc_id", F.round("lexical_markers", 6).alias("lexical_markers"))


@query("gate_notes", f"{o.scores()} SELECT doc_id, n_elevated, {' || '.join(f'CASE WHEN {d} > 0.5 AND n_elevated = 1 THEN {chr(39)}{d}{chr(39)} ELSE {chr(39)}{chr(39)} END' for d in o.WEAK)} AS damped FROM s")
def gate_notes(spark: SparkSession, sf: str) -> DataFrame:
    note = F.concat(*(F.when((F.col(d) > 0.5) & (F.col("n_elevated") == 1), d).otherwise("") for d in o.WEAK))
    return score(planted(spark, sf)).select("doc_id", F.col("n_elevated").cast("int").alias("n_elevated"), note.alias("damped"))


_DIMS_SQL = ", ".join(f"round({d}, 6) AS {d}" for d in DIMENSIONS)


@query("dimensions", f"{o.scores()} SELECT doc_id, {_DIMS_SQL} FROM s")
def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return score(planted(spark, sf)).select("doc_id", *(F.round(d, 6).alias(d) for d in DIMENSIONS))


@query("model_contributions", f"{o.scores()} SELECT doc_id, {', '.join(f'round_even({w}::DOUBLE * {d}, 4) + 0 AS {d}' for d, w in o.MODEL.items())} FROM s")
def model_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = score(planted(spark, sf)).select("doc_id", contributions().alias("c"))
    return rows.select("doc_id", *((F.col("c")[d] + 0).alias(d) for d in o.MODEL))


_FOUND = ["doc_id", "rule_id", "severity", "start_char", "end_char", "span"]
#: All findings that no control comment silences, as k.
_EV = f"{o.cleaned()}, {o.matches()}, {o.SUPPRESSION}, k AS MATERIALIZED (SELECT * FROM ev WHERE NOT {o.QUIET})"


def _find(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.findings(prepared(spark, sf))


@query("evidence", f"{_EV} SELECT {', '.join(_FOUND)}, (row_number() OVER (PARTITION BY doc_id ORDER BY start_char, ord, n) - 1)::INT AS ordinal FROM k")
def evidence_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _find(spark, sf).select(*_FOUND, "ordinal")


@query("suggestions", f"{o.cleaned()}, {o.matches(o.REWRITE_RULES)} SELECT {', '.join(_FOUND)} FROM ev")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    all_off = Settings(suggest=True, disabled_dimensions=frozenset(DIMENSIONS))
    return evidence.findings(prepared(spark, sf), all_off).select(*_FOUND)


_LINE = "1 + len(regexp_extract_all(substring(original, 1, start_char), E'\\n'))"


@query("line_col", f"{_EV} SELECT doc_id, rule_id, start_char, ({_LINE})::INT AS line, (1 + start_char - (CASE WHEN contains(substring(original, 1, start_char), E'\\n') THEN start_char - strpos(reverse(substring(original, 1, start_char)), E'\\n') + 1 ELSE 0 END))::INT AS col FROM k")
def line_col(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.with_evidence(prepared(spark, sf)).select("doc_id", "original", F.explode_outer("evidence").alias("e")).where("e is not null")
    at = T.line_and_column(F.col("original"), F.col("e.start_char"))
    return rows.select("doc_id", "e.rule_id", "e.start_char", at["line"].alias("line"), at["col"].alias("col"))


@query("suppressed", f"{o.cleaned()}, {o.SUPPRESSION} SELECT doc_id, s::INT AS start, e::INT AS stop, array_to_string(names, ' ') AS names FROM rg")
def suppressed(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("original")
    rows = prepared(spark, sf).select("doc_id", F.explode_outer(suppress.ranges(text, suppress.comments(text, "plumbline"))).alias("r")).where("r is not null")
    return rows.select("doc_id", "r.start", F.col("r.end").alias("stop"), F.array_join("r.names", " ").alias("names"))


_PRINT = "sha256(doc_id::VARCHAR || chr(0) || rule_id || chr(0) || span)"


@query("fingerprints", f"{_EV} SELECT DISTINCT {_PRINT} AS fingerprint FROM k")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.build(_find(spark, sf))


@query("new_findings", f"{_EV}, ok AS (SELECT * FROM k) SELECT doc_id, rule_id, {_PRINT} AS fingerprint FROM ok WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = ok.doc_id AND k.rule_id = ok.rule_id AND k.span = ok.span AND k.severity = 'low')")
def new_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = stored(_find(spark, sf).select("doc_id", "rule_id", "severity", "span"))
    return baseline.new(found, baseline.build(found.where("severity = 'low'"))).select("doc_id", "rule_id", "fingerprint")


@query("batch_by_label", f"{o.scores()} SELECT label, count(*) AS n FROM s GROUP BY label")
def batch_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return batch.by_label(score(planted(spark, sf)))


@query("batch_by_severity", f"{_EV} SELECT severity, count(*) AS n FROM k GROUP BY severity")
def batch_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return batch.by_severity(_find(spark, sf))


@query("worst", f"{o.scores()} SELECT doc_id, slop_score, label FROM s ORDER BY slop_score DESC, doc_id LIMIT 5")
def worst(spark: SparkSession, sf: str) -> DataFrame:
    return batch.worst(score(planted(spark, sf)))


@query("max_severity", f"{_EV} SELECT max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INT AS max_rank FROM k")
def max_severity(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.max_severity(_find(spark, sf))


@query("rule_metadata", f"{_EV} SELECT rule_id, any_value(severity) AS severity, count(*) AS n FROM k GROUP BY rule_id")
def rule_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return batch.rule_metadata(evidence.findings(prepared(spark, sf))).select("rule_id", "severity", "n")


_LONG = " UNION ALL ".join(f"SELECT doc_id, w, '{d}' AS dimension, {d} AS value FROM s" for d in DIMENSIONS)
_PROFILE = f"""{o.scores()}, v AS ({_LONG}), p0 AS (SELECT dimension, count(*) AS n_docs, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median FROM v WHERE w >= 50 GROUP BY dimension),
    p1 AS (SELECT v.dimension, median(abs(value - median)) AS mad FROM v JOIN p0 USING (dimension) WHERE w >= 50 GROUP BY v.dimension)"""


@query("calibration", f"{_PROFILE} SELECT dimension, n_docs, round(mean, 5) AS mean, round(std, 5) AS std, round(median, 5) AS median, round(mad, 5) AS mad FROM p0 JOIN p1 USING (dimension)")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    p = calibrate.profile(score(planted(spark, sf)))
    return p.select("dimension", "n_docs", *(F.round(c, 5).alias(c) for c in ("mean", "std", "median", "mad")))


@query("zscores", f"""{_PROFILE} SELECT v.doc_id, v.dimension, round(CASE WHEN std <= 1e-9 THEN CASE WHEN abs(value - mean) <= 1e-6 THEN 0 ELSE 3 * sign(value - mean) END ELSE greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (value - mean) / CASE WHEN std > 1e-9 THEN std END)) END, 2) + 0 AS z FROM v JOIN p0 USING (dimension)""")
def zscores(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored(score(planted(spark, sf)).select("doc_id", "w", *DIMENSIONS))
    return calibrate.deviations(scored, calibrate.profile(scored))


def _labelled(spark: SparkSession, sf: str, settings: Settings | None = None) -> DataFrame:
    """Rows to evaluate on: low quality is the positive class, the language the subgroup."""
    return _evaluated(score(_with_label(spark, sf), settings))


def _with_label(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have a label, which alone are scored."""
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("_truth")).where("_truth is not null")
    return planted(spark, sf).join(labels, "doc_id")


def _evaluated(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.col("lang").alias("subgroup"), F.col("slop_score").alias("score"), "abstained", F.col("_truth").alias("label"))


def _eval_sql(strictness: str = "conservative", scorer: str = "rules") -> str:
    return f"{o.scores(strictness=strictness, scorer=scorer)}, ev AS MATERIALIZED (SELECT s.doc_id, documents.lang AS subgroup, slop_score AS score, abstained, 1 - quality AS label FROM s JOIN documents USING (doc_id) JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


_CURVE = "c0 AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ev GROUP BY score), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM c0 WINDOW w AS (ORDER BY score DESC))"


@query("auroc", f"{_eval_sql()}, {_CURVE} SELECT round(sum(neg * (tp - pos / 2)) / max(pa * na), 6)::DOUBLE AS auroc FROM c")
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auroc(_labelled(spark, sf))


@query("pr_auc", f"{_eval_sql()}, {_CURVE}, k AS (SELECT score, tp / (tp + fp) AS p, tp / pa AS r FROM c), h AS (SELECT r - lag(r, 1, 0) OVER (ORDER BY score DESC) AS width, p + lag(p, 1, 1) OVER (ORDER BY score DESC) AS heights FROM k) SELECT round(sum(width * heights / 2), 6) AS pr_auc FROM h")
def pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.pr_auc(_labelled(spark, sf))


@query("tpr_at_fpr", f"{_eval_sql()}, {_CURVE} SELECT round(coalesce(max(tp / pa) FILTER (fp / na <= 0.01), 0), 6) AS tpr_at_01, round(coalesce(max(tp / pa) FILTER (fp / na <= 0.05), 0), 6) AS tpr_at_05 FROM c")
def tpr_at_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.tpr_at_fpr(_labelled(spark, sf))


@query("ece", f"{_eval_sql()}, bins AS (SELECT count(*) AS n, avg(score / 100) AS p, avg(label) AS y FROM ev GROUP BY least(floor(score / 100 * 10), 9)) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM bins")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ece(_labelled(spark, sf))


@query("brier", f"{_eval_sql()} SELECT round(avg((score / 100 - label) ** 2), 6) AS brier FROM ev")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.brier(_labelled(spark, sf))


@query("risk_coverage", f"{_eval_sql()} SELECT round(avg((NOT abstained)::INT), 6) AS coverage, round(coalesce(avg(((score >= 50)::INT = label)::INT) FILTER (NOT abstained), 0), 6) AS accuracy_answered, round(avg(((score >= 50)::INT = label)::INT), 6) AS accuracy_all FROM ev")
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.risk_coverage(_labelled(spark, sf))


@query("subgroups", f"{_eval_sql()} SELECT subgroup, count(*) AS n, round(coalesce(avg((score >= 50)::INT) FILTER (label = 0), 0), 6) AS fpr, round(coalesce(avg((score < 50)::INT) FILTER (label = 1), 0), 6) AS fnr, round(avg(abstained::INT), 6) AS abstention_rate FROM ev GROUP BY subgroup")
def subgroups(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.subgroups(_labelled(spark, sf))


def _gate_sql() -> str:
    """Both scorers' true positive rates at 1 % false ones, and each language's false positives, side by side."""
    parts = []
    for name, scorer in (("old", "rules"), ("new", "ml")):
        ev = _eval_sql(scorer=scorer).removeprefix("WITH ")
        parts.append(f"""{name}_t AS (WITH {ev}, {_CURVE} SELECT round(coalesce(max(tp / pa) FILTER (fp / na <= 0.01), 0), 6) AS {name}_tpr FROM c),
        {name}_g AS (WITH {ev} SELECT subgroup, round(coalesce(avg((score >= 50)::INT) FILTER (label = 0), 0), 6) AS {name}_fpr FROM ev GROUP BY subgroup)""")
    fair = "SELECT coalesce(bool_and(new_fpr <= coalesce(old_fpr, new_fpr) + 0.02), true) AS fair FROM new_g LEFT JOIN old_g USING (subgroup)"
    return f"WITH {', '.join(parts)} SELECT old_tpr, new_tpr, fair, new_tpr >= old_tpr - 0.02 AND fair AS promote FROM old_t, new_t, ({fair})"


@query("promotion_gate", _gate_sql())
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    measured = features.dimensions(features.prepare(_with_label(spark, sf)))
    once = stored(measured.select("doc_id", "lang", "_truth", "w", "language", "language_confidence", *DIMENSIONS))
    return evaluate.promotion(*(_evaluated(judged(once, Settings(scorer=s))) for s in ("rules", "ml")))


@query("fairness_rules", f"""{_EV}, cl AS (SELECT doc_id, documents.lang AS subgroup FROM documents JOIN labels USING (doc_id) WHERE quality = 1), n AS (SELECT subgroup, count(*) AS n_docs FROM cl GROUP BY subgroup),
    f AS (SELECT DISTINCT doc_id, rule_id FROM k) SELECT subgroup, rule_id, count(*) AS docs, round(count(*) / any_value(n_docs), 6) AS rate, round(count(*) / any_value(n_docs), 6) > 0.2 AS flagged FROM f JOIN cl USING (doc_id) JOIN n USING (subgroup) GROUP BY subgroup, rule_id""")
def fairness_rules(spark: SparkSession, sf: str) -> DataFrame:
    clean = planted(spark, sf).join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.col("lang").alias("subgroup"))
    return evaluate.rule_rates(_find(spark, sf), clean)


@query("span_iou", f"""{_EV}, x AS (SELECT a.doc_id, a.rule_id, b.rule_id AS other, least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char) AS shared, a.end_char - a.start_char + b.end_char - b.start_char AS total FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.start_char < b.end_char AND b.start_char < a.end_char)
    SELECT doc_id, rule_id, other, count(*) AS pairs, round(max(shared / (total - shared)), 6) AS iou FROM x GROUP BY ALL""")
def span_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs, document by document: an array of a few findings against itself rather than a range join."""
    rows = evidence.with_evidence(prepared(spark, sf)).select("doc_id", "evidence")
    rows = rows.select("doc_id", F.explode_outer("evidence").alias("a"), "evidence").select("doc_id", "a", F.explode_outer("evidence").alias("b"))
    rows = rows.where("a.start_char < b.end_char and b.start_char < a.end_char")
    shared = evaluate.iou(F.col("a.start_char"), F.col("a.end_char"), F.col("b.start_char"), F.col("b.end_char"))
    return rows.groupBy("doc_id", F.col("a.rule_id").alias("rule_id"), F.col("b.rule_id").alias("other")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max(shared), 6).alias("iou"))


@query("span_match", f"""{_EV}, g AS (SELECT *, CASE WHEN span = lower(span) THEN 1 ELSE 0 END AS exact FROM (SELECT DISTINCT doc_id, start_char, end_char, span FROM k)) SELECT doc_id, sum(exact)::INT AS matched, round(avg(exact), 6) AS precision, round(avg(exact), 6) AS recall FROM g GROUP BY doc_id""")
def span_match(spark: SparkSession, sf: str) -> DataFrame:
    """Found spans against themselves, those with capitals one character longer."""
    rows = evidence.with_evidence(prepared(spark, sf)).select("doc_id", F.array_distinct(F.transform("evidence", lambda e: F.struct(e["start_char"].alias("start"), e["end_char"].alias("end"), e["span"].alias("span")))).alias("e"))
    rows = rows.where(F.size("e") > 0)
    one = lambda e, more: F.struct(e["start"].alias("start"), (e["end"] + more).alias("end"))
    rows = rows.select("doc_id", F.transform("e", lambda e: one(e, F.lit(0))).alias("pred"), F.transform("e", lambda e: one(e, F.when(e["span"] == F.lower(e["span"]), 0).otherwise(100_000))).alias("gold"))
    out = evaluate.span_match(rows)
    return out.select("doc_id", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("json_strings", "SELECT event_id, string_agg(v, E'\\n\\n' ORDER BY k) AS prose FROM (SELECT event_id, unnest(json_keys(props)) AS key, generate_subscripts(json_keys(props), 1) AS k, json_extract(props, '$.' || key) AS j, json_extract_string(props, '$.' || key) AS v FROM events) WHERE json_type(j) = 'VARCHAR' GROUP BY event_id UNION ALL SELECT event_id, '' FROM events WHERE len(list_filter(json_keys(props), lambda k: json_type(json_extract(props, '$.' || k)) = 'VARCHAR')) = 0")
def json_strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", prose.json_strings(F.col("props")).alias("prose"))


def _html_sql() -> str:
    text = "html"
    for regex, by in prose.HTML_STEPS:
        text = f"regexp_replace({text}, {o.q(regex)}, {o.q(by)}, 'g')"
    text = o._ENTITIES.format(text).replace("'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')", "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')")
    for regex, by in prose.TIDY_STEPS:
        text = f"regexp_replace({text}, {o.q(regex)}, {o.q(by)}, 'g')"
    return f"SELECT page_id, {text} AS prose FROM pages"


@query("html_prose", _html_sql())
def html_prose(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", prose.html(F.col("html")).alias("prose"))


_CONV = "planted AS MATERIALIZED (SELECT conv_id * 1000 + turn AS doc_id, 'en' AS lang, role AS source, text FROM conversations)"


@query("conversation_scores", f"{o.scores(base=o.cleaned(_CONV))} SELECT r.role, count(*) AS n, round(avg(slop_score), 4) AS mean_score FROM s JOIN (SELECT conv_id * 1000 + turn AS doc_id, role FROM conversations) r USING (doc_id) GROUP BY r.role")
def conversation_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score(table(spark, sf, "conversations")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("slop_score"), 4).alias("mean_score"))


@query("adjacent_cosine", "SELECT label, count(*) AS pairs, round(avg((c >= 0.5)::INT), 6) AS similar FROM (SELECT label, list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS c FROM embeddings) WHERE c IS NOT NULL GROUP BY label")
def adjacent_cosine(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select("label", x.alias("a"), F.lead(x).over(w).alias("b")).where("b is not null")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cos = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((cos >= 0.5).cast("int")), 6).alias("similar"))


@query("class_quota", "SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 20")
def class_quota(spark: SparkSession, sf: str) -> DataFrame:
    return training.quota(table(spark, sf, "labels").select("doc_id", "quality"), 20, "quality")


@query("first_of_each", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def first_of_each(spark: SparkSession, sf: str) -> DataFrame:
    return batch.first_of_each(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("composition", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def composition(spark: SparkSession, sf: str) -> DataFrame:
    return batch.composition(table(spark, sf, "documents"), "lang", "source")


def _report(name: str, column: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = evidence.with_evidence(score(planted(spark, sf), places=True))
        return rows.select("doc_id", column().alias("report"))

    query(name)(run)


_report("report_json", lambda: reports.to_json(Settings(), "doc_id"))
_report("report_markdown", lambda: reports.to_markdown("doc_id"))
_report("report_html", lambda: reports.to_html("doc_id"))
_report("report_sarif", lambda: reports.to_sarif("doc_id"))
