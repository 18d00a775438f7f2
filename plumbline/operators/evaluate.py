"""Evaluation of scores against labels: ranking, calibration, abstention, fairness and span overlap.

Inputs are rows of (label 0 or 1, score, abstained). Rows with a null label or score don't count. Curves are built on
the distinct scores, so that the single ordered partition of a window holds at most as many rows as there are scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.stored import stored

FLAGGED = 50.0


def _valid(rows: DataFrame) -> DataFrame:
    """Rows with a label. Null scores are left out by the aggregates: a filter would be pushed into the scoring
    itself, with a copy of its expressions."""
    return rows.where(F.col("label").isNotNull())


def curve(rows: DataFrame) -> DataFrame:
    """For each distinct score from the highest: true and false positives at it or above, and all of each."""
    by = _valid(rows).groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.count("score").alias("_n")).where("_n > 0")
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by.select("score", "pos", "neg", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(everything).alias("p_all"), F.sum("neg").over(everything).alias("n_all"))


def auroc(rows: DataFrame) -> DataFrame:
    """Chance that a positive row has the higher score, ties counting half; null if a class is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return curve(rows).agg(F.round(F.when((F.max("p_all") > 0) & (F.max("n_all") > 0), area / F.nullif(F.max("p_all") * F.max("n_all"), F.lit(0))), 6).alias("auroc"))


def tpr_at_fpr(rows: DataFrame, targets: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """The highest true positive rate whose false positive rate is within each target."""
    c = curve(rows)
    fpr, tpr = F.col("fp") / F.nullif("n_all", F.lit(0)), F.col("tp") / F.nullif("p_all", F.lit(0))
    return c.agg(*(F.round(F.coalesce(F.max(F.when(fpr <= t, tpr)), F.lit(0.0)), 6).alias(f"tpr_at_{str(t)[2:]}") for t in targets))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Trapezoids under precision against recall, from precision 1 at recall 0."""
    w = Window.orderBy(F.desc("score"))
    points = curve(rows).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.nullif("p_all", F.lit(0))).alias("recall"))
    sides = points.select((F.col("recall") - F.lag("recall", 1, 0.0).over(w)).alias("width"), (F.col("precision") + F.lag("precision", 1, 1.0).over(w)).alias("heights"))
    return sides.agg(F.round(F.sum(F.col("width") * F.col("heights") / 2), 6).alias("pr_auc"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean distance of confidence and accuracy over equal bins, by their share of rows. Scores count as hundredths if any is over 1.

    Which it is shows in the end: rows are read once, into the bins of both readings.
    """
    bin_of = lambda p: F.least(F.floor(p * bins), F.lit(bins - 1))
    parts = _valid(rows).groupBy(bin_of(F.col("score") / 100).alias("_of_100"), bin_of(F.col("score")).alias("_of_1")).agg(
        F.max("score").alias("_max"), F.count("score").alias("n"), F.sum(F.col("score") / 100).alias("_p_of_100"), F.sum("score").alias("_p_of_1"), F.count("label").alias("_labels"), F.sum("label").alias("_y")
    )
    hundred = F.max("_max").over(Window.partitionBy(F.lit(0))) > 1
    read = parts.select(*(F.when(hundred, F.col(f"{c}_of_100")).otherwise(F.col(f"{c}_of_1")).alias(to) for c, to in (("", "bin"), ("_p", "p"))), "n", "_labels", "_y")
    by = read.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum("p") / F.nullif(F.sum("n"), F.lit(0))).alias("p"), (F.sum("_y") / F.sum("_labels")).alias("y"))
    return by.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared distance of score and label. Scores count as hundredths if any is over 1; both means come from one pass."""
    mean = lambda p: F.avg(F.pow(p - F.col("label"), F.lit(2)))
    both = _valid(rows).agg(F.max("score").alias("top"), mean(F.col("score") / 100).alias("of_100"), mean(F.col("score")).alias("of_1"))
    return both.select(F.round(F.when(F.col("top") > 1, F.col("of_100")).otherwise(F.col("of_1")), 6).alias("brier"))


def risk_coverage(rows: DataFrame, at: float = FLAGGED) -> DataFrame:
    """Accuracy with and without abstaining, and the share of rows that get an answer."""
    right = ((F.col("score") >= at).cast("int") == F.col("label")).cast("double")
    kept = F.when(F.col("score").isNotNull(), ~F.col("abstained"))
    return _valid(rows).agg(
        F.round(F.avg(kept.cast("double")), 6).alias("coverage"),
        F.round(F.coalesce(F.avg(F.when(kept, right)), F.lit(0.0)), 6).alias("accuracy_answered"),
        F.round(F.coalesce(F.avg(right), F.lit(0.0)), 6).alias("accuracy_all"),
    )


def subgroups(rows: DataFrame, group: str = "subgroup", at: float = FLAGGED) -> DataFrame:
    """False positive, false negative and abstention rates by group; 0 where there are no such rows."""
    flag = F.col("score") >= at
    rate = lambda x, name: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(name)
    return _valid(rows).groupBy(group).agg(
        F.count("score").alias("n"),
        rate(F.when(F.col("label") == 0, flag.cast("double")), "fpr"),
        rate(F.when(F.col("label") == 1, (~flag).cast("double")), "fnr"),
        rate(F.when(F.col("score").isNotNull(), F.col("abstained").cast("double")), "abstention_rate"),
    ).where("n > 0")


def rule_rates(findings: DataFrame, clean: DataFrame, group: str = "subgroup", flag_over: float = 0.2) -> DataFrame:
    """Share of a group's clean documents (doc_id, group) in which a rule fires, and whether it is suspicious."""
    sizes = clean.groupBy(group).agg(F.countDistinct("doc_id").alias("n_docs"))
    fired = findings.where(~F.col("rule_id").startswith("SUGGEST_")).select("doc_id", "rule_id").distinct().join(clean.select("doc_id", group).distinct(), "doc_id")
    counts = fired.groupBy(group, "rule_id").agg(F.count(F.lit(1)).alias("docs"))
    share = F.round(F.col("docs") / F.col("n_docs"), 6)
    return counts.join(F.broadcast(sizes), group).select(group, "rule_id", "docs", share.alias("rate"), (share > flag_over).alias("flagged"))


def metrics(rows: DataFrame) -> DataFrame:
    """All single-number metrics in one row. The rows are computed once."""
    rows = stored(rows.select("label", "score", "abstained"))
    out = auroc(rows)
    for part in (pr_auc(rows), tpr_at_fpr(rows), ece(rows), brier(rows), risk_coverage(rows)):
        out = out.crossJoin(part)
    return out


def promotion(old: DataFrame, new: DataFrame, group: str = "subgroup", tolerance: float = 0.02) -> DataFrame:
    """Whether new scores may replace the old: no worse in TPR at 1 % FPR, nor in any group's FPR, beyond the tolerance."""
    old, new = (stored(x.select("label", "score", "abstained", group)) for x in (old, new))
    a, b = tpr_at_fpr(old).select(F.col("tpr_at_01").alias("old_tpr")), tpr_at_fpr(new).select(F.col("tpr_at_01").alias("new_tpr"))
    before = subgroups(old, group).select(group, F.col("fpr").alias("old_fpr"))
    worse = subgroups(new, group).join(before, group, "left").agg(F.coalesce(F.bool_and(F.col("fpr") <= F.coalesce("old_fpr", "fpr") + tolerance), F.lit(True)).alias("fair"))
    return a.crossJoin(b).crossJoin(worse).select("old_tpr", "new_tpr", "fair", ((F.col("new_tpr") >= F.col("old_tpr") - tolerance) & F.col("fair")).alias("promote"))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return shared / F.nullif((a_end - a_start) + (b_end - b_start) - shared, F.lit(0))


def span_match(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """rows (pred and gold: arrays of struct<start, end>) with ``matched``, ``precision`` and ``recall``.

    Predictions take in order the first gold span left that is equal (or overlaps enough). Without predictions precision
    is 1 if there is no gold either; without gold recall is 1.
    """
    fits = (lambda p, g: F.coalesce(iou(p["start"], p["end"], g["start"], g["end"]) >= threshold, F.lit(False))) if threshold else (lambda p, g: (p["start"] == g["start"]) & (p["end"] == g["end"]))
    start = F.struct(F.col("gold").alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        hit = F.filter(F.transform(acc["left"], lambda g, i: F.when(fits(p, g), i)), lambda i: i.isNotNull())
        rest = F.filter(acc["left"], lambda g, i: i != F.get(hit, 0))
        return F.when(F.size(hit) > 0, F.struct(rest.alias("left"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    df = rows.withColumn("matched", F.aggregate("pred", start, step, lambda acc: acc["n"]))
    n_pred, n_gold = F.size("pred"), F.size("gold")
    return df.withColumns(
        {
            "precision": F.when(n_pred > 0, F.col("matched") / F.nullif(n_pred, F.lit(0))).when(n_gold == 0, 1.0).otherwise(0.0),
            "recall": F.when(n_gold > 0, F.col("matched") / F.nullif(n_gold, F.lit(0))).otherwise(1.0),
        }
    )
