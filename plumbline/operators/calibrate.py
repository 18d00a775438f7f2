"""A writer's own baseline: statistics of each dimension, and deviations from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.stored import stored
from plumbline.settings import DIMENSIONS

MIN_WORDS, ROBUST_BELOW, MAD_TO_STD = 50, 50, 1.4826


def long(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    return scored.unpivot([key], list(DIMENSIONS), "dimension", "value")


def medians(values: DataFrame, bins: int = 4096) -> DataFrame:
    """(dimension, median) of rows (dimension, value between 0 and 1), exactly and without bringing a dimension's values to one task.

    A histogram tells the bins that hold the middle ranks; only the distinct values in them are ordered.
    """
    binned = values.where("value is not null").withColumn("bin", F.floor(F.col("value") * bins))
    w = Window.partitionBy("dimension")
    counts = binned.groupBy("dimension", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("dimension", "bin", "n", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = counts.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low)).select("dimension", "bin", "before", "total")
    near = binned.join(F.broadcast(middle), ["dimension", "bin"]).groupBy("dimension", "bin", "before", "total", "value").agg(F.count(F.lit(1)).alias("n"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy("dimension", "bin").orderBy("value")) - F.col("n")
    at = lambda rank: F.max(F.when((F.col("start") <= rank) & (F.col("start") + F.col("n") > rank), F.col("value")))
    return near.withColumn("start", start).groupBy("dimension").agg(((at(low) + at(high)) / 2).alias("median"))


def profile(scored: DataFrame, name: str = "own", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each dimension: mean, std (population), median, mad; robust says that there are under 50 documents.

    Documents of fewer words than min_words don't count. Without any there are no rows. The scored documents'
    dimensions are written once and read three times.
    """
    used = stored(scored.where(F.col("w") >= min_words).select(F.lit(0).alias("_"), *DIMENSIONS))
    whole = used.agg(F.count(F.lit(1)).alias("n_docs"), *(f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
    first = whole.select("n_docs", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"mean_{d}").alias("mean"), F.col(f"std_{d}").alias("std")) for d in DIMENSIONS))).alias("x"))
    first = first.where("n_docs > 0").select("x.dimension", "n_docs", "x.mean", "x.std")
    values = long(used, "_").select("dimension", "value")
    middle = medians(values)
    spread = medians(values.join(F.broadcast(middle), "dimension").select("dimension", F.abs(F.col("value") - F.col("median")).alias("value"))).withColumnRenamed("median", "mad")
    return first.join(F.broadcast(middle), "dimension").join(F.broadcast(spread), "dimension").select(
        F.lit(name).alias("profile_name"), "dimension", "n_docs", "mean", "std", "median", "mad", (F.col("n_docs") < ROBUST_BELOW).alias("robust")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """A profile that was written as Parquet; any other table is refused."""
    df = spark.read.parquet(path)
    if missing := {"dimension", "n_docs", "mean", "std", "median", "mad", "robust"} - set(df.columns):
        raise ValueError(f"{path} isn't a profile: no {', '.join(sorted(missing))}")
    return df


def zscore(value: Column, mean: Column, std: Column, median: Column, mad: Column, robust: Column) -> Column:
    """Clamped to 3 either way; where the baseline doesn't vary, 0 or 3."""
    center = F.when(robust, median).otherwise(mean)
    scale = F.when(robust, mad * MAD_TO_STD).otherwise(std)
    off = value - center
    flat = F.when(F.abs(off) <= 1e-6, 0.0).otherwise(3.0 * F.signum(off))
    return F.round(F.when(scale <= 1e-9, flat).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), off / F.when(scale > 1e-9, scale)))), 2)


def deviations(scored: DataFrame, baseline: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document and dimension of the baseline (14 rows, hence broadcast)."""
    stats = F.broadcast(baseline.select("dimension", "mean", "std", "median", "mad", "robust"))
    z = zscore(*(F.col(c) for c in ("value", "mean", "std", "median", "mad", "robust")))
    return long(scored, key).join(stats, "dimension").select(key, "dimension", z.alias("z"))


def beside(scored: DataFrame, baseline: DataFrame, top: int = 5) -> DataFrame:
    """scored with ``deviations``: the dimensions that differ most from the baseline, as an array of struct<dimension, z>, by the size of z and then by name."""
    stats = F.broadcast(baseline.groupBy().agg(F.collect_list(F.struct("dimension", "mean", "std", "median", "mad", "robust")).alias("_stats")))
    values = F.create_map(*(x for d in DIMENSIONS for x in (F.lit(d), F.col(d))))

    def one(b: Column) -> Column:
        return F.struct(b["dimension"].alias("dimension"), zscore(F.coalesce(values[b["dimension"]], F.lit(0.0)), *(b[c] for c in ("mean", "std", "median", "mad", "robust"))).alias("z"))

    ordered = F.array_sort(F.transform(F.transform("_stats", one), lambda x: F.struct((-F.abs(x["z"])).alias("order"), x["dimension"].alias("dimension"), x["z"].alias("z"))))
    return scored.crossJoin(stats).withColumn("deviations", F.transform(F.slice(ordered, 1, top), lambda x: x.dropFields("order"))).drop("_stats")
