"""Scores of predictions and reports of latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions import text

# Lengths of a report, in order.
BUCKETS = ("01", "02", "03-04", "05-08", "09-16", "17-32", "33-64", "65+")


def score(pairs: DataFrame, reference: Column, prediction: Column, subset: Column | None = None) -> DataFrame:
    """samples, exact_matches, edit_distance, reference_characters, em and cer over all rows, or those of a subset.

    Without rows, or without characters, the ratios are null.
    """
    rows = pairs.select(reference.alias("r"), prediction.alias("p"), (subset if subset is not None else F.lit(True)).alias("of")).where("of").select("r", "p", text.edits("r", "p").alias("d"))
    total = rows.agg(F.count("*").alias("samples"), F.count_if(F.col("r") == F.col("p")).alias("exact_matches"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("edit_distance"), F.coalesce(F.sum(F.length("r")), F.lit(0)).cast("long").alias("reference_characters"))
    return total.select("*", F.try_divide("exact_matches", "samples").alias("em"), F.try_divide("edit_distance", "reference_characters").alias("cer"))


def score_both(pairs: DataFrame, reference: Column, prediction: Column, subset: Column) -> DataFrame:
    """score() of all rows (population "all") and of the subset ("subset"), in one pass over the pairs."""
    rows = pairs.select(reference.alias("r"), prediction.alias("p"), F.coalesce(subset, F.lit(False)).alias("of")).select("r", "p", text.edits("r", "p").alias("d"), "of")
    rows = rows.withColumn("population", F.explode(F.when(F.col("of"), F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))))
    total = rows.groupBy("population").agg(F.count("*").alias("samples"), F.count_if(F.col("r") == F.col("p")).alias("exact_matches"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("edit_distance"), F.coalesce(F.sum(F.length("r")), F.lit(0)).cast("long").alias("reference_characters"))
    return total.select("*", F.try_divide("exact_matches", "samples").alias("em"), F.try_divide("edit_distance", "reference_characters").alias("cer"))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that leaves no ties: a feature of its own, not a sample."""
    return rows.orderBy(*order).limit(n)


def series(report: dict, value: str = "mean_ms") -> list[tuple[str, float]]:
    """The points of a report by length (bucket to its figures), in the order of lengths; buckets it lacks are left out."""
    return [(b, float(report[b][value])) for b in BUCKETS if b in report and report[b].get(value) is not None]


def predictions(pairs: DataFrame, normalise) -> DataFrame:
    """pairs with both texts normalised; a text that can't be normalised counts as an error with an empty prediction."""
    out = pairs.withColumn("normalized_reference", normalise(F.col("reference"))).withColumn("normalized_prediction", normalise(F.col("prediction")))
    failed = F.col("normalized_prediction").isNull() & F.col("prediction").isNotNull()
    return out.withColumn("error", failed).withColumn("normalized_prediction", F.coalesce("normalized_prediction", F.lit("")))


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 1, BUCKETS[0]).when(n <= 2, BUCKETS[1])
    for name, most in zip(BUCKETS[2:7], (4, 8, 16, 32, 64)):
        out = out.when(n <= most, name)
    return out.otherwise(BUCKETS[7])


def by_length(rows: DataFrame, ms: Column, n: Column) -> DataFrame:
    """bucket, place, samples, mean, median and percentiles (linear interpolation) of each length bucket."""
    percentile = lambda q, name: F.percentile("ms", F.lit(q)).alias(name)
    found = rows.select(ms.alias("ms"), length_bucket(n).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("samples"), F.avg("ms").alias("mean_ms"), percentile(0.5, "median_ms"), percentile(0.9, "p90_ms"), percentile(0.95, "p95_ms"), percentile(0.99, "p99_ms"))
    return found.withColumn("place", F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")))


def trend(rows: DataFrame, ms: Column, n: Column) -> DataFrame:
    """The linear slope over lengths 1 to 64, the correlation and the median over all."""
    near = F.when(n.between(1, 64), n.cast("double"))
    return rows.agg(F.regr_slope(F.when(near.isNotNull(), ms), near).alias("slope"), F.corr(n.cast("double"), ms).alias("correlation"), F.median(ms).alias("median_ms"))


def nearest_p90(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """groups and p90: the value at position max(int(0.9 n) - 1, 0) of the group's sorted ones, which is none of the usual
    percentiles; counted and ranked, so that no group is held in one row."""
    order = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(value)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    ranked = rows.where(F.col(value).isNotNull()).select(*groups, value, F.row_number().over(order).alias("__at"), F.count("*").over(whole).alias("__n"))
    return ranked.where(F.col("__at") == F.greatest(F.lit(1), F.floor(F.col("__n") * 0.9))).select(*groups, F.col(value).alias("p90"))


def speed(batches: DataFrame, ms: Column, items: Column, prediction: Column) -> DataFrame:
    """Mean, median and 90th of a batch's time, time of an item, throughput and predictions that aren't empty.

    The times of one report, not of a corpus, are ranked together.
    """
    rows = batches.select(ms.alias("ms"), items.alias("items"), prediction.alias("prediction"))
    total = rows.agg(F.avg("ms").alias("batch_mean_ms"), F.median("ms").alias("batch_p50_ms"), F.sum("ms").alias("ms"), F.sum("items").cast("long").alias("items"), F.count_if(F.col("prediction") != "").alias("nonempty_predictions"))
    total = total.join(nearest_p90(rows, "ms").withColumnRenamed("p90", "batch_p90_ms"), how="left")  # a row each
    return total.select("batch_mean_ms", "batch_p50_ms", "batch_p90_ms", F.try_divide("ms", "items").alias("per_item_ms"), F.try_divide(F.col("items") * 1000.0, F.col("ms")).alias("items_per_second"), "nonempty_predictions")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str) -> DataFrame:
    """left with its row of right, the last by order of those with one key; a missing row raises an error when it is read."""
    last = right.groupBy(F.col(right_key).alias("__key")).agg(F.max(F.struct(order, *[c for c in right.columns if c not in (order, right_key)])).alias("__row"))
    joined = left.join(last, left[left_key] == last["__key"], "left")
    found = F.when(F.col("__key").isNull(), F.raise_error(F.lit("a key has no row"))).otherwise(F.col("__row"))
    return joined.withColumn("__row", found).select(*left.columns, "__row.*")


def sampled(rows: DataFrame, key: Column, n: int, seed: int = 20260907) -> DataFrame:
    """n rows (all if there are fewer) chosen by a seeded hash of their key: the same for any order and number of partitions."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
