"""Class posteriors over frames: collapsing, cells with their evidence, gates and the risk lookup.

Frames are long rows (roi_id, t, cls, v); a region is one group of roi_id, and everything here needs one exchange on it.
Class 0 is blank.  Ties go to the lowest class, the earliest frame and the lowest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = 0


def labels(frames: DataFrame) -> DataFrame:
    """roi_id, t, label and score: the likeliest class of each frame."""
    best = F.min(F.struct((-F.col("v")).alias("v"), F.col("cls")))
    return frames.groupBy("roi_id", "t").agg(best.alias("best")).select("roi_id", "t", F.col("best.cls").alias("label"), (-F.col("best.v")).alias("score"))


def runs(best: DataFrame) -> DataFrame:
    """The frames of runs of one class, with cell (the number of the run, from 0) and first (whether it starts there)."""
    at = Window.partitionBy("roi_id").orderBy("t")
    first = (F.col("label") != BLANK) & (F.col("label") != F.lag("label", 1, -1).over(at))
    marked = best.withColumn("first", first)
    cell = F.sum(F.col("first").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.withColumn("cell", cell.cast("int")).where(F.col("label") != BLANK)


def collapsed(frames: DataFrame) -> DataFrame:
    """roi_id, token_ids, token_count and confidence (mean score of the first frames of runs, 0 without) of each region."""
    starts = runs(labels(frames)).where("first").groupBy("roi_id").agg(F.array_sort(F.collect_list(F.struct("cell", "label"))).alias("tokens"), F.avg("score").alias("confidence"))
    every = frames.select("roi_id").distinct()
    tokens = F.coalesce(F.transform("tokens", lambda z: z["label"]), F.array().cast("array<int>"))
    return every.join(starts, "roi_id", "left").select("roi_id", tokens.alias("token_ids"), F.size(tokens).cast("long").alias("token_count"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def peaks(frames: DataFrame) -> DataFrame:
    """roi_id, cell, label, peak_t, peak and the frames (low to high) nearest to the peak; a frame between goes to the earlier cell."""
    best = F.max(F.struct("score", (-F.col("t")).alias("t")))
    top = runs(labels(frames)).groupBy("roi_id", "cell", "label").agg(best.alias("best")).select("roi_id", "cell", "label", (-F.col("best.t")).alias("peak_t"), F.col("best.score").alias("peak"))
    at = Window.partitionBy("roi_id").orderBy("cell")
    low = F.floor((F.lag("peak_t").over(at) + F.col("peak_t")) / 2) + 1
    high = F.floor((F.col("peak_t") + F.lead("peak_t").over(at)) / 2)
    return top.withColumn("low", F.coalesce(low, F.lit(0)).cast("int")).withColumn("high", F.coalesce(high, F.lit(2**31 - 1)).cast("int"))


def cell_frames(frames: DataFrame) -> DataFrame:
    """Every frame's classes with the cell whose peak is nearest, and that cell's label."""
    owned = peaks(frames).select("roi_id", "cell", "label", "low", "high")
    return frames.join(owned, "roi_id").where(F.col("t").between(F.col("low"), F.col("high"))).select("roi_id", "cell", "label", "t", "cls", "v")


def candidates(frames: DataFrame, most: int = 16) -> DataFrame:
    """roi_id, cell, cls, p, rank: the best non-blank classes of each cell, from the best of each frame."""
    by_frame = Window.partitionBy("roi_id", "cell", "t").orderBy(F.desc("v"), "cls")
    near = cell_frames(frames).where(F.col("cls") != BLANK).withColumn("r", F.row_number().over(by_frame)).where(F.col("r") <= most)
    best = near.groupBy("roi_id", "cell", "cls").agg(F.max("v").alias("p"))
    by_cell = Window.partitionBy("roi_id", "cell").orderBy(F.desc("p"), "cls")
    return best.withColumn("rank", F.row_number().over(by_cell)).where(F.col("rank") <= most)


def evidence(frames: DataFrame) -> DataFrame:
    """roi_id, cell, label, margin of the two best classes, log_margin of their logarithms, keep_rank (rank of the label, 0 if it is none of them), and blank max and mean of each cell."""
    ranked = candidates(frames)
    margins = ranked.groupBy("roi_id", "cell").agg(F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("p"))).alias("two"), F.collect_list(F.struct("cls", "rank")).alias("ranks"))
    blank = cell_frames(frames).where(F.col("cls") == BLANK).groupBy("roi_id", "cell", "label").agg(F.max("v").alias("blank_max"), F.avg("v").alias("blank_mean"))
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-30)))
    keep = F.coalesce(F.filter("ranks", lambda z: z["cls"] == F.col("label"))[0]["rank"], F.lit(0))
    return blank.join(margins, ["roi_id", "cell"]).select("roi_id", "cell", "label", (F.col("one") - F.col("two")).alias("margin"), (log("one") - log("two")).alias("log_margin"), keep.alias("keep_rank"), "blank_max", "blank_mean")


def posterior(frames: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """frames as probabilities: if any value is negative or any frame's sum is off 1, a softmax of every frame."""
    sums = frames.groupBy("roi_id", "t").agg(F.min("v").alias("low"), F.sum("v").alias("sum"))
    off = sums.agg(F.bool_or((F.col("low") < 0) | (F.abs(F.col("sum") - 1) > tolerance)).alias("off"))  # one row
    frame = Window.partitionBy("roi_id", "t")
    raised = F.exp(F.col("v") - F.max("v").over(frame))
    soft = frames.withColumn("soft", raised).withColumn("soft", F.col("soft") / F.sum("soft").over(frame))
    return soft.join(F.broadcast(off)).select("roi_id", "t", "cls", F.when(F.coalesce("off", F.lit(False)), F.col("soft")).otherwise(F.col("v")).alias("v"))


def consistent(a: DataFrame, b: DataFrame, thresholds: tuple[float, ...] = (0.995,) * 6) -> DataFrame:
    """roi_id, accepted: two views collapse to the same 1 to len(thresholds) tokens and both reach the threshold of that length."""
    two = b.select("roi_id", F.col("token_ids").alias("other"), F.col("confidence").alias("other_confidence"))
    least = F.element_at(F.array(*map(F.lit, thresholds)), F.least(F.greatest(F.size("token_ids"), F.lit(1)), F.lit(len(thresholds))))
    fit = F.col("token_ids").eqNullSafe(F.col("other")) & F.size("token_ids").between(1, len(thresholds))
    return a.join(two, "roi_id").select("roi_id", (fit & (F.col("confidence") >= least) & (F.col("other_confidence") >= least)).alias("accepted"))


def bucket(value: Column, edges: tuple[float, ...]) -> Column:
    """How many edges are at most value."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


# Counts by whether two views agree, confidence bucket (rows) and length bucket (columns), of text and of other crops.
CONFIDENCE_EDGES, LENGTH_EDGES = (0.80, 0.95, 0.995), (2, 3, 5)
TEXT = {False: [[4, 1, 1, 1], [1, 2, 0, 9], [0, 0, 0, 5], [0, 0, 0, 0]], True: [[4, 0, 0, 1], [2, 1, 2, 5], [2, 2, 5, 2], [19, 16, 4, 2]]}
OTHER = {False: [[533, 334, 191, 16], [17, 14, 8, 0], [2, 0, 0, 0], [0, 0, 0, 0]], True: [[121, 20, 5, 0], [28, 13, 4, 1], [18, 1, 1, 0], [4, 2, 0, 0]]}


def calibration() -> list[tuple[bool, int, int, int, int]]:
    """same, conf_bucket, len_bucket, text_n, nontext_n of all cells."""
    return [(s, c, n, TEXT[s][c][n], OTHER[s][c][n]) for s in (False, True) for c in range(4) for n in range(4)]


def hallucination(a: DataFrame, b: DataFrame, prior: float = 0.5, smoothing: float = 1.0) -> DataFrame:
    """roi_id, rate: the smoothed odds that a region isn't text, by agreement, least confidence and length; 0 without output."""
    if not 0 < prior < 1:
        raise ValueError("prior must lie between 0 and 1")
    spark = a.sparkSession
    cells = calibration()
    text, other = (sum(r[k] for r in cells) + smoothing * len(cells) for k in (3, 4))
    dim = spark.createDataFrame([(s, c, n, (o + smoothing) / other / ((t + smoothing) / text)) for s, c, n, t, o in cells], "same boolean, conf_bucket int, len_bucket int, ratio double")
    two = b.select("roi_id", F.col("token_ids").alias("other"), F.col("confidence").alias("other_confidence"))
    both = a.join(two, "roi_id").select(
        "roi_id",
        F.size("token_ids").alias("n"),
        F.col("token_ids").eqNullSafe(F.col("other")).alias("same"),
        bucket(F.least("confidence", "other_confidence"), CONFIDENCE_EDGES).alias("conf_bucket"),
        bucket(F.size("token_ids"), LENGTH_EDGES).alias("len_bucket"),
    )
    odds = F.col("ratio") * prior
    return both.join(F.broadcast(dim), ["same", "conf_bucket", "len_bucket"]).select("roi_id", F.when(F.col("n") == 0, 0.0).otherwise(odds / (odds + 1 - prior)).alias("rate"))


def supplement_gate(regions: DataFrame, allowed: list[int], confidence: float = 0.70, area: float = 0.075, distance: float = 50.0) -> DataFrame:
    """regions with accepted: ordinary ones pass, supplemental ones by labels, confidence, area and distance; a fallback passes with any output.

    regions: token_ids, confidence, supplemental, fallback, area_ratio, distance.
    """
    some = F.size("token_ids") > 0
    fit = some & F.forall("token_ids", lambda x: x.isin(allowed)) & (F.col("confidence") >= confidence) & (F.col("area_ratio") >= area) & (F.col("distance") <= distance)
    return regions.withColumn("accepted", F.when(F.col("fallback"), some).otherwise(~F.col("supplemental") | fit))


def scattered(slots: DataFrame, results: DataFrame) -> DataFrame:
    """Each slot (image_id, slot) with its row of results (image_id, slot, token_ids, confidence); without one it has no tokens and confidence 0."""
    out = slots.join(results, ["image_id", "slot"], "left")
    return out.withColumn("valid", F.col("token_ids").isNotNull()).withColumn("token_ids", F.coalesce("token_ids", F.array().cast(results.schema["token_ids"].dataType))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def packed(cells: DataFrame) -> DataFrame:
    """image_id, position (from 0, over regions in order and their cells) and starts (first cell of a region); cells: image_id, roi, cell."""
    image = Window.partitionBy("image_id").orderBy("roi", "cell")
    region = Window.partitionBy("image_id", "roi").orderBy("cell")
    return cells.withColumn("position", F.row_number().over(image) - 1).withColumn("starts", F.row_number().over(region) == 1)


def placed(cells: DataFrame) -> DataFrame:
    """packed() with the relative position from either end, the log of the length and flags of the first and last cell of each image."""
    whole = Window.partitionBy("image_id")
    out = packed(cells).withColumn("n", F.count("*").over(whole))
    return out.select("*", (F.col("position") / F.col("n")).alias("ahead"), ((F.col("n") - 1 - F.col("position")) / F.col("n")).alias("behind"), (F.log1p("n") / F.log(F.lit(129.0))).alias("length"), (F.col("position") == 0).alias("is_first"), (F.col("position") == F.col("n") - 1).alias("is_last"))
