"""Inputs of the queries, derived from the tables at hand, each with the SQL of the same rows.

An embedding of 64 values is a probability map of 8 x 8 pixels, and a class posterior of 8 frames and 8 classes of which
class 0 is blank.  Boxes are made from the first values of 8 neighbouring embeddings, which make an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, p, y, x, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("image_id", "p", F.expr(f"p div {SIDE}").cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), F.col("v").cast("double").alias("v"))


PIXELS = f"""px AS (
  SELECT vec_id AS image_id, (i - 1)::INT AS p, ((i - 1) // {SIDE})::INT AS y, ((i - 1) % {SIDE})::INT AS x, embedding[i]::DOUBLE AS v
  FROM embeddings, range(1, {SIDE * SIDE + 1}) AS r(i))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_id, t, cls, v."""
    return pixels(spark, sf_dir).select(F.col("image_id").alias("roi_id"), F.col("y").alias("t"), F.col("x").alias("cls"), "v")


FRAMES = PIXELS + ",\nframes AS (SELECT image_id AS roi_id, y AS t, x AS cls, v FROM px)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, slot, quad (four corners: left top, right top, right bottom, left bottom, before turning), score, supplemental.

    Images lean by a multiple of 0.12, and the boxes of every second one by an angle of their own; some images have no
    base boxes.
    """
    e = lambda i: F.col("embedding")[i].cast("double")
    image = F.shiftright("vec_id", 3)
    rows = table(spark, sf_dir, "embeddings").select(
        image.alias("image_id"),
        (F.col("vec_id") % 8).cast("int").alias("slot"),
        F.round(40 + 300 * F.abs(e(0)), 3).alias("mx"),
        F.round(40 + 300 * F.abs(e(1)), 3).alias("my"),
        F.round(4 + 120 * F.abs(e(2)), 3).alias("w"),
        F.round(4 + 120 * F.abs(e(3)), 3).alias("h"),
        (0.12 * (image % 5 - 2) + F.when(image % 2 == 1, 0.4 * e(5)).otherwise(0.0)).alias("turn"),
        F.round(0.5 + e(4), 6).alias("score"),
        ((F.col("vec_id") % 3 == 2) | (image % 11 == 5)).alias("supplemental"),
    )
    cos, sin = F.cos("turn"), F.sin("turn")

    def corner(x, y):
        w, h = x * F.col("w"), y * F.col("h")
        return F.struct(F.round(F.col("mx") + (w * cos - h * sin) / 2, 3).alias("x"), F.round(F.col("my") + (w * sin + h * cos) / 2, 3).alias("y"))

    return rows.select("image_id", "slot", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("quad"), "score", "supplemental")


def _corner(name: str, x: int, y: int) -> str:
    return f"round(mx + ({x} * w * cos(turn) - {y} * h * sin(turn)) / 2, 3) AS {name}x, round(my + ({x} * w * sin(turn) + {y} * h * cos(turn)) / 2, 3) AS {name}y"


#: Corners a, j (b and y would make a keyword), c, d.
BOXES = f"""boxes AS (
  SELECT image_id, slot, {_corner('a', -1, -1)}, {_corner('j', 1, -1)}, {_corner('c', 1, 1)}, {_corner('d', -1, 1)}, score, supplemental FROM (
    SELECT vec_id >> 3 AS image_id, (vec_id % 8)::INT AS slot, round(40 + 300 * abs(embedding[1]::DOUBLE), 3) AS mx, round(40 + 300 * abs(embedding[2]::DOUBLE), 3) AS my,
      round(4 + 120 * abs(embedding[3]::DOUBLE), 3) AS w, round(4 + 120 * abs(embedding[4]::DOUBLE), 3) AS h, round(0.5 + embedding[5]::DOUBLE, 6) AS score,
      0.12::DOUBLE * ((vec_id >> 3) % 5 - 2) + CASE WHEN (vec_id >> 3) % 2 = 1 THEN 0.4::DOUBLE * embedding[6]::DOUBLE ELSE 0 END AS turn, vec_id % 3 = 2 OR (vec_id >> 3) % 11 = 5 AS supplemental
    FROM embeddings))"""


def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, reference and prediction: whole documents and benchmark items, in ASCII."""
    items = table(spark, sf_dir, "benchmark")
    n = items.agg(F.max("item_id") + 1).first()[0]
    fold = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("said"))
    return docs.join(items, docs.doc_id % n == items.item_id).select(F.col("doc_id").alias("sample_id"), fold("said").alias("reference"), fold("text").alias("prediction"))


OCR_PAIRS = """pairs AS (
  SELECT doc_id AS sample_id, regexp_replace(d.text, '[^ -~]', '?', 'g') AS reference, regexp_replace(b.text, '[^ -~]', '?', 'g') AS prediction
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id)"""
