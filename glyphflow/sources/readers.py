"""Manifests, id lists, reports, presets, dictionaries and images; predictions and reports written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "image_path string, text string, sample_id string, id string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: image_path, text, sample_id (else id); empty lines are skipped."""
    return spark.read.schema(MANIFEST).json(path).select("image_path", "text", F.coalesce("sample_id", "id").alias("sample_id"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """value: the distinct ids of a text file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as one row."""
    return spark.read.option("multiLine", True).json(path)


def preset(text: str) -> dict[str, dict[str, str]]:
    """The maps of a YAML preset: lines of two levels, keys and values plain or quoted."""
    out: dict[str, dict[str, str]] = {}
    name = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(": ") if ": " in line else (line.strip().rstrip(":"), "", "")
        unquote = lambda s: s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s
        if not value:
            name = unquote(key)
            out[name] = {}
        elif name is not None and line.startswith(" "):
            out[name][unquote(key)] = unquote(value.strip())
    return {k: v for k, v in out.items() if v}


def dictionary(spark: SparkSession, path: str, space: bool = False) -> DataFrame:
    """id, ch: the lines of a dictionary from 1 on, 0 is blank, and a space at the end if asked for and missing.

    Ids follow the order of lines in the file, which is read as one row.
    """
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    rows = spark.read.text(path, wholetext=True).select(F.concat(F.array(F.lit("blank")), lines).alias("chars"))
    if space:
        rows = rows.select(F.when(F.array_contains("chars", " "), F.col("chars")).otherwise(F.concat("chars", F.array(F.lit(" ")))).alias("chars"))
    return rows.select(F.posexplode("chars").alias("id", "ch"))


def _png(data: bytes) -> np.ndarray:
    """Rows of BGR bytes of a PNG of 8-bit gray or RGB, without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (0, 2) or interlaced:
                raise ValueError("only 8-bit gray and RGB without interlacing")
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    n = 3 if colour == 2 else 1
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(w * n, int)
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(w, n), 0) & 255).ravel()
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            now = np.zeros(w * n, int)
            for x in range(w * n):
                left, corner = (now[x - n], up[x - n]) if x >= n else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                now[x] = (line[x] + guess) & 255
            out[y] = now
    pixels = out.reshape(h, w, n)
    return np.ascontiguousarray(np.repeat(pixels, 3, 2) if n == 1 else pixels[:, :, ::-1])


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, h, w, pixels (BGR bytes) and error of the PNG files of a folder; a broken file has an error and no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    image = _png(bytes(data))
                    rows.append((name, *image.shape[:2], image.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "pixels", "error"]).astype({"h": "Int64", "w": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, h long, w long, pixels binary, error string")


def image_pixels(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, p, y, x and the three channels of each pixel of images()."""
    at = rows.where("pixels is not null").select(key, "w", "pixels", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("p"))
    channel = lambda k: F.conv(F.hex(F.substring("pixels", (F.col("p") * 3 + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return at.select(key, "p", F.expr("p div w").alias("y"), (F.col("p") % F.col("w")).alias("x"), channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))


def numbered(df: DataFrame, order: Column, per: Column | None = None) -> DataFrame:
    """df with n, from 0 in an order, within a group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(per if per is not None else F.lit(0)).orderBy(order)) - 1)


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines: sample_id, reference, prediction, both normalised, edited."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report's row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("errorifexists").text(path)
