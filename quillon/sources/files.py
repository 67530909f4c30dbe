"""Labelled matrices from files: (id, features, labels) tables read by Spark's own readers."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUTS = ("first", "last")


def encode(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Add the rank, from 0, of a string among the sorted distinct ones; only the distinct values are sorted."""
    codes = df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")


def read_delimited(spark: SparkSession, path: str, separator: str = ",", labels: int = 1, at: str = "last", drop: tuple[int, ...] = (), missing: str = "?") -> DataFrame:
    """(id, features, labels) of a text table without header.

    ``separator``: a regular expression, such as ``\\s+`` for aligned text.  The
    first or last ``labels`` fields are the labelings (strings); fields in
    ``drop`` (by position, from 0) are ignored.  Blank lines, and lines with a
    missing or non-numeric feature, are left out.  ids grow with the line's
    place in the input but have gaps.
    """
    if at not in LAYOUTS:
        raise ValueError(f"labels are at one of {LAYOUTS}")
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.filter(F.split(F.trim("value"), separator), lambda x, k: ~k.isin(*drop) if drop else F.lit(True))
    parts = lines.select(F.monotonically_increasing_id().alias("id"), fields.alias("f"))
    n = F.size("f")
    found = F.slice("f", 1, labels) if at == "first" else F.slice("f", n - labels + 1, F.lit(labels))
    rest = F.slice("f", F.lit(labels + 1), n - labels) if at == "first" else F.slice("f", F.lit(1), n - labels)
    numbers = F.transform(rest, lambda x: F.when(F.trim(x) == missing, None).otherwise(F.trim(x).try_cast("double")))
    rows = parts.where(n > labels).select("id", numbers.alias("features"), F.transform(found, F.trim).alias("labels"))
    return rows.where(~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def read_series(spark: SparkSession, path: str, at: str = "first") -> DataFrame:
    """Time-series text: blanks, commas or colons between values; lines that start with @ or # are comments."""
    lines = spark.read.text(path).where(~F.ltrim("value").rlike("^[@#]") & (F.trim("value") != ""))
    values = F.transform(F.split(F.trim("value"), r"[,:\s]+"), lambda x: x.try_cast("double"))
    parts = lines.select(F.monotonically_increasing_id().alias("id"), values.alias("v"))
    n = F.size("v")
    label = F.element_at("v", 1 if at == "first" else -1)
    rest = F.slice("v", F.lit(2), n - 1) if at == "first" else F.slice("v", F.lit(1), n - 1)
    return parts.where(n > 1).select("id", rest.alias("features"), label.cast("int").alias("label")).where(~F.exists("features", lambda x: x.isNull()))


def read_npz(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """(file, split, row, features, labels) of npz archives with <split>_images and <split>_labels arrays.

    One archive is opened in one task; its rows leave in batches.
    """
    splits = ("train", "val", "test") if subset == "all" else (subset,)

    def unpack(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for split in splits:
                        if f"{split}_images" not in held:
                            continue
                        x, y = held[f"{split}_images"], held[f"{split}_labels"]
                        x, y = x.reshape(len(x), -1), y.reshape(len(y), -1)
                        for k in range(0, len(x), 1024):
                            xs, ys = x[k : k + 1024].astype(float), y[k : k + 1024].astype("int32")
                            yield pd.DataFrame({"file": file, "split": split, "row": np.arange(k, k + len(xs)), "features": list(xs), "labels": list(ys)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "file string, split string, row long, features array<double>, labels array<int>")


def keep_evenly(frames: DataFrame, ratio: float, group: str, order: str) -> DataFrame:
    """Without int(n - ratio n) evenly spaced rows of each group (frames of a video)."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be over 0 and at most 1")
    w = Window.partitionBy(group)
    ranked = frames.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    drop = F.floor(F.col("__n") - F.lit(ratio) * F.col("__n"))
    step = lambda k: F.floor(k * F.col("__n") / drop)
    k = F.ceil(F.col("__i") * drop / F.col("__n"))
    hit = (drop > 0) & (k < drop) & (step(k) == F.col("__i"))
    return ranked.where(~F.coalesce(hit, F.lit(False))).drop("__i", "__n")


def write_labels(df: DataFrame, path: str) -> None:
    """Text labels, one row a point, with a header; the folder gets one file a partition."""
    df.write.mode("errorifexists").csv(path, header=True)
