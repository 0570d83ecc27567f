"""Positioned words to text, and thresholds over gray images. A page or an image is one unit of work; pages are dealt over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators.pages import boxes
from paperloom.sources.tables import read

RTL_LETTER = "[֐-ࣿיִ-﷿ﹰ-﻿]"
LETTER = "[A-Za-zÀ-ɏͰ-ϿЀ-ӿ֐-ࣿיִ-﷿ﹰ-﻿]"


def line_numbers(centres: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """The line of each word, words being sorted by centre: a word joins the line if its centre is within half the height of the taller of itself and the line's first word; the line's centre is its running mean."""
    out = np.zeros(len(centres), np.int64)
    line, mean, size, half = 0, centres[0], 1, halves[0]
    for i in range(1, len(centres)):
        if abs(centres[i] - mean) <= max(half, halves[i]):
            size += 1
            mean += (centres[i] - mean) / size
        else:
            line, mean, size, half = line + 1, centres[i], 1, halves[i]
        out[i] = line
    return out


def page_lines(words: DataFrame) -> DataFrame:
    """(page, line, text) of words (page, x, y, w, h, word). Lines mostly of right-to-left letters are read from the right.

    Only the banding looks at one word after another, so it alone is a grouped function.
    """

    def band(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(cx=f["x"] + f["w"] / 2, cy=f["y"] + f["h"] / 2).sort_values(["cy", "cx", "word"], kind="stable")
        return f[["page", "cx", "word"]].assign(line=line_numbers(f["cy"].to_numpy(), f["h"].to_numpy() / 2))

    good = words.select("page", "x", "y", "w", "h", F.trim("word").alias("word")).where("word <> ''")
    banded = good.groupBy("page").applyInPandas(band, "page long, cx double, word string, line long")
    line = banded.groupBy("page", "line").agg(F.sort_array(F.collect_list(F.struct("cx", "word"))).alias("left"))
    joined = F.array_join(F.transform("left", lambda x: x["word"]), "")
    letters, rtl = F.regexp_count(joined, F.lit(LETTER)), F.regexp_count(joined, F.lit(RTL_LETTER))
    order = F.when((letters > 0) & (rtl * 2 > letters), F.reverse("left")).otherwise(F.col("left"))
    return line.select("page", "line", F.array_join(F.transform(order, lambda x: x["word"]), " ").alias("text"))


def page_texts(words: DataFrame) -> DataFrame:
    """(page, text): a page's lines in order."""
    lines = page_lines(words).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return lines.select("page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def percentiles(histogram: DataFrame, share: float) -> DataFrame:
    """(image, value): the first bin at which the running count reaches ``share`` of the pixels, rounded."""
    upto = F.sum("n").over(Window.partitionBy("image").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("image"))
    reached = histogram.withColumn("upto", upto).withColumn("target", F.round(total * share)).where("upto >= target")
    return reached.groupBy("image").agg(F.min("bin").alias("value"))


def sauvola(gray: np.ndarray, window: int = 25, k: float = 0.2, spread: float = 128.0) -> np.ndarray:
    """255 where a pixel is above its window's mean * (1 + k * (deviation / spread - 1)), else 0; windows are cut at the edges."""
    height, width = gray.shape
    half = min(max(window // 2, 1), max(height, width))
    top, left = np.maximum(np.arange(height) - half, 0), np.maximum(np.arange(width) - half, 0)
    bottom, right = np.minimum(np.arange(height) + half, height - 1) + 1, np.minimum(np.arange(width) + half, width - 1) + 1

    def window_sum(x: np.ndarray) -> np.ndarray:
        total = np.zeros((height + 1, width + 1))
        total[1:, 1:] = x.cumsum(0).cumsum(1)
        rows = total[bottom] - total[top]
        return rows[:, right] - rows[:, left]

    n = np.outer(bottom - top, right - left)
    values = gray.astype(float)
    mean = window_sum(values) / n
    deviation = np.sqrt(np.maximum(window_sum(values * values) / n - mean * mean, 0))
    return np.where(values > mean * (1 + k * (deviation / spread - 1)), 255, 0)


def binarised(images: DataFrame, window: int = 25) -> DataFrame:
    """Adds ``binary`` to images (width, height, gray array); null where the sizes do not agree."""

    @F.pandas_udf("array<int>")
    def run(width: pd.Series, height: pd.Series, gray: pd.Series) -> pd.Series:
        return pd.Series([sauvola(np.asarray(g).reshape(h, w), window).ravel().tolist() if g is not None and w * h == len(g) > 0 else None for w, h, g in zip(width, height, gray)])

    return images.withColumn("binary", run("width", "height", "gray"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes(spark, sf_dir)[0]
    return page_texts(words).select("page", F.length("text").cast("long").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2nd percentile of each brand's gray values, as for stretching contrast."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("image"), (F.col("p_retailprice").cast("long") % 256).alias("bin"))
    return percentiles(p.groupBy("image", "bin").agg(F.count(F.lit(1)).alias("n")), 0.02)


def binarise_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray rows of one pixel in height; how many pixels are white."""
    e = read(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda v: F.pmod((v * 1000).cast("int"), F.lit(256)))
    rows = e.select("vec_id", F.size("embedding").alias("width"), F.lit(1).alias("height"), gray.alias("gray"))
    return binarised(rows, 9).select("vec_id", F.size(F.filter("binary", lambda x: x == 255)).cast("long").alias("white"))


QUERIES = {f.__name__: f for f in (page_text, price_percentiles, binarise_vectors)}
ORACLE_SQL = {
    "price_percentiles": "WITH n AS (SELECT p_brand AS image, CAST(floor(p_retailprice) AS BIGINT) % 256 AS bin, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT image, bin, sum(n) OVER (PARTITION BY image ORDER BY bin) AS upto, round(sum(n) OVER (PARTITION BY image) * 0.02::DOUBLE) AS target FROM n) SELECT image, min(bin) AS value FROM c WHERE upto >= target GROUP BY image",
}
