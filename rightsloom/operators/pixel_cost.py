"""Embedding costs of pixels: high where an image is smooth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cost_table(pixels: DataFrame, max_cost: float, image: str = "image") -> DataFrame:
    """image, x, y, cost from rows (image, x, y, gray): each pixel meets its 3x3 neighbours by two sliding windows.

    Sums over three rows of columns, then over three columns, give mean and variance; edges have fewer neighbours.
    """
    cols = Window.partitionBy(image, "y").orderBy("x")
    rows = Window.partitionBy(image, "x").orderBy("y")
    by_x, by_y = cols.rowsBetween(-1, 1), rows.rowsBetween(-1, 1)
    g = F.col("gray").cast("double")
    t = pixels.withColumn("_g", g).withColumns({"_l": F.lag("_g").over(cols), "_r": F.lead("_g").over(cols), "_s": F.sum("_g").over(by_x), "_q": F.sum(F.col("_g") * F.col("_g")).over(by_x), "_n": F.count("*").over(by_x)})
    t = t.withColumns({"_u": F.lag("_g").over(rows), "_d": F.lead("_g").over(rows), "_s": F.sum("_s").over(by_y), "_q": F.sum("_q").over(by_y), "_n": F.sum("_n").over(by_y)})
    energy = sum((F.coalesce((F.col("_g") - F.col(c)) * (F.col("_g") - F.col(c)), F.lit(0.0)) for c in ("_l", "_r", "_u", "_d")), F.lit(0.0))
    complexity = energy + (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.col("_n")
    cost = F.when(complexity < 1, F.lit(float(max_cost))).otherwise(max_cost / F.sqrt(complexity))
    return t.select(image, "x", "y", cost.alias("cost"))


def cost_grid(gray: np.ndarray, max_cost: float) -> np.ndarray:
    """The same for one image in memory, by shifted copies."""
    g = gray.astype(np.float64)
    energy = np.zeros_like(g)
    for axis in (0, 1):
        d = np.diff(g, axis=axis) ** 2
        a = [slice(None)] * 2
        a[axis] = slice(1, None)
        energy[tuple(a)] += d
        a[axis] = slice(None, -1)
        energy[tuple(a)] += d
    def window(v):
        p = np.pad(v, 1)
        return sum(p[i : i + v.shape[0], j : j + v.shape[1]] for i in range(3) for j in range(3))
    n, s, q = window(np.ones_like(g)), window(g), window(g * g)
    complexity = energy + (q - s * s / n) / n
    return np.where(complexity < 1, max_cost, max_cost / np.sqrt(np.maximum(complexity, 1)))
