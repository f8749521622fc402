"""Gridded detail: cells, gap filling, smoothing and log histograms of located values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(points: DataFrame, group: str, cell: float, most: int = 200) -> DataFrame:
    """(group, x0, y0, size, nx, ny): the grid of each group; cells grow where more than `most` would be needed."""
    b = points.groupBy(group).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    size = F.greatest(F.lit(float(cell)), F.greatest(w, h) / most)
    n = lambda side: F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(side / F.col("size")))).cast("int")
    return b.withColumn("size", size).withColumns({"nx": n(w), "ny": n(h)}).select(group, "x0", "y0", "size", "nx", "ny")


def cells(points: DataFrame, group: str, grid: DataFrame) -> DataFrame:
    """(group, gx, gy, v, n): the median of the values in each cell. points: group, x, y, v."""
    at = lambda c, o, n: F.least(F.col(n) - 1, F.floor((F.col(c) - F.col(o)) / F.col("size"))).cast("int")
    rows = points.join(grid, group).withColumns({"gx": at("x", "x0", "nx"), "gy": at("y", "y0", "ny")})
    return rows.groupBy(group, "gx", "gy").agg(F.median("v").alias("v"), F.count("*").alias("n"))


def fill(known: DataFrame, group: str, grid: DataFrame, passes: int = 2, least: int = 3) -> DataFrame:
    """Cells and the gaps between them that have at least `least` of eight neighbours, as their median.

    Each pass sees only what the pass before left. Every cell gives its value to its neighbours; nothing is laid out densely.
    """
    around = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    have = known.select(group, "gx", "gy", "v")
    for _ in range(passes):
        near = have.select(group, F.explode(around).alias("c"), "v").select(group, "c.*", "v")
        gaps = near.groupBy(group, "gx", "gy").agg(F.median("v").alias("v"), F.count("*").alias("k")).where(F.col("k") >= least).drop("k")
        gaps = gaps.join(have.select(group, "gx", "gy"), [group, "gx", "gy"], "left_anti").join(grid.select(group, "nx", "ny"), group)
        have = have.unionByName(gaps.where("gx >= 0 and gy >= 0 and gx < nx and gy < ny").select(group, "gx", "gy", "v"))
    return have


def smooth(known: DataFrame, group: str, grid: DataFrame, passes: int = 3) -> DataFrame:
    """Cells smoothed by box blurs of value and mask (3 x 3, edges repeated); a group has at most the grid's cells."""
    kind = dict(known.dtypes)[group]

    def blur(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1, mode="edge")
        rows = p[:-2] + p[1:-1] + p[2:]
        return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(pdf["nx"].iat[0]), int(pdf["ny"].iat[0])
        value, mask = np.zeros((nx, ny)), np.zeros((nx, ny))
        value[pdf["gx"], pdf["gy"]] = pdf["v"]
        mask[pdf["gx"], pdf["gy"]] = 1
        for _ in range(passes):
            value, mask = blur(value), blur(mask)
        v = value[pdf["gx"], pdf["gy"]] / mask[pdf["gx"], pdf["gy"]]
        return pd.DataFrame({"g": pdf["g"], "gx": pdf["gx"], "gy": pdf["gy"], "v": v})

    rows = known.join(grid.select(group, "nx", "ny"), group).withColumnRenamed(group, "g").select("g", "gx", "gy", "v", "nx", "ny")
    return rows.groupBy("g").applyInPandas(run, f"g {kind}, gx int, gy int, v double").withColumnRenamed("g", group)


def nearest_ranks(points: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each share): the values at floor(share * n) of each group's sorted values.

    Value counts are sorted, not rows, so ties cost nothing.
    """
    w = Window.partitionBy(group)
    ranked = points.select(group, F.col(value).alias("v")).where("v is not null").groupBy(group, "v").agg(F.count("*").alias("k"))
    ranked = ranked.withColumns({"upto": F.sum("k").over(w.orderBy("v")), "total": F.sum("k").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))), F.col("v")))
    return ranked.groupBy(group).agg(F.max("total").alias("n"), *[at(q).alias(c) for c, q in shares.items()])


def log_histogram(points: DataFrame, group: str, value: str, bins: int = 24) -> DataFrame:
    """(group, lo, hi, n, hist): counts in bins of equal log width between the 2nd and 98th percentile.

    What lies outside is counted in the outer bins; empty bins are zero.
    """
    rows = points.select(group, F.col(value).alias("v")).where("v is not null")
    w = Window.partitionBy(group)
    ranked = rows.groupBy(group, "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(w.orderBy("v"))
    ranked = ranked.withColumns({"upto": upto, "total": F.sum("k").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))), F.col("v")))
    ends = ranked.groupBy(group).agg(F.greatest(at(0.02), F.lit(1)).cast("double").alias("lo"), F.greatest(at(0.98), F.lit(2)).cast("double").alias("hi"))
    pos = F.when(F.col("hi") > F.col("lo"), F.log(F.greatest(F.col("v"), F.lit(1)) / F.col("lo")) / F.log(F.col("hi") / F.col("lo")) * bins).otherwise(0.0)
    # towards zero, then into the outer bins
    bin_no = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.when(pos < 0, F.ceil(pos)).otherwise(F.floor(pos)))).cast("int")
    per = ranked.join(ends, group).groupBy(group, "lo", "hi", bin_no.alias("b")).agg(F.sum("k").alias("k"))
    table = per.groupBy(group, "lo", "hi").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("b", "k"))).alias("m"))
    return table.select(group, "lo", "hi", "n", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("hist"))


def share_below(budget: Column, bins: int = 24) -> Column:
    """The share of values at most `budget`, read from a histogram's columns lo, hi, n, hist by interpolation."""
    pos = F.log(budget / F.col("lo")) / F.log(F.col("hi") / F.col("lo")) * bins
    k = F.floor(pos).cast("int")
    full = F.aggregate(F.slice("hist", F.lit(1), F.greatest(F.lit(0), k)), F.lit(0).cast("long"), lambda a, x: a + x)
    inside = (full + F.element_at("hist", k + 1) * (pos - k)) / F.col("n")
    low = F.element_at("hist", 1) / F.col("n") * budget / F.col("lo")
    return F.when(budget >= F.col("hi"), F.lit(1.0)).when(budget <= F.col("lo"), low).otherwise(inside)
