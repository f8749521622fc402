"""Percentiles of very large columns from mergeable sketches of randomised compactors.

A sketch holds levels of values; one at level h stands for 2^h rows. A full level is sorted and every other value,
from a random start, moves up. Sketches of parts, days or loads merge level by level. Each compaction of
weight w moves any rank by at most w in either direction with equal chance, so the sketch keeps the sum of w^2 and bounds
the error of any rank by Hoeffding's inequality.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHRINK = 2 / 3
TYPE = "n long, low double, high double, variance double, sizes array<int>, items array<double>"


class Sketch:
    """Levels of compactors; k is the capacity of the highest one, lower ones shrink by 2/3 each."""

    __slots__ = ("k", "n", "low", "high", "variance", "levels", "rng")

    def __init__(self, k: int, seed: int):
        self.k, self.n, self.low, self.high, self.variance = k, 0, math.inf, -math.inf, 0.0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.rng = np.random.default_rng(seed)

    def capacity(self, level: int) -> int:
        return max(8, int(math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - level))))

    def add(self, values: np.ndarray) -> None:
        for at in range(0, len(values), 4 * self.k):
            part = values[at : at + 4 * self.k]
            self.n += len(part)
            self.low, self.high = min(self.low, float(part.min())), max(self.high, float(part.max()))
            self.levels[0] = np.concatenate([self.levels[0], part])
            self.compact()

    def compact(self) -> None:
        """Compact the lowest full level until all fit."""
        h = 0
        while h < len(self.levels):
            own = self.levels[h]
            if len(own) <= self.capacity(h):
                h += 1
                continue
            if h + 1 == len(self.levels):
                self.levels.append(np.empty(0))
                h = 0
                continue
            own = np.sort(own)
            odd = own[-1:] if len(own) % 2 else own[:0]
            even = own[: len(own) - len(odd)]
            self.levels[h] = odd
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], even[int(self.rng.integers(2)) :: 2]])
            self.variance += 4.0**h
            h += 1

    def merge(self, other: Sketch) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, own in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], own])
        self.n, self.variance = self.n + other.n, self.variance + other.variance
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.compact()

    def row(self) -> tuple:
        return self.n, self.low, self.high, self.variance, [len(x) for x in self.levels], np.concatenate(self.levels)

    @classmethod
    def of(cls, k: int, seed: int, n: int, low: float, high: float, variance: float, sizes, items) -> Sketch:
        s = cls(k, seed)
        s.n, s.low, s.high, s.variance = int(n), low, high, variance
        s.levels = np.split(np.asarray(items, dtype=float), np.cumsum(np.asarray(sizes, dtype=int))[:-1])
        return s

    def quantiles(self, qs: list[float]) -> list[float]:
        """The value at each share q of the rows (nearest rank)."""
        items = np.concatenate(self.levels)
        weight = np.repeat(2 ** np.arange(len(self.levels), dtype=np.int64), [len(x) for x in self.levels])
        order = np.argsort(items, kind="stable")
        cum = np.cumsum(weight[order])
        out = []
        for q in qs:
            rank = min(max(1, math.ceil(q * self.n)), self.n)
            out.append(self.low if q <= 0 else self.high if q >= 1 else float(items[order][min(np.searchsorted(cum, rank), len(cum) - 1)]))
        return out

    def error(self, delta: float) -> float:
        """Ranks by which an answer may be wrong, but for a chance of delta, besides the weight of the item itself."""
        top = 2.0 ** (len(self.levels) - 1) if len(self.levels) > 1 else 0.0
        return math.sqrt(2 * math.log(2 / delta) * self.variance) + top


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


def sketch(df: DataFrame, group: Column, value: Column, k: int = 800, seed: int = 7) -> DataFrame:
    """(g, n, low, high, variance, sizes, items): a sketch of value for each group.

    Null and NaN values are left out, a group of only such values has no sketch, a null group is a group of its own. Every
    partition sketches what it holds of each group, so no group meets in one task as rows; the sketches of a part are merged in
    two rounds, over at most 64 parts of a group and then over those.
    """
    kind = df.select(group.alias("g")).dtypes[0][1]
    rows = df.select(group.cast("string").alias("g"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = rows.withColumn("part", F.spark_partition_id())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, Sketch] = {}
        part = 0
        for pdf in batches:
            part = int(pdf["part"].iat[0]) if len(pdf) else part
            for g, own in pdf.groupby("g", dropna=False, sort=False)["v"]:
                g = None if pd.isna(g) else g
                if g not in held:
                    held[g] = Sketch(k, _seed(seed, g, part))
                held[g].add(own.to_numpy())
            # a partition with very many groups hands over what it has
            if len(held) > 5_000:
                yield _frame(held, part)
                held = {}
        yield _frame(held, part)

    made = rows.mapInPandas(build, f"g string, part int, {TYPE}")
    return merge(merge(made, ["g", F.pmod("part", F.lit(64)).alias("part")], k, seed), ["g"], k, seed).withColumn("g", F.col("g").cast(kind))


def _frame(held: dict, part: int) -> pd.DataFrame:
    return pd.DataFrame([(g, part, *s.row()) for g, s in held.items()], columns=["g", "part", "n", "low", "high", "variance", "sizes", "items"])


def merge(sketches: DataFrame, by: list, k: int = 800, seed: int = 7) -> DataFrame:
    """Sketches merged level by level within each group of `by` (columns of the sketches)."""
    keyed = sketches.select(*by, "n", "low", "high", "variance", "sizes", "items")
    keys = keyed.columns[:-6]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = Sketch(k, _seed(seed, key, len(pdf)))
        # in a fixed order, so that a task that runs again gives the same sketch
        pdf = pdf.iloc[np.lexsort([pdf["variance"], pdf["low"], pdf["high"], pdf["n"]])]
        for row in pdf[["n", "low", "high", "variance", "sizes", "items"]].itertuples(index=False):
            total.merge(Sketch.of(k, 0, *row))
        return pd.DataFrame([(*key, *total.row())], columns=[*keys, "n", "low", "high", "variance", "sizes", "items"])

    schema = ", ".join(f"`{n}` {t}" for n, t in keyed.dtypes[:-6])
    return keyed.groupBy(*keys).applyInPandas(run, f"{schema}, {TYPE}")


def percentiles(sketches: DataFrame, key: str, qs: list[float], k: int = 800, delta: float = 1e-6) -> DataFrame:
    """(key, n, q, value, rank_error): percentiles of each sketch; rank_error is a share of n, exceeded with chance delta."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = Sketch.of(k, 0, *row[1:])
                out += [(row[0], s.n, q, v, s.error(delta) / s.n) for q, v in zip(qs, s.quantiles(qs))]
            yield pd.DataFrame(out, columns=[key, "n", "q", "value", "rank_error"])

    kind = dict(sketches.dtypes)[key]
    return sketches.select(key, "n", "low", "high", "variance", "sizes", "items").mapInPandas(run, f"`{key}` {kind}, n long, q double, value double, rank_error double")
