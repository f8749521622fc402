"""Matching entities across sources without keys, by probabilistic record linkage.

Candidates come from several blocking passes. Each candidate pair is compared attribute by attribute at
agreement levels. Expectation-maximisation over the counts of agreement patterns finds how often each level occurs among
matches and non-matches; with them every pair has odds of being a match, and every record a posterior for each of its
candidates and for having none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.matching import levels_of
from tidemark.session import checkpointed, parts_for


def block(left: DataFrame, right: DataFrame, passes: list[tuple[Column, Column]], most: int = 2_000, pairs_a_part: int | None = None) -> DataFrame:
    """(l, r): every pair that shares a key in at least one pass, once.

    left, right: id and attributes. A pass is an array of keys for each side; null keys are none. A key that makes more than `most` pairs is
    cut into salted blocks: a row of the left goes to one of them and a row of the right to all, so every pair is made, in
    tasks of a bounded size. With pairs_a_part the pairs are spread over as many partitions as their number asks for.
    """
    def keyed(df: DataFrame, side: int) -> DataFrame:
        """All passes by one explode of (pass, key)."""
        # a second parameter of the function, even one with a default, would be the key's place in the array
        named = lambda n: lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"))
        each = [F.transform(F.coalesce(p[side].cast("array<string>"), F.array().cast("array<string>")), named(n)) for n, p in enumerate(passes)]
        rows = df.select("id", F.explode(F.array_distinct(F.concat(*each))).alias("k")).where("k.k is not null")
        return rows.select("id", F.xxhash64("k.n", "k.k").alias("k"))

    sides = [keyed(df, i) for i, df in enumerate((left, right))]
    counts = [s.groupBy("k").agg(F.count("*").alias(f"n{i}")) for i, s in enumerate(sides)]
    pairs = F.col("n0") * F.col("n1")
    # more blocks than rows on the left would only copy the right
    size = checkpointed(counts[0].join(counts[1], "k").select("k", pairs.alias("pairs"), F.greatest(F.lit(1), F.least("n0", F.ceil(pairs / most))).cast("int").alias("blocks")))

    def salted(s: DataFrame, every: bool) -> DataFrame:
        """The keys both sides have with the number of a block, or each of its numbers."""
        rows = s.join(size, "k")
        number = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if every else F.pmod(F.xxhash64("id"), "blocks").cast("int")
        return rows.select("id", "k", number.alias("block"))

    l, r = (salted(s, i == 1) for i, s in enumerate(sides))  # noqa: E741
    out = l.withColumnRenamed("id", "l").join(r.withColumnRenamed("id", "r"), ["k", "block"]).select("l", "r").distinct()
    if pairs_a_part is None:
        return out
    made = size.agg(F.sum("pairs")).first()[0] or 0
    return out.repartition(parts_for(left.sparkSession, made, pairs_a_part), "l", "r")


def name_level(a: Column, b: Column) -> Column:
    """Agreement of two names: 4 equal, 3 one slip (or two letters swapped), 2 two slips, 1 alike in three quarters, 0 other; null if one is missing."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    d = F.levenshtein(a, b)
    swapped = (d == 2) & (letters(a) == letters(b))
    alike = d <= F.greatest(F.length(a), F.length(b)) * 0.25
    return F.when(a == b, 4).when((d == 1) | swapped, 3).when(d == 2, 2).when(alike, 1).when(d.isNotNull(), 0)


@dataclass
class Model:
    """m and u: for each attribute the share of each level among matches and non-matches; prior: share of matches."""

    m: list[np.ndarray]
    u: list[np.ndarray]
    prior: float

    def odds(self, patterns: np.ndarray) -> np.ndarray:
        """Log odds of a match for rows of levels (-1: missing, which says nothing)."""
        w = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for j, (m, u) in enumerate(zip(self.m, self.u)):
            known = patterns[:, j] >= 0
            w[known] += np.log(m / u)[patterns[known, j]]
        return w


def fit(patterns: np.ndarray, counts: np.ndarray, levels: list[int], prior: float, rounds: int = 200) -> Model:
    """Expectation-maximisation over agreement patterns, started from: higher levels are likelier among matches."""
    m = [np.arange(1, n + 1, dtype=float) ** 3 for n in levels]
    u = [np.arange(n, 0, -1, dtype=float) ** 3 for n in levels]
    model = Model([x / x.sum() for x in m], [x / x.sum() for x in u], prior)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(model.odds(patterns), -60, 60)))
        new_m, new_u = [], []
        for j, n in enumerate(levels):
            known = patterns[:, j] >= 0
            at = patterns[known, j]
            a = np.bincount(at, (g * counts)[known], n) + 0.1
            b = np.bincount(at, ((1 - g) * counts)[known], n) + 0.1
            new_m.append(a / a.sum())
            new_u.append(b / b.sum())
        share = float(np.clip((g * counts).sum() / counts.sum(), 1e-6, 0.9))
        moved = max(float(np.abs(x - y).max()) for x, y in zip(new_m, model.m))
        model = Model(new_m, new_u, share)
        if moved < 1e-7:
            break
    return model


def link(pairs: DataFrame, levels: dict[str, int], least: float = 0.5) -> DataFrame:
    """(l, r, confidence): for each l the best r if its posterior reaches `least`.

    pairs: l, r and a column of agreement levels (null: missing) for each entry of levels, which gives the number of
    levels. The patterns, at most the product of the numbers of levels plus one, are what the driver gathers. The posteriors of
    an l's candidates and of having no match sum to one, so equally good candidates share their probability. Ties go to the
    smaller r. Without pairs there are no rows.
    """
    code: Column = F.lit(0)
    for c, n in levels.items():
        code = code * (n + 1) + F.coalesce(F.col(c).cast("int"), F.lit(-1)) + 1
    rows = checkpointed(pairs.select("l", F.lit(1).alias("w"), code.alias("code"), F.lit(1).alias("n"), "r"))
    return _best(rows, rows.select("l", "w"), levels, least)


def link_patterns(found: DataFrame, levels: dict[str, int], least: float = 0.5) -> DataFrame:
    """The same from matching.patterns: for each l the codes of its patterns, how many candidates have each and the smallest r of them."""
    found = checkpointed(found)
    each = F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n"), F.col("rs").alias("r"))).alias("p")
    return _best(found.select("l", "w", each).select("l", "w", "p.*"), found.select("l", "w"), levels, least)


def _best(rows: DataFrame, lefts: DataFrame, levels: dict[str, int], least: float) -> DataFrame:
    """rows: l, w records it stands for, code of a pattern, n candidates that have it, r the smallest of them."""
    got = rows.groupBy("code").agg(F.sum(F.col("n") * F.col("w")).alias("n")).toPandas()
    if not len(got):
        return rows.select("l", "r", F.lit(0.0).alias("confidence"))
    left = lefts.distinct().agg(F.sum("w")).first()[0]
    codes, counts = got["code"].to_numpy(dtype=int), got["n"].to_numpy(dtype=float)
    patterns = levels_of(codes, list(levels.values()))
    model = fit(patterns, counts, list(levels.values()), min(0.5, 0.5 * left / counts.sum()))
    got["odds"] = model.odds(patterns)
    table = F.broadcast(rows.sparkSession.createDataFrame(got[["code", "odds"]]).withColumn("code", F.col("code").cast("int")))
    each = rows.join(table, "code").withColumn("e", F.exp(F.least("odds", F.lit(500.0))))
    best = each.groupBy("l").agg(F.max(F.struct("e", (-F.col("r")).alias("r"))).alias("b"), F.sum(F.col("e") * F.col("n")).alias("all"))
    return best.select("l", (-F.col("b.r")).alias("r"), (F.col("b.e") / (1 + F.col("all"))).alias("confidence")).where(F.col("confidence") >= least)


__all__ = ["Model", "block", "fit", "link", "link_patterns", "name_level"]
