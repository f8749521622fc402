"""Column-level data-quality profile from range-sorted value counts.

The columns of a table are unpivoted to (column, series, value, load, count) and sorted by range into partitions. Each
partition's counts of the first and last column it holds are gathered (two rows of counts a partition), so that
every partition knows how many values of each load lie before it. With these prefix counts a partition finds, alone and
exactly, the quantiles, distinct values and modes that fall into it and the largest gaps between the cumulative curves
of consecutive loads (the Kolmogorov-Smirnov distance); the parts merge by sum and maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SORT = ["col", "series", "num", "txt", "load"]


def unpivot(df: DataFrame, columns: list[str], load: Column, series: Column | None = None, patterns: dict[str, str] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(col, series, load, num, txt, bad, n): how often each value of each column occurs in each load.

    Numbers and booleans go to num (NaN counts as null), all else to txt as text. bad marks values that violate
    their column's pattern (a regular expression) or range (closed). Counts are combined on the map side, so heavily tied columns shuffle few rows.
    """
    types, patterns, ranges = dict(df.dtypes), patterns or {}, ranges or {}

    def cell(c: str) -> Column:
        is_num = types[c].startswith(NUMERIC) or types[c] == "boolean"
        raw = F.col(f"`{c}`")
        num = F.nanvl(raw.cast("double"), F.lit(None).cast("double")) if is_num else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if is_num else (raw.cast("string") if not types[c].startswith(("array", "map", "struct", "binary")) else F.to_json(F.struct(raw)))
        bad = ~F.coalesce(raw.cast("string").rlike(patterns[c]), F.lit(True)) if c in patterns else F.lit(False)
        bad = bad | ~F.coalesce(num.between(*map(float, ranges[c])), F.lit(True)) if c in ranges else bad
        return F.struct(F.lit(c).alias("col"), num.alias("num"), txt.alias("txt"), bad.alias("bad"))

    rows = df.select(load.cast("string").alias("load"), (series if series is not None else F.lit("")).cast("string").alias("series"), F.explode(F.array(*[cell(c) for c in columns])).alias("c"))
    return rows.groupBy("c.col", "series", "load", "c.num", "c.txt", "c.bad").agg(F.count("*").alias("n"))


class _Part:
    """One partition as arrays, cut into segments of one column and series each."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        parts = [b for b in batches if len(b)]
        self.df = pd.concat(parts, ignore_index=True) if parts else None

    def segments(self):
        """((col, series), rows) in order; load is '' where null."""
        if self.df is None:
            return
        key = self.df["col"] + "\0" + self.df["series"]
        cuts = np.flatnonzero((key.to_numpy()[1:] != key.to_numpy()[:-1])) + 1
        edges = [0, *cuts.tolist(), len(self.df)]
        for a, b in zip(edges, edges[1:]):
            yield (self.df["col"].iat[a], self.df["series"].iat[a]), self.df.iloc[a:b]


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The non-null counts per load of the first and the last segment of a partition."""
    part = _Part(batches)
    segs = list(part.segments())
    for (col, series), rows in [segs[0], *segs[1:][-1:]] if segs else []:
        live = rows[rows["num"].notna() | rows["txt"].notna()]
        counts = live.groupby("load", sort=True)["n"].sum()
        # a null keeps the segment's presence known even where all its values are null
        yield pd.DataFrame({"pid": int(rows["pid"].iat[0]), "col": col, "series": series, "load": [*counts.index, ""], "n": [*counts.to_numpy(), 0]})


QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
OUT = "col string, series string, load string, kind string, arg double, num double, txt string, n long"


def _same(a: np.ndarray) -> np.ndarray:
    """Whether each entry equals the one before (null equals null)."""
    null = pd.isna(a)
    with np.errstate(invalid="ignore"):
        return (np.asarray(a[1:] == a[:-1], dtype=bool) & ~null[1:] & ~null[:-1]) | (null[1:] & null[:-1])


def _profile_part(before: dict, totals: dict):
    """A function from a partition to its share of the profile, as arrays over all its columns, series and loads at once.

    before: (pid, col, series) -> counts per load in earlier partitions; totals: (col, series) -> counts per load, of
    segments that cross a border.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = _Part(batches).df
        if df is None:
            return
        col, series, n = df["col"].to_numpy(object), df["series"].to_numpy(object), df["n"].to_numpy(np.int64)
        num, txt = df["num"].to_numpy(float), df["txt"].to_numpy(object)
        same_seg = _same(col) & _same(series)
        seg = np.concatenate([[0], np.cumsum(~same_seg)])
        first = np.flatnonzero(np.concatenate([[True], ~same_seg]))
        # segments that cross a border also have loads of which this partition has no row
        cross = {int(k): totals[key] for k in {0, len(first) - 1} if (key := (col[first[k]], series[first[k]])) in totals}
        loads = sorted({*df["load"].unique(), *(x for t in cross.values() for x in t)})
        place = {x: i for i, x in enumerate(loads)}
        width = len(loads)
        key = seg * width + df["load"].map(place).to_numpy(np.int64)
        extra = [k * width + place[x] for k, t in cross.items() for x in t]
        groups = np.unique(np.concatenate([key, np.array(extra, dtype=np.int64)]))
        g, G = np.searchsorted(groups, key), len(groups)
        is_num = ~np.isnan(num)
        live = is_num | ~pd.isna(txt)
        count = lambda mask: np.bincount(g[mask], n[mask], G).astype(np.int64)
        rows, nulls, bad = count(slice(None)), count(~live), count(df["bad"].to_numpy(bool))
        total, prior = count(live), np.zeros(G, dtype=np.int64)
        pid = int(df["pid"].iat[0])
        for k, t in cross.items():
            done = before[pid, col[first[k]], series[first[k]]]
            for x, m in t.items():
                at = np.searchsorted(groups, k * width + place[x])
                total[at], prior[at] = m, done.get(x, 0)
        out: list[pd.DataFrame] = []

        def put(kind: str, at: np.ndarray, arg=0.0, value_at: np.ndarray | None = None, num_=None, n_=0) -> None:
            own = groups[at]
            out.append(pd.DataFrame({
                "col": col[first[own // width]], "series": series[first[own // width]], "load": [loads[i] for i in own % width], "kind": kind, "arg": np.broadcast_to(np.asarray(arg, dtype=float), len(at)),
                "num": num[value_at] if value_at is not None else (np.nan if num_ is None else num_), "txt": txt[value_at] if value_at is not None else None, "n": n_,
            }))

        here = np.flatnonzero(rows)
        put("rows", here, n_=rows[here])
        put("bad", here, n_=bad[here])
        put("nulls", here, n_=nulls[here])
        if live.any():
            r = np.flatnonzero(live)
            r = r[np.argsort(g[r], kind="stable")]  # by group, in order of value
            rg, rn = g[r], n[r]
            start = np.flatnonzero(np.concatenate([[True], rg[1:] != rg[:-1]]))
            present, size = rg[start], np.diff(np.concatenate([start, [len(r)]]))
            cum = np.cumsum(rn)
            cum += np.repeat(prior[present] - (cum[start] - rn[start]), size)
            put("distinct", present, n_=size)
            top = np.lexsort((-rn, rg))[start]
            put("mode", present, value_at=r[top], n_=rn[top])
            span = int(max(cum.max(), total.max())) + 2
            code = rg * span + cum
            for q in QUANTILES:
                pos = q * (total[present] - 1)
                for rank in (np.floor(pos), np.ceil(pos)):
                    rank = rank.astype(np.int64)
                    at = np.minimum(np.searchsorted(code, present * span + rank, side="right"), len(r) - 1)
                    ok = (rg[at] == present) & (cum[at] - rn[at] <= rank) & (rank < cum[at])
                    put("rank", present[ok], arg=rank[ok], value_at=r[at[ok]])
            is_number = is_num[r[start]]
            sums = np.bincount(rg, np.nan_to_num(num[r]) * rn, G)[present[is_number]]
            put("sum", present[is_number], num_=sums)
            # consecutive loads of a segment that have values: each row moves the curve of its load in two comparisons
            full = np.flatnonzero(total > 0)
            pair = (groups[full[1:]] // width) == (groups[full[:-1]] // width)
            old_of, new_of = np.full(G, -1), np.full(G, -1)
            old_of[full[1:][pair]], new_of[full[:-1][pair]] = full[:-1][pair], full[1:][pair]
            same_value = same_seg & _same(num) & _same(txt)
            spot = np.concatenate([[0], np.cumsum(~same_value)])[r]
            as_new, as_old = old_of[rg] >= 0, new_of[rg] >= 0
            who = np.concatenate([rg[as_new], new_of[rg[as_old]]])
            where = np.concatenate([spot[as_new], spot[as_old]])
            up = np.concatenate([rn[as_new], np.zeros(as_old.sum(), dtype=np.int64)])
            down = np.concatenate([np.zeros(as_new.sum(), dtype=np.int64), rn[as_old]])
            if len(who):
                order = np.lexsort((where, who))
                who, where = who[order], where[order]
                begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                new, runs = who[begin], np.diff(np.concatenate([begin, [len(who)]]))
                old = old_of[new]

                def curve(step: np.ndarray, of: np.ndarray) -> np.ndarray:
                    c = np.cumsum(step)
                    return (c + np.repeat(prior[of] - (c[begin] - step[begin]), runs)) / np.repeat(total[of], runs)

                gap = np.abs(curve(up[order], new) - curve(down[order], old))
                last = np.concatenate([(who[1:] != who[:-1]) | (where[1:] != where[:-1]), [True]])
                put("ks", new, num_=np.maximum.reduceat(np.where(last, gap, 0.0), begin))
        made = pd.concat([x for x in out if len(x)], ignore_index=True)
        yield made.astype({"num": "float64", "n": "int64", "txt": object})

    return run


def profile(counts: DataFrame, values_a_part: int = 100_000) -> DataFrame:
    """The profile of unpivot()'s counts: a row for each column, series and load.

    Columns: col, series, load, rows, nulls, null_share, n_distinct, min/p25/median/p75/max (numbers, quantiles
    interpolated as percentile() does), min_text/max_text, mode, mode_text, mode_n, bad, mean, and ks, the
    Kolmogorov-Smirnov distance to the load before (null for the first). A null series or load counts as ''. All-null
    columns have null statistics; an empty table gives no rows.
    """
    counts = counts.withColumns({"load": F.coalesce("load", F.lit("")), "series": F.coalesce("series", F.lit(""))})
    counts = checkpointed(counts)
    # by rows alone: small tables need few tasks
    parts = max(1, -(-counts.count() // values_a_part))
    # all loads' rows of a value go to one partition: the curves are compared at whole values
    ranged = counts.repartitionByRange(parts, *SORT[:-1]).sortWithinPartitions(*SORT).withColumn("pid", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("n", F.col("n").cast("long")))
    # at most two segments a partition: bounded by partitions times loads
    edges = ranged.mapInPandas(_edges, "pid int, col string, series string, load string, n long").toPandas()
    before, totals = {}, {}
    for (col, series), own in edges.groupby(["col", "series"]):
        if own["pid"].nunique() < 2:
            continue
        run: dict[str, int] = {}
        for pid, rows in own.groupby("pid", sort=True):
            before[int(pid), col, series] = dict(run)
            for load, n in zip(rows["load"], rows["n"]):
                run[load] = run.get(load, 0) + int(n)
        totals[col, series] = run
    got = ranged.mapInPandas(_profile_part(before, totals), OUT)
    kind = lambda k: F.col("kind") == k
    total = lambda k: F.sum(F.when(kind(k), F.col("n")).otherwise(0))
    merged = got.groupBy("col", "series", "load").agg(
        total("rows").alias("rows"),
        total("nulls").alias("nulls"),
        total("bad").alias("bad"),
        total("distinct").alias("n_distinct"),
        F.map_from_entries(F.collect_set(F.when(kind("rank"), F.struct(F.col("arg").cast("long").alias("k"), F.struct("num", "txt").alias("v"))))).alias("ranks"),
        F.max(F.when(kind("mode"), F.struct("n", "num", "txt"))).alias("m"),
        F.max(F.when(kind("ks"), F.col("num"))).alias("ks"),
        F.sum(F.when(kind("sum"), F.col("num"))).alias("sum"),
    )
    live = F.col("rows") - F.col("nulls")

    def quantile(q: float) -> Column:
        pos = (live - 1) * F.lit(q)
        lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        a, b = F.try_element_at("ranks", lo)["num"], F.try_element_at("ranks", hi)["num"]
        return F.when(live > 0, a + (b - a) * (pos - lo))

    text = lambda k: F.when(live > 0, F.try_element_at("ranks", k.cast("long"))["txt"])
    return merged.select(
        "col",
        "series",
        "load",
        "rows",
        "nulls",
        (F.col("nulls") / F.col("rows")).alias("null_share"),
        "n_distinct",
        *[quantile(q).alias(name) for q, name in zip(QUANTILES, ("min", "p25", "median", "p75", "max"))],
        text(F.lit(0)).alias("min_text"),
        text(live - 1).alias("max_text"),
        F.col("m.num").alias("mode"),
        F.col("m.txt").alias("mode_text"),
        F.coalesce("m.n", F.lit(0)).alias("mode_n"),
        "bad",
        F.when(live > 0, F.col("sum") / live).alias("mean"),
        "ks",
    )

