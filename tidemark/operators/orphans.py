"""References to records that do not exist, by dictionary codes and compressed bitmaps.

Keys of both sides are hashed to ranges and get consecutive integer codes within their range (the dictionary). For
each range, the keys referenced in a period and load date become a compressed bitmap, and so do the parents that
exist, those not yet seen at a date and those no longer seen. Orphans are the bits of reference AND NOT parent.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import parts_for

CHUNK = 1 << 16


class Bitmap:
    """A compressed set of integers: blocks of 65,536, each a sorted uint16 array, a bit field or a run."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, tuple[str, np.ndarray]] | None = None):
        self.blocks = blocks or {}

    @staticmethod
    def _pack(low: np.ndarray) -> tuple[str, np.ndarray]:
        if len(low) and int(low[-1]) - int(low[0]) + 1 == len(low):
            return "run", np.array([low[0], low[-1]], dtype=np.uint16)
        if len(low) <= 4096:
            return "array", low.astype(np.uint16)
        bits = np.zeros(CHUNK, dtype=bool)
        bits[low] = True
        return "bits", np.packbits(bits)

    @staticmethod
    def _low(block: tuple[str, np.ndarray]) -> np.ndarray:
        kind, data = block
        if kind == "run":
            return np.arange(int(data[0]), int(data[1]) + 1)
        return data.astype(np.int64) if kind == "array" else np.flatnonzero(np.unpackbits(data))

    @staticmethod
    def _field(block: tuple[str, np.ndarray]) -> np.ndarray:
        if block[0] == "bits":
            return block[1]
        bits = np.zeros(CHUNK, dtype=bool)
        bits[Bitmap._low(block)] = True
        return np.packbits(bits)

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes)
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): cls._pack(part & 0xFFFF) for part in np.split(codes, cuts) if len(part)})

    def _combine(self, other: Bitmap, keep_left: bool, small, large) -> Bitmap:
        out = {}
        for k, a in self.blocks.items():
            b = other.blocks.get(k)
            if b is None:
                if keep_left:
                    out[k] = a
                continue
            if a[0] == "array" and b[0] != "bits" or a[0] == "array" and len(a[1]) < 512:
                low = small(self._low(a), b)
            else:
                low = np.flatnonzero(np.unpackbits(large(self._field(a), self._field(b))))
            if len(low):
                out[k] = self._pack(low)
        return Bitmap(out)

    @classmethod
    def _within(cls, low: np.ndarray, block: tuple[str, np.ndarray]) -> np.ndarray:
        kind, data = block
        if kind == "run":
            return (low >= data[0]) & (low <= data[1])
        if kind == "bits":
            return (data[low >> 3] >> (7 - (low & 7)) & 1).astype(bool)
        return np.isin(low, data, assume_unique=True)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._combine(other, True, lambda low, b: low[~self._within(low, b)], lambda a, b: a & ~b)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._combine(other, False, lambda low, b: low[self._within(low, b)], lambda a, b: a & b)

    def codes(self) -> np.ndarray:
        """Decode the set bits."""
        parts = [self._low(b) + (k << 16) for k, b in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.codes())

    def nbytes(self) -> int:
        return sum(b[1].nbytes for b in self.blocks.values())


NONE = np.iinfo(np.int32).min


def _days(s: pd.Series) -> np.ndarray:
    return s.fillna(NONE).to_numpy(dtype=np.int64)


def _range_orphans(pdf: pd.DataFrame) -> pd.DataFrame:
    """All orphans of one key range. pdf: code, parent, first, last, load, period, key (days since 1970 or null)."""
    code, parent = pdf["code"].to_numpy(dtype=np.int64), pdf["parent"].to_numpy(dtype=bool)
    names = np.empty(int(code.max()) + 1, dtype=object)
    names[code] = pdf["key"].to_numpy(dtype=object)
    p_code, first, last = code[parent], _days(pdf["first"])[parent], _days(pdf["last"])[parent]
    exist = Bitmap.of(p_code)
    refs = pdf.loc[~parent, ["code", "load", "period"]]
    out = []
    by_load: dict[int, tuple[Bitmap, Bitmap]] = {}
    for (load, period), own in refs.groupby(["load", "period"], dropna=False, sort=False):
        ref = Bitmap.of(own["code"].to_numpy(dtype=np.int64))
        found = [("missing", ref.and_not(exist))]
        if not pd.isna(load):
            load = int(load)
            if load not in by_load:
                born = Bitmap.of(p_code[(first <= load)])
                alive = Bitmap.of(p_code[(last == NONE) | (last >= load)])
                by_load[load] = (born, alive)
            born, alive = by_load[load]
            here = ref & exist
            found += [("late", here.and_not(born)), ("deleted", here.and_not(alive))]
        for kind, bits in found:
            if hit := bits.codes().tolist():
                out += [(key, None if pd.isna(period) else period, kind) for key in names[hit]]
    return pd.DataFrame(out, columns=["key", "period", "kind"])


def orphans(refs: DataFrame, parents: DataFrame, key: Column, load: Column | None, period: Column, parent_key: Column, first: Column | None = None, last: Column | None = None, per_range: int = 30_000) -> DataFrame:
    """(key, period, kind), distinct: the keys of refs that parents do not hold at the time of their load.

    kind is `missing` (no parent at all), `late` (first seen after the load date) or `deleted` (last seen before it).
    Null keys refer to nothing and give no row; a reference with a null load date can only be missing; a parent without
    first (last) date counts as always (still) there; of several parent rows for a key the earliest first and the latest
    last date count; a null period stays null. Empty references give no rows, empty parents make every key missing.
    References are made distinct before they are shuffled, so a key that holds a third of all rows travels
    once for each date. Ranges hold about per_range keys of both sides, whatever their
    number, so missing keys are spread even where there are no parents.
    """
    day = lambda c: (F.unix_date(c.cast("date")) if c is not None else F.lit(None)).cast("int")
    null = F.lit(None).cast("int")
    r = refs.select(key.alias("key"), day(load).alias("load"), period.cast("string").alias("period")).where("key is not null").distinct()
    never = F.lit(2**31 - 1)
    p = (
        parents.select(parent_key.alias("key"), day(first).alias("first"), day(last).alias("last"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min(F.coalesce("first", F.lit(NONE + 1))).alias("first"), F.max(F.coalesce("last", never)).alias("last"))
    )
    both = p.select("key", F.lit(True).alias("parent"), "first", "last", null.alias("load"), F.lit(None).cast("string").alias("period")).unionByName(
        r.select("key", F.lit(False).alias("parent"), null.alias("first"), null.alias("last"), "load", "period")
    )
    keys = (p.agg(F.count("*").alias("n")).first()["n"] or 0) + (refs.agg(F.approx_count_distinct(key).alias("n")).first()["n"] or 0)
    ranges = parts_for(refs.sparkSession, keys, per_range)
    coded = both.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    coded = coded.withColumn("code", F.dense_rank().over(Window.partitionBy("range").orderBy("key")) - 1)
    kind = dict(both.dtypes)["key"]
    return coded.groupBy("range").applyInPandas(_range_orphans, f"key {kind}, period string, kind string").distinct()


def report(found: DataFrame) -> DataFrame:
    """Orphan references per table and period: (table_name, period, kind, n_keys)."""
    return found.groupBy("table_name", "period", "kind").agg(F.count("*").alias("n_keys"))


__all__ = ["Bitmap", "orphans", "report"]
