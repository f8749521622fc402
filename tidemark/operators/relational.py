"""Relational building blocks that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import haversine_km
from tidemark.session import checkpointed


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Catalyst limits the groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def append_new(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of fresh whose non-null key existing lacks; a key that comes twice comes once."""
    known = existing.select(*keys).distinct()
    rows = fresh.dropna(subset=keys).dropDuplicates(keys)
    return rows.join(known, keys, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of fresh in place of those with the same key."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def ties_at_min(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows that hold the smallest value of their group."""
    return df.join(df.groupBy(*by).agg(F.min(value).alias(value)), [*by, value])


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str], months: int = 1) -> DataFrame:
    """Points with the intervals of the same keys that hold them: start <= at and (end is null or at < end).

    Both sides meet in calendar buckets by an equi-join; an open interval reaches to the last point.
    """
    bucket = lambda c: F.floor((F.year(c) * 12 + F.month(c)) / months).cast("int")
    last = points.agg(F.max(at).alias("_last"))
    spread = intervals.crossJoin(F.broadcast(last))  # one row
    stop = F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))
    spread = spread.where(stop >= F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(stop)))).drop("_last")
    return points.withColumn("_b", bucket(F.col(at))).join(spread, [*keys, "_b"]).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_b")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The nearest right row (bx, by) of each left row (x, y), with the distance km.

    Looks in the nine cells around each point, of a size that holds about one right row on average; points whose find may be
    beaten by a row outside look again in cells four times as wide, until all have the nearest. Ties go to the smaller right id.
    Degrees within one hemisphere; without right rows there are no rows.
    """
    e = right.agg(F.count("*").alias("n"), (F.max("bx") - F.min("bx")).alias("w"), (F.max("by") - F.min("by")).alias("h")).first()
    cell = max(1e-4, ((e["w"] or 0.0) * (e["h"] or 0.0) / max(1, e["n"])) ** 0.5)
    found, rest = None, left
    while True:
        whole = cell > 90
        at = lambda c: F.floor(F.col(c) / cell) if not whole else F.lit(0)  # noqa: E731, B023
        steps = (-1, 0, 1) if not whole else (0,)
        around = F.array(*[F.struct((at("x") + i).cast("long").alias("cx"), (at("y") + j).cast("long").alias("cy")) for i in steps for j in steps])
        cand = rest.withColumn("c", F.explode(around)).select("*", "c.cx", "c.cy").drop("c")
        pairs = cand.join(right.withColumns({"cx": at("bx").cast("long"), "cy": at("by").cast("long")}), ["cx", "cy"]).drop("cx", "cy")
        km = pairs.withColumn("km", haversine_km(F.col("x"), F.col("y"), F.col("bx"), F.col("by")))
        best = km.groupBy(left_id).agg(F.min(F.struct("km", right_id, *[c for c in right.columns if c != right_id])).alias("b"), F.max(F.abs("y")).alias("_y")).select(left_id, "b.*", "_y")
        # a row outside the nine cells is at least one cell away; a degree of longitude is shortest towards the pole
        reach = F.lit(cell * 111.19) * F.cos(F.radians(F.least(F.col("_y") + 2 * cell, F.lit(89.0))))
        sure = checkpointed((best if whole else best.where(F.col("km") <= reach)).drop("_y"))
        found = sure if found is None else found.unionByName(sure)
        rest = rest.join(sure.select(left_id), left_id, "left_anti")
        if whole or rest.isEmpty():
            return found
        cell *= 4


def rekey(history: DataFrame, old_id: str, old_names: DataFrame, new_names: DataFrame, name: str) -> DataFrame:
    """History under new ids: old id -> name -> new id, names compared without case and accents.

    old_names and new_names: id, name. Names that occur several times in new_names take their smallest id; rows whose name is
    gone are left out.
    """
    plain = F.collate(F.trim(F.col(name)), "UNICODE_CI_AI")
    new = new_names.where(F.col(name).isNotNull()).groupBy(plain.alias("_n")).agg(F.min("id").alias("new_id"))
    old = old_names.where(F.col(name).isNotNull()).select(F.col("id").alias(old_id), plain.alias("_n"))
    return history.join(old, old_id).join(new, "_n").drop("_n", old_id)
