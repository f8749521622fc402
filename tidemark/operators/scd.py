"""Slowly changing tables: one snapshot merged into a versioned table of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def opened(snapshot: DataFrame, keys: list[str], value: str, as_at: str) -> DataFrame:
    """The first version: everything in the snapshot is open."""
    return snapshot.select(*keys, value, F.lit(as_at).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def classify(table: DataFrame, snapshot: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, was, since, now, kind): opened, repriced, delisted or unchanged, from one full outer join of the current rows."""
    cur = table.where("is_current").select(*keys, F.col(value).alias("was"), F.col("valid_from").alias("since"))
    new = snapshot.where(F.col(value).isNotNull()).dropDuplicates(keys).select(*keys, F.col(value).alias("now"))
    kind = F.when(F.col("was").isNull(), "opened").when(F.col("now").isNull(), "delisted").when(F.col("was") != F.col("now"), "repriced").otherwise("unchanged")
    return cur.join(new, keys, "full_outer").withColumn("kind", kind)


def merge(table: DataFrame, snapshot: DataFrame, keys: list[str], value: str, as_at: str) -> DataFrame:
    """The table after the snapshot: changed and missing keys are closed at as_at, new and changed ones opened."""
    day = F.lit(as_at).cast("date")
    c = classify(table, snapshot, keys, value)
    closed = c.where("kind in ('delisted', 'repriced')").select(*keys, F.col("was").alias(value), F.col("since").alias("valid_from"), day.alias("valid_to"), F.lit(False).alias("is_current"))
    fresh = c.where("kind in ('opened', 'repriced')").select(*keys, F.col("now").alias(value), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    same = c.where("kind = 'unchanged'").select(*keys, F.col("was").alias(value), F.col("since").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    past = table.where("not is_current").select(*keys, value, "valid_from", "valid_to", "is_current")
    return reduce(DataFrame.unionByName, [past, closed, same, fresh])


def counts(classified: DataFrame) -> DataFrame:
    """(opened, repriced, delisted, unchanged)."""
    return classified.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("opened", "repriced", "delisted", "unchanged")])


def steps(snapshots: DataFrame, keys: list[str], value: str, as_at: str) -> DataFrame:
    """(keys, at, was, now) at every date at which a key was or is open: what merging the snapshots one after the other would see.

    snapshots: at most one row with a value for each key and date; a key that a date lacks is closed there. Dates come from the whole table, one row
    each. Only the dates around a key's own rows are made, not a row for each key and date.
    """
    rows = snapshots.where(F.col(value).isNotNull()).select(*keys, F.col(as_at).alias("at"), F.col(value).alias("now"))
    order = Window.orderBy("at")  # a row for each date
    dates = snapshots.select(F.col(as_at).alias("at")).where("at is not null").distinct().select("at", F.lead("at").over(order).alias("next_at"))
    w = Window.partitionBy(*keys).orderBy("at")
    # as many rows as there are dates: Spark may broadcast them by their size
    seen = rows.join(dates, "at").withColumn("was", F.when(F.lag("next_at").over(w) == F.col("at"), F.lag("now").over(w))).withColumn("gone", ~F.lead("at").over(w).eqNullSafe(F.col("next_at")) & F.col("next_at").isNotNull())
    left = seen.where("gone").select(*keys, F.col("next_at").alias("at"), F.col("now").alias("was"), F.lit(None).cast(dict(seen.dtypes)["now"]).alias("now"))
    return seen.select(*keys, "at", "was", "now").unionByName(left)


def replay(snapshots: DataFrame, keys: list[str], value: str, as_at: str) -> DataFrame:
    """The interval table after all snapshots, in one pass: the same as opened() and merge() for each date in order."""
    changes = steps(snapshots, keys, value, as_at).where(~F.col("was").eqNullSafe(F.col("now")))
    ends = F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))
    rows = changes.withColumn("valid_to", ends).where("now is not null")
    return rows.select(*keys, F.col("now").alias(value), F.col("at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def replay_counts(snapshots: DataFrame, keys: list[str], value: str, as_at: str) -> DataFrame:
    """(at, opened, repriced, delisted, unchanged) of each date."""
    kind = F.when(F.col("was").isNull(), "opened").when(F.col("now").isNull(), "delisted").when(F.col("was") != F.col("now"), "repriced").otherwise("unchanged")
    rows = steps(snapshots, keys, value, as_at).withColumn("kind", kind)
    return rows.groupBy("at").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("opened", "repriced", "delisted", "unchanged")])
