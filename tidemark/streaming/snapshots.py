"""Snapshots that arrive in a folder, merged one batch at a time by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import relational, scd
from tidemark.session import checkpointed
from tidemark.sources.versions import VersionStore


def follow(spark: SparkSession, folder: str, schema: str, store_path: str, state: str, keys: list[str], value: str, as_at: str) -> StreamingQuery:
    """Merge every new snapshot file of `folder` into a versioned interval table; ends when all files are read.

    Dates of one batch are merged in order; a date that is not newer than the table's last change is passed over, so a batch that
    runs again adds nothing; nothing is written if nothing changed. Closed rows are appended and never written again; only the part of
    the open rows is replaced.
    """
    store = VersionStore(spark, store_path)

    def batch(df: DataFrame, _: int) -> None:
        # a date for each snapshot that arrived
        days = [r[0] for r in df.select(F.col(as_at).cast("string")).where(F.col(as_at).isNotNull()).distinct().orderBy(as_at).collect()]
        for day in days:
            snap = df.where((F.col(as_at).cast("string") == day) & F.col(value).isNotNull())
            if store.version() < 0:
                store.put([("open", scd.opened(snap.dropDuplicates(keys), keys, value, day))], note={"as_at": day})
                continue
            if str(store.read().agg(F.max(F.greatest("valid_from", "valid_to"))).first()[0]) >= day:
                continue
            current = checkpointed(scd.merge(store.read(kind="open"), snap, keys, value, day))
            changed = current.agg(F.count_if(~F.col("is_current")).alias("closed"), F.count_if(F.col("is_current") & (F.col("valid_from") == F.lit(day).cast("date"))).alias("opened")).first().asDict()
            if changed["closed"] or changed["opened"]:
                store.put([("closed", current.where("not is_current")), ("open", current.where("is_current"))], lambda part: part["kind"] == "closed", {"as_at": day, **changed})

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def append_stream(spark: SparkSession, folder: str, schema: str, target: str, state: str, keys: list[str]) -> StreamingQuery:
    """Append the rows of new files whose key the target lacks, as parts of their own: a file fetched again changes nothing."""
    store = VersionStore(spark, target)

    def batch(df: DataFrame, _: int) -> None:
        if store.version() < 0:
            store.write(df.dropna(subset=keys).dropDuplicates(keys))
            return
        fresh = checkpointed(relational.append_new(store.read(), df, keys))
        if not fresh.isEmpty():
            store.append(fresh)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
