"""What changed between full snapshots, by comparing Merkle trees top-down.

Every release of a table is reduced to the digests of its leaf buckets (ranges of the key's hash). Digests
of inner nodes combine those of their children. Consecutive releases are compared from the root; only children
of nodes that differ are looked at, and only rows in leaf buckets that differ are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed
from tidemark.sources.versions import VersionStore

FANOUT_BITS = 4


def _zero_as_null(df: DataFrame, name: str) -> Column:
    numeric = dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(df.dtypes)[name].startswith("decimal")
    return F.nullif(F.col(f"`{name}`"), F.lit(0)) if numeric else F.col(f"`{name}`")


def depth_for(rows: int, rows_per_bucket: int = 64) -> int:
    """Levels below the root so that a leaf bucket of one release holds about rows_per_bucket rows."""
    depth = 1
    while FANOUT_BITS * depth < 60 and (1 << FANOUT_BITS * depth) * rows_per_bucket < rows:
        depth += 1
    return depth


def current_rows(df: DataFrame, keys: list[str], release: str, values: list[str], captured: str | None, zero_is_null: bool = True) -> DataFrame:
    """One row (k, release, row digest) for each key and release: the row captured last counts.

    Aggregated with map-side combine, so that rows captured many times never meet in one task. Rows with a null
    in a key or without a release are left out. Rows captured at the same time are ordered by their values.
    """
    vals = [_zero_as_null(df, v) if zero_is_null else F.col(f"`{v}`") for v in values]
    cap = F.col(f"`{captured}`") if captured else F.lit(0)
    base = df.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(f"`{release}`").alias("rel"),
        F.struct(cap.alias("cap"), *[v.alias(f"v{i}") for i, v in enumerate(vals)]).alias("s"),
    ).where(reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(keys))]) & F.col("rel").isNotNull())
    ks = [f"k{i}" for i in range(len(keys))]
    last = base.groupBy("rel", *ks).agg(F.max("s").alias("s"))
    # struct() keeps nulls apart from values: xxhash64 skips nulls, so each value travels with its null flag
    flagged = [x for i in range(len(values)) for x in (F.col(f"s.v{i}").isNull(), F.col(f"s.v{i}"))]
    return last.select("rel", *ks, F.xxhash64(*flagged, F.lit(17)).alias("d1"), F.xxhash64(F.lit(29), *flagged).alias("d2"), F.xxhash64(*ks).alias("kh"))


def leaf_digests(rows: DataFrame, depth: int) -> DataFrame:
    """(rel, bucket, h1, h2, n): an order-free digest of the rows in each leaf bucket of each release."""
    shift = 64 - FANOUT_BITS * depth
    mix = lambda seed, d: F.xxhash64(F.lit(seed), F.col("kh"), F.col(d))
    return (
        rows.withColumn("bucket", F.shiftrightunsigned("kh", shift))
        .groupBy("rel", "bucket")
        .agg(F.bit_xor(mix(1, "d1")).alias("h1"), F.bit_xor(mix(2, "d2")).alias("h2"), F.count("*").alias("n"))
    )


def parent_digests(nodes: DataFrame) -> DataFrame:
    """Digests one level up: a node's digest covers its children's numbers, digests and counts."""
    mix = lambda seed: F.xxhash64(F.lit(seed), "bucket", "h1", "h2", "n")
    return (
        nodes.select("rel", F.shiftrightunsigned("bucket", FANOUT_BITS).alias("up"), mix(3).alias("a"), mix(4).alias("b"), "n")
        .groupBy("rel", F.col("up").alias("bucket"))
        .agg(F.bit_xor("a").alias("h1"), F.bit_xor("b").alias("h2"), F.sum("n").alias("n"))
    )


def differing_buckets(leaves: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(old, new, bucket) of the leaf buckets whose digests differ, found from the root downwards."""
    levels = [leaves]
    for _ in range(depth):
        levels.append(parent_digests(levels[-1]))
    open_nodes = pairs.select("old", "new", F.lit(0).cast("long").alias("up"))
    for level in range(depth, -1, -1):
        if level < depth:
            open_nodes = open_nodes.withColumnRenamed("bucket", "up")
        nodes = levels[level].withColumn("up", F.shiftrightunsigned("bucket", FANOUT_BITS) if level < depth else F.col("bucket"))
        sides = [
            open_nodes.join(nodes.withColumnRenamed("rel", side), [side, "up"]).select("old", "new", "bucket", F.lit(i).alias("side"), "h1", "h2", "n")
            for i, side in enumerate(("old", "new"))
        ]
        digest = lambda i: F.max(F.when(F.col("side") == i, F.struct("h1", "h2", "n")))
        open_nodes = (
            sides[0].unionByName(sides[1]).groupBy("old", "new", "bucket").agg(digest(0).alias("o"), digest(1).alias("w")).where(~F.col("o").eqNullSafe(F.col("w"))).select("old", "new", "bucket")
        )
    return open_nodes


def snapshot_diff(df: DataFrame, keys: list[str], release: str, values: list[str], captured: str | None = None, zero_is_null: bool = True) -> DataFrame:
    """The keys added, removed or changed between each release and the one before.

    Returns the keys, `release` (of the later of the two) and `change` (`added`, `removed`, `changed`).
    Rows with a null key or release are left out; of several rows for a key and release the one captured last
    counts (at equal times the one with the larger values); with zero_is_null, 0 and null are the same in
    numeric values; an empty table or a single release gives no rows. Extra columns are never read.
    """
    rows = checkpointed(current_rows(df, keys, release, values, captured, zero_is_null))
    releases = rows.groupBy("rel").agg(F.count("*").alias("n"))
    # one row for each release: the only window without partitions, over as many rows as there are releases
    w = Window.orderBy("rel")
    pairs = releases.select(F.lag("rel").over(w).alias("old"), F.col("rel").alias("new")).where("old is not null")
    most = releases.agg(F.max("n")).first()[0] or 0
    depth = depth_for(most)
    leaves = checkpointed(leaf_digests(rows, depth))
    buckets = checkpointed(differing_buckets(leaves, checkpointed(pairs), depth))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("kh", 64 - FANOUT_BITS * depth))
    return changed_rows(buckets, rows, keys)


def changed_rows(buckets: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, release, change) from the rows of the buckets that differ."""
    ks = [f"k{i}" for i in range(len(keys))]
    side = lambda name, i: buckets.join(rows.withColumnRenamed("rel", name), [name, "bucket"]).select("new", *ks, F.lit(i).alias("side"), "d1", "d2")
    digest = lambda i: F.max(F.when(F.col("side") == i, F.struct("d1", "d2")))
    return (
        side("old", 0)
        .unionByName(side("new", 1))
        .groupBy("new", *ks)
        .agg(digest(0).alias("o"), digest(1).alias("w"))
        .where(~F.col("o").eqNullSafe(F.col("w")))
        .select(
            *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
            F.col("new").alias("release"),
            F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("changed").alias("change"),
        )
    )


class DigestStore:
    """The leaf digests and row digests of each release, kept on storage: only a new release is ever hashed.

    All releases have the same number of leaf buckets, 16 ** depth. The row digests of a release lie in files of their own, sorted by bucket, so that those of differing buckets are
    read by range.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], release: str, values: list[str], captured: str | None = None, zero_is_null: bool = True, depth: int = 4):
        self.store, self.keys, self.release, self.values, self.captured, self.zero_is_null, self.depth = VersionStore(spark, path), keys, release, values, captured, zero_is_null, depth

    def releases(self) -> list[str]:
        return sorted(p["kind"].removeprefix("leaves ") for p in self.store.parts() if p["kind"].startswith("leaves "))

    def add(self, rows: DataFrame) -> str | None:
        """Hash one release and keep it (in place of an earlier delivery of the same); its name, None for no rows."""
        own = current_rows(rows, self.keys, self.release, self.values, self.captured, self.zero_is_null).withColumn("bucket", F.shiftrightunsigned("kh", 64 - FANOUT_BITS * self.depth))
        own = checkpointed(own)
        names = [str(r[0]) for r in own.select("rel").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError("add one release at a time")
        if not names:
            return None
        mine = (f"leaves {names[0]}", f"rows {names[0]}")
        leaves = leaf_digests(own.drop("bucket"), self.depth)
        self.store.put([(mine[0], leaves), (mine[1], own.repartitionByRange("bucket").sortWithinPartitions("bucket"))], lambda part: part["kind"] not in mine)
        return names[0]

    def diff(self, old: str, new: str) -> DataFrame:
        """(keys, release, change) between two releases that are kept: digests first, then rows of the buckets that differ."""
        leaves = self.store.read(kind=f"leaves {old}").unionByName(self.store.read(kind=f"leaves {new}"))
        names = leaves.groupBy().agg(F.min("rel").alias("a"), F.max("rel").alias("b"))
        pairs = names.select(*[F.when(F.col("a").cast("string") == x, F.col("a")).otherwise(F.col("b")).alias(k) for k, x in (("old", old), ("new", new))])
        buckets = checkpointed(differing_buckets(leaves, pairs, self.depth))
        return changed_rows(buckets, self.store.read(kind=f"rows {old}").unionByName(self.store.read(kind=f"rows {new}")), self.keys)
