"""History of changing attributes, kept as checkpoints and per-change patches.

Periodic snapshots are turned into patches: one (key, date, value) for each change, a null value meaning that the
entity left. The store holds, for each key and epoch (a run of `epoch_months` calendar months), the full version
valid when the epoch began (the checkpoint) and the patches within it. Validity rows come from folding each
epoch's patches forward from its own checkpoint, so a reader of a late date never replays the whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed
from tidemark.sources.versions import VersionStore


def key_form(c: Column) -> Column:
    """Lower case, trimmed, inner blanks single; null becomes the empty string."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s  -​ 　]+", " ")))


def observed(df: DataFrame, keys: list[str], as_at: str, value: str | list[str], fetched: str | None, decimals: int) -> DataFrame:
    """(k0.., at, v): the value of each key and date, as fetched last; v is null where absent, NaN or 0.

    Of several attributes v is a struct, null where all of them are.
    """
    if isinstance(value, list):
        parts = [F.round(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), decimals) for c in value]
        own = F.struct(*[F.nullif(x, F.lit(0.0)).alias(c) for c, x in zip(value, parts)])
        base = df.where(F.col(f"`{as_at}`").isNotNull()).groupBy(*[key_form(F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{as_at}`").cast("date").alias("at"))
        last = base.agg(F.max(F.struct((F.col(f"`{fetched}`") if fetched else F.lit(0)).alias("f"), own.alias("v"))).alias("s"))
        return last.select(*[f"k{i}" for i in range(len(keys))], "at", F.when(F.coalesce(*[F.col(f"s.v.`{c}`") for c in value]).isNotNull(), F.col("s.v")).alias("v"))
    base = df.where(F.col(f"`{as_at}`").isNotNull()).select(
        *[key_form(F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(f"`{as_at}`").cast("date").alias("at"),
        F.struct((F.col(f"`{fetched}`") if fetched else F.lit(0)).alias("f"), F.round(F.col(f"`{value}`").cast("double"), decimals).alias("v")).alias("s"),
    )
    last = base.groupBy(*[f"k{i}" for i in range(len(keys))], "at").agg(F.max("s").alias("s"))
    return last.select(*[f"k{i}" for i in range(len(keys))], "at", F.when(~F.isnan("s.v") & (F.col("s.v") != 0), F.col("s.v")).alias("v"))


def patches(obs: DataFrame, n_keys: int, n_group: int) -> DataFrame:
    """(k0.., at, v) for each change. The first n_group keys name the source whose dates are known.

    A key without a row at a date its source delivered has left; a date without any row of the source says nothing.
    """
    ks, src = [f"k{i}" for i in range(n_keys)], [f"k{i}" for i in range(n_group)]
    known = obs.select(*src, "at").distinct()
    known = known.withColumn("next_at", F.lead("at").over(Window.partitionBy(*src).orderBy("at")))
    w = Window.partitionBy(*ks).orderBy("at")
    rows = (
        obs.join(known, [*src, "at"])
        .withColumn("prev", F.when(F.lag("next_at").over(w) == F.col("at"), F.lag("v").over(w)))
        .withColumn("gap", F.col("v").isNotNull() & F.col("next_at").isNotNull() & ~F.lead("at").over(w).eqNullSafe(F.col("next_at")))
    )
    change = F.when(~F.col("v").eqNullSafe(F.col("prev")), F.struct("at", "v"))
    left = F.when(F.col("gap"), F.struct(F.col("next_at").alias("at"), F.lit(None).cast(dict(obs.dtypes)["v"]).alias("v")))
    return rows.select(*ks, F.explode(F.filter(F.array(change, left), lambda x: x.isNotNull())).alias("p")).select(*ks, "p.at", "p.v")


def _epoch(at: Column, months: int) -> Column:
    return F.floor((F.year(at) * 12 + F.month(at) - 1) / F.lit(months)).cast("int")


def _state(df: DataFrame) -> str:
    """The type of a valid version, for a table of changes or a store."""
    kinds = dict(df.dtypes)
    return f"struct<v:{kinds['v']},since:date>" if "v" in kinds else kinds["checkpoint"]


def _step(s: Column, p: Column, state: str) -> Column:
    """The state after one patch."""
    return F.when(p["v"].isNull(), F.lit(None).cast(state)).otherwise(F.struct(p["v"].alias("v"), p["at"].alias("since")))


def build_store(changes: DataFrame, n_keys: int, epoch_months: int = 3, upto: Column | None = None) -> DataFrame:
    """(k0.., epoch, checkpoint, patches, last): the store, a row for each key and epoch.

    An epoch without patches has a row too while the key is valid, so that any date is at most one epoch
    away from a full version; with upto, the last epoch of the store, a key that is still valid has a row in each epoch up to it. A key has at
    most two patches for each date, which bounds the arrays.
    """
    STATE = _state(changes)
    ks = [f"k{i}" for i in range(n_keys)]
    per = changes.groupBy(*ks, _epoch(F.col("at"), epoch_months).alias("epoch")).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("patches"))
    # the state at the end of an epoch depends only on its last patch: a full version for the epochs that follow
    tail = F.element_at("patches", -1)
    w = Window.partitionBy(*ks).orderBy("epoch")
    end = F.when(tail["v"].isNotNull(), F.struct(tail["v"].alias("v"), tail["at"].alias("since")))
    rows = per.withColumn("end_state", end.cast(STATE)).withColumn("checkpoint", F.lag("end_state").over(w)).withColumn("next_epoch", F.lead("epoch").over(w))
    quiet = rows.withColumn("until", F.col("next_epoch") if upto is None else F.coalesce("next_epoch", upto + 1)).where("end_state is not null and until > epoch + 1").select(
        *ks,
        F.explode(F.sequence(F.col("epoch") + 1, F.col("until") - 1)).alias("epoch"),
        F.col("end_state").alias("checkpoint"),
        F.array().cast(dict(rows.dtypes)["patches"]).alias("patches"),
        F.lit(False).alias("last"),
    )
    return rows.select(*ks, "epoch", "checkpoint", "patches", F.col("next_epoch").isNull().alias("last")).unionByName(quiet)


def fold(store: DataFrame, n_keys: int) -> DataFrame:
    """(k0.., v, valid_from, valid_to): each version, valid_to null while open, folded from the checkpoints."""
    STATE = _state(store)
    VERSION = STATE.removesuffix(",since:date>") + ",valid_from:date,valid_to:date>"
    init = F.struct(F.col("checkpoint").cast(STATE).alias("state"), F.array().cast(f"array<{VERSION}>").alias("done"))

    def merge(acc: Column, p: Column) -> Column:
        closed = F.struct(acc["state"]["v"].alias("v"), acc["state"]["since"].alias("valid_from"), p["at"].alias("valid_to"))
        done = F.when(acc["state"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(closed)))
        return F.struct(_step(acc["state"], p, STATE).alias("state"), done.alias("done"))

    def finish(acc: Column) -> Column:
        still = F.struct(acc["state"]["v"].alias("v"), acc["state"]["since"].alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        return F.when(F.col("last") & acc["state"].isNotNull(), F.concat(acc["done"], F.array(still))).otherwise(acc["done"])

    return store.select(*[f"k{i}" for i in range(n_keys)], F.explode(F.aggregate("patches", init, merge, finish)).alias("r")).select(*[f"k{i}" for i in range(n_keys)], "r.*")


def as_of(store: DataFrame, n_keys: int, date: str, epoch_months: int = 3) -> DataFrame:
    """(k0.., v, since): the versions valid on a date, from the nearest checkpoint at or before it.

    A key whose last epoch lies before the date is read from that last epoch.
    """
    day = F.lit(date).cast("date")
    near = store.where((F.col("epoch") == _epoch(day, epoch_months)) | (F.col("last") & (F.col("epoch") < _epoch(day, epoch_months))))
    state = F.aggregate(F.filter("patches", lambda p: p["at"] <= day), F.col("checkpoint").cast(_state(store)), lambda s, p: _step(s, p, _state(store)))
    return near.select(*[f"k{i}" for i in range(n_keys)], state.alias("s")).where("s is not null").select(*[f"k{i}" for i in range(n_keys)], "s.*")


def rebuild_history(df: DataFrame, keys: list[str], as_at: str, value: str | list[str], fetched: str | None = None, n_group: int = 1, decimals: int = 2, epoch_months: int = 3) -> DataFrame:
    """Keys (in key form), value, valid_from, valid_to and is_current of every version in the snapshots df.

    Rows without a date are left out; null key parts count as ''; null, NaN and 0 values mean not carded; of several
    rows for a key and date the one fetched last counts (at equal times the larger value); values are compared at
    `decimals` places. An empty table gives no rows. Keys are never gathered by source: the largest group
    that meets in a task is one key's dates.
    """
    obs = observed(df, keys, as_at, value, fetched, decimals)
    store = checkpointed(build_store(patches(obs, len(keys), n_group), len(keys), epoch_months))
    rows = fold(store, len(keys))
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("v").alias("value"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


class HistoryStore:
    """A history kept on storage: a part for each epoch, with a full version (checkpoint) of every valid key and the patches of the epoch.

    A new snapshot reads and writes its own epoch only, or, where it begins one, reads the epoch before; a date is read from its epoch alone.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], as_at: str, value: str | list[str], fetched: str | None = None, n_group: int = 1, decimals: int = 2, epoch_months: int = 3):
        self.store, self.keys, self.as_at, self.value, self.fetched = VersionStore(spark, path), keys, as_at, value, fetched
        self.n_group, self.decimals, self.months = n_group, decimals, epoch_months

    def _observed(self, df: DataFrame) -> DataFrame:
        return observed(df, self.keys, self.as_at, self.value, self.fetched, self.decimals)

    def epochs(self) -> list[int]:
        return sorted(int(p["kind"]) for p in self.store.parts())

    def build(self, snapshots: DataFrame) -> None:
        """The store of all snapshots; an empty table makes none."""
        obs = checkpointed(self._observed(snapshots))
        ends = obs.agg(F.max(_epoch(F.col("at"), self.months)).alias("e"), F.max("at").alias("at")).first()
        if ends["e"] is None:
            return
        rows = checkpointed(build_store(patches(obs, len(self.keys), self.n_group), len(self.keys), self.months, F.lit(ends["e"])))
        # one for each epoch
        kinds = [r[0] for r in rows.select("epoch").distinct().orderBy("epoch").collect()]
        self.store.put([(str(e), rows.where(F.col("epoch") == e).drop("last")) for e in kinds], note={"at": str(ends["at"])})

    def apply(self, snapshot: DataFrame) -> bool:
        """Add one later date's snapshot; False if the store has that date or a later one already, or there are no rows.

        Sources (the first n_group keys) that the snapshot has no row of stay as they are.
        """
        obs = checkpointed(self._observed(snapshot))
        dates = obs.select("at").distinct().limit(2).collect()
        if len(dates) > 1:
            raise ValueError("a snapshot has one date")
        if not dates or (self.store.version() >= 0 and str(dates[0][0]) <= self.store.log()[-1]["at"]):
            return False
        if self.store.version() < 0:
            self.build(snapshot)
            return True
        day, ks = F.lit(dates[0][0]).cast("date"), [f"k{i}" for i in range(len(self.keys))]
        epoch = obs.select(_epoch(day, self.months)).first()[0]
        near = self.store.read(kind=str(self.epochs()[-1]))
        state = F.aggregate("patches", F.col("checkpoint").cast(_state(near)), lambda s, p: _step(s, p, _state(near)))
        now = near.select(*ks, "checkpoint", "patches", state.alias("state"))
        if epoch > self.epochs()[-1]:
            now = now.where("state is not null").select(*ks, F.col("state").alias("checkpoint"), F.array().cast(dict(near.dtypes)["patches"]).alias("patches"), "state")
        known = obs.select(*ks[: self.n_group]).distinct().withColumn("known", F.lit(True))
        both = now.join(obs.drop("at"), ks, "full_outer").join(known, ks[: self.n_group], "left")
        change = F.col("known") & ~F.col("v").eqNullSafe(F.col("state.v"))
        added = F.when(F.coalesce(change, F.lit(False)), F.array(F.struct(day.alias("at"), "v"))).otherwise(F.array())
        kept = F.coalesce("patches", F.array().cast(dict(near.dtypes)["patches"]))
        rows = both.select(*ks, F.lit(epoch).alias("epoch"), "checkpoint", F.concat(kept, added.cast(dict(near.dtypes)["patches"])).alias("patches")).where("checkpoint is not null or size(patches) > 0")
        # an epoch without a snapshot is a checkpoint only: its keys are those of the one before
        quiet = [(str(e), checkpointed(now).select(*ks, F.lit(e).alias("epoch"), "checkpoint", "patches")) for e in range(self.epochs()[-1] + 1, epoch)]
        self.store.put([*quiet, (str(epoch), rows)], lambda part: part["kind"] != str(epoch), {"at": str(dates[0][0])})
        return True

    def as_of(self, date: str) -> DataFrame:
        """(keys, value, since): the versions valid on a date, from the part of its epoch alone; none before the first one."""
        day = F.lit(date).cast("date")
        epoch = self.store.spark.range(1).select(_epoch(day, self.months)).first()[0]
        have = [e for e in self.epochs() if e <= epoch]
        near = self.store.read(kind=str(have[-1] if have else self.epochs()[0]))
        state = F.aggregate(F.filter("patches", lambda p: p["at"] <= day), F.col("checkpoint").cast(_state(near)), lambda s, p: _step(s, p, _state(near)))
        rows = near.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)], state.alias("s")).where("s is not null")
        return rows.select(*self.keys, F.col("s.v").alias("value"), "s.since")

    def history(self) -> DataFrame:
        """(keys, value, valid_from, valid_to, is_current) of every version."""
        last = self.epochs()[-1]
        rows = fold(self.store.read().withColumn("last", F.col("epoch") == last), len(self.keys))
        return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)], F.col("v").alias("value"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))
