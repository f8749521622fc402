"""The structured query interface over a table of records: filter, sort, limit, aggregate, calculate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import python_round


@dataclass
class Request:
    """What to select. numeric: column -> (least, most), either may be None; bedrooms: (number, least share)."""

    zones: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    traits: list[str] = field(default_factory=list)
    numeric: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    bedrooms: tuple[float, float] | None = None
    sort_by: str | None = None
    descending: bool = True
    limit: int = 8


def bedroom_share(mix: Column, bedrooms: float) -> Column:
    """The share of homes with so many bedrooms from a text such as '5/20/45/22/8'; null if any part is unreadable."""
    parts = F.transform(F.split(mix, "/"), lambda x: F.trim(x).try_cast("double"))
    at = min(4, max(0, round(bedrooms) - 1)) + 1
    return F.when((F.size(parts) == 5) & ~F.exists(parts, lambda x: x.isNull()), F.element_at(parts, at))


def conditions(r: Request) -> Column:
    """All conditions of a request; a missing value never meets a numeric one."""
    out = F.lit(True)
    if r.zones:
        out = out & F.coalesce(F.col("zone").isin(r.zones), F.lit(False))
    if r.names:
        out = out & F.coalesce(F.lower("name").isin([n.lower() for n in r.names]), F.lit(False))
    if r.traits:
        out = out & (F.size(F.array_except(F.array(*map(F.lit, r.traits)), F.split(F.coalesce("traits", F.lit("")), "/"))) == 0)
    for c, (low, high) in r.numeric.items():
        v = F.col(c)
        out = out & v.isNotNull() & (F.lit(True) if low is None else F.coalesce(v >= low, F.lit(False))) & (F.lit(True) if high is None else F.coalesce(v <= high, F.lit(False)))
    if r.bedrooms:
        out = out & F.coalesce(bedroom_share(F.col("bedroom_mix"), r.bedrooms[0]) >= r.bedrooms[1], F.lit(False))
    return out


def select(df: DataFrame, r: Request, key: str = "name") -> DataFrame:
    """The first rows of a request, missing values last in both directions, ties by key; 1 to 20 rows."""
    rows = df.where(conditions(r))
    order = [] if not r.sort_by else [F.col(r.sort_by).desc_nulls_last() if r.descending else F.col(r.sort_by).asc_nulls_last()]
    return rows.orderBy(*order, key).limit(min(20, max(1, r.limit)))


def summarise(df: DataFrame, r: Request, metric: str, op: str, by_zone: bool, key: str = "name", zone: str = "zone") -> DataFrame:
    """(grp, matched, value, name): count, mean, median, min or max of a metric over the matching rows.

    matched counts all rows, count those with a value; min and max name their row, the first by key of equals; rows without a
    zone are in no group.
    """
    rows = df.where(conditions(r))
    rows = rows.where(F.col(zone).isNotNull()).withColumn("grp", F.col(zone)) if by_zone else rows.withColumn("grp", F.lit("all"))
    v = F.col(metric).cast("double")
    rounded = python_round(2)
    name = F.lit(None).cast("string")
    if op == "count":
        value = F.nullif(F.count(v), F.lit(0)).cast("double")
    elif op in ("mean", "median"):
        value = F.avg(v) if op == "mean" else F.median(v)
    else:
        sign = 1 if op == "min" else -1
        best = F.min(F.when(v.isNotNull(), F.struct((v * sign).alias("s"), F.col(key).alias("k"))))
        value, name = best["s"] * sign, best["k"]
    out = rows.groupBy("grp").agg(F.count("*").alias("matched"), value.alias("value"), name.alias("name"))
    return out.withColumn("value", rounded("value")) if op in ("mean", "median") else out


def lookup(df: DataFrame, names: list[str]) -> DataFrame:
    """(asked, name, found) for each name asked for, without regard to case."""
    asked = df.sparkSession.createDataFrame([(n,) for n in names], "asked string")
    return asked.join(df.select("name"), F.lower("asked") == F.lower("name"), "left").select("asked", "name", F.col("name").isNotNull().alias("found"))


def search_names(df: DataFrame, text: str) -> DataFrame:
    """Names equal to the text, or if there are none, that start with it."""
    rank = F.when(F.lower("name") == text.lower(), 0).when(F.lower("name").startswith(text.lower()), 1)
    hits = df.select("name", rank.alias("rank")).where("rank is not null")
    best = hits.agg(F.min("rank").alias("rank"))
    return hits.join(F.broadcast(best), "rank").select("name", "rank")  # one row


def calculate(op: Column, a: Column, b: Column) -> Column:
    """add, subtract, multiply, divide, mean or percent_change of two columns; dividing by 0 is an error."""
    zero = F.raise_error(F.lit("division by zero"))
    divide = lambda x, y: F.when(y == 0, zero).otherwise(x / y)
    return (
        F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when(op == "mean", (a + b) / 2)
        .when(op == "divide", divide(a, b)).when(op == "percent_change", divide(b - a, F.abs(a)) * 100)
    )


def facts(df: DataFrame, prefix: str, key: str, columns: list[str]) -> DataFrame:
    """(label, value_num, value_str): prefix:key:column of every value that is present."""
    types = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("c"), (F.col(c).cast("double") if types[c] != "string" else F.lit(None).cast("double")).alias("n"), (F.col(c) if types[c] == "string" else F.lit(None).cast("string")).alias("s")) for c in columns]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(F.array(*cells)).alias("v")).where("v.n is not null or v.s is not null")
    return rows.select(F.concat_ws(":", F.lit(prefix), F.col("k").cast("string"), "v.c").alias("label"), F.col("v.n").alias("value_num"), F.col("v.s").alias("value_str"))
