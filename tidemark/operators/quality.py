"""Data-quality operators: gates, drift, constraints, metrics, freshness, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(metric, value): aggregates over tables, all those of one table in one pass."""
    rows = []
    for df, values in parts:
        one = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
        rows.append(one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values])).alias("m")).select("m.*"))
    return reduce(DataFrame.unionByName, rows)


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; null over no rows."""
    return F.try_divide(F.count_if(condition), F.count("*"))


def history(df: DataFrame, name: str, at: str, value: str) -> DataFrame:
    """(name, runs, low, high, latest): a metric's series at a glance; nulls are never the latest."""
    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(at, value)))[value]
    return df.groupBy(name).agg(F.count("*").alias("runs"), F.min(value).alias("low"), F.max(value).alias("high"), latest.alias("latest"))


def violations(df: DataFrame, table: str, rules: dict[str, str]) -> DataFrame:
    """(table_name, rule, rows, violations): in one pass; a rule that is null for a row holds, as in CHECK."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(F.lit(table).alias("table_name"), "rows", cells.alias("c")).select("table_name", "c.rule", "rows", "c.violations")


def enforce(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df, failing at the first row that breaks a rule."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(F.expr(rule), F.lit(True)), True).otherwise(F.raise_error(F.lit(f"constraint {name} violated"))))
    return df


def gate(df: DataFrame, source: str, least_rows: int, filled: dict[str, float]) -> DataFrame:
    """(source, ok, rows, message): whether a staged table is large enough and its columns filled enough."""
    got = df.agg(F.count("*").alias("rows"), *[F.coalesce(share(F.col(c).isNotNull()), F.lit(0.0)).alias(f"f_{c}") for c in filled])
    wrong = [F.when(F.col("rows") < least_rows, F.concat(F.lit(f"fewer than {least_rows} rows: "), F.col("rows").cast("string")))]
    wrong += [F.when(F.col(f"f_{c}") < least, F.lit(f"{c} is filled less than {least:g}")) for c, least in filled.items()]
    found = F.filter(F.array(*wrong), lambda x: x.isNotNull())
    return got.select(F.lit(source).alias("source"), (F.size(found) == 0).alias("ok"), "rows", F.array_join(found, "; ").alias("message"))


def drift(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, old, new, drift): keys whose value moved by more than the tolerance, relative to the old one."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key).withColumn("drift", F.try_divide(F.abs(F.col("new") - F.col("old")), F.abs("old"))).where(F.col("drift") > tolerance)


def due(sources: DataFrame, as_of: str) -> DataFrame:
    """sources (source, every_days, last_ok, forced) with due: forced, never run, or old enough."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_ok").cast("date"))
    return sources.withColumn("due", F.coalesce("forced", F.lit(False)) | F.col("last_ok").isNull() | (age >= F.col("every_days")))


def freshness(df: DataFrame, source: Column, at: Column, as_of: str, stale_days: int) -> DataFrame:
    """(source, newest, days_old, stale)."""
    rows = df.groupBy(source.alias("source")).agg(F.max(at).cast("date").alias("newest"))
    old = F.datediff(F.lit(as_of).cast("date"), F.col("newest")).cast("long")
    return rows.withColumn("days_old", old).withColumn("stale", F.coalesce(old > stale_days, F.lit(True)))


def content_mark(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, mark): a digest of a table's content that does not depend on the order of its rows."""
    row = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    return df.agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("s"), F.bit_xor(row).alias("x")).select("rows", F.sha2(F.concat_ws(",", "rows", "s", "x"), 256).alias("mark"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): how many rows each side has that the other lacks, repeats included."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    return left.crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))  # one row each


def gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): the numbers from 1 to the group's largest that it lacks."""
    top = df.groupBy(group).agg(F.max(number).cast("int").alias("top")).where("top >= 1")
    every = top.select(group, F.explode(F.sequence(F.lit(1), "top")).alias("missing"))
    return every.join(df.select(group, F.col(number).cast("int").alias("missing")).distinct(), [group, "missing"], "left_anti")
