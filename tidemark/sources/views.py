"""SQL over the tables and semantic views of a folder: read-only unless asked otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

#: Parts of the names of plans that change something.
CHANGES = ("Command", "Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "Set", "Add", "Refresh", "Replace", "Cache", "Load", "Unresolved DDL")


def register(spark: SparkSession, folder: str, tables: list[str], views: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None) -> None:
    """Temporary views of the tables of a folder and of semantic views over them."""
    for name in tables:
        table(spark, folder, name).createOrReplaceTempView(name)
    for name, make in (views or {}).items():
        make(spark, folder).createOrReplaceTempView(name)


def ask(spark: SparkSession, sql: str, read_only: bool = True) -> DataFrame:
    """The result of one statement; with read_only, a statement that is more than a query is refused before anything runs."""
    if read_only:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        stack = [plan]
        while stack:
            node = stack.pop()
            name = node.nodeName()
            if any(name.startswith(c) or name.endswith("Command") for c in CHANGES):
                raise PermissionError(f"read-only: {name}")
            kids = node.children()
            stack += [kids.apply(i) for i in range(kids.size())]
    return spark.sql(sql)


def columns(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """(table_name, column_name, data_type) of each table, from the files' schemas."""
    rows = [(name, c, kind) for name in tables for c, kind in table(spark, folder, name).dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def prechecks(spark: SparkSession, folder: str, tables: list[str], least_bytes: int = 1) -> DataFrame:
    """(table_name, present, files, bytes): whether each table's files are there and hold anything; only their lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    own = files.select(F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("table_name"), "length")
    got = own.groupBy("table_name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    want = spark.createDataFrame([(t,) for t in tables], "table_name string")
    return want.join(got, "table_name", "left").select("table_name", (F.coalesce("bytes", F.lit(0)) >= least_bytes).alias("present"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
