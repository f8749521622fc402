"""Readers of file formats: GeoJSON, line JSON, HTML tables and embedded payloads; and the sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RINGS = "array<array<array<array<double>>>>"


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files (gzipped or not): the properties as columns, and rings as array<array<struct<x,y>>>.

    properties: a DDL schema. Polygons and multi-polygons; other geometries have null rings.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polys = F.when(kind == "MultiPolygon", F.from_json(raw, RINGS)).when(kind == "Polygon", F.from_json(F.concat(F.lit("["), raw, F.lit("]")), RINGS))
    rings = F.transform(F.flatten(polys), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("f.properties.*", rings.alias("rings"))


def as_geojson(df: DataFrame, rings: str, properties: list[str]) -> Column:
    """A feature collection of all rows as one JSON text, by aggregation (for tables of few rows)."""
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")))


class _Cells(HTMLParser):
    """The cells of every table; the text of an image is its alt text."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, str]] = []
        self.table, self.row, self.cell, self.text = -1, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._end()
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th"):
            self._end()
            self.cell, self.text = self.cell + 1, []
        elif tag == "img" and self.text is not None:
            self.text.append(dict(attrs).get("alt") or "")

    def _end(self):
        if self.text is not None:
            self.rows.append((self.table, self.row, self.cell, " ".join(" ".join(self.text).split())))
            self.text = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def html_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cell, text): the cells of every table of each page; null pages have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, page in zip(pdf["key"], pdf["html"]):
                if isinstance(page, str):
                    p = _Cells()
                    p.feed(page)
                    p.close()
                    p._end()
                    out += [(k, *r) for r in p.rows]
            yield pd.DataFrame(out, columns=["key", "table", "row", "cell", "text"])

    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, table int, row int, cell int, text string").withColumnRenamed("key", key)


def rate_card(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, product, term, rate): the rates of every table of each page whose header names a product, a term and a rate.

    The header's words say which column is which, in any order. A row without a product belongs to the product above it in its table, if there is one;
    rows whose rate cannot be read are left out.
    """
    cells = html_cells(df, key, html)
    low = F.lower("text")
    role = F.when(low.contains("product"), "product").when(low.contains("term"), "term").when(low.contains("rate"), "rate")
    heads = cells.where("row = 0").select(key, "table", "cell", role.alias("role")).where("role is not null")
    body = cells.where("row > 0").join(heads, [key, "table", "cell"])
    of = lambda r: F.max(F.when(F.col("role") == r, F.nullif("text", F.lit(""))))
    rows = body.groupBy(key, "table", "row").agg(of("product").alias("named"), of("term").alias("term"), of("rate").alias("raw"))
    above = F.last("named", True).over(Window.partitionBy(key, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rate = F.regexp_extract("raw", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return rows.select(key, above.alias("product"), "term", rate.alias("rate")).where("product is not null and rate is not null")


def payload(page: Column, name: str) -> Column:
    """The JSON object that follows "name": in a page's pushed script strings, as text; null if there is none."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            if not isinstance(v, str):
                return None
            at = v.replace('\\"', '"').find(f'"{name}":')
            if at < 0:
                return None
            text = v.replace('\\"', '"')[at + len(name) + 3 :].lstrip()
            try:
                return json.dumps(json.JSONDecoder().raw_decode(text)[0])
            except ValueError:
                return None

        return s.map(one)

    return run(page)


def decode(df: DataFrame, code: str, domain: DataFrame, name: str) -> DataFrame:
    """A column `name` with the domain's text for each code (columns code, text), 'UNKNOWN (code)' where it has none."""
    texts = domain.dropDuplicates(["code"]).select(F.col("code").alias(code), F.col("text").alias(name))
    return df.join(texts, code, "left").withColumn(name, F.when(F.col(code).isNotNull(), F.coalesce(name, F.concat(F.lit("UNKNOWN ("), F.col(code).cast("string"), F.lit(")")))))


def fit_to_bytes(text: Column, most: int) -> Column:
    """The longest start of a text that fits into `most` bytes of UTF-8, no character cut."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\uFFFD+$", ""))
