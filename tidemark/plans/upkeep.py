"""Queries that keep the warehouse: appends, merges, versions, gates, metrics, sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, zero_as_null
from tidemark.operators import quality, relational, scd
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.views import _OVERVIEW, overview
from tidemark.session import checkpointed
from tidemark.sources import files
from tidemark.sources.versions import VersionStore

query = Registry()
KEYS = ["bank", "product", "term"]


def scratch(t: Tables, name: str) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    checkpointed(t.spark.range(1))
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def snapshots(t: Tables) -> DataFrame:
    """Every snapshot's rate of each key, as fetched last; null and 0 are no rate."""
    rows = t.rate_snapshot.where("rate > 0 and as_at is not null and bank is not null and product is not null and term is not null")
    return rows.groupBy(*KEYS, "as_at").agg(F.max(F.struct("fetched_at", "rate"))["rate"].alias("rate"))


_SNAPS = """s AS (SELECT bank, product, term, as_at, rate FROM (SELECT *, row_number() OVER (PARTITION BY bank, product, term, as_at ORDER BY fetched_at DESC NULLS LAST, rate DESC) AS rn FROM rate_snapshot
  WHERE rate > 0 AND as_at IS NOT NULL AND bank IS NOT NULL AND product IS NOT NULL AND term IS NOT NULL) WHERE rn = 1{upto})"""


def _grid(upto: str = "") -> str:
    return f"""{_SNAPS.format(upto=upto)}, d AS (SELECT DISTINCT as_at FROM s), g AS (SELECT k.*, d.as_at, s.rate FROM (SELECT DISTINCT bank, product, term FROM s) k CROSS JOIN d LEFT JOIN s USING (bank, product, term, as_at)),
  c AS (SELECT *, lag(rate) OVER (PARTITION BY bank, product, term ORDER BY as_at) AS was FROM g),
  v AS (SELECT *, lead(as_at) OVER (PARTITION BY bank, product, term ORDER BY as_at) AS upto FROM c WHERE rate IS DISTINCT FROM was)"""


@query("scd_merge", f"WITH {_grid()} SELECT bank, product, term, rate, as_at AS valid_from, upto AS valid_to, upto IS NULL AS is_current FROM v WHERE rate IS NOT NULL")
def scd_merge(t: Tables) -> DataFrame:
    """Every snapshot merged into an interval table, in one pass over all of them."""
    return scd.replay(snapshots(t), KEYS, "rate", "as_at")


@query("scd_counts", f"""WITH {_grid()} SELECT as_at, count(*) FILTER (was IS NULL AND rate IS NOT NULL) AS opened, count(*) FILTER (was <> rate) AS repriced,
  count(*) FILTER (was IS NOT NULL AND rate IS NULL) AS delisted, count(*) FILTER (was = rate) AS unchanged FROM c GROUP BY as_at""")
def scd_counts(t: Tables) -> DataFrame:
    """What each snapshot does."""
    return scd.replay_counts(snapshots(t), KEYS, "rate", "as_at").withColumnRenamed("at", "as_at")


_HALF = "2025-06-30"


@query("time_travel", f"""SELECT 0 AS version, (SELECT count(*) FROM (WITH {_grid(f" AND as_at <= DATE '{_HALF}'")} SELECT * FROM v WHERE rate IS NOT NULL)) AS rows, (SELECT count(*) FROM (WITH {_grid(f" AND as_at <= DATE '{_HALF}'")} SELECT * FROM v WHERE rate IS NOT NULL AND upto IS NULL)) AS open
  UNION ALL SELECT 1, (SELECT count(*) FROM (WITH {_grid()} SELECT * FROM v WHERE rate IS NOT NULL)), (SELECT count(*) FROM (WITH {_grid()} SELECT * FROM v WHERE rate IS NOT NULL AND upto IS NULL))""")
def time_travel(t: Tables) -> DataFrame:
    """The interval table of half a year and of the whole as two versions of a store; the first is still readable after the second."""
    store, rows = VersionStore(t.spark, scratch(t, "rates")), snapshots(t)
    store.write(scd.replay(rows.where(F.col("as_at") <= F.lit(_HALF).cast("date")), KEYS, "rate", "as_at"), {"as_at": _HALF})
    store.write(scd.replay(rows, KEYS, "rate", "as_at"))
    versions = [store.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("rows"), F.count_if("is_current").alias("open")) for v in (0, 1)]
    return versions[0].unionByName(versions[1])


@query("append_new_suburbs", "SELECT count(DISTINCT suburb_id) AS appended FROM market_snapshot WHERE source_as_at = (SELECT max(source_as_at) FROM market_snapshot) AND suburb_id NOT IN (SELECT suburb_id FROM market_snapshot WHERE source_as_at < (SELECT max(source_as_at) FROM market_snapshot) AND suburb_id IS NOT NULL)")
def append_new_suburbs(t: Tables) -> DataFrame:
    """How many suburbs of the last release an idempotent append adds to the earlier ones."""
    newest = t.market_snapshot.agg(F.max("source_as_at")).scalar()
    return relational.append_new(t.market_snapshot.where(F.col("source_as_at") < newest), t.market_snapshot.where(F.col("source_as_at") == newest), ["suburb_id"]).agg(F.count("*").alias("appended"))


@query("upsert_suburbs", "SELECT major_name, count(*) AS suburbs, sum(CASE WHEN suburb_id % 3 = 0 THEN 7 ELSE coalesce(population_linz, 0) END)::BIGINT AS population FROM suburb GROUP BY major_name")
def upsert_suburbs(t: Tables) -> DataFrame:
    """A correction of some suburbs' populations (those whose id divides by three: the rows that the update is about) merged into all by key."""
    s = t.suburb.select("suburb_id", "major_name", "population_linz")
    fixed = s.where("suburb_id % 3 = 0").withColumn("population_linz", F.lit(7))
    return relational.upsert(s, fixed, ["suburb_id"]).groupBy("major_name").agg(F.count("*").alias("suburbs"), F.sum(F.coalesce("population_linz", F.lit(0))).alias("population"))


@query("rekeyed_history", """WITH n AS (SELECT lower(strip_accents(trim(name))) AS k, min(suburb_id) AS new_id FROM suburb WHERE name IS NOT NULL GROUP BY 1)
  SELECT new_id AS suburb_id, source_as_at, count(*) AS rows FROM market_snapshot m JOIN suburb s USING (suburb_id) JOIN n ON n.k = lower(strip_accents(trim(s.name))) GROUP BY 1, 2""")
def rekeyed_history(t: Tables) -> DataFrame:
    """Market history under new ids by way of the names, compared without case and accents."""
    names = t.suburb.select(F.col("suburb_id").alias("id"), "name")
    rows = relational.rekey(t.market_snapshot.select("suburb_id", "source_as_at"), "suburb_id", names, names, "name")
    return rows.groupBy(F.col("new_id").alias("suburb_id"), "source_as_at").agg(F.count("*").alias("rows"))


@query("unmatched_pages", """WITH p AS (SELECT page_id, lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(heading, ',.*$', ''), '^House prices in ', '')), '[^A-Za-z0-9]', '', 'g')) AS k FROM suburb_page),
  s AS (SELECT DISTINCT lower(regexp_replace(strip_accents(name), '[^A-Za-z0-9]', '', 'g')) AS k FROM suburb) SELECT count(*) AS pages, count(s.k) AS matched, count(*) - count(s.k) AS unmatched FROM p LEFT JOIN s ON s.k = replace(p.k, 'mount', 'mount')""")
def unmatched_pages(t: Tables) -> DataFrame:
    """How many page headings equal a suburb's name by plain normalisation (accents, case, punctuation), and how many do not."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "āēīōū", "aeiou"), ",.*$", ""), "^house prices in |[^a-z0-9]", ""))
    pages = t.suburb_page.select("page_id", F.regexp_replace(plain(F.regexp_replace("heading", ",.*$", "")), "[^a-z0-9]", "").alias("k"))
    known = t.suburb.select(F.regexp_replace(plain(F.col("name")), "[^a-z0-9]", "").alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(1))
    return pages.join(known, "k", "left").agg(F.count("*").alias("pages"), F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("unmatched"))


_PROFILE_SQL = f"""{_OVERVIEW} SELECT 'rating_units' AS metric, count(*)::DOUBLE AS value FROM rating_unit
  UNION ALL SELECT 'ru_with_suburb', count(suburb_id) / count(*) FROM rating_unit
  UNION ALL SELECT 'ru_with_address', count(*) FILTER (length(address) > 5) / count(*) FROM rating_unit
  UNION ALL SELECT 'ru_with_land_area', count(*) FILTER (land_area_m2 > 0) / count(*) FROM rating_unit
  UNION ALL SELECT 'valuations_with_cv', count(*) FILTER (cv > 0) / count(*) FROM valuation
  UNION ALL SELECT 'suburbs_priced', count(avg_house_value) / count(*) FROM ov
  UNION ALL SELECT 'suburbs_with_cv', count(cv_median) / count(*) FROM ov
  UNION ALL SELECT 'median_suburb_value', median(avg_house_value) FROM ov
  UNION ALL SELECT 'median_agreement', median(avg_house_value / cv_median) FROM ov
  UNION ALL SELECT 'carded_rates_current', (count(*) FILTER (is_current))::DOUBLE FROM bank_rate"""


@query("quality_profile", _PROFILE_SQL)
def quality_profile(t: Tables) -> DataFrame:
    """The warehouse's metrics, one scan of each table for each group of them."""
    agreed = F.col("cv_median").isNotNull() & F.col("avg_house_value").isNotNull()
    return quality.metrics([
        (t.rating_unit, {"rating_units": F.count("*"), "ru_with_suburb": quality.share(F.col("suburb_id").isNotNull()), "ru_with_address": quality.share(F.length("address") > 5), "ru_with_land_area": quality.share(F.col("land_area_m2") > 0)}),
        (t.valuation, {"valuations_with_cv": quality.share(F.col("cv") > 0)}),
        (overview(t), {"suburbs_priced": quality.share(F.col("avg_house_value").isNotNull()), "suburbs_with_cv": quality.share(F.col("cv_median").isNotNull()), "median_suburb_value": F.median("avg_house_value"), "median_agreement": F.median(F.when(agreed, ratio(F.col("avg_house_value"), F.col("cv_median"))))}),
        (t.bank_rate, {"carded_rates_current": F.count_if("is_current")}),
    ])


@query("metric_history", "SELECT metric, count(*) AS runs, min(value) AS low, max(value) AS high, arg_max(value, (measured_at, value)) FILTER (value IS NOT NULL) AS latest FROM data_quality GROUP BY metric")
def metric_history(t: Tables) -> DataFrame:
    return quality.history(t.data_quality, "metric", "measured_at", "value")


RULES = {
    "rating_unit": {"lat_in_country": "lat between -47 and -34", "lon_in_country": "lon between 166 and 179"},
    "valuation": {"cv_not_negative": "cv is null or cv >= 0", "lv_not_negative": "lv is null or lv >= 0"},
    "bank_rate": {"rate_in_range": "rate between 0.5 and 20", "closed_after_opened": "valid_to is null or valid_to >= valid_from"},
}


@query("rule_violations", " UNION ALL ".join(f"SELECT '{tb}' AS table_name, '{r}' AS rule, count(*) AS rows, count(*) FILTER (NOT ({e})) AS violations FROM {tb}" for tb, rs in RULES.items() for r, e in rs.items()))
def rule_violations(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [quality.violations(getattr(t, tb), tb, rules) for tb, rules in RULES.items()])


@query("source_gates", """SELECT 'suburb' AS source, count(*) >= 24 AND count(centroid) / count(*) >= 0.5 AS ok, count(*) AS rows FROM suburb
  UNION ALL SELECT 'valuation', count(*) >= 1000000000 AND count(cv) / count(*) >= 0.5, count(*) FROM valuation""")
def source_gates(t: Tables) -> DataFrame:
    """Whether staged tables may be loaded: one that is whole, one that is too small."""
    return quality.gate(t.suburb, "suburb", 24, {"centroid": 0.5}).unionByName(quality.gate(t.valuation, "valuation", 1_000_000_000, {"cv": 0.5})).drop("message")


def newest_releases(t: Tables) -> list:
    """The dates of the last two releases, the last first: two rows of a table of dates."""
    rows = t.market_snapshot.select("source_as_at").where("source_as_at is not null").distinct().orderBy(F.col("source_as_at").desc()).limit(2).collect()
    return [*[r[0] for r in rows], None, None][:2]


@query("price_drift", """WITH m AS (SELECT suburb_id, source_as_at, max(nullif(avg_house_value, 0)) AS v FROM market_snapshot WHERE suburb_id IS NOT NULL GROUP BY ALL)
  SELECT a.suburb_id, a.v AS old, b.v AS new, round(abs(b.v - a.v) / a.v, 6) AS drift FROM m a JOIN m b USING (suburb_id) WHERE a.source_as_at = (SELECT max(source_as_at) FROM market_snapshot WHERE source_as_at < (SELECT max(source_as_at) FROM market_snapshot)) AND b.source_as_at = (SELECT max(source_as_at) FROM market_snapshot) AND abs(b.v - a.v) / a.v > 0.02""")
def price_drift(t: Tables) -> DataFrame:
    """Suburbs whose price moved by more than two per cent between the last two releases."""
    newest, before = newest_releases(t)
    on = lambda day: t.market_snapshot.where((F.col("source_as_at") == F.lit(day).cast("date")) & F.col("suburb_id").isNotNull()).groupBy("suburb_id").agg(F.max(zero_as_null(F.col("avg_house_value"))).alias("v"))
    return quality.drift(on(before), on(newest), "suburb_id", "v", 0.02).withColumn("drift", F.round("drift", 6))


@query("source_freshness", """SELECT bank AS source, CAST(max(fetched_at) AS DATE) AS newest, date_diff('day', CAST(max(fetched_at) AS DATE), DATE '2025-12-31') AS days_old, date_diff('day', CAST(max(fetched_at) AS DATE), DATE '2025-12-31') > 7 AS stale FROM rate_snapshot GROUP BY bank""")
def source_freshness(t: Tables) -> DataFrame:
    return quality.freshness(t.rate_snapshot, F.col("bank"), "fetched_at", "2025-12-31", 7)


@query("sources_due", """WITH l AS (SELECT trigger AS source, max(finished_at) FILTER (WHERE status = 'ok') AS last_ok FROM pipeline_run GROUP BY trigger)
  SELECT source, last_ok IS NULL OR date_diff('day', CAST(last_ok AS DATE), DATE '2025-12-31') >= 30 AS due FROM l""")
def sources_due(t: Tables) -> DataFrame:
    last = t.pipeline_run.groupBy(F.col("trigger").alias("source")).agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_ok"))
    return quality.due(last.withColumns({"every_days": F.lit(30), "forced": F.lit(False)}), "2025-12-31").select("source", "due")


@query("unchanged_source", "SELECT count(*) AS rows, TRUE AS same_content, FALSE AS same_after_change FROM mix_target")
def unchanged_source(t: Tables) -> DataFrame:
    """A table fetched again in another order has the same mark, one with a changed value has not."""
    c = ["source", "target_share", "max_repeat"]
    mark = lambda df, name: quality.content_mark(df, c).select("rows", F.col("mark").alias(name))
    a, b, d = mark(t.mix_target, "a"), mark(t.mix_target.orderBy(F.col("source").desc()), "b"), mark(t.mix_target.withColumn("max_repeat", F.col("max_repeat") + 1), "d")
    return a.join(b, "rows").join(d, "rows").select("rows", (F.col("a") == F.col("b")).alias("same_content"), (F.col("a") == F.col("d")).alias("same_after_change"))


@query("sink_round_trip", """SELECT 'parquet' AS sink, count(*) AS rows, sum(suburb_id)::BIGINT AS ids FROM suburb UNION ALL SELECT 'csv', count(*), sum(suburb_id)::BIGINT FROM suburb UNION ALL SELECT 'json', count(*), sum(suburb_id)::BIGINT FROM suburb
  UNION ALL SELECT 'geojson', sum(len(rings))::BIGINT, sum(board_id)::BIGINT FROM local_board""")
def sink_round_trip(t: Tables) -> DataFrame:
    """Tables written as Zstandard Parquet, CSV, gzipped line JSON and GeoJSON, and read again."""
    at, s = scratch(t, "sinks"), t.suburb.select("suburb_id", "name", "population_linz")
    s.write.option("compression", "zstd").parquet(f"{at}/parquet")
    s.orderBy(F.coalesce("population_linz", F.lit(0)).desc(), "name").write.option("header", True).csv(f"{at}/csv")
    s.write.option("compression", "gzip").json(f"{at}/json")
    t.local_board.agg(files.as_geojson(t.local_board, "rings", ["board_id", "board"]).alias("value")).write.text(f"{at}/geojson")
    count = lambda df, name, rows: df.agg(rows.cast("long").alias("rows"), F.sum(df.columns[0]).cast("long").alias("ids")).select(F.lit(name).alias("sink"), "*")
    back = [count(t.spark.read.parquet(f"{at}/parquet"), "parquet", F.count("*")), count(t.spark.read.option("header", True).schema("suburb_id int, name string, population_linz int").csv(f"{at}/csv"), "csv", F.count("*"))]
    back.append(count(t.spark.read.schema("suburb_id int, name string, population_linz int").json(f"{at}/json"), "json", F.count("*")))
    back.append(count(files.geojson(t.spark, f"{at}/geojson", "board_id int, board string"), "geojson", F.sum(F.size("rings"))))
    return reduce(DataFrame.unionByName, back)


@query("html_tables", """WITH r AS (SELECT bank, as_at, product, term, max(rate) AS rate FROM rate_snapshot WHERE rate > 0 AND bank IS NOT NULL AND as_at IS NOT NULL AND product IS NOT NULL AND term IS NOT NULL GROUP BY ALL)
  SELECT bank, as_at, trim(regexp_replace(product, ' +', ' ', 'g')) AS product, trim(regexp_replace(term, ' +', ' ', 'g')) AS term, round(rate, 2) AS rate FROM r""")
def html_tables(t: Tables) -> DataFrame:
    """Rate cards of every bank and date rendered as pages and read back by their header, products named on their first row only."""
    r = t.rate_snapshot.where("rate > 0 and bank is not null and as_at is not null and product is not null and term is not null").groupBy("bank", "as_at", "product", "term").agg(F.max("rate").alias("rate"))
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;")
    first = F.row_number().over(Window.partitionBy("bank", "as_at", "product").orderBy("term")) == 1
    # a product's further terms stand below it, in rows without its name
    row = F.concat(F.lit("<tr><td>"), F.when(first, esc("product")).otherwise(""), F.lit("</td><td><b>"), F.round("rate", 2).cast("decimal(10,2)").cast("string"), F.lit("</b> %</td><td>"), esc("term"), F.lit("</td></tr>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("product", "term", "row"))), lambda x: x["row"]), "")
    pages = r.withColumn("row", row).groupBy("bank", "as_at").agg(F.concat(F.lit("<table><tr><th>Product<th>Rate p.a.<th>Term</tr>"), lines, F.lit("</table>")).alias("html")).withColumn("page", F.struct("bank", "as_at"))
    return files.rate_card(pages, "page", "html").select("page.bank", "page.as_at", "product", "term", "rate")


@query("decoded_zones", "SELECT CASE WHEN planning_zone_code IS NULL THEN NULL WHEN planning_zone_code <= 40 THEN 'zone ' || planning_zone_code ELSE 'UNKNOWN (' || planning_zone_code || ')' END AS zone_name, count(*) AS units FROM rating_unit GROUP BY 1")
def decoded_zones(t: Tables) -> DataFrame:
    """Codes decoded by a domain table that lacks some."""
    domain = t.spark.range(1, 41).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("zone "), F.col("id").cast("string")).alias("text"))
    units = t.rating_unit.groupBy("planning_zone_code").agg(F.count("*").alias("n"))
    return files.decode(units, "planning_zone_code", domain, "zone_name").groupBy("zone_name").agg(F.sum("n").alias("units"))


@query("missing_line_numbers", "WITH t AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, unnest(range(1, top + 1)) AS missing FROM t) SELECT l_orderkey, CAST(missing AS INTEGER) AS missing FROM e EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem")
def missing_line_numbers(t: Tables) -> DataFrame:
    return quality.gaps(t.lineitem, "l_orderkey", "l_linenumber")


@query("surrogate_ids", "SELECT row_number() OVER (ORDER BY name, suburb_id) AS new_id, suburb_id FROM suburb")
def surrogate_ids(t: Tables) -> DataFrame:
    """Consecutive ids in the order of names: rows are range-sorted, then numbered by partition offsets, not in one task."""
    parts = checkpointed(t.suburb.select("name", "suburb_id").repartitionByRange(F.col("name").asc_nulls_last(), "suburb_id").sortWithinPartitions(F.col("name").asc_nulls_last(), "suburb_id").withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("i0"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return parts.join(before.select("p", "i0", "before"), "p").select((F.col("before") + F.col("i") - F.col("i0") + 1).alias("new_id"), "suburb_id")


@query("status_report", "SELECT min(source_as_at) AS first_release, max(source_as_at) AS last_release, count(DISTINCT source_as_at) AS releases, (SELECT string_agg(DISTINCT strftime(source_as_at, '%Y-%m'), ',' ORDER BY strftime(source_as_at, '%Y-%m')) FROM market_snapshot) AS months, count(*) AS rows FROM market_snapshot")
def status_report(t: Tables) -> DataFrame:
    return t.market_snapshot.agg(
        F.min("source_as_at").alias("first_release"), F.max("source_as_at").alias("last_release"), F.count_distinct("source_as_at").alias("releases"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("source_as_at", "yyyy-MM"))), ",").alias("months"), F.count("*").alias("rows"),
    )


QUERIES, SQL = query.queries, query.sql
