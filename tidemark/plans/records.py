"""Queries of the record-keeping operators over the property tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, nearby, orphans, profile, snapshot_diff
from tidemark.sources.tables import table

NEAR_M = 40.0


def valued_units(spark: SparkSession, d: str) -> DataFrame:
    """Located rating units that occur in valuation."""
    units = table(spark, d, "rating_unit").select("ru_id", "lon", "lat").where("lon between 166 and 179 and lat between -47 and -34")
    used = table(spark, d, "valuation").select("ru_id").where("ru_id is not null").distinct()
    return units.join(used, "ru_id", "left_semi")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Units at most 40 m apart, and the board that contains each suburb's centroid."""
    pairs = nearby.near_pairs(valued_units(spark, d), "ru_id", "lon", "lat", NEAR_M)
    suburbs = table(spark, d, "suburb").select("suburb_id", F.col("centroid.x").alias("lon"), F.col("centroid.y").alias("lat"))
    boards = nearby.regions_of(suburbs, "suburb_id", "lon", "lat", table(spark, d, "local_board"), "board_id", "rings")
    long = lambda rel, df, a, b: df.select(F.lit(rel).alias("relation"), F.col(a).cast("long").alias("left_id"), F.col(b).cast("long").alias("right_id"))
    return long("unit_unit", pairs, "left_id", "right_id").unionByName(long("suburb_board", boards, "id", "region"))


P1_SQL = """
WITH u AS (
  SELECT ru_id, lon, lat, CAST(floor(lon / 0.0006) AS BIGINT) AS cx, CAST(floor(lat / 0.0004) AS BIGINT) AS cy
  FROM rating_unit WHERE lon BETWEEN 166 AND 179 AND lat BETWEEN -47 AND -34 AND ru_id IN (SELECT ru_id FROM valuation)),
o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
near AS (
  SELECT a.ru_id AS l, b.ru_id AS r FROM (SELECT u.*, cx + dx AS nx, cy + dy AS ny FROM u, o) a
  JOIN u b ON a.nx = b.cx AND a.ny = b.cy AND a.ru_id < b.ru_id
  WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 40),
r AS (SELECT board_id, unnest(rings) AS ring FROM local_board),
e AS (SELECT board_id, ring, unnest(range(1, len(ring))) AS i FROM r),
s AS (SELECT board_id, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM e),
b AS (
  SELECT suburb_id, board_id FROM suburb, s WHERE (y1 > centroid.y) <> (y2 > centroid.y) AND centroid.x < (x2 - x1) * (centroid.y - y1) / (y2 - y1) + x1
  GROUP BY suburb_id, board_id HAVING count(*) % 2 = 1)
SELECT 'unit_unit' AS relation, CAST(l AS BIGINT) AS left_id, CAST(r AS BIGINT) AS right_id FROM near
UNION ALL SELECT 'suburb_board', CAST(suburb_id AS BIGINT), CAST(board_id AS BIGINT) FROM b"""

MARKET_RANGES = {"est_gross_yield_pct": (0.5, 15.0), "median_days_to_sell": (1.0, 300.0)}
MARKET_PATTERNS = {"source_url": r"^https://www\.suburb-ledger\.example/[^?#]*[^/?#]$"}




def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Releases and months in which nulls, ranges, modes or medians of a column go wrong, judged on its profile."""
    market = profile.unpivot(table(spark, d, "market_snapshot"), list(MARKET_RANGES), F.col("source_as_at"), ranges=MARKET_RANGES)
    quality = profile.unpivot(table(spark, d, "data_quality"), ["value"], F.date_format("measured_at", "yyyy-MM"), F.col("metric"))
    cols = [F.lit("market_snapshot").alias("table_name"), "*"]
    m = profile.profile(market).select(*cols).withColumn("live", F.col("rows") - F.col("nulls"))
    usual = m.groupBy("col").agg(F.median("null_share").alias("usual_nulls"), F.median("median").alias("usual_median"))
    # a row for each column of the table: Spark may broadcast it by its size
    m = m.join(usual, "col")
    found_m = F.filter(
        F.array(
            F.when(F.col("null_share") - F.col("usual_nulls") > 0.15, "nulls"),
            F.when((F.col("live") > 0) & (F.col("bad") > 0.05 * F.col("live")), "range"),
            F.when((F.col("live") > 0) & (F.col("mode_n") > 0.32 * F.col("live")), "mode"),
            F.when(F.abs(F.col("median") - F.col("usual_median")) > 0.25 * F.abs("usual_median"), "shift"),
        ),
        lambda x: x.isNotNull(),
    )
    q = profile.profile(quality).select(F.lit("data_quality").alias("table_name"), "*").withColumn("live", F.col("rows") - F.col("nulls"))
    dq = table(spark, d, "data_quality")
    base = dq.where("measured_at >= timestamp_ntz'2025-01-01' and measured_at < timestamp_ntz'2025-04-01'")
    first = profile.profile(profile.unpivot(base, ["value"], F.lit("base"), F.col("metric"))).select("series", F.col("median").alias("base_median"))
    q = q.join(first, "series", "left")
    found_q = F.filter(
        F.array(
            F.when(F.col("nulls") > 0.5 * F.col("rows"), "nulls"),
            F.when(F.col("series").contains("_with_") & (F.col("live") > 0) & ((F.col("min") < 0) | (F.col("max") > 1)), "range"),
            F.when(F.abs(F.col("median") - F.col("base_median")) > 0.1 * F.abs("base_median"), "shift"),
        ),
        lambda x: x.isNotNull(),
    )
    out = lambda df, found: df.select("table_name", F.col("col").alias("column_name"), "series", F.col("load").alias("load_key"), F.explode(found).alias("finding"))
    return out(m, found_m).unionByName(out(q, found_q))


P2_SQL = """
WITH m AS (
  SELECT 'est_gross_yield_pct' AS c, source_as_at AS r, est_gross_yield_pct AS v, 0.5 AS lo, 15 AS hi FROM market_snapshot
  UNION ALL SELECT 'median_days_to_sell', source_as_at, CAST(median_days_to_sell AS DOUBLE), 1, 300 FROM market_snapshot),
g AS (
  SELECT c, r, count(*) AS n, count(v) AS live, (count(*) - count(v)) / count(*) AS ns, median(v) AS med,
         count(*) FILTER (v < lo OR v > hi) AS bad FROM m GROUP BY c, r),
mo AS (SELECT c, r, max(k) AS k FROM (SELECT c, r, v, count(*) AS k FROM m WHERE v IS NOT NULL GROUP BY c, r, v) GROUP BY c, r),
u AS (SELECT c, median(ns) AS un, median(med) AS um FROM g GROUP BY c),
mf AS (
  SELECT g.*, un, um, k FROM g JOIN u USING (c) LEFT JOIN mo USING (c, r)),
q AS (
  SELECT metric AS s, strftime(measured_at, '%Y-%m') AS r, count(*) AS n, count(value) AS live, median(value) AS med, min(value) AS lo, max(value) AS hi
  FROM data_quality GROUP BY 1, 2),
b AS (SELECT metric AS s, median(value) AS bm FROM data_quality WHERE measured_at >= '2025-01-01' AND measured_at < '2025-04-01' GROUP BY 1),
qf AS (SELECT q.*, bm FROM q LEFT JOIN b USING (s))
SELECT 'market_snapshot' AS table_name, c AS column_name, '' AS series, strftime(r, '%Y-%m-%d') AS load_key, 'nulls' AS finding FROM mf WHERE ns - un > 0.15
UNION ALL SELECT 'market_snapshot', c, '', strftime(r, '%Y-%m-%d'), 'range' FROM mf WHERE live > 0 AND bad > 0.05 * live
UNION ALL SELECT 'market_snapshot', c, '', strftime(r, '%Y-%m-%d'), 'mode' FROM mf WHERE live > 0 AND k > 0.32 * live
UNION ALL SELECT 'market_snapshot', c, '', strftime(r, '%Y-%m-%d'), 'shift' FROM mf WHERE abs(med - um) > 0.25 * abs(um)
UNION ALL SELECT 'data_quality', 'value', s, r, 'nulls' FROM qf WHERE n - live > 0.5 * n
UNION ALL SELECT 'data_quality', 'value', s, r, 'range' FROM qf WHERE contains(s, '_with_') AND (lo < 0 OR hi > 1)
UNION ALL SELECT 'data_quality', 'value', s, r, 'shift' FROM qf WHERE abs(med - bm) > 0.1 * abs(bm)"""


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of market_snapshot per release, with the distance to the release before."""
    df = table(spark, d, "market_snapshot")
    columns = [c for c in df.columns if c != "source_as_at"]
    p = profile.profile(profile.unpivot(df, columns, F.col("source_as_at"), patterns=MARKET_PATTERNS, ranges=MARKET_RANGES))
    return p.select("col", "load", "rows", "nulls", "n_distinct", "bad", "mode_n", *[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max", "ks")], "min_text", "max_text")


def _p2_profile_sql() -> str:
    ints = "suburb_id run_id avg_house_value value_1y_ago value_2y_ago median_weekly_rent population median_days_to_sell median_days_to_rent sold_last_12m listed_last_month rent_1bed rent_2bed rent_3bed rent_4bed".split()
    doubles = "change_1y change_2y long_term_growth_pct est_gross_yield_pct renter_pct bed1_pct bed2_pct bed3_pct bed4_pct bed5_pct".split()
    rng = {c: f"v < {lo} OR v > {hi}" for c, (lo, hi) in MARKET_RANGES.items()}
    rows = [f"SELECT '{c}' AS col, CAST(source_as_at AS VARCHAR) AS load, CAST({c} AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS t FROM market_snapshot" for c in ints + doubles]
    rows.append("SELECT 'source_url', CAST(source_as_at AS VARCHAR), NULL, source_url FROM market_snapshot")
    # a timestamp's text has no trailing zeros in its fraction
    rows.append("SELECT 'captured_at', CAST(source_as_at AS VARCHAR), NULL, CAST(captured_at AS VARCHAR) FROM market_snapshot")
    bad = " ".join(f"WHEN col = '{c}' AND ({cond}) THEN 1" for c, cond in rng.items())
    pattern = MARKET_PATTERNS["source_url"]
    return f"""
WITH l AS ({" UNION ALL ".join(rows)}),
g AS (
  SELECT col, load, count(*) AS rows, count(*) - count(v) - count(t) AS nulls, count(DISTINCT v) + count(DISTINCT t) AS n_distinct,
    CAST(sum(CASE {bad} WHEN col = 'source_url' AND NOT regexp_matches(t, '{pattern}') THEN 1 ELSE 0 END) AS BIGINT) AS bad,
    round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max,
    min(t) AS min_text, max(t) AS max_text FROM l GROUP BY col, load),
m AS (SELECT col, load, max(k) AS mode_n FROM (SELECT col, load, v, t, count(*) AS k FROM l WHERE v IS NOT NULL OR t IS NOT NULL GROUP BY ALL) GROUP BY col, load),
c AS (SELECT col, load, v, t, count(*) AS k FROM l WHERE v IS NOT NULL OR t IS NOT NULL GROUP BY ALL),
n AS (SELECT col, load, sum(k) AS n, lag(load) OVER (PARTITION BY col ORDER BY load) AS prev FROM c GROUP BY col, load),
x AS (
  SELECT n.col, n.load, c.v, c.t, k / n.n AS w FROM n JOIN c ON c.col = n.col AND c.load = n.load WHERE prev IS NOT NULL
  UNION ALL SELECT n.col, n.load, c.v, c.t, -k / p.n FROM n JOIN c ON c.col = n.col AND c.load = n.prev JOIN n p ON p.col = n.col AND p.load = n.prev),
y AS (SELECT col, load, sum(sum(w)) OVER (PARTITION BY col, load ORDER BY v, t) AS d FROM x GROUP BY col, load, v, t),
ks AS (SELECT col, load, round(max(abs(d)), 6) AS ks FROM y GROUP BY col, load)
SELECT col, load, rows, nulls, n_distinct, bad, coalesce(mode_n, 0) AS mode_n, min, p25, median, p75, max, ks, min_text, max_text
FROM g LEFT JOIN m USING (col, load) LEFT JOIN ks USING (col, load)"""


RATE_KEYS = ["bank", "product", "term"]


def rate_history(spark: SparkSession, d: str) -> DataFrame:
    return history.rebuild_history(table(spark, d, "rate_snapshot"), RATE_KEYS, "as_at", "rate", "fetched_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every rate card, with the dates it was valid."""
    return rate_history(spark, d).select(*RATE_KEYS, F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("")).alias("valid_to"))


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt bank_rate: each rate with valid_from, valid_to and is_current."""
    return rate_history(spark, d).select(*RATE_KEYS, F.col("value").alias("rate"), "valid_from", "valid_to", "is_current")


_P3 = """
WITH o AS (
  SELECT lower(trim(regexp_replace(coalesce(bank, ''), '\\s+', ' ', 'g'))) AS bank, lower(trim(regexp_replace(coalesce(product, ''), '\\s+', ' ', 'g'))) AS product,
         lower(trim(regexp_replace(coalesce(term, ''), '\\s+', ' ', 'g'))) AS term, as_at, fetched_at, round(rate, 2) AS rate FROM rate_snapshot WHERE as_at IS NOT NULL),
l AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY bank, product, term, as_at ORDER BY fetched_at DESC NULLS LAST, rate DESC NULLS LAST) AS rn FROM o) WHERE rn = 1),
cal AS (SELECT DISTINCT bank, as_at FROM l),
k AS (SELECT DISTINCT bank, product, term FROM l),
grid AS (
  SELECT k.*, cal.as_at, nullif(l.rate, 0) AS rate FROM k JOIN cal USING (bank) LEFT JOIN l USING (bank, product, term, as_at)),
c AS (SELECT *, lag(rate) OVER w AS prev, row_number() OVER w AS rn FROM grid WINDOW w AS (PARTITION BY bank, product, term ORDER BY as_at)),
ch AS (SELECT * FROM c WHERE rate IS DISTINCT FROM prev),
v AS (SELECT *, lead(as_at) OVER (PARTITION BY bank, product, term ORDER BY as_at) AS upto FROM ch)
"""
P3_SQL = _P3 + "SELECT bank, product, term, strftime(as_at, '%Y-%m-%d') AS valid_from, coalesce(strftime(upto, '%Y-%m-%d'), '') AS valid_to FROM v WHERE rate IS NOT NULL"
P3_HISTORY_SQL = _P3 + "SELECT bank, product, term, rate, as_at AS valid_from, upto AS valid_to, upto IS NULL AS is_current FROM v WHERE rate IS NOT NULL"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References to suburbs and rating units that do not exist, or did not at the time of the load."""
    runs = table(spark, d, "pipeline_run").select("run_id", F.to_date("started_at").alias("load"))
    valuation = table(spark, d, "valuation").select("ru_id", "valuation_date", "run_id").distinct().join(runs, "run_id", "left")
    month = lambda c: F.date_format(c, "yyyy-MM")
    units = orphans.orphans(valuation, table(spark, d, "rating_unit"), F.col("ru_id").cast("long"), F.col("load"), month("valuation_date"), F.col("ru_id").cast("long"), F.col("first_seen"), F.col("last_seen"))
    places = orphans.orphans(
        table(spark, d, "market_snapshot"), table(spark, d, "suburb"), F.col("suburb_id").cast("long"), F.to_date("captured_at"), month("source_as_at"), F.col("suburb_id").cast("long"), F.col("first_seen")
    )
    out = lambda name, df: df.select(F.lit(name).alias("table_name"), F.col("key").alias("ref_id"), "period", "kind")
    return out("valuation", units).unionByName(out("market_snapshot", places))


_P4 = """
WITH v AS (
  SELECT 'valuation' AS table_name, CAST(v.ru_id AS BIGINT) AS ref_id, strftime(valuation_date, '%Y-%m') AS period, CAST(p.started_at AS DATE) AS load,
         r.ru_id IS NULL AS gone, r.first_seen, r.last_seen
  FROM valuation v LEFT JOIN pipeline_run p USING (run_id) LEFT JOIN rating_unit r ON r.ru_id = v.ru_id WHERE v.ru_id IS NOT NULL
  UNION ALL
  SELECT 'market_snapshot', CAST(m.suburb_id AS BIGINT), strftime(source_as_at, '%Y-%m'), CAST(captured_at AS DATE), s.suburb_id IS NULL, s.first_seen, NULL
  FROM market_snapshot m LEFT JOIN suburb s ON s.suburb_id = m.suburb_id WHERE m.suburb_id IS NOT NULL),
f AS (
  SELECT DISTINCT table_name, ref_id, period, kind FROM (
    SELECT *, unnest([CASE WHEN gone THEN 'missing' END, CASE WHEN NOT gone AND first_seen > load THEN 'late' END, CASE WHEN NOT gone AND last_seen < load THEN 'deleted' END]) AS kind FROM v)
  WHERE kind IS NOT NULL)
"""
P4_SQL = _P4 + "SELECT * FROM f"


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """How many keys are orphans per table, period and kind."""
    return orphans.report(p4_found(spark, d))


P4_REPORT_SQL = _P4 + "SELECT table_name, period, kind, count(*) AS n_keys FROM f GROUP BY ALL"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Suburbs added, removed or changed between consecutive releases."""
    diff = snapshot_diff.snapshot_diff(table(spark, d, "market_snapshot"), ["suburb_id"], "source_as_at", ["avg_house_value", "median_weekly_rent"], "captured_at")
    return diff.select("suburb_id", F.date_format("release", "yyyy-MM-dd").alias("source_as_at"), "change")


P7_SQL = """
WITH l AS (
  SELECT suburb_id, source_as_at, nullif(avg_house_value, 0) AS a, nullif(median_weekly_rent, 0) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY suburb_id, source_as_at ORDER BY captured_at DESC NULLS LAST, nullif(avg_house_value, 0) DESC NULLS LAST, nullif(median_weekly_rent, 0) DESC NULLS LAST) AS rn
    FROM market_snapshot WHERE suburb_id IS NOT NULL AND source_as_at IS NOT NULL) WHERE rn = 1),
rel AS (SELECT r AS new, lag(r) OVER (ORDER BY r) AS old FROM (SELECT DISTINCT source_as_at AS r FROM l)),
n AS (SELECT l.*, old FROM l JOIN rel ON l.source_as_at = rel.new WHERE old IS NOT NULL),
o AS (SELECT l.*, new FROM l JOIN rel ON l.source_as_at = rel.old)
SELECT coalesce(n.suburb_id, o.suburb_id) AS suburb_id, strftime(coalesce(n.source_as_at, o.new), '%Y-%m-%d') AS source_as_at,
  CASE WHEN o.suburb_id IS NULL THEN 'added' WHEN n.suburb_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.suburb_id = o.suburb_id AND n.source_as_at = o.new
WHERE o.suburb_id IS NULL OR n.suburb_id IS NULL OR n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_profile": p2_profile, "p3_found": p3_found, "p3_history": p3_history, "p4_found": p4_found, "p4_report": p4_report, "p7_found": p7_found}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_profile": _p2_profile_sql(), "p3_found": P3_SQL, "p3_history": P3_HISTORY_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p7_found": P7_SQL}
