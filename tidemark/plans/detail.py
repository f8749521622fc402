"""Gridded detail, rankings, text and the structured query interface over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import area_m2, has_han, haversine_km, label_form, name_key, python_round, ratio, serial_date, trim_to_sentence
from tidemark.operators import api, grid, model, quality, text
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.views import _CURRENT, _NOW, _OVERVIEW, _ROUND_DATES, _ROUNDS, _THEN, LEAST_UNITS, current, overview, round_dates, rounds_on
from tidemark.session import checkpointed

query = Registry()
CELL = 0.004


def points(t: Tables) -> DataFrame:
    """suburb_id, x, y, v of the located units of the current round."""
    rows = current(t).where("cv > 0 and suburb_id is not null and lon between 166 and 179 and lat between -47 and -34")
    return rows.select("suburb_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("cv").alias("v"))


_POINTS = f"""{_CURRENT}, pt AS (SELECT suburb_id, lon AS x, lat AS y, cv AS v FROM cur WHERE cv > 0 AND suburb_id IS NOT NULL AND lon BETWEEN 166 AND 179 AND lat BETWEEN -47 AND -34),
  bx AS (SELECT suburb_id, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), 1e-6) AS w, greatest(max(y) - min(y), 1e-6) AS h FROM pt GROUP BY suburb_id),
  gs AS (SELECT suburb_id, x0, y0, size, CAST(greatest(1, least(200, ceil(w / size))) AS INTEGER) AS nx, CAST(greatest(1, least(200, ceil(h / size))) AS INTEGER) AS ny FROM (SELECT *, greatest({CELL}, greatest(w, h) / 200) AS size FROM bx)),
  ce AS (SELECT suburb_id, CAST(least(nx - 1, floor((x - x0) / size)) AS INTEGER) AS gx, CAST(least(ny - 1, floor((y - y0) / size)) AS INTEGER) AS gy, median(v) AS v, count(*) AS n FROM pt JOIN gs USING (suburb_id) GROUP BY ALL)"""


@query("grid_cells", f"WITH {_POINTS} SELECT suburb_id, gx, gy, v, n FROM ce")
def grid_cells(t: Tables) -> DataFrame:
    """Median values in grid cells of each suburb."""
    p = points(t)
    return grid.cells(p, "suburb_id", grid.bounds(p, "suburb_id", CELL))


_FILL = """{new} AS (SELECT c.suburb_id, c.gx, c.gy, median(c.v) AS v FROM (SELECT k.suburb_id, k.gx + dx AS gx, k.gy + dy AS gy, k.v FROM {old} k, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0) c
  JOIN gs USING (suburb_id) LEFT JOIN {old} h ON h.suburb_id = c.suburb_id AND h.gx = c.gx AND h.gy = c.gy WHERE h.v IS NULL AND c.gx >= 0 AND c.gy >= 0 AND c.gx < nx AND c.gy < ny GROUP BY ALL HAVING count(*) >= 3)"""


@query("grid_filled", f"WITH {_POINTS}, k0 AS (SELECT suburb_id, gx, gy, v FROM ce), {_FILL.format(new='a1', old='k0')}, k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM a1), {_FILL.format(new='a2', old='k1')} SELECT * FROM k1 UNION ALL SELECT * FROM a2")
def grid_filled(t: Tables) -> DataFrame:
    """Cells with the gaps that two passes over their neighbours fill."""
    p = checkpointed(points(t))
    g = grid.bounds(p, "suburb_id", CELL)
    return grid.fill(checkpointed(grid.cells(p, "suburb_id", g)), "suburb_id", g)


_BLUR = """{new} AS (SELECT o.suburb_id, o.gx, o.gy, sum(b.a) / 9 AS a, sum(b.m) / 9 AS m FROM {out} o JOIN gs USING (suburb_id), (VALUES (-1), (0), (1)) i(dx), (VALUES (-1), (0), (1)) j(dy), {old} b
  WHERE b.suburb_id = o.suburb_id AND b.gx = greatest(0, least(nx - 1, o.gx + dx)) AND b.gy = greatest(0, least(ny - 1, o.gy + dy)) GROUP BY ALL)"""
_SMOOTH = f"""WITH {_POINTS}, f0 AS (SELECT suburb_id, CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy FROM (SELECT suburb_id, unnest(range(nx)) AS x, ny FROM gs), LATERAL (SELECT unnest(range(ny)) AS y)),
  s0 AS (SELECT f.suburb_id, f.gx, f.gy, coalesce(v, 0) AS a, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS m FROM f0 f LEFT JOIN ce USING (suburb_id, gx, gy)), {_BLUR.format(new='s1', out='f0', old='s0')}, {_BLUR.format(new='s2', out='f0', old='s1')}, {_BLUR.format(new='s3', out='f0', old='s2')}
  SELECT suburb_id, gx, gy, round(a / m, 2) AS v FROM s3 JOIN ce USING (suburb_id, gx, gy)"""


@query("grid_smoothed", _SMOOTH)
def grid_smoothed(t: Tables) -> DataFrame:
    p = points(t)
    g = grid.bounds(p, "suburb_id", CELL)
    return grid.smooth(grid.cells(p, "suburb_id", g), "suburb_id", g).withColumn("v", F.round("v", 2))


@query("grid_lookup", f"WITH {_POINTS} SELECT s.suburb_id, ce.v FROM suburb s JOIN gs ON gs.suburb_id = s.suburb_id JOIN ce ON ce.suburb_id = s.suburb_id AND ce.gx = CAST(floor((centroid.x - x0) / size) AS INTEGER) AND ce.gy = CAST(floor((centroid.y - y0) / size) AS INTEGER)")
def grid_lookup(t: Tables) -> DataFrame:
    """The value of the cell that each suburb's centre falls into."""
    p = points(t)
    g = grid.bounds(p, "suburb_id", CELL)
    at = lambda c, o: F.floor((F.col(c) - F.col(o)) / F.col("size")).try_cast("int")
    s = t.suburb.select("suburb_id", F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy")).where("cx between -180 and 180").join(g, "suburb_id")
    return s.select("suburb_id", at("cx", "x0").alias("gx"), at("cy", "y0").alias("gy")).join(grid.cells(p, "suburb_id", g).drop("n"), ["suburb_id", "gx", "gy"]).select("suburb_id", "v")


_HIST = f"""{_CURRENT}, pv AS (SELECT suburb_id, cv AS v FROM cur WHERE cv > 0 AND suburb_id IS NOT NULL), so AS (SELECT suburb_id, list(v ORDER BY v) AS l FROM pv GROUP BY suburb_id),
  en AS (SELECT suburb_id, CAST(greatest(l[1 + least(len(l) - 1, CAST(floor(0.02 * len(l)) AS BIGINT))], 1) AS DOUBLE) AS lo, CAST(greatest(l[1 + least(len(l) - 1, CAST(floor(0.98 * len(l)) AS BIGINT))], 2) AS DOUBLE) AS hi, len(l) AS n FROM so),
  bi AS (SELECT suburb_id, lo, hi, n, CAST(greatest(0, least(23, trunc(CASE WHEN hi > lo THEN ln(greatest(v, 1) / lo) / ln(hi / lo) * 24 ELSE 0 END))) AS INTEGER) AS b FROM pv JOIN en USING (suburb_id))"""


@query("log_histogram", f"WITH {_HIST} SELECT suburb_id, lo, hi, n, b, count(*) AS k FROM bi GROUP BY ALL")
def log_histogram(t: Tables) -> DataFrame:
    """Histograms of log width, one row for each bin that is not empty."""
    h = grid.log_histogram(current(t).where("cv > 0 and suburb_id is not null"), "suburb_id", "cv")
    return h.select("suburb_id", "lo", "hi", "n", F.posexplode("hist").alias("b", "k")).where("k > 0")


@query("share_below", f"""WITH {_HIST}, c AS (SELECT suburb_id, lo, hi, n, ln(800000 / lo) / ln(hi / lo) * 24 AS pos, count(*) FILTER (b < floor(ln(800000 / lo) / ln(hi / lo) * 24)) AS below, count(*) FILTER (b = floor(ln(800000 / lo) / ln(hi / lo) * 24)) AS inside, count(*) FILTER (b = 0) AS first FROM bi WHERE hi > lo GROUP BY ALL)
  SELECT suburb_id, round(CASE WHEN 800000 >= hi THEN 1.0 WHEN 800000 <= lo THEN first / n * 800000 / lo ELSE (below + inside * (pos - floor(pos))) / n END, 6) AS share FROM c""")
def share_below(t: Tables) -> DataFrame:
    """The share of a suburb's units under a budget, interpolated on its histogram."""
    h = grid.log_histogram(current(t).where("cv > 0 and suburb_id is not null"), "suburb_id", "cv").where("hi > lo")
    return h.select("suburb_id", F.round(grid.share_below(F.lit(800_000.0)), 6).alias("share"))


_NR = lambda q: f"l[1 + least(len(l) - 1, CAST(floor({q} * len(l)) AS BIGINT))]"


@query("nearest_rank_quantiles", f"WITH {_CURRENT}, so AS (SELECT suburb_id, list(cv ORDER BY cv) AS l FROM cur WHERE cv > 0 AND suburb_id IS NOT NULL GROUP BY suburb_id) SELECT suburb_id, len(l) AS n, {_NR(0.1)} AS q10, {_NR(0.25)} AS q25, {_NR(0.5)} AS q50, {_NR(0.75)} AS q75, {_NR(0.9)} AS q90 FROM so")
def nearest_rank_quantiles(t: Tables) -> DataFrame:
    return grid.nearest_ranks(current(t).where("cv > 0 and suburb_id is not null"), "suburb_id", "cv", {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9})


@query("current_and_previous", f"WITH {_ROUNDS}, {_ROUND_DATES} SELECT r.suburb_id, count(*) AS units, sum(c.cv)::BIGINT AS now, sum(coalesce(p.cv, 0))::BIGINT AS before FROM rating_unit r JOIN val c ON c.ru_id = r.ru_id AND c.valuation_date = {_NOW} LEFT JOIN val p ON p.ru_id = r.ru_id AND p.valuation_date = {_THEN} WHERE c.cv > 0 AND r.suburb_id IS NOT NULL GROUP BY r.suburb_id")
def current_and_previous(t: Tables) -> DataFrame:
    """Units of the current round with their value of the round before, 0 if they had none."""
    before = rounds_on(t, round_dates(t)[1]).select("ru_id", F.col("cv").alias("before"))
    rows = current(t).where("cv > 0 and suburb_id is not null").join(before, "ru_id", "left")
    return rows.groupBy("suburb_id").agg(F.count("*").alias("units"), F.sum("cv").alias("now"), F.sum(F.coalesce("before", F.lit(0))).alias("before"))


STANDARD = ["cv_median", "avg_house_value", "median_weekly_rent", "est_gross_yield_pct"]


@query("reference_quartiles", f"{_OVERVIEW}, l AS (SELECT unnest([{', '.join(repr(c) for c in STANDARD)}]) AS metric, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in STANDARD)}]) AS v FROM ov), so AS (SELECT metric, list(v ORDER BY v) AS l FROM l WHERE v IS NOT NULL GROUP BY metric) SELECT metric, len(l) AS n, {_NR(0.25)} AS p25, {_NR(0.5)} AS p50, {_NR(0.75)} AS p75 FROM so")
def reference_quartiles(t: Tables) -> DataFrame:
    """Quartiles of several metrics at once, over the unpivoted overview."""
    long = overview(t).unpivot("suburb_id", [F.col(c).cast("double").alias(c) for c in STANDARD], "metric", "v")
    return grid.nearest_ranks(long, "metric", "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("suburb_standing", f"{_OVERVIEW}, p AS (SELECT suburb_id, avg_house_value AS v FROM ov WHERE avg_house_value IS NOT NULL) SELECT suburb_id, (SELECT count(*) FROM p b WHERE b.v < a.v) AS cheaper, (SELECT count(*) FROM p) - (SELECT count(*) FROM p b WHERE b.v < a.v) AS place, round((SELECT count(*) FROM p b WHERE b.v < a.v) / ((SELECT count(*) FROM p) - 1), 6) AS position FROM p a")
def suburb_standing(t: Tables) -> DataFrame:
    """Each suburb's place among all by price. The window holds one row for each price, not for each row of a fact."""
    p = overview(t).where("avg_house_value is not null").select("suburb_id", F.col("avg_house_value").alias("v"))
    per = p.groupBy("v").agg(F.count("*").alias("k"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.select("v", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("cheaper"), F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    return p.join(ranked, "v").select("suburb_id", "cheaper", (F.col("all") - F.col("cheaper")).alias("place"), F.round(F.try_divide("cheaper", F.col("all") - 1), 6).alias("position"))


@query("extremes", f"{_OVERVIEW} SELECT median(avg_house_value) AS mid, max(avg_house_value) AS dearest, min(avg_house_value) AS cheapest, round(max(avg_house_value) / nullif(min(avg_house_value), 0), 4) AS ratio FROM ov")
def extremes(t: Tables) -> DataFrame:
    v = F.col("avg_house_value")
    return overview(t).agg(F.median(v).alias("mid"), F.max(v).alias("dearest"), F.min(v).alias("cheapest"), F.round(ratio(F.max(v), F.min(v)), 4).alias("ratio"))


@query("land_stats", "SELECT suburb_id, median(land_area_m2) FILTER (WHERE land_area_m2 BETWEEN 100 AND 5000) AS median_section, round(count(*) FILTER (WHERE land_area_m2 >= 300) / count(*), 3) AS large_share FROM rating_unit WHERE suburb_id IS NOT NULL GROUP BY suburb_id")
def land_stats(t: Tables) -> DataFrame:
    a = F.col("land_area_m2")
    return t.rating_unit.where("suburb_id is not null").groupBy("suburb_id").agg(F.median(F.when(a.between(100, 5000), a)).alias("median_section"), F.round(quality.share(a >= 300), 3).alias("large_share"))


@query("zone_shares", "SELECT planning_zone_code, count(*) AS units, round(count(*) / (SELECT count(*) FROM rating_unit), 6) AS share FROM rating_unit GROUP BY planning_zone_code")
def zone_shares(t: Tables) -> DataFrame:
    n = t.rating_unit.groupBy("planning_zone_code").agg(F.count("*").alias("units"))
    total = n.agg(F.sum("units").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("planning_zone_code", "units", F.round(F.col("units") / F.col("total"), 6).alias("share"))  # one row


@query("zones_of_suburbs", "SELECT suburb_id, list_sort(list_distinct(list(planning_zone_code))) AS zones FROM rating_unit WHERE suburb_id IS NOT NULL AND planning_zone_code IS NOT NULL GROUP BY suburb_id")
def zones_of_suburbs(t: Tables) -> DataFrame:
    return t.rating_unit.where("suburb_id is not null and planning_zone_code is not null").groupBy("suburb_id").agg(F.array_sort(F.collect_set("planning_zone_code")).alias("zones"))


@query("dominant_zone", "SELECT suburb_id, planning_zone_code, n FROM (SELECT *, row_number() OVER (PARTITION BY suburb_id ORDER BY n DESC, planning_zone_code) AS rn FROM (SELECT suburb_id, planning_zone_code, count(*) AS n FROM rating_unit WHERE suburb_id IS NOT NULL AND planning_zone_code IS NOT NULL GROUP BY ALL)) WHERE rn = 1")
def dominant_zone(t: Tables) -> DataFrame:
    n = t.rating_unit.where("suburb_id is not null and planning_zone_code is not null").groupBy("suburb_id", "planning_zone_code").agg(F.count("*").alias("n"))
    best = n.groupBy("suburb_id").agg(F.max(F.struct("n", (-F.col("planning_zone_code")).alias("z"))).alias("b"))
    return best.select("suburb_id", (-F.col("b.z")).cast("int").alias("planning_zone_code"), "b.n")


@query("value_series", "SELECT suburb_id, min(year(source_as_at))::INTEGER AS first_year, list(CAST(round(v / 1000) AS INTEGER) ORDER BY source_as_at) AS series FROM (SELECT suburb_id, source_as_at, max(avg_house_value) AS v FROM market_snapshot WHERE suburb_id IS NOT NULL AND avg_house_value > 0 GROUP BY ALL) GROUP BY suburb_id HAVING count(*) >= 5")
def value_series(t: Tables) -> DataFrame:
    """Each suburb's values in order, in thousands, where there are at least five."""
    v = t.market_snapshot.where("suburb_id is not null and avg_house_value > 0").groupBy("suburb_id", "source_as_at").agg(F.max("avg_house_value").alias("v"))
    s = F.sort_array(F.collect_list(F.struct("source_as_at", F.round(F.col("v") / 1000).cast("int").alias("k"))))
    return v.groupBy("suburb_id").agg(F.year(F.min("source_as_at")).alias("first_year"), F.transform(s, lambda x: x["k"]).alias("series")).where(F.size("series") >= 5)


@query("event_fill_forward", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_paid FROM events""")
def event_fill_forward(t: Tables) -> DataFrame:
    """The last stated value carried forward over each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.events.select("user_id", "event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), True).over(w).alias("last_paid"))


@query("latest_events", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 8 AND event_type <> 'error'""")
def latest_events(t: Tables) -> DataFrame:
    """The last eight events of each user, errors left out afterwards."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 8").where("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query("event_intervals", """SELECT user_id, event_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "end" FROM events WHERE event_type = 'signup'""")
def event_intervals(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("start"), F.lead("ts").over(w).alias("end"))


@query("rising_orders", """WITH o AS (SELECT o_custkey, list([o_totalprice] ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey)
  SELECT o_custkey, len(l) AS orders, len(list_reduce(l, lambda acc, x: list_concat(list_concat(acc[1:len(list_filter(acc, lambda v: v < x[1]))], x), acc[len(list_filter(acc, lambda v: v < x[1])) + 2:]))) AS longest FROM o""")
def rising_orders(t: Tables) -> DataFrame:
    """The length of the longest rising run of each customer's order values, in order of date: the smallest end of a run of each length, folded over the orders."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"].cast("double"))

    def step(ends, x):
        k = F.size(F.filter(ends, lambda v: v < x))
        return F.concat(F.slice(ends, F.lit(1), k), F.array(x), F.slice(ends, k + 2, F.size(ends)))

    rows = t.orders.groupBy("o_custkey").agg(values.alias("v"))
    return rows.select("o_custkey", F.size("v").cast("long").alias("orders"), F.size(F.aggregate("v", F.array().cast("array<double>"), step)).cast("long").alias("longest"))


REQUEST = api.Request(zones=["West Hills", "Central"], numeric={"avg_house_value": (400_000, 1_500_000), "cbd_km": (None, 200)}, sort_by="median_weekly_rent", limit=12)
_WHERE = "zone IN ('West Hills', 'Central') AND avg_house_value BETWEEN 400000 AND 1500000 AND cbd_km <= 200"


@query("filtered_suburbs", f"{_OVERVIEW} SELECT name, zone, avg_house_value, median_weekly_rent FROM ov WHERE {_WHERE} ORDER BY median_weekly_rent DESC NULLS LAST, name LIMIT 12")
def filtered_suburbs(t: Tables) -> DataFrame:
    """A structured request: filters, sort with missing values last, limit (a feature of the request)."""
    return api.select(overview(t), REQUEST).select("name", "zone", "avg_house_value", "median_weekly_rent")


@query("bedroom_filter", """WITH m AS (SELECT suburb_id, concat_ws('/', bed1_pct, bed2_pct, bed3_pct, bed4_pct, bed5_pct) AS mix, bed3_pct, bed1_pct, bed2_pct, bed4_pct, bed5_pct FROM market_snapshot WHERE source_as_at = (SELECT max(source_as_at) FROM market_snapshot))
  SELECT count(*) AS matched FROM m WHERE bed3_pct >= 40 AND bed1_pct IS NOT NULL AND bed2_pct IS NOT NULL AND bed4_pct IS NOT NULL AND bed5_pct IS NOT NULL""")
def bedroom_filter(t: Tables) -> DataFrame:
    """Rows with enough three-bedroom homes by their mix text; an incomplete mix never matches."""
    m = t.market_snapshot.where(F.col("source_as_at") == t.market_snapshot.agg(F.max("source_as_at")).scalar()).withColumn("bedroom_mix", F.concat_ws("/", *[f"bed{i}_pct" for i in range(1, 6)]))
    return m.where(api.conditions(api.Request(bedrooms=(3, 40)))).agg(F.count("*").alias("matched"))


@query("summary_by_zone", f"{_OVERVIEW} SELECT major_name AS grp, count(*) AS matched, round_even(median(avg_house_value), 2) AS value, CAST(NULL AS VARCHAR) AS name FROM ov WHERE major_name IS NOT NULL GROUP BY major_name")
def summary_by_zone(t: Tables) -> DataFrame:
    return api.summarise(overview(t), api.Request(), "avg_house_value", "median", True, zone="major_name")


@query("summary_cheapest", f"{_OVERVIEW} SELECT 'all' AS grp, (SELECT count(*) FROM ov WHERE {_WHERE}) AS matched, CAST(avg_house_value AS DOUBLE) AS value, name FROM ov WHERE {_WHERE} ORDER BY avg_house_value, name LIMIT 1")
def summary_cheapest(t: Tables) -> DataFrame:
    return api.summarise(overview(t), REQUEST, "avg_house_value", "min", False)


@query("summary_counts", f"{_OVERVIEW} SELECT major_name AS grp, count(*) AS matched, CAST(nullif(count(avg_house_value), 0) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS name FROM ov WHERE major_name IS NOT NULL GROUP BY major_name")
def summary_counts(t: Tables) -> DataFrame:
    return api.summarise(overview(t), api.Request(), "avg_house_value", "count", True, zone="major_name")


@query("lookup_suburbs", "SELECT q.asked, s.name, s.name IS NOT NULL AS found FROM (SELECT unnest(['titono', 'Frobawold South', 'nowhere at all']) AS asked) q LEFT JOIN suburb s ON lower(s.name) = lower(q.asked)")
def lookup_suburbs(t: Tables) -> DataFrame:
    return api.lookup(t.suburb, ["titono", "Frobawold South", "nowhere at all"])


@query("name_search", "WITH h AS (SELECT name, CASE WHEN lower(name) = 'mount' THEN 0 ELSE 1 END AS rank FROM suburb WHERE lower(name) LIKE 'mount%') SELECT name, rank FROM h WHERE rank = (SELECT min(rank) FROM h)")
def name_search(t: Tables) -> DataFrame:
    return api.search_names(t.suburb, "Mount")


@query("calculations", "SELECT ru_id, cv + lv AS added, cv - lv AS subtracted, (cv + lv) / 2 AS mean, round((lv - cv) / abs(cv) * 100, 2) AS change FROM valuation WHERE cv > 0 AND lv > 0")
def calculations(t: Tables) -> DataFrame:
    """The calculations over every run's valuations."""
    v = t.valuation.where("cv > 0 and lv > 0")
    op = lambda name: api.calculate(F.lit(name), F.col("cv").cast("double"), F.col("lv").cast("double"))
    return v.select("ru_id", op("add").alias("added"), op("subtract").alias("subtracted"), op("mean").alias("mean"), F.round(op("percent_change"), 2).alias("change"))


@query("suburb_facts", "SELECT 'suburb:' || suburb_id || ':' || c AS label, n AS value_num, s AS value_str FROM (SELECT suburb_id, unnest(['zone', 'cbd_km']) AS c, unnest([NULL, cbd_km]) AS n, unnest([zone, NULL]) AS s FROM suburb) WHERE n IS NOT NULL OR s IS NOT NULL")
def suburb_facts(t: Tables) -> DataFrame:
    """Labelled facts of each suburb."""
    return api.facts(t.suburb, "suburb", "suburb_id", ["zone", "cbd_km"])


@query("dataset_description", f"{_OVERVIEW} SELECT unnest(['cv_median', 'avg_house_value', 'population']) AS field, unnest([count(cv_median), count(avg_house_value), count(population)]) AS filled, count(*) AS rows FROM ov")
def dataset_description(t: Tables) -> DataFrame:
    """How many suburbs have each field."""
    names = ["cv_median", "avg_house_value", "population"]
    n = overview(t).agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in names])
    return n.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names])).alias("c")).select("c.field", "c.filled", "rows")


@query("comparison", f"""{_OVERVIEW}, l AS (SELECT major_name AS d, unnest(['price', 'rent']) AS metric, unnest([median(avg_house_value), median(median_weekly_rent)]) AS v FROM ov WHERE major_name IS NOT NULL GROUP BY major_name)
  SELECT metric, arg_min(d, (v, d)) AS lowest, arg_max(d, (v, d)) AS highest, (max(v) - min(v)) / max(v) >= 0.02 AS decided FROM l WHERE v IS NOT NULL GROUP BY metric""")
def comparison(t: Tables) -> DataFrame:
    """For each metric the districts at either end, decided only if they differ by two per cent."""
    per = overview(t).where("major_name is not null").groupBy(F.col("major_name").alias("d")).agg(F.median("avg_house_value").alias("price"), F.median("median_weekly_rent").alias("rent"))
    long = per.unpivot("d", ["price", "rent"], "metric", "v").where("v is not null")
    low, high = F.min(F.struct("v", "d")), F.max(F.struct("v", "d"))
    return long.groupBy("metric").agg(low["d"].alias("lowest"), high["d"].alias("highest"), ((high["v"] - low["v"]) / high["v"] >= 0.02).alias("decided"))


@query("relaxed_requests", f"""{_OVERVIEW} SELECT unnest(['all', 'no price', 'no rent', 'no distance']) AS variant, unnest([count(*) FILTER (avg_house_value <= 800000 AND median_weekly_rent <= 600 AND cbd_km <= 100), count(*) FILTER (median_weekly_rent <= 600 AND cbd_km <= 100),
  count(*) FILTER (avg_house_value <= 800000 AND cbd_km <= 100), count(*) FILTER (avg_house_value <= 800000 AND median_weekly_rent <= 600)]) AS matched FROM ov""")
def relaxed_requests(t: Tables) -> DataFrame:
    """How many suburbs a request finds as it is and with one condition left out, in one pass."""
    c = {"price": F.coalesce(F.col("avg_house_value") <= 800_000, F.lit(False)), "rent": F.coalesce(F.col("median_weekly_rent") <= 600, F.lit(False)), "distance": F.coalesce(F.col("cbd_km") <= 100, F.lit(False))}
    both = lambda skip: reduce(lambda a, b: a & b, [v for k, v in c.items() if k != skip])
    n = overview(t).agg(*[F.count_if(both(k)).alias(k) for k in ("none", *c)])
    return n.select(F.explode(F.array(*[F.struct(F.lit("all" if k == "none" else f"no {k}").alias("variant"), F.col(k).alias("matched")) for k in ("none", *c)])).alias("v")).select("v.*")


@query("nearest_centres", "WITH u AS (SELECT suburb_id, centroid.x AS x, centroid.y AS y FROM suburb WHERE centroid.x BETWEEN 166 AND 179 AND centroid.y BETWEEN -47 AND -34) SELECT suburb_id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(-37.6 - y) / 2), 2) + cos(radians(y)) * cos(radians(-37.6)) * pow(sin(radians(172.7 - x) / 2), 2))), 3) AS km FROM u")
def nearest_centres(t: Tables) -> DataFrame:
    u = t.suburb.where("centroid.x between 166 and 179 and centroid.y between -47 and -34")
    return u.select("suburb_id", F.round(haversine_km(F.col("centroid.x"), F.col("centroid.y"), F.lit(172.7), F.lit(-37.6)), 3).alias("km"))


@query("area_labels", "SELECT ru_id, nullif(round(land_area_m2, 2), 0) AS metres, CASE WHEN land_area_m2 >= 10000 THEN 'HA' ELSE 'M2' END AS unit FROM rating_unit")
def area_labels(t: Tables) -> DataFrame:
    """Areas written as labels and read back."""
    a = F.col("land_area_m2")
    unit = F.when(a >= 10_000, "HA").otherwise("M2")
    label = F.when(a >= 10_000, F.concat((a / 10_000).cast("decimal(20,6)").cast("string"), F.lit(" HA"))).otherwise(F.concat(a.cast("decimal(20,2)").cast("string"), F.lit(" M2")))
    return t.rating_unit.select("ru_id", area_m2(label).alias("metres"), unit.alias("unit"))


@query("serial_dates", "SELECT ru_id, valuation_date AS back FROM valuation WHERE ru_id IS NOT NULL")
def serial_dates(t: Tables) -> DataFrame:
    """The dates of every run's valuations from their serial numbers."""
    n = F.datediff("valuation_date", F.lit("1899-12-30").cast("date"))
    return t.valuation.where("ru_id is not null").select("ru_id", serial_date(n, "2000-01-01", "2030-01-01").alias("back"))


@query("rounded_rents", "SELECT suburb_id, round_even(avg(est_gross_yield_pct), 2) AS mean_yield FROM market_snapshot WHERE suburb_id IS NOT NULL GROUP BY suburb_id")
def rounded_rents(t: Tables) -> DataFrame:
    return t.market_snapshot.where("suburb_id is not null").groupBy("suburb_id").agg(F.avg("est_gross_yield_pct").alias("y")).select("suburb_id", python_round(2)("y").alias("mean_yield"))


@query("name_keys", "SELECT suburb_id, regexp_replace(regexp_replace(lower(strip_accents(name)), '\\bmount\\b', 'mt', 'g'), '[^a-z0-9]', '', 'g') AS k FROM suburb")
def name_keys(t: Tables) -> DataFrame:
    return t.suburb.select("suburb_id", name_key(F.col("name")).alias("k"))


@query("text_scripts", "SELECT coalesce(regexp_matches(text, '[一-鿿]'), FALSE) AS han, count(*) AS texts FROM documents GROUP BY 1")
def text_scripts(t: Tables) -> DataFrame:
    return t.documents.groupBy(has_han(F.col("text")).alias("han")).agg(F.count("*").alias("texts"))


@query("trimmed_texts", r"""WITH h AS (SELECT doc_id, text, substring(text, 1, 520) AS head FROM documents), e AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])(\s|$)', 1) AS whole, regexp_extract(head, '(?s)^(.*)\s\S*$', 1) AS words FROM h)
  SELECT doc_id, CASE WHEN length(text) <= 520 THEN text WHEN whole <> '' THEN whole WHEN words <> '' THEN words ELSE head END AS text FROM e""")
def trimmed_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", trim_to_sentence(F.col("text"), 520).alias("text"))


@query("text_traits")
def text_traits(t: Tables) -> DataFrame:
    """Traits of each English text with the words that show them."""
    return english_traits(t).select("doc_id", F.explode("traits").alias("trait", "evidence"))


@query("trait_coverage")
def trait_coverage(t: Tables) -> DataFrame:
    return text.coverage(english_traits(t))


def english_traits(t: Tables) -> DataFrame:
    """The traits of each text whose label names English; the name of the place that a text is about shows nothing."""
    names = t.suburb.where("suburb_id is not null").groupBy("suburb_id").agg(F.min("name").alias("place"))
    docs = t.documents.where(label_form(F.col("lang")) == "en").select("doc_id", "text", "suburb_id").join(names, "suburb_id", "left")
    return text.traits(docs, "doc_id", "text", "place")


_MONEY = r"\$[0-9][0-9,]*(?:\.[0-9]+)?[mkMK]?"


@query("money_claims", f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '({_MONEY})', 1)) AS w FROM documents)
  SELECT doc_id, round(CAST(regexp_replace(w, '[$,mkMK]', '', 'g') AS DOUBLE) * CASE WHEN w ILIKE '%m' THEN 1e6 WHEN w ILIKE '%k' THEN 1e3 ELSE 1 END, 2) AS claim FROM c""")
def money_claims(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(text.money(F.col("text"))).alias("claim")).withColumn("claim", F.round("claim", 2))


_FIGURES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, CAST(replace(n, ',', '') AS DOUBLE) * CASE lower(u) " + "".join(f"WHEN '{w}' THEN {v!r} " for w, v in units.items()) + f"WHEN '' THEN 1.0 ELSE 1.0 END AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS n, unnest(regexp_extract_all(text, '{p}', 2)) AS u FROM documents)"
    for k, (p, units) in text.FIGURES.items()
)


@query("figures_in_texts", f"SELECT doc_id, kind, round(value, 4) AS value FROM ({_FIGURES_SQL})")
def figures_in_texts(t: Tables) -> DataFrame:
    """Amounts of money, shares and distances that texts state."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), text.figures(F.col("text"), k).alias("v")) for k in text.FIGURES])
    rows = t.documents.select("doc_id", F.explode(kinds).alias("f"))
    return rows.select("doc_id", "f.kind", F.explode("f.v").alias("value")).withColumn("value", F.round("value", 4))


@query("claims_supported", f"""WITH c AS (SELECT doc_id, suburb_id, CAST(regexp_replace(w, '[$,mkMK]', '', 'g') AS DOUBLE) * CASE WHEN w ILIKE '%m' THEN 1e6 WHEN w ILIKE '%k' THEN 1e3 ELSE 1 END AS claim
  FROM (SELECT doc_id, suburb_id, unnest(regexp_extract_all(text, '({_MONEY})', 1)) AS w FROM documents WHERE suburb_id IS NOT NULL)),
  f AS (SELECT DISTINCT suburb_id, CAST(avg_house_value AS DOUBLE) AS fact FROM market_snapshot WHERE avg_house_value > 0 AND suburb_id IS NOT NULL)
  SELECT suburb_id, count(*) AS claims, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.suburb_id = c.suburb_id AND abs(claim - fact) <= greatest(500, 0.002 * fact))) AS supported FROM c GROUP BY suburb_id""")
def claims_supported(t: Tables) -> DataFrame:
    """Prices stated in texts held against the released values of their suburb."""
    claims = t.documents.where("suburb_id is not null").select("suburb_id", F.explode(text.money(F.col("text"))).alias("claim"))
    facts = t.market_snapshot.where("avg_house_value > 0 and suburb_id is not null").select("suburb_id", F.col("avg_house_value").cast("double").alias("fact")).distinct()
    return text.supported(claims, facts, "suburb_id", 500.0, 0.002).groupBy("suburb_id").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"))


MODEL_FEATURES = ["cv_median", "cv_p25", "median_weekly_rent", "est_gross_yield_pct", "cbd_km", "population"]


def _modelled(t: Tables, kind: str, rounds: int = 20) -> DataFrame:
    return model.out_of_fold(overview(t).where(F.col("units") >= LEAST_UNITS), "suburb_id", "avg_house_value", MODEL_FEATURES, kind, categories=["major_name"], rounds=rounds)


@query("agreement_model")
def agreement_model(t: Tables) -> DataFrame:
    """Out-of-fold errors of a ridge model and of boosted trees of prices from council values, market figures and district."""
    return reduce(DataFrame.unionByName, [model.scores(_modelled(t, kind, 5)).select(F.lit(kind).alias("model"), "*") for kind in ("ridge", "boosted")])


@query("agreement_bands")
def agreement_bands(t: Tables) -> DataFrame:
    """How far each suburb's price is off the ridge model, in bands of confidence."""
    return model.bands(_modelled(t, "ridge"), "suburb_id")


QUERIES, SQL = query.queries, query.sql
