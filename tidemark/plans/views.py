"""The semantic views and the analysts' queries over them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_even_long, nztm_sql, ratio
from tidemark.operators import relational
from tidemark.plans.registry import Registry, Tables

query = Registry()

#: One row for each unit and date, the last one loaded: a shared record has thousands of repeats of a date.
_ROUNDS = """val AS (
  SELECT ru_id, valuation_date, cv, lv FROM (SELECT *, row_number() OVER (PARTITION BY ru_id, valuation_date ORDER BY coalesce(run_id, -1) DESC, cv DESC NULLS LAST, lv DESC NULLS LAST) AS rn
    FROM valuation WHERE ru_id IS NOT NULL) WHERE rn = 1)"""


def last_loaded(valuation: DataFrame) -> DataFrame:
    """Without repeats: for each unit and date the row of the last run (of equals the larger values)."""
    last = F.max(F.struct(F.coalesce("run_id", F.lit(-1)).alias("run"), "cv", "lv")).alias("s")
    return valuation.where("ru_id is not null").groupBy("ru_id", "valuation_date").agg(last).select("ru_id", "valuation_date", "s.cv", "s.lv")


def rounds(t: Tables) -> DataFrame:
    return last_loaded(t.valuation)


_MARKET = """mk AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY suburb_id ORDER BY source_as_at DESC, captured_at DESC, avg_house_value DESC NULLS LAST, median_weekly_rent DESC NULLS LAST,
    est_gross_yield_pct DESC NULLS LAST, population DESC NULLS LAST) AS rn FROM market_snapshot WHERE suburb_id IS NOT NULL) WHERE rn = 1)"""
#: 0 means missing in the market's figures.
_FIGURES = ["avg_house_value", "median_weekly_rent", "est_gross_yield_pct", "population", "median_days_to_sell"]
_MARKET_COLUMNS = ["suburb_id", "source_as_at", "avg_house_value", "median_weekly_rent", "est_gross_yield_pct", "population"]


@query("suburb_market", f"WITH {_MARKET} SELECT {', '.join(_MARKET_COLUMNS)} FROM mk")
def suburb_market(t: Tables) -> DataFrame:
    """The latest release of each suburb."""
    order = [F.col(c).desc_nulls_last() for c in ["source_as_at", "captured_at", "avg_house_value", "median_weekly_rent", "est_gross_yield_pct", "population"]]
    return relational.latest(t.market_snapshot.where("suburb_id is not null"), ["suburb_id"], order).select(_MARKET_COLUMNS)


#: A region-wide round is a date that values at least this share of as many units as the date that values most; all else are interim dates.
ROUND_SHARE = 0.5
_ROUND_DATES = f"""rd AS (SELECT valuation_date AS d, row_number() OVER (ORDER BY valuation_date DESC) AS age FROM (SELECT valuation_date, count(DISTINCT ru_id) AS n FROM valuation WHERE ru_id IS NOT NULL AND valuation_date IS NOT NULL GROUP BY 1)
  WHERE n >= {ROUND_SHARE} * (SELECT max(n) FROM (SELECT count(DISTINCT ru_id) AS n FROM valuation WHERE ru_id IS NOT NULL AND valuation_date IS NOT NULL GROUP BY valuation_date)))"""
_NOW, _THEN = "(SELECT d FROM rd WHERE age = 1)", "(SELECT d FROM rd WHERE age = 2)"
_CURRENT = f"{_ROUNDS}, {_ROUND_DATES}, cur AS (SELECT r.*, v.valuation_date, v.cv, v.lv FROM rating_unit r JOIN val v USING (ru_id) WHERE v.valuation_date = {_NOW})"


def round_dates(t: Tables) -> list[date | None]:
    """The dates of the last two rounds. As there are few dates, what comes to the driver is one row for each."""
    if "rounds" in t.seen:
        return t.seen["rounds"]
    per = t.valuation.where("ru_id is not null and valuation_date is not null").groupBy("valuation_date").agg(F.approx_count_distinct("ru_id").alias("n"))
    rows = per.collect()
    most = max((r["n"] for r in rows), default=0)
    t.seen["rounds"] = [*sorted((r["valuation_date"] for r in rows if r["n"] >= ROUND_SHARE * most), reverse=True)[:2], None, None][:2]
    return t.seen["rounds"]


def current(t: Tables) -> DataFrame:
    """Rating units with their values of the last region-wide round."""
    return t.rating_unit.join(rounds_on(t, round_dates(t)[0]), "ru_id")


def rounds_on(t: Tables, on: date | None) -> DataFrame:
    """(ru_id, cv, lv, valuation_date) of one date, the last loaded row of each unit; the date is pushed into the scan, and rows are grouped by the key that they are joined by."""
    last = F.max(F.struct(F.coalesce("run_id", F.lit(-1)).alias("run"), "cv", "lv")).alias("s")
    rows = t.valuation.where((F.col("valuation_date") == F.lit(on).cast("date")) & F.col("ru_id").isNotNull())
    return rows.groupBy("ru_id").agg(last).select("ru_id", F.lit(on).cast("date").alias("valuation_date"), "s.cv", "s.lv")


@query(
    "rating_unit_current",
    f"WITH {_ROUNDS} SELECT r.ru_id, r.suburb_id, r.planning_zone_code, v.valuation_date, v.cv, v.lv FROM rating_unit r JOIN val v USING (ru_id) WHERE v.valuation_date = (SELECT max(valuation_date) FROM valuation)",
)
def rating_unit_current(t: Tables) -> DataFrame:
    """Units with their value at the latest date of all: a scalar subquery that is pushed into the scan."""
    newest = t.valuation.agg(F.max("valuation_date")).scalar()
    last = F.max(F.struct(F.coalesce("run_id", F.lit(-1)).alias("run"), "cv", "lv", "valuation_date")).alias("s")
    rows = t.valuation.where((F.col("valuation_date") == newest) & F.col("ru_id").isNotNull()).groupBy("ru_id").agg(last).select("ru_id", "s.valuation_date", "s.cv", "s.lv")
    return t.rating_unit.select("ru_id", "suburb_id", "planning_zone_code").join(rows, "ru_id")


_BY_SUBURB = "bs AS (SELECT suburb_id, count(*) AS units, CAST(round_even(median(cv), 0) AS BIGINT) AS cv_median, CAST(round_even(quantile_cont(cv, 0.25), 0) AS BIGINT) AS cv_p25, CAST(round_even(quantile_cont(cv, 0.75), 0) AS BIGINT) AS cv_p75 FROM cur WHERE cv > 0 GROUP BY suburb_id)"


def values_by_suburb(t: Tables) -> DataFrame:
    quantile = lambda q: half_even_long(F.percentile("cv", q))
    units = current(t).where("cv > 0 and suburb_id is not null")
    return units.groupBy("suburb_id").agg(F.count("*").alias("units"), quantile(0.5).alias("cv_median"), quantile(0.25).alias("cv_p25"), quantile(0.75).alias("cv_p75"))


_OVERVIEW = f"WITH {_MARKET}, {_CURRENT}, {_BY_SUBURB}, ov AS (SELECT s.suburb_id, s.name, s.zone, s.major_name, s.local_board, s.cbd_km, nullif(m.avg_house_value, 0) AS avg_house_value, nullif(m.est_gross_yield_pct, 0) AS est_gross_yield_pct, nullif(m.median_weekly_rent, 0) AS median_weekly_rent, nullif(m.population, 0) AS population, nullif(m.median_days_to_sell, 0) AS median_days_to_sell, m.sold_last_12m, b.units, b.cv_median, b.cv_p25, b.cv_p75 FROM suburb s LEFT JOIN mk m USING (suburb_id) LEFT JOIN bs b USING (suburb_id))"
_OVERVIEW_COLUMNS = ["suburb_id", "name", "zone", "major_name", "local_board", "cbd_km", "avg_house_value", "est_gross_yield_pct", "median_weekly_rent", "population", "median_days_to_sell", "sold_last_12m", "units", "cv_median", "cv_p25", "cv_p75"]


def overview(t: Tables) -> DataFrame:
    """Everything about a suburb on one row: its latest release and the values of its units."""
    order = [F.col(c).desc_nulls_last() for c in ["source_as_at", "captured_at", "avg_house_value", "median_weekly_rent", "est_gross_yield_pct", "population"]]
    market = relational.latest(t.market_snapshot.where("suburb_id is not null"), ["suburb_id"], order)
    market = market.withColumns({c: F.nullif(c, F.lit(0)) for c in _FIGURES})
    return t.suburb.join(market.drop("zone"), "suburb_id", "left").join(values_by_suburb(t), "suburb_id", "left").select(_OVERVIEW_COLUMNS)


@query("suburb_overview", f"{_OVERVIEW} SELECT *, cv_median / nullif(avg_house_value, 0) AS cv_vs_avm FROM ov")
def suburb_overview(t: Tables) -> DataFrame:
    return overview(t).withColumn("cv_vs_avm", ratio(F.col("cv_median"), F.col("avg_house_value")))


@query("lakehouse_overview", f"{_OVERVIEW} SELECT suburb_id, name, units, cv_p25 AS entry_price, round(avg_house_value / nullif(cv_median, 0), 3) AS value_to_cv FROM ov")
def lakehouse_overview(t: Tables) -> DataFrame:
    """The same with the inverse ratio."""
    return overview(t).select("suburb_id", "name", "units", F.col("cv_p25").alias("entry_price"), F.round(ratio(F.col("avg_house_value"), F.col("cv_median")), 3).alias("value_to_cv"))


LEAST_UNITS = 20


@query("source_agreement", f"{_OVERVIEW} SELECT name, zone, units, round(avg_house_value / nullif(cv_median, 0), 3) AS value_to_cv FROM ov WHERE avg_house_value IS NOT NULL AND cv_median IS NOT NULL AND units >= {LEAST_UNITS}")
def source_agreement(t: Tables) -> DataFrame:
    rows = overview(t).where((F.col("units") >= LEAST_UNITS) & F.col("avg_house_value").isNotNull() & F.col("cv_median").isNotNull())
    return rows.select("name", "zone", "units", F.round(ratio(F.col("avg_house_value"), F.col("cv_median")), 3).alias("value_to_cv"))


@query(
    "revaluation_rounds",
    f"""WITH {_ROUNDS}, p AS (SELECT r.suburb_id, a.valuation_date AS d1, b.valuation_date AS d2, a.cv AS c1, b.cv AS c2 FROM val a JOIN val b ON a.ru_id = b.ru_id AND a.valuation_date < b.valuation_date
    JOIN rating_unit r ON r.ru_id = a.ru_id WHERE a.cv > 0 AND b.cv > 0)
    SELECT s.suburb_id, d1, d2, count(*) AS units, median(c1) AS cv_before, median(c2) AS cv_after, round(median((c2 - c1) / c1) * 100, 1) AS pct_change
    FROM p JOIN suburb s USING (suburb_id) GROUP BY s.suburb_id, d1, d2 HAVING count(*) >= {LEAST_UNITS}""",
)
def revaluation_rounds(t: Tables) -> DataFrame:
    """All ordered pairs of rounds of each unit; repeats are gone before, so a shared record has one row a date."""
    v = rounds(t).where("cv > 0")
    a, b = v.select("ru_id", F.col("valuation_date").alias("d1"), F.col("cv").alias("c1")), v.select("ru_id", F.col("valuation_date").alias("d2"), F.col("cv").alias("c2"))
    pairs = a.join(b, "ru_id").where("d1 < d2").join(t.rating_unit.select("ru_id", "suburb_id"), "ru_id").join(t.suburb.select("suburb_id"), "suburb_id")
    out = pairs.groupBy("suburb_id", "d1", "d2").agg(F.count("*").alias("units"), F.median("c1").alias("cv_before"), F.median("c2").alias("cv_after"), F.round(F.median((F.col("c2") - F.col("c1")) / F.col("c1")) * 100, 1).alias("pct_change"))
    return out.where(F.col("units") >= LEAST_UNITS)


@query(
    "revaluation_by_suburb",
    f"""WITH {_ROUNDS}, {_ROUND_DATES} SELECT s.name, s.suburb_id, count(*) AS units, round(median((b.cv - a.cv) / a.cv) * 100, 1) AS pct_change FROM val a JOIN val b ON a.ru_id = b.ru_id JOIN rating_unit r ON r.ru_id = a.ru_id JOIN suburb s USING (suburb_id)
    WHERE a.valuation_date = {_THEN} AND b.valuation_date = {_NOW} AND a.cv > 0 AND b.cv > 0 GROUP BY s.name, s.suburb_id HAVING count(*) >= {LEAST_UNITS}""",
)
def revaluation_by_suburb(t: Tables) -> DataFrame:
    """The last two rounds side by side, from one pass over the rows of both dates: no self-join."""
    now, then = round_dates(t)
    last = lambda on, c: F.max(F.when(F.col("valuation_date") == F.lit(on).cast("date"), F.struct(F.coalesce("run_id", F.lit(-1)).alias("run"), "cv", "lv")))["cv"].alias(c)
    rows = t.valuation.where(F.col("valuation_date").isin(now, then) & F.col("ru_id").isNotNull()).groupBy("ru_id").agg(last(then, "c1"), last(now, "c2")).where("c1 > 0 and c2 > 0")
    rows = rows.join(t.rating_unit.select("ru_id", "suburb_id"), "ru_id").join(t.suburb.select("suburb_id", "name"), "suburb_id")
    return rows.groupBy("name", "suburb_id").agg(F.count("*").alias("units"), F.round(F.median((F.col("c2") - F.col("c1")) / F.col("c1")) * 100, 1).alias("pct_change")).where(F.col("units") >= LEAST_UNITS)


@query("shortlist", f"{_OVERVIEW} SELECT name, avg_house_value, round(est_gross_yield_pct, 1) AS yield_pct, sold_last_12m FROM ov WHERE avg_house_value BETWEEN 500000 AND 1200000 AND est_gross_yield_pct > 3 AND sold_last_12m > 50")
def shortlist(t: Tables) -> DataFrame:
    """Budget, yield and a liquid market."""
    rows = overview(t).where("avg_house_value between 500000 and 1200000 and est_gross_yield_pct > 3 and sold_last_12m > 50")
    return rows.select("name", "avg_house_value", F.round("est_gross_yield_pct", 1).alias("yield_pct"), "sold_last_12m").orderBy(F.col("yield_pct").desc(), "name")


_E, _N = nztm_sql("lon", "lat")
_AT = (171.9, -37.75)
_AE, _AN = nztm_sql(repr(_AT[0]), f"({_AT[1]!r})")
RADIUS_M = 15_000


@query(
    "within_radius",
    f"""WITH {_ROUNDS}, {_ROUND_DATES}, u AS (SELECT r.*, {_E} AS e, {_N} AS n FROM rating_unit r WHERE lon BETWEEN 166 AND 179 AND lat BETWEEN -47 AND -34)
    SELECT s.name, count(*) AS units, CAST(round_even(median(v.cv), 0) AS BIGINT) AS cv_median FROM u JOIN val v USING (ru_id) JOIN suburb s USING (suburb_id)
    WHERE v.valuation_date = {_NOW} AND pow(e - {_AE}, 2) + pow(n - {_AN}, 2) <= {RADIUS_M**2} GROUP BY s.name""",
)
def within_radius(t: Tables) -> DataFrame:
    """Units within a distance of a point on the national grid, medians by suburb. A box in degrees reaches the scan first."""
    box = f"lon between {_AT[0] - 0.25} and {_AT[0] + 0.25} and lat between {_AT[1] - 0.2} and {_AT[1] + 0.2}"
    near = t.rating_unit.where(box).where(F.expr(f"pow({_E} - {_AE}, 2) + pow({_N} - {_AN}, 2) <= {RADIUS_M**2}")).select("ru_id", "suburb_id")
    rows = rounds_on(t, round_dates(t)[0]).join(near, "ru_id").join(t.suburb.select("suburb_id", "name"), "suburb_id")
    return rows.groupBy("name").agg(F.count("*").alias("units"), half_even_long(F.median("cv")).alias("cv_median"))


# Fixed value: the house number in front of an address
HOUSE_NUMBER = r"^[0-9]+[A-Za-z]?(/[0-9]+[A-Za-z]?)?\s*"


@query(
    "street_medians",
    f"""WITH {_CURRENT} SELECT suburb_id, trim(regexp_replace(split_part(address, ',', 1), '{HOUSE_NUMBER}', '')) AS street, count(*) AS n, CAST(round_even(median(cv), 0) AS BIGINT) AS cv_median
    FROM cur WHERE cv IS NOT NULL AND address IS NOT NULL AND suburb_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def street_medians(t: Tables) -> DataFrame:
    """Medians by street: the house number in front of an address is cut off."""
    street = F.trim(F.regexp_replace(F.split_part("address", F.lit(","), F.lit(1)), HOUSE_NUMBER, ""))
    rows = current(t).where("cv is not null and address is not null and suburb_id is not null")
    return rows.groupBy("suburb_id", street.alias("street")).agg(F.count("*").alias("n"), half_even_long(F.median("cv")).alias("cv_median")).where("n >= 3")


@query("land_value_per_m2", f"WITH {_CURRENT} SELECT suburb_id, count(*) AS n, CAST(round_even(median(lv / land_area_m2), 0) AS BIGINT) AS lv_per_m2 FROM cur WHERE land_area_m2 BETWEEN 300 AND 1200 AND lv > 0 AND suburb_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_UNITS}")
def land_value_per_m2(t: Tables) -> DataFrame:
    rows = current(t).where("land_area_m2 between 300 and 1200 and lv > 0 and suburb_id is not null")
    return rows.groupBy("suburb_id").agg(F.count("*").alias("n"), half_even_long(F.median(F.col("lv") / F.col("land_area_m2"))).alias("lv_per_m2")).where(F.col("n") >= LEAST_UNITS)


@query(
    "property_search",
    f"WITH {_CURRENT} SELECT c.address, c.land_area_m2, a.cv AS cv_before, c.cv AS cv_now, round((c.cv - a.cv) / nullif(a.cv, 0) * 100, 1) AS pct_change FROM cur c JOIN val a ON a.ru_id = c.ru_id AND a.valuation_date = {_THEN} WHERE c.address ILIKE '12 %'",
)
def property_search(t: Tables) -> DataFrame:
    """Properties by the start of their address, with what the revaluation did to them."""
    units = t.rating_unit.where(F.col("address").ilike("12 %")).select("ru_id", "address", "land_area_m2")
    now, then = round_dates(t)
    rows = rounds_on(t, now).select("ru_id", F.col("cv").alias("cv_now")).join(units, "ru_id").join(rounds_on(t, then).select("ru_id", F.col("cv").alias("cv_before")), "ru_id")
    return rows.select("address", "land_area_m2", "cv_before", "cv_now", F.round(ratio(F.col("cv_now") - F.col("cv_before"), F.col("cv_before")) * 100, 1).alias("pct_change"))


@query("entry_price_by_zone", f"{_OVERVIEW} SELECT zone, major_name, count(*) AS suburbs, round(median(cv_p25)) AS median_entry_price, round(median(avg_house_value)) AS median_avg_value FROM ov WHERE cv_p25 IS NOT NULL AND zone IS NOT NULL GROUP BY zone, major_name")
def entry_price_by_zone(t: Tables) -> DataFrame:
    rows = overview(t).where("cv_p25 is not null and zone is not null")
    return rows.groupBy("zone", "major_name").agg(F.count("*").alias("suburbs"), F.round(F.median("cv_p25"), 0).alias("median_entry_price"), F.round(F.median("avg_house_value"), 0).alias("median_avg_value"))


@query("run_status", """SELECT trigger, max(finished_at) FILTER (WHERE status = 'ok') AS last_ok, date_diff('day', CAST(max(finished_at) FILTER (WHERE status = 'ok') AS DATE), DATE '2026-01-01') AS days_ago,
  arg_max(status, started_at) FILTER (WHERE status <> 'skipped') AS last_status, arg_max(note, started_at) FILTER (WHERE note IS NOT NULL) AS last_note, count(*) AS runs FROM pipeline_run GROUP BY trigger""")
def run_status(t: Tables) -> DataFrame:
    """The last good run, the last state and the last remark of each kind of run; nulls never win an arg_max."""
    r, ok = t.pipeline_run, F.col("status") == "ok"
    last_ok = F.max(F.when(ok, F.col("finished_at")))
    newest = lambda c, cond: F.max(F.when(cond & F.col(c).isNotNull(), F.struct("started_at", c)))[c]
    return r.groupBy("trigger").agg(
        last_ok.alias("last_ok"), F.datediff(F.lit("2026-01-01").cast("date"), last_ok.cast("date")).cast("long").alias("days_ago"),
        newest("status", F.col("status") != "skipped").alias("last_status"), newest("note", F.lit(True)).alias("last_note"), F.count("*").alias("runs"),
    )


# Fixed: the banks that series are quoted for
MAIN_BANKS = ["Harbourline Bank", "Kestrel Mutual", "First Lantern"]
_IN = ", ".join(f"'{b}'" for b in MAIN_BANKS)


@query("rate_series", f"SELECT term, valid_from AS observed_on, min(rate) AS cheapest, count(*) AS products FROM bank_rate WHERE bank IN ({_IN}) GROUP BY term, valid_from")
def rate_series(t: Tables) -> DataFrame:
    return t.bank_rate.where(F.col("bank").isin(MAIN_BANKS)).groupBy("term", F.col("valid_from").alias("observed_on")).agg(F.min("rate").alias("cheapest"), F.count("*").alias("products"))


@query(
    "rate_as_of_edges",
    f"""WITH b AS (SELECT * FROM bank_rate WHERE bank IN ({_IN}) AND valid_from IS NOT NULL), e AS (SELECT term, valid_from AS d FROM b UNION SELECT term, valid_to FROM b WHERE valid_to IS NOT NULL)
    SELECT e.term, e.d AS on_date, min(rate) AS cheapest, count(*) AS carded FROM e JOIN b ON b.term = e.term AND valid_from <= d AND (valid_to IS NULL OR valid_to > d) GROUP BY e.term, e.d""",
)
def rate_as_of_edges(t: Tables) -> DataFrame:
    """What was carded at every date on which something changed: a range join over months that intervals touch."""
    b = t.bank_rate.where(F.col("bank").isin(MAIN_BANKS)).where("valid_from is not null")
    edges = b.select("term", F.col("valid_from").alias("d")).union(b.where("valid_to is not null").select("term", "valid_to")).distinct()
    return relational.interval_join(edges, "d", b.select("term", "rate", "valid_from", "valid_to"), "valid_from", "valid_to", ["term"]).groupBy("term", F.col("d").alias("on_date")).agg(F.min("rate").alias("cheapest"), F.count("*").alias("carded"))


@query(
    "rate_moves",
    """WITH w AS (SELECT term, min(rate) FILTER (WHERE valid_from >= DATE '2025-06-01') AS opened, min(rate) FILTER (WHERE valid_to >= DATE '2025-06-01') AS closed FROM bank_rate GROUP BY term)
    SELECT term, opened, closed, round(opened - closed, 2) AS moved FROM w WHERE opened IS NOT NULL AND closed IS NOT NULL""",
)
def rate_moves(t: Tables) -> DataFrame:
    """Terms whose rates both opened and closed in a window, with the move of the cheapest."""
    since = F.lit("2025-06-01").cast("date")
    low = lambda c: F.min(F.when(F.col(c) >= since, F.col("rate")))
    rows = t.bank_rate.groupBy("term").agg(low("valid_from").alias("opened"), low("valid_to").alias("closed")).where("opened is not null and closed is not null")
    return rows.withColumn("moved", F.round(F.col("opened") - F.col("closed"), 2))


@query("cheapest_offers", """WITH c AS (SELECT bank, product, term, min(rate) AS rate FROM bank_rate WHERE is_current AND rate > 0 GROUP BY ALL), q AS (SELECT bank, product FROM c GROUP BY ALL HAVING count(*) >= 3),
  o AS (SELECT c.* FROM c JOIN q USING (bank, product)), m AS (SELECT term, min(rate) AS rate FROM o GROUP BY term) SELECT m.term, m.rate, string_agg(DISTINCT o.bank, ', ' ORDER BY o.bank) AS banks FROM m JOIN o ON o.term = m.term AND o.rate = m.rate GROUP BY m.term, m.rate""")
def cheapest_offers(t: Tables) -> DataFrame:
    """The cheapest current offer of each term and the banks that share it; products with fewer than three terms do not count."""
    offers = t.bank_rate.where("is_current and rate > 0").groupBy("bank", "product", "term").agg(F.min("rate").alias("rate"))
    wide = offers.groupBy("bank", "product").agg(F.count("*").alias("terms")).where("terms >= 3").select("bank", "product")
    tied = relational.ties_at_min(offers.join(wide, ["bank", "product"]), ["term"], "rate")
    return tied.groupBy("term", "rate").agg(F.array_join(F.array_sort(F.collect_set("bank")), ", ").alias("banks"))


@query("nearest_board", """WITH u AS (SELECT suburb_id, centroid.x AS x, centroid.y AS y, local_board FROM suburb WHERE centroid.x BETWEEN 166 AND 179 AND centroid.y BETWEEN -47 AND -34),
  d AS (SELECT a.suburb_id, b.local_board, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) AS km, b.suburb_id AS from_id
  FROM u a, u b WHERE a.local_board IS NULL AND b.local_board IS NOT NULL)
  SELECT suburb_id, local_board, from_id, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY suburb_id ORDER BY km, from_id) AS rn FROM d) WHERE rn = 1""")
def nearest_board(t: Tables) -> DataFrame:
    """Suburbs without a board take that of the nearest suburb that has one."""
    u = t.suburb.select("suburb_id", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"), "local_board").where("x between 166 and 179 and y between -47 and -34")
    near = relational.nearest(u.where("local_board is null").select("suburb_id", "x", "y"), u.where("local_board is not null").select(F.col("suburb_id").alias("from_id"), F.col("x").alias("bx"), F.col("y").alias("by"), "local_board"), "suburb_id", "from_id")
    return near.select("suburb_id", "local_board", "from_id", F.round("km", 3).alias("km"))


@query("vector_search", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, v.vec_id, list_dot_product(CAST(qe AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings v ON v.label = q.label AND v.vec_id <> query_id)
  SELECT query_id, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5""")
def vector_search(t: Tables) -> DataFrame:
    """The five closest vectors within each query's own label: the label is an equi-join before anything is scored."""
    from tidemark.operators.search import top_k

    e = t.embeddings
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    return top_k(queries, e.select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("scope")), 5, scoped=True).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("retrieval_quality", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, q.label = v.label AS hit, v.vec_id, list_dot_product(CAST(qe AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings v ON v.vec_id <> query_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s),
  e AS (SELECT query_id, min(rn) FILTER (WHERE hit) AS first_hit, count(*) FILTER (WHERE NOT hit) AS off FROM r WHERE rn <= 5 GROUP BY query_id)
  SELECT count(*) AS queries, round(count(first_hit) / count(*), 4) AS recall_at_5, round(avg(coalesce(1.0 / first_hit, 0)), 4) AS mrr, round(sum(off) / (5 * count(*)), 4) AS off_scope FROM e""")
def retrieval_quality(t: Tables) -> DataFrame:
    """Recall, mean reciprocal rank and share of hits out of scope for search without a filter."""
    from tidemark.operators.search import evaluate, top_k

    e = t.embeddings
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    return evaluate(top_k(queries, e.select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("scope")), 5, scoped=False), 5)


QUERIES, SQL = query.queries, query.sql
