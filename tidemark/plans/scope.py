"""Scopes of clauses, resolution of names in texts, cleaning, lineage and small helpers over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import haversine_km, source_form
from tidemark.operators import lineage
from tidemark.operators.search import in_scope
from tidemark.plans import views
from tidemark.plans.registry import Registry, Tables
from tidemark.sources import views as sources

query = Registry()

_CLAUSES = r"""cl AS (SELECT doc_id AS clause_id, CASE WHEN doc_id % 3 = 0 THEN []::INTEGER[] ELSE [CAST(doc_id % 50 AS INTEGER), CAST(doc_id % 7 AS INTEGER)] END AS zones, [CAST(doc_id % 11 AS INTEGER)] AS excluded FROM documents WHERE regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') = 'plan_clause'),
  z AS (SELECT DISTINCT planning_zone_code AS zone FROM rating_unit WHERE planning_zone_code IS NOT NULL)"""


def clauses(t: Tables) -> DataFrame:
    """Clauses (their source in any spelling) with the zones they name (none: everywhere but the excluded ones)."""
    mod = lambda n: F.pmod("doc_id", F.lit(n)).cast("int")
    rows = t.documents.where(source_form(F.col("source")) == "plan_clause")
    return rows.select(F.col("doc_id").alias("clause_id"), F.when(mod(3) == 0, F.array().cast("array<int>")).otherwise(F.array(mod(50), mod(7))).alias("zones"), F.array(mod(11)).alias("excluded"))


def zones(t: Tables) -> DataFrame:
    return t.rating_unit.where("planning_zone_code is not null").select(F.col("planning_zone_code").alias("zone")).distinct()


def scoped(c: DataFrame, z: DataFrame) -> DataFrame:
    """(clause_id, zone): an equi-join for clauses that name zones; the few zones are sent to the others."""
    named = c.select("clause_id", F.explode(F.array_distinct("zones")).alias("zone")).join(z, "zone").select("clause_id", "zone")
    # the zones are a code list: their number is checked before they are sent along
    codes = [r[0] for r in z.limit(10_001).collect()]
    if len(codes) > 10_000:
        raise ValueError("too many zones to be a code list")
    everywhere = c.where(F.size("zones") == 0).select("clause_id", F.explode(F.array_except(F.array(*map(F.lit, codes)) if codes else F.array().cast("array<int>"), "excluded")).alias("zone"))
    return named.unionByName(everywhere)


@query("zone_map", f"WITH {_CLAUSES} SELECT zone, count(*) AS clauses, list_sort(list(clause_id)) AS clause_ids FROM z JOIN cl ON list_contains(zones, zone) OR (len(zones) = 0 AND NOT list_contains(excluded, zone)) GROUP BY zone")
def zone_map(t: Tables) -> DataFrame:
    """Which clauses apply in each zone, in order."""
    return scoped(clauses(t), zones(t)).groupBy("zone").agg(F.count("*").alias("clauses"), F.array_sort(F.collect_list("clause_id")).alias("clause_ids"))


@query("clauses_of_zone", f"WITH {_CLAUSES} SELECT clause_id FROM cl WHERE CASE WHEN len(zones) = 0 THEN NOT list_contains(excluded, 20) ELSE list_contains(zones, 20) END")
def clauses_of_zone(t: Tables) -> DataFrame:
    return clauses(t).where(in_scope("zones", "excluded", F.lit(20))).select("clause_id")


@query("clause_coverage", f"WITH {_CLAUSES} SELECT count(*) AS units, count(*) FILTER (planning_zone_code IN (SELECT unnest(zones) FROM cl)) AS covered FROM rating_unit WHERE planning_zone_code IS NOT NULL")
def clause_coverage(t: Tables) -> DataFrame:
    """How many units lie in a zone that some clause names; units are counted by zone before the join."""
    per = t.rating_unit.where("planning_zone_code is not null").groupBy(F.col("planning_zone_code").alias("zone")).agg(F.count("*").alias("n"))
    named = clauses(t).select(F.explode("zones").alias("zone")).distinct().withColumn("hit", F.lit(True))
    return per.join(named, "zone", "left").agg(F.sum("n").alias("units"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("covered"))


@query("resolved_boards", """WITH h AS (SELECT d.suburb_id, count(DISTINCT b.board_id) AS k, min(b.board_id) AS board_id FROM (SELECT suburb_id, lower(local_board) AS t FROM suburb WHERE local_board IS NOT NULL) d JOIN local_board b ON contains(d.t, lower(b.board)) GROUP BY d.suburb_id)
  SELECT suburb_id, CASE WHEN k = 1 THEN board_id END AS board_id, k AS mentioned FROM h""")
def resolved_boards(t: Tables) -> DataFrame:
    """Boards resolved from free spellings of their names; several names in one text resolve to none."""
    # fixed: 25 boards
    boards = [(r[0], r[1].lower()) for r in t.local_board.select("board_id", "board").where("board is not null").collect()]
    s = F.lower("local_board")
    hits = F.array_distinct(F.filter(F.array(*[F.when(s.contains(name), F.lit(i)) for i, name in boards]), lambda x: x.isNotNull()))
    rows = t.suburb.where("local_board is not null").select("suburb_id", hits.alias("h")).where(F.size("h") > 0)
    return rows.select("suburb_id", F.when(F.size("h") == 1, F.element_at("h", 1)).alias("board_id"), F.size("h").cast("long").alias("mentioned"))


@query("cleaned_records", """SELECT name, zone, cbd_km FROM (SELECT substr(trim(name), 1, 120) AS name, CASE zone WHEN 'South Flats' THEN 'South' ELSE zone END AS zone, CASE WHEN isfinite(cbd_km) THEN cbd_km END AS cbd_km,
  row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY suburb_id) AS rn FROM suburb WHERE name IS NOT NULL) WHERE rn = 1""")
def cleaned_records(t: Tables) -> DataFrame:
    """Records with allowed fields, trimmed names, aliases replaced and finite numbers; the first of equal names stays."""
    ok = F.col("cbd_km").isNotNull() & ~F.isnan("cbd_km") & (F.abs("cbd_km") < float("inf"))
    rows = t.suburb.where("name is not null").select("suburb_id", F.substring(F.trim("name"), 1, 120).alias("name"), F.when(F.col("zone") == "South Flats", "South").otherwise(F.col("zone")).alias("zone"), F.when(ok, F.col("cbd_km")).alias("cbd_km"))
    first = rows.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "zone", "cbd_km"), "suburb_id").alias("r"))
    return first.select("r.*")


@query("event_properties", """WITH p AS (SELECT user_id, event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL) SELECT user_id, 'k' AS label, arg_max(k, (ts, event_id)) AS value FROM p WHERE k IS NOT NULL GROUP BY user_id""")
def event_properties(t: Tables) -> DataFrame:
    """Facts from JSON: of several values for a label the last one holds."""
    rows = t.events.select("user_id", "ts", "event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("label", "value")).where("value is not null")
    return rows.groupBy("user_id", "label").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("release_keys", "SELECT run_id, arg_min(source_as_at, captured_at) FILTER (source_as_at IS NOT NULL AND captured_at IS NOT NULL) AS release FROM (SELECT run_id, captured_at, min(source_as_at) AS source_as_at FROM market_snapshot GROUP BY run_id, captured_at) GROUP BY run_id")
def release_keys(t: Tables) -> DataFrame:
    """The release a run loaded: that of its first row with one."""
    return t.market_snapshot.groupBy("run_id").agg(F.min(F.when(F.col("source_as_at").isNotNull() & F.col("captured_at").isNotNull(), F.struct("captured_at", "source_as_at")))["source_as_at"].alias("release"))


@query("yearly_samples", "SELECT suburb_id, list(v ORDER BY source_as_at) AS series FROM (SELECT suburb_id, source_as_at, max(avg_house_value) AS v FROM market_snapshot WHERE suburb_id IS NOT NULL AND avg_house_value > 0 AND month(source_as_at) IN (1, 7) GROUP BY ALL) GROUP BY suburb_id")
def yearly_samples(t: Tables) -> DataFrame:
    """Half-yearly samples of a monthly series, by a filter within the array."""
    v = t.market_snapshot.where("suburb_id is not null and avg_house_value > 0").groupBy("suburb_id", "source_as_at").agg(F.max("avg_house_value").alias("v"))
    s = F.sort_array(F.collect_list(F.struct("source_as_at", "v")))
    rows = v.groupBy("suburb_id").agg(F.transform(F.filter(s, lambda x: F.month(x["source_as_at"]).isin(1, 7)), lambda x: x["v"]).alias("series"))
    return rows.where(F.size("series") > 0)


@query("scale_positions", "SELECT suburb_id, round(greatest(0, least(1, log2(avg_house_value / 200000.0) / log2(4000000 / 200000.0))), 6) AS position FROM (SELECT suburb_id, max(avg_house_value) AS avg_house_value FROM market_snapshot WHERE avg_house_value > 0 AND suburb_id IS NOT NULL GROUP BY 1)")
def scale_positions(t: Tables) -> DataFrame:
    """Positions on a logarithmic scale between two ends."""
    v = t.market_snapshot.where("avg_house_value > 0 and suburb_id is not null").groupBy("suburb_id").agg(F.max("avg_house_value").alias("v"))
    return v.select("suburb_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log2(F.col("v") / 200_000.0) / F.log2(F.lit(20.0)))), 6).alias("position"))


@query("text_kinds", r"""SELECT CASE WHEN regexp_matches(lower(text), '\?') THEN 'question' WHEN regexp_matches(lower(text), '\$|nzd|per cent|%') THEN 'figures' ELSE 'other' END AS kind, count(*) AS texts FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def text_kinds(t: Tables) -> DataFrame:
    """Texts sorted into kinds by patterns."""
    s = F.lower("text")
    kind = F.when(s.rlike(r"\?"), "question").when(s.rlike(r"\$|nzd|per cent|%"), "figures").otherwise("other")
    return t.documents.where("text is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("texts"))


_LINEAGE = {"suburb_market": ["market_snapshot"], "rating_unit_current": ["rating_unit", "valuation"], "suburb_overview": ["market_snapshot", "rating_unit", "suburb", "valuation"], "rate_series": ["bank_rate"]}


@query("lineage_edges", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}')" for r, ss in _LINEAGE.items() for s in ss) + ") v(result, source)")
def lineage_edges(t: Tables) -> DataFrame:
    """Which tables the views read, taken from their plans."""
    return lineage.edges({name: views.QUERIES[name](t.spark, t.folder) for name in _LINEAGE})


@query("cheapest_runs", "SELECT term, valid_from, rate, rank() OVER (PARTITION BY term ORDER BY rate) AS place FROM (SELECT term, valid_from, min(rate) AS rate FROM bank_rate WHERE rate > 0 GROUP BY ALL)")
def cheapest_runs(t: Tables) -> DataFrame:
    """Each date's cheapest rate with its place within the term."""
    rows = t.bank_rate.where("rate > 0").groupBy("term", "valid_from").agg(F.min("rate").alias("rate"))
    return rows.withColumn("place", F.rank().over(Window.partitionBy("term").orderBy("rate")).cast("long"))


TABLES = ["suburb", "rating_unit", "valuation", "market_snapshot", "bank_rate", "data_quality", "pipeline_run", "documents", "rate_snapshot", "suburb_page", "local_board", "mix_target"]
_NAMES = ", ".join(f"'{x}'" for x in TABLES)


@query("sql_over_views", f"{views._OVERVIEW} SELECT s.type, count(*) AS suburbs, count(o.avg_house_value) AS priced, max(o.cv_median) AS dearest FROM ov o JOIN suburb s USING (suburb_id) GROUP BY s.type")
def sql_over_views(t: Tables) -> DataFrame:
    """A question in SQL over a table and a semantic view, read-only."""
    sources.register(t.spark, t.folder, ["suburb"], {"suburb_overview": views.QUERIES["suburb_overview"]})
    return sources.ask(t.spark, "SELECT s.type, count(*) AS suburbs, count(o.avg_house_value) AS priced, max(o.cv_median) AS dearest FROM suburb_overview o JOIN suburb s USING (suburb_id) GROUP BY s.type")


@query("schema_listing", f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({_NAMES})")
def schema_listing(t: Tables) -> DataFrame:
    return sources.columns(t.spark, t.folder, TABLES).select("table_name", "column_name")


@query("tables_present", f"SELECT unnest([{_NAMES}]) AS table_name, TRUE AS present")
def tables_present(t: Tables) -> DataFrame:
    """Whether every table's files are there before anything is read from them."""
    return sources.prechecks(t.spark, t.folder, TABLES).select("table_name", "present")


@query("latest_releases", "SELECT source_as_at, count(*) AS rows FROM market_snapshot WHERE source_as_at IN (SELECT DISTINCT source_as_at FROM market_snapshot WHERE source_as_at IS NOT NULL ORDER BY source_as_at DESC LIMIT 2) GROUP BY source_as_at")
def latest_releases(t: Tables) -> DataFrame:
    """The two latest releases (as many as the report shows) with their rows."""
    per = t.market_snapshot.where("source_as_at is not null").groupBy("source_as_at").agg(F.count("*").alias("rows"))
    return per.orderBy(F.col("source_as_at").desc()).limit(2)


PICKS = 5


@query("spread_pick", f"""{views._OVERVIEW}, c AS (SELECT suburb_id, avg_house_value AS v, row_number() OVER (ORDER BY est_gross_yield_pct DESC, suburb_id) AS r, count(*) OVER () AS n FROM ov WHERE avg_house_value IS NOT NULL AND est_gross_yield_pct IS NOT NULL),
  k AS (SELECT suburb_id, v, row_number() OVER (ORDER BY v, suburb_id) - 1 AS i, count(*) OVER () AS m FROM c WHERE r <= ceil(0.6 * n)) SELECT suburb_id, v AS price FROM k WHERE i IN (SELECT CAST(round_even(x * (m - 1) / {PICKS - 1}.0, 0) AS BIGINT) FROM (SELECT unnest(range({PICKS})) AS x))""")
def spread_pick(t: Tables) -> DataFrame:
    """Five suburbs (the size of the pick) spread evenly over the prices of the better 60 per cent by yield. The windows run over one row a suburb."""
    rows = views.overview(t).where("avg_house_value is not null and est_gross_yield_pct is not null").select("suburb_id", F.col("avg_house_value").alias("v"), "est_gross_yield_pct")
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    best = rows.select("suburb_id", "v", F.row_number().over(Window.orderBy(F.col("est_gross_yield_pct").desc(), "suburb_id")).alias("r"), n.alias("n")).where(F.col("r") <= F.ceil(0.6 * F.col("n")))
    line = best.select("suburb_id", "v", (F.row_number().over(Window.orderBy("v", "suburb_id")) - 1).alias("i"), n.alias("m"))
    spots = F.array(*[F.bround(F.lit(x) * (F.col("m") - 1) / float(PICKS - 1), 0).cast("long") for x in range(PICKS)])
    return line.where(F.array_contains(spots, F.col("i").cast("long"))).select("suburb_id", F.col("v").alias("price"))


@query("accepted_pages", """WITH p AS (SELECT page_id, lower(trim(regexp_replace(strip_accents(regexp_replace(heading, ',.*$', '')), '^House prices in ', ''))) AS k, lon, lat FROM suburb_page),
  s AS (SELECT suburb_id, lower(trim(strip_accents(name))) AS k, centroid.x AS x, centroid.y AS y FROM suburb WHERE name IS NOT NULL)
  SELECT page_id, suburb_id FROM p JOIN s USING (k) WHERE lon IS NULL OR lat IS NULL OR x IS NULL OR y IS NULL OR 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2)))) <= 20""")
def accepted_pages(t: Tables) -> DataFrame:
    """Pages whose heading is a suburb's name, kept unless both have a place and these are more than 20 km apart."""
    bare = lambda c: F.regexp_replace(F.translate(c, "āēīōūàáâäèéêëìíîïòóôöùúûüçñĀĒĪŌŪ", "aeiouaaaaeeeeiiiioooouuuucnAEIOU"), r"\p{M}", "")
    plain = lambda c: F.lower(F.trim(bare(c)))
    heading = F.regexp_replace(bare(F.regexp_replace("heading", ",.*$", "")), "^House prices in ", "")
    p = t.suburb_page.select("page_id", plain(heading).alias("k"), "lon", "lat")
    s = t.suburb.where("name is not null").select("suburb_id", plain(F.col("name")).alias("k"), F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"))
    return p.join(s, "k").where(F.coalesce(haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= 20, F.lit(True))).select("page_id", "suburb_id")


QUERIES, SQL = query.queries, query.sql
