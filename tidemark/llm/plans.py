"""Queries of the operators for training data, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import label_form, source_form
from tidemark.llm import language, linkage, matching, mixing, percentiles, tokens
from tidemark.session import checkpointed
from tidemark.sources.tables import table

#: Fixed: short forms of words in place names.
SHORT_WORDS = {"nth": "north", "sth": "south", "upr": "upper", "mt": "mount", "pt": "point", "hts": "heights", "vly": "valley", "bch": "beach", "jn": "junction", "pk": "park"}
NAME_WORDS = ["north", "south", "upper", "mount", "point", "heights", "valley", "beach", "junction", "park", "bay"]
ACCENTED, PLAIN = "āēīōūàáâäèéêëìíîïòóôöùúûüçñ", "aeiouaaaaeeeeiiiioooouuuucn"


def name_form(c: Column) -> Column:
    """Words of a place name: lower case, no accents, letters only, short forms written out."""
    low = F.translate(F.lower(c), ACCENTED, PLAIN)
    low = F.trim(F.regexp_replace(F.regexp_replace(low, "^house prices in ", ""), "[^a-z]+", " "))
    words = F.create_map(*[F.lit(x) for kv in SHORT_WORDS.items() for x in kv])
    return F.nullif(F.array_join(F.transform(F.split(low, " "), lambda w: F.coalesce(words[w], w)), " "), F.lit(""))


def url_form(c: Column) -> Column:
    """An address as all its variants have it: lower case, no scheme, www, query, fragment or slash at the end."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[?#].*$", ""), "^(https?:)?//", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(low, r"^www\.", ""), "/+$", ""), F.lit(""))


def _ordered(c: Column) -> Column:
    """The words in a fixed order, so that a word in front or behind is the same name."""
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def _core(c: Column) -> Column:
    """The longest word that is no usual part of names."""
    own = F.filter(F.split(c, " "), lambda w: ~w.isin(NAME_WORDS))
    words = F.when(F.size(own) > 0, own).otherwise(F.split(c, " "))
    return F.element_at(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), 1)


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """One record of each page: both its names (heading and address), district, populations and place."""
    pages = table(spark, d, "suburb_page").withColumn("url", url_form(F.col("source_url")))
    # the most frequent population of an address, the smallest of several; addresses are brought to one form once for each spelling
    market = table(spark, d, "market_snapshot").where("suburb_id is null and population > 0").groupBy("source_url", "population").agg(F.count("*").alias("n"))
    market = market.groupBy(url_form(F.col("source_url")).alias("url"), "population").agg(F.sum("n").alias("n")).groupBy("url").agg(F.max(F.struct("n", (-F.col("population")).alias("less"))).alias("b")).select("url", (-F.col("b.less")).alias("sold_population"))
    slug = F.regexp_replace(F.regexp_extract("url", "([^/]+)$", 1), "(-[0-9]+)+$", "")
    slug = F.when(~slug.rlike("^[0-9]*$"), slug)
    rows = pages.join(market, "url", "left").where("page_id is not null")
    heading = F.regexp_replace("heading", ",.*$", "")
    lon, lat = F.when(F.col("lon").between(160, 180), F.col("lon")), F.when(F.col("lat").between(-50, -30), F.col("lat"))
    return rows.select(
        F.col("page_id").alias("id"), name_form(heading).alias("name"), name_form(slug).alias("slug"), name_form(F.coalesce("district", F.regexp_extract("heading", ", *(.*)$", 1))).alias("district"),
        F.nullif(F.col("population"), F.lit(0)).alias("population"), "sold_population", lon.alias("lon"), lat.alias("lat"),
    )


def suburb_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suburb").where("suburb_id is not null")
    lon, lat = F.when(F.col("centroid.x").between(160, 180), F.col("centroid.x")), F.when(F.col("centroid.y").between(-50, -30), F.col("centroid.y"))
    name = name_form(F.coalesce("name", "name_ascii"))
    return s.select(
        F.col("suburb_id").alias("id"), name.alias("name"), F.lit(None).cast("string").alias("slug"), name_form(F.col("major_name")).alias("district"),
        F.nullif(F.col("population_linz"), F.lit(0)).alias("population"), F.lit(None).cast("int").alias("sold_population"), lon.alias("lon"), lat.alias("lat"),
    )


def _keys(cut) -> Column:
    """cut() of the core of each of a record's names."""
    return F.array(*[F.when(F.length(c) > 3, cut(F.col(c))) for c in ("core", "slug_core")])


def _kind(c: Column) -> Column:
    """The usual parts of a name."""
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w.isin(NAME_WORDS))), " ")


def _hashed(*keys: Column) -> Column:
    """The keys of all passes as numbers; null keys are none. Each is an array of a pass's keys."""
    # a second parameter of the function, even one with a default, would be the key's place in the array
    number = lambda n: lambda k: F.when(k.isNotNull(), F.xxhash64(F.lit(n), k))
    each = [F.transform(p, number(n)) for n, p in enumerate(keys)]
    return F.array_distinct(F.filter(F.concat(*each), lambda k: k.isNotNull()))


def _alike(df: DataFrame) -> Column:
    """The same number for records alike in all but their id."""
    rest = [c for c in df.columns if c != "id"]
    return F.xxhash64(*rest, *[F.col(c).isNull() for c in rest])


def page_patterns(pages: DataFrame, suburbs: DataFrame) -> DataFrame:
    """The agreement patterns of pages (l: _alike) with their candidates, suburbs that share a key of a name, a place or a population.

    Records alike in all attributes have the same candidates at the same levels: they are compared once and counted as often as they occur.
    """
    skeleton = lambda w: F.substring(F.regexp_replace(w, "[aeiou]|(.)(?=\\1)", ""), 1, 4)
    cuts = [lambda w: F.substring(w, 1, 4), lambda w: F.substring(w, -4, 4), skeleton, lambda w: F.substring(F.array_join(F.array_sort(F.array_distinct(F.split(w, ""))), ""), 1, 12)]
    pops = F.array(F.when(F.col("sold_population").isNotNull(), F.concat_ws(":", "sold_population", F.substring("district", 1, 2))), F.when(F.col("slug").isNull(), F.concat_ws(":", "population", F.substring("district", 1, 2))))

    def once(df: DataFrame, key: Column, name: str, count: str) -> DataFrame:
        rest = [c for c in df.columns if c != "id"]
        rows = df.groupBy(*rest).agg(key.alias(name), F.count("*").alias(count)).withColumns({"core": _core(F.col("name")), "slug_core": _core(F.col("slug"))})
        return checkpointed(rows.withColumns({
            "ordered": _ordered(F.col("name")), "slug_ordered": _ordered(F.col("slug")), "kind": _kind(F.col("name")), "slug_kind": _kind(F.col("slug")),
            "name_keys": _hashed(*[_keys(cut) for cut in cuts]), "keys": _hashed(pops),
        }).drop("core", "slug_core"))

    left = once(pages.withColumn("alike", _alike(pages)), F.first("alike"), "l", "w").drop("alike", "name", "slug")
    right = once(suburbs, F.min("id").cast("long"), "r", "n").drop("slug", "slug_ordered", "slug_kind", "sold_population")
    return matching.patterns(left, right)


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The suburb that each page describes best, with a confidence, however low; pages without any candidate have no row."""
    pages = checkpointed(page_records(spark, d))
    links = linkage.link_patterns(page_patterns(pages, suburb_records(spark, d)), matching.LEVELS, least=0.0)
    rows = pages.select(F.col("id").alias("page_id"), _alike(pages).alias("l")).join(links, "l")
    return rows.groupBy("page_id").agg(F.max(F.struct("confidence", (-F.col("r")).alias("r"))).alias("b")).select("page_id", (-F.col("b.r")).cast("int").alias("suburb_id"), "b.confidence")


SURE = 0.8


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The suburb that each page describes, if any: links of a confidence of at least 0.8."""
    return p5_links(spark, d).where(F.col("confidence") >= SURE).select("page_id", "suburb_id")


def p5_market(spark: SparkSession, d: str) -> DataFrame:
    """How many market_snapshot rows without suburb_id each page's suburb gets, with the confidence."""
    links = p5_links(spark, d).where(F.col("confidence") >= SURE).join(table(spark, d, "suburb_page").select("page_id", url_form(F.col("source_url")).alias("url")), "page_id")
    # pages whose addresses are variants of one: the surest of them, so that a row counts once
    best = links.groupBy("url").agg(F.max(F.struct("confidence", (-F.col("suburb_id")).alias("s"))).alias("b")).select("url", (-F.col("b.s")).alias("suburb_id"), "b.confidence")
    rows = table(spark, d, "market_snapshot").where("suburb_id is null").select(url_form(F.col("source_url")).alias("url"), "source_as_at").join(best, "url")
    return rows.groupBy("suburb_id", "source_as_at").agg(F.count("*").alias("rows"), F.round(F.min("confidence"), 4).alias("least_confidence"))


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "valuation").select("valuation_date", F.nullif("cv", F.lit(0)).alias("cv"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of cv for each valuation date, with a bound of their rank error."""
    made = percentiles.sketch(_values(spark, d), F.col("valuation_date"), F.col("cv"))
    return percentiles.percentiles(made.withColumnRenamed("g", "valuation_date"), "valuation_date", QUANTILES)


def p6_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of cv for each year, from the merged sketches of its dates."""
    days = percentiles.sketch(_values(spark, d), F.col("valuation_date"), F.col("cv"))
    years = percentiles.merge(days.withColumn("year", F.year("g")), ["year"])
    return percentiles.percentiles(years, "year", QUANTILES)


def p6_bound(spark: SparkSession, d: str) -> DataFrame:
    """For each valuation date and percentile: whether the true rank of the answer is within the stated bound."""
    got = p6_percentiles(spark, d)
    counts = _values(spark, d).where("cv is not null").groupBy("valuation_date", F.col("cv").cast("double").alias("cv")).agg(F.count("*").alias("c"))
    ranks = got.join(counts, got["valuation_date"].eqNullSafe(counts["valuation_date"])).groupBy(got["valuation_date"], "q", "n", "rank_error").agg(
        F.sum(F.when(F.col("cv") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("cv") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto")
    )
    off = F.greatest(F.col("below") - F.col("q") * F.col("n"), F.col("q") * F.col("n") - F.col("upto"), F.lit(0.0))
    return ranks.select("valuation_date", "q", "n", (off <= F.col("rank_error") * F.col("n") + 1).alias("within"))


P6_BOUND_SQL = f"""
SELECT valuation_date, q, count(*) AS n, TRUE AS within FROM valuation, (SELECT unnest({QUANTILES}) AS q)
WHERE cv IS NOT NULL AND cv <> 0 GROUP BY valuation_date, q"""


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    return tokens.round_trip(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "same")


P8_ROUND_TRIP_SQL = "SELECT doc_id, TRUE AS same FROM documents"

MIX_SHARE = 0.5
LANGUAGES = ["en", "mi", "zh", "de", "fr", "es", "pt", "nl"]


def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    # fixed: one row for each source
    return {r[0]: (r[1], r[2]) for r in table(spark, d, "mix_target").select("source", "target_share", "max_repeat").where("source is not null").collect()}


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its leaf in the tree and its size in tokens."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("key"),
        F.when(F.col("suburb_id").isNull(), "general").otherwise("place").alias("domain"),
        F.when(label_form(F.col("lang")).isin(LANGUAGES), label_form(F.col("lang"))).otherwise("und").alias("language"),
        source_form(F.col("source")).alias("source"),
        "text",
    )
    return tokens.count_tokens(docs)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a mix half the size of the corpus, and how often each is used."""
    return mixing.mix(_sized(spark, d), _targets(spark, d), share_of_all=MIX_SHARE).select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    targets = _targets(spark, d)
    return mixing.shares(mixing.mix(_sized(spark, d), targets, share_of_all=MIX_SHARE), targets)


def p9_leaves(spark: SparkSession, d: str) -> DataFrame:
    """What each leaf of the tree was to give, can give, gives and lacks."""
    return mixing.leaf_report(_sized(spark, d), _targets(spark, d), share_of_all=MIX_SHARE)


def p9_bound(spark: SparkSession, d: str) -> DataFrame:
    """For each target: whether its share is within 0.005 of its plan or within a mean document of it, and whether the mix is within a median
    document of its size. A hundred documents are too few for either."""
    docs, targets = checkpointed(_sized(spark, d)), _targets(spark, d)
    own = docs.where(F.col("source").isin(list(targets)) & (F.col("tokens") > 0)).agg(F.sum("tokens").alias("all"), F.median("tokens").alias("usual"))
    mean = docs.where("tokens > 0").groupBy("source").agg(F.avg("tokens").alias("mean"))
    leaves = mixing.leaf_report(docs, targets, share_of_all=MIX_SHARE).groupBy("source").agg(F.first("source_plan").alias("budget"), F.sum("tokens").alias("tokens")).join(mean, "source")
    whole = leaves.agg(F.sum("budget").alias("planned"), F.sum("tokens").alias("reached"))
    want = spark.createDataFrame([(s, float(w)) for s, (w, _) in targets.items()], "source string, target_share double")
    rows = want.join(leaves, "source", "left").fillna(0.0, ["budget", "tokens", "mean"]).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(own))  # one row each
    off = F.abs(F.col("tokens") - F.col("budget") * F.col("reached") / F.col("planned"))
    return rows.select("source", "target_share", (off <= F.greatest(F.col("reached") * 0.005, "mean")).alias("share_met"), (F.abs(F.col("reached") - MIX_SHARE * F.col("all")) <= F.col("usual")).alias("size_met"))


P9_BOUND_SQL = "SELECT source, target_share, TRUE AS share_met, TRUE AS size_met FROM mix_target WHERE source IS NOT NULL"


def _languages(spark: SparkSession, d: str, anew: bool = False) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, "doc_id", "text", label_form(F.col("lang")), LANGUAGES, anew=anew)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The language of documents whose label does not name it, and the languages of mixed documents. The network is trained in every call,
    so that the query's time holds all of its work; p10_languages and p10_stretches use the one it leaves."""
    got = _languages(spark, d, anew=True)
    all_langs = F.array_distinct(F.transform(F.filter("stretches", lambda s: s["whole"]), lambda s: s["lang"]))
    wrong = F.when(~F.coalesce(F.col("label") == F.col("lang"), F.lit(False)), F.array(F.struct("lang", F.lit("label").alias("role"))))
    mixed = F.when(F.size(all_langs) > 1, F.transform(all_langs, lambda x: F.struct(x.alias("lang"), F.lit("mixed").alias("role"))))
    rows = got.where("lang is not null").select("doc_id", F.explode(F.concat(F.coalesce(wrong, F.array()), F.coalesce(mixed, F.array()))).alias("r"))
    return rows.select("doc_id", "r.lang", "r.role")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language with its confidence."""
    return _languages(spark, d).select("doc_id", "lang", F.round("confidence", 3).alias("confidence"), F.size("stretches").alias("stretches"))


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of each document with its language and confidence."""
    return _languages(spark, d).select("doc_id", F.explode("stretches").alias("s")).select("doc_id", "s.start", "s.end", "s.lang", F.round("s.confidence", 3).alias("confidence"))


QUERIES = {"p5_found": p5_found, "p5_links": p5_links, "p5_market": p5_market, "p6_percentiles": p6_percentiles, "p6_by_year": p6_by_year, "p6_bound": p6_bound, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_leaves": p9_leaves, "p9_bound": p9_bound, "p10_found": p10_found, "p10_languages": p10_languages, "p10_stretches": p10_stretches}
SQL = {"p6_bound": P6_BOUND_SQL, "p9_bound": P9_BOUND_SQL, "p8_round_trip": P8_ROUND_TRIP_SQL}
