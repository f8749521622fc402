"""Operators and sources that the queries use only in part."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.nearby import metres
from tidemark.operators import api, grid, model, quality, relational, scd, search, text
from tidemark.session import checkpointed
from tidemark.sources import files
from tidemark.sources.versions import VersionStore
from tidemark.streaming import snapshots

KEYS = ["bank", "product", "term"]


def snap(spark, rows):
    return spark.createDataFrame(rows, "bank string, product string, term string, rate double")


A, B, C = ("fern", "basic", "6m", 7.1), ("fern", "basic", "5y", 6.35), ("gull", "saver", "6m", 6.9)
DAYS = ["2031-02-03", "2031-02-10", "2031-02-24", "2031-03-03", "2031-03-31", "2031-04-07"]


def test_random_snapshots_merged_and_replayed(spark):
    """Snapshots merged one after the other, all replayed at once, and a dictionary give the same intervals and counts."""
    rng, days = random.Random(12), [f"2030-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (2, 16)]
    names = [(b, p, t) for b in "uv" for p in "mn" for t in ("1y", "2y")]
    cards = [{k: rng.choice([3.5, 4.25, 5.0]) for k in names if rng.random() < 0.6} for _ in days]
    open_, done, counted = {}, [], []
    for day, card in zip(days, cards):
        c = {"opened": 0, "repriced": 0, "delisted": 0, "unchanged": 0}
        for k in {*open_, *card}:
            was, now = open_.get(k), card.get(k)
            if was and was[0] == now:
                c["unchanged"] += 1
                continue
            if was:
                done.append((*k, was[0], was[1], day))
                del open_[k]
            if now:
                open_[k] = (now, day)
            c["opened" if not was else "delisted" if not now else "repriced"] += 1
        counted.append((day, *c.values()))
    want = sorted(done + [(*k, r, d, "None") for k, (r, d) in open_.items()])
    flat = lambda df: sorted((*(r[c] for c in [*KEYS, "rate"]), str(r["valid_from"]), str(r["valid_to"])) for r in df.collect())
    table = scd.opened(snap(spark, [(*k, r) for k, r in cards[0].items()]), KEYS, "rate", days[0])
    for day, card in zip(days[1:], cards[1:]):
        table = checkpointed(scd.merge(table, snap(spark, [(*k, r) for k, r in card.items()]), KEYS, "rate", day))
    assert flat(table) == want
    rows = [(*k, r, date.fromisoformat(d)) for d, card in zip(days, cards) for k, r in card.items()]
    every = spark.createDataFrame(rows, "bank string, product string, term string, rate double, d date")
    assert flat(scd.replay(every, KEYS, "rate", "d")) == want
    assert sorted((str(r["at"]), r["opened"], r["repriced"], r["delisted"], r["unchanged"]) for r in scd.replay_counts(every, KEYS, "rate", "d").collect()) == counted
    assert scd.replay(every.limit(0), KEYS, "rate", "d").count() == 0


def test_versions_stay_readable(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "t"))
    assert store.version() == -1
    for n in range(3):
        assert store.write(spark.range(n + 1), {"n": n}) == n
    assert [store.read(v).count() for v in range(3)] == [1, 2, 3] and store.read().count() == 3 and [x["n"] for x in store.log()] == [0, 1, 2]


def test_stream_of_snapshots(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "bank string, product string, term string, rate double, as_at date"
    put = lambda rows, day: snap(spark, rows).withColumn("as_at", F.lit(day).cast("date")).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: snapshots.follow(spark, folder, schema, str(tmp_path / "t"), str(tmp_path / "s"), KEYS, "rate", "as_at").awaitTermination()
    put([A, B], DAYS[0])
    run()
    put([(*A[:3], 7.45), B, C], DAYS[1])
    put([(*A[:3], 7.45), B, C], DAYS[2])
    run()
    put([A], DAYS[0])  # late: passed over
    run()
    store = VersionStore(spark, str(tmp_path / "t"))
    assert store.version() == 1 and store.read().count() == 4 and store.read().where("is_current").count() == 3


def test_append_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    run = lambda: snapshots.append_stream(spark, folder, "k int, v int", str(tmp_path / "t"), str(tmp_path / "s"), ["k"]).awaitTermination()
    for rows in ([(1, 1), (2, 2), (2, 2), (None, 0)], [(2, 9), (3, 3)], [(1, 1)]):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(folder)
        run()
    store = VersionStore(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, store.read().collect())) == [(1, 1), (2, 2), (3, 3)] and store.version() == 1


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"type":"FeatureCollection","features":[{"properties":{"id":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},'
        '{"properties":{"id":2},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"properties":{"id":3},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    )
    got = {r["id"]: r["rings"] for r in files.geojson(spark, str(tmp_path), "id int").collect()}
    assert len(got[1]) == 1 and len(got[2]) == 2 and got[3] is None and got[2][1][1]["x"] == 6.0


def test_html_and_payload(spark):
    page = '<p>no</p><table><tr><th>a<th><img alt="b c"><tr><td> 1 <b>2</b></td><td></table><table><tr><td>z</table>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<td>loose")], "id int, html string")
    got = sorted(tuple(r) for r in files.html_cells(df, "id", "html").collect())
    assert got[:4] == [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b c"), (1, 0, 1, 0, "1 2"), (1, 0, 1, 1, "")] and (1, 1, 0, 0, "z") in got
    pages = spark.createDataFrame([('push("x\\"suburbData\\":{\\"a\\":[1,2]},\\"b\\":1")',), ("none",), (None,)], "t string")
    assert [r[0] for r in pages.select(files.payload(F.col("t"), "suburbData")).collect()] == ['{"a": [1, 2]}', None, None]


def test_fit_to_bytes(spark):
    df = spark.createDataFrame([("abc",), ("日本語",), ("éé",), (None,)], "t string")
    assert [r[0] for r in df.select(files.fit_to_bytes(F.col("t"), 4)).collect()] == ["abc", "日", "éé", None]


def test_areas_and_dates(spark):
    df = spark.createDataFrame([("711 M2",), ("1.2 HA",), ("1,020 m2",), ("0 M2",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(scalars.area_m2(F.col("a"))).collect()] == [711.0, 12000.0, 1020.0, None, None, None]
    d = spark.createDataFrame([(45_000,), (1,), (None,)], "n int").select(scalars.serial_date(F.col("n"), "2000-01-01", "2030-01-01"))
    assert [r[0] for r in d.collect()] == [date(2023, 3, 15), None, None]


def test_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(scalars.python_round(2)("v")).collect()] == [0.12, 2.5, None]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,), (2.7,)], "v double").select(scalars.half_even_long(F.col("v"))).collect()] == [2, 4, 3]


def test_projection(spark):
    """On the central meridian the easting is the false one; a degree of latitude is about 111 km."""
    e, n = scalars.nztm_sql("lon", "lat")
    df = spark.createDataFrame([(173.0, -41.0), (173.0, -42.0), (174.7645, -36.8443)], "lon double, lat double").select(F.expr(e), F.expr(n))
    a, b, c = df.collect()
    assert a[0] == pytest.approx(1_600_000) and a[1] - b[1] == pytest.approx(0.9996 * 111_052, rel=1e-3)
    assert c[0] == pytest.approx(1_757_300, abs=300) and c[1] == pytest.approx(5_920_900, abs=300)


def test_sentence_trim_and_evidence(spark):
    t = "One two. Three four! Five six seven"
    got = spark.createDataFrame([(t,), ("short",), (None,)], "t string").select(scalars.trim_to_sentence(F.col("t"), 22)).collect()
    assert [r[0] for r in got] == ["One two. Three four!", "short", None]
    r = spark.createDataFrame([("x" * 50 + " quarry " + "y" * 50,)], "t string").select(scalars.evidence(F.col("t"), F.lit(52), F.lit(6))).first()[0]
    assert r.startswith("…") and r.endswith("…") and "quarry" in r


def test_name_key(spark):
    df = spark.createDataFrame([("Mount Rōskill",), ("Saint Mary's Bay",), (None,)], "n string")
    assert [r[0] for r in df.select(scalars.name_key(F.col("n"))).collect()] == ["mtroskill", "stmarysbay", None]


def test_query_interface(spark):
    """Requests over random records like plain Python."""
    rng = random.Random(13)
    mixes = [None, "1/2/x/4/5", "1/2/3/4"] + ["/".join(str(rng.randrange(60)) for _ in range(5)) for _ in range(6)]
    rows = [(f"{rng.choice('PQRpqr')}lace {i}", rng.choice([None, "Upper", "Lower"]), rng.choice([None, *range(310, 320)]), rng.choice([None, "", "lake", "lake/hill", "hill"]), rng.choice(mixes), rng.choice([None, 1.5, 30.0])) for i in range(60)]
    rows = [(a, b, None if c is None else c * 1_000.0, *r) for a, b, c, *r in rows]
    df = spark.createDataFrame(rows, "name string, zone string, price double, traits string, bedroom_mix string, km double")

    def share(mix, i):
        parts = (mix or "").split("/")
        return float(parts[i - 1]) if len(parts) == 5 and all(p.isdigit() for p in parts) else -1

    def names(keep, key=lambda r: r[0]):
        return [r[0] for r in sorted(filter(keep, rows), key=key)]

    got = lambda **k: [x["name"] for x in api.select(df, api.Request(limit=20, **k)).collect()]
    assert got(numeric={"price": (313_000, 315_000)}) == names(lambda r: r[2] and 313_000 <= r[2] <= 315_000)[:20]
    assert got(numeric={"km": (None, None)}, zones=["Upper"]) == names(lambda r: r[5] is not None and r[1] == "Upper")[:20]
    assert got(traits=["hill", "lake"]) == names(lambda r: r[3] == "lake/hill")[:20] and got(names=[rows[7][0].upper()]) == [rows[7][0]]
    last = lambda sign: lambda r: (r[2] is None, sign * (r[2] or 0), r[0])
    assert got(sort_by="price") == names(lambda r: True, last(-1))[:20] and got(sort_by="price", descending=False) == names(lambda r: True, last(1))[:20]
    assert got(bedrooms=(4, 25)) == names(lambda r: share(r[4], 4) >= 25)[:20]
    assert len(api.select(df, api.Request(limit=0)).collect()) == 1
    priced = sorted(r[2] for r in rows if r[2])
    mid = api.summarise(df, api.Request(), "price", "median", False).first()
    assert mid["matched"] == 60 and mid["value"] == (priced[(len(priced) - 1) // 2] + priced[len(priced) // 2]) / 2
    for zone in ("Upper", "Lower"):
        own = [r for r in rows if r[1] == zone and r[2]]
        best = {r["grp"]: r for r in api.summarise(df, api.Request(), "price", "max", True).collect()}[zone]
        assert best["value"] == max(r[2] for r in own) and best["name"] == min(r[0] for r in own if r[2] == best["value"])
    calc = lambda op, a, b: spark.range(1).select(api.calculate(F.lit(op), F.lit(a), F.lit(b))).first()[0]
    assert calc("percent_change", 40.0, 50.0) == 25.0 and calc("percent_change", -40.0, -30.0) == 25.0 and calc("subtract", 3.0, 4.5) == -1.5 and calc("divide", 3.0, 4.0) == 0.75
    with pytest.raises(Exception, match="division by zero"):
        calc("divide", 1.0, 0.0)


def test_scoped_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.9, 0.1], 1)], "vec_id long, vector array<float>, scope int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1), (9, None, 1)], "query_id long, vector array<float>, scope int")
    hits = search.top_k(q, v, 5).orderBy("rank").collect()
    assert [(h["vec_id"], h["rank"]) for h in hits] == [(2, 1), (5, 2)]
    assert [h["vec_id"] for h in search.top_k(q, v, 1, scoped=False).collect()] == [3]
    assert search.evaluate(search.top_k(q, v, 5, scoped=False), 5).first().asDict() == {"queries": 1, "recall_at_5": 1.0, "mrr": 0.5, "off_scope": 0.2}
    z = spark.createDataFrame([([], [60],), ([60, 1], []), (None, None)], "z array<int>, x array<int>")
    assert [r[0] for r in z.select(search.in_scope("z", "x", 60)).collect()] == [False, True, True]


def test_interval_and_nearest_joins(spark):
    p = spark.createDataFrame([("a", date(2025, 3, 1)), ("a", date(2025, 9, 1)), ("b", date(2025, 3, 1))], "k string, d date")
    i = spark.createDataFrame([("a", date(2024, 1, 1), date(2025, 3, 1)), ("a", date(2025, 3, 1), None), ("a", date(2026, 1, 1), None)], "k string, s date, e date")
    got = relational.interval_join(p, "d", i, "s", "e", ["k"]).collect()
    assert sorted((r["k"], r["d"], r["s"]) for r in got) == [("a", date(2025, 3, 1), date(2025, 3, 1)), ("a", date(2025, 9, 1), date(2025, 3, 1))]
    left = spark.createDataFrame([(1, 170.0, -40.0), (2, 178.0, -35.0)], "id long, x double, y double")
    right = spark.createDataFrame([(10, 170.001, -40.0), (11, 170.0, -40.001), (12, 171.0, -44.0)], "rid long, bx double, by double")
    assert sorted((r["id"], r["rid"]) for r in relational.nearest(left, right, "id", "rid").collect()) == [(1, 10), (2, 10)]


def test_nearest_like_brute_force(spark):
    rng = random.Random(8)
    left = [(i, rng.uniform(166, 179), rng.uniform(-47, -34)) for i in range(120)]
    right = [(i, rng.gauss(172, 0.3), rng.gauss(-40, 0.3)) for i in range(200)] + [(900, 178.9, -46.9)]
    want = [(i, min(right, key=lambda r: (float(metres(x, y, r[1], r[2])), r[0]))[0]) for i, x, y in left]
    df = spark.createDataFrame(left, "id long, x double, y double")
    other = spark.createDataFrame(right, "rid long, bx double, by double")
    assert sorted((r["id"], r["rid"]) for r in relational.nearest(df, other, "id", "rid").collect()) == want
    assert relational.nearest(df, other.limit(0), "id", "rid").count() == 0


def test_grid_operators(spark):
    pts = spark.createDataFrame([("g", x + 0.5, y + 0.5, float(x * 10 + y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "g string, x double, y double, v double")
    b = grid.bounds(pts, "g", 0.7)
    c = grid.cells(pts, "g", b)
    filled = grid.fill(c, "g", b, passes=1)
    assert c.count() == 8 and filled.count() == 9 and filled.join(c, ["g", "gx", "gy"], "left_anti").first()["v"] == 11.0
    flat = grid.smooth(c.withColumn("v", F.lit(7.0)), "g", b)
    assert {round(r["v"], 9) for r in flat.collect()} == {7.0}
    h = grid.log_histogram(pts.withColumn("v", F.col("v") + 1), "g", "v", 4).first()
    assert sum(h["hist"]) == 8 and h["n"] == 8


def test_quality_operators(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "k int, v double")
    assert quality.violations(df, "t", {"positive": "v > 0"}).first()["violations"] == 1
    with pytest.raises(Exception, match="positive"):
        quality.enforce(df, {"positive": "v > 0"}).collect()
    g = quality.gate(df, "s", 5, {"v": 0.9}).first()
    assert not g["ok"] and "fewer than 5" in g["message"] and "v is filled" in g["message"]
    d = quality.drift(df, df.withColumn("v", F.col("v") * 1.5), "k", "v", 0.3).collect()
    assert [(r["k"], r["drift"]) for r in d] == [(1, 0.5), (3, 0.5)]
    s = spark.createDataFrame([("a", 6, date(2025, 1, 1), False), ("b", 6, None, False), ("c", 6, date(2025, 1, 9), True), ("d", 6, date(2025, 1, 9), None)], "source string, every_days int, last_ok date, forced boolean")
    assert [r["due"] for r in quality.due(s, "2025-01-10").collect()] == [True, True, True, False]
    assert quality.same_rows(df, df.union(df.limit(1))).first()[:] == (0, 1)


def test_traits(spark):
    rows = [
        (1, "Nobody swims there now. It was a beach. Its tidal flats are wide, near a quarry.", "Crumb"),
        (2, "Gull Village is small; wide orchards follow.", "Gull"),
        (3, "Elm (ELM-\u0259n, port) has a scenic reserve. The Harbour Bridge is far.", "Elm"),
        (4, "Facing the forest, a warehouse. Lava everywhere.", None),
        (5, None, "x"), (6, "", ""), (7, "quarry " * 20_000, "a(b["), (8, "A port; a port.", "port"),
    ]
    got = {r["id"]: r["traits"] for r in text.traits(spark.createDataFrame(rows, "id int, t string, n string"), "id", "t", "n").collect()}
    assert {k: set(v) for k, v in got.items()} == {1: {"coastal"}, 2: {"rural"}, 3: {"bush"}, 4: {"volcanic"}, 5: set(), 6: set(), 7: {"industrial"}, 8: set()}
    assert "tidal" in got[1]["coastal"] and got[1]["coastal"].startswith("…") and "orchards" in got[2]["rural"]
    assert {r["trait"]: r["texts"] for r in text.coverage(text.traits(spark.createDataFrame(rows, "id int, t string, n string"), "id", "t", "n")).collect()}["none"] == 3


def test_claims(spark):
    df = spark.createDataFrame([("$703,000, $1.2m and $450k or $5",), (None,)], "t string")
    assert [r[0] for r in df.select(text.money(F.col("t"))).collect()] == [[703_000.0, 1_200_000.0, 450_000.0, 5.0], None]
    more = spark.createDataFrame([("$1.78M or $450K, 98.5万元, 2百万, 4.2 % and 7 per cent, 1,200 km, 5 kmh",)], "t string")
    assert more.select(*[text.figures(F.col("t"), k) for k in text.FIGURES]).first()[:] == ([1_780_000.0, 450_000.0], [985_000.0, 2_000_000.0], [4.2, 7.0], [1_200.0])
    claims = spark.createDataFrame([(1, 100.0), (1, 100.0), (1, 150.0), (2, 1.0)], "k int, claim double")
    facts = spark.createDataFrame([(1, 100.4), (1, 900.0)], "k int, fact double")
    assert sorted(r["supported"] for r in text.supported(claims, facts, "k", 0.5, 0.001, 0.5).collect()) == [False, False, True, True]


def test_longest_run():
    assert text.longest_run([5, 1, 2, 9, 3, 3, 4]) == [1, 2, 5, 6] and text.longest_run([]) == []


def test_clauses(spark):
    rows = [("H1", 1, 100.0, 700.0, "H1.1 Purpose"), ("H1", 1, 100.0, 690.0, "This chapter sets out what may be built, and where, in the zone."), ("H1", 1, 300.0, 680.0, "H1.9 a cell of a table"),
            ("H1", 1, 100.0, 670.0, "H1.2 Rules"), ("H1", 2, 100.0, 700.0, "(1) First rule of the zone is here. "), ("H1", 2, 100.0, 690.0, "(2) Second rule of the zone is here."), ("H1", 2, 20.0, 600.0, "PC 78"),
            ("H1", 2, 100.0, 600.0, "H1.3 Gone"), ("H1", 2, 100.0, 590.0, None)]
    df = spark.createDataFrame(rows, "chapter string, page int, x double, y double, text string")
    got = [(r["clause"], r["part"], r["status"], r["page_from"], r["page_to"]) for r in text.segment(df, 40).orderBy("clause", "part").collect()]
    assert got == [("H1.1", 1, "active", 1, 1), ("H1.2", 1, "active", 1, 2), ("H1.2", 2, "active", 1, 2), ("H1.3", 1, "replaced", 2, 2)]


def test_model(spark):
    df = spark.createDataFrame([(i, 3.0 * i + 100 + (i % 7), float(i), None if i % 9 == 0 else i * 2.0) for i in range(300)] + [(999, None, 1.0, 1.0)], "id long, y double, a double, b double")
    p = model.out_of_fold(df, "id", "y", ["a", "b"])
    s = model.scores(p).first()
    zero = model.out_of_fold(df.withColumn("y", F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("y"))).withColumn("z", F.when(F.col("id") % 2 == 0, "odd")), "id", "y", ["a", "b"], "boosted", folds=2, categories=["z"], rounds=5)
    assert zero.count() == 270 and model.scores(zero).first()["mape"] < 50 and model.scores(zero.limit(0)).first()["mape"] is None
    assert s["rows"] == 300 and s["r2"] > 0.95 and model.bands(p, "id").where("confidence = 'high'").count() > 200


def test_whole_valuation_is_calculated_and_dated(spark, small):
    import __spark_entry__ as entry

    v = spark.read.parquet(f"{small}/valuation.parquet")
    assert v.where("cv > 0 and lv > 0").select("run_id").distinct().count() > 2
    for name, rows in (("calculations", "cv > 0 and lv > 0"), ("serial_dates", "ru_id is not null")):
        assert entry.queries()[name](spark, small).count() == v.where(rows).count()


def test_labels_and_sources_in_any_spelling(spark, tmp_path):
    import __spark_entry__ as entry

    labels = ["en", "en-NZ", "en_nz", "EN", " en", "mi", None]
    sources = ["plan_clause", "Plan-Clause", " plan clause ", "PLAN_CLAUSE", "listing", None, "plan__clause"]
    docs = [(3 * i + 1, "A beach.", a, b, None) for i, (a, b) in enumerate(zip(labels, sources))]
    spark.createDataFrame([(1, "x")], "suburb_id int, name string").write.parquet(f"{tmp_path}/suburb.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, suburb_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(z,) for z in (1, 4, 7, 19, 49)], "planning_zone_code int").write.parquet(f"{tmp_path}/rating_unit.parquet")
    run = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert [r[0] for r in run("text_traits")] == [1, 4, 7, 10, 13] and run("trait_coverage") == [("coastal", 5)]
    assert run("zone_map") == [(1, 1, [1]), (4, 1, [4]), (7, 1, [7]), (19, 1, [19])]
    assert run("clause_coverage") == [(5, 4)] and run("clauses_of_zone") == []


def test_rate_cards(spark):
    """Columns by their header, a product named once for all its rows, not carried into another table."""
    page = "<table><tr><th>Rate p.a.<th>Product<th>Term<tr><td>5.10%<td>Fixed<td>1 year<tr><td>6 %<td><td>18 months<tr><td>n/a<td>Flex<td>none</table><table><tr><th>Term<th>Product<th>Rate<tr><td>2 years<td><td>7</table><table><tr><td>x</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    assert sorted(tuple(r) for r in files.rate_card(df, "id", "html").collect()) == [(1, "Fixed", "1 year", 5.1), (1, "Fixed", "18 months", 6.0)]


def test_rounds_are_data(spark, tmp_path):
    """The last round is the newest date that most units have, whatever it is; later interim dates are none."""
    from tidemark.plans.registry import Tables
    from tidemark.plans.views import round_dates

    rows = [(i, date(y, 5, 2), 1) for i in range(40) for y in (2040, 2043, 2046) if y < 2046 or i < 30] + [(3, date(2047, 1, 1), 1), (None, date(2048, 1, 1), 1)]
    spark.createDataFrame(rows, "ru_id int, valuation_date date, cv long").write.parquet(f"{tmp_path}/valuation.parquet")
    assert round_dates(Tables(spark, str(tmp_path))) == [date(2046, 5, 2), date(2043, 5, 2)]
    spark.createDataFrame([], "ru_id int, valuation_date date, cv long").write.parquet(f"{tmp_path}/empty/valuation.parquet")
    assert round_dates(Tables(spark, f"{tmp_path}/empty")) == [None, None]


def test_sql_is_read_only(spark, small, tmp_path):
    from tidemark.sources import views

    views.register(spark, small, ["suburb"])
    assert views.ask(spark, "WITH x AS (SELECT suburb_id FROM suburb) SELECT count(*) FROM x").first()[0] > 0
    for bad in ("DROP VIEW suburb", "CREATE TABLE zz AS SELECT 1", "INSERT INTO suburb SELECT * FROM suburb", "SET spark.sql.ansi.enabled=false", f"INSERT OVERWRITE DIRECTORY '{tmp_path}' USING parquet SELECT 1", "CACHE TABLE suburb", "DELETE FROM suburb"):
        with pytest.raises(PermissionError):
            views.ask(spark, bad)
    got = {r["table_name"]: r for r in views.prechecks(spark, small, ["suburb", "nothing"]).collect()}
    assert got["suburb"]["present"] and not got["nothing"]["present"] and got["nothing"]["files"] == 0
