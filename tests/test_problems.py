"""The record-keeping operators against brute force and on odd input."""

import itertools
import math
import random
from datetime import date, datetime

import numpy as np
import pytest

from tidemark.operators import history, nearby, orphans, profile, snapshot_diff
from tidemark.operators.bvh import Bvh, ear_clip, fan, in_triangles
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- nearby -----------------------------------------------------------------

POINTS = "id long, lon double, lat double, metres double, leaf int"


def brute_pairs(pts, within):
    out = {}
    for (i, x, y, *_), (j, u, v, *_) in itertools.product(pts, pts):
        if i is None or j is None or i >= j or None in (x, y, u, v) or not all(map(math.isfinite, (x, y, u, v))) or max(abs(x), abs(u)) > 180 or max(abs(y), abs(v)) > 90:
            continue
        d = float(nearby.metres(x, y, u, v))
        if d <= within:
            out[i, j] = min(d, out.get((i, j), 1e9))
    return sorted(out)


@pytest.mark.parametrize("cap", [3, 50, 6_000])
def test_near_pairs_like_brute_force(spark, cap):
    rng = random.Random(cap)
    pts = [(i, 174 + rng.random() * 0.01, -37 - rng.random() * 0.01, 1.0, 2) for i in range(300)]
    pts += [(1_000 + i, 174.005, -37.005, None, None) for i in range(12)]  # one site
    pts += [(1, pts[1][1], pts[1][2], 0.0, 0)] * 3  # repeated rows
    pts += [(5, 174.0, -37.0, 0.0, 0)]  # an id with a second location
    pts += [(None, 174.005, -37.005, 0.0, 0), (2_000, None, -37.0, 0.0, 0), (2_001, float("nan"), -37.0, 0.0, 0), (2_002, 999.0, -37.0, 0.0, 0)]
    got = nearby.near_pairs(spark.createDataFrame(pts, POINTS), "id", "lon", "lat", 40.0, cap)
    assert [(a, b) for a, b, _ in rows(got)] == brute_pairs(pts, 40.0)


def test_near_pairs_empty(spark):
    assert nearby.near_pairs(spark.createDataFrame([], POINTS), "id", "lon", "lat", 40.0).count() == 0


def even_odd(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def star(rng, n, cx, cy):
    far = [rng.uniform(0.2, 1) for _ in range(n)]
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(far)]


def test_ear_clipping_covers_the_ring():
    rng = random.Random(1)
    for n in (3, 4, 9, 40):
        ring = star(rng, n, 0, 0)
        tri = np.array(ear_clip([*ring, ring[0]]))
        assert len(tri) == n - 2
        for _ in range(200):
            x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
            inside, _ = in_triangles(tri, np.full(len(tri), x), np.full(len(tri), y))
            assert inside.any() == even_odd(ring, x, y)


def test_crossing_rings_fall_back_to_a_fan():
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    assert ear_clip(bow) is None and len(fan(bow)) == 2
    assert ear_clip([(0.0, 0.0), (1.0, 1.0)]) == []


def test_exact_border():
    t = np.array([[0.1, 0.1, 0.7, 0.7, 0.9, 0.1]])
    inside, border = in_triangles(t, np.array([0.4]), np.array([0.4]))
    assert inside[0] and border[0]


def test_bvh_query():
    rng = np.random.default_rng(2)
    lo = rng.random((500, 2))
    boxes = np.concatenate([lo, lo + rng.random((500, 2)) * 0.05], axis=1)
    q, i = Bvh(boxes).query(boxes[:50])
    want = {(a, b) for a in range(50) for b in range(500) if (boxes[a, :2] <= boxes[b, 2:]).all() and (boxes[b, :2] <= boxes[a, 2:]).all()}
    assert set(zip(q.tolist(), i.tolist())) == want
    assert len(Bvh(np.empty((0, 4))).query(boxes)[0]) == 0


RINGS = "rid int, rings array<array<struct<x: double, y: double>>>, lon double, id string"


def test_regions(spark):
    rng = random.Random(3)
    hole = [(0.3, 0.3), (0.6, 0.3), (0.6, 0.6), (0.3, 0.6), (0.3, 0.3)]
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    right = [(x + 1, y) for x, y in square]
    over = [(x + 0.5, y + 0.5) for x, y in square]
    ragged = star(rng, 25, 3, 3)
    bow = [(5.0, 5.0), (7.0, 7.0), (7.0, 5.0), (5.0, 7.0), (5.0, 5.0)]
    shapes = {1: [square, hole], 2: [right], 3: [over], 4: [[*ragged, ragged[0]]], 5: [bow]}
    regions = spark.createDataFrame([(k, v, 1.0, "a") for k, v in shapes.items()] + [(6, None, 0.0, ""), (7, [[(0.0, 0.0)]], 0.0, None), (None, [square], 0.0, None)], RINGS)
    pts = [(i, rng.uniform(-1, 8), rng.uniform(-1, 8)) for i in range(600)] + [(700 + i, rng.uniform(0, 2), rng.uniform(0, 1.5)) for i in range(200)]
    want = sorted((i, k) for i, x, y in pts for k, v in shapes.items() if sum(even_odd(r[:-1], x, y) for r in v) % 2)
    odd = [(9_001, 1.0, 0.25), (9_002, None, 1.0), (9_003, float("nan"), 1.0), (None, 0.1, 0.1), (9_004, 0.45, 0.45), (9_005, 500.0, 0.1)]
    df = spark.createDataFrame(pts + odd, "id long, lon double, lat double")
    for cap in (5, 6_000):
        got = rows(nearby.regions_of(df, "id", "lon", "lat", regions, "rid", "rings", cap))
        assert [g for g in got if g[0] < 9_000] == want
        # on the border of 1 and 2: the smaller id only; in the hole: nothing
        assert [g for g in got if g[0] >= 9_000] == [(9_001, 1)]
    assert nearby.regions_of(df.limit(0), "id", "lon", "lat", regions, "rid", "rings").count() == 0
    assert nearby.regions_of(df, "id", "lon", "lat", regions.limit(0), "rid", "rings").count() == 0


# --- profile ----------------------------------------------------------------


def test_profile_like_numpy(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", "c"]), rng.choice(["s", "t"]), rng.choice([None, 0.0, 1.5, 2.5, rng.gauss(3, 1)]), rng.choice([None, "x", "yy", "é"]), i, float("nan") if i % 50 == 0 else 1.0) for i in range(800)]
    df = spark.createDataFrame(data, "load string, kind string, v double, w string, num int, txt double")
    counts = profile.unpivot(df, ["v", "w", "num", "txt"], F.col("load"), F.col("kind"), {"w": "^x$"}, {"v": (0.5, 100)})
    for per in (4, 40, 400_000):
        got = {(r["col"], r["series"], r["load"]): r for r in profile.profile(counts, per).collect()}
        assert len(got) == 4 * 2 * 3
        for (col, s, load), r in got.items():
            k = ["load", "kind", "v", "w", "num", "txt"].index(col)
            own = [x[k] for x in data if x[0] == load and x[1] == s]
            live = [x for x in own if x is not None and x == x]
            assert (r["rows"], r["nulls"], r["n_distinct"]) == (len(own), len(own) - len(live), len(set(live)))
            assert r["mode_n"] == max(live.count(x) for x in set(live))
            if col == "w":
                assert (r["min_text"], r["max_text"], r["bad"]) == (min(live, key=str.encode), max(live, key=str.encode), sum(x != "x" for x in live))
                continue
            for q, c in zip(profile.QUANTILES, ("min", "p25", "median", "p75", "max")):
                assert r[c] == pytest.approx(np.quantile(live, q))
            assert r["bad"] == (sum(x < 0.5 for x in live) if col == "v" else 0)
            if load != "a":
                prev = [x[k] for x in data if x[0] == chr(ord(load) - 1) and x[1] == s and x[k] is not None and x[k] == x[k]]
                at = sorted({*live, *prev})
                ks = max(abs(sum(x <= v for x in live) / len(live) - sum(x <= v for x in prev) / len(prev)) for v in at)
                assert r["ks"] == pytest.approx(ks)
            else:
                assert r["ks"] is None


def test_profile_odd(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, None)], "load string, v double, pid int")
    got = profile.profile(profile.unpivot(df, ["v", "pid"], F.col("load"))).collect()
    assert {(r["col"], r["load"], r["rows"], r["nulls"], r["median"], r["n_distinct"]) for r in got} == {("v", "", 2, 2, None, 0), ("pid", "", 2, 2, None, 0)}
    assert profile.profile(profile.unpivot(df.limit(0), ["v"], F.col("load"))).count() == 0


def test_hot_column_is_cut(spark):
    df = spark.range(5_000).select((F.col("id") % 2).cast("string").alias("load"), (F.col("id") * 1.0).alias("v"))
    r = {x["load"]: x for x in profile.profile(profile.unpivot(df, ["v"], F.col("load")), 100).collect()}
    assert r["0"]["median"] == 2499.0 and r["1"]["n_distinct"] == 2500 and r["1"]["ks"] == pytest.approx(1 / 2500)


# --- history ----------------------------------------------------------------


def brute_history(data):
    norm = lambda s: " ".join((s or "").lower().split())
    last = {}
    for bank, product, at, fetched, rate in data:
        if at is not None:
            k = (norm(bank), norm(product), at)
            v = (fetched or datetime.min, -1 if rate is None else rate)
            last[k] = max(last.get(k, v), v)
    out = []
    for key in {k[:2] for k in last}:
        dates = sorted({k[2] for k in last if k[0] == key[0]})
        now, since = None, None
        for d in dates:
            v = last.get((*key, d))
            r = None if v is None or v[1] in (-1, 0) else round(v[1], 2)
            if r != now:
                if now is not None:
                    out.append((*key, now, since, d, False))
                now, since = r, d
        if now is not None:
            out.append((*key, now, since, None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_history_like_replay(spark, seed):
    rng = random.Random(seed)
    days = [date(2025, 1, 1 + 7 * i) if i < 4 else date(2025, 2 + i // 4, 1 + 7 * (i % 4)) for i in range(30)]
    data = []
    for d in days:
        for b in ("A b", "C"):
            if rng.random() < 0.1:
                continue
            for p in ("p", "q", None):
                if rng.random() < 0.85:
                    data.append((rng.choice([b, b.upper(), f"  {b.replace(' ', '  ')} "]), p, d, datetime(2025, 1, 1, rng.randrange(20)), rng.choice([5.0, 5.004, 5.25, 6.0, None, 0.0] if rng.random() < 0.5 else [5.0])))
                    if rng.random() < 0.2:
                        data.append((*data[-1][:3], None, 9.0))
    data += [("A b", "p", None, None, 5.0), data[0], data[0]]
    df = spark.createDataFrame(data, "bank string, product string, as_at date, fetched timestamp_ntz, rate double").withColumn("epoch", F.lit(1)).withColumn("v", F.lit("x"))
    for months in (1, 3):
        got = history.rebuild_history(df, ["bank", "product"], "as_at", "rate", "fetched", epoch_months=months)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_history(data)


def test_history_as_of(spark):
    data = [("a", date(2025, m, 1), r) for m, r in ((1, 5.0), (2, 5.0), (3, 6.0), (4, None), (9, 7.0), (12, 7.0))]
    df = spark.createDataFrame(data, "k string, at date, r double")
    obs = history.observed(df, ["k"], "at", "r", None, 2)
    store = history.build_store(history.patches(obs, 1, 1), 1, 2)
    at = lambda d: [(r["v"], str(r["since"])) for r in history.as_of(store, 1, d, 2).collect()]
    assert at("2024-12-31") == [] and at("2025-02-15") == [(5.0, "2025-01-01")] and at("2025-03-31") == [(6.0, "2025-03-01")]
    assert at("2025-06-01") == [] and at("2025-11-01") == [(7.0, "2025-09-01")] and at("2027-01-01") == [(7.0, "2025-09-01")]
    assert history.rebuild_history(df.limit(0), ["k"], "at", "r").count() == 0


# --- orphans ----------------------------------------------------------------


def test_bitmap_algebra():
    rng = np.random.default_rng(5)
    for n, top in ((10, 100), (5_000, 200_000), (60_000, 65_536), (100_000, 131_072)):
        a, b = rng.integers(0, top, n), rng.integers(0, top, n)
        x, y = orphans.Bitmap.of(a), orphans.Bitmap.of(b)
        assert x.codes().tolist() == sorted(set(a.tolist()))
        assert x.and_not(y).codes().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert (x & y).codes().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    run = orphans.Bitmap.of(np.arange(50_000))
    assert run.nbytes() == 4 and len(run.and_not(orphans.Bitmap.of(np.array([7])))) == 49_999
    assert len(orphans.Bitmap.of(np.empty(0, dtype=np.int64))) == 0


@pytest.mark.parametrize("per_range", [3, 30_000])
def test_orphans_like_brute_force(spark, per_range):
    rng = random.Random(6)
    day = lambda: date(2025, rng.randrange(1, 13), rng.randrange(1, 28))
    parents = [(k, rng.choice([None, day()]), rng.choice([None, day()])) for k in range(0, 60, 2)] + [(None, day(), day()), (4, date(2020, 1, 1), date(2030, 1, 1))]
    refs = [(rng.choice([None, 7, *range(0, 70)]), rng.choice([None, day()]), rng.choice([None, "2025-01", "2025-02"]), "x") for _ in range(600)]
    refs += [(7, date(2025, 5, 5), "2025-01", "hot")] * 300
    want = set()
    for k, load, period, _ in refs:
        own = [p for p in parents if p[0] == k]
        if k is None:
            continue
        if not own:
            want.add((k, period, "missing"))
        elif load is not None:
            if min(p[1] or date(1, 1, 1) for p in own) > load:
                want.add((k, period, "late"))
            if max(p[2] or date(9999, 1, 1) for p in own) < load:
                want.add((k, period, "deleted"))
    p = spark.createDataFrame(parents, "key long, first date, last date").withColumn("code", F.lit(1))
    r = spark.createDataFrame(refs, "key long, load date, period string, code string")
    got = orphans.orphans(r, p, F.col("key"), F.col("load"), F.col("period"), F.col("key"), F.col("first"), F.col("last"), per_range)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
    none = orphans.orphans(r, p.limit(0), F.col("key"), F.col("load"), F.col("period"), F.col("key"))
    assert {x["kind"] for x in none.collect()} == {"missing"}
    assert orphans.orphans(r.limit(0), p, F.col("key"), F.col("load"), F.col("period"), F.col("key")).count() == 0


def test_orphans_text_keys(spark):
    p, r = spark.createDataFrame([("a",), ("é",)], "k string"), spark.createDataFrame([("a",), ("b",), (None,), ("",)], "k string")
    got = orphans.orphans(r, p, F.col("k"), None, F.lit("p"), F.col("k"))
    assert rows(got) == [("", "p", "missing"), ("b", "p", "missing")]


# --- snapshot diff ----------------------------------------------------------


def brute_diff(data):
    zero = lambda v: None if v in (0, 0.0) else v
    last = {}
    low = lambda v: (0, 0) if v is None else (1, v)
    for k, rel, cap, a, b in data:
        if k is not None and rel is not None:
            mark = (low(cap), low(zero(a)), low(b))
            if (rel, k) not in last or mark > last[rel, k][0]:
                last[rel, k] = (mark, (zero(a), b))
    rels = sorted({r for r, _ in last})
    out = []
    for old, new in zip(rels, rels[1:]):
        for k in {k for r, k in last if r in (old, new)}:
            x, y = last.get((old, k)), last.get((new, k))
            if x is None or y is None or x[1] != y[1]:
                out.append((k, new, "added" if x is None else "removed" if y is None else "changed"))
    return sorted(out)


def test_snapshot_diff_like_brute_force(spark):
    rng = random.Random(7)
    data = []
    for m in range(1, 6):
        for k in range(400):
            if rng.random() < 0.95:
                data.append((k, date(2025, m, 1), datetime(2025, m, 2), rng.choice([0, None, 5, 6]) if rng.random() < 0.05 else 5, "t" if rng.random() < 0.99 else None))
                if rng.random() < 0.05:
                    data.append((k, date(2025, m, 1), rng.choice([None, datetime(2025, m, 3)]), 9, "t"))
    data += [(None, date(2025, 1, 1), None, 1, "x"), (1, None, None, 1, "x"), data[5], data[5]]
    df = spark.createDataFrame(data, "k int, rel date, cap timestamp_ntz, a int, b string").withColumn("release", F.lit(1)).withColumn("bucket", F.lit(2))
    got = snapshot_diff.snapshot_diff(df, ["k"], "rel", ["a", "b"], "cap")
    assert rows(got) == brute_diff(data)
    assert snapshot_diff.snapshot_diff(df.limit(0), ["k"], "rel", ["a"], "cap").count() == 0
    assert snapshot_diff.snapshot_diff(df.where("rel = date'2025-01-01'"), ["k"], "rel", ["a"], "cap").count() == 0


def test_merkle_looks_only_where_digests_differ(spark):
    base = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    two = base.withColumn("rel", F.lit(1)).unionByName(base.withColumn("rel", F.lit(2)).withColumn("v", F.when(F.col("k") == 77, 2).otherwise(1)))
    r = snapshot_diff.current_rows(two, ["k"], "rel", ["v"], None)
    depth = snapshot_diff.depth_for(20_000)
    pairs = spark.createDataFrame([(1, 2)], "old int, new int")
    assert snapshot_diff.differing_buckets(snapshot_diff.leaf_digests(r, depth), pairs, depth).count() == 1
    assert rows(snapshot_diff.snapshot_diff(two, ["k"], "rel", ["v"])) == [(77, 2, "changed")]


def test_history_store_touches_one_epoch(spark, tmp_path):
    """Snapshots applied one by one give the history of all at once; each writes its epoch only, a date reads one part."""
    rng, keys = random.Random(21), [("a", str(i)) for i in range(6)] + [("b", "0")]
    days = [date(2030, 1 + m, 1 + 9 * d) for m in range(5) for d in range(3)] + [date(2031, 2, 1)]
    rows = [(b, p, d, rng.choice([1.0, 2.0, 2.0, 0.0]), rng.choice([5.0, 6.0])) for d in days for b, p in keys if rng.random() < 0.8 and not (b == "b" and d.day == 1)]
    df = spark.createDataFrame(rows, "bank string, product string, d date, rate double, fee double").withColumn("at", F.lit("x"))
    store = history.HistoryStore(spark, str(tmp_path / "h"), ["bank", "product"], "d", ["rate", "fee"])
    for day in days:
        before = store.store.parts() if store.store.version() >= 0 else []
        assert store.apply(df.where(F.col("d") == day)) and not store.apply(df.where(F.col("d") == day))
        fresh = [p["kind"] for p in store.store.parts() if p not in before]
        assert len(fresh) == 1 or day == days[-1] and len(fresh) == 3
    flat = lambda x: sorted(tuple(str(v) for v in r) for r in x.collect())
    want = flat(history.rebuild_history(df, ["bank", "product"], "d", ["rate", "fee"]))
    assert flat(store.history()) == want and len(want) > 20
    whole = history.HistoryStore(spark, str(tmp_path / "w"), ["bank", "product"], "d", ["rate", "fee"])
    whole.build(df)
    assert flat(whole.history()) == want
    for day in ("2029-01-01", "2030-03-10", "2030-12-01", "2031-06-01"):
        valid = sorted((r[0], r[1]) for r in history.rebuild_history(df, ["bank", "product"], "d", ["rate", "fee"]).where(f"valid_from <= date'{day}' and (valid_to is null or valid_to > date'{day}')").select("bank", "product").collect())
        for s in (store, whole):
            got = s.as_of(day)
            assert sorted((r["bank"], r["product"]) for r in got.collect()) == valid
            assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 1
    empty = history.HistoryStore(spark, str(tmp_path / "e"), ["bank", "product"], "d", ["rate", "fee"])
    empty.build(df.limit(0))
    assert empty.store.version() == -1 and not empty.apply(df.limit(0))


def test_digest_store_hashes_a_release_once(spark, tmp_path):
    rng = random.Random(22)
    rows = [(i, r, rng.choice([None, 0, 5, 6]), rng.choice([1, 2])) for r in (1, 2, 3) for i in range(300) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k int, rel int, v int, cap int").withColumn("bucket", F.lit("x"))
    want = {(r["k"], r["release"], r["change"]) for r in snapshot_diff.snapshot_diff(df, ["k"], "rel", ["v"], "cap").collect()}
    store = snapshot_diff.DigestStore(spark, str(tmp_path / "d"), ["k"], "rel", ["v"], "cap", depth=2)
    for r in (1, 2, 3):
        before = store.store.parts() if store.store.version() >= 0 else []
        assert store.add(df.where(F.col("rel") == r)) == str(r)
        assert sorted(p["kind"] for p in store.store.parts() if p not in before) == [f"leaves {r}", f"rows {r}"]
    assert store.releases() == ["1", "2", "3"] and store.add(df.limit(0)) is None
    got = {(r["k"], r["release"], r["change"]) for a, b in (("1", "2"), ("2", "3")) for r in store.diff(a, b).collect()}
    assert got == want and len(want) > 100 and store.diff("2", "2").count() == 0


def test_two_writers_take_two_versions(spark, tmp_path):
    from tidemark.sources.versions import VersionStore

    a, b = VersionStore(spark, str(tmp_path / "t")), VersionStore(spark, str(tmp_path / "t"))
    a.write(spark.range(3))
    old = b.version
    b.version = iter([0, *[1] * 9]).__next__  # has not seen the other's version yet
    a.append(spark.range(1))
    assert b.append(spark.range(2)) == 2
    b.version = old
    assert b.read().count() == 6 and a.read(1).count() == 4 and len(a.parts()) == 3
    a.fs.create(a._path("_VERSIONS/3.json"), False).close()  # a version whose file is not written yet
    assert a.version() == 2


def test_crowded_cell_is_dealt_to_blocks(spark):
    """More sites than the cap within one cell of the finest grid: blocks find the pairs and regions that one group would."""
    rng = random.Random(31)
    pts = [(i, 170.0 + rng.random() * 4e-4, -40.0 + rng.random() * 4e-4) for i in range(260)] + [(900, 171.0, -41.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if float(nearby.metres(a[1], a[2], b[1], b[2])) <= 15}
    rows = [(r["left_id"], r["right_id"]) for r in nearby.near_pairs(df, "id", "x", "y", 15.0, cap=40).collect()]
    assert set(rows) == want and len(rows) == len(want) and nearby.partition(df.select(F.col("x").alias("lon"), F.col("y").alias("lat")), 40).blocks.max() > 2
    square = [[(170.0, -40.0), (170.0002, -40.0), (170.0002, -39.9997), (170.0, -39.9997), (170.0, -40.0)]]
    region = spark.createDataFrame([(5, [[{"x": x, "y": y} for x, y in r] for r in square])], "rid int, rings array<array<struct<x:double,y:double>>>")
    got = [r["id"] for r in nearby.regions_of(df, "id", "x", "y", region, "rid", "rings", cap=40).collect()]
    assert sorted(got) == sorted(i for i, x, y in pts if 170.0 <= x <= 170.0002 and -40.0 <= y <= -39.9997)


def test_sites_and_links_hold_all_pairs(spark):
    rng = random.Random(32)
    spots = [(170.0 + rng.random() * 2e-3, -40.0 + rng.random() * 2e-3) for _ in range(30)]
    df = spark.createDataFrame([(i, *rng.choice(spots)) for i in range(200)] + [(500, None, -40.0)], "id long, x double, y double")
    members, links = nearby.near_site_counts(df, "id", "x", "y", 40.0)
    at = {}
    for r in members.collect():
        at.setdefault(r["site"], []).append(r["id"])
    pairs = {tuple(sorted(p)) for own in at.values() for p in itertools.combinations(own, 2)}
    for r in links.collect():
        assert (r["points_a"], r["points_b"]) == (len(at[r["site_a"]]), len(at[r["site_b"]]))
        pairs |= {tuple(sorted(p)) for p in itertools.product(at[r["site_a"]], at[r["site_b"]])}
    assert pairs == {(r["left_id"], r["right_id"]) for r in nearby.near_pairs(df, "id", "x", "y", 40.0).collect()}


def test_ring_that_crosses_itself(spark):
    """Points on the fan's diagonals are judged by the ring's parity."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (1.0, -1.0), (0.0, 0.0)]
    region = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], "rid int, rings array<array<struct<x:double,y:double>>>")
    pts = [(0, 3.0, 3.0), (1, 2.0, 2.0), (2, 0.25, 3.5), (3, 5.0, 1.0), (4, 0.1, 2.0), (5, 2.0, 1.0)]

    def odd(x, y):
        n = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return n % 2 == 1

    got = {r["id"] for r in nearby.regions_of(spark.createDataFrame(pts, "id long, x double, y double"), "id", "x", "y", region, "rid", "rings").collect()}
    assert 0 in got and got == {i for i, x, y in pts if odd(x, y)}


def test_long_ring_is_clipped_quickly():
    import time

    ring = [((2 + math.sin(9 * a)) * math.cos(a), (2 + math.sin(9 * a)) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 4_000, endpoint=False)]
    began = time.process_time()
    tri = ear_clip(ring)
    took = time.process_time() - began
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    assert len(tri) == len(ring) - 2 and sum(abs((t[2] - t[0]) * (t[5] - t[1]) - (t[4] - t[0]) * (t[3] - t[1])) / 2 for t in tri) == pytest.approx(area) and took < 5


def test_orphans_without_parents_are_spread(spark):
    refs = spark.range(5_000).select((F.col("id") % 1_700).alias("k"), F.lit("2030-01").alias("p"))
    none = spark.createDataFrame([], "k long")
    df = orphans.orphans(refs, none, F.col("k"), None, F.col("p"), F.col("k"), per_range=50)
    assert df.count() == 1_700 and {r["kind"] for r in df.collect()} == {"missing"}
