"""Points near other points, and the regions that contain points.

Locations are made distinct and counted in grid cells, and the cells rolled up to a tree: a node with more than
`cap` locations is split in four. Its leaves, with the true bounds of their points, form the upper bounding-volume
hierarchy; it is small by construction and goes to every executor. Locations travel to the leaf they lie in,
search discs and triangles to all leaves that they touch. Each leaf builds its own hierarchy and tests exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bvh import Bvh, crossed, ear_clip, fan, in_triangles
from tidemark.session import checkpointed

EARTH_M = 6_371_008.8
BASE = 18  # levels of the finest grid: cells of about 150 m
MAX_NODES = 16_384


def _cell(x: np.ndarray, lo: float, width: float) -> np.ndarray:
    return np.clip(np.floor((x - lo) / width * (1 << BASE)), 0, (1 << BASE) - 1).astype(np.int64)


@dataclass
class Partition:
    """The upper hierarchy: leaves as (level, ix, iy) with the bounds of their points and the number of blocks that their points are dealt to.

    A leaf has several blocks only where a cell of the finest level holds more than the cap.
    """

    level: np.ndarray
    ix: np.ndarray
    iy: np.ndarray
    bounds: np.ndarray
    blocks: np.ndarray

    def __post_init__(self):
        self.bvh = Bvh(self.bounds)
        code = (self.ix << (BASE - self.level)) << BASE | (self.iy << (BASE - self.level))
        self.by_level = {}
        for lv in np.unique(self.level):
            own = np.flatnonzero(self.level == lv)
            order = np.argsort(code[own])
            self.by_level[int(lv)] = (code[own][order], own[order])

    def home(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The leaf of each point, -1 if none."""
        cx, cy = _cell(lon, -180.0, 360.0), _cell(lat, -90.0, 180.0)
        out = np.full(len(lon), -1, dtype=np.int64)
        for lv, (codes, leaf) in self.by_level.items():
            s = BASE - lv
            c = (cx >> s << s) << BASE | (cy >> s << s)
            at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            ok = codes[at] == c
            out[ok] = leaf[at[ok]]
        return out


def _block(lon: np.ndarray, lat: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block for each place, by its bits."""
    mixed = (lon.view(np.int64) * np.int64(-7046029254386353131) ^ lat.view(np.int64)) * np.int64(-4417276706812531889)
    return (mixed >> 20 & 0x7FFFFFFF) % blocks


COARSE = 12  # levels that are counted for all points; finer ones only where a coarse cell holds too many


def _rolled(cells: DataFrame, base: int, top: int) -> DataFrame:
    """Counts and bounds of the nodes of levels top..base from the cells of level base."""
    up = lambda c: F.expr(f"shiftright({c}, {base} - level)")
    return (
        cells.withColumn("level", F.explode(F.sequence(F.lit(top), F.lit(base))))
        .groupBy("level", up("cx").alias("ix"), up("cy").alias("iy"))
        .agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    )


def partition(sites: DataFrame, cap: int = 6_000) -> Partition:
    """The upper hierarchy of sites (lon, lat).

    The driver gets the nodes with more than cap sites and their children: as cap grows with the rows, at most about
    4 x 18 x 16,384 of them.
    """
    side = 1 << BASE
    cell = lambda c, lo, width: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - lo) / width * side))).cast("long")
    placed = sites.select("lon", "lat", cell("lon", -180.0, 360.0).alias("cx"), cell("lat", -90.0, 180.0).alias("cy"))
    stats = (F.count("*").alias("n"), F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    shift = BASE - COARSE
    coarse = checkpointed(placed.groupBy(F.shiftright("cx", shift).alias("cx"), F.shiftright("cy", shift).alias("cy")).agg(*stats))
    total = coarse.agg(F.sum("n")).first()[0] or 0
    cap = max(cap, total // MAX_NODES)
    columns = ["level", "ix", "iy", "n", "x0", "y0", "x1", "y1"]

    def nodes_of(cells: DataFrame, base: int, top: int) -> pd.DataFrame:
        nodes = _rolled(cells, base, top)
        big = nodes.where((F.col("n") > cap) & (F.col("level") < base)).select((F.col("level") + 1).alias("level"), F.col("ix").alias("px"), F.col("iy").alias("py"))
        kids = nodes.withColumns({"px": F.expr("shiftright(ix, 1)"), "py": F.expr("shiftright(iy, 1)")}).join(big, ["level", "px", "py"])
        return kids.select(columns).unionByName(nodes.where(F.col("level") == top)).toPandas().astype({c: "int64" for c in columns[:4]})

    got = nodes_of(coarse, COARSE, 0)
    deep = got[(got["level"] == COARSE) & (got["n"] > cap)]
    leaves = [got[(got["n"] <= cap)]]
    if len(deep):
        # at most total / cap <= 16,384 cells
        crowded = F.broadcast(sites.sparkSession.createDataFrame(deep[["ix", "iy"]].rename(columns={"ix": "kx", "iy": "ky"}), "kx long, ky long"))
        fine = placed.withColumns({"kx": F.shiftright("cx", shift), "ky": F.shiftright("cy", shift)}).join(crowded, ["kx", "ky"], "left_semi").groupBy("cx", "cy").agg(*stats)
        below = nodes_of(checkpointed(fine), BASE, COARSE)
        leaves.append(below[(below["level"] > COARSE) & ((below["n"] <= cap) | (below["level"] == BASE))])
    got = pd.concat(leaves)
    return Partition(*(got[c].to_numpy(dtype=np.int64) for c in ("level", "ix", "iy")), got[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float), np.maximum(1, -(-got["n"].to_numpy(dtype=np.int64) // cap)))


def _spread(lon: np.ndarray, lat: np.ndarray, metres: float) -> np.ndarray:
    """Boxes that surely hold every point within the distance."""
    dy = np.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-12
    c = np.cos(np.radians(np.minimum(np.abs(lat) + dy, 90.0)))
    s = np.sin(metres / EARTH_M / 2)
    # the widest longitude difference at these latitudes
    dx = np.where(c > s, np.degrees(2 * np.arcsin(np.minimum(1.0, s / np.maximum(c, 1e-300)))), 360.0) * (1 + 1e-9) + 1e-12
    return np.stack([lon - dx, lat - dy, lon + dx, lat + dy], axis=1)


def metres(lon1, lat1, lon2, lat2):
    """Great-circle distance (haversine)."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def near_sites(sites: DataFrame, within_m: float, cap: int = 6_000) -> DataFrame:
    """(lon_a, lat_a, id_a, lon_b, lat_b, id_b, metres): pairs of distinct locations, a before b by lon and lat.

    sites: lon, lat and id, a long that is passed on.
    """
    tree = sites.sparkSession.sparkContext.broadcast(partition(sites, cap))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each site to its leaf, to be found and to ask, and to the other leaves that its disc touches, to ask; in a leaf of several blocks each pair of blocks meets once."""
        t = tree.value
        for pdf in batches:
            lon, lat = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
            home = t.home(lon, lat)
            q, leaf = t.bvh.query(_spread(lon, lat, within_m))
            away = leaf != home[q]
            row, to = np.concatenate([np.arange(len(lon)), q[away]]), np.concatenate([home, leaf[away]])
            at_home = np.arange(len(row)) < len(lon)
            n = t.blocks[to]
            own = _block(lon[row], lat[row], n)
            one, many = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
            found = many[at_home[many]]
            # to be found: in one row of the square of blocks; to ask: in one column
            f, a = np.repeat(found, n[found]), np.repeat(many, n[many])
            step = lambda x: np.arange(n[x].sum()) - np.repeat(np.cumsum(n[x]) - n[x], n[x])  # noqa: E731, B023
            part = np.concatenate([np.zeros(len(one), dtype=np.int64), own[f] * n[f] + step(found), step(many) * n[a] + own[a]])
            pick = np.concatenate([one, f, a])
            is_found = np.concatenate([at_home[one], np.ones(len(f), dtype=bool), np.zeros(len(a), dtype=bool)])
            asks = np.concatenate([np.ones(len(one), dtype=bool), np.zeros(len(f), dtype=bool), np.ones(len(a), dtype=bool)])
            r = row[pick]
            yield pd.DataFrame({"leaf": to[pick], "part": part, "home": is_found, "asks": asks, "lon": lon[r], "lat": lat[r], "id": pdf["id"].array.take(r)})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        own, pdf = pdf[pdf["home"]], pdf[pdf["asks"]]
        hx, hy = own["lon"].to_numpy(), own["lat"].to_numpy()
        bvh, out, hid, ids = Bvh(np.stack([hx, hy, hx, hy], axis=1)), [pd.DataFrame({"lon_a": [], "lat_a": [], "id_a": [], "lon_b": [], "lat_b": [], "id_b": [], "metres": []})], own["id"].array, pdf["id"].array
        x, y = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
        for a in range(0, len(x), 20_000):
            qx, qy, qid = x[a : a + 20_000], y[a : a + 20_000], ids[a : a + 20_000]
            q, i = bvh.query(_spread(qx, qy, within_m))
            first = (hx[i] < qx[q]) | (hx[i] == qx[q]) & (hy[i] < qy[q])
            q, i = q[first], i[first]
            d = metres(hx[i], hy[i], qx[q], qy[q])
            ok = d <= within_m
            out.append(pd.DataFrame({"lon_a": hx[i[ok]], "lat_a": hy[i[ok]], "id_a": hid.take(i[ok]), "lon_b": qx[q[ok]], "lat_b": qy[q[ok]], "id_b": qid.take(q[ok]), "metres": d[ok]}))
        return pd.concat(out[1:] or out)

    copies = sites.select("lon", "lat", "id").mapInPandas(spread, "leaf long, part long, home boolean, asks boolean, lon double, lat double, id long")
    return copies.groupBy("leaf", "part").applyInPandas(join, "lon_a double, lat_a double, id_a long, lon_b double, lat_b double, id_b long, metres double")


def _located(points: DataFrame, point_id: str, lon: str, lat: str) -> DataFrame:
    rows = points.select(F.col(point_id).alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    return rows.where("id is not null and lon between -180 and 180 and lat between -90 and 90").withColumns({"lon": F.col("lon") + 0.0, "lat": F.col("lat") + 0.0})


def near_site_counts(points: DataFrame, point_id: str, lon: str, lat: str, within_m: float, cap: int = 6_000) -> tuple[DataFrame, DataFrame]:
    """The form for sites that hold very many points: (sites, links), no pairs of points.

    sites: (site, id), a row for each point, its site being the smallest id there. links: (site_a, site_b, points_a, points_b, metres), a row for each pair of
    different sites within the distance. Points at one site are within it of each other; all pairs follow from both tables. Rows that
    near_pairs leaves out are left out here.
    """
    pts = checkpointed(_located(points, point_id, lon, lat).distinct())
    at = pts.groupBy("lon", "lat").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n"))
    at = checkpointed(at)
    members = pts.join(at.select("lon", "lat", F.col("id").alias("site")), ["lon", "lat"]).select("site", "id")
    far = near_sites(at.select("lon", "lat", "id"), within_m, cap)
    size = lambda x: at.select(F.col("lon").alias(f"lon_{x}"), F.col("lat").alias(f"lat_{x}"), F.col("n").alias(f"points_{x}"))
    links = far.join(size("a"), ["lon_a", "lat_a"]).join(size("b"), ["lon_b", "lat_b"])
    return members, links.select(F.col("id_a").alias("site_a"), F.col("id_b").alias("site_b"), "points_a", "points_b", "metres")


def near_pairs(points: DataFrame, point_id: str, lon: str, lat: str, within_m: float, cap: int = 6_000) -> DataFrame:
    """(left_id, right_id, metres): every pair of points at most within_m apart, the smaller id first.

    Ids are integers. Rows without id or with a location that is null, NaN or outside -180..180 / -90..90 have no neighbours; ids
    that occur with one location several times count once and an id is never paired with itself. Pairs across the
    180th meridian are not formed. Points that share a location are one site while sites are compared, so a site that holds a
    third of all rows is one row there; only sites with several points are joined with them afterwards, by equi-joins that
    AQE splits.
    """
    pts = checkpointed(_located(points, point_id, lon, lat))
    sites = checkpointed(pts.groupBy("lon", "lat").agg(F.when(F.min("id") == F.max("id"), F.min("id")).cast("long").alias("id")))
    far = near_sites(sites, within_m, cap)
    shared = sites.where("id is null").select("lon", "lat")
    crowd = checkpointed(pts.join(shared, ["lon", "lat"], "left_semi").distinct())
    far = checkpointed(far)
    member = lambda x: crowd.select(F.col("id").alias(f"m{x}"), F.col("lon").alias(f"lon_{x}"), F.col("lat").alias(f"lat_{x}"))
    some = far.where("id_a is null or id_b is null").select("*", *[F.col(f"id_{x}").alias(f"m{x}") for x in "ab"])
    for x in "ab":
        many = some.where(f"id_{x} is null").drop(f"m{x}").join(member(x), [f"lon_{x}", f"lat_{x}"])
        some = some.where(f"id_{x} is not null").unionByName(many)
    same = member("a").join(member("b").toDF("mb", "lon_a", "lat_a"), ["lon_a", "lat_a"]).where("ma < mb").select("ma", "mb", F.lit(0.0).alias("metres"))
    pairs = far.where("id_a is not null and id_b is not null").select(F.col("id_a").alias("ma"), F.col("id_b").alias("mb"), "metres").unionByName(some.select("ma", "mb", "metres")).where("ma <> mb").unionByName(same)
    # an id with several locations may meet another more than once
    return pairs.groupBy(F.least("ma", "mb").alias("left_id"), F.greatest("ma", "mb").alias("right_id")).agg(F.min("metres").alias("metres"))


TRI = "region long, ring int, simple boolean, ax double, ay double, bx double, by double, cx double, cy double"


def triangles(regions: DataFrame, region_id: str, rings: str) -> DataFrame:
    """The triangles of every ring, by ear clipping; of rings that cross themselves, a fan (simple = false)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for region, k, xs, ys in zip(pdf["region"], pdf["ring"], pdf["xs"], pdf["ys"]):
                pts = [(x, y) for x, y in zip(xs.tolist(), ys.tolist()) if x is not None and y is not None and x == x and y == y]
                tri = ear_clip(pts)
                out += [(region, k, tri is not None, *t) for t in (tri if tri is not None else fan(pts))]
            yield pd.DataFrame(out, columns=["region", "ring", "simple", "ax", "ay", "bx", "by", "cx", "cy"])

    rows = regions.select(F.col(region_id).cast("long").alias("region"), F.posexplode(rings).alias("ring", "pts")).where("region is not null and pts is not null")
    rows = rows.select("region", "ring", F.transform("pts", lambda p: p["x"].cast("double")).alias("xs"), F.transform("pts", lambda p: p["y"].cast("double")).alias("ys"))
    return rows.mapInPandas(cut, TRI)


def regions_of(points: DataFrame, point_id: str, lon: str, lat: str, regions: DataFrame, region_id: str, rings: str, cap: int = 6_000) -> DataFrame:
    """(id, region): the regions that contain each point: those in an odd number of whose rings it lies.

    A ring's border belongs to it; a point on the border of several regions is given to the one with the smallest
    id only. Points with a null, NaN or impossible location, regions without rings and rings of fewer than three corners
    match nothing. Region ids are integers, unique in regions.
    """
    pts = checkpointed(_located(points, point_id, lon, lat))
    sites = checkpointed(pts.select("lon", "lat").distinct())
    tree = sites.sparkSession.sparkContext.broadcast(partition(sites, cap))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
            leaf = tree.value.home(x, y)
            yield pdf.assign(leaf=leaf, part=_block(x, y, tree.value.blocks[leaf]))

    def hand_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf[["ax", "bx", "cx"]].to_numpy(), pdf[["ay", "by", "cy"]].to_numpy()
            q, leaf = tree.value.bvh.query(np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1) if len(pdf) else np.empty((0, 4)))
            n = tree.value.blocks[leaf]
            # a leaf's triangles go to all its blocks
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pdf.iloc[np.repeat(q, n)].assign(leaf=np.repeat(leaf, n), part=part)

    def test(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return pd.DataFrame({"lon": [], "lat": [], "region": []})
        tri = t[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy()
        x, y = p["lon"].to_numpy(), p["lat"].to_numpy()
        bvh = Bvh(np.stack([tri[:, 0::2].min(axis=1), tri[:, 1::2].min(axis=1), tri[:, 0::2].max(axis=1), tri[:, 1::2].max(axis=1)], axis=1))
        q, i = bvh.query(np.stack([x, y, x, y], axis=1))
        inside, border = in_triangles(tri[i], x[q], y[q])
        simple = t["simple"].to_numpy(dtype=bool)[i]
        # a ring that crosses itself is cut into a fan: parity, without its border
        inside[~simple], border[~simple] = crossed(tri[i][~simple], x[q][~simple], y[q][~simple]), False
        corner = ((tri[i][:, 0::2] == x[q][:, None]) & (tri[i][:, 1::2] == y[q][:, None])).any(axis=1)
        hit = pd.DataFrame({"p": q, "region": t["region"].to_numpy()[i], "ring": t["ring"].to_numpy()[i], "simple": simple, "border": border, "corner": corner})[inside]
        per = hit.groupby(["p", "region", "ring"], as_index=False).agg(n=("border", "size"), simple=("simple", "first"), border=("border", "all"), corner=("corner", "any"))
        # a side of a triangle that another one shares is inside the ring, unless at a corner
        per["border"] &= (per["n"] == 1) | per["corner"]
        per = per[per["simple"] | (per["n"] % 2 == 1)]
        per = per.groupby(["p", "region"], as_index=False).agg(n=("ring", "size"), border=("border", "any"))
        per = per[per["n"] % 2 == 1]
        shared = per["border"] & (per.groupby("p")["region"].transform("size") > 1)
        per = per[~shared | (per["region"] == per.groupby("p")["region"].transform("min"))]
        return pd.DataFrame({"lon": x[per["p"]], "lat": y[per["p"]], "region": per["region"]})

    homes = sites.mapInPandas(place, "lon double, lat double, leaf long, part long")
    parts = triangles(regions, region_id, rings).mapInPandas(hand_out, TRI + ", leaf long, part long")
    found = homes.groupBy("leaf", "part").cogroup(parts.groupBy("leaf", "part")).applyInPandas(test, "lon double, lat double, region long")
    return pts.join(found, ["lon", "lat"]).select("id", "region")
