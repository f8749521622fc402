"""Comparing all candidates of a record at once: counts of agreement patterns in place of rows of pairs.

The candidates of a record grow with the other side, its patterns do not. A block of left records meets a block of right ones in
one task, which finds the candidates by sorted keys, compares names once for each different name of the right, and keeps, for each left
record and pattern, how many right records have it and the smallest of their ids. Nothing is left out: the counts add up to all candidate pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions

#: Records of the left and of the right in one task at most, of the left so that a task is worth its start; pairs, and counters of patterns, held at a time.
LEFT, RIGHT, SOME, AT_ONCE = 32_000, 250_000, 4_000, 500_000

#: The attributes in the order of their levels in a pattern's code, with their numbers of levels.
LEVELS = {"name": 5, "kind": 3, "district": 4, "sold": 3, "population": 3, "place": 4}
#: A pair has a level of sold or of population, never both: their seven cases (none, three, three) as part of an inner code.
_INNER = 6 * 4 * 5 * 7 * 5
_SOLD, _POPULATION = np.array([-1, 0, 1, 2, -1, -1, -1]), np.array([-1, -1, -1, -1, 0, 1, 2])

PATTERNS = "l long, w long, codes array<smallint>, counts array<long>, rs array<long>"


def codes_of(levels: list[np.ndarray], numbers: list[int]) -> np.ndarray:
    """One number for the levels of each row (-1: missing)."""
    code = 0
    for x, n in zip(levels, numbers):
        code = code * (n + 1) + (x + 1)
    return code


def levels_of(codes: np.ndarray, numbers: list[int]) -> np.ndarray:
    """The levels of each code, a column for each attribute."""
    out = []
    for n in reversed(numbers):
        out.append(codes % (n + 1) - 1)
        codes = codes // (n + 1)
    return np.stack(out[::-1], axis=1)


def _final_codes() -> np.ndarray:
    inner = np.arange(_INNER)
    rest, place = inner // 5, inner % 5
    rest, pop = rest // 7, rest % 7
    rest, district = rest // 5, rest % 5
    return codes_of([rest // 4 - 1, rest % 4 - 1, district - 1, _SOLD[pop], _POPULATION[pop], place - 1], list(LEVELS.values()))


#: Characters of a text that fit the bits of a word.
_WORD = 64


class Texts:
    """Different texts of the letters a to z and blanks; the first 64 characters as numbers 1 to 27 in rows padded with 0."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.texts, self.size = texts, np.array([len(t) for t in raw], dtype=np.int64)
        short = np.minimum(self.size, _WORD)
        self.chars = np.zeros((len(raw), max([1, *short])), dtype=np.uint8)
        flat = np.frombuffer(b"".join(t[:_WORD] for t in raw), dtype=np.uint8)
        at = _expand(np.arange(len(raw)) * self.chars.shape[1], short)
        self.chars.reshape(-1)[at] = np.where(flat == 32, 27, flat - 96)
        self.letters = np.sort(self.chars, axis=1)
        #: for each text and character the bits of its places
        self.masks = np.zeros((len(raw), 28), dtype=np.uint64)
        for j in range(self.chars.shape[1]):
            rows = np.flatnonzero(short > j)
            self.masks[rows, self.chars[rows, j]] |= np.uint64(1 << j)


def _one_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def _long(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """The pairs of which a text is longer than a word has bits; they are compared one by one."""
    return np.flatnonzero((a.size[i] > _WORD) | (b.size[j] > _WORD))


def distances(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """Edit distances of texts i of a and j of b, by Myers' bit vectors, one word a pair."""
    out = np.zeros(len(i), dtype=np.int64)
    order = np.argsort(-np.minimum(b.size[j], _WORD).astype(np.int8), kind="stable")  # longest first: those not at their end lead
    i, j = i[order], j[order]
    m, n, one = np.minimum(a.size[i], _WORD), np.minimum(b.size[j], _WORD), np.uint64(1)
    last = (np.maximum(m, 1) - 1).astype(np.uint64)
    score, pv, mv = m.copy(), np.full(len(i), ~np.uint64(0)), np.zeros(len(i), dtype=np.uint64)
    for at in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -at))  # those longer than at
        p, q = pv[:k], mv[:k]
        eq = a.masks[i[:k], b.chars[j[:k], at]]
        xv, xh = eq | q, (((eq & p) + p) ^ p) | eq
        ph, mh = q | ~(xh | p), p & xh
        score[:k] += ((ph >> last[:k]) & one).astype(np.int64) - ((mh >> last[:k]) & one).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        pv[:k], mv[:k] = mh | ~(xv | ph), ph & xv
    score = np.where(m == 0, n, score)
    for k in _long(a, i, b, j):
        score[k] = _one_distance(a.texts[i[k]], b.texts[j[k]])
    out[order] = score
    return out


def name_levels(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """linkage.name_level of texts i of a and j of b; -1 where one is missing (a negative number)."""
    out = np.full(len(i), -1, dtype=np.int64)
    known = np.flatnonzero((i >= 0) & (j >= 0))
    i, j = i[known], j[known]
    if not len(known):
        return out
    d = distances(a, i, b, j)
    level = np.where(d == 0, 4, np.where(d == 1, 3, np.where(d == 2, 2, np.where(d <= np.maximum(a.size[i], b.size[j]) * 0.25, 1, 0))))
    two = np.flatnonzero((d == 2) & (a.size[i] == b.size[j]))
    width = min(a.chars.shape[1], b.chars.shape[1])
    # sorted letters have their padding in front
    swapped = (a.letters[i[two], -width:] == b.letters[j[two], -width:]).all(axis=1)
    for k in _long(a, i[two], b, j[two]):
        swapped[k] = sorted(a.texts[i[two[k]]]) == sorted(b.texts[j[two[k]]])
    level[two[swapped]] = 3
    out[known] = level
    return out


def _district_levels(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """3 equal, 2 the right begins with the left or at most two slips, 1 at most four, 0 other."""
    d = distances(a, i, b, j)
    width = min(a.chars.shape[1], b.chars.shape[1])
    left, right = a.chars[i, :width], b.chars[j, :width]
    begins = (a.size[i] <= b.size[j]) & ((left == right) | (left == 0)).all(axis=1)
    for k in _long(a, i, b, j):
        begins[k] = b.texts[j[k]].startswith(a.texts[i[k]])
    return np.where(d == 0, 3, np.where(begins | (d <= 2), 2, np.where(d <= 4, 1, 0)))


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count numbers of each."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Index:
    """Rows by key."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.rows = rows[order]
        self.keys, self.start, self.count = np.unique(keys[order], return_index=True, return_counts=True)

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key and how many rows it has."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, np.where(self.keys[at] == keys, self.count[at], 0)

    def find(self, keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, row) for every row of every owner's key."""
        at, count = self.counts(keys)
        if not count.any():
            return owners[:0], self.rows[:0]
        return np.repeat(owners, count), self.rows[_expand(self.start[at], count)]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()  # null: NaN


def _texts(*columns: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """The different texts of all columns and each column as their numbers (-1: null)."""
    coded = pa.chunked_array([c for col in columns for c in col.chunks], type=pa.string()).combine_chunks().dictionary_encode()
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of every entry of a column of lists."""
    flat = column.combine_chunks()
    size = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), flat.flatten().to_numpy(zero_copy_only=False)


def _cell(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) * (1 << 20) + y.astype(np.int64)


def compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """PATTERNS of a block of left records with a block of right ones."""
    schema = pa.schema([("l", pa.int64()), ("w", pa.int64()), ("codes", pa.list_(pa.int16())), ("counts", pa.list_(pa.int64())), ("rs", pa.list_(pa.int64()))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    # the right, by name: a node is a different name, its records lie one after the other
    nodes, (node,) = _texts(right["name"])
    node = np.where(node < 0, len(nodes), node)  # the last node: no name, and so no keys of a name
    order = np.argsort(node, kind="stable")
    right, node = right.take(pa.array(order)), node[order]
    size = np.bincount(node, minlength=len(nodes) + 1)
    start = np.cumsum(size) - size
    some = start[size > 0]  # a record of each node
    first = np.zeros(len(size), dtype=np.int64)
    first[size > 0] = some
    kinds, (kind, l_kind, l_slug_kind) = _texts(right["kind"], left["kind"], left["slug_kind"])
    ordered, (r_name,) = _texts(right["ordered"])
    names, (l_name, l_slug) = _texts(left["ordered"], left["slug_ordered"])
    names, ordered = Texts(names), Texts(ordered)
    plain = kinds.index("") if "" in kinds else -2
    l_districts, (l_district,) = _texts(left["district"])
    r_districts, (r_district,) = _texts(right["district"])
    l_districts, r_districts = Texts(l_districts), Texts(r_districts)
    n_d = len(r_districts.texts) + 1  # the last: none
    r_district = np.where(r_district < 0, n_d - 1, r_district)
    r_id, r_n = right["r"].to_numpy(), right["n"].to_numpy().astype(float)
    several = bool((r_n != 1).any())
    r_log, r_lon, r_lat = (_numbers(right[c]) for c in ("population", "lon", "lat"))
    r_cos = np.cos(np.radians(r_lat)) * 111.19
    l_sold, l_pop, l_lon, l_lat = (_numbers(left[c]) for c in ("sold_population", "population", "lon", "lat"))
    sold = ~np.isnan(l_sold)
    l_near, l_exact, l_off = np.where(sold, 0.1, 0.15), np.where(sold, 1e-9, 0.03), np.where(sold, 1, 4)
    with np.errstate(all="ignore"):
        l_log, r_log = np.log(np.where(sold, l_sold, l_pop)), np.log(r_log)  # numbers below 0 say nothing

    # keys: of names lead to nodes, of places and populations to records
    at, key = _lists(right["name_keys"].take(pa.array(some)))
    by_name = _Index(key, node[some][at])
    at, key = _lists(right["keys"])
    by_key = _Index(key, at)
    placed = np.flatnonzero(~np.isnan(r_lon) & ~np.isnan(r_lat))
    corners = [(np.floor(r_lon[placed] * 20 + i), np.floor(r_lat[placed] * 20 + j)) for i in (0, 1) for j in (0, 1)]
    by_place = _Index(np.concatenate([_cell(*c) for c in corners]), np.tile(placed, 4))
    name_at, name_key = _lists(left["name_keys"])
    key_at, key = _lists(left["keys"])
    place_at = np.flatnonzero(~np.isnan(l_lon) & ~np.isnan(l_lat))
    place = _cell(np.floor(l_lon[place_at] * 20 + 0.5), np.floor(l_lat[place_at] * 20 + 0.5))

    # batches of left records, of about AT_ONCE pairs or counters
    held = np.zeros(len(by_name.keys) + 1)
    np.add.at(held, np.repeat(np.arange(len(by_name.keys)), by_name.count), size[by_name.rows])
    spot, there = by_name.counts(name_key)
    load = np.bincount(name_at, weights=np.where(there > 0, held[spot], 0), minlength=left.num_rows) + np.bincount(key_at, weights=by_key.counts(key)[1], minlength=left.num_rows)
    load += np.bincount(place_at, weights=by_place.counts(place)[1], minlength=left.num_rows) + _INNER + n_d
    batch = (np.cumsum(load) // AT_ONCE).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(batch)) + 1, [left.num_rows]])

    final, made = _final_codes(), []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = lambda at, keys: (keys[slice(*np.searchsorted(at, (lo, hi)))], at[slice(*np.searchsorted(at, (lo, hi)))] - lo)  # noqa: B023, E731
        n_nodes, n_r = len(size), len(node)
        o, v = by_name.find(*part(name_at, name_key))
        whole = np.unique(o * n_nodes + v)
        found = [index.find(*part(at, keys)) for index, at, keys in ((by_key, key_at, key), (by_place, place_at, place))]
        single = np.unique(np.concatenate([o * n_r + r for o, r in found]))
        so, sr = single // n_r, single % n_r
        # those that share a key of the name are in a whole node
        of = so * n_nodes + node[sr]
        seen = np.searchsorted(whole, of)
        keep = np.ones(len(of), dtype=bool) if not len(whole) else whole[np.minimum(seen, len(whole) - 1)] != of
        so, sr, of = so[keep], sr[keep], of[keep]
        others, of = np.unique(of, return_inverse=True)
        both = np.concatenate([whole, others])
        bo, bv = both // n_nodes + lo, both % n_nodes
        text = r_name[first[bv]]
        name = np.maximum(name_levels(names, l_name[bo], ordered, text), name_levels(names, l_slug[bo], ordered, text))
        k, a, b = kind[first[bv]], l_kind[bo], l_slug_kind[bo]
        same = (k >= 0) & ((a == k) | (b == k))
        alike = np.where(same, 2, np.where((a == plain) | (b == plain), 1, np.where((a >= 0) | (b >= 0), 0, -1)))
        base = (name + 1) * 4 + (alike + 1)
        # pairs: all records of the whole nodes, and single ones
        count = size[bv[: len(whole)]]
        r = np.concatenate([_expand(start[bv[: len(whole)]], count), sr])
        o = np.concatenate([np.repeat(bo[: len(whole)] - lo, count), so])
        if not len(r):
            continue
        code = np.concatenate([np.repeat(base[: len(whole)], count), base[len(whole) :][of]]) * 5
        # districts: each different one of the batch with each of the right
        mine, row = np.unique(l_district[lo:hi], return_inverse=True)
        table = np.zeros((len(mine), n_d), dtype=np.int64)
        known = np.flatnonzero(mine >= 0)
        if len(known) and n_d > 1:
            table[known, : n_d - 1] = 1 + _district_levels(l_districts, np.repeat(mine[known], n_d - 1), r_districts, np.tile(np.arange(n_d - 1), len(known))).reshape(len(known), -1)
        code = (code + table.reshape(-1)[row[o] * n_d + r_district[r]]) * 7
        ratio = np.abs(l_log[lo:hi][o] - r_log[r])
        code += (l_off[lo:hi][o] + (ratio < l_near[lo:hi][o]) + (ratio < l_exact[lo:hi][o])) * (ratio == ratio)  # noqa: PLR0124
        code *= 5
        dx, dy = (l_lon[lo:hi][o] - r_lon[r]) * r_cos[r], (l_lat[lo:hi][o] - r_lat[r]) * 111.19
        km2 = dx * dx + dy * dy
        near = np.flatnonzero(km2 < 144)
        code += km2 == km2  # noqa: PLR0124
        code[near] += 1 + (km2[near] < 16).astype(np.int64) + (km2[near] < 1.44)
        code += o * _INNER
        counts = np.bincount(code, weights=r_n[r] if several else None, minlength=(hi - lo) * _INNER)
        least = np.full(len(counts), np.iinfo(np.int64).max)
        np.minimum.at(least, code, r_id[r])
        full = np.flatnonzero(counts)
        owner, lengths = np.unique(full // _INNER, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (final[full % _INNER].astype(np.int16), counts[full].astype(np.int64), least[full])]
        made.append(pa.table([left["l"].take(pa.array(owner + lo)), left["w"].take(pa.array(owner + lo)), *lists], schema=schema))
    return pa.concat_tables(made) if made else schema.empty_table()


def patterns(left: DataFrame, right: DataFrame) -> DataFrame:
    """PATTERNS of every left record with every block of the right: codes of agreement, how many right records have each, the smallest of their ids.

    left: l, w (how many records it stands for), ordered, slug_ordered, kind, slug_kind, district, population, sold_population, lon, lat,
    name_keys, keys. right: r, n (records it stands for), name, ordered, kind, district, population, lon, lat, name_keys, keys.
    """
    lefts, blocks = left.count(), max(1, -(-right.count() // RIGHT))
    # as many parts as the session has partitions, if they have work to do
    parts = max(1, -(-lefts // LEFT), min(shuffle_partitions(left.sparkSession), -(-lefts // SOME)))
    # records of one name share a block, so that it is compared once; a name of very many records, or none, is dealt out
    hot = right.groupBy("name").agg(F.count("*").alias("c")).where(F.col("c") > RIGHT // 10).select(F.col("name").alias("hot"), F.ceil(F.col("c") / (RIGHT // 10)).alias("c"))
    dealt = right.join(F.broadcast(hot), F.col("name").eqNullSafe(F.col("hot")), "left")
    block = F.pmod(F.xxhash64("name", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("r"), "c"))), F.lit(blocks)).cast("int")
    ls = left.withColumn("part", F.pmod(F.xxhash64("l"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rs = dealt.withColumn("block", block).drop("hot", "c").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = parts * blocks
    # a partition for each cell: hashing would put several into one, and AQE, going by bytes, too
    placed = [df.withColumn("cell", F.col("part") * blocks + F.col("block")).drop("part", "block").repartitionById(cells, "cell") for df in (ls, rs)]
    return placed[0].groupBy("cell").cogroup(placed[1].groupBy("cell")).applyInArrow(compare, PATTERNS)


__all__ = ["LEVELS", "PATTERNS", "Texts", "codes_of", "compare", "distances", "levels_of", "name_levels", "patterns"]
