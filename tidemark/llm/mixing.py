"""Mixing sources to target weights within a budget of tokens.

Weights run down a tree (domain, language, source); each node shares its budget among its children by weight, no
child getting more than it can give (its tokens times the allowed repeats), and what one cannot give goes to its
siblings before the node above hears of it. Each leaf then reads its documents in a seeded order, epoch after epoch, and
takes what fits its budget, stepping over documents longer than the rest. What is then left of a leaf's budget goes to the next leaf of its
source; what a whole source leaves over is a shortage, which runs through the tree again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed

#: A leaf's order is cut into 2 ** bits ranges, at least so many bits, and more where a range would hold over 4,096 documents.
RANGE_BITS, RANGE_DOCS = 12, 4_096
#: Documents behind the cut of a leaf that are tried for what is left of its budget.
AHEAD = 1_000
PATH = ["domain", "language", "source"]


def share_out(budget: float, weights: list[float], limits: list[float]) -> list[float]:
    """The budget by weight under limits; what a limit cuts off goes to the others by weight, to the weightless last."""
    got = [0.0] * len(weights)
    for open_by in (lambda i: weights[i] > 0, lambda i: weights[i] <= 0):
        free = {i for i in range(len(weights)) if open_by(i) and limits[i] > 0}
        while free and budget - sum(got) > 1e-9:
            rest = budget - sum(got)
            total = sum(weights[i] for i in free)
            part = {i: rest * (weights[i] / total if total > 0 else limits[i] / sum(limits[j] for j in free)) for i in free}
            full = {i for i in free if got[i] + part[i] >= limits[i]}
            for i in full or free:
                got[i] = limits[i] if i in full else got[i] + part[i]
            free -= full
            if not full:
                break
    return got


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], total: float) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf (path, weight, limit), from the root downwards."""
    def below(rows: list, depth: int, budget: float) -> dict[tuple[str, ...], float]:
        if depth == len(rows[0][0]):
            return {rows[0][0]: min(budget, rows[0][2])}
        kids: dict[str, list] = {}
        for r in rows:
            kids.setdefault(r[0][depth], []).append(r)
        names = sorted(kids)
        parts = share_out(budget, [sum(r[1] for r in kids[n]) for n in names], [sum(r[2] for r in kids[n]) for n in names])
        out: dict[tuple[str, ...], float] = {}
        for n, b in zip(names, parts):
            out |= below(kids[n], depth + 1, b)
        return out

    return below(leaves, 0, total) if leaves else {}


def first_fit(tokens: np.ndarray, room: float) -> np.ndarray:
    """Which documents are taken in their order if each one that still fits is taken."""
    took, at = np.zeros(len(tokens), dtype=bool), 0
    while at < len(tokens):
        # the run that fits, then on from the next document that fits what is left
        run = int(np.searchsorted(np.cumsum(tokens[at:]), room, side="right"))
        took[at : at + run] = True
        room -= float(tokens[at : at + run].sum())
        small = np.flatnonzero(tokens[at + run :] <= room)
        if not len(small):
            break
        at += run + int(small[0])
    return took


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents taken at the cuts of one source's leaves.

    What a leaf can't use goes to the next one, the last having most to give, and then once more to all that have a document which
    fits; in the end one more document is taken if that comes closer to the source's budget.
    """
    rows = pdf.sort_values(["turn", "domain", "language", "place", "key"], kind="stable")
    tokens, took, carry = rows["tokens"].to_numpy(np.int64), np.zeros(len(rows), dtype=bool), 0.0
    leaf = rows.groupby("turn").ngroup().to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]))
    rooms = rows["room"].to_numpy(float)
    for a, b in spans:
        room = rooms[a] + carry
        took[a:b] = first_fit(tokens[a:b], room)
        carry = room - float(tokens[a:b][took[a:b]].sum())
    for a, b in reversed(spans):
        free = np.flatnonzero(~took[a:b]) + a
        more = free[first_fit(tokens[free], carry)]
        took[more] = True
        carry -= float(tokens[more].sum())
    off = np.where(took, np.inf, np.abs(tokens - carry))
    if len(off) and off.min() < carry:
        took[off.argmin()] = True
    return rows.assign(more=took.astype(np.int32))[["key", *PATH, "tokens", "full", "more"]]


def draw(docs: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, share_of_all: float | None = None, seed: int = 11) -> tuple[DataFrame, list[tuple]]:
    """(the rows of mix(), the leaves as (domain, language, source, the source's tokens in the first plan, limit, budget, tokens reached))."""
    spark = docs.sparkSession
    rows = docs.select("key", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in PATH[:2]], "source", F.col("tokens").cast("long").alias("tokens")).where(F.col("source").isin(list(targets)) & (F.col("tokens") > 0) & F.col("key").isNotNull())
    rows = checkpointed(rows)
    held = {tuple(r[:3]): (r[3], r[4]) for r in rows.groupBy(*PATH).agg(F.sum("tokens"), F.count("*")).collect()}
    if not held:
        return rows.select("key", *PATH, "tokens", F.lit(0).alias("copies")), []
    by_source: dict[str, int] = {}
    for p, (n, _) in held.items():
        by_source[p[2]] = by_source.get(p[2], 0) + n
    usual = min(n / sum(k for p, (_, k) in held.items() if p[2] == s) for s, n in by_source.items())
    size = total if total is not None else (share_of_all or 0.0) * sum(by_source.values())
    weight = {p: targets[p[2]][0] * n / by_source[p[2]] for p, (n, _) in held.items()}
    limit = {p: float(n * targets[p[2]][1]) for p, (n, _) in held.items()}
    bits = min(20, max(RANGE_BITS, int(np.ceil(np.log2(max(1, max(k for _, k in held.values()) / RANGE_DOCS))))))
    # an order for each leaf, the same whatever its budget, so that a larger budget reads on where a smaller one ended
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), *PATH, "key")).withColumn("range", F.shiftrightunsigned("place", 64 - bits))
    wish: dict[str, float] = {}
    sums = checkpointed(rows.groupBy(*PATH, "range").agg(F.sum("tokens").alias("own"), F.count("*").alias("docs")))
    most = {p: targets[p[2]][1] for p in held}
    closed: dict[tuple, float] = {}
    while True:
        plan = budgets([(p, weight[p], closed.get(p, limit[p])) for p in held], size)
        wish = wish or {s: sum(plan[p] for p in held if p[2] == s) for s in by_source}
        turn = sorted(held, key=lambda p: (limit[p] - plan[p], p))
        # as many rows as the tree has leaves
        cut = [(*p, int((plan[p] + 1e-6) // held[p][0]), float(plan[p] - held[p][0] * int((plan[p] + 1e-6) // held[p][0])), turn.index(p)) for p in held]
        unspent = [c for c in cut if c[3] < most[tuple(c[:3])]]
        plan_df = F.broadcast(spark.createDataFrame(unspent, "domain string, language string, source string, full int, rest double, turn int"))
        w = Window.partitionBy(*PATH).orderBy("range")
        line = sums.join(plan_df, PATH).withColumns({"before": F.sum("own").over(w) - F.col("own"), "docs_before": F.sum("docs").over(w) - F.col("docs")})
        line = line.withColumn("behind", F.col("before") + F.col("own") > F.col("rest"))
        start = F.min(F.when(F.col("behind"), F.struct("range", "before", "docs_before"))).over(Window.partitionBy(*PATH)).alias("s")
        edge = line.select(*PATH, "range", "docs_before", "full", "rest", "turn", "behind", start).where(f"behind and docs_before - s.docs_before < {AHEAD}")
        # a leaf's cut is at most AHEAD documents and a range long: a few ranges of each leaf
        edge = checkpointed(edge.select(*PATH, "range", "full", "turn", (F.col("rest") - F.col("s.before")).alias("room"), F.col("s.range").alias("first_edge")))
        near = rows.join(F.broadcast(edge), [*PATH, "range"])
        kind = dict(rows.dtypes)["key"]
        filled = checkpointed(near.select("key", *PATH, "tokens", "place", "full", "turn", "room").groupBy("source").applyInPandas(_fill, f"key {kind}, domain string, language string, source string, tokens long, full int, more int"))
        got = {tuple(r[:3]): (r[3], r[4]) for r in filled.groupBy(*PATH).agg(F.sum(F.col("more") * F.col("tokens")), F.count_if(F.col("more") == 0)).collect()}
        firsts = {tuple(r[:3]): (r[3], r[4]) for r in edge.groupBy(*PATH).agg(F.first("first_edge"), F.first("room")).collect()}
        reached = {}
        for *p, full, rest, _ in cut:
            p = tuple(p)
            # tokens of the ranges before the cut: rest - room
            reached[p] = held[p][0] * full + (rest - firsts[p][1] + got[p][0] if p in firsts else 0.0)
        again = False
        for s in by_source:
            own = [p for p in held if p[2] == s and p not in closed]
            short = sum(plan[p] - reached[p] for p in held if p[2] == s)
            if short <= usual or not own:
                continue
            again = True
            # leaves with documents left have none that fits; those read to the end may begin another epoch
            able = [p for p in own if p in got and not got[p][1] and reached[p] < limit[p]]
            closed |= {p: reached[p] for p in own if p not in able}
            spare = sum(limit[p] - reached[p] for p in able)
            for p in held:
                if p[2] == s:
                    weight[p] = (reached[p] + (short * (limit[p] - reached[p]) / spare if p in able else 0.0)) / size
        if not again:
            break
    first_df = F.broadcast(spark.createDataFrame([(*p, full, firsts[p][0] if p in firsts else None) for *path, full, _, _ in cut for p in [tuple(path)]], "domain string, language string, source string, full int, first_edge long"))
    last_edge = F.broadcast(edge.select(*PATH, "range").withColumn("at_edge", F.lit(True)))
    rest_rows = rows.join(first_df, PATH).join(last_edge, [*PATH, "range"], "left").where("at_edge is null")
    outside = rest_rows.select("key", *PATH, "tokens", "full", F.coalesce((F.col("range") < F.col("first_edge")).cast("int"), F.lit(0)).alias("more"))
    out = outside.unionByName(filled).withColumn("copies", F.col("full") + F.col("more")).where("copies > 0")
    return out.select("key", *PATH, "tokens", F.col("copies").cast("int").alias("copies")), [(*p, wish[p[2]], limit[p], plan[p], float(reached[p])) for p in sorted(held)]


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, share_of_all: float | None = None, seed: int = 11) -> DataFrame:
    """(key, domain, language, source, tokens, copies): the documents drawn and how often each is used.

    docs: key, domain, language, source, tokens. targets: source -> (share, most copies of a document). total is the size wanted
    in tokens, or share_of_all gives it as a share of all tokens of the sources that have a target. Documents whose source is
    null or has no target, or without tokens, are not drawn. A source's weight is split over its domains and
    languages by the tokens they hold. If all sources together cannot give the total, each gives what it can. A leaf's
    last epoch takes, in its order, every document that still fits, among those up to AHEAD documents behind the first that does not; its remainder
    goes to the source's next leaf, and the last leaf takes one more document if that comes closer. A source that ends short by more than
    a document of the mean length (of the source where that is least) gives the shortage to its leaves that may begin another epoch, and if there is none, holds at what
    it reached and leaves its shortage to the tree. Null domains or
    languages count as ''. The tree, with one node for each combination of domain, language and
    source, is the only thing the driver holds; leaves of any size are cut by sums over ranges of their
    order and only the documents near the cut are put in order.
    """
    return draw(docs, targets, total, share_of_all, seed)[0]


LEAVES = "domain string, language string, source string, source_plan double, most double, budget double, tokens double"


def leaf_report(docs: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, share_of_all: float | None = None, seed: int = 11) -> DataFrame:
    """(domain, language, source, source_plan, most, budget, tokens, short): what each leaf was to give, can give and gives; source_plan
    is the whole source's budget in the first plan, before any shortage was seen."""
    rows = draw(docs, targets, total, share_of_all, seed)[1]
    return docs.sparkSession.createDataFrame(rows, LEAVES).withColumn("short", F.col("budget") - F.col("tokens"))


def shares(drawn: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of each source with a target."""
    spark = drawn.sparkSession
    want = spark.createDataFrame([(s, float(w)) for s, (w, _) in targets.items()], "source string, target_share double") if targets else spark.createDataFrame([], "source string, target_share double")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    rows = want.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row for each source
    return rows.select("source", "target_share", F.round(F.try_divide("tokens", total), 6).alias("actual_share"), "tokens", "documents", "most_copies")
