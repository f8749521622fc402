"""Vector search: scope first, then exact scores in blocks, and its evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def top_k(queries: DataFrame, vectors: DataFrame, k: int, scoped: bool = True, vectors_a_part: int = 40_000, queries_a_part: int = 10_000) -> DataFrame:
    """(query_id, vec_id, score, scope, hit_scope, rank): the k vectors with the largest dot product for each query.

    queries: query_id, vector, scope; vectors: vec_id, vector, scope. With scoped, only vectors of the query's scope are
    ever scored (both sides meet by scope). Vectors and queries are split into blocks by hashed ids, as many as their numbers ask
    for; every query block meets every vector block of its scope once, so no task holds more than a block of either,
    however large a scope is. A vector is never its own hit; equal scores are ordered by id; null vectors and ids are left out.
    """
    q = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").alias("v"), F.col("scope").alias("s"))
    v = vectors.where("vec_id is not null and vector is not null").select("vec_id", F.col("vector").alias("v"), F.col("scope").alias("s"))
    v_parts = max(4, -(-vectors.count() // vectors_a_part))
    q_parts = max(1, -(-queries.count() // queries_a_part))
    group = F.coalesce(F.col("s").cast("string"), F.lit("")) if scoped else F.lit("")
    key = ["g", "part", "block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = q.withColumns({"g": group, "block": own("query_id", q_parts)}).withColumn("part", each(v_parts))
    v = v.withColumns({"g": group, "part": own("vec_id", v_parts)}).withColumn("block", each(q_parts))
    scope = dict(vectors.dtypes)["scope"]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, mat = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(np.float64)
            order = np.argsort(ids, kind="stable")
            ids, mat, scopes = ids[order], mat[order], b["s"].to_numpy()[order]
            for at in range(0, len(a), BLOCK):
                part = a.iloc[at : at + BLOCK]
                dots = np.stack(part["v"].to_numpy()).astype(np.float64) @ mat.T
                for row, (qid, qs) in zip(dots, zip(part["query_id"], part["s"])):
                    row[ids == qid] = -np.inf
                    best = np.argsort(-row, kind="stable")[:k]
                    out += [(qid, ids[j], row[j], qs, scopes[j]) for j in best if row[j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "scope", "hit_scope"])

    some = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(score, f"query_id long, vec_id long, score double, scope {scope}, hit_scope {scope}")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evaluate(hits: DataFrame, k: int) -> DataFrame:
    """(queries, recall_at_k, mrr, off_scope): a hit is right if it has the query's scope."""
    right = F.col("scope").eqNullSafe(F.col("hit_scope"))
    per = hits.groupBy("query_id").agg(F.min(F.when(right, F.col("rank"))).alias("first"), F.sum((~right).cast("int")).alias("off"))
    return per.agg(
        F.count("*").alias("queries"), F.round(F.count("first") / F.count("*"), 4).alias(f"recall_at_{k}"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.sum("off") / (k * F.count("*")), 4).alias("off_scope"),
    )


def in_scope(zones: str, excluded: str, zone) -> object:
    """Whether a clause applies in a zone: everywhere but the excluded if it names none, else only there."""
    return F.when(F.size(F.coalesce(F.col(zones), F.array())) == 0, ~F.coalesce(F.array_contains(excluded, zone), F.lit(False))).otherwise(F.array_contains(zones, zone))
