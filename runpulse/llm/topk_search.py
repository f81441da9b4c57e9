"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are split into ``lists`` of equal width; a candidate's partial inner product in each
is its local score there, and its score is their sum.

1. Every block of candidates ranks each list for itself and reports the best totals among the
   entries at the head of its lists. The k-th best of all reports is a safe cutoff: at least k
   candidates reach it.
2. The cutoff goes back to the blocks. A candidate that reaches it has at least one local score of
   cutoff / lists or more, so the blocks collect the entries above that uniform threshold.
3. The local scores still missing for the collected candidates are computed, and those that
   reach the cutoff are ranked.

Queries and candidates meet block by block: a cell holds ``QUERY_BLOCK`` queries and
``CANDIDATE_BLOCK`` candidates at most, and scores are held for ``SCORED_AT_ONCE`` queries at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpulse.llm.common import pick, store

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
SCORED_AT_ONCE = 256
LISTS = 2


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null, NaN or infinity."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "vector", lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best rows but those with its own id.

    ``vector`` holds integers; ``is_query`` is a condition on ``vec_id``. Score is the inner product, equal
    scores go to the smaller id, and fewer rows than ``k`` are all returned. Rows without an id or a
    vector take no part; a row that repeats an id with its vector counts once, and rows that
    share an id only are queries and candidates of their own. Shorter vectors count as if zeros followed.
    Scores are exact; beyond the range of a long they are cut to it, and then ranked.
    """
    clean = pick(vectors, vec_id, vector).toDF("vec_id", "v").where("vec_id is not null and v is not null").distinct()
    rows = store(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(is_query)
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = max(1, -(-rows.count() // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(each(query_blocks).alias("qb"), block(blocks).alias("cb"), F.col("vec_id").alias("cand_id"), F.col("v").alias("cand"))

    def asked(queries: DataFrame) -> DataFrame:
        return queries.select(block(query_blocks).alias("qb"), each(blocks).alias("cb"), "row", "vec_id", "v", "cutoff")

    def meet(queries: DataFrame, scan, schema: str) -> DataFrame:
        return asked(queries).groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(scan, schema)

    first = meet(queries.withColumn("cutoff", F.lit(None).cast("long")), _heads(k, lists), "row long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"))
    reached = first.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    cutoffs = reached.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("cutoff"))
    cutoffs = cutoffs.select("row", F.when(F.col("n") == k, F.col("cutoff")).alias("cutoff"))
    second = meet(queries.join(cutoffs, "row", "left"), _entries(k, lists), "row long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        second.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrices(queries: pa.Table, candidates: pa.Table, lists: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Both sides as matrices of a type in which all partial sums are exact, and the lists' dimensions."""
    widest = max(pc.max(pc.list_value_length(v)).as_py() or 0 for v in (queries["v"], candidates["cand"]))

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(vectors), widest), np.int64)
        lengths = pc.list_value_length(vectors).to_numpy()
        out[np.arange(widest) < lengths[:, None]] = pc.list_flatten(vectors).to_numpy()
        return out

    q, c = matrix(queries["v"]), matrix(candidates["cand"])
    most = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    bound = most(q) * most(c) * widest
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    edges = [widest * i // lists for i in range(lists + 1)]
    return q.astype(kind), c.astype(kind), [slice(a, b) for a, b in zip(edges, edges[1:])]


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.clip(scores, -(2**63), 2**63 - 1)
    return scores.astype(np.int64)


def _heads(k: int, lists: int):
    """Phase 1: the best totals of those that head a list of this block."""

    def scan(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, scores = [], []
        if queries.num_rows and candidates.num_rows:
            q, c, parts = _matrices(queries, candidates, lists)
            ids, own = candidates["cand_id"].to_numpy(), queries["vec_id"].to_numpy()
            numbers = queries["row"].to_numpy()
            take = min(k + 1, len(c))
            for at in range(0, len(q), SCORED_AT_ONCE):
                some = slice(at, at + SCORED_AT_ONCE)
                local = [q[some, p] @ c[:, p].T for p in parts]
                heads = [np.argpartition(-s, take - 1, axis=1)[:, :take] for s in local]
                seen = np.sort(np.concatenate(heads, axis=1), axis=1)
                fresh = np.diff(seen, axis=1, prepend=-1) > 0
                fresh &= ids[seen] != own[some][:, None]
                totals = sum(np.take_along_axis(s, seen, axis=1) for s in local)
                for number, score, ok in zip(numbers[some], totals, fresh):
                    found = np.sort(_longs(score[ok]))[::-1][:k]
                    rows.append(np.full(len(found), number))
                    scores.append(found)
        empty = np.zeros(0, np.int64)
        return pa.table({"row": np.concatenate([empty, *rows]), "score": np.concatenate([empty, *scores])})

    return scan


def _entries(k: int, lists: int):
    """Phases 2 and 3: entries above the uniform threshold, their missing scores, and the block's k best."""

    def scan(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = {name: [np.zeros(0, np.int64)] for name in ("row", "query_id", "vec_id", "score")}
        if queries.num_rows and candidates.num_rows:
            q, c, parts = _matrices(queries, candidates, lists)
            ids, own = candidates["cand_id"].to_numpy(), queries["vec_id"].to_numpy()
            numbers = queries["row"].to_numpy()
            low = -(2**63)  # no cutoff, or one that was cut to the range of a long
            cutoffs = np.array([low if x is None else x for x in queries["cutoff"].to_pylist()], np.int64)
            thresholds = -(-cutoffs // lists)
            for at in range(0, len(q), SCORED_AT_ONCE):
                some = slice(at, at + SCORED_AT_ONCE)
                local = [q[some, p] @ c[:, p].T for p in parts]
                all_of = cutoffs[some, None] == low
                above = [(s >= thresholds[some, None].astype(s.dtype)) | all_of for s in local]
                who, what = np.nonzero(np.logical_or.reduce(above))
                total = sum(_score(s, a, q[some, p], c[:, p], who, what) for s, a, p in zip(local, above, parts))
                total = _longs(total) if len(who) else np.zeros(0, np.int64)
                keep = (total >= cutoffs[some][who]) & (ids[what] != own[some][who])
                who, what, total = who[keep], what[keep], total[keep]
                order = np.lexsort((ids[what], ~total, who))
                who, what, total = who[order], what[order], total[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                who, what, total = who[place < k], what[place < k], total[place < k]
                for name, values in zip(found, (numbers[some][who], own[some][who], ids[what], total)):
                    found[name].append(values)
        return pa.table({name: np.concatenate(values) for name, values in found.items()})

    return scan


def _score(collected, above, q, c, who, what) -> np.ndarray:
    """One list's local scores of the collected pairs: as collected, or computed where they weren't."""
    scores = np.where(above[who, what], collected[who, what], 0)
    missing = np.flatnonzero(~above[who, what])
    for at in range(0, len(missing), 100_000):
        some = missing[at : at + 100_000]
        scores[some] = (q[who[some]] * c[what[some]]).sum(axis=1)
    return scores
