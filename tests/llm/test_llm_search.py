"""Exact top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from runpulse.llm import topk_search


def brute(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for q, a in rows:
        if q % 20 == 0:
            long = lambda s: max(-(2**63), min(2**63 - 1, s))
            scored = sorted((-long(sum(x * y for x, y in zip(a, b))), i) for i, b in rows if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, k, **how):
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    found = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k, **how)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("lists", [1, 3])
def test_search(spark, monkeypatch, lists):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 50)
    rng = random.Random(lists)
    rows = [(i, [rng.randint(-9, 9) for _ in range(7)]) for i in range(200)]
    rows += rows[:30] + [(i, [3] * 7) for i in range(300, 420)] + [(None, [1] * 7), (None, None), (500, None), (520, [])]
    rows += [(540, [9, 9]), (7, [1] * 7)]
    assert search(spark, rows, 5, lists=lists) == brute(rows, 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1, 2]), (20, [-1, 5]), (3, [0, 0])]
    assert search(spark, rows, 20) == brute(rows, 20)
    assert search(spark, [], 20) == []
    assert search(spark, [(1, [1])], 20) == []


@pytest.mark.parametrize("size", [2**14, 2**30, 2**40, 2**62])
def test_large_components(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.randint(-size, size) for _ in range(3)]) for i in range(40)]
    assert search(spark, rows, 4) == brute(rows, 4)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [i, 1], "a", "b", "c") for i in range(30)], "vec_id long, vector array<long>, v string, row string, s string")
    found = topk_search.top_k(df.toDF("vec_id", "vector", "VEC_ID", "score", "cand"), F.col("vec_id") % 20 == 0, 2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == brute([(i, [i, 1]) for i in range(30)], 2)


def test_quantized(spark):
    cases = [[0.5, -0.01], [1.0, None], [math.nan], [math.inf], [-math.inf], None, [], [0.99999, -1.0]]
    df = spark.createDataFrame([(c,) for c in cases], "v array<float>")
    got = [r[0] for r in df.select(topk_search.quantized(F.col("v"))).collect()]
    assert got == [[32, -1], None, None, None, None, None, [], [63, -64]]
