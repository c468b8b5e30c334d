"""Nearest neighbours whose buckets hold too little, and probes beyond the first bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("marginalia.llm.crosspolytope")

from marginalia.llm import crosspolytope  # noqa: E402


def brute(x, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(5).standard_normal((600, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    # columns that the search uses for its own purposes
    for c in ("id", "v", "q", "t", "b", "part", "parts", "h", "g", "ids", "nth", "score", "rank", "query_id"):
        v = v.withColumn(c, F.lit("x"))
    return x.astype(float), v


def test_queries_with_poor_buckets_are_ranked_against_all_rows(table):
    x, v = table
    report = {}
    # buckets of two rows and a goal that one probe meets
    got = crosspolytope.nearest(v, bucket=2, tables=2, recall=0.01, cell=100, report=report).collect()
    assert report["short"] > 0
    near = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        near.setdefault(g.query_id, []).append(g.vec_id)
    assert sorted(near) == list(range(0, 600, 20)) and all(len(n) == 20 for n in near.values())
    exact = [q for q in near if near[q] == brute(x, q, 20)]
    assert len(exact) >= report["short"]


def test_probes_go_on_until_the_goal_is_met(table):
    x, v = table
    report = {}
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1).alias("asks"))
    # one table of 131,072 buckets for 600 rows: far more than the first bound of probes
    hashes = crosspolytope.Hashes(20, float(np.sqrt((x * x).sum(axis=1).max())), 1, 3, 16)
    probes = crosspolytope.fit_probes(rows, hashes, 20, 0.9, 10, report)
    assert hashes.buckets > 4096 and 4096 < probes <= hashes.buckets and report["fitted"] >= 0.9
