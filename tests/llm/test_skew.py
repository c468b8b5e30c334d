"""Uneven weights and hot lines do not gather in one task; near pairs just above the threshold are found."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("marginalia.llm.mixing")

from marginalia.llm import lines, mixing, simhash  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)


def test_key_buckets_are_even_for_any_weights(spark):
    weight = F.when(F.col("id") % 10 == 0, 1e-6).when(F.col("id") % 10 == 1, 1e9).when(F.col("id") % 10 < 6, 1.0).otherwise(1.7)
    one = spark.range(20_000).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), weight.alias("q"))
    one = one.withColumn("key", -F.ln(mixing.draw(F.col("doc_id"))) / F.col("q"))
    one = one.join(mixing.weight_classes(one), F.col("source") == F.col("cs"))
    cut = one.select("key", F.least(F.floor(mixing.share_before(F.col("key"), F.col("classes")) * 20), F.lit(19)).alias("b"))
    per = cut.groupBy("b").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("b").collect()
    assert len(per) == 20 and max(r.n for r in per) < 1.5 * 1000
    assert all(a.hi <= b.lo for a, b in zip(per, per[1:]))


def test_mix_does_not_depend_on_buckets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 30), r.choice("ab")) for i in range(300)] + [(None, "x y", None), (7, None, "a")]
    odd = [1e-6, 1.0, 3e8, 0.0, -1.0, None, float("inf"), float("nan")]
    quality = spark.createDataFrame([(i, odd[i % 8]) for i in range(280)], "doc_id long, quality double")
    a, b = (sorted(map(str, mixing.mix(make(spark, rows), quality, bucket_rows=n).collect())) for n in (10, 1000))
    assert a == b and len(a) == len(rows)
    none = spark.createDataFrame([(i, 0.0) for i in range(300)], "doc_id long, quality double")
    assert mixing.mix(make(spark, rows), none, bucket_rows=10).where("taken > 0").count() > 0


def test_places_of_a_hot_line_stay_in_their_tasks(spark):
    rows = [(i, f"own {i}\nhot", f"s{i % 12}") for i in range(60)] + [(99, "z " * 300_000 + "\nhot", "s1"), (99, "z " * 300_000 + "\nhot", "s1")]
    out = lines.drop_boilerplate(make(spark, rows))
    got = {r.doc_id: (r.text, r.n_removed) for r in out.select("row.doc_id", "text", "n_removed").collect()}
    assert got[0] == ("own 0\nhot", 0) and got[5] == ("own 5", 1) and got[99][1] == 1 and len(got[99][0]) == 600_000
    assert "hashpartitioning(h1" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_above_the_threshold_are_found(spark):
    r = random.Random(8)
    rows, pairs = [], 0
    while pairs < 250:
        w = [f"w{r.randrange(50_000)}" for _ in range(r.choice([40, 120, 400]))]
        v = list(w)
        for i in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.018, 0.026)))):
            v[i] = f"x{r.randrange(50_000)}"
        a, b = (set(zip(*[x[i:] for i in range(5)])) for x in (w, v))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(w), "s"), (2 * pairs + 1, " ".join(v), "s")]
            pairs += 1
    rows += [(1000 + i, " ".join(f"n{r.randrange(50_000)}" for _ in range(80)), "s") for i in range(500)]
    kept = {x.doc_id for x in simhash.near_duplicates(make(spark, rows)).select("doc_id").collect()}
    assert {2 * i for i in range(250)} <= kept and set(range(1000, 1500)) <= kept
    assert sum(2 * i + 1 not in kept for i in range(250)) >= 0.97 * 250
