"""Stored search indexes against the searches that read whole tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import ann, inverted, lexical, retrieval
from marginalia.plans import jobs
from marginalia.session import work_path

QUESTIONS = [
    "cat", "rat cat", '"state of the art"', '"cat sat" mat', "cat -dog", "cat or rat", "fat or dog -cat", '"rat fat"', "zebra cat",
    "the", "", "cat cat cat", "-cat", 'cat -"sad cat"', "w1 w2", "w1", '"w1 w2" or w3', "w0 w1 w2 -w3",
]


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(6)
    rows = [
        (1, "The cat sat on the mat while a dog barked"), (2, "Dogs and cats: the cat chased dogs across mats"),
        (3, "A sad cat is not a fat rat"), (4, "Fat cats ignore the rat"), (5, "state of the art pumps"), (6, ""), (7, None),
    ]
    words = [f"w{i}" for i in range(8)] + ["of", "cat"]
    rows += [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(10, 120)]
    return rows


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, question string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def plain(spark, rows, asked):
    found = lexical.lexical_match(lexical.with_terms(frame(spark, rows)).select("id", "terms"), asked)
    return {(r.query_id, r.id): r.rank_cd for r in lexical.cover_density_rank(found).collect()}


def first(ranks, k):
    out = set()
    for q in {q for q, _ in ranks}:
        best = sorted(((-v, i) for (p, i), v in ranks.items() if p == q))[:k]
        out |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    return out


def same(got, want):
    got = {(r.query_id, r.id): r.rank_cd for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_index_answers_like_a_scan(spark, chunks, asked):
    index = inverted.build(frame(spark, chunks), work_path(spark, "index"), buckets=4)
    want = plain(spark, chunks, asked)
    assert len(want) > 150
    same(inverted.match(index, asked), want)
    for k in (3, 50):  # bounds leave candidates out at 3
        got = inverted.topk(inverted.open_index(spark, index.path), asked, k)
        assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == first(want, k)
    assert inverted.topk(index, asked.limit(0)).count() == 0


def test_updates_and_compaction(spark, chunks, asked):
    index = inverted.build(frame(spark, chunks), work_path(spark, "index"), buckets=4)
    changed = [(i, "fat " + (t or "")) for i, t in chunks if i % 4 == 0]
    new = [(500, "a cat and a rat"), (501, None)]
    gone = {i for i, _ in chunks if i % 7 == 0}
    index = inverted.update(index, frame(spark, changed + new), spark.createDataFrame([(i,) for i, _ in changed] + [(i,) for i in gone], "id long"))
    now = {**dict(chunks), **dict(new)}
    now = {i: t for i, t in now.items() if i not in gone} | dict(changed)
    want = plain(spark, list(now.items()), asked)
    same(inverted.match(index, asked), want)
    # a chunk that went may come back
    index = inverted.update(index, frame(spark, [(7, "cat")]))
    now[7] = "cat"
    want = plain(spark, list(now.items()), asked)
    same(inverted.match(inverted.open_index(spark, index.path), asked), want)
    whole = inverted.compact(spark, index, work_path(spark, "index"))
    assert len(whole.generations) == 1
    same(inverted.match(whole, asked), want)


def test_an_unfinished_generation_is_not_seen(spark, chunks, asked):
    index = inverted.build(frame(spark, chunks), work_path(spark, "index"), buckets=4)
    before = {tuple(r) for r in inverted.match(index, asked).collect()}
    frame(spark, [(900, "cat")]).write.parquet(index.at(1, "postings"))  # a job that died before its commit
    assert {tuple(r) for r in inverted.match(inverted.open_index(spark, index.path), asked).collect()} == before


def test_only_buckets_of_the_terms_are_read(spark, chunks):
    index = inverted.build(frame(spark, chunks), work_path(spark, "index"), buckets=16)
    one = spark.createDataFrame([(1, "cat")], "query_id long, question string")
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in inverted._ask(index, one).postings.inputFiles() if "bucket=" in f}
    plan = inverted._ask(index, one).postings._jdf.queryExecution().executedPlan().toString()
    assert len(files) > 4 and "PartitionFilters: [isnotnull(bucket" in plan


# --- vectors by cell


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 12)) + 4 * r.normal(size=(12, 12))[r.integers(0, 12, 1500)]
    x[900:1500] = x[3]  # copies: over a third of all rows
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)


def test_cells_of_a_table(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 100)
    q = vectors.where("id < 60").select(F.col("id").alias("query_id"), "embedding")
    exact = retrieval.dense_topk(vectors, q, 10)
    rows, cells = ann.build_index(vectors, cells=25, path=work_path(spark, "cells"))
    assert rows.count() == 1500 and {r.cell for r in rows.select("cell").distinct().collect()} <= set(range(len(cells)))
    every = ann.ann_topk(rows, cells, q, 10, probes=len(cells))
    keys = ["query_id", "id", "rank"]
    assert {tuple(r) for r in every.select(keys).collect()} == {tuple(r) for r in exact.select(keys).collect()}
    assert ann.ann_recall(ann.ann_topk(rows, cells, q, 10), exact).first().recall >= 0.95
    assert ann.fit_probes(rows, cells, q, 10, recall=1.0) <= len(cells)
    path = work_path(spark, "centers")
    ann.save_cells(spark, cells, path)
    again = ann.load_cells(spark, path)
    assert (again.fine == cells.fine).all() and (again.coarse == cells.coarse).all() and (again.start == cells.start).all()


def test_cells_of_little(spark, vectors):
    q = vectors.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    rows, cells = ann.build_index(vectors.where("id = 2"))
    assert [(r.query_id, r.id) for r in ann.ann_topk(rows, cells, q, 5).orderBy("query_id").collect()] == [(0, 2), (1, 2), (2, 2)]
    rows, cells = ann.build_index(vectors.where("id < 0"))
    assert ann.ann_topk(rows, cells, q, 5).count() == 0


def test_answers_from_stored_indexes(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)), "h", f"c{i}") for i in range(80)]
    from marginalia.operators.embedding import hash_embed

    chunks = spark.createDataFrame(rows, "id long, text string, heading_path string, content_hash string")
    chunks = chunks.withColumn("embedding", hash_embed(F.col("text"), 64, double=True))
    asks = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w4 w5")], "query_id long, question string")
    embed = lambda c: hash_embed(c, 64, double=True)
    path = work_path(spark, "search")
    jobs.index_chunks(chunks.where("id < 60"), path)
    search = jobs.open_search(spark, path)
    late = chunks.where("id >= 60 or id = 5")
    search = jobs.update_search(search, late, late.select("id"), work_path(spark, "search"))
    keys = ["query_id", "id", "position", "dense_rank", "lexical_rank"]
    want = sorted(map(str, jobs.answer_questions(chunks, asks, embed).fused.select(keys).collect()))
    got = jobs.answer_questions(chunks, asks, embed, search=search).fused.select(keys).collect()
    near = jobs.answer_questions(chunks, asks, embed, mode="approximate", search=search, recall=1.0).fused.select(keys).collect()
    assert len(want) > 20 and sorted(map(str, got)) == want and sorted(map(str, near)) == want


def test_metrics_of_dense_search_build_no_index(spark, sf, monkeypatch):
    from marginalia.plans import queries_evaluation as qe
    from marginalia.plans import queries_search as qs

    def refuse(*_):
        raise AssertionError("an index of terms is built")

    monkeypatch.setattr(qs, "search_index", refuse)
    assert qe.dense_ranked(spark, sf, 3).count() == 3 * qs.questions(spark, sf).count()


def test_ablation_builds_no_index(spark, sf, monkeypatch):
    """Its two lexical searches are one pass over the terms, its vectors stay in the tasks that make them."""
    from marginalia.operators import lexical
    from marginalia.plans import queries_evaluation as qe
    from marginalia.plans import queries_search as qs

    def refuse(*_):
        raise AssertionError("an index of terms is built")

    searched = []
    match = lexical.lexical_match
    monkeypatch.setattr(qs, "search_index", refuse)
    monkeypatch.setattr(lexical, "lexical_match", lambda *a, **kw: searched.append(a) or match(*a, **kw))
    rows = {(r.config, r.type) for r in qe.retrieval_ablation(spark, sf).collect()}
    assert {(c, None) for c in ("dense", "hybrid", "hybrid+rerank")} <= rows
    assert len(searched) == 1


def test_dense_search_by_a_model_in_the_task(spark):
    """Vectors made in the searching task give the rows of stored ones, scanned or in a grid; a null text has no words."""
    from marginalia.operators import embedding, retrieval

    docs = spark.createDataFrame(
        [(i, None if i == 4 else f"a{i % 7} b{i % 3} a{i % 5} c") for i in range(60)], "id long, text string"
    )
    stored = docs.select("id", embedding.hash_embed(F.col("text"), double=True).alias("embedding"))
    made = docs.select("id", embedding.word_buckets(F.col("text")).alias("embedding"))
    asked = stored.where("id < 5").withColumnRenamed("id", "query_id")
    want = sorted(retrieval.dense_topk(stored, asked, 8).collect())
    assert len(want) == 40
    for most in (retrieval.BROADCAST_BYTES, 0):
        got = retrieval.dense_topk(made, asked, 8, broadcast_bytes=most, model=embedding.bucket_counts)
        assert sorted(got.collect()) == want


def test_hashed_vectors_come_in_slices(spark, monkeypatch):
    from marginalia.operators import embedding

    monkeypatch.setattr(embedding, "EMBED_SLICE", 7)
    df = spark.range(40).coalesce(1).select("id", F.concat(F.lit("a a b "), F.col("id").cast("string")).alias("text"))
    got = {r.id: r.v for r in df.select("id", embedding.hash_embed(F.col("text"), 64, double=True).alias("v")).collect()}
    for r in embedding.sparse_embed(df, "id", "text", 64).collect():
        assert abs(got[r.id][r.bucket] - r.weight) < 1e-9


def test_an_index_runs_the_model_of_its_vectors_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(text):
        made.add(1)
        return None if text is None else [float(len(text)), 1.0]

    chunks = frame(spark, [(i, None if i == 3 else "cat " * i) for i in range(1, 41)]).withColumn("embedding", model("text"))
    index = inverted.build(chunks, work_path(spark, "index"), buckets=4)
    assert made.value == 40
    got = {r.id: r.embedding for r in inverted.vectors(spark, inverted.open_index(spark, index.path)).collect()}
    assert got == {i: [4.0 * i, 1.0] for i in range(1, 41) if i != 3}


def test_postings_of_slices(spark, monkeypatch):
    """A slice holds many chunks or a part of a batch; texts that are null, empty or all stop words have no postings."""
    monkeypatch.setattr(lexical, "POSTING_SLICE", 7)
    rows = [(1, "red pump red"), (1, "pump"), (2, None), (3, ""), (4, "the of"), (None, "gear"), (5, "gear " * 20 + "the pump")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = sorted((str(r.chunk_id), r.term, list(r.positions)) for r in lexical.build_postings(df).collect())
    assert got == [
        ("1", "pump", [1]), ("1", "pump", [2]), ("1", "red", [1, 3]), ("5", "gear", list(range(1, 21))), ("5", "pump", [22]),
        ("None", "gear", [1]),
    ]


def test_few_candidates_meet_documents_in_place(spark, sf):
    from marginalia.plans import queries_search as qs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")  # less than the documents
    try:
        plan = qs.candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_hashed_vectors_cut_at_every_white_space(spark, monkeypatch):
    from marginalia.functions import fixed_values as fv
    from marginalia.operators import embedding

    monkeypatch.setattr(embedding, "WORD_BYTES", 30)
    texts = [f"A{c}b{c}{c}Bé" for c in fv.WHITE_SPACE] + [None, "", " ", "İ Σς"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    made = df.select("id", embedding.hash_embed(F.col("text"), 64, double=True).alias("v"), embedding.word_buckets(F.col("text"), 64).alias("b"))
    for r in made.collect():
        want = np.bincount(r.b, minlength=64).astype(float) if r.b else np.zeros(64)
        assert np.allclose(r.v, want / (np.linalg.norm(want) or 1)), r.id
