"""Search, fusion, reranking and assembly against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.stats import top_k
from marginalia.operators import ann, assembly, embedding, lexical, retrieval


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[200:300] = m[0]  # a group of copies holds a third of all rows
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5), m.astype(np.float32)


def _brute(m, q, k):
    m = m.astype(np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for qi in q:
        s = np.round(u @ u[qi], 9)
        for r, i in enumerate(np.lexsort((np.arange(len(m)), -s))[:k], 1):
            out.add((qi, int(i), r))
    return out


@pytest.mark.parametrize("broadcast_bytes", [retrieval.BROADCAST_BYTES, 0])
def test_dense_topk_both_ways(vectors, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 64)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    df, m = vectors
    q = df.filter("id < 7").select(F.col("id").alias("query_id"), "embedding")
    got = retrieval.dense_topk(df, q, 10, broadcast_bytes)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == _brute(m, range(7), 10)


def test_ann_with_all_cells_is_exact(vectors, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 32)
    df, m = vectors
    q = df.filter("id < 5").select(F.col("id").alias("query_id"), "embedding")
    index, centers = ann.build_index(df, cells=6)
    got = ann.ann_topk(index, centers, q, k=10, probes=len(centers))
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == _brute(m, range(5), 10)


def test_top_k_with_a_hot_group(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 3)).withColumn("v", F.col("id") % 97)
    got = top_k(df, ["g"], [F.desc("v"), F.asc("id")], 5, spread="id")
    rows = [r.asDict() for r in df.collect()]
    want = set()
    for g in {r["g"] for r in rows}:
        best = sorted((r for r in rows if r["g"] == g), key=lambda r: (-r["v"], r["id"]))[:5]
        want |= {(g, r["id"], n) for n, r in enumerate(best, 1)}
    assert {(r.g, r.id, r["rank"]) for r in got.collect()} == want


def test_hash_embed_is_unit_and_equals_sparse(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "B b b")], "id long, text string")
    dense = {r.id: np.array(r.v) for r in df.select("id", embedding.hash_embed(F.col("text"), 64, double=True).alias("v")).collect()}
    assert np.isclose(np.linalg.norm(dense[1]), 1) and not dense[2].any()
    for r in embedding.sparse_embed(df, "id", "text", 64).collect():
        assert np.isclose(dense[r.id][r.bucket], r.weight)
    assert np.count_nonzero(dense[3]) == 1


DOCS = [
    (1, "The cat sat on the mat while a dog barked"),
    (2, "Dogs and cats: the cat chased dogs across mats"),
    (3, "A sad cat is not a fat rat"),
    (4, "Fat cats ignore the rat"),
    (5, "state of the art pumps"),
]


@pytest.mark.parametrize(
    "question, ids",
    [
        ("cat dog", {1, 2}),
        ('"sad cat" or "fat rat"', {3}),
        ("cat -dog", {3, 4}),
        ("cat rat or pump", {3, 4, 5}),
        ('"the mat"', {1, 2}),
        ("unicorn cat", set()),
        ("the of", set()),
        ('"art pumps"', {5}),
        ("state-of-the-art", {5}),
    ],
)
def test_lexical_match(spark, question, ids):
    chunks = lexical.with_terms(spark.createDataFrame(DOCS, "id long, text string")).select("id", "terms")
    q = spark.createDataFrame([(0, question)], "query_id long, question string")
    assert {r.id for r in lexical.lexical_match(chunks, q).collect()} == ids


def _covers(terms, need):
    """Sum of 0.1 / (1 + noise) over minimal covers, by trying every interval."""
    pos = [i for i, t in enumerate(terms) if t in need]
    spans = [(a, b) for a in pos for b in pos if a <= b and need <= set(terms[a : b + 1])]
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in pos) - 1)) for a, b in minimal)


def test_cover_density(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "pump", "gear"], 25))) for i in range(20)]
    chunks = lexical.with_terms(spark.createDataFrame(rows, "id long, text string")).select("id", "terms")
    q = spark.createDataFrame([(0, "red pump gear")], "query_id long, question string")
    got = {r.id: r.rank_cd for r in lexical.cover_density_rank(lexical.lexical_match(chunks, q)).collect()}
    terms = {r.id: r.terms for r in chunks.collect()}
    need = {"red", "pump", "gear"}
    assert got.keys() == {i for i, t in terms.items() if need <= set(t)}
    for i, v in got.items():
        assert np.isclose(v, _covers(terms[i], need), atol=1e-8)


def test_rrf(spark):
    rows = [(1, "x", r, i) for r, i in enumerate("abc", 1)] + [(1, "y", r, i) for r, i in enumerate("cda", 1)]
    rows += [(2, "x", 1, "a"), (2, "y", 1, "a")]
    out = retrieval.rrf(spark.createDataFrame(rows, "query_id int, list_id string, rank int, item string")).collect()
    assert [r.item for r in sorted(out, key=lambda r: r.position) if r.query_id == 1] == ["a", "c", "b", "d"]
    assert np.isclose(next(r.score for r in out if r.query_id == 2), 2 / 61)


def test_rerank_and_fallback(spark):
    c = spark.createDataFrame(
        [(q, i, p, "fast pump", t) for q in (1, 2) for p, (i, t) in enumerate([(10, "slow"), (11, "a fast pump"), (12, "pump")], 1)],
        "query_id int, id long, position int, question string, text string",
    )
    top = retrieval.rerank_jaccard(c, 2).filter("query_id = 1").orderBy("n").collect()
    assert [r.id for r in top] == [11, 12]
    assert [r.id for r in retrieval.rerank_overlap(c, 3).filter("query_id = 1").orderBy("n").collect()] == [11, 12, 10]
    s = c.select("query_id", "id", F.col("position").cast("double").alias("rerank_score"), F.when(F.col("query_id") == 2, "timeout").alias("error"))
    got = {(r.query_id, r.n): (r.id, r.rerank_score) for r in retrieval.rerank_or_fallback(c, s, 2).collect()}
    assert got == {(1, 1): (12, 3.0), (1, 2): (11, 2.0), (2, 1): (10, None), (2, 2): (11, None)}


def test_last_user_message_and_sources(spark):
    parts = '[{"type":"text","text":"what"},{"type":"image"},{"type":"text","text":"now"}]'
    c = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "old"), (1, 2, "assistant", "a"), (1, 3, "user", parts), (1, 4, "user", ""), (2, 0, "system", "s")],
        "conv_id int, turn int, role string, text string",
    )
    got = {r.conv_id: (r.question, r.error) for r in assembly.last_user_message(c).collect()}
    assert got == {1: ("what now", None), 2: (None, "no user message")}
    cites = spark.createDataFrame([(1, 2, 7, "B"), (1, 1, 5, "A")], "query_id int, n int, chunk_id long, heading_path string")
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, question string")
    out = {r.query_id: r.sources for r in assembly.sources_block(cites, q).collect()}
    assert out == {1: "\n\n**Sources**\n[1] A (chunk 5)\n[2] B (chunk 7)", 2: ""}


def test_plain_words_hold_no_syntax(spark):
    chunks = spark.createDataFrame([(1, "red pump"), (2, "blue gear"), (3, "red pump, or blue gear; inlet-valve")], "id long, text string")
    text = 'Red pump OR "blue" -gear inlet valve or'
    q = spark.createDataFrame([(1, text)], "query_id long, question string")
    plain = q.withColumn("question", lexical.plain_words(F.col("question")))
    found = lexical.lexical_match(lexical.with_terms(chunks), plain)
    assert {r.id for r in found.collect()} == {3}
    rows = lexical.websearch_terms(plain).collect()
    assert {(r.alternative, r.clause, r.negated) for r in rows} == {(0, i, False) for i in range(6)}


def test_block_best_in_slices(monkeypatch):
    """Blocks larger than what meets at once, with copies across the slices."""
    monkeypatch.setattr(retrieval, "ROW_SLICE", 16)
    monkeypatch.setattr(retrieval, "QUERY_SLICE", 3)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 8))
    m[40:170] = m[0]
    ids = rng.permutation(200)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = retrieval._block_best(ids, u, ids, u, 7)
    assert got.groupby("query_id").size().eq(7).all()
    at = np.argsort(ids)
    want = {(q, i) for q, i, _ in _brute(m[at], range(200), 7)}
    assert set(zip(got["query_id"], got["id"])) == want


def test_a_question_meets_a_bin_once(vectors, monkeypatch):
    """Rows that the cells yield grow with the bins, not with the probed cells."""
    df, _ = vectors
    index, cells = ann.build_index(df, cells=40)
    seen = []
    monkeypatch.setattr(ann, "top_k", lambda found, *a, **kw: seen.append(found.count()) or top_k(found, *a, **kw))
    q = df.filter("id < 50").select(F.col("id").alias("query_id"), "embedding")
    for probes in (len(cells), len(cells) // 2):
        ann.ann_topk(index, cells, q, k=3, probes=probes)
    assert max(seen) <= 50 * 3 * 2


def test_pack_cells():
    b = ann.pack(np.array([3, 0, 4, 4, 25, 2, 9]), 10)
    assert (b.first.tolist(), b.parts.tolist(), b.number) == ([0, 0, 0, 1, 2, 5, 6], [1, 0, 1, 1, 3, 1, 1], 7)
    assert [x.tolist() for x in b.visited(np.array([[0, 2], [4, 6], [1, 3]]))] == [[0], [2, 3, 4, 6], [1]]


@pytest.fixture(scope="module")
def worded(sf, tmp_path_factory):
    """The documents beside benchmark texts that hold what a user's question would take as syntax, and their views in DuckDB."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("worded")
    docs = pq.read_table(f"{sf}/documents.parquet")
    pq.write_table(docs, folder / "documents.parquet")
    rows = sorted(docs.to_pylist(), key=lambda r: r["doc_id"])
    texts = []
    for i, r in enumerate([r for r in rows if r["text"] and len(r["text"].split()) > 12][:24]):
        w = re.findall(r"[^\W_]+", r["text"])[:9]
        texts.append([" or ".join(w), f"{w[0]} OR {w[1]} -{w[2]}", f'"{w[3]}" {w[2]}-{w[4]} or', f"or {w[5]} or or \"{w[1]}"][i % 4])
    pq.write_table(pa.table({"item_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), folder / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


@pytest.mark.parametrize(
    "name",
    ["build_prompts", "citation_markers", "citations", "cover_density_rank", "generate_answers", "rerank_jaccard", "rerank_model"]
    + ["lexical_match", "lexical_topk", "websearch_terms", "rerank_or_fallback", "rerank_overlap"],
)
def test_benchmark_texts_are_searched_as_the_sql_searches_them(spark, worded, tmp_path, name):
    import __spark_entry__ as entry

    folder, con = worded
    entry.queries()[name](spark, folder).write.parquet(str(tmp_path / "got"))
    want = con.sql(entry.oracle_sql()[name])
    got = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in want.columns)} FROM read_parquet('{tmp_path}/got/*.parquet')")
    missing, extra = len(want.except_(got).fetchall()), len(got.except_(want).fetchall())
    assert (missing, extra, len(got.fetchall())) == (0, 0, len(want.fetchall()))
    assert len(want.fetchall()) >= 8


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """Few documents beside questions that share a word with fewer than a list holds, or have no text, and their views in DuckDB."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("sparse")
    texts = ["red pump", "blue gear with a pump", "İstanbul istanbul", "ISTANBUL pump", "ΑΣ ΟΔΥΣΣΕΥΣ", "valve", None, ""]
    texts += [f"filler{i} line{i} about nothing{i}" for i in range(40)]
    docs = {"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["src1"] * len(texts)}
    docs["n_chars"] = [len(t or "") for t in texts]
    pq.write_table(pa.table(docs), folder / "documents.parquet")
    asked = ["pump", "red pump", "valve gear", None, "istanbul", "İstanbul", "οδυσσευΣ ασ", "ΑΣ", "filler3", "nowhere"]
    pq.write_table(pa.table({"item_id": pa.array(range(len(asked)), pa.int64()), "text": asked}), folder / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


def _differences(spark, folder, con, name, out):
    """Rows of a query that its SQL lacks, rows of its SQL that it lacks, and all rows."""
    import __spark_entry__ as entry

    entry.queries()[name](spark, folder).write.parquet(f"{out}/got")
    cols = ", ".join(f'"{c}"' for c in con.sql(entry.oracle_sql()[name]).columns)
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {entry.oracle_sql()[name]}")
    con.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {cols} FROM read_parquet('{out}/got/*.parquet')")
    count = lambda q: con.execute(f"SELECT count(*) FROM ({q})").fetchone()[0]
    return count("FROM want EXCEPT ALL FROM got"), count("FROM got EXCEPT ALL FROM want"), count("FROM got")


@pytest.mark.parametrize("name", ["rerank_jaccard", "rerank_model", "rerank_or_fallback", "rerank_overlap", "retrieve", "rrf"])
def test_only_rows_that_share_a_word_are_candidates(spark, sparse, tmp_path, name):
    missing, extra, n = _differences(spark, *sparse, name, tmp_path)
    assert (missing, extra) == (0, 0)
    assert n >= 8


@pytest.mark.parametrize(
    "name", ["build_prompts", "citation_markers", "citations", "cover_density_rank", "lexical_match", "lexical_topk", "websearch_terms"]
)
def test_characters_are_lowered_one_by_one(spark, sparse, tmp_path, name):
    missing, extra, n = _differences(spark, *sparse, name, tmp_path)
    assert (missing, extra) == (0, 0)
    assert n >= 8


def test_a_null_question_is_answered(spark, sparse, tmp_path):
    assert _differences(spark, *sparse, "generate_answers", tmp_path) == (0, 0, 10)
