"""Dense search, rank fusion and reranking for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.functions.stats import top_k

# Query vectors are broadcast only below this many bytes; beyond it both sides are cut into blocks.
BROADCAST_BYTES = 64 * 1024 * 1024
QUERY_BLOCK = 2_048
ROW_BLOCK = 16_384
SIM_DIGITS = 9
# A block of vectors as doubles, blocks that a small table is cut into, and what meets at once inside a block.
BLOCK_BYTES = 32 * 1024 * 1024
SPREAD = 8
QUERY_SLICE = 256
ROW_SLICE = 4_096

# Turns what a batch of rows holds into a matrix, a row each.
Model = Callable[[pa.Array], np.ndarray]

_PART = "query_id long, id long, similarity double"
PART_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.vstack(column.to_numpy()).astype(np.float64))


def _chunk_best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, similarity) of the k best rows of ``x`` for each row of ``q``; ties go to the first rows.

    ``x`` comes in slices. The k-th best so far is a floor: what rounds to less is never gathered.
    """
    floor = np.full(len(q), -np.inf)
    rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    held = [(rows, cols, sims)]
    n = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, sims = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((cols, -sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = nth == k - 1
        floor[rows[last]] = sims[last]
        keep = nth < k
        return rows[keep], cols[keep], sims[keep]

    for j in range(0, len(x), ROW_SLICE):
        s = q @ x[j : j + ROW_SLICE].T
        if j == 0 and s.shape[1] > k:
            floor = np.round(np.partition(s, -k, axis=1)[:, -k], SIM_DIGITS)
        rows, cols = np.nonzero(~(s < floor[:, None] - 10.0**-SIM_DIGITS))
        held.append((rows, cols + j, np.round(s[rows, cols], SIM_DIGITS)))
        n += len(rows)
        if n > 4 * k * len(q):
            held = [best()]
            n = len(held[0][0])
    return best()


def _block_best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """k best rows (similarity desc, id asc) of one block of vectors for each query.

    QUERY_SLICE queries meet ROW_SLICE rows at once, so memory does not grow with the block. Ties with the k-th best are
    filled up in id order, so a block full of copies yields k rows too.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    out = []
    for i in range(0, len(qids), QUERY_SLICE):
        rows, cols, sims = _chunk_best(q[i : i + QUERY_SLICE], x, k)
        out.append(pd.DataFrame({"query_id": qids[i + rows], "id": ids[cols], "similarity": sims}))
    return pd.concat(out)


def block_table(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.Table:
    return pa.Table.from_pandas(_block_best(qids, q, ids, x, k), schema=PART_SCHEMA, preserve_index=False)


def blocks_of(n: int, width: int, small: int) -> int:
    """Blocks that ``n`` vectors are cut into: a block holds at most BLOCK_BYTES as doubles, and a smaller table is up to
    SPREAD blocks of ``small`` rows, so that its pairs keep many tasks busy."""
    most = max(small, BLOCK_BYTES // (8 * max(1, width)))
    return max(1, -(-n // most), min(SPREAD, -(-n // small)))


def rows_of(column: pa.ChunkedArray | pa.Array, model: Model | None = None) -> np.ndarray:
    """Vectors of one width as unit rows, a view on the Arrow buffer where there is one chunk; or what a model makes of the rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if model is not None:
        return _unit(model(flat))
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1))


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    df = pd.concat(parts).sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return df.groupby("query_id", sort=False).head(k)


def _scan_best(vectors: DataFrame, qids: np.ndarray, q: np.ndarray, k: int, model: Model | None = None) -> DataFrame:
    """One narrow pass: each task keeps k rows per query over all its batches."""
    shared = vectors.sparkSession.sparkContext.broadcast((qids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, mat = shared.value
        held: list[pd.DataFrame] = []
        for b in batches:
            if b.num_rows:
                # vectors of one table have one width: a view on the Arrow buffer is the matrix
                x, ids = b.column("embedding"), b.column("id").to_numpy(zero_copy_only=False)
                for i in range(0, len(ids), ROW_SLICE):
                    held.append(_block_best(ids_q, mat, ids[i : i + ROW_SLICE], rows_of(x.slice(i, ROW_SLICE), model), k))
                    if len(held) >= 8:
                        held = [_merge(held, k)]
        if held:
            yield pa.RecordBatch.from_pandas(_merge(held, k), preserve_index=False)

    return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, _PART)


def _grid_best(vectors: DataFrame, queries: DataFrame, n_q: int, k: int, model: Model | None = None) -> DataFrame:
    """Blocks of queries meet blocks of vectors; a block pair yields k rows per query, never all pairs.

    Both block numbers come from hashes of unique ids, so blocks are even whatever the data. The pairs grow with the
    product of both tables, what is shuffled with the number of blocks, and a task's memory with neither.
    """
    # rows that a model turns into vectors become as wide as the queries
    d = (queries if model else vectors).select(F.max(F.size("embedding"))).first()[0] or 0
    nq, nv = blocks_of(n_q, d, QUERY_BLOCK), blocks_of(vectors.count(), d, ROW_BLOCK)
    block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # renamed, so that both sides may come from one table
    qs = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"),
        F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), block(nv).alias("vb"),
    )
    vs = vectors.select(F.col("id").cast("long").alias("id"), "embedding", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"), block(nq).alias("qb"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return PART_SCHEMA.empty_table()
        return block_table(q["query_id"].to_numpy(), rows_of(q["asked"]), v["id"].to_numpy(), rows_of(v["embedding"], model), k)

    return qs.groupBy("qb", "vb").cogroup(vs.groupBy("qb", "vb")).applyInArrow(run, _PART)


def collect_queries(queries: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """Query vectors for a broadcast if they are proven small (row count times width), else None."""
    width = queries.select(F.max(F.size("embedding")).alias("d"), F.count("*").alias("n")).first()
    n, d = width["n"], width["d"] or 0
    if n == 0 or n > 2 * QUERY_BLOCK or n * d * 8 > limit:
        return None
    pdf = queries.select("query_id", "embedding").toPandas()
    return pdf["query_id"].to_numpy(), _matrix(pdf["embedding"])


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fv.PER_LIST,
    broadcast_bytes: int = BROADCAST_BYTES,
    model: Model | None = None,
) -> DataFrame:
    """Exact nearest rows under cosine: (query_id, id, similarity, rank).

    ``vectors`` (id, embedding), ``queries`` (query_id, embedding). With a ``model``, the column ``embedding`` of
    ``vectors`` holds what it turns into vectors, in the task that searches them: they are never stored. Similarities are rounded to nine
    digits before ranking and ties go to the smaller id, so results do not depend on partitioning.
    """
    vectors = vectors.filter(F.col("embedding").isNotNull())
    small = collect_queries(queries, broadcast_bytes)
    if small is not None:
        return top_k(_scan_best(vectors, *small, k, model), ["query_id"], [F.desc("similarity"), F.asc("id")], k, spread="id")
    # a query has k rows a block of vectors: one step ranks them
    parts = _grid_best(vectors, queries, queries.count(), k, model)
    return top_k(parts, ["query_id"], [F.desc("similarity"), F.asc("id")], k, spread="id", salts=1)


def dense_only(vectors: DataFrame, queries: DataFrame, top_n: int = fv.TOP_N) -> DataFrame:
    """Dense mode: the similarity is the score and there is no lexical rank."""
    return dense_topk(vectors, queries, top_n).select(
        "query_id",
        "id",
        F.col("similarity").alias("score"),
        F.col("rank").alias("dense_rank"),
        F.lit(None).cast("int").alias("lexical_rank"),
    )


def rrf(lists: DataFrame, k: int = fv.RRF_K) -> DataFrame:
    """Fuse ranked lists (query_id, list_id, rank, item) into (query_id, item, score, position)."""
    fused = lists.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("item").cast("string"))
    return fused.withColumn("position", F.row_number().over(w))


def rrf_hybrid(dense: DataFrame, lexical: DataFrame, k: int = fv.RRF_K, top_n: int = fv.TOP_N) -> DataFrame:
    """Fuse the two legs (query_id, id, rank) by reciprocal ranks; absent legs add nothing."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = d.join(x, ["query_id", "id"], "full_outer").withColumn(
        "score", F.round(part("dense_rank") + part("lexical_rank"), 12)
    )
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("id")], top_n, spread="id", rank="position")


def retrieve(fused: DataFrame, chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fused ids back to chunk columns. Only the fused ids meet the wide table; adaptive execution turns
    the join into a broadcast when they are few, and it stays a shuffle join when they are not."""
    columns = columns or ["volume", "chapter_num", "chapter_title", "heading_path", "text", "content_hash"]
    return fused.join(chunks.select("id", *columns), "id")


def rerank(
    candidates: DataFrame,
    score: Column,
    k: int = fv.TOP_K,
    order: list[Column] | None = None,
) -> DataFrame:
    """Best k candidates (query_id, position, ...) of each question by ``score``."""
    order = order or [F.desc("rerank_score"), F.asc("position")]
    return top_k(candidates.withColumn("rerank_score", score), ["query_id"], order, k, spread="id", rank="n")


def rerank_jaccard(candidates: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    return rerank(candidates, tx.jaccard(F.col("question"), F.col("text")), k)


def rerank_overlap(candidates: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Shared-word count; ties go to the later candidate."""
    score = tx.overlap_count(F.col("question"), F.col("text")).cast("double")
    return rerank(candidates, score, k, [F.desc("rerank_score"), F.desc("position")])


PairScorer = Callable[[], Callable[[list[str], list[str]], np.ndarray]]


def rerank_model(loader: PairScorer, batch_size: int = 8) -> Callable[[Column, Column], Column]:
    """A Column function that scores (question, text) pairs with a model loaded once per worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for q, t in batches:
            parts = [
                np.asarray(model(list(q.iloc[i : i + batch_size]), list(t.iloc[i : i + batch_size])), dtype=np.float64)
                for i in range(0, len(q), batch_size)
            ]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run


def rerank_or_fallback(candidates: DataFrame, scores: DataFrame | None, k: int = fv.TOP_K) -> DataFrame:
    """Reranked top k, or the first k fused rows of questions whose scoring is off or failed.

    ``scores`` is (query_id, id, rerank_score, error); a question with an error or without any score
    falls back as a whole, as one failed model call does.
    """
    if scores is None:
        scored = candidates.withColumn("rerank_score", F.lit(None).cast("double")).withColumn(
            "rerank_error", F.lit(None).cast("string")
        )
    else:
        per_question = scores.groupBy("query_id").agg(F.max("error").alias("rerank_error"))
        scored = (
            candidates.join(scores.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
            .join(per_question, "query_id", "left")
            .withColumn("rerank_score", F.when(F.col("rerank_error").isNull(), F.col("rerank_score")))
        )
    order = [F.desc_nulls_last("rerank_score"), F.asc("position")]
    return top_k(scored, ["query_id"], order, k, spread="id", rank="n")
