"""Whole jobs: corpus to chunks, chunk table refresh, questions to cited prompts, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.operators import ann, assembly, chunking, embedding, inverted, maintenance, markup, retrieval
from marginalia.session import cut_lineage, work_path
from marginalia.sources.readers import scan_corpus


def build_chunks(
    spark: SparkSession,
    root: str,
    manifest: DataFrame,
    commit_sha: str,
    values: DataFrame | None = None,
    min_tokens: int = fv.MIN_TOKENS,
    max_tokens: int = fv.MAX_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, missing manifest rows) of the marked-up files under ``root``.

    Cross-references need every document, so parsed blocks are written once and read by the label
    aggregation and by the packing.
    """
    chapters = chunking.select_chapters(manifest)
    docs, missing = scan_corpus(spark, root, chapters)
    if values is not None:
        docs = markup.substitute_values(docs, values).drop("inline", "resolved")
    blocks = cut_lineage(markup.parse_blocks(docs.select("source_file", "text")), "blocks")
    labels = markup.collect_labels(blocks, chapters.withColumnRenamed("path", "source_file"))
    resolved = markup.resolve_crossrefs(blocks, labels)
    return chunking.chunk_corpus(resolved, chapters, commit_sha, min_tokens, max_tokens), missing


def refresh_chunks(
    current: DataFrame, incoming: DataFrame, commit_sha: str, embed: Callable[[Column], Column] = embedding.hash_embed
) -> DataFrame:
    """Next version of the chunk table, with embeddings for what is new."""
    return embedding.fill_embeddings(maintenance.diff_load(current, incoming, commit_sha), embed)


@dataclass
class Retrieved:
    fused: DataFrame
    reranked: DataFrame
    citations: DataFrame
    prompts: DataFrame


@dataclass
class Search:
    """Stored indexes of a chunk table: postings with vectors, and the vectors by cell."""

    postings: inverted.SearchIndex
    rows: DataFrame | None
    cells: ann.Cells | None


def index_chunks(chunks: DataFrame, path: str, buckets: int = inverted.BUCKETS) -> Search:
    """Indexes of chunks (id, text, embedding) in the new folder ``path``."""
    postings = inverted.build(chunks.select("id", "text", "embedding"), f"{path}/postings", buckets)
    rows, cells = ann.build_index(inverted.vectors(chunks.sparkSession, postings), path=f"{path}/cells")
    ann.save_cells(chunks.sparkSession, cells, f"{path}/centers")
    return Search(postings, rows, cells)


def open_search(spark: SparkSession, path: str) -> Search:
    """Indexes that an earlier job stored."""
    return Search(
        inverted.open_index(spark, f"{path}/postings"), spark.read.parquet(f"{path}/cells"), ann.load_cells(spark, f"{path}/centers")
    )


def update_search(search: Search, added: DataFrame, removed: DataFrame, path: str) -> Search:
    """Chunks ``removed`` (id) taken out of and ``added`` (id, text, embedding) put into the indexes.

    Postings get a generation; the vectors by cell are written anew to the new folder ``path`` with the cells they have.
    """
    spark = added.sparkSession
    postings = inverted.update(search.postings, added.select("id", "text", "embedding"), removed)
    fresh = ann.assign(added.select("id", "embedding").where("embedding is not null"), search.cells)
    rows = search.rows.join(removed.select("id"), "id", "left_anti").select("id", "embedding", "cell").unionByName(fresh)
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{path}/cells")
    ann.save_cells(spark, search.cells, f"{path}/centers")
    return Search(postings, spark.read.parquet(f"{path}/cells"), search.cells)


def answer_questions(
    chunks: DataFrame,
    questions: DataFrame,
    embed: Callable[[Column], Column] = embedding.hash_embed,
    mode: str = "hybrid",
    top_n: int = fv.TOP_N,
    top_k: int = fv.TOP_K,
    search: Search | None = None,
    recall: float = 0.97,
) -> Retrieved:
    """Questions (query_id, question) over chunks with embeddings to cited prompts.

    ``search`` holds the stored indexes of the chunks; without it they are built first, in the shared folder. Modes:
    ``hybrid`` (exact dense search and lexical search, fused), ``approximate`` (the same with probed cells in place of exact
    search, probes fitted to ``recall``), ``dense``. The legs carry ids only; texts come in for the fused rows.
    """
    spark = chunks.sparkSession
    q = cut_lineage(questions.withColumn("embedding", embed(F.col("question"))), "asked")
    if search is None and mode == "approximate":
        search = index_chunks(chunks, work_path(spark, "search"))
    elif search is None and mode == "hybrid":  # cells are not asked for
        search = Search(inverted.build(chunks.select("id", "text", "embedding"), work_path(spark, "search")), None, None)
    vectors = inverted.vectors(spark, search.postings) if search else chunks.select("id", "embedding")
    if mode == "dense":
        fused = retrieval.dense_only(vectors, q, top_n).withColumn("position", F.col("dense_rank"))
    else:
        if mode == "approximate":
            dense = ann.ann_topk(search.rows, search.cells, q, recall=recall)
        else:
            dense = retrieval.dense_topk(vectors, q)
        fused = retrieval.rrf_hybrid(dense, inverted.topk(search.postings, questions), top_n=top_n)
    rows = retrieval.retrieve(fused, chunks, ["heading_path", "text", "content_hash"])
    rows = cut_lineage(rows.join(questions, "query_id"), "fused")
    reranked = retrieval.rerank_jaccard(rows, top_k)
    return Retrieved(rows, reranked, assembly.citations(reranked), assembly.build_prompts(reranked, questions))
