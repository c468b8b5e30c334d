"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

CHUNKS = (
    "id BIGINT, volume INT, chapter_num INT, chapter_title STRING, section_path ARRAY<STRING>, "
    "heading_path STRING, source_file STRING, char_start INT, char_end INT, token_count INT, commit_sha STRING, "
    "content_hash STRING, oversize BOOLEAN, text STRING, embedding ARRAY<FLOAT>"
)
BLOCKS = (
    "source_file STRING, block_no INT, kind STRING, text STRING, char_start INT, char_end INT, level INT, anchor STRING"
)
MANIFEST = "volume INT, ordinal BIGINT, path STRING"
POSTINGS = "chunk_id BIGINT, term STRING, positions ARRAY<INT>"
INGEST_RUNS = (
    "id STRING, commit_sha STRING, started_at TIMESTAMP, finished_at TIMESTAMP, chunks_added BIGINT, "
    "chunks_removed BIGINT, chunks_unchanged BIGINT, notes STRING"
)
QUERY_LOG = (
    "id BIGINT, question_hash STRING, question STRING, started_at TIMESTAMP, finished_at TIMESTAMP, profile STRING, "
    "model STRING, prompt_version STRING, retrieval_mode STRING, embed_ms FLOAT, retrieve_ms FLOAT, rerank_ms FLOAT, "
    "ttft_ms FLOAT, generate_ms FLOAT, total_ms FLOAT, fused_ids ARRAY<BIGINT>, fused_scores ARRAY<FLOAT>, "
    "reranked_ids ARRAY<BIGINT>, rerank_scores ARRAY<FLOAT>, prompt_tokens INT, completion_tokens INT, answer STRING, "
    "abstained BOOLEAN, error STRING"
)
JUDGE_SCORES = (
    "query_log_id BIGINT, judged_at TIMESTAMP, judge_model STRING, faithfulness FLOAT, relevance FLOAT, "
    "groundedness FLOAT, flagged BOOLEAN, rationale STRING"
)
DEMO_REQUESTS = "id BIGINT, ip_hash STRING, at TIMESTAMP, cost_usd FLOAT"
GOLDEN = (
    "id STRING, question STRING, answer_key_points ARRAY<STRING>, source_chunk_content_hashes ARRAY<STRING>, "
    "type STRING, chapter STRING, verified BOOLEAN"
)
CANDIDATES = GOLDEN + ", generated_by STRING, notes STRING"
SAMPLES = (
    "target STRING, concurrency INT, ok BOOLEAN, ttft_ms DOUBLE, total_ms DOUBLE, output_tokens BIGINT, error STRING, "
    "stage_ms MAP<STRING,DOUBLE>, rerank_fallback BOOLEAN"
)
_LATENCY = "STRUCT<p50:DOUBLE,p90:DOUBLE,p99:DOUBLE>"
RESULTS = (
    "name STRING, created_at STRING, git_sha STRING, reproduce STRING, "
    "runs ARRAY<STRUCT<concurrency:INT,requests_per_s:DOUBLE,output_tokens_per_s:DOUBLE,"
    f"ttft_ms:{_LATENCY},total_ms:{_LATENCY},errors:BIGINT>>"
)

TABLES = {
    "chunks": CHUNKS,
    "query_log": QUERY_LOG,
    "judge_scores": JUDGE_SCORES,
    "demo_requests": DEMO_REQUESTS,
    "ingest_runs": INGEST_RUNS,
}
