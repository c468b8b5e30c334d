"""Registered queries: sources and sinks (written to and read from the shared folder), table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions import text as tx
from marginalia.operators import maintenance, quality
from marginalia.plans import derive as dv
from marginalia.plans.registry import query
from marginalia.session import cut_lineage, work_path
from marginalia.sources import readers, writers

# ---- sources ----------------------------------------------------------------------


def _page_files(spark, sf, root):
    """Pages written as one file each under ``root``; the paths of the files. Folders are 256, so a listing is as many tasks."""
    pages = dv.t(spark, sf, "pages").select(
        F.pmod("page_id", F.lit(256)).alias("g"), F.col("page_id").alias("p"), F.col("html").alias("value")
    )
    local = writers.local_folder(spark, root)
    if local:
        path = F.concat(F.lit("g="), F.coalesce(F.col("g").cast("string"), F.lit("none")), F.lit("/p="), F.coalesce(F.col("p").cast("string"), F.lit("none")))
        return writers.write_texts(pages.select(path.alias("path"), F.col("value").alias("text")), local)
    # another file system: every core writes files, and each task commits its own (version 2), as the driver would rename them one by one
    writer = pages.repartition(spark.sparkContext.defaultParallelism, "p").write.partitionBy("g", "p")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.regexp_extract("path", r"(g=\d+/p=\d+/[^/]+)$", 1).alias("path")
    )


@query(
    "scan_corpus",
    "SELECT page_id, md5(html) AS text_md5, true AS found FROM pages UNION ALL SELECT page_id, NULL, false FROM pages",
)
def scan_corpus(spark, sf):
    """Pages written as one file each; the manifest also names an absent twin of every file."""
    root = work_path(spark, "corpus")
    names = _page_files(spark, sf, root)
    both = F.explode(F.array("path", F.concat("path", F.lit(".absent")))).alias("path")
    manifest = names.select(F.regexp_extract("path", r"/p=(-?\d+)", 1).try_cast("long").alias("page_id"), both)
    manifest = cut_lineage(manifest.repartition("path"), "manifest")  # read three times; the names are listed once
    docs, missing = readers.scan_corpus(spark, root, manifest)
    # the writers end each file with a line end of their own
    found = docs.select("page_id", F.md5(F.regexp_replace("text", r"\n\z", "")).alias("text_md5"), F.lit(True).alias("found"))
    return found.unionByName(missing.select("page_id", F.lit(None).cast("string").alias("text_md5"), F.lit(False).alias("found")))


def _chunk_table(spark, sf):
    e = dv.t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dv.doc_rows(spark, sf).join(e, "id", "left").withColumn("char_start", F.lit(0)).withColumn(
        "char_end", F.col("n_chars")
    )


@query(
    "scan_chunks",
    f"""WITH {dv.DOC_ROWS} SELECT volume::INT AS volume, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) FILTER (id IN (SELECT vec_id FROM embeddings)) AS embedded
    FROM doc_rows GROUP BY 1""",
)
def scan_chunks(spark, sf):
    path = work_path(spark, "chunks")
    writers._conform(_chunk_table(spark, sf), schemas.CHUNKS).write.parquet(path)
    return readers.scan_chunks(spark, path).groupBy(F.col("volume").cast("int").alias("volume")).agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count("embedding").alias("embedded")
    )


@query("scan_table", "SELECT 0::BIGINT AS absent, count(*) AS present FROM events")
def scan_table(spark, sf):
    """An absent table is empty; a written one comes back with its declared schema."""
    path = work_path(spark, "demo")
    e = dv.events(spark, sf).select(
        F.col("event_id").alias("id"), tx.key_hash(F.col("user_id").cast("string"), "s").alias("ip_hash"), F.col("ts").alias("at"), F.col("value").alias("cost_usd")
    )
    writers._conform(e, schemas.DEMO_REQUESTS).write.parquet(path)
    absent = readers.scan_table(spark, path + "-absent", "demo_requests")
    present = readers.scan_table(spark, path, "demo_requests")
    both = absent.withColumn("p", F.lit(0)).unionByName(present.withColumn("p", F.lit(1)))
    return both.agg(F.count_if(F.col("p") == 0).alias("absent"), F.count_if(F.col("p") == 1).alias("present"))


@query("read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def read_jsonl(spark, sf):
    path = work_path(spark, "jsonl")
    writers.write_jsonl(dv.t(spark, sf, "conversations"), path)
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    return readers.read_jsonl(spark, path, schema).unionByName(readers.read_jsonl(spark, path + "-absent", schema))


_RUNS_SQL = f"""{dv.EVENTS}, runs AS (SELECT event_type AS name, CAST(user_id % 5 AS INT) AS concurrency, round(count(*) / 100.0, 3)::DOUBLE AS requests_per_s,
    round(sum(k) / 100.0, 1)::DOUBLE AS output_tokens_per_s, min(value) AS ttft_p50, max(value) AS ttft_p99, min(value) + 1 AS total_p50, max(value) + 1 AS total_p99,
    count(*) FILTER (k > 90) AS errors FROM ev GROUP BY 1, 2)"""


def result_documents(spark, sf):
    """One result document per event type, with a run per user group."""
    e = dv.events(spark, sf)
    lat = lambda d: F.struct(
        (F.min("value") + d).alias("p50"), F.avg("value").alias("p90"), (F.max("value") + d).alias("p99")
    )
    runs = e.groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 5).cast("int").alias("concurrency")).agg(
        F.round(F.count("*") / 100, 3).alias("requests_per_s"),
        F.round(F.sum("k") / 100, 1).alias("output_tokens_per_s"),
        lat(0).alias("ttft_ms"),
        lat(1).alias("total_ms"),
        F.count_if(F.col("k") > 90).alias("errors"),
    )
    cols = [c for c in runs.columns if c != "name"]
    return runs.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("runs"))


def _read_back(spark, sf):
    root = work_path(spark, "results")
    result_documents(spark, sf).withColumn("doc", F.col("name")).write.partitionBy("doc").json(root)
    return readers.read_results(spark, root + "/*/*.json")


@query("read_results", f"WITH {_RUNS_SQL} SELECT name, count(*) AS runs, CAST(sum(errors) AS BIGINT) AS errors FROM runs GROUP BY 1")
def read_results(spark, sf):
    r = _read_back(spark, sf).select("name", F.explode("runs").alias("r"))
    return r.groupBy("name").agg(F.count("*").alias("runs"), F.sum("r.errors").alias("errors"))


@query(
    "runs_table",
    f"WITH {_RUNS_SQL} SELECT name, concurrency, requests_per_s, output_tokens_per_s, ttft_p50, ttft_p99, total_p50, total_p99, errors FROM runs",
)
def runs_table(spark, sf):
    return quality.runs_table(_read_back(spark, sf))


_LOG_SQL = f"""{dv.EVENTS}, logs AS (SELECT 'u' || (user_id % 5) AS cell, CASE event_type WHEN 'error' THEN 'vllm' WHEN 'click' THEN 'reranker' WHEN 'view' THEN 'gateway' ELSE 'embedder' END AS service, event_id, k,
    CASE k % 5 WHEN 0 THEN 'CUDA error: out of memory at ' || k WHEN 1 THEN 'Model loading took ' || k || '.5 GiB of memory' WHEN 2 THEN 'GET / 500 Internal Server Error'
      WHEN 3 THEN 'GPU KV cache size: ' || k || ',000 tokens' ELSE 'ok ' || event_id END AS line FROM ev)"""


def log_lines(spark, sf):
    k = F.col("k").cast("string")
    service = (
        F.when(F.col("event_type") == "error", "vllm")
        .when(F.col("event_type") == "click", "reranker")
        .when(F.col("event_type") == "view", "gateway")
        .otherwise("embedder")
    )
    m = F.col("k") % 5
    line = (
        F.when(m == 0, F.concat(F.lit("CUDA error: out of memory at "), k))
        .when(m == 1, F.concat(F.lit("Model loading took "), k, F.lit(".5 GiB of memory")))
        .when(m == 2, "GET / 500 Internal Server Error")
        .when(m == 3, F.concat(F.lit("GPU KV cache size: "), k, F.lit(",000 tokens")))
        .otherwise(F.concat(F.lit("ok "), F.col("event_id").cast("string")))
    )
    return dv.events(spark, sf).select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("cell"),
        service.alias("service"),
        F.col("event_id").alias("line_no"),
        line.alias("line"),
    )


@query("read_logs", f"WITH {_LOG_SQL} SELECT cell, service, count(*) AS lines, count(*) FILTER (starts_with(line, 'ok ')) AS ok_lines FROM logs GROUP BY 1, 2")
def read_logs(spark, sf):
    root = work_path(spark, "logs")
    log_lines(spark, sf).select("cell", "service", F.col("line").alias("value")).write.partitionBy("cell", "service").text(root)
    lines = readers.read_logs(spark, root + "/*/*", r"/cell=([^/]+)/", r"/service=([^/]+)/")
    return lines.groupBy("cell", "service").agg(
        F.count("*").alias("lines"), F.count_if(F.col("line").startswith("ok ")).alias("ok_lines")
    )


@query(
    "mine_logs",
    f"""WITH {_LOG_SQL} SELECT cell, CAST(sum(CASE WHEN service <> 'gateway' AND k % 5 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS memory_errors,
      CAST(sum(CASE WHEN service = 'gateway' AND k % 5 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS gateway_500s,
      coalesce(arg_min('Model loading took ' || k || '.5 GiB', event_id) FILTER (service = 'vllm' AND k % 5 = 1), '') AS weights, '' AS kv,
      coalesce(arg_min('GPU KV cache size: ' || k || ',000 tokens', event_id) FILTER (service = 'vllm' AND k % 5 = 3), '') AS kv_tokens, '' AS max_concurrency
    FROM logs GROUP BY 1""",
)
def mine_logs(spark, sf):
    return quality.mine_logs(log_lines(spark, sf))


@query("read_prompts", f"WITH p AS (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) SELECT {dv.strip_sql('l')} AS prompt FROM p WHERE {dv.strip_sql('l')} <> ''")
def read_prompts(spark, sf):
    path = work_path(spark, "prompts")
    b = dv.t(spark, sf, "benchmark")
    b.select(F.concat(F.lit("# item "), F.col("item_id").cast("string"), F.lit("\n\n  "), "text", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_prompts(spark, path)


# ---- sinks ------------------------------------------------------------------------


@query("snapshot_spans", f"WITH {dv.DOC_ROWS} SELECT content_hash, source_file, 0 AS char_start, CAST(n_chars AS BIGINT) AS char_end FROM doc_rows")
def snapshot_spans(spark, sf):
    path = work_path(spark, "spans")
    writers.snapshot_spans(_chunk_table(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "append_query_log",
    f"""WITH {dv.QUERY_LOG} SELECT CAST(started_at AS DATE) AS day, count(*) AS n, count(error) AS errors, count(*) FILTER (abstained) AS abstained, CAST(sum(3) AS BIGINT) AS ids
    FROM query_log GROUP BY 1""",
)
def append_query_log(spark, sf):
    """Two appends (answered rows, failed rows), read back through the declared schema."""
    path = work_path(spark, "query_log")
    log = dv.query_log(spark, sf)
    writers.append_query_log(log.filter("error is null"), path)
    writers.append_query_log(log.filter("error is not null"), path)
    back = readers.scan_table(spark, path, "query_log")
    return back.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("n"),
        F.count("error").alias("errors"),
        F.count_if("abstained").alias("abstained"),
        F.sum(F.size("reranked_ids")).alias("ids"),
    )


@query(
    "append_judge_scores",
    f"WITH {dv.EVENTS} SELECT event_type, count(*) AS n, count(*) FILTER (k > 50) AS flagged FROM ev GROUP BY 1",
)
def append_judge_scores(spark, sf):
    path = work_path(spark, "judge")
    writers.append_judge_scores(judge_scores(spark, sf), path)
    back = readers.scan_table(spark, path, "judge_scores")
    return back.groupBy(F.col("judge_model").alias("event_type")).agg(
        F.count("*").alias("n"), F.count_if("flagged").alias("flagged")
    )


def judge_scores(spark, sf):
    """Every event as a judged answer."""
    return dv.events(spark, sf).select(
        F.col("event_id").alias("query_log_id"),
        F.col("ts").alias("judged_at"),
        F.col("event_type").alias("judge_model"),
        (F.col("k") / 100).alias("faithfulness"),
        ((100 - F.col("k")) / 100).alias("groundedness"),
        (F.col("k") > 50).alias("flagged"),
    )


def versions(spark, sf):
    """(current, incoming): documents as they are; then without those labelled toxic, with low-quality
    ones edited, and the benchmark passages added."""
    docs = dv.t(spark, sf, "documents").select("doc_id", "text", "source")
    lab = dv.t(spark, sf, "labels")
    current = docs.select(
        F.col("doc_id").alias("id"), "text", F.concat(F.lit("old-"), "source").alias("commit_sha"), F.col("doc_id").cast("float").alias("e")
    ).withColumn("content_hash", tx.content_hash(F.col("text"))).withColumn("embedding", F.array("e")).drop("e")
    edited = (
        docs.join(lab, "doc_id", "left")
        .filter("coalesce(toxic, 0) = 0")
        .select(
            F.col("doc_id").alias("id"),
            F.when(F.col("quality") == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")).alias("text"),
        )
    )
    added = dv.t(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("id"), "text")
    incoming = edited.unionByName(added).withColumn("commit_sha", F.lit("new")).withColumn(
        "content_hash", tx.content_hash(F.col("text"))
    )
    return maintenance.dedup_by_hash(current), incoming


_VERSIONS_SQL = f"""cur0 AS (SELECT doc_id AS id, text, 'old-' || source AS commit_sha, {dv.hash_sql('text')} AS content_hash FROM documents),
    cur AS (SELECT * FROM cur0 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id DESC) = 1),
    inc0 AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 0 THEN text || ' (revised)' ELSE text END AS text FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0
      UNION ALL SELECT item_id + 1000000000, text FROM benchmark),
    inc AS (SELECT *, {dv.hash_sql('text')} AS content_hash FROM inc0 QUALIFY row_number() OVER (PARTITION BY {dv.hash_sql('text')} ORDER BY id DESC) = 1)"""


@query(
    "dedup_by_hash",
    f"SELECT max(doc_id) AS id, {dv.hash_sql('text')} AS content_hash FROM documents GROUP BY 2",
)
def dedup_by_hash(spark, sf):
    return maintenance.dedup_by_hash(dv.doc_rows(spark, sf)).select("id", "content_hash")


_LOADED_SQL = f"""WITH {_VERSIONS_SQL} SELECT coalesce(c.id, i.id) AS id, i.content_hash, 'new' AS commit_sha, c.id IS NOT NULL AS embedded
    FROM inc i LEFT JOIN cur c USING (content_hash)"""


@query("diff_load", _LOADED_SQL)
def diff_load(spark, sf):
    current, incoming = versions(spark, sf)
    return maintenance.diff_load(current, incoming, "new").select(
        "id", "content_hash", "commit_sha", F.col("embedding").isNotNull().alias("embedded")
    )


@query("next_version", _LOADED_SQL)
def next_version(spark, sf):
    """The current table bucketed by hash, the next version written from it bucket by bucket and read back."""
    current, incoming = versions(spark, sf)
    path, buckets = work_path(spark, "version"), 16
    name = "chunks_" + path.rsplit("-", 1)[1]
    old = writers.write_bucketed(current, f"{name}_1", f"{path}/1", buckets)
    new = maintenance.next_version(old, incoming, "new", f"{name}_2", f"{path}/2", buckets)
    return new.select("id", "content_hash", "commit_sha", F.col("embedding").isNotNull().alias("embedded"))


_SUMMARY_SQL = f"""WITH {_VERSIONS_SQL}, s AS (SELECT c.content_hash IS NULL AS a, i.content_hash IS NULL AS r, c.commit_sha FROM cur c FULL OUTER JOIN inc i ON c.content_hash = i.content_hash)
    SELECT count(*) FILTER (a) AS added, count(*) FILTER (r) AS removed, count(*) FILTER (NOT a AND NOT r) AS unchanged, min(commit_sha) AS previous_sha FROM s"""


@query("diff_summary", _SUMMARY_SQL)
def diff_summary(spark, sf):
    return maintenance.diff_summary(*versions(spark, sf))


@query(
    "append_ingest_run",
    f"SELECT added AS chunks_added, removed AS chunks_removed, unchanged AS chunks_unchanged, 'new' AS commit_sha FROM ({_SUMMARY_SQL})",
)
def append_ingest_run(spark, sf):
    path = work_path(spark, "runs")
    s = maintenance.diff_summary(*versions(spark, sf))
    writers.append_ingest_run(s, path, "r1", "new", dv.as_of(), dv.as_of())
    return readers.scan_table(spark, path, "ingest_runs").select("chunks_added", "chunks_removed", "chunks_unchanged", "commit_sha")


@query(
    "incremental_copy",
    f"""WITH {dv.DOC_ROWS} SELECT content_hash, count(*) AS rows FROM doc_rows d WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.id) GROUP BY 1""",
)
def incremental_copy(spark, sf):
    """English rows first, then everything that is still missing; a repeat adds nothing."""
    path = work_path(spark, "copy")
    # the table is read three times: texts and embeddings meet once, and rows that are never copied go no further
    src = cut_lineage(_chunk_table(spark, sf).filter("embedding is not null"), "chunk-table")
    other = dv.doc_rows(spark, sf).filter("lang <> 'en'").select("content_hash").distinct()
    en = src.filter("lang = 'en'").join(other, "content_hash", "left_anti")
    writers.incremental_copy(en, path)
    writers.incremental_copy(src, path)
    writers.incremental_copy(src, path)
    return readers.scan_chunks(spark, path).groupBy("content_hash").agg(F.count("*").alias("rows"))


@query("index_summary", f"WITH {dv.DOC_ROWS} SELECT min(commit_sha) AS commit_sha, count(*) AS chunks FROM doc_rows")
def index_summary(spark, sf):
    return maintenance.index_summary(dv.doc_rows(spark, sf))


# ---- label migration --------------------------------------------------------------


def _spans(spark, sf, lo, hi):
    return dv.doc_chunks(spark, sf, lo, hi).select(
        "content_hash", F.col("doc_id").cast("string").alias("source_file"), "char_start", "char_end"
    )


def _remap_sql() -> str:
    import re

    old = dv.packed_sql(200, 400)
    new = dv.packed_sql(300, 600)
    for cte in ("sized", "sents0", "sents", "split", "pieces", "items0", "items", "pack", "chunks"):
        old = re.sub(rf"\b{cte}\b", f"{cte}_o", old)
        new = re.sub(rf"\b{cte}\b", f"{cte}_n", new)
    return f"""WITH RECURSIVE {dv.PARAS}, {old}, {new},
    o AS (SELECT {dv.hash_sql('text')} AS h, doc_id::VARCHAR AS f, char_start AS s, char_end AS e FROM chunks_o),
    n AS (SELECT {dv.hash_sql('text')} AS h, doc_id::VARCHAR AS f, char_start AS s, char_end AS e FROM chunks_n),
    place AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY h ORDER BY f DESC, s DESC, e DESC) = 1),
    best AS (SELECT p.h, n.h AS nh FROM place p JOIN n ON n.f = p.f AND least(p.e, n.e) - greatest(p.s, n.s) > 0
      WHERE p.h NOT IN (SELECT h FROM n) QUALIFY row_number() OVER (PARTITION BY p.h ORDER BY least(p.e, n.e) - greatest(p.s, n.s) DESC, n.s, n.h) = 1),
    mapping AS (SELECT DISTINCT o.h AS old_hash, CASE WHEN o.h IN (SELECT h FROM n) THEN o.h ELSE b.nh END AS new_hash FROM o LEFT JOIN best b ON b.h = o.h)"""


@query("span_overlap_remap", f"{_remap_sql()} SELECT old_hash, new_hash FROM mapping")
def span_overlap_remap(spark, sf):
    """Every chunk of the 400-token cut is a label, moved to the 600-token cut."""
    old, new = _spans(spark, sf, 200, 400), _spans(spark, sf, 300, 600)
    return maintenance.span_overlap_remap(old, new, old.select("content_hash"))


@query(
    "apply_remap",
    f"""{_remap_sql()}, lab AS (SELECT doc_id, chunk_no, {dv.hash_sql('text')} AS h FROM chunks_o UNION ALL SELECT doc_id, -1, 'gone' FROM documents)
    SELECT doc_id::VARCHAR AS id, coalesce(string_agg(m.new_hash, ',' ORDER BY chunk_no), '') AS hashes, count(*) FILTER (m.new_hash IS NULL) AS lost
    FROM lab LEFT JOIN mapping m ON m.old_hash = lab.h GROUP BY 1""",
)
def apply_remap(spark, sf):
    """Each document is an item labelled with all its old chunks and one label that no longer exists."""
    old, new = _spans(spark, sf, 200, 400), _spans(spark, sf, 300, 600)
    mapping = maintenance.span_overlap_remap(old, new, old.select("content_hash"))
    chunks = dv.doc_chunks(spark, sf, 200, 400).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "content_hash"))), lambda x: x["content_hash"]).alias("h")
    )
    items = (
        dv.t(spark, sf, "documents")
        .select("doc_id")
        .join(chunks, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.concat(F.array(F.lit("gone")), F.coalesce("h", F.array().cast("array<string>"))).alias("source_chunk_content_hashes"),
        )
    )
    return maintenance.apply_remap(items, mapping).select(
        "id", F.array_join("source_chunk_content_hashes", ",").alias("hashes"), "lost"
    )

