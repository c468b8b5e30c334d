"""Coverage reports, trailing-window quality gauges and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions.stats import nearest_rank, order_statistics, percentile_cont, select_ranks, top_k
from marginalia.session import cut_lineage


def first_section(section_path: Column) -> Column:
    return F.coalesce(F.try_element_at(section_path, F.lit(1)), F.lit(""))


def coverage_chapters(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("volume", "chapter_num", "chapter_title").agg(
        F.count("*").alias("chunks"),
        F.sum("token_count").alias("tokens"),
        F.min("commit_sha").alias("commit_sha"),
    )


def coverage_sections(chunks: DataFrame) -> DataFrame:
    """Chunks per first section; ``first_id`` gives the reading order."""
    return (
        chunks.withColumn("section", first_section(F.col("section_path")))
        .groupBy("volume", "chapter_num", "section")
        .agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"))
    )


def coverage_hits(query_log: DataFrame, chunks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per chapter: distinct answers and citations of the last ``days`` days.

    Ids are counted per (answer, chapter) after the join with the narrow id-to-chapter columns; the
    second step counts those rows, so no chapter is a group of raw citations.
    """
    recent = query_log.filter(F.col("started_at") > as_of - F.make_dt_interval(F.lit(days)))
    cites = recent.select(F.col("id").alias("answer_id"), F.explode("reranked_ids").alias("id"))
    per_answer = (
        cites.join(chunks.select("id", "volume", "chapter_num"), "id")
        .groupBy("volume", "chapter_num", "answer_id")
        .agg(F.count("*").alias("c"))
    )
    return per_answer.groupBy("volume", "chapter_num").agg(
        F.count("*").alias("answers"), F.sum("c").alias("citations")
    )


def coverage_rows(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Chapters with their hits (0 if none), volume totals (chapter null) and the grand total (both null)."""
    per = (
        coverage_chapters(chunks)
        .join(hits, ["volume", "chapter_num"], "left")
        .withColumn("answers", F.coalesce("answers", F.lit(0)))
        .withColumn("citations", F.coalesce("citations", F.lit(0)))
    )
    return per.rollup("volume", "chapter_num").agg(
        F.sum("chunks").alias("chunks"),
        F.sum("tokens").alias("tokens"),
        F.sum("answers").alias("answers"),
        F.sum("citations").alias("citations"),
    )


def coverage_tree(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per volume: nested chapters, each with its sections in reading order.

    Groups here are chapters of a volume and sections of a chapter, i.e. outline entries, not chunks.
    """
    sections = (
        coverage_sections(chunks)
        .groupBy("volume", "chapter_num")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("first_id", "section", "chunks"))),
                lambda x: F.struct(x["section"].alias("title"), x["chunks"].alias("chunks")),
            ).alias("sections")
        )
    )
    chapters = (
        coverage_chapters(chunks)
        .join(sections, ["volume", "chapter_num"])
        .join(hits, ["volume", "chapter_num"], "left")
        .select(
            "volume",
            "commit_sha",
            F.struct(
                "chapter_num",
                F.col("chapter_title").alias("title"),
                "chunks",
                "tokens",
                F.coalesce("answers", F.lit(0)).alias("answers"),
                F.coalesce("citations", F.lit(0)).alias("citations"),
                "sections",
            ).alias("c"),
        )
    )
    return chapters.groupBy("volume").agg(
        F.min("commit_sha").alias("commit_sha"),
        F.sum("c.chunks").alias("chunks"),
        F.sort_array(F.collect_list("c")).alias("chapters"),
    )


def gauges_24h(query_log: DataFrame, as_of: Column) -> DataFrame:
    """Queries, abstention rate, and medians of top-1 and mean rerank score over error-free rows of 24 hours."""
    rows = query_log.filter(
        (F.col("started_at") > as_of - F.expr("INTERVAL '24' HOUR")) & F.col("error").isNull()
    ).select(
        "abstained",
        F.try_element_at("rerank_scores", F.lit(1)).cast("double").alias("top1"),
        F.when(
            F.size("rerank_scores") > 0,
            F.aggregate("rerank_scores", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("rerank_scores"),
        ).alias("mean"),
    )
    rows = cut_lineage(rows, "gauges")  # the log is read once; three passes over three narrow columns of a day follow
    one = F.lit(1).alias("_one")
    base = rows.agg(
        F.count("*").alias("queries_24h"),
        F.coalesce(F.avg(F.when(F.col("abstained"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("abstention_rate_24h"),
    ).select("*", one)
    med = percentile_cont(rows, [], {"top1_score_p50": ("top1", 0.5), "retrieval_score_p50": ("mean", 0.5)})
    return (
        base.join(med.select("*", one), "_one", "left")
        .drop("_one")
        .withColumn("top1_score_p50", F.coalesce("top1_score_p50", F.lit(0.0)))
        .withColumn("retrieval_score_p50", F.coalesce("retrieval_score_p50", F.lit(0.0)))
    )


def gauges_7d(judge_scores: DataFrame, as_of: Column) -> DataFrame:
    recent = judge_scores.filter(F.col("judged_at") > as_of - F.expr("INTERVAL '7' DAY"))
    avg0 = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return recent.agg(
        avg0("groundedness").alias("nightly_groundedness"),
        avg0("faithfulness").alias("nightly_faithfulness"),
        F.coalesce(F.sum(F.col("flagged").cast("long")), F.lit(0)).alias("judge_flagged_7d"),
        F.count("*").alias("judged_answers_7d"),
        F.coalesce(F.unix_timestamp(F.max("judged_at")), F.lit(0)).alias("last_judge_run"),
    )


# ---- benchmark analytics ----------------------------------------------------------


def bench_summary(samples: DataFrame, wall_s: DataFrame) -> DataFrame:
    """Per (target, concurrency): requests, errors, rates over wall time, latency percentiles of ok rows.

    ``samples`` (target, concurrency, ok, ttft_ms, total_ms, output_tokens, rerank_fallback);
    ``wall_s`` (target, concurrency, wall_s).
    """
    keys = ["target", "concurrency"]
    ok = F.col("ok")
    base = samples.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(~ok).alias("errors"),
        F.sum(F.when(ok, F.col("output_tokens")).otherwise(0)).alias("_tokens"),
        F.count_if(ok & F.col("rerank_fallback")).alias("rerank_fallbacks"),
    )
    good = samples.filter("ok")
    ranks = {50: nearest_rank(50), 90: nearest_rank(90), 99: nearest_rank(99)}
    wanted = {f"{a}_p{p}": (f"{a}_ms", *r) for a in ("ttft", "total") for p, r in ranks.items()}
    pct = select_ranks(good, keys, wanted).drop("_n_ttft_ms", "_n_total_ms")
    rate = lambda x, d: F.when(F.col("wall_s") > 0, F.round(x / F.col("wall_s"), d)).otherwise(0.0)
    out = base.join(wall_s, keys).join(pct, keys, "left")
    ps = [f"{a}_p{p}" for a in ("ttft", "total") for p in (50, 90, 99)]
    return out.select(
        *keys,
        "requests",
        "errors",
        F.round("wall_s", 2).alias("wall_s"),
        rate(F.col("requests") - F.col("errors"), 3).alias("requests_per_s"),
        rate(F.col("_tokens"), 1).alias("output_tokens_per_s"),
        *[F.round(F.coalesce(p, F.lit(0.0)), 1).alias(p) for p in ps],
        "rerank_fallbacks",
    )


def stage_p50(samples: DataFrame) -> DataFrame:
    """Median per (target, concurrency, stage) of ok rows."""
    each = samples.filter("ok").select("target", "concurrency", F.explode("stage_ms").alias("stage", "ms"))
    st = order_statistics(each, ["target", "concurrency", "stage"], "ms", {"p50_ms": nearest_rank(50)})
    return st.withColumn("p50_ms", F.round("p50_ms", 1))


def error_samples(samples: DataFrame, order: str, n: int = 5) -> DataFrame:
    """(target, concurrency, n, error): the first n error messages of each run."""
    bad = samples.filter(~F.col("ok"))
    return top_k(bad, ["target", "concurrency"], [F.asc(order)], n, spread=order, rank="n").select(
        "target", "concurrency", "n", "error"
    )


def runs_table(results: DataFrame) -> DataFrame:
    """Result documents (name, runs[]) to one row per run."""
    return results.select("name", F.explode("runs").alias("r")).select(
        "name",
        "r.concurrency",
        "r.requests_per_s",
        "r.output_tokens_per_s",
        F.col("r.ttft_ms.p50").alias("ttft_p50"),
        F.col("r.ttft_ms.p99").alias("ttft_p99"),
        F.col("r.total_ms.p50").alias("total_p50"),
        F.col("r.total_ms.p99").alias("total_p99"),
        "r.errors",
    )


def cells_pivot(model_runs: DataFrame, e2e_runs: DataFrame, key: str = "name") -> DataFrame:
    """Per cell, figures of two run lists side by side at concurrency 1 and 8."""
    def side(df: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
        p = df.groupBy(key).pivot("concurrency", [1, 8]).agg(*[F.max(c).alias(c) for c in cols])
        return p.select(key, *[F.col(f"{c}_{m}").alias(f"{prefix}_{m}_c{c}") for c in (1, 8) for m in cols])

    m = side(model_runs, "model", ["output_tokens_per_s", "ttft_p50"])
    e = side(e2e_runs, "e2e", ["ttft_p50", "total_p50"])
    return m.join(e, key, "full_outer").select(
        key, "model_output_tokens_per_s_c8", "model_ttft_p50_c1", "e2e_ttft_p50_c1", "e2e_total_p50_c8"
    )


def mine_logs(
    logs: DataFrame, engine: str = "vllm", services: tuple[str, ...] = ("vllm", "reranker", "embedder"), gateway: str = "gateway"
) -> DataFrame:
    """(cell, service, line_no, line) to one row per cell: error counts and first matches.

    All aggregates combine map-side, so one huge log is no hot group.
    """
    svc, line = F.col("service"), F.col("line")
    firsts = []
    for name, pattern in fv.LOG_FIRST_MATCH.items():
        hit = F.regexp_extract(line, pattern, 0)
        cond = (svc == engine) & (hit != "")
        firsts.append(
            F.coalesce(F.min_by(F.when(cond, hit), F.when(cond, F.col("line_no"))), F.lit("")).alias(name)
        )
    return logs.groupBy("cell").agg(
        F.sum(F.when(svc.isin(*services), F.regexp_count(line, F.lit(fv.P_LOG_MEMORY))).otherwise(0)).alias(
            "memory_errors"
        ),
        F.sum(F.when(svc == gateway, F.regexp_count(line, F.lit(fv.P_LOG_500))).otherwise(0)).alias("gateway_500s"),
        *firsts,
    )


def peak_usage(samples: DataFrame) -> DataFrame:
    return samples.groupBy("cell").agg(F.max("used_mib").alias("peak_mib"))


def sweep_delta(rows: DataFrame, metrics: list[str], baseline: str) -> DataFrame:
    """Change of each metric in percent against the baseline variant at the same concurrency."""
    base = rows.filter(F.col("variant") == baseline).select(
        "concurrency", *[F.col(m).alias(f"_{m}") for m in metrics]
    )
    return rows.join(base, "concurrency").select(
        "variant",
        "concurrency",
        *[F.when(F.col(f"_{m}") != 0, (F.col(m) / F.col(f"_{m}") - 1) * 100).alias(f"{m}_delta_pct") for m in metrics],
    )
