"""Retrieval metrics, rater agreement and the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.stats import mean_or_zero, nearest_rank, order_statistics
from marginalia.functions.text import ratio


def resolve_hashes(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(content_hash, chunk_id): current chunk of each labelled hash, null when it is gone.

    Chunks meet the labels first, so only labelled ones are grouped.
    """
    hashes = items.select(F.explode("source_chunk_content_hashes").alias("content_hash")).distinct()
    labelled = chunks.select("content_hash", "id").join(hashes, "content_hash", "left_semi")
    ids = labelled.groupBy("content_hash").agg(F.max("id").alias("chunk_id"))
    return hashes.join(ids, "content_hash", "left")


def relevant_of(items: DataFrame) -> DataFrame:
    """Distinct (query_id, content_hash) labels."""
    return items.select(
        F.col("id").alias("query_id"), F.explode("source_chunk_content_hashes").alias("content_hash")
    ).distinct()


def recall_at_k(ranked: DataFrame, relevant: DataFrame, ks: list[int], item: str = "content_hash") -> DataFrame:
    """(query_id, recall_at_<k>..., mrr, n_relevant) for every question with labels.

    ``ranked`` is (query_id, rank, item), ``relevant`` distinct (query_id, item). Labels that are not
    in the index stay in the denominator.
    """
    first = ranked.groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    j = relevant.join(first, ["query_id", item], "left")
    return j.groupBy("query_id").agg(
        *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        F.count("*").alias("n_relevant"),
    )


def mrr(ranked: DataFrame, relevant: DataFrame, item: str = "content_hash") -> DataFrame:
    return recall_at_k(ranked, relevant, [], item).select("query_id", "mrr")


def retrieval_ablation(
    ranked: DataFrame,
    relevant: DataFrame,
    questions: DataFrame,
    configs: tuple[str, ...] = ("dense", "hybrid", "hybrid+rerank"),
    ks: tuple[int, ...] = (5, 10, 30),
    item: str = "content_hash",
) -> DataFrame:
    """Mean metrics per config overall (``type`` null) and per question type.

    ``ranked`` is (config, query_id, rank, item); only answerable questions with labels count.
    """
    asked = questions.filter("type <> 'unanswerable'").select("query_id", "type")
    # every config is scored on every question, also where it found nothing
    rel = relevant.join(asked, "query_id").withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    first = ranked.groupBy("config", "query_id", item).agg(F.min("rank").alias("rank"))
    per = (
        rel.join(first, ["config", "query_id", item], "left")
        .groupBy("config", "query_id", "type")
        .agg(
            *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"r{k}") for k in ks],
            F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"),
        )
    )
    return (
        per.groupingSets([["config"], ["config", "type"]], "config", "type")
        .agg(
            *[F.avg(f"r{k}").alias(f"recall_at_{k}") for k in ks],
            F.avg("rr").alias("mrr"),
            F.count("*").alias("n"),
        )
    )


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def abstention_scores(answers: DataFrame, should: str = "should_abstain", did: str = "abstained") -> DataFrame:
    """Abstaining is the positive class."""
    s, d = F.col(should), F.col(did)
    counts = answers.agg(
        F.count_if(s & d).alias("tp"),
        F.count_if(~s & d).alias("fp"),
        F.count_if(s & ~d).alias("fn"),
        F.count_if(s).alias("unanswerable"),
        F.count_if(~s).alias("answerable"),
    )
    prf = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        *[c.alias(n) for n, c in prf.items()],
        ratio(F.col("fn"), F.col("unanswerable")).alias("hallucination_rate"),
        ratio(F.col("fp"), F.col("answerable")).alias("false_abstention_rate"),
    )


def percent_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(mean_or_zero((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def judge_agreement(pairs: DataFrame, a: str, b: str, by: str | None = None, threshold: float = 0.8) -> DataFrame:
    """n, agreement and Cohen's kappa of two raters, overall and per value of ``by`` (null = overall).

    The pairs are first counted into the contingency table, which has labels x labels rows however
    many pairs there are; everything else works on that.
    """
    cols = [by] if by else []
    table = (
        pairs.groupBy(*cols, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    )
    if by:
        whole = table.groupBy("_a", "_b").agg(F.sum("_n").alias("_n")).withColumn(by, F.lit(None).cast(table.schema[by].dataType))
        table = whole.withColumn("_set", F.lit(0)).unionByName(table.withColumn("_set", F.lit(1)))
    else:
        table = table.withColumn("_set", F.lit(0))
    keys = ["_set", *cols]
    # each cell counts once for the label of either rater
    none = F.lit(0).cast("long")
    equal = F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(none)
    by_label = F.explode(
        F.array(
            F.struct(F.col("_a").alias("_l"), F.col("_n").alias("_ca"), none.alias("_cb"), equal.alias("_eq")),
            F.struct(F.col("_b").alias("_l"), none.alias("_ca"), F.col("_n").alias("_cb"), none.alias("_eq")),
        )
    )
    marg = (
        table.select(*keys, by_label.alias("_m"))
        .groupBy(*keys, "_m._l")
        .agg(*[F.sum(f"_m.{c}").alias(c) for c in ("_ca", "_cb", "_eq")])
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_ca").cast("double") * F.col("_cb")).alias("_cross"),
            F.sum("_ca").alias("n"),
            F.sum("_eq").alias("_same"),
        )
    )
    po = F.col("_same") / F.col("n")
    pe = F.col("_cross") / (F.col("n").cast("double") * F.col("n"))
    return marg.select(
        *cols,
        F.col("n"),
        po.alias("agreement"),
        F.when(pe == 1.0, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"),
        (po >= threshold).alias("trusted"),
    )


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    out = judge_agreement(pairs, a, b).agg(F.max("kappa").alias("kappa"))
    return out.select(F.coalesce("kappa", F.lit(0.0)).alias("kappa"))


def nearest_rank_percentile(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """p<p> columns: sorted[round half even of p/100 * (n-1)] per group; without keys one row, 0 where there are no values."""
    names = {f"p{p:g}": nearest_rank(p) for p in ps}
    out = order_statistics(df, keys, value, names)
    return out if keys else out.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])


def per_question(
    items: DataFrame, answers: DataFrame, verdicts: DataFrame, cited: DataFrame | None = None, k: int = 5
) -> DataFrame:
    """One row per question: judge scores side by side, abstention, latency, recall of cited hashes.

    ``verdicts`` is (query_id, judge, score); ``cited`` (query_id, rank, content_hash).
    """
    judges = ["faithfulness", "relevance", "groundedness"]
    scores = verdicts.groupBy("query_id").pivot("judge", judges).agg(F.first("score"))
    q = items.select(F.col("id").alias("query_id"), "type", "chapter", "question")
    out = q.join(answers.select("query_id", "abstained", "latency_ms"), "query_id", "left").join(
        scores, "query_id", "left"
    )
    if cited is not None:
        r = recall_at_k(cited, relevant_of(items), [k]).select(
            "query_id", F.col(f"recall_at_{k}").alias("recall_cited")
        )
        out = out.join(r, "query_id", "left")
    return out


def generation_summary(per_q: DataFrame) -> DataFrame:
    """Means and pass rates (score >= 4), overall (type null) and per type, with latency percentiles overall."""
    def mean(c: str) -> Column:
        answered = F.when(F.col("type") != "unanswerable", F.col(c)) if c != "groundedness" else F.col(c)
        return mean_or_zero(answered.cast("double")).alias(f"{c}_mean")

    def passed(c: str) -> Column:
        answered = F.when(F.col("type") != "unanswerable", F.col(c)) if c != "groundedness" else F.col(c)
        ok = F.when(answered.isNotNull(), (answered >= 4).cast("double"))
        return mean_or_zero(ok).alias(f"{c}_pass_rate")

    names = ["faithfulness", "relevance", "groundedness"]
    agg = [F.count("*").alias("n")] + [f(c) for c in names for f in (mean, passed)]
    agg.append(mean_or_zero(F.col("abstained").cast("double")).alias("abstention_rate"))
    # grouping sets null out the key, so the type that the aggregates read is a second column
    src = per_q.withColumn("by_type", F.col("type"))
    rows = src.groupingSets([[], ["by_type"]], "by_type").agg(*agg).withColumnRenamed("by_type", "type")
    lat = nearest_rank_percentile(per_q.filter("latency_ms <> 0"), [], "latency_ms", [50, 90, 99])
    one = lat.withColumn("_all", F.lit(True))
    return rows.withColumn("_all", F.col("type").isNull()).join(one, "_all", "left").drop("_all")


def eval_report(
    run_id: Column,
    meta: dict[str, Column],
    items: DataFrame,
    retrieval: DataFrame,
    summary: DataFrame,
    agreement: DataFrame,
    per_q: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(one nested row of run data, per-question rows): the questions stay a table of their own because
    their number grows; the report row holds only summaries."""
    one = F.lit(1).alias("_one")
    base = items.agg(
        F.count("*").alias("golden_count"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("single", "multi", "unanswerable")],
    ).select("*", one)
    r = retrieval.agg(F.sort_array(F.collect_list(F.struct(*retrieval.columns))).alias("retrieval")).select("*", one)
    g = summary.agg(F.sort_array(F.collect_list(F.struct("type", *[c for c in summary.columns if c != "type"]))).alias("generation")).select("*", one)
    a = agreement.agg(F.sort_array(F.collect_list(F.struct(*agreement.columns))).alias("judge_agreement")).select("*", one)
    row = base.join(r, "_one").join(g, "_one").join(a, "_one").drop("_one")
    return (
        row.select(run_id.alias("run_id"), *[c.alias(n) for n, c in meta.items()], "*"),
        per_q.select(run_id.alias("run_id"), "*"),
    )
