"""From ranked chunks to citations, prompts, answers and log rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx

SYSTEM_TEMPLATE = (
    "You help readers study one textbook. Use only the numbered context blocks and cite them as [n]. "
    f'If they do not answer the question, begin with "{fv.ABSTAIN_PHRASE}."'
)
USER_TEMPLATE = "Context blocks from the book:\n\n{context}\n\nQuestion: {question}"


def citations(reranked: DataFrame) -> DataFrame:
    """(query_id, n, id, ...) to citation rows with a short preview."""
    return reranked.select(
        "query_id",
        "n",
        F.col("id").alias("chunk_id"),
        "heading_path",
        "rerank_score",
        F.col("score").alias("fusion_score"),
        tx.preview(F.col("text")).alias("text_preview"),
    )


def ordered(struct: Column, pick: str) -> Column:
    """Values of one field in the order of the struct's first field; k rows per group at most."""
    return F.transform(F.sort_array(F.collect_list(struct)), lambda x: x[pick])


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def build_prompts(
    reranked: DataFrame, questions: DataFrame, system: str = SYSTEM_TEMPLATE, user: str = USER_TEMPLATE
) -> DataFrame:
    """(query_id, system, user): numbered blocks in rank order put into the templates."""
    block = _rstrip(
        F.concat(
            F.lit("["), F.col("n").cast("string"), F.lit("] ("), "heading_path", F.lit(")\n"), "text"
        )
    )
    context = reranked.groupBy("query_id").agg(
        F.array_join(ordered(F.struct("n", block.alias("b")), "b"), "\n\n").alias("context")
    )
    before, rest = user.split("{context}")
    middle, after = rest.split("{question}")
    return (
        questions.select("query_id", "question")
        .join(context, "query_id", "left")
        .select(
            "query_id",
            F.lit(system.strip()).alias("system"),
            tx.strip(
                F.concat(
                    F.lit(before),
                    F.coalesce("context", F.lit("")),
                    F.lit(middle),
                    tx.strip(F.col("question")),
                    F.lit(after),
                )
            ).alias("user"),
        )
    )


def sources_block(cites: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, sources): the list of sources under an answer, empty without citations."""
    line = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] "), "heading_path", F.lit(" (chunk "), "chunk_id", F.lit(")")
    )
    lists = cites.groupBy("query_id").agg(
        F.concat(
            F.lit("\n\n**Sources**\n"), F.array_join(ordered(F.struct("n", line.alias("l")), "l"), "\n")
        ).alias("sources")
    )
    return (
        questions.select("query_id")
        .join(lists, "query_id", "left")
        .withColumn("sources", F.coalesce("sources", F.lit("")))
    )


def message_text(content: Column) -> Column:
    """Plain content as it is; a JSON list of parts gives its text parts joined by a blank."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(content.startswith("[{"), F.coalesce(F.array_join(texts, " "), content)).otherwise(content)


def last_user_message(conversations: DataFrame) -> DataFrame:
    """(conv_id, question, error): the last non-empty user turn of each conversation."""
    users = (F.col("role") == "user") & (F.col("text") != "")
    return (
        conversations.groupBy("conv_id")
        .agg(F.max_by(F.when(users, F.col("text")), F.when(users, F.col("turn"))).alias("raw"))
        .select(
            "conv_id",
            message_text(F.col("raw")).alias("question"),
            F.when(F.col("raw").isNull(), "no user message").alias("error"),
        )
    )


def citation_markers(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """(query_id, n, chunk_id, times): which citations an answer names, and how often."""
    marks = (
        answers.select(
            "query_id", F.explode(F.regexp_extract_all("answer", F.lit(fv.P_CITATION_MARK), F.lit(1))).alias("m")
        )
        .groupBy("query_id", F.col("m").cast("int").alias("n"))
        .agg(F.count("*").alias("times"))
    )
    return marks.join(cites.select("query_id", "n", "chunk_id"), ["query_id", "n"])


def latency_overhead(total: Column, *stages: Column) -> Column:
    spent = stages[0]
    for s in stages[1:]:
        spent = spent + s
    return F.greatest(total - spent, F.lit(0.0))


def finish_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("truncated", F.coalesce(F.col("finish_reason") == "length", F.lit(False))).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("error")
    )


def canned_answers(prompts: DataFrame, answer: Column, max_tokens: int = 512) -> DataFrame:
    """Deterministic stand-in for a generator: a given answer with word-count usage."""
    n = F.size(F.split("answer", " "))
    return prompts.withColumn("answer", answer).select(
        "query_id",
        "answer",
        (F.size(tx.words(F.col("system"))) + F.size(tx.words(F.col("user")))).alias("prompt_tokens"),
        n.alias("completion_tokens"),
        F.when(n >= max_tokens, "length").otherwise("stop").alias("finish_reason"),
    )


Generator = Callable[[], Callable[[list[str], list[str]], list[tuple[str, int, int, str]]]]


def generate_answers(prompts: DataFrame, loader: Generator) -> DataFrame:
    """Answers from a model loaded once per task: (system, user) batches in, (answer, usage, finish) out."""
    schema = "query_id long, answer string, prompt_tokens int, completion_tokens int, finish_reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            out = model(list(pdf["system"]), list(pdf["user"]))
            res = pd.DataFrame(out, columns=["answer", "prompt_tokens", "completion_tokens", "finish_reason"])
            res.insert(0, "query_id", pdf["query_id"].to_numpy())
            yield res

    return prompts.select("query_id", "system", "user").mapInPandas(run, schema)


def build_log_rows(
    questions: DataFrame,
    fused: DataFrame,
    reranked: DataFrame,
    answers: DataFrame,
    null_missing: bool = False,
) -> DataFrame:
    """One log row per question with parallel id and score arrays in rank order.

    A missing rerank score is logged as 0 unless ``null_missing``.
    """
    score = F.col("rerank_score") if null_missing else F.coalesce("rerank_score", F.lit(0.0))
    f = fused.groupBy("query_id").agg(
        ordered(F.struct("position", "id"), "id").alias("fused_ids"),
        F.transform(ordered(F.struct("position", "score"), "score"), lambda x: x.cast("float")).alias("fused_scores"),
    )
    r = reranked.groupBy("query_id").agg(
        ordered(F.struct("n", "id"), "id").alias("reranked_ids"),
        F.transform(ordered(F.struct("n", score.alias("s")), "s"), lambda x: x.cast("float")).alias("rerank_scores"),
    )
    ids, scores = F.array().cast("array<bigint>"), F.array().cast("array<float>")
    return (
        questions.join(f, "query_id", "left")
        .join(r, "query_id", "left")
        .join(answers, "query_id", "left")
        .withColumn("question_hash", tx.question_hash(F.col("question")))
        .withColumn("abstained", tx.is_abstention(F.coalesce("answer", F.lit(""))))
        .withColumns(
            {
                "fused_ids": F.coalesce("fused_ids", ids),
                "fused_scores": F.coalesce("fused_scores", scores),
                "reranked_ids": F.coalesce("reranked_ids", ids),
                "rerank_scores": F.coalesce("rerank_scores", scores),
            }
        )
    )
