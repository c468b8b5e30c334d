"""Judge prompts, a deterministic lexical judge, and verdict parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.operators.assembly import ordered

REPLY = 'Reply with JSON only: {"score": 1-5, "pass": true or false, "rationale": "one sentence"}'
TEMPLATES = {
    "faithfulness": (
        "<context>\n{context}\n</context>\n\n<question>{question}</question>\n<answer>{answer}</answer>\n\n"
        "Is every claim of the answer backed by the context? " + REPLY
    ),
    "relevance": (
        "<question>{question}</question>\n<answer>{answer}</answer>\n<key_points>{key_points}</key_points>\n\n"
        "Does the answer meet the question and its key points? " + REPLY
    ),
    "groundedness": (
        "<context>\n{context}\n</context>\n\n<question>{question}</question>\n<answer>{answer}</answer>\n"
        "<expected_behavior>{expected}</expected_behavior>\n\n"
        "Did the answer keep to the context, or decline where the context has nothing? " + REPLY
    ),
}


def fill(template: str, **values: Column) -> Column:
    """Put columns into the {named} places of a template."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)], F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def context_text(reranked_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, reranked_ids) to (query_id, context, context_hashes): numbered blocks in rank order.

    Ids without a chunk are left out and the others numbered on.
    """
    each = reranked_ids.select("query_id", F.posexplode("reranked_ids").alias("pos", "id"))
    found = each.join(chunks.select("id", "heading_path", "text", "content_hash"), "id")
    per = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "heading_path", "text", "content_hash"))).alias("b")
    )
    block = lambda x, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] ("), x["heading_path"], F.lit(")\n"), x["text"]
    )
    return per.select(
        "query_id",
        F.array_join(F.transform("b", block), "\n\n").alias("context"),
        F.transform("b", lambda x: x["content_hash"]).alias("context_hashes"),
    )


def judge_plan(answers: DataFrame) -> DataFrame:
    """One row per (answer, judge): unanswerable questions are audited for groundedness only."""
    judges = F.when(F.col("type") == "unanswerable", F.array(F.lit("groundedness"))).otherwise(
        F.array(*[F.lit(x) for x in ("groundedness", "faithfulness", "relevance")])
    )
    return answers.withColumn("judge", F.explode(judges)).withColumn(
        "expects_abstention", F.col("type") == "unanswerable"
    )


def judge_prompts(plan: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Add ``prompt`` to (question, answer, context, key_points, expects_abstention, judge) rows."""
    expected = F.when(F.col("expects_abstention"), "abstain: the book does not cover this").otherwise(
        "answer from the context"
    )
    values = {
        "context": F.col("context"),
        "question": F.col("question"),
        "answer": F.col("answer"),
        "key_points": F.array_join("key_points", "; "),
        "expected": expected,
    }
    prompt = None
    for name, t in templates.items():
        cond = F.col("judge") == name
        prompt = F.when(cond, fill(t, **values)) if prompt is None else prompt.when(cond, fill(t, **values))
    return plan.withColumn("prompt", prompt)


def lexical_score(answer: Column, evidence: Column, expects_abstention: Column) -> Column:
    """5 / 3 / 1 by the share of the answer's words found in the evidence; an abstaining answer scores
    5 where that was expected and 2 elsewhere."""
    a = F.array_distinct(tx.words(answer))
    share = F.size(F.array_intersect(a, tx.words(evidence))) / F.greatest(F.size(a), F.lit(1))
    by_share = F.when(share > 0.6, 5).when(share > 0.3, 3).otherwise(1)
    abstains = F.lower(answer).contains("does not appear to cover")
    return F.when(abstains, F.when(expects_abstention, 5).otherwise(2)).otherwise(by_share)


def judge_lexical(plan: DataFrame) -> DataFrame:
    """Scores by word overlap with the context, or with the key points for relevance."""
    evidence = F.when(F.col("judge") == "relevance", F.array_join("key_points", "; ")).otherwise(
        F.coalesce("context", F.lit(""))
    )
    score = lexical_score(F.col("answer"), evidence, F.col("expects_abstention"))
    return plan.withColumn("score", score).withColumn("passed", F.col("score") >= 4)


Judge = Callable[[], Callable[[list[str]], list[str]]]


def judge_model(prompts: DataFrame, loader: Judge, keys: list[str]) -> DataFrame:
    """(keys..., raw): replies of a model loaded once per task to batches of prompts."""
    out = prompts.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", raw string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            res = pdf[keys].copy()
            res["raw"] = model(list(pdf["prompt"]))
            yield res

    return prompts.select(*keys, "prompt").mapInPandas(run, schema)


def parse_verdict(raw: Column) -> Column:
    """Model reply to struct(score, passed, rationale); anything unreadable scores 1 and fails.

    A score may be a number (cut to its whole part), a boolean or a text of digits; a missing one counts as 1. A given
    pass counts by its truth: null, 0, false and empty values fail; a missing one follows from the score.
    """
    span = F.regexp_extract(raw, fv.P_JSON_SPAN, 0)
    obj = F.from_json(span, "score string, pass string, rationale string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    value = F.try_parse_json(span)
    kind = {k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) for k in ("score", "pass")}
    number = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    digits = F.when(obj["score"].rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(obj["score"]).try_cast("int"))
    num = (
        F.when(kind["score"].isNull(), 1)
        .when(kind["score"] == "STRING", digits)
        .when(kind["score"] == "BOOLEAN", (obj["score"] == "true").cast("int"))
        .when(kind["score"].rlike(number), obj["score"].try_cast("double").cast("int"))
    )
    passed = (
        F.when(kind["pass"].isNull(), num >= 4)
        .when(kind["pass"] == "VOID", False)
        .when(kind["pass"] == "STRING", obj["pass"] != "")
        .when(kind["pass"] == "BOOLEAN", obj["pass"] == "true")
        .when(kind["pass"].rlike(number), obj["pass"].try_cast("double") != 0)
        .otherwise(~obj["pass"].isin("{}", "[]"))
    )
    bad = (span == "") | value.isNull() | obj.isNull() | obj["_bad"].isNotNull() | num.isNull()
    return F.when(
        bad,
        F.struct(
            F.lit(1).alias("score"),
            F.lit(False).alias("passed"),
            F.when(span == "", "unparseable judge output").otherwise("invalid judge JSON").alias("rationale"),
        ),
    ).otherwise(
        F.struct(
            num.alias("score"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
            F.coalesce(obj["rationale"], F.lit("")).alias("rationale"),
        )
    )


def drift_sample(query_log: DataFrame, judge_scores: DataFrame, as_of: Column, n: int, seed: str = "drift") -> DataFrame:
    """Up to n recent, answered, error-free rows not judged yet, in a seeded random order (top-n, no full sort)."""
    recent = query_log.filter(
        (F.col("finished_at") > as_of - F.expr("INTERVAL '24' HOUR"))
        & F.col("error").isNull()
        & F.col("answer").isNotNull()
    )
    judged = judge_scores.select(F.col("query_log_id").alias("id"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string")))
    return recent.join(judged, "id", "left_anti").orderBy(order, "id").limit(n)


def lexical_verdicts(prompts: DataFrame) -> DataFrame:
    """(query_id, judge, score, passed, rationale) by word overlap."""
    v = judge_lexical(prompts)
    return v.select("query_id", "judge", "score", "passed", F.concat(F.lit("score="), F.col("score").cast("string")).alias("rationale"))


def model_verdicts(loader: Judge) -> Callable[[DataFrame], DataFrame]:
    """The same from the replies of a model."""

    def run(prompts: DataFrame) -> DataFrame:
        raw = judge_model(prompts, loader, ["query_id", "judge"])
        return raw.select("query_id", "judge", parse_verdict(F.col("raw")).alias("v")).select("query_id", "judge", "v.*")

    return run


def drift_scores(
    sample: DataFrame,
    chunks: DataFrame,
    judge_name: str = "lexical",
    as_of: Column | None = None,
    judge: Callable[[DataFrame], DataFrame] = lexical_verdicts,
) -> DataFrame:
    """judge_scores rows of sampled answers: scores over 5, flagged unless both judges pass.

    ``judge`` turns prompt rows (two an answer: groundedness, faithfulness) into verdicts: ``lexical_verdicts`` or
    ``model_verdicts(loader)``. An answer that it leaves without a verdict has no score and is flagged.
    """
    rows = sample.select(F.col("id").alias("query_id"), "question", "answer", "reranked_ids")
    ctx = context_text(rows.select("query_id", "reranked_ids"), chunks)
    plan = (
        rows.join(ctx, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn("key_points", F.array().cast("array<string>"))
        .withColumn("judge", F.explode(F.array(F.lit("groundedness"), F.lit("faithfulness"))))
        .withColumn("expects_abstention", F.col("judge") == "groundedness")  # the nightly prompt allows abstaining
    )
    verdict = F.struct("score", "passed", "rationale")
    of = lambda name: F.max(F.when(F.col("judge") == name, verdict))
    both = judge(judge_prompts(plan)).groupBy("query_id").agg(of("groundedness").alias("g"), of("faithfulness").alias("f"))
    return rows.select("query_id").join(both, "query_id", "left").select(
        F.col("query_id").alias("query_log_id"),
        (as_of if as_of is not None else F.lit(None).cast("timestamp")).alias("judged_at"),
        F.lit(judge_name).alias("judge_model"),
        (F.col("f.score") / 5).cast("float").alias("faithfulness"),
        F.lit(None).cast("float").alias("relevance"),
        (F.col("g.score") / 5).cast("float").alias("groundedness"),
        (~(F.coalesce("g.passed", F.lit(False)) & F.coalesce("f.passed", F.lit(False)))).alias("flagged"),
        F.concat(F.lit("g: "), F.coalesce("g.rationale", F.lit("")), F.lit(" | f: "), F.coalesce("f.rationale", F.lit(""))).alias("rationale"),
    )
