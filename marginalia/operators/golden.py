"""Building and checking the verified question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.functions import fixed_values as fv
from marginalia.operators.judging import fill

MIN_SAMPLE_TOKENS = 200
CANDIDATE_TEMPLATES = {
    "single": (
        '<passage heading="{heading}">\n{text}\n</passage>\n\nWrite one self-contained question that this passage '
        'answers, with 2-4 paraphrased key points. Reply with JSON only: {"question": "...", "key_points": ["..."]}'
    ),
    "multi": (
        '<passage_1 heading="{heading}">\n{text}\n</passage_1>\n<passage_2 heading="{heading2}">\n{text2}\n'
        "</passage_2>\n\nWrite one self-contained question that needs both passages, with 2-4 paraphrased key points. "
        'Reply with JSON only: {"question": "...", "key_points": ["..."]}'
    ),
    "unanswerable": (
        '<passage heading="{heading}">\n{text}\n</passage>\n\nWrite one plausible question close to this passage that '
        'it does not answer. Reply with JSON only: {"question": "...", "why_unanswerable": "..."}'
    ),
}


def seeded(id: Column, seed: int | str) -> Column:
    """Random but repeatable sort key, the same in any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id.cast("string")))


def sample_chunks(chunks: DataFrame, n: int, seed: int, min_tokens: int = MIN_SAMPLE_TOKENS) -> DataFrame:
    """n chunks at random, hence spread over chapters as the chunks are; each task keeps its n smallest keys."""
    return (
        chunks.filter(F.col("token_count") >= min_tokens)
        .withColumn("sample_key", seeded(F.col("id"), seed))
        .orderBy("sample_key", "id")
        .limit(n)
    )


def assign_question_types(sample: DataFrame, n: int) -> DataFrame:
    """Types by position in the sample: 60 % single, 30 % multi, the rest unanswerable. At most n rows."""
    pos = F.row_number().over(W.orderBy("sample_key", "id")) - 1
    cut1 = round(n * 0.6)
    cut2 = cut1 + round(n * 0.3)
    number = F.col("pos").cast("string")  # padded to three digits, never cut
    kind = F.when(F.col("pos") < cut1, "single").when(F.col("pos") < cut2, "multi").otherwise("unanswerable")
    return (
        sample.withColumn("pos", pos)
        .withColumn("type", kind)
        .withColumn("item_id", F.concat(F.lit("g"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))))
        .withColumn(
            "chapter",
            F.concat(F.lit("vol"), F.col("volume").cast("string"), F.lit("/ch"), F.col("chapter_num").cast("string")),
        )
    )


def pick_sibling(
    typed: DataFrame, chunks: DataFrame, seed: int, min_tokens: int = MIN_SAMPLE_TOKENS, digits: int = 3
) -> DataFrame:
    """(item_id, sibling_id): for each multi sample another long chunk of its chapter.

    Chunks of a chapter stand in a ring by seeded key; the sibling is the next one on the ring, so samples of one chapter
    get different partners. Chunks and samples are merged: sorted together, each takes the chunk that follows it. Keys are
    hex digits at random, so their first ``digits`` cut the ring of a chapter, however large, into even arcs that are
    sorted by themselves; the first chunks of the arcs (at most 16^digits a chapter) carry over to the arcs before.
    Samples need not be among the chunks; a chapter without another chunk gives none, samples without one drop out.
    """
    chapter, place = ["volume", "chapter_num"], F.struct("key", F.col("id").alias("sibling_id"))

    def keyed(df: DataFrame) -> DataFrame:
        key = seeded(F.col("id"), seed)
        return df.withColumn("key", key).withColumn("arc", F.substring(key, 1, digits))

    ring = keyed(chunks.filter(F.col("token_count") >= min_tokens).select(*chapter, "id"))
    asked = keyed(typed.filter("type = 'multi'").select("item_id", *chapter, "id"))
    both = ring.unionByName(asked, allowMissingColumns=True).withColumn(
        "chunk", F.when(F.col("item_id").isNull(), place)
    )
    # from the end of an arc to its start; a sample stands before its own chunk, so that what it has seen lies behind it
    back = W.partitionBy(*chapter, "arc").orderBy(F.desc("key"), F.desc("id"), F.col("item_id").desc_nulls_last())
    seen = F.last("chunk", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    here = both.withColumn("seen", seen).filter("item_id is not null").select("item_id", *chapter, "arc", "id", "seen")
    heads = both.groupBy(*chapter, "arc").agg(F.min("chunk").alias("head"))
    arcs = W.partitionBy(*chapter).orderBy("arc")
    follow = F.coalesce(
        F.first("head", ignorenulls=True).over(arcs.rowsBetween(1, W.unboundedFollowing)),
        F.min("head").over(W.partitionBy(*chapter)),  # round the ring
    )
    heads = heads.select(*chapter, "arc", follow.alias("follow"))
    return (
        here.join(heads, [*chapter, "arc"])
        .select("item_id", "id", F.coalesce("seen", "follow")["sibling_id"].alias("sibling_id"))
        .filter("sibling_id is not null and sibling_id <> id")
        .select("item_id", "sibling_id")
    )


def candidate_prompts(typed: DataFrame, siblings: DataFrame, chunks: DataFrame, templates: dict[str, str] = CANDIDATE_TEMPLATES) -> DataFrame:
    """(item_id, type, chapter, prompt, hashes): filled templates; multi samples without a sibling drop out."""
    sib = siblings.join(
        chunks.select(
            F.col("id").alias("sibling_id"),
            F.col("heading_path").alias("heading2"),
            F.col("text").alias("text2"),
            F.col("content_hash").alias("hash2"),
        ),
        "sibling_id",
    )
    rows = typed.join(sib, "item_id", "left").filter("type <> 'multi' or sibling_id is not null")
    values = {k: F.col(c) for k, c in {"heading": "heading_path", "text": "text", "heading2": "heading2", "text2": "text2"}.items()}
    prompt = None
    for kind, t in templates.items():
        cond = F.col("type") == kind
        prompt = F.when(cond, fill(t, **values)) if prompt is None else prompt.when(cond, fill(t, **values))
    hashes = (
        F.when(F.col("type") == "single", F.array("content_hash"))
        .when(F.col("type") == "multi", F.array("content_hash", "hash2"))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select("item_id", "type", "chapter", prompt.alias("prompt"), hashes.alias("source_chunk_content_hashes"))


def parse_candidates(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Question, key points and notes from model replies; replies without a question are skipped."""
    obj = F.from_json(
        F.regexp_extract(raw, fv.P_JSON_SPAN, 0),
        "question string, key_points array<string>, why_unanswerable string",
    )
    return (
        replies.withColumn("_o", obj)
        .filter("_o.question is not null")
        .withColumns(
            {
                "question": F.col("_o.question"),
                "answer_key_points": F.coalesce("_o.key_points", F.array().cast("array<string>")),
                "notes": F.coalesce("_o.why_unanswerable", F.lit("")),
            }
        )
        .drop("_o", raw)
    )


def pending_review(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    return candidates.join(golden.select("id"), "id", "left_anti")


def golden_stats(items: DataFrame) -> DataFrame:
    """Counts in total (both null), by type and by chapter."""
    return items.groupingSets([[], ["type"], ["chapter"]], "type", "chapter").agg(F.count("*").alias("n"))


def fingerprint(items: DataFrame) -> DataFrame:
    """One order-free fingerprint of a table of items: the SHA-256 over exact sums of the parts of per-row SHA-256s.

    Used where the set is a directory of part files; a single file is fingerprinted by its bytes.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return items.agg(
        F.count("*").alias("n"),
        F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256).alias("fingerprint"),
    )


def golden_stamp(items: DataFrame, verifier: str = "owner") -> DataFrame:
    """Fingerprint and counts by type; stored when a review ends."""
    by_type = items.agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in ("single", "multi", "unanswerable")]
    ).withColumn("_one", F.lit(1))
    return (
        fingerprint(items)
        .withColumn("_one", F.lit(1))
        .join(by_type, "_one")
        .drop("_one")
        .withColumn("verifier", F.lit(verifier))
    )


def golden_gate(items: DataFrame, stamp: DataFrame) -> DataFrame:
    """Violations (rule, item_id): empty when the set is unchanged since its stamp and fully verified."""
    now = fingerprint(items).withColumn("_one", F.lit(1))
    then = stamp.select(F.col("fingerprint").alias("stamped"), F.lit(1).alias("_one"))
    changed = (
        now.join(then, "_one", "left")
        .filter(F.col("stamped").isNull() | (F.col("stamped") != F.col("fingerprint")))
        .select(
            F.when(F.col("stamped").isNull(), "no stamp").otherwise("changed since verification").alias("rule"),
            F.lit(None).cast("string").alias("item_id"),
        )
    )
    unverified = items.filter(~F.coalesce("verified", F.lit(False))).select(
        F.lit("not verified").alias("rule"), F.col("id").cast("string").alias("item_id")
    )
    return changed.unionByName(unverified)
