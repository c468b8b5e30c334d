"""Keeping the chunk table current: deduplicate, diff, remap labels, copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_by_hash(chunks: DataFrame, key: str = "content_hash", order: str = "id") -> DataFrame:
    """One row per hash: the one with the greatest ``order`` (last wins).

    Only (hash, id) pairs are aggregated, with map-side combine, so a text that a third of all rows
    repeat costs one pair per map task; the wide rows then meet the winners on the unique id.
    """
    winners = chunks.groupBy(key).agg(F.max(order).alias(order)).select(order)
    return chunks.join(winners, order, "left_semi")


def diff_status(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(content_hash, status, previous_sha) for the union of both tables' hashes."""
    cur = current.groupBy("content_hash").agg(F.min("commit_sha").alias("previous_sha"))
    new = incoming.select("content_hash").distinct().withColumn("_new", F.lit(True))
    status = (
        F.when(F.col("_new").isNull(), "removed").when(F.col("previous_sha").isNull(), "added").otherwise("unchanged")
    )
    return cur.join(new, "content_hash", "full_outer").select("content_hash", status.alias("status"), "previous_sha")


#: Columns that the chunk table decides; the others tell where a text stands in the load.
KEPT = ("id", "content_hash", "text", "embedding", "commit_sha")


def split_load(
    current: DataFrame, incoming: DataFrame, commit_sha: str, refresh_provenance: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(unchanged rows under the new commit, added rows without an embedding), in the columns of ``current``.

    Status is told by hashes alone: one (hash, greatest id) per text of the load. Unchanged rows are a semi-join of the
    current table by hash, so a table bucketed by ``content_hash`` (``writers.write_bucketed``) is read in place and
    neither its texts nor its embeddings are shuffled. Wide rows of the load are fetched for added hashes only.
    ``refresh_provenance`` takes the columns outside ``KEPT`` from the load. Rows without a hash take no part; repeated
    hashes of the load count once (the last id); an empty table on either side is all added or all gone.
    """
    place = [c for c in current.columns if c not in KEPT] if refresh_provenance else []
    pick = [F.max("id").alias("id")]
    if place:
        pick.append(F.max_by(F.struct(*place), "id").alias("_place"))
    new = incoming.filter("content_hash is not null").groupBy("content_hash").agg(*pick)
    if place:
        kept = current.drop(*place).join(new.drop("id"), "content_hash").select("*", "_place.*").drop("_place")
    else:
        kept = current.join(new.select("content_hash"), "content_hash", "left_semi")
    kept = kept.withColumn("commit_sha", F.lit(commit_sha)).select(*current.columns)
    added = new.select("content_hash", "id").join(current.select("content_hash"), "content_hash", "left_anti")
    fresh = incoming.join(added, ["id", "content_hash"], "left_semi").withColumn("commit_sha", F.lit(commit_sha))
    if "embedding" in current.columns and "embedding" not in incoming.columns:
        fresh = fresh.withColumn("embedding", F.lit(None).cast(current.schema["embedding"].dataType))
    return kept, fresh.select(*current.columns)


def diff_load(current: DataFrame, incoming: DataFrame, commit_sha: str, refresh_provenance: bool = False) -> DataFrame:
    """The next version of the chunk table: see ``split_load``. Unchanged rows keep id and embedding; removed rows go."""
    kept, added = split_load(current, incoming, commit_sha, refresh_provenance)
    return kept.unionByName(added)


def next_version(
    current: DataFrame, incoming: DataFrame, commit_sha: str, table: str, path: str, buckets: int, refresh_provenance: bool = False
) -> DataFrame:
    """``diff_load`` written as the new table ``table`` at ``path``, bucketed like ``current``.

    Unchanged rows go from bucket to bucket without a shuffle, then the added ones are shuffled alone and appended. The
    version counts once this returns; after a failure it is written anew under another name.
    """
    from marginalia.sources import writers

    kept, added = split_load(current, incoming, commit_sha, refresh_provenance)
    writers.write_bucketed(kept, table, path, buckets, in_place=True)
    return writers.append_bucketed(added, table, path, buckets)


def diff_summary(current: DataFrame, incoming: DataFrame) -> DataFrame:
    st = diff_status(current, incoming)
    return st.agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.min("previous_sha").alias("previous_sha"),
    )


def span_overlap_remap(old: DataFrame, new: DataFrame, hashes: DataFrame, width: int = 4096) -> DataFrame:
    """(old_hash, new_hash or null) for each labelled hash of (content_hash).

    A hash still present maps to itself. Otherwise the new chunk of the same file with the largest
    positive overlap wins (earliest start, then smallest hash on ties). Spans are cut into
    fixed-width bins, so a pair meets only where both lie in one bin of one file: a file that holds a
    third of all chunks is spread over its bins, and no file is joined with itself as a whole.
    """
    labels = hashes.select(F.col("content_hash").alias("old_hash")).distinct()
    present = new.select(F.col("content_hash").alias("old_hash")).distinct().withColumn("_here", F.lit(True))
    known = labels.join(present, "old_hash", "left")
    # a text occurring twice is one old place: the last one, as in a keyed lookup
    spans = old.groupBy(F.col("content_hash").alias("old_hash")).agg(
        F.max(F.struct("source_file", "char_start", "char_end")).alias("o")
    )
    gone = known.filter("_here is null").join(spans, "old_hash").select("old_hash", "o.*")

    def bins(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("char_end") - 1, F.col("char_start"))
        return df.withColumn(
            "bin", F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor(last / width)))
        )

    n = bins(
        new.select(
            F.col("content_hash").alias("new_hash"), "source_file", "char_start", "char_end"
        )
    ).select("new_hash", "source_file", "bin", F.col("char_start").alias("ns"), F.col("char_end").alias("ne"))
    overlap = F.least("char_end", "ne") - F.greatest("char_start", "ns")
    meet = (
        bins(gone)
        .join(n, ["source_file", "bin"])
        .withColumn("overlap", overlap)
        # each overlapping pair is looked at in its first common bin only
        .filter((F.col("overlap") > 0) & (F.floor(F.greatest("char_start", "ns") / width) == F.col("bin")))
    )
    best = meet.groupBy("old_hash").agg(
        F.min_by("new_hash", F.struct(-F.col("overlap"), "ns", "new_hash")).alias("best")
    )
    return known.join(best, "old_hash", "left").select(
        "old_hash", F.when(F.col("_here"), F.col("old_hash")).otherwise(F.col("best")).alias("new_hash")
    )


def apply_remap(items: DataFrame, mapping: DataFrame, array_col: str = "source_chunk_content_hashes") -> DataFrame:
    """Rewrite each item's label array through the mapping; labels without a target are dropped and counted."""
    each = items.select("id", F.posexplode(array_col).alias("pos", "old_hash"))
    out = (
        each.join(mapping, "old_hash", "left")
        .groupBy("id")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("new_hash").isNotNull(), F.struct("pos", "new_hash")))),
                lambda x: x["new_hash"],
            ).alias("_new"),
            F.count_if(F.col("new_hash").isNull()).alias("lost"),
        )
    )
    return (
        items.join(out, "id", "left")
        .withColumn(array_col, F.coalesce("_new", F.array().cast("array<string>")))
        .withColumn("lost", F.coalesce("lost", F.lit(0)))
        .drop("_new")
    )


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.min("commit_sha").alias("commit_sha"), F.count("*").alias("chunks"))


def lookup_chunk(chunks: DataFrame, id: int | None = None, content_hash: str | None = None) -> DataFrame:
    """Point lookup; both forms reach the Parquet scan as pushed filters."""
    if id is not None:
        return chunks.filter(F.col("id") == id)
    return chunks.filter(F.col("content_hash") == content_hash)


def lookup_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks for a table of ids, however large."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def validate_questions(questions: DataFrame) -> DataFrame:
    """Add ``reason``: null for an acceptable row, else the first rule it breaks."""
    n = F.length("question")
    reason = (
        F.when(F.col("question").isNull() | (n < 1), "question_too_short")
        .when(n > 2000, "question_too_long")
        .when(~F.coalesce(F.col("top_k").between(1, 10), F.lit(True)), "top_k_out_of_range")
        .when(~F.coalesce(F.col("mode").isin("hybrid", "dense"), F.lit(True)), "unknown_mode")
    )
    return questions.withColumn("reason", reason)


def guard_content(
    files: DataFrame,
    globs: list[str] | None = None,
    tripwires: list[str] | None = None,
    max_bytes: int | None = None,
    suffix: str | None = None,
    allowed_prefix: str | None = None,
) -> DataFrame:
    """(path, size, content) to one row per broken rule. The rules are a fixed short list held in the plan."""
    from marginalia.functions import fixed_values as fv

    globs = fv.GUARD_BLOCKED_GLOBS if globs is None else globs
    tripwires = fv.GUARD_TRIPWIRES if tripwires is None else tripwires
    max_bytes = fv.GUARD_MAX_BYTES if max_bytes is None else max_bytes
    suffix = fv.GUARD_SOURCE_SUFFIX if suffix is None else suffix
    allowed_prefix = fv.GUARD_ALLOWED_PREFIX if allowed_prefix is None else allowed_prefix

    def glob_regex(g: str) -> str:
        esc = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in g)
        return f"(?s)^{esc}$"

    rules = [F.when(F.col("path").rlike(glob_regex(g)), F.lit(f"glob:{g}")) for g in globs]
    rules.append(
        F.when(F.col("path").endswith(suffix) & ~F.col("path").startswith(allowed_prefix), F.lit("suffix:" + suffix))
    )
    rules.append(F.when(F.col("size") > max_bytes, F.lit("size")))
    rules += [F.when(F.col("content").contains(t), F.lit(f"tripwire:{t}")) for t in tripwires]
    return files.select("path", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
