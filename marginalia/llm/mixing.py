"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. Within a source, documents in key order are
prefix-summed against the source's word budget: whole epochs come first, the remainder takes the front of that order.

Plan: one scan counts words and draws keys into a narrow table; per-source totals give the targets; prefix sums run in
two levels (key buckets of a source, then rows of a bucket), so that a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.frames import small
from marginalia.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A uniform number in (0, 1) that depends on id and seed only, so that reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to target: `share` of all words dealt by weight, none above `cap` times its source.

    Sources by code point, null last, take `weights` in turn. What a capped source cannot take is shared again by
    weight: in order of cap per weight, the level is that of the first source that the level does not fill. One row
    a source passes through the windows below.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", pick).withColumn("top", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    so_far, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("nth", F.row_number().over(by)).withColumn(
        "level",
        (float(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(so_far), F.lit(0.0)))
        / F.sum("w").over(rest),
    )
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("nth"))).over(every))
    s = s.withColumn("level", F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(every))
    return s.withColumn("target", F.least(F.col("top"), F.col("level") * F.col("w")))


def weight_classes(one: DataFrame) -> DataFrame:
    """(cs, classes) of each source: mean weight and share of its rows by power of two of their (positive) weight."""
    q = F.least("q", F.lit(1e300))
    c = one.where("q > 0").groupBy(F.col("source").alias("cs"), F.floor(F.log2(q)).alias("power"))
    c = c.agg(F.avg(q).alias("w"), F.count(F.lit(1)).alias("n"))
    c = c.groupBy("cs").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("w", "n"))).alias("each"))
    return c.select("cs", F.transform("each", lambda x: F.struct(x["w"].alias("w"), (x["n"] / F.col("all")).alias("p"))).alias("classes"))


def share_before(key: Column, classes: Column) -> Column:
    """The share of a source's keys that is expected below `key`: exponential keys, mixed over the classes of weights.

    It never falls as keys grow, so buckets cut by it are in key order whatever the classes are; they are about even for
    any mix of weights, as weights of a class differ by a factor of two at most.
    """
    mixed = F.aggregate(classes, F.lit(0.0), lambda acc, x: acc + x["p"] * (1 - F.exp(-key * x["w"])))
    return F.when(key == float("inf"), 1.0).otherwise(F.coalesce(mixed, F.lit(0.0)))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    bucket_rows: int = 50_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, draw_key, taken (words, repeats counted) of every row.

    quality: (doc_id, quality) with positive weights; ids it lacks, and null weights, count as 1; a weight that is not
    positive puts a document last. The document on the edge of the remainder is taken if that brings the source nearer
    to its target, so the words taken differ from it by half a document at most.
    Null or empty texts have size 0 and take 0. A null source is a source of its own, last in order. Rows that repeat
    an id draw the same key and are ordered by size; rows equal in all three are exchangeable. No rows: no rows.
    Other columns are not read. Documents are taken whole, however long; the words of texts are counted in the scan.
    """
    one = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("qid")).agg(F.max("quality").cast("double").alias("q"))
        one = one.join(q, F.col("doc_id") == F.col("qid"), "left").drop("qid")
    else:
        one = one.withColumn("q", F.lit(1.0))
    q = F.coalesce(F.when(~F.isnan("q"), F.col("q")), F.lit(1.0))
    one = one.withColumn("q", q).withColumn(
        "draw_key", F.when(F.col("q") > 0, -F.ln(draw(F.col("doc_id"), seed)) / F.col("q")).otherwise(float("inf"))
    )
    one = cut_lineage(one, "mix")

    sizes = one.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("rows"),
    )
    goal = targets(sizes, weights, share, cap).join(weight_classes(one), F.col("source").eqNullSafe(F.col("cs")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = small(
        goal.select(
            F.col("source").alias("s"),
            "source_size",
            "target",
            "classes",
            epochs.alias("epochs"),
            (F.col("target") - epochs * F.col("source_size")).alias("rest"),
            F.ceil(F.col("rows") / bucket_rows).alias("buckets"),
        )
    )
    one = one.join(goal, F.col("source").eqNullSafe(F.col("s")))
    at = F.floor(share_before(F.col("draw_key"), F.col("classes")) * F.col("buckets"))
    one = one.withColumn("bucket", F.least(at, F.col("buckets") - 1))
    per = one.groupBy(F.col("source").alias("ps"), F.col("bucket").alias("pb")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("ps").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).drop("words")
    one = one.join(per, F.col("source").eqNullSafe(F.col("ps")) & (F.col("bucket") == F.col("pb")))
    own = (
        Window.partitionBy("source", "bucket")
        .orderBy("draw_key", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    upto = F.col("before") + F.sum("size").over(own)
    one = one.withColumn("part", F.when(2 * upto - F.col("size") <= 2 * F.col("rest"), F.col("size")).otherwise(0))
    return one.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "draw_key",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )
