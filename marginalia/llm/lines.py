"""Line dedup by distinct-site spread.

A HyperLogLog sketch of sites per line hash merges by aggregation. Lines whose estimate lies near the threshold get an
exact distinct count; lines that spread over enough sites are boilerplate and stay at their first place only.

Plan: exploded lines carry two hashes, the site and the place, never the text. A hot line is pre-aggregated by task.
The few spread lines go to the places (broadcast up to a counted bound), so the places of a hot line stay in their tasks.
Texts move once, to meet their removed line numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.frames import packed, row_key, small
from marginalia.session import cut_lineage


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h1, h2 (of the line without white space at its ends), site, id, row key and line number; blank lines are left out."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        row_key(id_col, text_col).alias("rk"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"),
    )
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).where("line <> ''")
    return lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "site", "id", "rk", "at"
    )


def spread_lines(places: DataFrame, min_sites: int = 10, lg_k: int = 10) -> DataFrame:
    """h1, h2, sites and first place of each line found on `min_sites` sites or more.

    The sketch has a standard error of 0.83 / sqrt(2^lg_k) (2.6 %); six of them make the band that is counted exactly.
    """
    band = 6 * 0.83 / (2 ** (lg_k / 2))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk", "at")).alias("first")
    seen = places.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), first
    )
    seen = seen.where(F.col("rows") >= min_sites).select(
        "h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"), "first"
    )
    seen = cut_lineage(seen.where(F.col("sites") >= min_sites * (1 - band) - 1), "lines")
    near = seen.where(F.col("sites") <= min_sites * (1 + band) + 1)
    exact = (
        places.join(small(near.select("h1", "h2")), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("x"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("exact"))
    )
    known = seen.join(exact, ["h1", "h2"], "left").withColumn("sites", F.coalesce("exact", "sites"))
    return known.where(F.col("sites") >= min_sites).drop("exact")


def drop_boilerplate(
    docs: DataFrame,
    *,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    lg_k: int = 10,
) -> DataFrame:
    """`docs` with boilerplate lines taken out of the text: columns row (all columns as one), text, n_lines, n_removed.

    A line counts once for each distinct site; a null site is a site of its own. Its first place (smallest id, null
    ids last, then line number) stays. Null and empty texts stay as they are. Rows equal in id and text are one
    document read twice: each keeps the first place. No rows: no rows. A text is cut whole, however long it is; other
    columns, whatever their names, come back in `row`.
    """
    places = line_places(docs, id_col, text_col, site_col)
    found = spread_lines(places, min_sites, lg_k)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rk", "at")
    gone = places.join(small(found.select("h1", "h2", "first")), ["h1", "h2"]).where(place != F.col("first"))
    gone = gone.groupBy("id", "rk").agg(F.collect_set("at").alias("gone"))
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("i"), row_key(id_col, text_col).alias("k"))
    both = rows.join(gone, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("rk")), "left")
    text = F.col("row").getField(text_col)
    kept = F.array_join(
        F.filter(F.split(text, "\n"), lambda x, at: ~F.array_contains(F.col("gone"), at)), "\n"
    )
    return both.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
