"""Blocks to chunks.

A document's items sit in one array of one row (a document is one row to begin with), so packing
needs no shuffle on plain text: the fold stores a cut only where a chunk ends, and the chunk
texts are slices of the item array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.functions.stats import number_rows, order_statistics

ITEM = (
    "struct<text:string,tokens:int,section_path:array<string>,char_start:int,char_end:int,atomic:boolean>"
)
CUT = "struct<first:int,until:int,tokens:int,oversize:boolean>"
CHUNKS_PER_DOC_BITS = 24


def select_chapters(
    manifest: DataFrame,
    skip: list[str] = fv.SKIP_PATH_SUBSTRINGS,
    appendix_base: int = fv.APPENDIX_BASE,
    glossary_base: int = fv.GLOSSARY_BASE,
) -> DataFrame:
    """(volume, ordinal, path) to numbered chapters; ordinals are unique within a volume."""
    path = F.col("path")
    keep = F.lit(True)
    for s in skip:
        keep = keep & ~F.concat(F.lit("/"), path).contains(s)
    kind = (
        F.when(path.contains("/backmatter/glossary"), "glossary")
        .when(path.contains("/backmatter/"), "appendix")
        .otherwise("chapter")
    )
    num = (
        F.when(F.col("kind") == "glossary", F.lit(glossary_base))
        .when(F.col("kind") == "appendix", F.col("_n") - 1 + appendix_base)
        .otherwise(F.col("_n"))
    )
    numbered = number_rows(manifest.filter(keep).withColumn("kind", kind), ["volume", "kind"], "ordinal", "_n")
    return numbered.select("volume", "ordinal", num.cast("int").alias("chapter_num"), "path", "kind")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Add ``section_path``: the open headings of level 2 and deeper at each block.

    Per level the last heading so far counts if no shallower heading came later: six running
    windows over one (source_file, block_no) order, so one shuffle and one sort.
    """
    w = W.partitionBy("source_file").orderBy("block_no")
    is_head = (F.col("kind") == "heading") & (F.col("level") >= 2)
    out = blocks
    levels = range(2, 7)
    for lv in levels:
        here = F.when(is_head & (F.col("level") == lv), F.struct(F.col("block_no").alias("at"), F.col("text").alias("title")))
        out = out.withColumn(f"_h{lv}", F.last(here, ignorenulls=True).over(w))
    parts = []
    for lv in levels:
        alive = F.col(f"_h{lv}").isNotNull()
        for up in range(2, lv):
            alive = alive & F.coalesce(F.col(f"_h{up}.at") < F.col(f"_h{lv}.at"), F.lit(True))
        parts.append(F.when(alive, F.col(f"_h{lv}.title")))
    return out.withColumn("section_path", F.array_compact(F.array(*parts))).drop(*[f"_h{lv}" for lv in levels])


def items_of(
    text: Column, start: Column, end: Column, section: Column, atomic: Column, max_tokens: int, count=tx.token_count
) -> Column:
    """One block as an array of packable items; long prose is cut at sentence ends."""
    def item(t: Column, n: Column, a: Column) -> Column:
        return F.struct(
            t.alias("text"),
            n.cast("int").alias("tokens"),
            section.alias("section_path"),
            start.cast("int").alias("char_start"),
            end.cast("int").alias("char_end"),
            a.alias("atomic"),
        )

    return tx.let(
        count(text),
        lambda n: F.when(atomic | (n <= max_tokens), F.array(item(text, n, atomic))).otherwise(
            F.transform(tx.split_paragraph(text, max_tokens), lambda p: item(p, count(p), F.lit(False)))
        ),
    )


def block_items(blocks: DataFrame, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Blocks with ``section_path`` to one row per document with its items in reading order."""
    items = items_of(
        F.col("text"),
        F.col("char_start"),
        F.col("char_end"),
        F.col("section_path"),
        F.col("kind").isin(fv.ATOMIC_KINDS),
        max_tokens,
    )
    return (
        blocks.filter("kind <> 'heading'")
        .select("source_file", "block_no", items.alias("part"))
        .groupBy("source_file")
        .agg(F.sort_array(F.collect_list(F.struct("block_no", "part"))).alias("parts"))
        .select("source_file", F.flatten(F.transform("parts", lambda p: p["part"])).alias("items"))
    )


def pack_cuts(items: Column, min_tokens: int | Column, max_tokens: int | Column) -> Column:
    """Greedy packing: where chunks start and end in an item array."""
    none = F.array().cast("array<string>")
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("first"),
        F.lit(0).alias("used"),
        none.alias("section"),
        F.array().cast(f"array<{CUT}>").alias("cuts"),
    )

    def cut(first, until, tokens, oversize) -> Column:
        return F.array(
            F.struct(
                first.alias("first"), until.alias("until"), tokens.alias("tokens"), F.lit(oversize).alias("oversize")
            )
        )

    def step(a, it):
        some = a["first"] < a["i"]
        alone = it["atomic"] & (it["tokens"] > max_tokens)
        new_section = (it["section_path"] != a["section"]) & (a["used"] >= min_tokens)
        over = a["used"] + it["tokens"] > max_tokens
        flush = some & (alone | new_section | over)
        nxt = a["i"] + 1
        cuts = F.when(flush, F.concat(a["cuts"], cut(a["first"], a["i"], a["used"], False))).otherwise(a["cuts"])
        return F.struct(
            nxt.alias("i"),
            F.when(alone, nxt).when(flush | ~some, a["i"]).otherwise(a["first"]).alias("first"),
            F.when(alone, F.lit(0)).when(flush | ~some, it["tokens"]).otherwise(a["used"] + it["tokens"]).alias("used"),
            it["section_path"].alias("section"),
            F.when(alone, F.concat(cuts, cut(a["i"], nxt, it["tokens"], True))).otherwise(cuts).alias("cuts"),
        )

    return F.aggregate(
        items,
        start,
        step,
        lambda a: F.when(
            a["first"] < a["i"], F.concat(a["cuts"], cut(a["first"], a["i"], a["used"], False))
        ).otherwise(a["cuts"]),
    )


def pack_chunks(
    docs: DataFrame,
    min_tokens: int | str = fv.MIN_TOKENS,
    max_tokens: int | str = fv.MAX_TOKENS,
    items: str = "items",
) -> DataFrame:
    """Rows with an item array to one row per chunk; every other column is carried along.

    The budgets may be numbers or names of columns (as in a sweep over configurations).
    """
    lo = F.col(min_tokens) if isinstance(min_tokens, str) else min_tokens
    hi = F.col(max_tokens) if isinstance(max_tokens, str) else max_tokens
    others = [c for c in docs.columns if c != items]
    part = lambda c: F.slice(F.col(items), c["first"] + 1, c["until"] - c["first"])
    return (
        docs.withColumn("_cuts", pack_cuts(F.col(items), lo, hi))
        .select(*others, items, F.posexplode_outer("_cuts").alias("chunk_no", "_c"))
        .filter("_c is not null")
        .select(
            *others,
            "chunk_no",
            F.get(F.col(items), F.col("_c.first"))["section_path"].alias("section_path"),
            F.get(F.col(items), F.col("_c.first"))["char_start"].alias("char_start"),
            F.get(F.col(items), F.col("_c.until") - 1)["char_end"].alias("char_end"),
            F.col("_c.tokens").alias("token_count"),
            F.col("_c.oversize").alias("oversize"),
            F.array_join(F.transform(part(F.col("_c")), lambda x: x["text"]), "\n\n").alias("text"),
        )
        .withColumn("content_hash", tx.content_hash(F.col("text")))
    )


def chunk_id(doc_ordinal: Column, chunk_no: Column) -> Column:
    """Unique id in (document, chunk) order without a global sort or shuffle; fails where the bits do not hold a number."""
    doc, no = doc_ordinal.cast("long"), chunk_no.cast("long")
    whole = F.shiftleft(doc, CHUNKS_PER_DOC_BITS) + no
    return _fits(whole, (doc, 63 - CHUNKS_PER_DOC_BITS), (no, CHUNKS_PER_DOC_BITS))


def _fits(value: Column, *parts: tuple[Column, int]) -> Column:
    """`value` if each part lies in its number of bits (or is null)."""
    bad = F.lit(False)
    for part, bits in parts:
        bad = bad | (part < 0) | (part >= 1 << bits)
    return F.when(bad, F.raise_error(F.lit("an ordinal does not fit into the chunk id")).cast("long")).otherwise(value)


def chapter_ordinal(volume: Column, chapter_num: Column) -> Column:
    """Volumes and chapters side by side in 39 bits: 2^19 volumes of 2^20 chapters."""
    vol, chapter = volume.cast("long"), chapter_num.cast("long")
    return _fits(F.shiftleft(vol, 20) + chapter, (vol, 19), (chapter, 20))


def chunk_corpus(
    blocks: DataFrame,
    chapters: DataFrame,
    commit_sha: str,
    min_tokens: int = fv.MIN_TOKENS,
    max_tokens: int = fv.MAX_TOKENS,
) -> DataFrame:
    """Blocks and numbered chapters (path = source_file) to chunk rows without embeddings."""
    from marginalia.operators.markup import document_titles

    chapters = chapters.select("volume", "chapter_num", F.col("path").alias("source_file"))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"\.[^.]*$", "")
    packed = pack_chunks(block_items(section_paths(blocks), max_tokens), min_tokens, max_tokens)
    return (
        packed.join(chapters, "source_file")
        .join(document_titles(blocks).select("source_file", "title"), "source_file", "left")
        .withColumn("chapter_title", F.coalesce("title", stem))
        .withColumn("id", chunk_id(chapter_ordinal(F.col("volume"), F.col("chapter_num")), F.col("chunk_no")))
        .withColumn(
            "heading_path",
            tx.heading_path(F.col("volume"), F.col("chapter_num"), F.col("chapter_title"), F.col("section_path")),
        )
        .select(
            "id", "volume", "chapter_num", "chapter_title", "section_path", "heading_path", "source_file",
            "char_start", "char_end", "token_count", F.lit(commit_sha).alias("commit_sha"), "content_hash",
            "oversize", "text",
        )
    )


def line_items(docs: DataFrame, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Plain documents (text) to item arrays: every non-blank line is a paragraph. No shuffle.

    Offsets are kept by a fold that carries the running position; lines are gathered in blocks of
    256 so that appending stays linear for long documents.
    """
    width = 256
    span = lambda a, x: a + F.length(x) + 1

    def block_lens(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / width).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: F.aggregate(F.slice(lines, b * width + 1, F.lit(width)), F.lit(0), span),
        )

    def offset(lines: Column, lens: Column, i: Column) -> Column:
        b = F.floor(i / width).cast("int")
        before = F.aggregate(F.slice(lens, F.lit(1), b), F.lit(0), lambda a, x: a + x)
        return before + F.aggregate(F.slice(lines, b * width + 1, i - b * width), F.lit(0), span)

    def one_line(ln: Column, t: Column, at: Column) -> Column:
        end = F.least(at + F.length(ln) + 1, F.length("text"))
        return items_of(t, at, end, F.array().cast("array<string>"), F.lit(False), max_tokens)

    def to_items(lines: Column, lens: Column) -> Column:
        return F.transform(
            lines,
            lambda ln, i: tx.let(
                tx.strip(ln),
                lambda t: F.when(
                    t != "", tx.let(offset(lines, lens, i), lambda at: one_line(ln, t, at))
                ).otherwise(F.array().cast(f"array<{ITEM}>")),
            ),
        )

    items = tx.let(F.split("text", "\n"), lambda lines: tx.let(block_lens(lines), lambda lens: to_items(lines, lens)))
    return docs.withColumn("items", F.flatten(items)).drop("text")


def chunk_stats(chunks: DataFrame, min_tokens: int = fv.MIN_TOKENS) -> DataFrame:
    """One row: count, min, p50 (element n // 2), max, mean to one decimal, oversize, under-min."""
    p50 = order_statistics(
        chunks, [], "token_count", {"tokens_p50": (0.5, lambda n: F.floor(n / 2))}
    )
    base = chunks.agg(
        F.count("*").alias("count"),
        F.min("token_count").alias("tokens_min"),
        F.max("token_count").alias("tokens_max"),
        F.round(F.sum("token_count") / F.count("*"), 1).alias("tokens_mean"),
        F.count_if("oversize").alias("oversize"),
        F.count_if(F.col("token_count") < min_tokens).alias("under_min"),
    )
    # both sides are a single row
    return base.withColumn("_one", F.lit(1)).join(p50.withColumn("_one", F.lit(1)), "_one").drop("_one")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("volume").agg(F.count("*").alias("chunks"))


def chunk_size_sweep(docs: DataFrame, budgets: list[tuple[str, int, int]]) -> DataFrame:
    """The same documents packed under several (name, min, max) budgets, one summary row each.

    Scan and packing are narrow for every budget; only per-budget summaries are shuffled.
    """
    per_budget = None
    for name, lo, hi in budgets:
        one = line_items(docs, hi).withColumn("config", F.lit(name)).withColumn("lo", F.lit(lo)).withColumn("hi", F.lit(hi))
        per_budget = one if per_budget is None else per_budget.unionByName(one)
    return (
        pack_chunks(per_budget, "lo", "hi")
        .groupBy("config")
        .agg(
            F.count("*").alias("chunks"),
            F.min("token_count").alias("tokens_min"),
            F.max("token_count").alias("tokens_max"),
            F.round(F.avg("token_count"), 6).alias("tokens_mean"),
            F.count_if(F.col("token_count") < F.col("lo")).alias("under_min"),
        )
    )
