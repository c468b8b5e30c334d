"""Text expressions: cleaning, counting, hashing, labels and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv


def let(value: Column, use) -> Column:
    """Compute ``value`` once and hand it to ``use``; inside higher-order functions nothing else is shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.btrim(c, F.lit(fv.WHITE_SPACE))


def lower(c: Column) -> Column:
    """Each character lower-cased by itself: a capital sigma does not depend on its place, a dotted capital I stays one letter."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def words(c: Column) -> Column:
    """Lower-cased white-space tokens; an empty text has none."""
    blanks = F.translate(lower(c), fv.WHITE_SPACE, " " * len(fv.WHITE_SPACE))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def token_count(c: Column) -> Column:
    n = F.regexp_count(c, F.lit(fv.P_WORD_OR_MARK))
    return ((n * F.lit(fv.TOKENS_PER_WORD)).cast("int") + 1).cast("int")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def question_hash(c: Column) -> Column:
    return content_hash(lower(strip(c)))


def key_hash(c: Column, salt: str) -> Column:
    return content_hash(F.concat(F.lit(salt + ":"), c))


def clean_inline(c: Column) -> Column:
    steps = [
        (fv.P_COMMENT, ""),
        (fv.P_INDEX, ""),
        (fv.P_SHORTCODE, ""),
        (fv.P_INLINE_VALUE, "[value]"),
        (fv.P_FOOTNOTE_REF, ""),
        (fv.P_CITATION, ""),
        (fv.P_SPAN_ATTR, "$1"),
        (fv.P_BLANKS, " "),
    ]
    for pattern, put in steps:
        c = F.regexp_replace(c, pattern, put)
    return strip(c)


def parse_attrs(c: Column) -> Column:
    """``#id .class key="v"`` as struct(ident, classes, kv)."""
    return let(c, _parse_attrs)


def _parse_attrs(c: Column) -> Column:
    pairs = F.transform(
        F.regexp_extract_all(c, F.lit(fv.P_ATTR), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, fv.P_ATTR, 1).alias("k"),
            # at most one of the three alternatives is non-empty
            F.concat(*[F.regexp_extract(m, fv.P_ATTR, g) for g in (2, 3, 4)]).alias("v"),
        ),
    )
    # the last value of a repeated key counts
    kv = F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    rest = F.filter(F.split(F.regexp_replace(c, fv.P_ATTR, ""), r"\s+"), lambda t: t != "")
    return let(
        rest,
        lambda r: F.struct(
            F.substr(
                F.try_element_at(F.filter(r, lambda t: t.startswith("#")), F.lit(-1)), F.lit(2)
            ).alias("ident"),
            F.transform(F.filter(r, lambda t: t.startswith(".")), lambda t: F.substr(t, F.lit(2))).alias("classes"),
            kv.alias("kv"),
        ),
    )


def split_sentences(c: Column) -> Column:
    return F.split(c, fv.P_SENTENCE_CUT)


def split_paragraph(c: Column, max_tokens: int) -> Column:
    """Pieces of whole sentences, each filled up to ``max_tokens`` before the next one starts."""
    sentences = F.transform(
        split_sentences(c), lambda s: F.struct(s.alias("text"), token_count(s).alias("tokens"))
    )
    piece = "array<string>"
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast(piece).alias("open"),
        F.lit(0).alias("used"),
    )

    def step(acc, s):
        full = (F.size(acc["open"]) > 0) & (acc["used"] + s["tokens"] > max_tokens)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " "))))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(full, F.array(s["text"])).otherwise(F.concat(acc["open"], F.array(s["text"]))).alias("open"),
            F.when(full, s["tokens"]).otherwise(acc["used"] + s["tokens"]).alias("used"),
        )

    return F.aggregate(
        sentences, start, step, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))
    )


def chapter_label(num: Column) -> Column:
    return (
        F.when(num >= fv.GLOSSARY_BASE, F.lit("Glossary"))
        .when(num >= fv.APPENDIX_BASE, F.concat(F.lit("Appendix "), F.char(num.cast("int") - fv.APPENDIX_BASE + 65)))
        .otherwise(F.concat(F.lit("Ch "), num.cast("string")))
    )


def heading_path(volume: Column, num: Column, title: Column, section_path: Column) -> Column:
    head = F.array(
        F.concat(F.lit("Vol "), volume.cast("string")), F.concat(chapter_label(num), F.lit(": "), title)
    )
    return F.array_join(F.concat(head, section_path), " > ")


def embed_text(heading: Column, text: Column) -> Column:
    return F.concat(heading, F.lit("\n\n"), text)


def preview(c: Column, n: int = 240) -> Column:
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def is_abstention(answer: Column) -> Column:
    head = F.substring(F.lower(strip(answer)), 1, fv.ABSTAIN_PREFIX)
    return head.contains(fv.ABSTAIN_PHRASE.lower())


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two texts as word sets; two empty texts score 0."""
    wa, wb = words(a), words(b)
    return F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words(a), words(b)))


def fold_term(c: Column) -> Column:
    """Cut one suffix; words that end otherwise never reach the regular expression."""
    may = c.endswith("s") | c.endswith("ing") | c.endswith("ed") | c.endswith("ly")
    return F.when(may, F.regexp_replace(c, fv.P_SUFFIX, "$1")).otherwise(c)


def index_terms(c: Column) -> Column:
    """Normalised term of every word position; stop words keep their place as empty strings."""
    found = F.regexp_extract_all(lower(c), F.lit(fv.P_WORD), F.lit(0))
    return F.transform(
        found, lambda w: F.when(w.isin(fv.STOP_WORDS), F.lit("")).otherwise(fold_term(w))
    )


def cost_usd(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Token counts at prices per million tokens."""
    return prompt / F.lit(1e6) * F.lit(prompt_price) + completion / F.lit(1e6) * F.lit(completion_price)


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 when there is nothing to divide by."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))
