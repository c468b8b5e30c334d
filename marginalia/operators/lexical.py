"""Lexical search: index terms, query syntax, matching and cover-density ranking.

A chunk keeps its normalised terms as one array by position (``terms``; stop words are empty
strings that hold their place), so phrases and covers are computed inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.functions.stats import top_k
from marginalia.operators.embedding import cut
from marginalia.session import cut_lineage

OPERAND = "struct<terms:array<string>,offsets:array<int>,negated:boolean>"

#: Word positions that a worker groups at once; a longer chunk is a slice of its own.
POSTING_SLICE = 1_000_000


def with_terms(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("terms", tx.index_terms(F.col(text)))


def _grouped(ids: pa.Array, terms: pa.ListArray) -> pa.RecordBatch:
    """(chunk_id, term, positions) of a slice of chunks, in order of term and chunk.

    Terms become numbers in their order, so that one sort of whole numbers puts the positions of a term in a chunk side by side.
    """
    n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    order = np.empty(len(by_term), np.int64)
    order[by_term] = np.arange(len(by_term))
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(n) - n, n)
    code = coded.indices.to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(code != coded.dictionary.index("").as_py())
    key = order[code[kept]] * len(n) + row[kept]
    place = np.argsort(key, kind="stable")
    at, first = kept[place], np.flatnonzero(np.diff(key[place], prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(pos[at].astype(np.int32)))
    head = at[first]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row[head])), coded.dictionary.take(pa.array(code[head])), positions], names=["chunk_id", "term", "positions"]
    )


def build_postings(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """(chunk_id, term, positions), positions counted from 1 in the text with stop words.

    Terms come from the JVM; a task groups the positions of a slice of chunks: no shuffle, and no group per frequent term.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), tx.index_terms(F.col("text")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms = b.columns
            for first, n in cut(pc.list_value_length(terms), POSTING_SLICE):
                yield _grouped(ids.slice(first, n), terms.slice(first, n))

    kinds = [("chunk_id", rows.schema["chunk_id"].dataType), ("term", T.StringType()), ("positions", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in kinds]))


def _operand(token: Column) -> Column:
    words = F.regexp_extract_all(tx.lower(token), F.lit(fv.P_WORD), F.lit(0))
    terms = F.transform(words, lambda w: F.when(w.isin(fv.STOP_WORDS), F.lit("")).otherwise(tx.fold_term(w)))

    def build(all_terms: Column, at: Column) -> Column:
        return F.struct(
            F.transform(at, lambda i: F.get(all_terms, i)).alias("terms"),
            F.transform(at, lambda i: (i - F.get(at, F.lit(0))).cast("int")).alias("offsets"),
            token.startswith("-").alias("negated"),
        )

    return tx.let(
        terms,
        lambda ts: tx.let(
            F.filter(F.transform(ts, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull()),
            lambda at: build(ts, at),
        ),
    )


def parse_question(question: Column) -> Column:
    """Web-search syntax to alternatives of operands: words must all occur, ``"..."`` is a phrase,
    ``or`` separates alternatives, ``-`` excludes. Operands that are only stop words vanish.
    """
    tokens = F.regexp_extract_all(question, F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    # a word of several parts (state-of-the-art) is a phrase of its parts
    parsed = F.transform(
        tokens,
        lambda t: F.struct((F.lower(t) == "or").alias("is_or"), _operand(t).alias("op")),
    )
    start = F.struct(
        F.array().cast(f"array<array<{OPERAND}>>").alias("done"), F.array().cast(f"array<{OPERAND}>").alias("open")
    )

    def step(a, p):
        return F.struct(
            F.when(p["is_or"], F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(p["is_or"], F.array().cast(f"array<{OPERAND}>"))
            .when(F.size(p["op"]["terms"]) > 0, F.concat(a["open"], F.array(p["op"])))
            .otherwise(a["open"])
            .alias("open"),
        )

    alts = F.aggregate(parsed, start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return F.filter(alts, lambda g: F.exists(g, lambda o: ~o["negated"]))


def plain_words(text: Column) -> Column:
    """A text as a question in which nothing is an operator: words only, each by itself, ``or`` quoted."""
    words = F.trim(F.regexp_replace(tx.lower(text), fv.P_NO_WORD, " "))
    return F.regexp_replace(words, r"(?<![^ ])or(?![^ ])", '"or"')


def websearch_terms(questions: DataFrame) -> DataFrame:
    """(query_id, question) to (query_id, alternative, clause, negated, term, offset) rows."""
    return (
        questions.select("query_id", F.posexplode(parse_question(F.col("question"))).alias("alternative", "_g"))
        .select("query_id", "alternative", F.posexplode("_g").alias("clause", "_o"))
        .select(
            "query_id",
            "alternative",
            "clause",
            F.col("_o.negated").alias("negated"),
            F.inline(F.arrays_zip(F.col("_o.terms").alias("term"), F.col("_o.offsets").alias("offset"))),
        )
    )


def _ends(terms: Column, op: Column) -> Column:
    """Positions (0-based) where an operand's first term stands with the rest at its offsets."""
    first = op["terms"][0]
    starts = F.filter(
        F.transform(terms, lambda t, i: F.when(t == first, i)), lambda i: i.isNotNull()
    )
    return F.when(F.size(op["terms"]) == 1, starts).otherwise(
        F.filter(
            starts,
            lambda s: F.forall(
                F.arrays_zip(op["terms"].alias("t"), op["offsets"].alias("o")),
                lambda x: F.coalesce(F.get(terms, s + x["o"]) == x["t"], F.lit(False)),
            ),
        )
    )


def _satisfies(terms: Column, group: Column) -> Column:
    """All positive operands present, no negated one. Cheap containment first, phrases only when that holds."""
    positive = F.filter(group, lambda o: ~o["negated"])
    needed = F.flatten(F.transform(positive, lambda o: o["terms"]))
    return (F.size(F.array_except(needed, terms)) == 0) & F.forall(
        group,
        lambda o: F.when((F.size(o["terms"]) == 1), F.array_contains(terms, o["terms"][0])).otherwise(
            F.size(_ends(terms, o)) > 0
        )
        != o["negated"],
    )


def lexical_match(chunks: DataFrame, questions: DataFrame, salts: int = 16) -> DataFrame:
    """(query_id, id, terms, groups): chunks that satisfy at least one alternative of a question.

    ``chunks`` has (id, terms). Every alternative is looked up by its rarest required term only, so a
    term that stands in a third of all chunks drives no lookup unless the question has nothing rarer;
    the candidates are then checked against the chunk's own terms. Lookup keys are salted by chunk, so
    a frequent term's chunks are spread over ``salts`` tasks.
    """
    alts = questions.select("query_id", F.explode(parse_question(F.col("question"))).alias("group"))
    need = F.array_distinct(
        F.flatten(F.transform(F.filter("group", lambda o: ~o["negated"]), lambda o: o["terms"]))
    )
    # what meets the postings is written first, so its size is known: where it is small the postings stay where they are
    alts = cut_lineage(
        alts.select("query_id", "group", F.md5(F.to_json("group")).alias("group_key"), need.alias("need")), "alternatives"
    )
    wanted = alts.select("group_key", F.explode("need").alias("term")).distinct()
    postings = chunks.select("id", F.explode_outer(F.array_distinct("terms")).alias("term")).filter("term <> ''")
    df = (
        postings.join(wanted.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    # a required term that no chunk has makes the alternative empty
    rarest = (
        wanted.join(df, "term", "left")
        .groupBy("group_key")
        .agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    )
    keys = rarest.select("group_key", "term", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = (
        postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        .join(cut_lineage(keys, "keys"), ["term", "salt"])
        .select("group_key", "id")
    )
    # keys and ids only so far; the term arrays come in once, for candidates
    return (
        cut_lineage(found, "candidates")
        .join(chunks.select("id", "terms"), "id")
        .join(alts.select("group_key", "query_id", "group"), "group_key")
        .filter(_satisfies(F.col("terms"), F.col("group")))
        .groupBy("query_id", "id")
        .agg(F.any_value("terms").alias("terms"), F.collect_set("group").alias("groups"))
    )


def cover_sum(hits: Column, need: Column) -> Column:
    """Sum of 0.1 / (1 + noise) over the minimal covers of ``need`` (terms) among ``hits``: (pos, which), in order of
    pos, where which counts the terms of ``need`` from 1. One pass keeps the last position of every term; a cover
    ends where the earliest of those moves on.
    """
    none = F.transform(need, lambda t: F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("nth")))
    start = F.struct(
        F.lit(0).alias("nth"), none.alias("last"), F.lit(-1).alias("left"), F.lit(0.0).alias("rank")
    )

    def step(a, h):
        last = F.transform(
            a["last"],
            lambda x, i: F.when(i + 1 == h["which"], F.struct(h["pos"].alias("pos"), a["nth"].alias("nth"))).otherwise(x),
        )

        def build(new_last, left):
            is_cover = (left["pos"] >= 0) & (left["pos"] > a["left"])
            noise = (h["pos"] - left["pos"]) - (a["nth"] - left["nth"])
            return F.struct(
                (a["nth"] + 1).alias("nth"),
                new_last.alias("last"),
                F.when(is_cover, left["pos"]).otherwise(a["left"]).alias("left"),
                F.when(is_cover, a["rank"] + F.lit(0.1) / (F.lit(1) + noise)).otherwise(a["rank"]).alias("rank"),
            )

        return tx.let(last, lambda x: tx.let(F.array_min(x), lambda left: build(x, left)))

    return F.aggregate(hits, start, step, lambda a: a["rank"])


def cover_density(terms: Column, groups: Column) -> Column:
    """Sum over minimal covers of 0.1 / (1 + noise), as in cover-density ranking.

    ``groups`` are the satisfied alternatives; a cover must hold all positive terms of one of them, so
    the rank of several alternatives adds the covers of each.
    """

    def one(group: Column) -> Column:
        need = F.array_distinct(
            F.flatten(F.transform(F.filter(group, lambda o: ~o["negated"]), lambda o: o["terms"]))
        )
        return tx.let(need, covers)

    def covers(need: Column) -> Column:
        hits = F.filter(
            F.transform(
                terms, lambda t, i: F.struct(i.alias("pos"), F.array_position(need, t).cast("int").alias("which"))
            ),
            lambda h: h["which"] > 0,
        )
        return cover_sum(hits, need)

    return F.aggregate(F.transform(groups, one), F.lit(0.0), lambda s, x: s + x)


def cover_density_rank(matches: DataFrame) -> DataFrame:
    return matches.select(
        "query_id", "id", F.round(cover_density(F.col("terms"), F.col("groups")), 9).alias("rank_cd")
    )


def lexical_topk(chunks: DataFrame, questions: DataFrame, k: int = fv.PER_LIST) -> DataFrame:
    """(query_id, id, rank_cd, rank): the k best matches of each question."""
    return rank_matches(lexical_match(chunks, questions), k)


def rank_matches(matches: DataFrame, k: int = fv.PER_LIST) -> DataFrame:
    """The k best of the rows that ``lexical_match`` found."""
    return top_k(cover_density_rank(matches), ["query_id"], [F.desc("rank_cd"), F.asc("id")], k, spread="id")
