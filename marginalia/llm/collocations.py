"""Phrase collocations by stripes.

Each prefix keys an associative counter of next words, its stripe. A task counts the stripes of its texts, prefixes meet in
one exchange, and stripes are merged element by element. The merged elements are the counts of longer phrases (prefix and
next word), so one structure gives the extensions of a prefix, the counts that cuts ask for, and the greatest count of a
longer phrase on either side, which tells phrases that are subsumed.

Three passes over the texts: counts of words (the stripe of the empty prefix), stripes of one word, stripes of two and
three words. A phrase that is frequent enough has frequent parts only, so each pass leaves out what a bit filter
of the parts found before rules out. The filter has a fixed size: where it is full it saves less, and no count changes.
A prefix with more than a thousandth of all places has its stripe cut by its next words; there are at most a thousand such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.stats import top_k
from marginalia.llm.bytehash import U, mix, pieces, word_hashes, word_spans
from marginalia.session import cut_lineage

#: Bytes that end a piece, and those that end a word (the same and blanks).
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Texts are counted in runs of about so many bytes, and results leave a task in batches of so many rows.
RUN = 2 << 20
BATCH = 8192
#: A prefix with more than this share of all places is cut into parts.
HOT = 1000
#: A stripe as it moves: the next words joined by spaces, and their counts.
STRIPES = "lang string, prefix string, part int, nexts string, counts array<int>"


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 64-bit key of a phrase from the keys of its first words and of its last word."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


class Words:
    """The words of a run of texts as numbers of a vocabulary of (language, word), with piece ends and 64-bit keys."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array, seeds: np.ndarray) -> None:
        start, end, first = word_spans(buf, off, GAP)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        seed = seeds[doc]
        key = mix(word_hashes(buf, start, end, FOLD) ^ seed)
        check = word_hashes(buf, start, end, FOLD, 1) ^ seed
        broken = np.concatenate([[0], np.cumsum(BREAK[buf])])[start]
        #: whether the next word is of the same piece
        self.joined = np.zeros(len(start), bool)
        self.joined[:-1] = (broken[1:] == broken[:-1]) & (doc[1:] == doc[:-1])
        self.key, at, self.ids = np.unique(key, return_index=True, return_inverse=True)
        if (check != check[at][self.ids]).any():  # two words of one key: number the pairs of hashes
            pair = np.unique(np.stack([key, check], 1), axis=0, return_index=True, return_inverse=True)
            at, self.ids = pair[1], pair[2].ravel()
            self.key = key[at]
        folded = FOLD[buf].tobytes()
        self.words = pa.array([folded[a:z].decode("utf-8", "replace") for a, z in zip(start[at].tolist(), end[at].tolist())], pa.string())
        self.langs = langs.take(pa.array(doc[at]))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Batches of (lang, seed, text) as runs of words."""
    kept, size = [], 0

    def flush() -> Iterator[Words]:
        table = pa.Table.from_batches(kept)
        seeds = table["seed"].to_numpy().view(U)
        langs = table["lang"].combine_chunks()
        for row, buf, off in pieces(table["text"], RUN):
            n = len(off) - 1
            yield Words(buf, off, langs.slice(row, n), seeds[row : row + n])

    for b in batches:
        kept.append(b)
        size += b.nbytes
        if size >= RUN:
            yield from flush()
            kept, size = [], 0
    if kept:
        yield from flush()


def texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def passes(keys: np.ndarray, bits: bytes) -> np.ndarray:
    """Which keys the filter does not rule out."""
    at = (keys & U(len(bits) * 8 - 1)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def key_filter(found: DataFrame, bits: int) -> bytes:
    """A filter of 2^bits bits over the column `key`; it reaches the driver as at most 2^bits / 32,768 rows of 4 KiB."""
    at = (F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("at")
    rows = found.select(at).groupBy(F.bitmap_bucket_number("at").alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():
        out[(r["nth"] - 1) * 4096 : r["nth"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return out.tobytes()


def stripes_of(w: Words, prefix: np.ndarray, first: np.ndarray, nexts: np.ndarray, names: pa.Array, keys: np.ndarray, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """One row a prefix (and part): `prefix` numbers the prefix of each place, `first` its first word, `nexts` the next words.

    names and keys: by prefix number.
    """
    v = len(w.key)
    code, at, count = np.unique(prefix.astype(np.int64) * v + nexts, return_index=True, return_counts=True)
    p, n = code // v, code % v
    parts = np.ones(len(keys), U)
    for k in np.flatnonzero(np.isin(keys.view(np.int64), np.fromiter(hot, np.int64, len(hot)))):
        parts[k] = hot[int(keys.view(np.int64)[k])]
    part = (w.key[n] % parts[p]).astype(np.int32)
    order = np.lexsort((n, part, p))
    p, n, part, count, at = p[order], n[order], part[order], count[order], at[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (part[1:] != part[:-1])
    row = np.flatnonzero(new)
    offsets = pa.array(np.append(row, len(p)).astype(np.int32))
    whole = pa.RecordBatch.from_arrays(
        [
            w.langs.take(pa.array(first[at[row]])),
            names.take(pa.array(p[row])),
            pa.array(part[row]),
            pc.binary_join(pa.ListArray.from_arrays(offsets, w.words.take(pa.array(n))), " "),
            pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
        ],
        ["lang", "prefix", "part", "nexts", "counts"],
    )
    yield from cut_batch(whole)


def cut_batch(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, whole.num_rows, BATCH):
        yield whole.slice(at, BATCH)


def merged(stripes: DataFrame) -> DataFrame:
    """Stripes of all tasks merged element by element: lang, phrase, size (words of the phrase), a.

    Prefixes meet in one exchange; the elements of a prefix are then summed where they are.
    """
    at = stripes.repartition("lang", "prefix", "part")
    zipped = F.arrays_zip(F.split("nexts", " ").alias("next"), F.col("counts").alias("count"))
    at = at.select("lang", "prefix", "part", F.explode(zipped).alias("x"))
    at = at.groupBy("lang", "prefix", "part", F.col("x.next").alias("next")).agg(F.sum(F.col("x.count").cast("bigint")).alias("a"))
    return at.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), (F.size(F.split("prefix", " ")) + 1).alias("size"), "a")


def with_keys(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a) with the key that the passes give to the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = b.column("seed").to_numpy().view(U)
            keys = np.zeros(b.num_rows, U)
            for row, buf, off in pieces(b.column("phrase"), RUN):
                start, end, first = word_spans(buf, off, GAP)
                word = word_hashes(buf, start, end, FOLD)
                here, many = np.arange(row, row + len(off) - 1), np.diff(first)
                for k in range(int(many.max(initial=0))):
                    on = many > k
                    key = mix(word[first[:-1][on] + k] ^ seeds[here[on]])
                    keys[here[on]] = join_keys(keys[here[on]], key) if k else key
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("lang", "phrase", "size", "a")), pa.array(keys.view(np.int64))],
                ["lang", "phrase", "size", "a", "key"],
            )

    rows = found.select("lang", "phrase", "size", "a", F.xxhash64("lang").alias("seed"))
    return rows.mapInArrow(run, "lang string, phrase string, size int, a bigint, key bigint")


def hot_prefixes(found: DataFrame, total: int) -> dict[int, int]:
    """Parts of the prefixes with more than a thousandth of all places: at most a thousand for phrases of one length."""
    rows = found.where(F.col("a") * HOT > total).select("key", "a").collect()
    return {r["key"]: min(64, 1 + r["a"] * HOT // total) for r in rows}


def phrase_counts(
    docs: DataFrame, *, least: int = 30, text_col: str = "text", lang_col: str = "lang", filter_bits: int = 26
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to 4 words that occur `least` times or more in a language, and
    (lang, n), all words of each language."""
    sc = docs.sparkSession.sparkContext
    rows = texts(docs, text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in runs(batches):
            n = np.bincount(w.ids, minlength=len(w.key)).astype(np.int64)
            yield from cut_batch(pa.RecordBatch.from_arrays([w.langs, w.words, pa.array(n)], ["lang", "phrase", "a"]))

    one = rows.mapInArrow(count, "lang string, phrase string, a bigint")
    one = cut_lineage(one.groupBy("lang", "phrase").agg(F.sum("a").alias("a")), "words")
    totals = one.groupBy("lang").agg(F.sum("a").alias("n"))
    total = one.agg(F.sum("a")).first()[0] or 0
    one = cut_lineage(with_keys(one.where(F.col("a") >= least).withColumn("size", F.lit(1))), "frequent-words")
    known, hot = sc.broadcast(key_filter(one, filter_bits)), hot_prefixes(one, total)

    def twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in runs(batches):
            ok = passes(w.key, known.value)[w.ids]
            at = np.flatnonzero(w.joined[:-1] & ok[:-1] & ok[1:])
            a, b = w.ids[at], w.ids[at + 1]
            yield from stripes_of(w, a, a, b, w.words, w.key, hot)

    two = cut_lineage(with_keys(merged(rows.mapInArrow(twos, STRIPES)).where(F.col("a") >= least)), "pairs")
    pairs, hot2 = sc.broadcast(key_filter(two, filter_bits)), hot_prefixes(two, total)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in runs(batches):
            v = len(w.key)
            ok = passes(w.key, known.value)[w.ids]
            at = np.flatnonzero(w.joined[:-1] & ok[:-1] & ok[1:])
            key = join_keys(w.key[w.ids[at]], w.key[w.ids[at + 1]])
            at = at[passes(key, pairs.value)]
            # pair[i]: the number of the pair of words at place i, or -1
            code, number = np.unique(w.ids[at] * v + w.ids[at + 1], return_inverse=True)
            pair = np.full(len(w.ids) + 3, -1)
            pair[at] = number
            keys = join_keys(w.key[code // v], w.key[code % v])
            names = pc.binary_join_element_wise(w.words.take(pa.array(code // v)), w.words.take(pa.array(code % v)), " ")
            three = at[pair[at + 1] >= 0]
            yield from stripes_of(w, pair[three], w.ids[three], w.ids[three + 2], names, keys, hot2)
            four = three[pair[three + 2] >= 0]
            code, triple = np.unique(pair[four] * v + w.ids[four + 2], return_inverse=True)
            keys = join_keys(keys[code // v], w.key[code % v])
            names = pc.binary_join_element_wise(names.take(pa.array(code // v)), w.words.take(pa.array(code % v)), " ")
            yield from stripes_of(w, triple, w.ids[four], w.ids[four + 3], names, keys, hot2)

    longer = merged(rows.mapInArrow(more, STRIPES)).where(F.col("a") >= least)
    cols = ["lang", "phrase", "size", "a"]
    counts = one.select(cols).unionByName(two.select(cols)).unionByName(longer.select(cols))
    return cut_lineage(counts, "phrases"), totals


def collocations(
    docs: DataFrame,
    *,
    least: int = 30,
    keep: int = 2000,
    subsumed: int = 80,
    scale: int = 2_000_000,
    text_col: str = "text",
    lang_col: str = "lang",
    filter_bits: int = 26,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `keep` phrases of 2 to 4 words of each language.

    Words are in lower case (A-Z only) and do not cross the ends of pieces. A phrase with a = f(phrase) >= `least` is cut
    after its first k words: l = f(first words), r = f(rest), score = floor(scale * a / (l + r)); the cut of the least
    score counts, ties to the smallest k. Phrases inside a longer one with 100 * f(longer) >= `subsumed` * a are
    dropped. Order: score, a, then phrase by bytes. n is the number of words of the language.

    A null language is `und`, a null text is empty. Repeated rows count again. Very long texts are handled alone, whole.
    No rows: no rows. Other columns are not read.
    """
    counts, totals = phrase_counts(docs, least=least, text_col=text_col, lang_col=lang_col, filter_bits=filter_bits)
    phrases = counts.where("size > 1")
    w = F.split("phrase", " ")
    side = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    # a longer phrase that holds this one begins or ends one word further; what holds for longer ones holds for these
    longer = phrases.where("size > 2").select(
        "lang", F.explode(F.array(side(F.lit(1), F.col("size") - 1), side(F.lit(2), F.col("size") - 1))).alias("phrase"), "a"
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = phrases.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(subsumed) * wide("a"))
    )
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), side(F.lit(1), k).alias("x"), side(k + 1, F.col("size")).alias("y")))
    cut = left.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    cut = cut.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"])
    # exact whole-number division of decimals
    cut = cut.withColumn("up", F.lit(scale).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"))
    cut = cut.withColumn("down", (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")))
    cut = cut.withColumn("score", F.expr("up div down"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_k(best, ["lang"], order, keep, "phrase")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
