"""Search over a stored inverted table: postings by term bucket, term facts with score bounds, generations.

An index is a folder. Each generation holds `postings` (term, id, tf, positions; a folder per bucket, sorted by term and id),
`terms` (document frequency and greatest tf of a term) and `removed` (ids that are gone from earlier generations).
Chunks are added and removed by writing one more generation; a row in `commits` makes it visible, so a job that dies
half way leaves nothing that a reader sees.

A question reads only the buckets of its terms. Each alternative is looked up by its rarest term, the other terms are
intersected on narrow columns, and what comes out bounds the score: with m terms that occur n times in a chunk there
are at most n - m + 1 covers of 0.1 each. The k chunks of the greatest bounds are scored first; positions of others are
read only where their bound reaches the k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions.stats import top_k
from marginalia.operators import lexical
from marginalia.session import cut_lineage

BUCKETS = 64
COVER = 0.1
_COMMIT = "gen int, buckets int, removes boolean, vectors boolean"


@dataclass(frozen=True)
class Generation:
    gen: int
    removes: bool


@dataclass(frozen=True)
class SearchIndex:
    """A committed state of the index in the folder `path`."""

    path: str
    buckets: int
    generations: tuple[Generation, ...]
    has_vectors: bool = False

    def at(self, gen: int, table: str) -> str:
        return f"{self.path}/gen={gen}/{table}"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _store(entries: DataFrame, index: SearchIndex, gen: int) -> None:
    """Postings and term facts of a generation. A bucket is one file or, where it is large, several: adaptive execution cuts
    it by size, so a term that half of the chunks have is many tasks. Facts are counted from the stored postings."""
    path = index.at(gen, "postings")
    moved = entries.drop("tf").hint("rebalance", "bucket").withColumn("tf", F.size("positions"))
    moved = moved.select(entries.columns).sortWithinPartitions("bucket", "term", "id")
    moved.write.partitionBy("bucket").parquet(path, compression="zstd")  # beside what was shuffled, most of the disk it takes
    stored = entries.sparkSession.read.schema(entries.schema).parquet(path)
    facts = stored.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    facts.sortWithinPartitions("bucket", "term").write.parquet(index.at(gen, "terms"))


def _write(index: SearchIndex, gen: int, chunks: DataFrame, removed: DataFrame | None) -> SearchIndex:
    spark = chunks.sparkSession
    entries = lexical.build_postings(chunks.select("id", "text")).select(
        F.col("chunk_id").alias("id"), "term", F.size("positions").alias("tf"), "positions", bucket_of(F.col("term"), index.buckets).alias("bucket")
    )
    _store(entries, index, gen)
    if index.has_vectors:
        # a filter here would run the model that makes the vectors a second time
        chunks.select("id", "embedding").write.parquet(index.at(gen, "vectors"))
    if removed is not None:
        removed.select(F.col("id").cast("long")).distinct().write.parquet(index.at(gen, "removed"))
    commit = spark.range(1).select(
        F.lit(gen).alias("gen"), F.lit(index.buckets).alias("buckets"),
        F.lit(removed is not None).alias("removes"), F.lit(index.has_vectors).alias("vectors"),
    )
    commit.coalesce(1).write.mode("append").parquet(f"{index.path}/commits")
    return replace(index, generations=(*index.generations, Generation(gen, removed is not None)))


def build(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
    """Index of (id, text) chunks in the new folder `path`; a column `embedding` is stored beside it for dense search."""
    return _write(SearchIndex(path.rstrip("/"), buckets, (), "embedding" in chunks.columns), 0, chunks, None)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """The last committed state of an index."""
    path = path.rstrip("/")
    rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy("gen").collect()  # a row a generation
    return SearchIndex(path, rows[0]["buckets"], tuple(Generation(r["gen"], r["removes"]) for r in rows), rows[0]["vectors"])


def update(index: SearchIndex, added: DataFrame, removed: DataFrame | None = None) -> SearchIndex:
    """One more generation: ids of `removed` go first, then the chunks `added` come in. A changed chunk is in both."""
    return _write(index, index.generations[-1].gen + 1, added, removed)


def _alive(spark: SparkSession, index: SearchIndex, table: str, pick) -> DataFrame:
    """Rows of all generations without those that a later one removed."""
    parts = []
    for i, g in enumerate(index.generations):
        rows = pick(spark.read.parquet(index.at(g.gen, table)))
        gone = [spark.read.parquet(index.at(x.gen, "removed")) for x in index.generations[i + 1 :] if x.removes]
        if gone:
            rows = rows.join(reduce(DataFrame.unionByName, gone), "id", "left_anti")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def vectors(spark: SparkSession, index: SearchIndex) -> DataFrame:
    """(id, embedding) of the index, of chunks that have a vector."""
    return _alive(spark, index, "vectors", lambda d: d.where("embedding is not null"))


def compact(spark: SparkSession, index: SearchIndex, path: str) -> SearchIndex:
    """The same index as one generation in a new folder."""
    out = SearchIndex(path.rstrip("/"), index.buckets, (), index.has_vectors)
    entries = _alive(spark, index, "postings", lambda d: d)
    _store(entries, out, 0)
    if index.has_vectors:
        vectors(spark, index).write.parquet(out.at(0, "vectors"))
    spark.createDataFrame([(0, index.buckets, False, index.has_vectors)], _COMMIT).coalesce(1).write.parquet(f"{out.path}/commits")
    return open_index(spark, out.path)


@dataclass
class _Asked:
    """Alternatives (query_id, group_key, group, need, terms, m, rarest) that can match, and the postings of their terms."""

    alternatives: DataFrame
    postings: DataFrame


def _ask(index: SearchIndex, questions: DataFrame) -> _Asked:
    spark = questions.sparkSession
    terms = lambda ops: F.array_distinct(F.flatten(F.transform(ops, lambda o: o["terms"])))
    alts = questions.select("query_id", F.explode(lexical.parse_question(F.col("question"))).alias("group"))
    alts = alts.select(
        "query_id",
        F.md5(F.to_json("group")).alias("group_key"),
        "group",
        terms(F.filter("group", lambda o: ~o["negated"])).alias("need"),
        terms(F.col("group")).alias("terms"),
    )
    # removed chunks still count here: frequencies choose the lookup only
    facts = reduce(DataFrame.unionByName, [spark.read.parquet(index.at(g.gen, "terms")) for g in index.generations])
    facts = alts.select(F.explode("need").alias("term")).distinct().join(facts, "term").groupBy("term").agg(F.sum("df").alias("df"))
    # a term that no chunk has makes the alternative empty
    whole = ["query_id", "group_key", "group", "need", "terms"]
    found = (
        alts.select(*whole, F.explode("need").alias("term"))
        .join(facts, "term")
        .groupBy("query_id", "group_key")
        .agg(
            F.any_value(F.struct("group", "need", "terms")).alias("g"),
            F.countDistinct("term").alias("known"),
            F.min_by("term", F.struct("df", "term")).alias("rarest"),
        )
        .select("query_id", "group_key", "g.*", F.size("g.need").alias("m"), "known", "rarest")
        .where("known = m")
    )
    found = cut_lineage(found.drop("known"), "alternatives")
    wanted = found.select(F.explode("terms").alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    # at most `buckets` numbers; they prune folders before anything is read
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    postings = _alive(spark, index, "postings", lambda d: d.where(F.col("bucket").isin(buckets)))
    return _Asked(found, postings)


def _among(postings: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Postings that can meet ``keys``. Whole numbers are met several times faster than strings: a hash leaves out what
    meets nothing, and the join that follows compares the columns themselves."""
    keys = keys.select(F.xxhash64(*by).alias("_key")).distinct()
    return postings.withColumn("_key", F.xxhash64(*by)).join(keys, "_key", "left_semi").drop("_key")


def _candidates(asked: _Asked) -> DataFrame:
    """(query_id, group_key, id, bound): chunks that have all terms of an alternative. Positions are not read.

    Each side that meets the postings is written first, so its size is known: small ones are broadcast and postings stay
    where they are.
    """
    lookup = asked.alternatives.select(
        "query_id", "group_key", "m", F.array_remove("need", F.col("rarest")).alias("others"), F.col("rarest").alias("term")
    )
    narrow = asked.postings.select("term", "id", "tf")
    found = cut_lineage(lookup.join(_among(narrow, lookup, ["term"]), "term").withColumnRenamed("tf", "own").drop("term"), "found")
    # other terms are looked for in the chunks that were found only
    narrow = _among(narrow, lookup.select(F.explode("others").alias("term")), ["term"])
    narrow = narrow.join(found.select("id").distinct(), "id", "left_semi")
    found = found.withColumn("term", F.explode_outer("others")).drop("others")
    found = found.join(narrow, ["term", "id"], "left").groupBy("query_id", "group_key", "m", "id").agg(
        F.count("tf").alias("met"), (F.coalesce(F.sum("tf"), F.lit(0)) + F.max("own")).alias("n")
    )
    found = found.where("met = m - 1").select("query_id", "group_key", "id", ((F.col("n") - F.col("m") + 1) * COVER).alias("bound"))
    return cut_lineage(found, "candidates")


def _at(places: Column, term: Column) -> Column:
    return F.coalesce(F.try_element_at(places, term), F.array().cast("array<int>"))


def _occurs(places: Column, op: Column) -> Column:
    """Whether an operand stands in the chunk, a phrase with its terms at their offsets."""
    starts = _at(places, op["terms"][0])
    return F.when(F.size(op["terms"]) == 1, F.size(starts) > 0).otherwise(
        F.exists(
            starts,
            lambda s: F.forall(
                F.arrays_zip(op["terms"].alias("t"), op["offsets"].alias("o")),
                lambda x: F.array_contains(_at(places, x["t"]), s + x["o"]),
            ),
        )
    )


def _score(asked: _Asked, picked: DataFrame) -> DataFrame:
    """(query_id, id, rank_cd) of the candidates (query_id, group_key, id) that satisfy their alternatives."""
    rows = picked.join(asked.alternatives.select("query_id", "group_key", "terms"), ["query_id", "group_key"])
    rows = rows.select("query_id", "group_key", "id", F.explode("terms").alias("term"))
    rows = cut_lineage(rows, "places")
    rows = rows.join(_among(asked.postings.select("term", "id", "positions"), rows, ["term", "id"]), ["term", "id"])
    rows = rows.groupBy("query_id", "group_key", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places")
    )
    rows = rows.join(asked.alternatives.select("query_id", "group_key", "group", "need"), ["query_id", "group_key"])
    rows = rows.where(F.forall("group", lambda o: _occurs(F.col("places"), o) != o["negated"]))
    hits = F.array_sort(
        F.flatten(
            F.transform(
                "need", lambda t, i: F.transform(_at(F.col("places"), t), lambda p: F.struct(p.alias("pos"), (i + 1).alias("which")))
            )
        )
    )
    one = rows.select("query_id", "id", lexical.cover_sum(hits, F.col("need")).alias("s"))
    return one.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("rank_cd"))


def match(index: SearchIndex, questions: DataFrame) -> DataFrame:
    """(query_id, id, rank_cd) of every chunk that satisfies an alternative of its question."""
    asked = _ask(index, questions)
    return _score(asked, _candidates(asked).select("query_id", "group_key", "id"))


def topk(index: SearchIndex, questions: DataFrame, k: int = fv.PER_LIST) -> DataFrame:
    """(query_id, id, rank_cd, rank): the k best matches of each question, the same as scoring all of them."""
    asked = _ask(index, questions)
    cand = _candidates(asked)
    order = [F.desc("rank_cd"), F.asc("id")]
    # a chunk that several alternatives found is bounded by their sum
    per = cand.groupBy("query_id", "id").agg(F.sum("bound").alias("bound"))
    crowded = per.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > k).select("query_id")
    parts = ["query_id", "group_key", "id"]
    if crowded.isEmpty():
        return top_k(_score(asked, cand.select(*parts)), ["query_id"], order, k, spread="id")
    keys = ["query_id", "id"]
    lead = cut_lineage(top_k(per, ["query_id"], [F.desc("bound"), F.asc("id")], k, spread="id", rank="nth").select(*keys), "lead")
    first = cut_lineage(_score(asked, cand.join(lead, keys, "left_semi").select(*parts)), "first")
    # the k-th of them; what is bounded below it, or stands behind it at an equal bound, is out
    last = top_k(first, ["query_id"], order, k, spread="id").where(F.col("rank") == k)
    floor = last.select("query_id", F.col("rank_cd").alias("least"), F.col("id").alias("last"))
    rest = per.join(crowded, "query_id", "left_semi").join(lead, keys, "left_anti").join(floor, "query_id", "left")
    reach = (F.col("bound") > F.col("least") + 1e-9) | ((F.col("bound") > F.col("least") - 1e-9) & (F.col("id") < F.col("last")))
    rest = cut_lineage(rest.where(F.col("least").isNull() | reach).select(*keys), "rest")
    if rest.isEmpty():
        return top_k(first, ["query_id"], order, k, spread="id")
    later = _score(asked, cand.join(rest, keys, "left_semi").select(*parts))
    return top_k(first.unionByName(later), ["query_id"], order, k, spread="id")
