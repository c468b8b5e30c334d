"""Approximate nearest neighbours over an inverted file with two-level cells.

Centroids are fitted on a bounded sample of rows: coarse ones first, then the fine ones of each coarse cell. A row finds
its cell through the coarse level, so it is compared with a number of centroids that grows with the square root of
their number only. How many cells a question probes is fitted to a stated recall on sample questions against exact
search; where only all cells reach it, all cells are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions.stats import top_k
from marginalia.operators.retrieval import _PART, PART_SCHEMA, QUERY_BLOCK, ROW_BLOCK, _matrix, _unit, block_table, blocks_of, dense_topk, rows_of
from marginalia.session import cut_lineage

#: Most rows that centroids are fitted on, and rows of the sample a centroid.
SAMPLE = 1 << 18
PER_CELL = 16
#: Coarse cells in which a row looks for its fine one.
WIDE = 4


@dataclass(frozen=True)
class Cells:
    """Fine centroids in the order of their coarse cells: those of coarse cell g are start[g]..start[g + 1]."""

    coarse: np.ndarray
    fine: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.fine)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The fine cell of each row, looked for in the `WIDE` nearest coarse cells."""
        best, cell = np.full(len(x), -np.inf), np.zeros(len(x), np.int32)
        sims = x @ self.coarse.T
        wide = min(WIDE, sims.shape[1])
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        for g in np.unique(near):
            rows = np.flatnonzero((near == g).any(axis=1))
            s = x[rows] @ self.fine[self.start[g] : self.start[g + 1]].T
            at = s.argmax(axis=1)
            value = s[np.arange(len(rows)), at]
            better = value > best[rows]
            best[rows[better]], cell[rows[better]] = value[better], self.start[g] + at[better]
        return cell

    def order(self, q: np.ndarray) -> np.ndarray:
        """All fine cells of each question, nearest first."""
        return np.argsort(-(q @ self.fine.T), axis=1, kind="stable").astype(np.int32)


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows; a centroid that loses all rows stays where it was."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        has = np.bincount(own, minlength=len(c)) > 0
        c[has] = _unit(total[has])
    return c


def fit_cells(sample: np.ndarray, cells: int, seed: int = 7) -> Cells:
    rng = np.random.default_rng(seed)
    coarse = _lloyd(sample, max(1, int(np.ceil(np.sqrt(cells)))), rng)
    own = np.concatenate([(sample[i : i + 8192] @ coarse.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
    fine, start = [], [0]
    for g in range(len(coarse)):
        mine = sample[own == g]
        k = max(1, round(cells * len(mine) / len(sample)))
        fine.append(_lloyd(mine, k, rng) if len(mine) else coarse[g : g + 1])
        start.append(start[-1] + len(fine[-1]))
    return Cells(coarse, np.concatenate(fine), np.array(start))


def build_index(vectors: DataFrame, cells: int | None = None, seed: int = 7, path: str | None = None) -> tuple[DataFrame, Cells]:
    """(rows (id, embedding, cell), cells). With `path` the rows are written there, a folder a cell range, and read back.

    Half the square root of the rows is the number of cells, at most SAMPLE / PER_CELL; larger cells are searched in parts.
    The sample has PER_CELL rows a cell, drawn by a hash of the id.
    """
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    n = vectors.count()
    cells = min(cells or max(1, int(n**0.5) // 2), SAMPLE // PER_CELL)
    size = max(cells * PER_CELL, min(n, 4096))
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(size).select("embedding").toArrow()
    if not len(drawn):
        return vectors.withColumn("cell", F.lit(0)), Cells(np.zeros((1, 1)), np.zeros((1, 1)), np.array([0, 1]))
    flat = drawn["embedding"].combine_chunks()
    found = fit_cells(_unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)), cells, seed)
    rows = assign(vectors, found)
    if path:
        rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(path)
        rows = vectors.sparkSession.read.parquet(path)
    return rows, found


def assign(df: DataFrame, cells: Cells) -> DataFrame:
    """Each row with its cell."""
    shared = df.sparkSession.sparkContext.broadcast(cells)  # at most SAMPLE / PER_CELL centroids

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(shared.value.nearest(_matrix(v)) if len(v) else [], dtype="int32")

    return df.withColumn("cell", nearest("embedding"))


def probe(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """Each question with the cells that it probes."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(shared.value.order(_matrix(v))[:, :probes]) if len(v) else [], dtype=object)

    return queries.withColumn("cells", first("embedding"))


@dataclass(frozen=True)
class Bins:
    """Neighbouring cells packed into bins of about equal size: cell c lies in bins first[c] .. first[c] + parts[c] - 1."""

    first: np.ndarray
    parts: np.ndarray
    number: int

    def visited(self, probed: np.ndarray) -> list[np.ndarray]:
        """The bins of each row of probed cells."""
        out = []
        for i in range(0, len(probed), 1024):
            some = probed[i : i + 1024]
            hit = np.zeros((len(some), self.number), bool)
            for p in range(int(self.parts.max(initial=0))):
                at, nth = np.nonzero(self.parts[some] > p)
                hit[at, self.first[some[at, nth]] + p] = True
            out += [np.flatnonzero(h).astype(np.int32) for h in hit]
        return out


def pack(counts: np.ndarray, most: int) -> Bins:
    """Cells in order, packed until a bin holds `most` rows; a larger cell is several bins by itself, an empty one is in none."""
    first, parts = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
    bins, room = 0, 0
    for c, n in enumerate(counts):
        if not n:
            continue
        parts[c] = -(-int(n) // most)
        if parts[c] > 1:
            first[c], bins, room = bins, bins + parts[c], 0
        else:
            if n > room:
                bins, room = bins + 1, most
            first[c], room = bins - 1, room - n
    return Bins(first, parts, bins)


def fit_probes(index: DataFrame, cells: Cells, queries: DataFrame, k: int, recall: float = 0.97, sample: int = 256) -> int:
    """The number of probed cells at which `recall` of the true k nearest of a sample of questions are found.

    The nearest rows come from exact search; at most `sample` questions, so sample * k rows reach the driver. All cells
    reach any recall.
    """
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "embedding")
    some = cut_lineage(some, "sample-questions")
    true = dense_topk(index.select("id", "embedding"), some, k).select("query_id", "id")
    true = true.join(index.select("id", "cell"), "id").select("query_id", "cell").toPandas()
    if not len(true):
        return 1
    asked = some.toPandas()
    order = cells.order(_matrix(asked["embedding"]))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :].repeat(len(order), 0), axis=1)
    row = dict(zip(asked["query_id"], range(len(asked))))
    need = np.sort(place[[row[q] for q in true["query_id"]], true["cell"].to_numpy()])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def ann_topk(index: DataFrame, cells: Cells, queries: DataFrame, k: int = fv.PER_LIST, probes: int | None = None, recall: float = 0.97) -> DataFrame:
    """(query_id, id, similarity, rank) from the probed cells of each question; probes are fitted to `recall` if not given.

    Neighbouring cells are packed into bins by their counted sizes, and a cell that holds a third of all rows is many bins.
    A question goes once to each bin that has a cell of its own, and a bin yields k rows per question, however many of its
    cells are probed. Cells that no question asks for go no further. What reaches the driver is a number a cell, at most
    SAMPLE / PER_CELL.
    """
    if probes is None:
        probes = fit_probes(index, cells, queries, k, recall)
    spark, every = index.sparkSession, probes >= len(cells)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"), "embedding")
    asked = asked.withColumn("cells", F.lit(None).cast("array<int>")) if every else probe(asked, cells, probes)
    asked = asked.drop("embedding")
    counts = np.zeros(len(cells), np.int64)
    size = index.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    if not every:
        asked = cut_lineage(asked, "probes")
        size = size.join(asked.select(F.explode("cells").alias("cell")).distinct(), "cell")
    size = size.toPandas()  # a row a cell
    if not len(size):
        return spark.createDataFrame([], f"{_PART}, rank int")
    counts[size["cell"].to_numpy()] = size["n"].to_numpy()
    width, n = int(size["d"].max()), int(counts.sum())
    bins = pack(counts, max(1, -(-n // blocks_of(n, width, ROW_BLOCK))))
    blocks = blocks_of(queries.count(), width, QUERY_BLOCK)
    shared = spark.sparkContext.broadcast(bins)

    @F.pandas_udf("array<int>")
    def bins_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(shared.value.visited(np.vstack(v.to_numpy())) if len(v) else [], dtype=object)

    @F.pandas_udf("int")
    def bin_of(cell: pd.Series, hashed: pd.Series) -> pd.Series:
        b, c = shared.value, cell.to_numpy()
        parts = b.parts[c]
        return pd.Series(np.where(parts > 0, b.first[c] + hashed.to_numpy() % np.maximum(parts, 1), -1).astype(np.int32))

    rows = index.select(
        F.col("id").cast("long").alias("id"), "embedding", "cell",
        bin_of("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    ).filter("bin >= 0")
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins.number - 1)) if every else bins_of("cells")).alias("q_bin"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q_block"), "query_id", "asked", "cells",
    )

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return PART_SCHEMA.empty_table()
        qids, asked, ids, x = q["query_id"].to_numpy(), rows_of(q["asked"]), v["id"].to_numpy(), rows_of(v["embedding"])
        if every:
            return block_table(qids, asked, ids, x, k)
        probed, own = np.vstack(q["cells"].to_numpy()), v["cell"].to_numpy()
        found = PART_SCHEMA.empty_table()
        for c in np.unique(own):
            who, rows = (probed == c).any(axis=1), own == c
            if who.any():
                found = pa.concat_tables([found, block_table(qids[who], asked[who], ids[rows], x[rows], k)])
                if len(found) > 4 * k * len(qids):
                    found = _first(found, k)
        return _first(found, k)

    found = asked.groupBy("q_bin", "q_block").cogroup(rows.groupBy("bin", "block")).applyInArrow(run, _PART)
    # a question has k rows a bin: one step ranks them
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k, spread="id", salts=1)


def _first(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each question."""
    q = found["query_id"].to_numpy()
    order = np.lexsort((found["id"].to_numpy(), -found["similarity"].to_numpy(), q))
    q = q[order]
    return found.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k]))


def ann_recall(approx: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """Share of the exact k nearest that the approximate k nearest contain, over all questions."""
    e = exact.filter(F.col("rank") <= k).select("query_id", "id")
    a = approx.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return e.join(a, ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("questions"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )


def save_cells(spark: SparkSession, cells: Cells, path: str) -> None:
    """Centroids as a table: level, nth, and for fine ones their coarse cell."""
    own = np.repeat(np.arange(len(cells.coarse)), np.diff(cells.start))
    rows = [(0, i, i, c.tolist()) for i, c in enumerate(cells.coarse)] + [(1, i, int(g), c.tolist()) for i, (g, c) in enumerate(zip(own, cells.fine))]
    spark.createDataFrame(rows, "level int, nth int, coarse int, center array<double>").write.parquet(path)


def load_cells(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(path).orderBy("level", "nth").collect()  # centroids: a bounded table
    coarse = np.array([r["center"] for r in rows if r["level"] == 0])
    fine = [r for r in rows if r["level"] == 1]
    own = np.array([r["coarse"] for r in fine])
    return Cells(coarse, np.array([r["center"] for r in fine]), np.searchsorted(own, np.arange(len(coarse) + 1)))
