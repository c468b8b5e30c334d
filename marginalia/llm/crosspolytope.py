"""Approximate nearest neighbours by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the signed axis it then lies nearest
to is its hash. A table may join several hashes, the last over fewer axes, so that buckets hold some `bucket` rows at
any size of input. Queries probe the buckets of nearly nearest axes in every table, and candidates are ranked by their
exact inner product. Largest inner products become nearest directions by one more coordinate that brings every vector
to the largest norm (0 for queries).

Equal vectors are indexed once, with their smallest ids. The number of probes is fitted on a bounded sample of queries
against all rows; every row is indexed, and a bucket of more than `cell` rows is split, its queries going to each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, scaled to a rotation."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@dataclass
class Hashes:
    """`tables` tables of `joined` hashes over `axes` axes each, the last over `last`."""

    dim: int
    top: float
    tables: int
    joined: int
    last: int
    seed: int = 11

    def __post_init__(self) -> None:
        self.axes = 1 << int(np.ceil(np.log2(self.dim + 1)))
        r = np.random.default_rng(self.seed)
        self.signs = r.choice([-1.0, 1.0], size=(self.tables, self.joined, 3, self.axes))

    @property
    def buckets(self) -> int:
        return (2 * self.axes) ** (self.joined - 1) * 2 * self.last

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            out[:, : self.dim] = x / norm[:, None]
        else:
            out[:, : self.dim] = x / self.top
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm / self.top) ** 2))
        return out

    def signed(self, lifted: np.ndarray, table: int) -> list[np.ndarray]:
        """For each joined hash the value along every signed axis (positive axes, then negative ones)."""
        out = []
        for j in range(self.joined):
            y = lifted
            for s in self.signs[table, j]:
                y = hadamard(y * s)
            y = y[:, : self.last] if j == self.joined - 1 else y
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def bucket(self, lifted: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(lifted), np.int64)
        for v in self.signed(lifted, table):
            out = out * v.shape[1] + v.argmax(axis=1)
        return out

    def probes(self, lifted: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets of least loss (squared gaps to the nearest axis, summed over the hashes), best first."""
        code = loss = None
        for v in self.signed(lifted, table):
            m = min(n, v.shape[1])
            axis = np.argsort(-v, axis=1, kind="stable")[:, :m]
            gap = np.take_along_axis(v, axis, axis=1)
            gap = (gap[:, :1] - gap) ** 2
            if code is None:
                code, loss = axis, gap
            else:
                code = (code[:, :, None] * v.shape[1] + axis[:, None, :]).reshape(len(v), -1)
                loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(v), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :n]
            code, loss = np.take_along_axis(code, order, axis=1), np.take_along_axis(loss, order, axis=1)
        return code


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of each query; ties to the smaller id."""
    rows, cols, scores = [], [], []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ v.T
        if len(v) > k:
            edge = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
            r, c = np.nonzero(s >= edge[:, None])
        else:
            r, c = np.nonzero(np.ones(s.shape, bool))
        x = s[r, c]
        order = np.lexsort((ids[c], -x, r))
        r, c, x = r[order], c[order], x[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[nth < k] + a), cols.append(c[nth < k]), scores.append(x[nth < k])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (double) of the vectors that take part: finite, not zero, of the commonest length; ids not null."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where("id is not null and size(v) > 0").where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return v.where(F.size("v") == (size["n"] if size else 0))


def nearest(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    recall: float = 0.97,
    tables: int = 6,
    bucket: int = 256,
    sample: int = 96,
    cell: int = 8192,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k rows found of largest inner product.

    Probes are fitted so that `recall` of the true neighbours of `sample` queries lie in probed buckets, in the end in all
    of them. A query whose probed buckets hold fewer than k rows is ranked against all rows, in blocks. Rows that
    cannot take part (see `usable`) are neither queries nor candidates. Equal vectors are told apart by id, ties go to
    the smaller; a repeated id counts once for each of its vectors. Fewer than k candidates: all of them. No rows: no
    rows. Other columns are not read. `report` gets the fitted figures.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(
        usable(vectors, id_col, vec_col).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v")), "vectors"
    )
    out = "query_id bigint, rank int, vec_id bigint, score double"
    order = Window.partitionBy("h", "g").orderBy("id")
    ids = rows.select("h", "g", "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    ids = ids.groupBy("h", "g").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("h", "g").agg(
        F.first("v").alias("v"), F.max((F.col("id") % every == 0).cast("int")).alias("asks")
    )
    one = cut_lineage(one.join(ids, ["h", "g"]).withColumn("id", F.element_at("ids", 1)), "distinct")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = one.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not facts[0]:
        return spark.createDataFrame([], out)
    axes = 1 << int(np.ceil(np.log2(facts[2] + 1)))
    want, joined = max(1, facts[0] // bucket), 1
    while (2 * axes) ** joined < want:
        joined += 1
    last = min(axes, 1 << max(0, int(np.ceil(np.log2(max(1, want / (2 * axes) ** (joined - 1) / 2))))))
    hashes = Hashes(facts[2], facts[1], tables, joined, last)
    probes = fit_probes(one, hashes, k, recall, sample, report)

    asks = one.where("asks = 1").select("id", "v")

    def spread(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                x = hashes.lift(_matrix(s.column("v")), n > 0)
                for t in range(tables):
                    code = hashes.probes(x, t, n) if n else hashes.bucket(x, t)[:, None]
                    row = np.repeat(np.arange(len(x)), code.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(code.ravel()), *(s.column(c).take(pa.array(row)) for c in ("id", "v"))],
                        ["t", "b", "id", "v"],
                    )

    kind = "t int, b bigint, id bigint, v array<double>"
    base = one.select("id", "v").mapInArrow(lambda it: spread(it, 0), kind)
    ask = asks.mapInArrow(lambda it: spread(it, probes), kind)
    crowded = base.groupBy("t", "b").count().where(F.col("count") > cell)
    crowded = crowded.select("t", "b", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    crowded = cut_lineage(crowded, "crowded")
    split = lambda d: d.join(crowded, ["t", "b"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    base = split(base).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    ask = split(ask).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def rank(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vid, qid = mine["id"].to_numpy(), theirs["id"].to_numpy()
        r, c, s = _best(_matrix(theirs["v"]), _matrix(mine["v"]), vid, k + 1)
        return pa.table({"q": qid[r], "id": vid[c], "score": s})

    keys = ["t", "b", "part"]
    found = base.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(rank, "q bigint, id bigint, score double")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    found = cut_lineage(found.join(one.select("id", "ids"), "id").select("q", "id", "score", "ids"), "found")

    # queries whose buckets hold too few rows meet all rows, in blocks
    total = rows.count()
    have = found.groupBy("q").agg(F.sum(F.size("ids")).alias("have"))
    short = asks.join(have, asks["id"] == have["q"], "left").where(F.coalesce("have", F.lit(0)) < min(k + 1, total))
    short = cut_lineage(short.select("id", "v"), "short")
    n_short = short.count()
    if report is not None:
        report["short"] = n_short
    if n_short:
        blocks, parts = -(-n_short // 1024), -(-facts[0] // cell)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cut = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        here = one.select(F.lit(-1).alias("t"), each(blocks).alias("b"), cut(parts).alias("part"), "id", "v")
        there = short.select(F.lit(-1).alias("t"), cut(blocks).alias("b"), each(parts).alias("part"), "id", "v")
        whole = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(rank, "q bigint, id bigint, score double")
        whole = whole.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        whole = whole.join(one.select("id", "ids"), "id").select("q", "id", "score", "ids")
        found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(whole)

    found = found.select("q", "score", F.explode("ids").alias("id"))
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    found = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))
    name = one.where("asks = 1").select("h", "g", F.col("id").alias("q"))
    who = rows.where(F.col("id") % every == 0).select("h", "g", F.col("id").alias("query_id"))
    near = who.join(name, ["h", "g"]).join(found, "q")
    near = near.select(
        "query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near")
    )
    near = near.select("query_id", F.posexplode("near").alias("rank", "x"))
    return near.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )


def fit_probes(one: DataFrame, hashes: Hashes, k: int, recall: float, sample: int, report: dict | None) -> int:
    """Probes a table so that `recall` of the true neighbours of a sample of queries lie in a probed bucket of some table."""
    some = one.where("asks = 1").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow()
    if not len(some):
        return 1
    q, qid = _matrix(some["v"]), some["id"].to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r, c, s = _best(q, _matrix(b.column("v")), b.column("id").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[r]), pa.array(s), b.column("id").take(pa.array(c)), b.column("v").take(pa.array(c))],
                    ["q", "score", "id", "v"],
                )

    true = one.select("id", "v").mapInArrow(scan, "q bigint, score double, id bigint, v array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = true.where("q <> id").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).toArrow()
    if not len(true):
        return 1
    at = {x: i for i, x in enumerate(qid.tolist())}
    owner = np.array([at[x] for x in true["q"].to_pylist()])
    lifted, theirs = hashes.lift(q, True), hashes.lift(_matrix(true["v"]), False)
    most = min(hashes.buckets, 4096)
    while True:
        first = np.full(len(owner), most)
        for t in range(hashes.tables):
            goal = hashes.bucket(theirs, t)
            for i in range(len(lifted)):
                mine = np.flatnonzero(owner == i)
                code = hashes.probes(lifted[i : i + 1], t, most)[0]
                hit = code[None, :] == goal[mine][:, None]
                first[mine] = np.minimum(first[mine], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        # every vector lies in some bucket, so the goal is met with all of them at the latest
        if most == hashes.buckets or (first < most).mean() >= recall:
            break
        most = min(hashes.buckets, 4 * most)
    probes = int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
    if report is not None:
        report.update(probes=probes, buckets=hashes.buckets, tables=hashes.tables, fitted=float((first < probes).mean()))
    return min(probes, most)
