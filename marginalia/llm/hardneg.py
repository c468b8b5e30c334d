"""Hard-negative mining with Kronecker-packed products.

Vectors become integers, floor(scale * x). The components of several candidates, biased to be no less than 0, are laid
into separated fields of one wide integer; one multiplication by an anchor's component then serves all of them, and the
sums over the components are unpacked field by field into exact scores. Field widths come from bounds counted on the
data. Where two fields or more fit into the 53 bits that a double holds exactly, the wide integers are multiplied as
such, by BLAS; else they are Python's integers of any width.

Every candidate meets every anchor, in a grid of bounded blocks: first an anchor's best rows of its own label, then, for
each of these positives, the best rows of other labels inside its score range. Blocks keep a few rows an anchor, so
what is shuffled and ranked afterwards is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.stats import top_k
from marginalia.session import cut_lineage

#: Bits of an integer that a double holds exactly.
EXACT = 53


class Packing:
    """How candidates are packed: the bias of a component, the width of a field, fields in an integer, and its kind."""

    def __init__(self, least: int, most: int, weight: int) -> None:
        """Candidate components lie in least..most; the absolute components of no anchor sum up to more than `weight`."""
        self.bias = -least
        self.offset = weight * (most - least)  # no biased score is beyond it, in either direction
        self.width = max(1, (2 * self.offset).bit_length())
        self.fields = (EXACT - 1) // self.width
        self.exact = self.fields >= 2
        if not self.exact:
            self.fields = 8

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Integers of `fields` candidates each, by component: (ceil(n / fields), dim)."""
        n = -(-len(rows) // self.fields)
        wide = np.zeros((n * self.fields, rows.shape[1]), np.int64 if self.exact else object)
        wide[: len(rows)] = rows
        wide += self.bias
        wide = wide.reshape(n, self.fields, -1)
        out = wide[:, 0].copy()
        for i in range(1, self.fields):
            out += wide[:, i] << (self.width * i)
        return out.astype(np.float64) if self.exact else out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Exact inner products (anchors, n) of integer anchors with the n candidates of `packed`."""
        kind = np.float64 if self.exact else object
        total = np.dot(anchors.astype(kind), packed.T)
        total = total.astype(np.int64) if self.exact else total
        total = total + sum(self.offset << (self.width * i) for i in range(self.fields))
        mask = (1 << self.width) - 1
        own = self.offset + self.bias * anchors.sum(axis=1, dtype=np.int64)
        out = np.empty((*total.shape, self.fields), np.int64)
        for i in range(self.fields):
            out[:, :, i] = ((total >> (self.width * i)) & mask).astype(np.int64) - own[:, None]
        return out.reshape(len(anchors), -1)[:, :n]


def _whole(column: pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors, shorter ones filled with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    sizes = np.diff(flat.offsets.to_numpy())
    if (sizes == dim).all():
        return values.reshape(len(flat), dim)
    out = np.zeros((len(flat), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _firsts(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k allowed columns of each row, highest first, ties to the smaller column."""
    low = np.where(ok, scores, np.iinfo(np.int64).min)
    if low.shape[1] > k:
        edge = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        ok = ok & (low >= edge[:, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, v and label of the rows that take part: nothing null, every component finite."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("bigint").alias("label"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return x.where("id is not null and v is not null and label is not null").where(~F.exists("v", bad))


def bounds(rows: DataFrame, scale: int) -> tuple[int, int, int, int, int] | None:
    """Rows, longest vector, least and greatest component, and the greatest sum of absolute components, as integers."""
    whole = lambda x: F.floor(x.cast("double") * scale).cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    # sums of absolute values are bounded by double sums with one unit a component to spare
    weight = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(F.floor(x.cast("double") * scale).cast("double")) + 1)
    if not (r := rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")),
        F.min(F.least(zero, whole(F.array_min("v")))), F.max(F.greatest(zero, whole(F.array_max("v")))), F.max(weight),
    ).first())[0]:
        return None
    n, dim, least, most, weight = r[0], r[1], int(r[2] or 0), int(r[3] or 0), int(r[4] or 0)
    if weight * max(most, -least, 1) >= 1 << 62:
        raise ArithmeticError("inner products of these vectors do not fit into 64 bits")
    return n, dim, least, most, weight


def hard_negatives(
    vectors: DataFrame,
    *,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    label: Column | None = None,
    anchor_block: int = 2048,
    row_block: int = 16_384,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; positives their first rows of the same label and another id;
    negatives the first rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    Scores are exact; higher ones come first, ties by smaller id. `label` replaces the label (of columns id and label).

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Vectors of
    unequal length are filled with zeros. Of rows that share an id each takes part by itself, as an anchor too. A positive
    of a negative score has no negatives (the range is empty), nor has a row alone in its label. No rows: no rows.
    Components whose products pass 64 bits raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col)
    if label is not None:
        rows = rows.withColumn("label", label.cast("bigint"))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    facts = bounds(rows, scale)
    if facts is None:
        return spark.createDataFrame([], out)
    n, dim, least, most, weight = facts
    packing = Packing(least, most, weight)
    block = max(512, min(row_block, n // 48))  # some tasks for small inputs too
    blocks = max(1, -(-n // block))
    ablocks = max(1, -(-n // (every * anchor_block)))
    parts = min(blocks * ablocks, 20_000)

    asks = rows.where(F.pmod("id", F.lit(every)) == 0)
    # rows that share an id are told apart by a number
    nth = Window.partitionBy("id").orderBy("label", F.col("v").cast("array<double>"))
    asks = asks.withColumn("nth", F.row_number().over(nth)).withColumn("ab", F.pmod(F.xxhash64("id", "nth"), F.lit(ablocks)))
    asks = cut_lineage(asks, "anchors")
    cand = rows.withColumn("cb", F.pmod(F.xxhash64(F.lit("c"), "id"), F.lit(blocks)))
    cand = cand.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(ablocks - 1)))).withColumn("ab", F.col("ab").cast("bigint"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("cb")

    def grid(anchors: DataFrame, fn, kind: str) -> DataFrame:
        a = anchors.select("*", each).repartition(parts, "cb", "ab")
        return a.groupBy("cb", "ab").cogroup(cand.repartition(parts, "cb", "ab").groupBy("cb", "ab")).applyInArrow(fn, kind)

    def sides(a: pa.Table, c: pa.Table):
        c = c.sort_by([("label", "ascending"), ("id", "ascending")])
        return a, _whole(a["v"], dim, scale), a["label"].to_numpy(), c["id"].to_numpy(), c["label"].to_numpy(), _whole(c["v"], dim, scale)

    def own_label(a: pa.Table, c: pa.Table) -> pa.Table:
        got = []
        if len(a) and len(c):
            a, av, al, cid, cl, cv = sides(a, c)
            aid = a["id"].to_numpy()
            for x in np.unique(al):
                mine = np.flatnonzero(al == x)
                lo, hi = np.searchsorted(cl, [x, x + 1])
                for z in range(lo, hi, 2048):
                    to = min(z + 2048, hi)
                    packed = packing.pack(cv[z:to])
                    for i in range(0, len(mine), 512):
                        m = mine[i : i + 512]
                        s = packing.scores(av[m], packed, to - z)
                        r, k = _firsts(s, cid[z:to] != aid[m][:, None], positives)
                        got.append((m[r], cid[z + k], s[r, k]))
        who, pid, score = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"id": a["id"].combine_chunks().take(pa.array(who)), "nth": a["nth"].combine_chunks().take(pa.array(who)), "positive_id": pid, "positive_score": score})

    pos = grid(asks, own_label, "id bigint, nth int, positive_id bigint, positive_score bigint")
    pos = top_k(pos, ["id", "nth"], [F.desc("positive_score"), F.col("positive_id")], positives, "positive_id")
    # a positive of a score below 0 has an empty range
    pos = pos.where("positive_score >= 0").groupBy("id", "nth").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")
    )
    asks = cut_lineage(asks.join(pos, ["id", "nth"]), "positives")

    def other_labels(a: pa.Table, c: pa.Table) -> pa.Table:
        got = []
        p = a["p"].combine_chunks()
        first, flat = p.offsets.to_numpy(), p.flatten()
        pscore = flat.field("positive_score").to_numpy()
        if len(a) and len(c):
            c_order = c.sort_by("id")
            av, al = _whole(a["v"], dim, scale), a["label"].to_numpy()
            cid, cl, cv = c_order["id"].to_numpy(), c_order["label"].to_numpy(), _whole(c_order["v"], dim, scale)
            first = first - first[0]
            size = np.diff(first)
            for z in range(0, len(cid), 2048):
                to = min(z + 2048, len(cid))
                packed = packing.pack(cv[z:to])
                for i in range(0, len(a), 256):
                    m = np.arange(i, min(i + 256, len(a)))
                    s = packing.scores(av[m], packed, to - z)
                    other = cl[z:to] != al[m][:, None]
                    for j in range(int(size[m].max(initial=0))):
                        has = np.flatnonzero(size[m] > j)
                        at = first[m[has]] + j
                        edge = pscore[at]
                        x = s[has]
                        top, bottom = (edge // 100) * high + (edge % 100) * high // 100, -(-low * edge // 100)
                        r, k = _firsts(x, other[has] & (x <= top[:, None]) & (x >= bottom[:, None]), negatives)
                        got.append((m[has][r], at[r], cid[z + k], x[r, k]))
        who, at, nid, score = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(4))
        at, who = pa.array(at, pa.int64()), pa.array(who, pa.int64())
        return pa.table(
            {
                "id": a["id"].combine_chunks().take(who), "nth": a["nth"].combine_chunks().take(who),
                "p": flat.field("rank").take(at), "positive_id": flat.field("positive_id").take(at),
                "positive_score": flat.field("positive_score").take(at), "negative_id": nid, "negative_score": score,
            }
        )

    found = grid(
        asks, other_labels,
        "id bigint, nth int, p int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    found = top_k(found, ["id", "nth", "p"], [F.desc("negative_score"), F.col("negative_id")], negatives, "negative_id")
    return found.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
