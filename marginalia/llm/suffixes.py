"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of `length` bytes that starts at two places is found in three steps:

1. Each window of `length` bytes is filed under its minimizer, the least hash of its inner strings of `gram` bytes.
   Windows of one minimizer in a row form a context. Equal windows have equal minimizers, so only contexts under one
   minimizer can share a window; minimizers that occur once are done. Equal contexts are counted and go on once.
2. The contexts of a bounded bucket of minimizers are laid end to end. Their bounded suffix order gives the transform;
   backward extension, breadth first from the strings of 14, finds common prefixes by increasing length: the string
   found at step n + 1 whose right boundary is still open closes it with the value n. Expansion stops at `length`:
   boundaries still open are inside runs of suffixes that share `length` bytes. A run that weighs two or more is
   repeated.
3. Blocks of documents learn which windows of their contexts are repeated, and cover their bytes.

A minimizer with more than `cell` distinct contexts is a grid of buckets, each of two parts of its contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytehash import U, mix, pieces, powers, prefix, spans
from marginalia.llm.frames import row_key, total_bytes


#: Bytes of texts whose contexts are found at once: what that takes should fit a core's cache.
TEXT_PIECE = 1 << 17


def sevens(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place: the seven symbols from it in one number, 0 from a separator on, and how many symbols come before that."""
    n = len(text)
    wide = np.concatenate([text.astype(np.int64), np.zeros(6, np.int64)])
    two = (wide[:-1] << 9) | wide[1:]
    four = (two[:-2] << 18) | two[2:]
    packed = (four[:n] << 27) | (two[4 : 4 + n] << 9) | wide[6 : 6 + n]
    stop = np.flatnonzero(text == 0)
    left = np.repeat(stop, np.diff(stop, prepend=-1)) - np.arange(n)
    packed &= np.array([-1 << (9 * (7 - k)) for k in range(8)], np.int64)[np.minimum(left, 7)]
    return packed, left


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (0: a separator, each of its own kind, in order of place, one at the end; else byte + 1)
    by their first `depth` symbols at least. Prefix tripling from packed sevens (three ranks of 21 bits are one key; doubling
    beyond 2 MB); settled suffixes are left out of later rounds."""
    n = len(text)
    packed, left = sevens(text)
    open_ = left >= 7
    sa = np.argsort(packed)
    ends = np.flatnonzero(~open_[sa])  # equal so far, but for the kind of separator
    sa[ends] = sa[ends][np.lexsort((sa[ends], packed[sa[ends]]))]
    p = packed[sa]
    new = np.ones(n, bool)
    new[1:] = (p[1:] != p[:-1]) | ~open_[sa[1:]]
    rank = np.zeros(n, np.int64)
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = slot
    h = 7
    times = 3 if n <= 1 << 21 else 2
    todo = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < depth and len(todo):
        at = sa[todo]
        if times == 3:
            # a suffix that ends within 2 h is told by its second rank, which no other has
            key = (rank[at] << 42) | (rank[at + h] << 21) | rank[np.minimum(at + 2 * h, n - 1)]
            order = np.argsort(key)
            key = key[order]
            differ = key[1:] != key[:-1]
        else:
            first, second = rank[at], rank[at + h]
            order = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort((first << 32) | second)
            first, second = first[order], second[order]
            differ = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = at[order]
        sa[todo] = at
        new = np.ones(len(at), bool)
        new[1:] = differ
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        todo = todo[~(new & np.append(new[1:], True))]
        h *= times
    return sa


def short_boundaries(text: np.ndarray, sa: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: whether it shares fewer than `m` symbols with the row before, and fewer than `m` - 1; m is 14 at most."""
    packed, left = sevens(text)
    same = lambda x: np.append(False, x[1:] == x[:-1])
    row, room = packed[sa], left[sa]
    room = np.minimum(room, np.append(0, room[:-1]))
    closed = []
    for k in (m, m - 1):
        if k <= 7:
            alike = same(row >> (9 * (7 - k)))
        else:
            alike = same(row) & same(packed[np.minimum(sa + (k - 7), len(sa) - 1)])
        closed.append(~(alike & (room >= k)))
        closed[-1][0] = True
    return closed[0], closed[1]


def open_boundaries(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """By row of the suffix order: whether it shares fewer than `length` symbols with the row before.

    The intervals of short strings are many and wide, and the packed symbols that were sorted tell their boundaries: expansion
    begins at strings of 14 symbols. An interval is expanded when its right boundary was closed by its own last symbol.
    """
    n = len(sa)
    bwt = text[sa - 1].astype(np.uint16)  # the row of suffix 0 wraps round to the last separator
    bwt[bwt == 0] = 257  # separators are read no further
    by_symbol = np.argsort(bwt, kind="stable")
    seps = int((text == 0).sum())
    lf = np.zeros(n, np.int64)
    bytes_first = by_symbol[: n - seps]
    lf[bytes_first] = seps + np.arange(n - seps)
    head = text[sa]
    begin = min(14, length)
    now, before = short_boundaries(text, sa, begin)
    closed = np.append(now, True)
    lb = np.flatnonzero(now)
    rb = np.append(lb[1:], n) - 1
    fresh = ~np.append(before, True)[rb + 1]
    lb, rb = lb[fresh], rb[fresh]
    for _ in range(begin, length):
        if not len(lb):
            break
        size = rb - lb + 1
        who = np.repeat(np.arange(len(lb)), size)
        row = np.repeat(lb - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        ok = bwt[row] < 257
        row, who = row[ok], who[ok]
        # rows ascend, and the step keeps the order of rows within a symbol: by symbol is by target
        order = np.argsort(bwt[row], kind="stable")
        to, who = lf[row[order]], who[order]
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (who[1:] != who[:-1]) | (head[to[1:]] != head[to[:-1]])
        a = np.flatnonzero(new)
        lb, rb = to[a], to[np.append(a[1:], len(to)) - 1]
        fresh = ~closed[rb + 1]
        closed[rb + 1] = True
        lb, rb = lb[fresh], rb[fresh]
    return closed[:n]


def repeated_starts(parts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part, the starts of strings of `length` bytes that stand at two places or more of all (weighted) parts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int16)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    sa = suffix_order(text, length)
    group = np.cumsum(open_boundaries(text, sa, length)) - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)[sa]
    long = sa + length <= ends[owner] - 1
    weight = np.bincount(group[long], weights=weights[owner[long]], minlength=int(group[-1]) + 1)
    hit = long & (weight[group] >= 2)
    at = np.sort(sa[hit])
    begin = ends - sizes - 1
    cut = np.searchsorted(at, np.append(begin, ends[-1]))
    return [at[a:z] - b for a, z, b in zip(cut[:-1], cut[1:], begin)]


def contexts(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """minimizer, first and last window start, two content hashes, and whether it may repeat itself, of each context.

    Contexts never cross texts. Equal windows of one context have different places of the minimizer, the first of
    which then lies before the last window.
    """
    n, w = len(buf), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z.astype(U), z.astype(U), z
    values = buf.astype(U) + U(1)
    p = prefix(values)
    g = mix((p[gram:] - p[:-gram]) * powers(0, len(p))[1][: n - gram + 1])  # spans() of all inner strings, without an index
    full = np.concatenate([g, np.full((-len(g)) % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    lens = np.diff(off)
    within = np.arange(windows) + length <= np.repeat(off[1:], lens)[:windows]
    new = np.ones(windows + 1, bool)
    new[1:windows] = (least[1:] != least[:-1]) | (within[1:] != within[:-1])
    edge = np.flatnonzero(new)
    a, z = edge[:-1], edge[1:] - 1
    a, z = a[within[a]], z[within[a]]
    size = (z - a).astype(U)
    c = mix(spans(p, a, z + length) + size)
    d = mix(spans(prefix(values, 1), a, z + length, 1) + size)
    here = np.concatenate([[0], np.cumsum(g[:windows] == least)])
    return least[a], a, z, c, d, (here[z] > here[a]).astype(np.int64)


class Corpus:
    """The documents of a block, ordered, with their contexts."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        self.table = table.sort_by([("sid", "ascending"), ("rk", "ascending")])
        self.block = table["block"][0].as_py() if len(table) else 0
        parts = []
        for row, buf, off in pieces(self.table["text"], TEXT_PIECE):
            a, lo, hi, c, d, own = contexts(buf, off, length, gram)
            doc = np.searchsorted(off, lo, side="right") - 1
            # empty texts share an offset; the last of them owns the place
            parts.append((a, lo - off[doc], hi - off[doc], c, d, row + doc, own))
        cat = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7
        self.a, self.c, self.d = (cat[i].view(np.int64) if len(cat[i]) else cat[i].astype(np.int64) for i in (0, 3, 4))
        self.lo, self.hi, self.doc = cat[1].astype(np.int64), cat[2].astype(np.int64), cat[5].astype(np.int64)
        self.own = cat[6].astype(np.int32)

    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order that sorts contexts, the first of each kind in it, and kind sizes."""
        order = np.lexsort((self.d, self.c, self.a))
        new = np.ones(len(order), bool)
        same = np.ones(max(len(order) - 1, 0), bool)
        for x in (self.a, self.c, self.d):
            y = x[order]
            same &= y[1:] == y[:-1]
        new[1:] = ~same
        first = np.flatnonzero(new)
        return order, first, np.diff(np.append(first, len(order)))


def long_repeats(
    docs: DataFrame,
    *,
    length: int = 400,
    gram: int = 32,
    block_bytes: int = 8 << 20,
    bucket_bytes: int = 2 << 20,
    cell: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges) of every row.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same row or another.
    Strings are judged on the input and never cross rows. Null texts are empty. Repeated rows are repeats of each
    other; null and repeated ids are kept as they are. No rows: no rows. Other columns are not read.
    """
    size = total_bytes(docs, text_col)
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // bucket_bytes))
    rows = docs.select(
        F.col(id_col).alias("id"),
        row_key(id_col, text_col).alias("rk"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    rows = rows.withColumn("sid", F.xxhash64("id")).withColumn("block", F.pmod(F.xxhash64("id", "rk"), F.lit(blocks)))
    rows = rows.repartition(min(blocks, 20_000), "block")
    key = ["a", "c", "d"]

    def count(t: pa.Table) -> pa.Table:
        x = Corpus(t, length, gram)
        order, first, n = x.kinds()
        at = order[first]
        return pa.table(
            {
                "a": x.a[at], "c": x.c[at], "d": x.d[at],
                "m": (np.int64(x.block) << 3) | (np.minimum(n, 2) << 1) | x.own[at].astype(np.int64),
            }
        )

    def emit(t: pa.Table, side: pa.Table) -> pa.Table:
        x = Corpus(t, length, gram)
        order, first, _ = x.kinds()
        have = {}
        if len(side):
            at = order[first]
            have = dict(zip(zip(x.a[at].tolist(), x.c[at].tolist(), x.d[at].tolist()), at.tolist()))
        out = {"bucket": [], "a": [], "c": [], "d": [], "w": [], "part": []}
        # a context is cut from the block's bytes: taking out the whole text each time costs a long text's length squared
        text = x.table["text"].combine_chunks().cast(pa.large_binary())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist()
        raw = memoryview(text.buffers()[2] or b"")
        doc, lo, hi = (v.tolist() for v in (x.doc, x.lo, x.hi))
        for a, c, d, w, cells in zip(*(side[n].to_pylist() for n in ("a", "c", "d", "w", "cells"))):
            at = have[a, c, d]
            part = bytes(raw[off[doc[at]] + lo[at] : off[doc[at]] + hi[at] + length])
            mine = c % cells
            where = [(a % buckets, 0, 0)] if cells == 1 else [(a, min(mine, o), max(mine, o)) for o in range(cells)]
            for bucket in where:
                for n, v in zip(out, (f"{bucket[0]}/{bucket[1]}/{bucket[2]}", a, c, d, w, part)):
                    out[n].append(v)
        kinds = {"bucket": pa.string(), "w": pa.int32(), "part": pa.binary()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    def expand(t: pa.Table) -> pa.Table:
        got = repeated_starts(t["part"].to_pylist(), t["w"].to_numpy(), length)
        runs = []
        for s in got:
            edge = np.flatnonzero(np.diff(s) > 1) if len(s) else s
            runs.append(
                np.stack([s[np.append(0, edge + 1)], s[np.append(edge, len(s) - 1)] + 1], axis=1).ravel().tolist() if len(s) else []
            )
        hit = pa.array([bool(r) for r in runs])
        out = pa.table({n: t[n] for n in key} | {"runs": pa.array(runs, pa.list_(pa.int32()))})
        return out.filter(hit)

    def cover(t: pa.Table, side: pa.Table) -> pa.Table:
        x = Corpus(t, length, gram)
        told: dict[tuple, list[int]] = {}
        for a, c, d, r in zip(*(side[n].to_pylist() for n in (*key, "runs"))):
            told.setdefault((a, c, d), []).extend(r)
        spans_of: dict[int, list[tuple[int, int]]] = {}
        order, first, n = x.kinds()
        for f, m in zip(first.tolist(), n.tolist()):
            at = order[f]
            runs = told.get((int(x.a[at]), int(x.c[at]), int(x.d[at])))
            if runs:
                for i in order[f : f + m].tolist():
                    lo = int(x.lo[i])
                    spans_of.setdefault(int(x.doc[i]), []).extend(
                        (lo + p, lo + q - 1 + length) for p, q in zip(runs[::2], runs[1::2])
                    )
        out = {"doc_id": x.table["id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
        for i, text in enumerate(x.table["text"]):
            raw, merged = text.as_py(), []
            for a, z in sorted(spans_of.get(i, [])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            sha, at = hashlib.sha256(), 0
            for a, z in merged:
                sha.update(raw[at:a])
                at = z
            sha.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(z - a for a, z in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(sha.hexdigest())
            out["removed"].append([y for m in merged for y in m])
        kinds = {"kept_sha256": pa.string(), "removed": pa.list_(pa.int32())}
        return pa.table(
            {n: v if n == "doc_id" else pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()}
        )

    # block, weight and self-repeat in one number, and the filter that joins would push down: so all uses of the counts
    # read the same columns and share one exchange
    found = rows.groupBy("block").applyInArrow(count, "a bigint, c bigint, d bigint, m bigint")
    found = found.where("a is not null and c is not null and d is not null").repartition(*key)
    kinds = found.groupBy(*key).agg(F.sum(F.expr("(m >> 1) & 3")).alias("w"), F.min("m").alias("m"), F.max(F.expr("m & 1")).alias("own"))
    kinds = kinds.withColumn("block", F.shiftright("m", 3)).drop("m")
    per = kinds.groupBy("a").agg(F.sum(F.col("w") + F.col("own")).alias("total"), F.count(F.lit(1)).alias("kinds")).where("total >= 2")
    reps = kinds.join(per, "a").select(
        *key, "block", F.least("w", F.lit(2)).cast("int").alias("w"), F.ceil(F.col("kinds") / cell).cast("int").alias("cells")
    )
    parts = rows.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(
        emit, "bucket string, a bigint, c bigint, d bigint, w int, part binary"
    )
    hits = parts.groupBy("bucket").applyInArrow(expand, "a bigint, c bigint, d bigint, runs array<int>")
    told = found.withColumn("block", F.shiftright("m", 3)).drop("m").join(hits, key)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        cover,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<int>",
    )
