"""Substring dedup of word windows behind a count-min prefilter.

1. Documents are dealt into blocks of bounded size. Each block sketches its windows: for each of two hash rows the
   cells it fills, and whether twice, sorted and stored as gaps, a piece for each shard of cells.
2. Shards merge the pieces of all blocks and tell each block which of its cells hold two windows or more in all. The
   sketch has about four cells a window, so it grows with the input, and no task or broadcast holds it whole.
3. A window whose cells are repeated in both rows may be repeated (the estimate is never too low); all others are
   unique. Candidates are cut into segments at places that depend on content only; of equal segments the first stays,
   so copies of a passage are settled by one row a segment.
4. Windows of the segments left are grouped exactly, by 96 bits of hash; all but the first place of each are removed.

The blocked documents are shuffled once and read by each of the four passes through the reused exchange.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.bytehash import WHITE, U, mix, pieces, powers, prefix, spans, word_spans
from marginalia.llm.frames import row_key, total_bytes

SHARD = 1 << 20
ROWS = 2
LONGEST = 64


def pack_gaps(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cells as gaps of one byte (255: a full step that adds no cell), then the `twice` bits."""
    gaps = np.diff(cells, prepend=0)
    steps = gaps // 255
    at = np.arange(len(gaps)) + np.cumsum(steps)
    out = np.full(len(gaps) + int(steps.sum()), 255, np.uint8)
    out[at] = gaps % 255
    return len(cells).to_bytes(4, "little") + out.tobytes() + np.packbits(twice).tobytes()


def unpack_gaps(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    bits = -(-n // 8)
    raw = np.frombuffer(blob, np.uint8, len(blob) - 4 - bits, 4)
    cells = np.cumsum(raw, dtype=np.int64)[raw < 255]
    return cells, np.unpackbits(np.frombuffer(blob, np.uint8, bits, len(blob) - bits), count=n).astype(bool)


@dataclass
class Block:
    """The documents of one block in order of (id, row key), with their windows laid end to end."""

    table: pa.Table
    k: int

    def __post_init__(self) -> None:
        self.table = self.table.sort_by([("sid", "ascending"), ("rk", "ascending")])
        sid, rk = self.table["sid"].to_numpy(), self.table["rk"].to_numpy()
        same = np.zeros(len(sid), bool)
        same[1:] = (sid[1:] == sid[:-1]) & (rk[1:] == rk[:-1])
        #: rows equal in id and text are one document: only the first is counted
        self.same = same
        nth = np.arange(len(sid)) - np.searchsorted(sid, sid)
        h, g, doc, at, words = [], [], [], [], []
        for row, buf, off in pieces(self.table["text"]):
            start, end, first = word_spans(buf, off, WHITE)
            words.append(np.diff(first))
            if len(start) < self.k:
                continue
            pair = []
            values = buf.astype(U) + U(1)
            for which in (0, 1):
                word = spans(prefix(values, which), start, end, which)
                p = prefix(word, which)
                n = len(start) - self.k + 1
                pair.append(mix((p[self.k :] - p[: -self.k]) * powers(which, len(p))[1][:n]))
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(pair[0])]
            ok = (np.arange(len(own)) + self.k <= first[own + 1]) & ~same[row + own]
            h.append(pair[0][ok])
            g.append(pair[1][ok])
            doc.append((row + own)[ok])
            at.append((np.arange(len(own)) - first[own])[ok])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.words = cat(words, np.int64)
        self.h, self.g, self.doc, self.at = cat(h, U), cat(g, U), cat(doc, np.int64), cat(at, np.int64)
        self.sid = sid
        #: place in the order of a document's id: rows that share an id follow each other
        self.place = (nth.astype(np.int64)[self.doc] << 40) | self.at if len(self.doc) else self.at

    def cells(self, width: int) -> list[np.ndarray]:
        return [mix(self.h + U(0x9E3779B97F4A7C15 * (r + 1) % 2**64)).astype(np.int64) & (width - 1) for r in range(ROWS)]

    def sketch(self, width: int) -> tuple[list[int], list[bytes]]:
        keys, blobs = [], []
        for r, c in enumerate(self.cells(width)):
            cells, n = np.unique(c, return_counts=True)
            for a, z, shard in _runs(cells >> 20):
                keys.append(r << 40 | shard)
                blobs.append(pack_gaps(cells[a:z] & (SHARD - 1), n[a:z] > 1))
        return keys, blobs

    def candidates(self, width: int, masks: dict[int, bytes]) -> np.ndarray:
        """Windows whose cells all hold two windows or more."""
        ok = np.ones(len(self.h), bool)
        for r, c in enumerate(self.cells(width)):
            order = np.argsort(c)
            c = c[order]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            cells = c[new]
            many = np.zeros(len(cells), bool)
            for a, z, shard in _runs(cells >> 20):
                many[a:z] = np.unpackbits(np.frombuffer(masks[r << 40 | shard], np.uint8), count=z - a).astype(bool)
            ok[order[~many[np.cumsum(new) - 1]]] = False
        return ok

    def segments(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of candidates cut by content: first window, number of windows, and two hashes."""
        at = np.flatnonzero(ok)
        if not len(at):
            z = np.zeros(0, np.int64)
            return z, z, z.astype(U), z.astype(U)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (self.doc[at[1:]] != self.doc[at[:-1]]) | ((self.h[at[1:]] & U(15)) == 0)
        first = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        new |= nth % LONGEST == 0
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        out = []
        for which, x in enumerate((self.h, self.g)):
            p = prefix(x[at], which)
            out.append(mix(spans(p, first, first + size, which) + size.astype(U)))
        return at[first], size, out[0], out[1]


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(x):
        return []
    edge = np.flatnonzero(np.diff(x)) + 1
    a = np.concatenate([[0], edge])
    return list(zip(a.tolist(), np.append(edge, len(x)).tolist(), x[a].tolist()))


def _firsts(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Of equal (h, g), whether a place is the first."""
    order = np.lexsort((np.arange(len(h)), g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[new]] = True
    return out


class Told:
    """What the other side of a cogroup tells a block: masks by shard, and removed segments and windows by place."""

    def __init__(self, side: pa.Table) -> None:
        kind = side["kind"].to_numpy()
        self.masks = {}
        for i in np.flatnonzero(kind == 0).tolist():
            self.masks[side["x"][i].as_py()] = side["blob"][i].as_py()
        self.gone = []
        for k in (1, 2):
            part = side.filter(pa.array(kind == k))
            self.gone.append(np.stack([part["x"].to_numpy(), part["y"].to_numpy()], axis=1))

    def holds(self, which: int, sid: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each (sid, place) is among the removed ones."""
        have = self.gone[which]
        if not len(have) or not len(sid):
            return np.zeros(len(sid), bool)
        both = np.concatenate([have, np.stack([sid, place], axis=1)])
        order = np.lexsort((np.arange(len(both)), both[:, 1], both[:, 0]))
        s = both[order]
        new = np.ones(len(both), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        known = np.zeros(group[-1] + 1, bool)
        known[group[order < len(have)]] = True
        out = np.zeros(len(both), bool)
        out[order] = known[group]
        return out[len(have) :]


SIDE = "block bigint, kind int, x bigint, y bigint, blob binary"


def repeated_windows(docs: DataFrame, *, k: int = 20, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word ranges, [from, to) pairs) of every row.

    A word is removed if a window of k words that covers it also starts earlier: in a smaller id, or in the same
    document before. Windows are judged on the input. Null ids come last, in order of their text's hash; rows that share
    an id follow each other in that order; rows equal in id and text are one document, removed alike. Null texts have
    no words; texts of fewer than k words lose none. No rows: no rows. Other columns are not read.
    """
    size = total_bytes(docs, text_col)
    blocks = max(1, -(-size // block_bytes))
    width = 1 << max(20, int(np.ceil(np.log2(max(1, size / 3)))))
    rows = docs.select(
        F.col(id_col).alias("id"),
        row_key(id_col, text_col).alias("rk"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    # ids take the order; null ids follow all others, told apart by their text
    rows = rows.withColumn("sid", F.coalesce(F.col("id").cast("bigint"), F.lit(2**63 - 1)))
    rows = rows.withColumn(
        "block", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("rk")).otherwise(F.xxhash64("id")), F.lit(blocks))
    )
    rows = rows.repartition(min(blocks, 20_000), "block")

    def sketch(t: pa.Table) -> pa.Table:
        keys, blobs = Block(t, k).sketch(width)
        return pa.table(
            {"shard": pa.array(keys, pa.int64()), "block": pa.array([t["block"][0].as_py()] * len(keys), pa.int64()), "blob": pa.array(blobs, pa.binary())}
        )

    def merge(t: pa.Table) -> pa.Table:
        seen = np.zeros(SHARD, np.uint8)
        for blob in t["blob"]:
            cells, twice = unpack_gaps(blob.as_py())
            seen[cells] = np.minimum(seen[cells] + 1 + twice, 2)
        told = [np.packbits(seen[unpack_gaps(b.as_py())[0]] > 1).tobytes() for b in t["blob"]]
        n = len(told)
        return pa.table(
            {
                "block": t["block"], "kind": pa.array([0] * n, pa.int32()), "x": t["shard"],
                "y": pa.array([0] * n, pa.int64()), "blob": pa.array(told, pa.binary()),
            }
        )

    def seg(t: pa.Table, side: pa.Table) -> pa.Table:
        b, told = Block(t, k), Told(side)
        first, _, h, g = b.segments(b.candidates(width, told.masks))
        own = _firsts(h, g)
        return _places(b, first[own], h[own], g[own])

    def win(t: pa.Table, side: pa.Table) -> pa.Table:
        b, told = Block(t, k), Told(side)
        live = _live(b, told, b.candidates(width, told.masks))
        own = live[_firsts(b.h[live], b.g[live])]
        return _places(b, own, b.h[own], b.g[own])

    def _places(b: Block, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> pa.Table:
        n = len(at)
        block = b.table["block"][0].as_py() if len(b.table) else 0
        return pa.table(
            {
                "h": h.view(np.int64), "g": (g >> U(32)).astype(np.uint32).view(np.int32),
                "x": b.sid[b.doc[at]] if n else np.zeros(0, np.int64), "y": b.place[at],
                "block": np.full(n, block, np.int64),
            }
        )

    def _live(b: Block, told: Told, cand: np.ndarray) -> np.ndarray:
        """Candidate windows of segments that are the first of their kind here and elsewhere."""
        first, n, h, g = b.segments(cand)
        stay = _firsts(h, g)
        stay &= ~told.holds(0, b.sid[b.doc[first]], b.place[first]) if len(first) else stay
        first, n = first[stay], n[stay]
        return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else first

    def last(t: pa.Table, side: pa.Table) -> pa.Table:
        b, told = Block(t, k), Told(side)
        cand = b.candidates(width, told.masks)
        live = _live(b, told, cand)
        stay = _firsts(b.h[live], b.g[live])
        stay &= ~told.holds(1, b.sid[b.doc[live]], b.place[live]) if len(live) else stay
        cand[live[stay]] = False
        return _result(b, cand)

    def _result(b: Block, gone: np.ndarray) -> pa.Table:
        first = np.concatenate([[0], np.cumsum(b.words)])
        edge = np.zeros(first[-1] + 1, np.int64)
        w = first[b.doc[gone]] + b.at[gone]
        np.add.at(edge, w, 1)
        np.add.at(edge, w + k, -1)
        hit = np.cumsum(edge)[:-1] > 0
        sha, removed, ranges = [], [], []
        for i, text in enumerate(b.table["text"]):
            if b.same[i]:
                sha.append(sha[-1]), removed.append(removed[-1]), ranges.append(ranges[-1])
                continue
            m = hit[first[i] : first[i + 1]]
            words = text.as_py().split()
            if m.any():
                words = [x for x, y in zip(words, m.tolist()) if not y]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            removed.append(int(m.sum()))
            flip = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]])))
            ranges.append(flip.tolist())
        return pa.table(
            {
                "doc_id": b.table["id"], "n_words": b.words, "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(ranges, pa.list_(pa.int32())),
            }
        )

    place = "h bigint, g int, x bigint, y bigint, block bigint"
    masks = rows.groupBy("block").applyInArrow(sketch, "shard bigint, block bigint, blob binary")
    masks = masks.groupBy("shard").applyInArrow(merge, SIDE)

    def later(found: DataFrame, kind: int) -> DataFrame:
        """All but the first place of each hash, as told to the blocks."""
        order = Window.partitionBy("h", "g").orderBy("x", "y")
        found = found.withColumn("nth", F.row_number().over(order)).where("nth > 1")
        return found.select("block", F.lit(kind).alias("kind"), "x", "y", F.lit(None).cast("binary").alias("blob"))

    def told(side: DataFrame, fn, schema: str) -> DataFrame:
        return rows.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(fn, schema)

    segs = later(told(masks, seg, place), 1)
    wins = later(told(masks.union(segs), win, place), 2)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed array<int>"
    return told(masks.union(segs).union(wins), last, out)
