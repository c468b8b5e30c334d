"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: the binary Golay code of 23 bits, whose 4,096 words lie within 3 bits of
every 23-bit string. A fingerprint is cut into blocks; two fingerprints that differ in few bits differ in at most
`slack` bits of some block. Of that block, take the anchor nearest to the one: the other lies within 3 + slack of it.
So each fingerprint is copied to every anchor within 3 + slack of each of its blocks, and compared per anchor only.
Bits of a block beyond 23 extend the code by all their values (radius 0).

Only distinct fingerprints are copied, and an anchor yields the links of a spanning forest, never all pairs: documents
equal in their fingerprint cost one row, and a dense group of n fingerprints n - 1 links an anchor. An anchor with
more members than `cell` is a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytehash import mix
from marginalia.llm.components import components
from marginalia.llm.frames import packed, row_key, small
from marginalia.session import cut_lineage

N, CHECK, RADIUS = 23, 11, 3
GENERATOR = 0b101011100011


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, lower-cased in A-Z and joined by a space; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - k + 1)
    stops = ends[min(k, len(words)) - 1 :]
    h = xxhash.xxh64_digest
    return np.frombuffer(
        b"".join([h(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), stops.tolist())]), dtype=">u8"
    ).astype(np.uint64)


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits set in over half the hashes, as `words` 64-bit words: the first of the hashes themselves, more of remixes."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    for i in range(words):
        each = mix(h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) if i else h
        bits = np.unpackbits(each.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        counts = bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(
    docs: DataFrame, k: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False
) -> DataFrame:
    """id, row key and `words` 64-bit words f0, f1, ... (as signed longs) of each text; null is empty, empty is zero.

    With `sets`, a shingle counts once however often it is repeated, and fid, a hash of the shingle set, comes too.
    """
    names = [f"f{i}" for i in range(words)] + ["fid"] * sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.zeros((b.num_rows, words + sets), np.uint64)
            for i, t in enumerate(b.column("text")):
                h = shingle_hashes(t.as_py() or b"", k)
                if sets:
                    h = np.unique(h)
                    f[i, words] = xxhash.xxh64_intdigest(h.tobytes(), 42)
                f[i, :words] = fingerprint(h, words)
            cols = [pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), *cols], ["id", "rk", *names])

    rows = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("binary").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, rk bigint, " + ", ".join(f"{n} bigint" for n in names))


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(N - 1, CHECK - 1, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - CHECK)), x)
    return x


@cache
def near_words(reach: int) -> np.ndarray:
    """For each syndrome, the error patterns of at most `reach` bits that lead to a code word; -1 fills up."""
    errors = [sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(N), r)]
    e = np.array(errors, dtype=np.int64)
    s = _syndrome(e)
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    nth = np.arange(len(s)) - np.searchsorted(s, s)
    out = np.full((1 << CHECK, int(nth.max()) + 1), -1, dtype=np.int64)
    out[s, nth] = e
    return out


def cut_blocks(words: int, blocks: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of `blocks` blocks; a block lies within one 64-bit word."""
    if blocks % words:
        raise ValueError("each 64-bit word has the same number of blocks")
    per = blocks // words
    cuts = [64 * i // per for i in range(per + 1)]
    return [(w, a, z - a) for w in range(words) for a, z in zip(cuts, cuts[1:])]


def anchors(f: np.ndarray, blocks: list[tuple[int, int, int]], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor key) of each row of f (n x words, unsigned) for every anchor within 3 + slack of a block."""
    rows, keys = [], []
    for nth, (word, shift, width) in enumerate(blocks):
        part = ((f[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        code, more = part & ((1 << N) - 1), part >> N
        extra = max(0, width - N)
        s = _syndrome(code)
        for flips in range(min(slack, extra) + 1):
            table = near_words(RADIUS + slack - flips)[s]
            at, col = np.nonzero(table >= 0)
            word_id = (code[at] ^ table[at, col]) >> CHECK
            for c in combinations(range(extra), flips):
                flipped = more[at] ^ sum(1 << b for b in c)
                rows.append(at)
                keys.append((nth << 56) | (flipped << (N - CHECK)) | word_id)
    return np.concatenate(rows), np.concatenate(keys)


def near_pairs(f: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the rows of f that differ in at most `limit` bits; nearest links come first.

    Prim's order over the rows that have any near row: each row joins by its nearest link to those joined before.
    """
    n = len(f)
    has = np.zeros(n, bool)
    for a in range(0, n, 256):
        d = sum(np.bitwise_count(f[a : a + 256, None, w] ^ f[None, :, w]).astype(np.uint16) for w in range(f.shape[1]))
        has[a : a + 256] = (d <= limit).sum(axis=1) > 1
    left = np.flatnonzero(has)
    a, b = [], []
    best = np.full(len(left), 1 << 15)
    via = np.zeros(len(left), np.int64)
    while len(left):
        i = int(np.argmin(best))
        p = left[i]
        if best[i] <= limit:
            a.append(via[i])
            b.append(p)
        left, best, via = np.delete(left, i), np.delete(best, i), np.delete(via, i)
        if len(left):
            d = np.bitwise_count(f[left] ^ f[p]).sum(axis=1)
            closer = d < best
            best, via = np.where(closer, d, best), np.where(closer, p, via)
    return np.array(a, np.int64), np.array(b, np.int64)


def links(prints: DataFrame, words: int, limit: int, blocks: int, slack: int, cell: int = 4096) -> DataFrame:
    """Distinct prints (fid, f0, ...) to links (u, v) of fids: a spanning forest for each anchor.

    Complete for all pairs within `limit` bits if limit < blocks * (slack + 1); beyond, for those that a block favours.
    """
    names = [f"f{i}" for i in range(words)]
    cuts = cut_blocks(words, blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                f = np.stack([s.column(n).to_numpy().view(np.uint64) for n in names], axis=1)
                row, key = anchors(f, cuts, slack)
                out = [pa.array(key), pa.array(s.column("fid").to_numpy()[row])]
                out += [pa.array(f[row, i].view(np.int64)) for i in range(words)]
                yield pa.RecordBatch.from_arrays(out, ["key", "fid", *names])

    def compare(table: pa.Table) -> pa.Table:
        f = np.stack([table.column(n).to_numpy().view(np.uint64) for n in names], axis=1)
        fid = table.column("fid").to_numpy()
        a, b = near_pairs(f, limit)
        return pa.table({"u": fid[a], "v": fid[b]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    cols = ", ".join(f"{n} bigint" for n in names)
    copies = cut_lineage(prints.mapInArrow(spread, f"key bigint, fid bigint, {cols}"), "anchors")
    crowded = copies.groupBy("key").count().where(F.col("count") > cell)
    crowded = crowded.select("key", F.ceil(F.col("count") / cell).cast("int").alias("cells"))
    copies = copies.join(crowded, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fid"), F.col("cells")).cast("int")
    copies = copies.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    copies = copies.select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fid", *names
    )
    return copies.groupBy("key", "i", "j").applyInArrow(compare, "u bigint, v bigint").distinct()


def simhash_components(
    docs: DataFrame, *, k: int = 4, limit: int = 4, blocks: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_copies of each row.

    Documents link at `limit` bits or fewer; the component is named by its smallest id. With three blocks an anchor of
    4,096 a block; `blocks=2` has 2^21 anchors a half and suits billions of fingerprints; both find every link.
    Null and empty texts have fingerprint zero and link like any other. Null ids take part and name a component only if
    it has no other id (then null). Repeated rows are copies. No rows: no rows. Other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, k, 1, id_col, text_col).select("id", "f0"), "prints")
    distinct = prints.groupBy("f0").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    pairs = links(distinct.select(F.col("f0").alias("fid"), "f0"), 1, limit, blocks, limit // blocks)
    roots = components(pairs)
    whole = distinct.join(roots, F.col("f0") == F.col("node"), "left")
    whole = whole.select("f0", "least", "n_copies", F.coalesce("root", "f0").alias("root"))
    names = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(names, "root").select(F.col("f0").alias("f"), "component_id", "n_copies")
    return prints.join(named, F.col("f0") == F.col("f")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_copies",
    )


def set_links(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the sets (sorted, distinct) whose Jaccard similarity is `least` or more; exact.

    Sets so alike share one of their rarest members (as many as may be missing, and one), so only those that do are
    compared, and only while no links join them yet.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    shared = np.empty(len(count), bool)
    shared[rank] = count > 1
    own = [np.sort(x) for x in np.split(rank[code], np.cumsum(sizes)[:-1])] if n else []
    rare = [x[: len(x) - int(np.ceil(least * len(x) - 1e-6)) + 1] for x in own]
    rare = [x[shared[x]] for x in rare]
    member = np.concatenate([*rare, np.zeros(0, np.int64)])
    holder = np.repeat(np.arange(n), [len(x) for x in rare])
    by = np.argsort(member, kind="stable")
    member, holder = member[by], holder[by]
    group, mark = np.arange(n), np.zeros(len(count), bool)
    a, b = [], []
    for i in range(n):
        lo, hi = np.searchsorted(member, rare[i]), np.searchsorted(member, rare[i], "right")
        if not len(lo):
            continue
        meets = np.bincount(np.concatenate([holder[x:y] for x, y in zip(lo.tolist(), hi.tolist())]), minlength=n)
        meets[i:] = 0
        near = np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]) - 1e-6
        others = np.flatnonzero((meets > 0) & near & (group != group[i]))
        mark[own[i]] = True
        for j in others[np.argsort(-meets[others], kind="stable")].tolist():
            if group[i] == group[j]:
                continue
            both = int(mark[own[j]].sum())
            if both >= least * (sizes[i] + sizes[j] - both):
                a.append(j)
                b.append(i)
                group[group == group[j]] = group[i]
        mark[own[i]] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def confirmed(texts: DataFrame, k: int, least: float, part_bytes: int) -> DataFrame:
    """Texts (root, fid, t) to links (u, v) of fids: a spanning forest of the similar pairs of each root.

    Every pair of a root is told by its sets of k-word shingles. A root of more than `part_bytes` is a grid of tasks.
    """

    def compare(table: pa.Table) -> pa.Table:
        fid = table.column("fid").to_numpy()
        a, b = set_links([np.unique(shingle_hashes(t.as_py() or b"", k)) for t in table.column("t")], least)
        return pa.table({"u": fid[a], "v": fid[b]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    large = texts.groupBy("root").agg(F.sum(F.octet_length("t")).alias("size")).where(F.col("size") > part_bytes)
    large = small(large.select("root", F.ceil(F.col("size") / part_bytes).cast("int").alias("cells")))
    texts = texts.join(large, "root", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fid"), F.col("cells")).cast("int")
    texts = texts.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    texts = texts.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fid", "t")
    return texts.groupBy("root", "i", "j").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    k: int = 5,
    similarity: float = 0.8,
    words: int = 3,
    limit: int = 44,
    blocks: int = 9,
    slack: int = 1,
    part_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one of smallest id (nulls last, then by text hash).

    Sets of k-word shingles with Jaccard similarity of `similarity` or more are near. At 0.8 some 15 % of SimHash bits
    differ, so candidates are taken at `limit` of 64 * `words` bits. The texts that candidate links join are one group,
    and every pair of a group is told by the texts themselves, so no link among candidates is lost.
    Equal shingle sets (by their hash) count as one text; different sets of equal fingerprint are compared like others.
    A repeated shingle counts once. Texts without words are one group. Null texts are empty. All columns of `docs` are kept. No rows: no rows.
    """
    docs_in = docs.select(
        packed(docs).alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"),
        F.col(text_col).alias("text"),
    )
    prints = cut_lineage(fingerprints(docs, k, words, id_col, text_col, sets=True), "prints")
    names = [f"f{i}" for i in range(words)]
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rk")
    text_of = prints.groupBy("fid", *names).agg(F.min(order).alias("o"))
    text_of = cut_lineage(text_of, "texts")
    pairs = links(text_of.select("fid", *names), words, limit, blocks, slack)
    pairs = cut_lineage(pairs, "pairs")
    groups = cut_lineage(components(pairs), "groups")
    ends = text_of.join(groups, F.col("fid") == F.col("node"))
    ends = ends.select("fid", F.col("root").alias("base"), F.col("o.id").alias("pid"), F.col("o.rk").alias("prk"))
    texts = docs_in.select("id", "rk", "text").join(
        ends, F.col("id").eqNullSafe(F.col("pid")) & (F.col("rk") == F.col("prk"))
    )
    texts = texts.groupBy("fid").agg(F.first("base").alias("root"), F.first("text").cast("binary").alias("t"))
    near = confirmed(cut_lineage(texts, "ends"), k, similarity, part_bytes)
    roots = components(near)
    group = text_of.join(roots, F.col("fid") == F.col("node"), "left").select(
        F.coalesce("root", "fid").alias("root"), "o"
    )
    first = group.groupBy("root").agg(F.min("o").alias("o")).select(
        F.col("o.id").alias("kid"), F.col("o.rk").alias("krk")
    )
    kept = docs_in.select("row", "id", "rk").join(
        first, F.col("id").eqNullSafe(F.col("kid")) & (F.col("rk") == F.col("krk")), "left_semi"
    )
    # rows equal in id and text are one document read more than once
    one = F.row_number().over(_same_row())
    return kept.withColumn("nth", one).where("nth = 1").select("row.*")


def _same_row():
    from pyspark.sql import Window

    return Window.partitionBy("id", "rk").orderBy("rk")
