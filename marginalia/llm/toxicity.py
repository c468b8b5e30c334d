"""Toxicity by a small convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

Training is numpy on a bounded sample of labelled rows; scoring runs in tasks over every whole text. A word's embedding
is the sum of those of the hashed word and its hashed prefixes. Thresholds are calibrated on a part of the sample kept from training: one for all
texts, which the score moves to 0.5, and one by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytehash import pieces, prefix, spans, word_spans
from marginalia.llm.frames import packed
from marginalia.session import cut_lineage

#: Bytes that stand in no word: ASCII other than letters, digits and bytes of longer UTF-8 characters.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


#: Besides the whole word, prefixes of so many bytes have an embedding of their own, so that word forms share one.
PREFIXES = (4, 5)


#: A sample with fewer toxic rows teaches nothing that carries over; every text then scores the share of toxic rows.
LEAST_TOXIC = 20
#: At a threshold, at most this share of the clean rows kept from training is called toxic.
MOST_WRONG = 0.01


def word_ids(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed numbers (from 1; 0 is padding) of each word and its prefixes, texts end to end; each text's first word."""
    start, end, first = word_spans(buf, offsets, GAP)
    p = prefix(FOLD[buf].astype(np.uint64) + np.uint64(1))
    parts = [spans(p, start, end)] + [
        spans(p, start, np.minimum(end, start + k)) * np.uint64(2 * k + 1) for k in PREFIXES
    ]
    return np.stack([(h >> np.uint64(64 - bits)).astype(np.int32) + 1 for h in parts], axis=1), first


@dataclass
class TextCnn:
    """Parameters and the fit of the classifier. `shift` moves the global threshold to 0.5."""

    bits: int = 15
    dim: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 7
    shift: float = 0.0
    base: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        v = (1 << self.bits) + 1
        self.emb = (r.standard_normal((v, self.dim)) * 0.1).astype(np.float32)
        self.emb[0] = 0
        self.conv = [
            (r.standard_normal((w, self.dim, self.filters)) / np.sqrt(w)).astype(np.float32)
            for w in self.widths
        ]
        self.bias = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = (r.standard_normal(len(self.widths) * self.filters) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.ready = False
        self._padded = self._e = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_padded": None, "_e": None}

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled activations (texts x features) and the places of the maxima. Texts end in padding of the widest filter."""
        n = len(first) - 1
        wide = max(self.widths)
        lens = np.diff(first)
        at = np.arange(len(ids)) + np.repeat(np.arange(n) * wide, lens)
        padded = np.zeros((len(ids) + n * wide, ids.shape[1]), np.int32)
        padded[at] = ids
        start = first[:-1] + np.arange(n) * wide
        total = np.concatenate([padded, np.zeros((wide, padded.shape[1]), np.int32)])
        e = self.emb[total[:, 0]]
        for c in range(1, total.shape[1]):
            e += self.emb[total[:, c]]
        self._e = e
        parts, places, owner = [], [], None
        for w, kernel, bias in zip(self.widths, self.conv, self.bias):
            z = e[: len(padded)] @ kernel[0]
            for o in range(1, w):
                z += e[o : o + len(padded)] @ kernel[o]
            top = np.maximum.reduceat(z, start, axis=0)
            parts.append(np.maximum(top + bias, 0))
            if self.want_places:
                if owner is None:
                    owner = np.repeat(np.arange(n), lens + wide)
                row, col = np.nonzero(z == top[owner])
                place = np.zeros((n, self.filters), np.int64)
                place[owner[row[::-1]], col[::-1]] = row[::-1]
                places.append(place)
        self._padded = total
        return np.concatenate(parts, axis=1), np.array(places)

    want_places = False

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        x, _ = self.pooled(ids, first)
        return (x @ self.out + self.out_bias - self.shift).astype(np.float64)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(first) - 1, self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, first), -40, 40)))

    def fit(
        self, docs: list[np.ndarray], y: np.ndarray, lang: np.ndarray, negatives: float = 1.0, epochs: int = 10,
        batch: int = 64,
    ) -> TextCnn:
        """Adam on the logistic loss, classes weighted alike; a fifth of the rows calibrates."""
        y = np.asarray(y, np.float32)
        self.base = float(y.mean()) if len(y) else 0.0
        if y.sum() < LEAST_TOXIC or y.min() == y.max():
            return self
        r = np.random.default_rng(self.seed)
        order = r.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-6), 0.5 / max(1 - y[train].mean(), 1e-6))
        params = [self.emb, *self.conv, *self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        self.want_places = True
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            r.shuffle(train)
            for a in range(0, len(train), batch):
                rows = train[a : a + batch]
                ids, first = lay([docs[i] for i in rows])
                x, places = self.pooled(ids, first)
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))
                g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                grads = [np.zeros_like(q) for q in params]
                grads[-2][:] = x.T @ g + 1e-4 * self.out
                grads[-1][:] = g.sum()
                dx = np.outer(g, self.out) * (x > 0)
                for i, w in enumerate(self.widths):
                    d = dx[:, i * self.filters : (i + 1) * self.filters]
                    grads[1 + len(self.widths) + i][:] = d.sum(axis=0)
                    for o in range(w):
                        at = places[i] + o
                        grads[1 + i][o] = np.einsum("nf,nfd->df", d, self._e[at])
                        back = (d[:, :, None] * self.conv[i][o].T[None]).reshape(-1, self.dim)
                        for c in range(self._padded.shape[1]):
                            np.add.at(grads[0], self._padded[at, c].ravel(), back)
                grads[0][0] = 0
                step += 1
                for q, gr, mm, vv in zip(params, grads, m, v):
                    mm *= 0.9
                    mm += 0.1 * gr
                    vv *= 0.999
                    vv += 0.001 * gr * gr
                    q -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-7)
        self.want_places, self._padded, self._e, self.ready = False, None, None, True
        z = np.concatenate([self.logits(*lay([docs[i] for i in held[a : a + 256]])) for a in range(0, len(held), 256)])
        scale = np.where(y[held] == 1, 1.0, negatives)  # a sampled clean row stands for so many
        self.shift = best_cut(z, y[held], scale)
        for name in sorted({x for x in lang[held] if x}):
            own = lang[held] == name
            # few rows say little about a language: its cut is drawn to the global one by 150 rows of weight
            cut = best_cut(z[own], y[held][own], scale[own]) if 0 < y[held][own].sum() < own.sum() else self.shift
            cut = (own.sum() * cut + 150 * self.shift) / (own.sum() + 150)
            self.by_lang[name] = float(1 / (1 + np.exp(-(cut - self.shift))))
        return self


def lay(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts end to end, and each one's first."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    return np.concatenate(docs) if docs else np.zeros((0, 1 + len(PREFIXES)), np.int32), first


def best_cut(z: np.ndarray, y: np.ndarray, scale: np.ndarray) -> float:
    """The logit from which calling a row toxic gives the best F1; in the middle of the gap below it."""
    order = np.argsort(-z, kind="stable")
    z, y, scale = z[order], y[order], scale[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(scale) + y.sum())
    last = np.concatenate([z[1:] < z[:-1], [True]])
    i = int(np.argmax(np.where(last, f1, -1)))
    below = z[i + 1] if i + 1 < len(z) else z[i] - 2
    cut = float((z[i] + max(below, z[i] - 4)) / 2)
    clean = z[y == 0]
    return max(cut, float(np.quantile(clean, 1 - MOST_WRONG, method="higher")) + 1e-6) if len(clean) else cut


def train_rows(doc_id) -> F.Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_toxic: int = 2000,
    most_clean: int = 4000,
    longest: int = 50_000,
    **model: int,
) -> TextCnn:
    """A classifier fitted on at most `most_toxic` and `most_clean` labelled texts, of `longest` characters or fewer.

    The rows are those of least id hash, the same in each run. Rows held out by `train_rows` are never read. Labels
    that repeat an id count as toxic if any does; null ids and null labels teach nothing. With one class or
    fewer than LEAST_TOXIC toxic rows the score is the share of toxic rows everywhere.
    """
    lab = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where("lid is not null and toxic is not null").where(train_rows(F.col("lid")))
    lab = lab.groupBy("lid").agg(F.max("toxic").alias("toxic"))
    lab = cut_lineage(lab, "labels")
    most = {0: most_clean, 1: most_toxic}
    count = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    parts = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64("lid"), "lid").limit(2 * n) for y, n in most.items()]
    ids = parts[0].unionByName(parts[1])
    got = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")
    ).where((F.length(text_col) <= longest) & F.col("id").isNotNull())
    got = got.join(F.broadcast(ids), F.col("id") == F.col("lid")).select("lid", "text", "lang", "toxic")
    parts = [got.where(F.col("toxic") == y).orderBy(F.xxhash64("lid"), "lid").limit(n) for y, n in most.items()]
    rows = parts[0].unionByName(parts[1]).toArrow().sort_by([("lid", "ascending")])
    cnn = TextCnn(**model)
    words: list[np.ndarray] = []
    for _, buf, off in pieces(rows["text"]):
        ids_, first = word_ids(buf, off, cnn.bits)
        words += [ids_[a:b] for a, b in zip(first[:-1], first[1:])]
    lang = np.array([x or "" for x in rows["lang"].to_pylist()], dtype=object)
    y = rows["toxic"].to_numpy().astype(np.float32)
    return cnn.fit(words, y, lang, max(1.0, count.get(0, 0) / max(1, int((y == 0).sum()))))


def score(docs: DataFrame, cnn: TextCnn, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the score of each whole text; null and empty texts have that of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(cnn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [np.zeros(0)]
            for _, buf, off in pieces(b.column(b.num_columns - 1)):
                got.append(model.scores(*word_ids(buf, off, model.bits)))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(got))], [*b.schema.names[:-1], "score"])

    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("binary").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double")


def lang_threshold(cnn: TextCnn, lang) -> F.Column:
    """The calibrated threshold of a row's language; 0.5 for languages that the sample lacks."""
    out = F.lit(0.5)
    for name, cut in cnn.by_lang.items():
        out = F.when(lang == name, cut).otherwise(out)
    return out


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score at 0.5), lang_threshold and rejected (score at that) of every row.

    No rows: no rows. A null id is not held out. Extra columns are not read. Repeated rows score alike.
    """
    cnn = train(docs, labels)
    rows = docs.select("doc_id", "lang", "text")
    cut = lang_threshold(cnn, F.col("lang"))
    return score(rows, cnn, keep=("doc_id", "lang")).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        cut.alias("lang_threshold"),
        (F.col("score") >= cut).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`, all columns, without the texts that score at or above the threshold of their language; all of them if
    the labels cannot teach."""
    cnn = train(docs, labels)
    if not cnn.ready:
        return docs
    rows = docs.select(packed(docs).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(cnn)

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for t in texts:
            got = [np.zeros(0)]
            for _, buf, off in pieces(pa.array(t, type=pa.binary(), from_pandas=True)):
                got.append(model.scores(*word_ids(buf, off, model.bits)))
            yield pd.Series(np.concatenate(got))

    lang, text = F.col("row").getField("lang"), F.col("row").getField("text").cast("binary")
    return rows.where(toxic(text) < lang_threshold(cnn, lang)).select("row.*")
