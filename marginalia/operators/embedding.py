"""Filling in embeddings. Models plug in as functions over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.functions import vectors as vx

# A loader runs once per Python worker and returns texts -> matrix.
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]

#: Vectors that a worker counts at once, and bytes of text whose words it hashes at once.
EMBED_SLICE = 512
WORD_BYTES = 8 * 1024 * 1024


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    """Rows still to embed. The filter is pushed to the scan; order and batching are left to partitions."""
    return chunks.filter(F.col("embedding").isNull())


def embed_batch(loader: Embedder, normalize: bool = True, batch_size: int = 32) -> Callable[[Column], Column]:
    """A Column function that embeds a text column with a model loaded once per worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for texts in batches:
            parts = [
                np.asarray(model(list(texts.iloc[i : i + batch_size])), dtype=np.float32)
                for i in range(0, len(texts), batch_size)
            ]
            m = np.vstack(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            if normalize and m.size:
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm == 0, 1, norm)
            yield pd.Series(list(m))

    return run


def word_buckets(text: Column, dim: int = fv.EMBED_DIM) -> Column:
    """The bucket of every word of a text; a null text has none."""
    return F.coalesce(F.transform(tx.words(text), lambda w: vx.hash_bucket(w, dim)), F.array().cast("array<int>"))


def bucket_counts(buckets: pa.Array, dim: int = fv.EMBED_DIM) -> np.ndarray:
    """A row of word counts for each list of buckets: hashed vectors before they are scaled."""
    n = len(buckets)
    cell = np.repeat(np.arange(n), np.diff(buckets.offsets.to_numpy())) * dim + buckets.flatten().to_numpy()
    return np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)


def cut(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices whose sizes add up to ``most`` or less; a larger row is a slice of its own."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j - i
        i = j


def _buckets_of(texts: pa.Array, dim: int) -> pa.ListArray:
    """The bucket of every word, as ``word_buckets`` has it, of lower-cased texts; a word of the batch is hashed once."""
    words = pc.split_pattern(pc.replace_substring_regex(texts, f"[{fv.WHITE_SPACE}]", " "), " ")
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    heads = b"".join(md5(w, usedforsecurity=False).digest()[:4] for w in known)
    bucket = np.frombuffer(heads, dtype=">u4").astype(np.int64) % dim
    code = coded.indices.to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(np.array([w != b"" for w in known], dtype=bool)[code])
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(bucket[code[kept]].astype(np.int32)))


def hash_embed(text: Column, dim: int = fv.EMBED_DIM, normalize: bool = True, double: bool = False) -> Column:
    """Words hashed into ``dim`` buckets, unit length; the JVM lower-cases, counting is one bincount per Arrow slice.

    A slice is handed back before the next one is counted, so a worker holds EMBED_SLICE vectors and not those of a batch.
    """
    dtype = np.float64 if double else np.float32

    @F.arrow_udf(ArrayType(DoubleType() if double else FloatType()))
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for first, rows in cut(pc.binary_length(texts), WORD_BYTES):
                buckets = _buckets_of(texts.slice(first, rows), dim)
                for i in range(0, rows, EMBED_SLICE):
                    m = bucket_counts(buckets.slice(i, EMBED_SLICE), dim)
                    n = len(m)
                    norm = np.linalg.norm(m, axis=1, keepdims=True) if normalize else 1.0
                    m = (m / np.where(norm == 0, 1, norm)).astype(dtype)
                    yield pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(m.ravel()))

    return count(tx.lower(text))


def sparse_embed(docs: DataFrame, id_col: str, text_col: str, dim: int = fv.EMBED_DIM) -> DataFrame:
    """(id, bucket, weight): the non-zero entries of the unit hashed vectors. Each row is counted in place."""
    words = F.transform(tx.words(F.col(text_col)), lambda w: vx.hash_bucket(w, dim))

    def starts(b: Column) -> Column:
        """Positions where a new bucket begins in the sorted buckets."""
        at = F.transform(b, lambda x, i: F.when((i == 0) | (x != F.get(b, i - 1)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def counts(b: Column, s: Column) -> Column:
        return F.transform(
            s,
            lambda i, j: F.struct(
                F.get(b, i).alias("bucket"), (F.coalesce(F.get(s, j + 1), F.size(b)) - i).cast("double").alias("tf")
            ),
        )

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["tf"] * x["tf"]))
        return tx.let(
            norm,
            lambda n: F.transform(c, lambda x: F.struct(x["bucket"].alias("bucket"), (x["tf"] / n).alias("weight"))),
        )

    entries = tx.let(F.sort_array(words), lambda b: tx.let(starts(b), lambda s: tx.let(counts(b, s), scaled)))
    # the outer form: the plain one would add a filter that computes the entries a second time
    return docs.select(F.col(id_col).alias("id"), F.inline_outer(entries)).filter("bucket is not null")


def fill_embeddings(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Embed heading path and text of rows without an embedding; the others pass through untouched."""
    todo = pending_embeddings(chunks)
    done = chunks.filter(F.col("embedding").isNotNull())
    form = tx.embed_text(F.col("heading_path"), F.col("text"))
    return done.unionByName(todo.withColumn("embedding", embed(form)))
