"""Sinks. Appends are idempotent per run id; table versions are written aside and then pointed to."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.session import cut_lineage
from marginalia.sources.readers import read_jsonl, scan_table


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as the operating system names it, or None where ``path`` lies in another file system."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(?://[^/]*)?(.*)", path).groups()
    if not scheme:
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").split(":")[0]
    return rest if scheme == "file" and rest.startswith("/") else None


def write_texts(texts: DataFrame, root: str) -> DataFrame:
    """Files of (path, text) in the local or mounted folder ``root``, and their paths, stored. A path is ``folder/name``.

    Each text ends with a line end, and texts of one path are one file, as Spark's text writer has them; a null text is an
    empty line. The task that holds a text writes its file aside and renames it, so a retried task leaves whole files. Spark's
    writer takes a folder and several steps of a commit for a file, some 15 ms of a core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: set[str] = set()
        at, aside, f = None, "", None

        def done() -> None:
            f.close()
            os.replace(aside, os.path.join(root, at))

        for b in batches:
            begun = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != at:
                    if f:
                        done()
                    folder, name = os.path.split(os.path.join(root, path))
                    if folder not in folders:
                        os.makedirs(folder, exist_ok=True)
                        folders.add(folder)
                    at, aside = path, os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
                    f = open(aside, "wb")
                    begun.append(path)
                f.write((text or b"") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(begun, pa.string())], names=["path"])
        if f:
            done()

    rows = texts.select("path", F.col("text").cast("binary").alias("text"))
    rows = rows.repartition(texts.sparkSession.sparkContext.defaultParallelism, "path").sortWithinPartitions("path")
    return cut_lineage(rows.mapInArrow(run, "path string"), "written")


def snapshot_spans(chunks: DataFrame, path: str) -> None:
    """Keep (hash, file, start, end) before a re-ingest."""
    chunks.select("content_hash", "source_file", "char_start", "char_end").write.mode("overwrite").parquet(path)


def _conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the declared schema in order; absent ones are null."""
    want = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in want.fields
        ]
    )


def append_query_log(rows: DataFrame, path: str) -> None:
    """Log rows, partitioned by day so that trailing-window reads prune."""
    out = _conform(rows, schemas.QUERY_LOG).withColumn("day", F.to_date("started_at"))
    out.write.mode("append").partitionBy("day").parquet(path)


def append_judge_scores(rows: DataFrame, path: str) -> None:
    _conform(rows, schemas.JUDGE_SCORES).write.mode("append").parquet(path)


def append_ingest_run(summary: DataFrame, path: str, run_id: str, commit_sha: str, started_at: Column, finished_at: Column) -> None:
    """One ledger row from a diff summary (added, removed, unchanged)."""
    row = summary.select(
        F.lit(run_id).alias("id"),
        F.lit(commit_sha).alias("commit_sha"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        F.col("added").alias("chunks_added"),
        F.col("removed").alias("chunks_removed"),
        F.col("unchanged").alias("chunks_unchanged"),
    )
    _conform(row, schemas.INGEST_RUNS).write.mode("append").parquet(path)


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, key: str = "content_hash", in_place: bool = False
) -> DataFrame:
    """A table version at the new folder ``path``, bucketed and sorted by ``key``: joins on it need no shuffle.

    ``in_place`` says that the rows come from a table with the same buckets, so they are not shuffled again. Without it
    each bucket is one file.
    """
    rows = df if in_place else df.repartition(buckets, key)
    rows.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def append_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "content_hash") -> DataFrame:
    """Rows added to a bucketed table, one more file a bucket."""
    rows = df.repartition(buckets, key)
    rows.write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def incremental_copy(source: DataFrame, target_path: str, truncate: bool = False) -> None:
    """Copy embedded rows whose hash the target lacks; ``truncate`` replaces the target.

    A run that is repeated after a failure copies only what is still missing.
    """
    rows = source.filter(F.col("embedding").isNotNull())
    if truncate:
        rows.write.mode("overwrite").parquet(target_path)
        return
    target = scan_table(source.sparkSession, target_path, "chunks")
    todo = rows.join(target.select("content_hash").distinct(), "content_hash", "left_anti")
    _conform(todo, schemas.CHUNKS).write.mode("append").parquet(target_path)


def write_report(report: DataFrame, per_question: DataFrame, root: str, run_id: str) -> None:
    """Report of one run under its id; the latest report is the one with the greatest run id."""
    base = root.rstrip("/")
    report.drop("run_id").write.mode("overwrite").json(f"{base}/reports/run_id={run_id}")
    per_question.drop("run_id").write.mode("overwrite").json(f"{base}/questions/run_id={run_id}")


def latest_report(spark, root: str) -> DataFrame:
    df = spark.read.json(f"{root.rstrip('/')}/reports")
    last = df.agg(F.max("run_id").alias("run_id"))
    return df.join(F.broadcast(last), "run_id")  # one row


__all__ = [
    "append_bucketed", "append_ingest_run", "append_judge_scores", "append_query_log", "incremental_copy", "latest_report",
    "read_jsonl", "snapshot_spans", "write_bucketed", "write_jsonl", "write_report",
]
