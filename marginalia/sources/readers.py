"""Typed scans."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.session import cut_lineage, work_path


#: Tasks of a core that read whole files, and the bytes a task reads where that makes more of them.
TASKS_A_CORE = 8
READ_BYTES = 64 * 1024 * 1024


def read_parquet_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def scan_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan of one of the declared tables; an absent table is empty."""
    schema = schemas.TABLES[name]
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    return scan_table(spark, path, "chunks")


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int, key: str = "content_hash") -> DataFrame:
    """A bucketed table version that an earlier session wrote, under a name in this session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def scan_corpus(spark: SparkSession, root: str, manifest: DataFrame, batch: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(documents, missing): files under ``root`` that the manifest names, read whole, and manifest rows without a file.

    One listing gives the names of all files and opens none. They meet the manifest in a join. Where every file is
    named, all are read; otherwise files are pruned by name before they are opened: ``batch`` names at a time, copied to
    the shared folder, so neither the driver nor a plan holds more names. As Spark's file sources do, files without a byte
    and those whose name starts with ``_`` or ``.`` are passed over; their manifest rows are missing.
    """
    base = root.rstrip("/")
    uri = F.col("_metadata.file_path")
    # file_path is percent-encoded, blanks and plus signs included, and writes a scheme in its own way (file:/ for file:///)
    folder = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", base) + "/"
    whole = F.url_decode(F.regexp_replace("uri", r"\+", "%2B"))
    name = F.substr(whole, F.instr(whole, folder) + F.lit(len(folder)))
    # Spark reads some thirty small files a task: tasks are put together, names without a look at sizes and texts up to READ_BYTES
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    listed = listed.select(uri.alias("uri"), F.col("_metadata.file_size").alias("size")).coalesce(tasks)
    listed = cut_lineage(listed.withColumn("path", name).repartition("path"), "corpus-names")  # every reader would ask for each file
    wanted = manifest.select("path").distinct()
    source = spark.read.text(base, wholetext=True, recursiveFileLookup=True)
    whole_bytes = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    texts = source.select(uri.alias("uri"), F.col("value").alias("text")).coalesce(max(tasks, whole_bytes // READ_BYTES))
    if not listed.join(wanted, "path", "left_anti").isEmpty():
        named = listed.join(wanted, "path", "left_semi").select("uri").toLocalIterator()
        target = work_path(spark, "corpus-texts")
        texts.limit(0).write.parquet(target)
        while some := [r["uri"] for r in islice(named, batch)]:
            source.filter(uri.isin(some)).select(uri.alias("uri"), F.col("value").alias("text")).write.mode("append").parquet(target)
        texts = spark.read.schema(texts.schema).parquet(target)
    docs = texts.withColumn("path", name).join(manifest, "path").select(
        *[c for c in manifest.columns if c != "path"], F.col("path").alias("source_file"), "text"
    )
    return docs, manifest.join(listed.select("path"), "path", "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines records; blank lines are skipped and an absent file is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """Multi-line result documents with their nested runs."""
    return spark.read.schema(schemas.RESULTS).option("multiLine", True).json(glob)


def read_logs(
    spark: SparkSession, glob: str, cell: str = r"/cell-([^/]+)/[^/]+$", service: str = r"([^/]+)\.log$"
) -> DataFrame:
    """(cell, service, line_no, line) from ``.../cell-<cell>/<service>.log``.

    ``line_no`` orders lines of one file: the byte block of the split first, then the place in it.
    """
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    return lines.select(
        F.regexp_extract("file", cell, 1).alias("cell"),
        F.regexp_extract("file", service, 1).alias("service"),
        F.struct("block", "seq").alias("line_no"),
        "line",
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt lines without blanks and ``#`` comments."""
    t = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(t.alias("prompt")).filter("prompt <> '' and not startswith(prompt, '#')")


