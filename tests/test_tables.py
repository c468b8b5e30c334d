"""Table versions, pruned scans and siblings."""

import gzip
import re
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluation, golden, maintenance
from marginalia.sources import readers, writers

CHUNKS = "id long, content_hash string, text string, chapter_num int, commit_sha string, embedding array<float>"


@pytest.fixture(scope="module")
def current(spark):
    rows = [(i, f"h{i}", f"text {i}", 1, "a", [float(i)]) for i in range(40)]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def incoming(spark):
    rows = [(100 + i, f"h{i}", f"text {i}", 2, "b") for i in range(20, 60)]
    rows += [(300, "h50", "text 50", 3, "b"), (301, None, "no hash", 3, "b")]  # a repeat and a row without a hash
    return spark.createDataFrame(rows, CHUNKS.rsplit(",", 1)[0])


def expected(refresh):
    out = {f"h{i}": (i, 2 if refresh else 1, "b", True) for i in range(20, 40)}
    out |= {f"h{i}": (100 + i, 2, "b", False) for i in range(40, 60)}
    out["h50"] = (300, 3, "b", False)
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r["content_hash"] for r in rows})
    return {r["content_hash"]: (r["id"], r["chapter_num"], r["commit_sha"], r["embedding"] is not None) for r in rows}


@pytest.mark.parametrize("refresh", [False, True])
def test_diff_load(current, incoming, refresh):
    assert found(maintenance.diff_load(current, incoming, "b", refresh)) == expected(refresh)


def test_diff_load_of_empty_tables(current, incoming):
    assert maintenance.diff_load(current, incoming.limit(0), "b").count() == 0
    assert maintenance.diff_load(current.limit(0), incoming, "b").count() == 40


def test_bucketed_versions_do_not_shuffle_the_current_table(spark, current, incoming, tmp_path):
    name = "v" + uuid.uuid4().hex
    old = writers.write_bucketed(current, f"{name}_1", str(tmp_path / "1"), 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for refresh in (False, True):
            plan = maintenance.diff_load(old, incoming, "b", refresh)._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            )
            scans = re.findall(r"^\(\d+\) Scan parquet.*\nOutput.*", plan, re.MULTILINE)
            wide = {a for b in scans for a in re.findall(r"(?:text|embedding)#\d+", b)}
            moved = [b for b in plan.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", b)]
            assert len(wide) == 2 and moved
            assert not any(a in re.findall(r"\w+#\d+", b) for a in wide for b in moved)
        new = maintenance.next_version(old, incoming, "b", f"{name}_2", str(tmp_path / "2"), 5)
        assert found(new) == expected(False)
        # the next version is bucketed in its turn, and opens under another name
        again = readers.open_bucketed(spark, f"{name}_3", str(tmp_path / "2"), 5)
        assert found(again) == expected(False)
        plan = again.join(again.groupBy("content_hash").count(), "content_hash")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("batch", [2, 100])
def test_files_outside_the_manifest_are_never_opened(spark, tmp_path, batch):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    names = ["a.md", "sub/b c.md", "sub/d+e.md", "f%20g.md", "h%.md"]
    for n in names:
        (root / n).write_text(f"# {n}\nbody\n")
    (root / "packed.md.gz").write_bytes(gzip.compress(b"packed\n"))
    (root / "broken.md.gz").write_bytes(b"no archive at all")
    rows = [(i, n) for i, n in enumerate([*names, "packed.md.gz", "absent.md"])]
    manifest = spark.createDataFrame(rows, "number int, path string")
    docs, missing = readers.scan_corpus(spark, str(root), manifest, batch)
    got = {r["source_file"]: (r["number"], r["text"]) for r in docs.collect()}
    assert got == {n: (i, f"# {n}\nbody\n") for i, n in enumerate(names)} | {"packed.md.gz": (5, "packed\n")}
    assert [r["path"] for r in missing.collect()] == ["absent.md"]
    # names are listed once: later steps read them back
    assert "binaryFile" not in missing._jdf.queryExecution().executedPlan().toString()
    # the broken file fails as soon as it is opened
    with pytest.raises(Exception):  # noqa: B017, PT011
        every = spark.createDataFrame([(9, "broken.md.gz")], "number int, path string")
        readers.scan_corpus(spark, str(root), every)[0].collect()


def test_a_manifest_of_nothing(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    docs, missing = readers.scan_corpus(spark, str(tmp_path), spark.createDataFrame([], "number int, path string"))
    assert docs.count() == 0 and missing.count() == 0


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_siblings_are_the_next_on_the_ring(spark, digits):
    sizes = {(1, 1): 400, (1, 2): 1, (2, 1): 3, (2, 2): 30}
    rows, n = [], 0
    for (v, c), size in sizes.items():
        for _ in range(size):
            rows.append((n, v, c, 300 if n % 9 else 10, "multi" if n % 4 == 0 else "single"))
            n += 1
    chunks = spark.createDataFrame(rows, "id long, volume int, chapter_num int, token_count int, type string")
    # a sample of a chapter without chunks and one that is too short to be a chunk itself
    typed = chunks.withColumn("item_id", F.concat(F.lit("g"), "id"))
    typed = typed.unionByName(spark.createDataFrame([(9000, 3, 3, 300, "multi", "g9000")], typed.schema))
    got = {r["item_id"]: r["sibling_id"] for r in golden.pick_sibling(typed, chunks, 7, digits=digits).collect()}
    keys = {r["id"]: r["k"] for r in typed.select("id", golden.seeded(F.col("id"), 7).alias("k")).collect()}
    want = {}
    for i, v, c, _, kind in rows:
        others = [j for j, w, d, t, _ in rows if (w, d) == (v, c) and t >= 200 and j != i]
        if kind == "multi" and others:
            want[f"g{i}"] = min(others, key=lambda j: (keys[j] < keys[i], keys[j], j))
    assert got == want


def test_siblings_need_no_broadcast(spark):
    chunks = spark.range(1000).selectExpr("id", "1 as volume", "1 as chapter_num", "300 as token_count")
    typed = chunks.filter("id < 50").selectExpr("*", "'multi' as type", "concat('g', id) as item_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = golden.pick_sibling(typed, chunks, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "NestedLoop" not in plan


def test_labels_meet_chunks_before_grouping(spark):
    items = spark.createDataFrame([(1, ["a", "gone"]), (2, ["a", "b"]), (3, None)], "id int, source_chunk_content_hashes array<string>")
    chunks = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b"), (3, "c"), (4, None)], "id long, content_hash string")
    got = {tuple(r) for r in evaluation.resolve_hashes(items, chunks).collect()}
    assert got == {("a", 5), ("b", 2), ("gone", None)}


def test_copy_joins_texts_and_embeddings_once(spark, sf, monkeypatch):
    from marginalia.plans import queries_tables as qt

    plans, copy = [], qt.writers.incremental_copy

    def seen(source, path, *a):
        plans.append(source._jdf.queryExecution().optimizedPlan().toString())
        copy(source, path, *a)

    monkeypatch.setattr(qt.writers, "incremental_copy", seen)
    assert qt.incremental_copy(spark, sf).count() > 0
    assert [p.count("Join") for p in plans] == [1, 0, 0]


def test_a_root_with_a_scheme_and_a_blank(spark, tmp_path):
    root = tmp_path / "my corpus"
    (root / "sub").mkdir(parents=True)
    for n in ("a.md", "sub/b+c.md"):
        (root / n).write_text(n)
    manifest = spark.createDataFrame([(1, "a.md"), (2, "sub/b+c.md"), (3, "absent.md")], "number int, path string")
    for base in (str(root), f"file:{root}", f"file://{root}/"):
        docs, missing = readers.scan_corpus(spark, base, manifest)
        assert {tuple(r) for r in docs.collect()} == {(1, "a.md", "a.md"), (2, "sub/b+c.md", "sub/b+c.md")}
        assert [r.number for r in missing.collect()] == [3]


def test_texts_are_written_as_files_by_their_tasks(spark, tmp_path):
    rows = [("x/1", "é\n"), ("x/2", None), ("y/1", ""), ("y/2", "same"), ("y/2", "same")]
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    names = writers.write_texts(df, str(tmp_path / "texts"))
    files = {str(f.relative_to(tmp_path / "texts")): f.read_bytes() for f in (tmp_path / "texts").rglob("*") if f.is_file()}
    assert files == {"x/1": "é\n\n".encode(), "x/2": b"\n", "y/1": b"\n", "y/2": b"same\nsame\n"}
    assert sorted(r.path for r in names.collect()) == sorted(files)
    assert writers.local_folder(spark, "file:///a/b") == writers.local_folder(spark, "/a/b") == "/a/b"
    assert writers.local_folder(spark, "hdfs://host/a") is writers.local_folder(spark, "a/b") is None


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_scan_corpus_finds_every_page(spark, tmp_path, monkeypatch, scheme):
    import hashlib

    from marginalia.plans import queries_tables as qt

    pages = [(i, None if i == 3 else f"<p>{i}</p>\n\n" * (i % 4)) for i in range(300)] + [(-7, "minus")]
    spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr("marginalia.session.shared_dir", lambda spark: f"{scheme}{tmp_path}/shared")
    got = sorted(tuple(r) for r in qt.scan_corpus(spark, str(tmp_path)).collect() if r.found)
    every = qt.scan_corpus(spark, str(tmp_path)).count()
    md5 = lambda x: hashlib.md5((x or "").encode()).hexdigest()
    assert got == sorted((i, md5(h), True) for i, h in pages) and every == 602
    written = [f for f in (tmp_path / "shared").rglob("p=*") if "corpus-" in str(f)]
    assert len(written) == 602 and all(f.is_file() for f in written)
