"""Marked-up files to blocks and chunks."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import chunking, markup
from marginalia.plans import jobs

HERE = os.path.join(os.path.dirname(__file__), "fixtures", "markup")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, open(os.path.join(HERE, n), encoding="utf-8").read()) for n in ("pumps.md", "valves.md")]
    return spark.createDataFrame(rows, "source_file string, text string")


@pytest.fixture(scope="module")
def blocks(docs):
    return markup.parse_blocks(docs).cache()


@pytest.fixture(scope="module")
def pumps(blocks):
    return blocks.filter("source_file = 'pumps.md'").orderBy("block_no").collect()


def test_block_kinds_in_order(pumps):
    assert [(b.kind, b.anchor) for b in pumps] == [
        ("heading", "sec-pumps"),
        ("heading", None),
        ("para", None),
        ("heading", "sec-pumps-size"),
        ("para", None),
        ("list", None),
        ("para", None),
        ("figure", "fig-flow"),
        ("figure", "fig-valve"),
        ("heading", "sec-table"),
        ("table", "tbl-sizes"),
        ("equation", "eq-flow"),
        ("equation", "eq-head"),
        ("para", None),
        ("para", None),
        ("code", None),
        ("para", None),
    ]


def test_block_texts(pumps):
    text = {i: b.text for i, b in enumerate(pumps)}
    assert text[2] == (
        "Pumps move water uphill. See @sec-pumps-size and @Fig-flow, but not @fig-nowhere. They also move [value] litres."
    )
    assert text[4] == "Text before the list"
    assert text[5] == "- first item\n- second item\n continued"
    assert text[6] == "A litre is a cubic decimetre and nothing else."
    assert text[7] == "Figure (fig-flow): **Flow**: water goes up."
    assert text[8] == "Figure (fig-valve): A valve"
    assert text[10] == "Table (tbl-sizes): **Sizes**: of pumps.\n| Size | Flow |\n|------|-----:|\n| S | 1 |"
    assert text[11] == "$$ Q = A v $$ (eq-flow)"
    assert text[12] == "$$ P = \\rho g h $$ (eq-head)"
    assert text[13] == "**Keep it primed.**"
    assert text[15] == "```text\n```\nkept verbatim\n```"
    assert text[16] == "The end."


def test_offsets_point_into_the_source(docs, pumps):
    source = docs.filter("source_file = 'pumps.md'").first().text
    for b in pumps:
        piece = source[b.char_start : b.char_end]
        assert 0 <= b.char_start < b.char_end <= len(source)
        if b.kind == "heading":
            assert piece.startswith("#") and b.text in piece


def test_nothing_dropped_leaks(pumps):
    whole = "\n".join(b.text for b in pumps)
    for word in ("SECRET", "Dropped question", "still dropped", "Printed cover", "tikz", "newpage", "pagebreak"):
        assert word not in whole


def test_cross_references(blocks):
    out = markup.resolve_crossrefs(blocks, markup.collect_labels(blocks))
    texts = [r.text for r in out.filter("text like '%stop what%' or text like '%uphill%'").orderBy("source_file").collect()]
    assert "See § Sizing and Figure [fig-flow], but not @fig-nowhere." in texts[0]
    assert texts[1] == (
        "Valves stop what § Pump Systems starts, and Table [tbl-sizes] says how much; write to me@sec-pumps for more."
    )


def test_last_label_in_reading_order(spark):
    rows = [(f, 0, "heading", f, "sec-x") for f in ("a.md", "b.md", "z.md")] + [("a.md", 1, "figure", "", "fig-y")]
    heads = spark.createDataFrame(rows, "source_file string, block_no int, kind string, text string, anchor string")
    chapters = spark.createDataFrame([("z.md", 1, 1), ("b.md", 1, 2)], "source_file string, volume int, ordinal long")
    got = lambda *a: dict(markup.collect_labels(heads, *a).collect())
    assert got() == {"sec-x": "§ z.md", "fig-y": "Figure [fig-y]"}
    assert got(chapters) == {"sec-x": "§ b.md", "fig-y": "Figure [fig-y]"}


def test_section_paths(blocks):
    p = chunking.section_paths(blocks).filter("kind = 'para' and source_file = 'valves.md'").orderBy("block_no")
    assert [r.section_path for r in p.collect()] == [["Kinds"], ["Kinds", "Ball"], ["Kinds", "Gate"]]


def test_explode_lines_in_the_row(spark):
    texts = {"a": "x\nyy\n", "b": "", "c": "\n\n", "d": "q", "e": "é\n" + "line\n" * 20_000, "f": "x\nyy\n"}
    rows = [*texts.items(), ("n", None), ("a2", texts["a"])]
    d = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "source_file string, text string, n int, line int")
    out = markup.explode_lines(d)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, t in rows:
        at = 0
        for i, x in enumerate(t.split("\n") if t is not None else []):
            want.append((k, i, x, at, min(at + len(x) + 1, len(t))))
            at += len(x) + 1
    got = [tuple(r) for r in out.collect()]
    assert sorted(r for r in got if r[0] != "n") == sorted(want) and ("n", None, None, None, None) in got
    assert markup.explode_lines(d.limit(0)).count() == 0


def test_explode_lines_covers_the_text(docs):
    total = markup.explode_lines(docs).groupBy("source_file").agg(F.max("char_end").alias("e"))
    j = total.join(docs, "source_file").select("e", F.length("text").alias("n")).collect()
    assert all(r.e == r.n for r in j)


def test_substitute_values(spark):
    text = "```{python}\nx\n``` \n`{python} a` and `{python} b` and `{python} c`"
    docs = spark.createDataFrame([("f", text)], "source_file string, text string")
    vals = spark.createDataFrame([("f", 0, "1"), ("f", 1, None), ("f", 2, "$3")], "source_file string, ordinal int, value string")
    r = markup.substitute_values(docs, vals).first()
    assert (r.inline, r.resolved) == (3, 2)
    assert r.text.endswith("1 and [value] and $3")


def _pack(items, lo, hi):
    """Sequential statement of the packing rule."""
    chunks, cur, used = [], [], 0

    def flush():
        nonlocal cur, used
        if cur:
            chunks.append((used, [i[0] for i in cur], False))
        cur, used = [], 0

    for it in items:
        text, n, sec, atomic = it
        if atomic and n > hi:
            flush()
            chunks.append((n, [text], True))
            continue
        if cur and sec != cur[-1][2] and used >= lo:
            flush()
        if cur and used + n > hi:
            flush()
        cur.append(it)
        used += n
    flush()
    return chunks


def test_packing_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        items = [(f"t{i}", rng.randint(1, 90), [str(i // rng.choice([2, 5]))], rng.random() < 0.2) for i in range(60)]
        row = [("d", [(t, n, s, 0, 1, a) for t, n, s, a in items])]
        df = spark.createDataFrame(row, f"d string, items array<{chunking.ITEM}>")
        got = chunking.pack_chunks(df, 40, 70).orderBy("chunk_no").collect()
        assert [(r.token_count, r.text.split("\n\n"), r.oversize) for r in got] == _pack(items, 40, 70)


def test_chunk_job_and_reload(spark, tmp_path):
    manifest = spark.createDataFrame(
        [(9, 1, "pumps.md"), (9, 2, "valves.md"), (9, 3, "index.qmd"), (9, 4, "absent.md")],
        "volume int, ordinal int, path string",
    )
    chunks, missing = jobs.build_chunks(spark, "file:" + HERE, manifest, "abc", min_tokens=20, max_tokens=60)
    rows = chunks.orderBy("id").collect()
    assert [r.path for r in missing.collect()] == ["absent.md"]
    assert {r.chapter_title for r in rows} == {"Pump Systems", "Valves"}
    assert rows[0].heading_path == "Vol 9 > Ch 1: Pump Systems > Why Pumps"
    current = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    again = jobs.refresh_chunks(current, chunks, "def")
    assert again.filter("commit_sha <> 'def' or embedding is null").count() == 0
    from marginalia.operators.maintenance import diff_summary

    s = diff_summary(again, chunks).first()
    assert (s.added, s.removed, s.unchanged) == (0, 0, len(rows))


def test_select_chapters(spark):
    paths = [
        "contents/frontmatter/a.qmd", "contents/one.qmd", "contents/two.qmd", "contents/backmatter/references.qmd",
        "contents/backmatter/extra.qmd", "contents/backmatter/glossary/g.qmd", "index.qmd",
    ]
    m = spark.createDataFrame([(9, i, p) for i, p in enumerate(paths)], "volume int, ordinal int, path string")
    got = {r.path.split("/")[-1]: r.chapter_num for r in chunking.select_chapters(m).collect()}
    assert got == {"one.qmd": 1, "two.qmd": 2, "extra.qmd": 100, "g.qmd": 200}


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a <!-- x\ny --> b", "a b"),
        ("x\\index{a{b}c} y", "x y"),
        ("`{python} v` [^f] [-@a; @b] [t]{.c}", "[value] t"),
        ("{{< include z >}}  q\t r", "q r"),
    ],
)
def test_clean_inline(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.clean_inline(F.col("t"))).first()[0] == clean


def test_token_count_and_sentences(spark):
    df = spark.createDataFrame([("Hello, wörld! It's 3.5. (Yes) no.",)], "t string")
    r = df.select(tx.token_count(F.col("t")), tx.split_sentences(F.col("t"))).first()
    assert r[0] == int(16 * 1.35) + 1
    assert r[1] == ["Hello, wörld!", "It's 3.5.", "(Yes) no."]


def test_chunk_ids_do_not_overlap(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from marginalia.operators import chunking

    chapters = spark.range(32_760, 32_780).select(F.col("id").alias("c")).crossJoin(spark.range(1, 4).toDF("v"))
    ids = chapters.select(chunking.chunk_id(chunking.chapter_ordinal(F.col("v"), F.col("c")), F.lit(0)).alias("x"))
    assert ids.distinct().count() == 60
    with pytest.raises(PySparkException):
        spark.range(1).select(chunking.chunk_id(F.lit(1), F.lit(1 << 24))).collect()


def test_blocks_of_some_kinds_are_those_of_all(spark):
    cols = ["source_file", "kind", "text", "char_start", "char_end", "level", "anchor"]
    texts = [
        ("notes.md", "---\nt: 1\n---\n\n# A {#sec-a}\n\n[^n]: first\n    second\n| a | b |\n|---|---|\n\n: Cap {#tbl-a}\n\nx\n- one\n- two\n"),
        ("scopes.md", "::: {#fig-a fig-cap=\"F\"}\n![](x.png)\n:::\n::: {.callout-note title=\"T\"}\nIn\n$$\ny\n$$ {#eq-a}\n:::\n```text\nc\n```\n"),
    ]
    docs = spark.createDataFrame(texts, "source_file string, text string")
    whole = markup.parse_blocks(docs).select(*cols).collect()
    assert {r["kind"] for r in whole} == set(markup.LINES_OF)
    for kind in markup.LINES_OF:
        some = markup.parse_blocks(docs, [kind]).select(*cols).collect()
        assert sorted(some, key=str) == sorted((r for r in whole if r["kind"] == kind), key=str), kind
