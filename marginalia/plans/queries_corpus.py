"""Registered queries: selection, cleaning, markup to blocks, blocks to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.operators import chunking, maintenance, markup
from marginalia.plans import derive as dv
from marginalia.plans.registry import query
from marginalia.session import cut_lineage

# ---- selection and cleaning -------------------------------------------------------

MANIFEST_SQL = f"""manifest AS (
  SELECT CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 9 END AS volume, doc_id AS ordinal,
    CASE source WHEN 'src0' THEN 'contents/frontmatter/' WHEN 'src1' THEN 'contents/backmatter/references/'
      WHEN 'src2' THEN 'contents/backmatter/' WHEN 'src3' THEN 'contents/backmatter/glossary/' ELSE 'contents/' || source || '/' END
      || doc_id || '.qmd' AS path FROM documents)"""


def manifest(spark, sf):
    vol = F.lit(9)
    for k, v in dv.VOLUMES.items():
        vol = F.when(F.col("lang") == k, F.lit(v)).otherwise(vol)
    folder = (
        F.when(F.col("source") == "src0", "contents/frontmatter/")
        .when(F.col("source") == "src1", "contents/backmatter/references/")
        .when(F.col("source") == "src2", "contents/backmatter/")
        .when(F.col("source") == "src3", "contents/backmatter/glossary/")
        .otherwise(F.concat(F.lit("contents/"), "source", F.lit("/")))
    )
    return dv.t(spark, sf, "documents").select(
        vol.alias("volume"),
        F.col("doc_id").alias("ordinal"),
        F.concat(folder, F.col("doc_id").cast("string"), F.lit(".qmd")).alias("path"),
    )


@query(
    "select_chapters",
    f"""WITH {MANIFEST_SQL}, kept AS (SELECT *, CASE WHEN contains(path, '/backmatter/glossary') THEN 'glossary'
      WHEN contains(path, '/backmatter/') THEN 'appendix' ELSE 'chapter' END AS kind FROM manifest
      WHERE NOT ({" OR ".join(f"contains('/' || path, '{s}')" for s in fv.SKIP_PATH_SUBSTRINGS)}))
    SELECT volume, ordinal, path, kind, CAST(CASE kind WHEN 'glossary' THEN 200
      WHEN 'appendix' THEN 99 + row_number() OVER w ELSE row_number() OVER w END AS INT) AS chapter_num
    FROM kept WINDOW w AS (PARTITION BY volume, kind ORDER BY ordinal)""",
)
def select_chapters(spark, sf):
    return chunking.select_chapters(manifest(spark, sf))


def _with_placeholders(spark, sf):
    lines = F.split(F.regexp_replace("text", "`", ""), "\n")
    body = F.array_join(F.transform(lines, lambda ln: F.concat(ln, F.lit(" `{python} v`"))), "\n")
    cell = F.lit("```{python}\nx = 1 # `{python} inside`\n```\n")
    return dv.t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_file"), F.concat(cell, body).alias("text")
    )


@query(
    "substitute_values",
    r"""WITH s AS (SELECT doc_id, string_split(replace(text, '`', ''), chr(10)) AS ls FROM documents),
    e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM s)
    SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(count(*) AS INT) AS inline, CAST(count(*) FILTER (i % 4 <> 3) AS INT) AS resolved,
      md5('```{python}' || chr(10) || 'x = 1 # `{python} inside`' || chr(10) || '```' || chr(10)
        || string_agg(line || ' ' || CASE WHEN i % 4 = 3 THEN '[value]' ELSE 'v' || i END, chr(10) ORDER BY i)) AS text_md5
    FROM e GROUP BY doc_id""",
)
def substitute_values(spark, sf):
    docs = _with_placeholders(spark, sf)
    values = dv.t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("ordinal", "_l")
    ).select(
        "source_file",
        "ordinal",
        F.when(F.col("ordinal") % 4 != 3, F.concat(F.lit("v"), F.col("ordinal").cast("string"))).alias("value"),
    )
    return markup.substitute_values(docs, values).select(
        "source_file", "inline", "resolved", F.md5("text").alias("text_md5")
    )


def _noisy(text):
    return F.concat(
        F.lit("<!-- note\n-->"), text, F.lit("\\index{a{b}c}  {{< pagebreak >}}\t`{python} x.y`[^fn-1] [@a2020; @b] [span]{.x} end ")
    )


_NOISY_SQL = r"""'<!-- note' || chr(10) || '-->' || text || '\index{a{b}c}  {{< pagebreak >}}' || chr(9) || '`{python} x.y`[^fn-1] [@a2020; @b] [span]{.x} end '"""
_CLEAN_SQL = _NOISY_SQL
for _p, _r in [
    (fv.P_COMMENT, ""),
    (fv.P_INDEX, ""),
    (fv.P_SHORTCODE, ""),
    (fv.P_INLINE_VALUE, "[value]"),
    (fv.P_FOOTNOTE_REF, ""),
    (fv.P_CITATION, ""),
    (fv.P_SPAN_ATTR, r"\1"),
    (fv.P_BLANKS, " "),
]:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_p}', '{_r}', 'g')"
_CLEAN_SQL = dv.strip_sql(_CLEAN_SQL)


@query("clean_inline", f"SELECT doc_id, md5({_CLEAN_SQL}) AS clean_md5, length({_CLEAN_SQL}) AS n FROM documents")
def clean_inline(spark, sf):
    c = tx.clean_inline(_noisy(F.col("text")))
    return dv.t(spark, sf, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n"))


@query(
    "parse_attrs",
    """SELECT doc_id, 'sec-' || doc_id AS ident, 'a,c-' || lang AS classes, 'Doc ' || doc_id AS title, source AS src, '3' AS cols,
       CAST(NULL AS VARCHAR) AS absent FROM documents""",
)
def parse_attrs(spark, sf):
    i = F.col("doc_id").cast("string")
    attrs = F.concat(
        F.lit("#sec-"), i, F.lit(' .a title="Doc '), i, F.lit('" .c-'), "lang", F.lit(" src='"), "source", F.lit("' cols=3")
    )
    p = tx.parse_attrs(attrs)
    return dv.t(spark, sf, "documents").select(
        "doc_id",
        p["ident"].alias("ident"),
        F.array_join(p["classes"], ",").alias("classes"),
        p["kv"]["title"].alias("title"),
        p["kv"]["src"].alias("src"),
        p["kv"]["cols"].alias("cols"),
        p["kv"]["absent"].alias("absent"),
    )


@query(
    "strip_front_matter",
    """SELECT doc_id, CAST(length('---' || chr(10) || 'id: ' || doc_id || chr(10) || '---') AS INT) AS body_start,
      md5('---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || text || chr(10) || repeat(' ', length('<!-- ' || lang || ' -->')) || 'end') AS masked_md5
    FROM documents""",
)
def strip_front_matter(spark, sf):
    docs = dv.t(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text", F.lit("\n<!-- "), "lang", F.lit(" -->end")).alias("text"),
    )
    return markup.strip_front_matter(docs).select("doc_id", "body_start", F.md5("masked").alias("masked_md5"))


_GUARD_TRIP = ["MIT License", "Apache License", "GNU General Public License"]


@query(
    "guard_content",
    """WITH f AS (SELECT 'data/' || lang || '/' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.qmd' ELSE '.bin' END AS path, n_chars, text FROM documents WHERE lang = 'de'
      UNION ALL SELECT lang || '/' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.qmd' ELSE '.txt' END, n_chars, text FROM documents WHERE lang <> 'de')
    SELECT path, 'glob:data/*' AS rule FROM f WHERE starts_with(path, 'data/') UNION ALL
    SELECT path, 'glob:*.bin' FROM f WHERE ends_with(path, '.bin') UNION ALL
    SELECT path, 'suffix:.qmd' FROM f WHERE ends_with(path, '.qmd') AND NOT starts_with(path, 'es/') UNION ALL
    SELECT path, 'size' FROM f WHERE n_chars > 5000 """
    + " ".join(f"UNION ALL SELECT path, 'tripwire:{w}' FROM f WHERE contains(text, '{w}')" for w in _GUARD_TRIP),
)
def guard_content(spark, sf):
    d = dv.t(spark, sf, "documents")
    even = F.col("n_chars") % 2 == 0
    i = F.col("doc_id").cast("string")
    path = F.when(
        F.col("lang") == "de", F.concat(F.lit("data/"), "lang", F.lit("/"), i, F.when(even, ".qmd").otherwise(".bin"))
    ).otherwise(F.concat("lang", F.lit("/"), i, F.when(even, ".qmd").otherwise(".txt")))
    files = d.select(path.alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content"))
    return maintenance.guard_content(files, ["data/*", "*.bin"], _GUARD_TRIP, 5000, ".qmd", "es/")


@query(
    "validate_questions",
    """SELECT doc_id, CASE WHEN length(text) < 1 THEN 'question_too_short' WHEN length(text) > 2000 THEN 'question_too_long'
      WHEN NOT (doc_id % 13 BETWEEN 1 AND 10) THEN 'top_k_out_of_range'
      WHEN lang NOT IN ('en', 'fr') THEN 'unknown_mode' END AS reason FROM documents""",
)
def validate_questions(spark, sf):
    q = dv.t(spark, sf, "documents").select(
        "doc_id",
        F.col("text").alias("question"),
        (F.col("doc_id") % 13).alias("top_k"),
        F.when(F.col("lang") == "en", "hybrid").when(F.col("lang") == "fr", "dense").otherwise("other").alias("mode"),
    )
    return maintenance.validate_questions(q).select("doc_id", "reason")


# ---- lines and blocks -------------------------------------------------------------


@query(
    "explode_lines",
    f"WITH {dv.LINES} SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(i AS INT) AS line_no, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end, md5(line) AS line_md5 FROM lines",
)
def explode_lines(spark, sf):
    docs = dv.t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text")
    return markup.explode_lines(docs).select(
        "source_file", "line_no", "char_start", "char_end", F.md5("line").alias("line_md5")
    )


def blocks(spark, sf, *kinds):
    """The blocks of the marked-up documents: all, or those of some kinds."""
    return markup.parse_blocks(dv.marked_up(spark, sf).select("source_file", "text"), list(kinds) or None)


def _block_rows(df):
    return df.select("source_file", "kind", "char_start", "char_end", "level", "anchor", F.md5("text").alias("text_md5"))


def _block_sql(kind: str, rows: str) -> str:
    """rows: SELECT doc_id, start, len, last, level, anchor, txt. The final line of a file has no line end."""
    return f"""WITH {dv.MARKED}, b AS ({rows})
    SELECT CAST(doc_id AS VARCHAR) AS source_file, '{kind}' AS kind, CAST(start AS INT) AS char_start,
      CAST(start + len + CASE WHEN last THEN 0 ELSE 1 END AS INT) AS char_end, CAST(level AS INT) AS level,
      CAST(anchor AS VARCHAR) AS anchor, md5(txt) AS text_md5 FROM b"""


@query(
    "fence_islands",
    f"""WITH {dv.MARKED} SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(start AS INT) AS char_start,
      CAST(start + length(s) + CASE WHEN is_last THEN 0 ELSE 1 END AS INT) AS char_end,
      CAST(3 AS BIGINT) AS lines, (i % 12 = 3) AS kept FROM seg WHERE i % 12 IN (3, 4)""",
)
def fence_islands(spark, sf):
    return (
        markup.fence_islands(dv.marked_up(spark, sf))
        .groupBy("source_file", "char_start", "char_end", "kept")
        .agg(F.count("*").alias("lines"))
    )


@query(
    "div_scope",
    f"""WITH {dv.MARKED} SELECT CAST(doc_id AS VARCHAR) AS source_file, CAST(count(*) FILTER (i % 12 = 9) * 7 AS BIGINT) AS dropped_lines
    FROM seg GROUP BY doc_id""",
)
def div_scope(spark, sf):
    return (
        markup.scope_visibility(dv.marked_up(spark, sf))
        .groupBy("source_file")
        .agg(F.count_if("dropped").alias("dropped_lines"))
    )


@query(
    "heading_blocks",
    _block_sql(
        "heading",
        """SELECT doc_id, start, length(s) AS len, is_last AS last, (i // 12) % 3 + 2 AS level, 'sec-' || tag AS anchor, x AS txt FROM seg WHERE i % 12 = 0
        UNION ALL SELECT doc_id, 0, length('# Title ' || doc_id || ' {#ttl-' || doc_id || '}'), false, 1, 'ttl-' || doc_id, 'Title ' || doc_id FROM documents""",
    ),
)
def heading_blocks(spark, sf):
    return _block_rows(blocks(spark, sf, "heading"))


@query(
    "table_blocks",
    _block_sql(
        "table",
        "SELECT doc_id, start, length(s) AS len, is_last AS last, 0 AS level, 'tbl-' || tag AS anchor, 'Table (tbl-' || tag || '): Cap ' || x || chr(10) || '| ' || x || ' | b |' || chr(10) || '|---|---|' AS txt FROM seg WHERE i % 12 = 5",
    ),
)
def table_blocks(spark, sf):
    return _block_rows(blocks(spark, sf, "table"))


@query(
    "equation_blocks",
    _block_sql(
        "equation",
        "SELECT doc_id, start, length(s) AS len, is_last AS last, 0 AS level, 'eq-' || tag AS anchor, '$$ ' || x || ' $$ (eq-' || tag || ')' AS txt FROM seg WHERE i % 12 IN (6, 7)",
    ),
)
def equation_blocks(spark, sf):
    return _block_rows(blocks(spark, sf, "equation"))


@query(
    "figure_blocks",
    _block_sql(
        "figure",
        """SELECT doc_id, start, length('::: {#fig-' || tag || ' fig-cap="' || x || '"}') AS len, false AS last, 0 AS level, 'fig-' || tag AS anchor, 'Figure (fig-' || tag || '): ' || x AS txt FROM seg WHERE i % 12 = 8""",
    ),
)
def figure_blocks(spark, sf):
    return _block_rows(blocks(spark, sf, "figure"))


def _all_sql(where: str) -> str:
    return f"""WITH {dv.BLOCKS} SELECT source_file, kind, char_start, char_end, CAST(level AS INT) AS level,
      CAST(anchor AS VARCHAR) AS anchor, md5(txt) AS text_md5 FROM spans WHERE {where}"""


@query("callout_titles", _all_sql("kind = 'para'"))
def callout_titles(spark, sf):
    """Titles of callouts among all the paragraphs."""
    return _block_rows(blocks(spark, sf, "para"))


@query("para_list_blocks", _all_sql("kind IN ('para', 'list')"))
def para_list_blocks(spark, sf):
    return _block_rows(blocks(spark, sf, "para", "list"))


@query("all_blocks", _all_sql("true"))
def all_blocks(spark, sf):
    return _block_rows(blocks(spark, sf))


_LABELS_SQL = """labels_t AS (SELECT 'sec-' || tag AS anchor, '§ ' || x AS label FROM seg WHERE i % 12 = 0
      UNION ALL SELECT 'ttl-' || doc_id, '§ Title ' || doc_id FROM documents
      UNION ALL SELECT 'tbl-' || tag, 'Table [tbl-' || tag || ']' FROM seg WHERE i % 12 = 5
      UNION ALL SELECT 'eq-' || tag, 'Equation [eq-' || tag || ']' FROM seg WHERE i % 12 IN (6, 7)
      UNION ALL SELECT 'fig-' || tag, 'Figure [fig-' || tag || ']' FROM seg WHERE i % 12 = 8)"""


@query("collect_labels", f"WITH {dv.MARKED}, {_LABELS_SQL} SELECT anchor, label FROM labels_t")
def collect_labels(spark, sf):
    return markup.collect_labels(blocks(spark, sf, "heading", "figure", "table", "equation"))


@query(
    "collect_labels_in_order",
    """SELECT 'sec-' || doc_id % 97 AS anchor, '§ Title ' || doc_id AS label FROM documents
    QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id % 3 DESC, doc_id) = 1""",
)
def collect_labels_in_order(spark, sf):
    """Anchors that several files define; files are read by volume, and backwards in a volume."""
    docs = dv.t(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source_file"))
    heads = docs.select(
        "source_file",
        F.lit(0).alias("block_no"),
        F.lit("heading").alias("kind"),
        F.concat(F.lit("Title "), "source_file").alias("text"),
        F.concat(F.lit("sec-"), (F.col("doc_id") % 97).cast("string")).alias("anchor"),
    )
    chapters = docs.select("source_file", (F.col("doc_id") % 3).cast("int").alias("volume"), (-F.col("doc_id")).alias("ordinal"))
    return markup.collect_labels(heads, chapters)


@query(
    "resolve_crossrefs",
    f"""WITH {dv.BLOCKS} SELECT b.source_file, b.kind, b.char_start, b.char_end, CAST(b.level AS INT) AS level, CAST(b.anchor AS VARCHAR) AS anchor,
      md5(CASE WHEN b.i % 12 = 11 THEN 'See § ' || h.x || ' and @tbl-none-' || b.doc_id || '-' || b.i || ' ' || own.x ELSE b.txt END) AS text_md5
    FROM spans b LEFT JOIN seg own ON own.doc_id = b.doc_id AND own.i = b.i
    LEFT JOIN seg h ON h.doc_id = b.doc_id AND h.i = b.i - 11""",
)
def resolve_crossrefs(spark, sf):
    # three readers: written once to the shared folder
    b = cut_lineage(blocks(spark, sf), "blocks")
    return _block_rows(markup.resolve_crossrefs(b, markup.collect_labels(b)))


@query(
    "section_path",
    f"""WITH {dv.BLOCKS}, h AS (SELECT doc_id, i // 12 AS j, x FROM seg WHERE i % 12 = 0)
    SELECT s.source_file, s.kind, s.char_start, s.char_end,
      md5(CASE WHEN s.i < 0 THEN '' WHEN (s.i // 12) % 3 = 0 THEN h0.x WHEN (s.i // 12) % 3 = 1 THEN h1.x || '|' || h0.x
        ELSE h2.x || '|' || h1.x || '|' || h0.x END) AS path_md5
    FROM spans s LEFT JOIN h h0 ON h0.doc_id = s.doc_id AND h0.j = s.i // 12
    LEFT JOIN h h1 ON h1.doc_id = s.doc_id AND h1.j = s.i // 12 - 1
    LEFT JOIN h h2 ON h2.doc_id = s.doc_id AND h2.j = s.i // 12 - 2""",
)
def section_path(spark, sf):
    b = chunking.section_paths(blocks(spark, sf))
    return b.select("source_file", "kind", "char_start", "char_end", F.md5(F.array_join("section_path", "|")).alias("path_md5"))


# ---- counting, splitting, packing -------------------------------------------------


@query(
    "heading_path",
    f"WITH {dv.DOC_ROWS} SELECT id, heading_path FROM doc_rows",
)
def heading_path(spark, sf):
    return dv.doc_rows(spark, sf).select("id", "heading_path")


@query("token_count", f"SELECT doc_id, {dv.tokens_sql('text')} AS tokens FROM documents")
def token_count(spark, sf):
    return dv.t(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


_CUT_SQL = r"""string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(
    "split_sentences",
    f"WITH s AS (SELECT doc_id, {_CUT_SQL} AS x FROM documents) SELECT doc_id, CAST(len(x) AS INT) AS n, md5(array_to_string(x, '|')) AS joined_md5 FROM s",
)
def split_sentences(spark, sf):
    s = tx.split_sentences(F.col("text"))
    return dv.t(spark, sf, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("joined_md5"))


_WHOLE = "whole AS (SELECT doc_id, 0 AS i, text AS txt, 0 AS char_start, n_chars AS char_end FROM documents)"


@query(
    "split_paragraph",
    f"""WITH RECURSIVE {_WHOLE}, {dv.pieces_sql(120, 'whole', cut_all=True)}
    SELECT doc_id, CAST(piece AS INT) AS piece, md5(txt) AS text_md5 FROM pieces""",
)
def split_paragraph(spark, sf):
    """All documents: sentences are counted one by one, so a text just below the budget can still be two pieces."""
    d = dv.t(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(tx.split_paragraph(F.col("text"), 120)).alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).alias("piece"), F.md5("p").alias("text_md5")
    )


_SECTIONED = f"""{dv.PARAS}"""


@query(
    "pack_chunks",
    f"""WITH RECURSIVE {_SECTIONED}, {dv.packed_sql(60, 120, section="x.i // 10", atomic="(i % 7 = 3)")}
    SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(section AS VARCHAR) AS section, CAST(char_start AS INT) AS char_start,
      CAST(char_end AS INT) AS char_end, CAST(token_count AS INT) AS token_count, oversize, substr(sha256(text), 1, 32) AS content_hash FROM chunks""",
)
def pack_chunks(spark, sf):
    """Lines as blocks, a section every ten lines, every seventh line atomic, budget 60-120."""
    d = dv.t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "doc_id", "text")
    ln = markup.explode_lines(d)
    b = ln.select(
        "source_file",
        F.col("line_no").alias("block_no"),
        F.when(F.col("line_no") % 7 == 3, "code").otherwise("para").alias("kind"),
        tx.strip(F.col("line")).alias("text"),
        "char_start",
        "char_end",
        F.array(F.floor(F.col("line_no") / 10).cast("string")).alias("section_path"),
    ).filter("text <> ''")
    return chunking.pack_chunks(chunking.block_items(b, 120), 60, 120).select(
        F.col("source_file").cast("long").alias("doc_id"),
        "chunk_no",
        F.col("section_path")[0].alias("section"),
        "char_start",
        "char_end",
        "token_count",
        "oversize",
        "content_hash",
    )


@query("embed_text", f"WITH {dv.DOC_ROWS} SELECT id, md5(heading_path || chr(10) || chr(10) || text) AS form_md5 FROM doc_rows")
def embed_text(spark, sf):
    return dv.doc_rows(spark, sf).select("id", F.md5(tx.embed_text(F.col("heading_path"), F.col("text"))).alias("form_md5"))


@query("content_hash", f"SELECT doc_id, {dv.hash_sql('text')} AS content_hash FROM documents")
def content_hash(spark, sf):
    return dv.t(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(
    "question_hash",
    f"SELECT item_id, {dv.hash_sql('lower(' + dv.strip_sql('text') + ')')} AS question_hash FROM benchmark",
)
def question_hash(spark, sf):
    return dv.t(spark, sf, "benchmark").select("item_id", tx.question_hash(F.col("text")).alias("question_hash"))


@query(
    "chunk_stats",
    dv.chunks_sql()
    + """ SELECT count(*) AS count, CAST(min(token_count) AS INT) AS tokens_min, CAST(max(token_count) AS INT) AS tokens_max,
      round(sum(token_count)::DOUBLE / count(*), 1) AS tokens_mean, count(*) FILTER (oversize) AS oversize,
      count(*) FILTER (token_count < 400) AS under_min,
      CAST((SELECT token_count FROM (SELECT token_count, row_number() OVER (ORDER BY token_count) - 1 AS r, count(*) OVER () AS n FROM chunks) WHERE r = n // 2) AS INT) AS tokens_p50
    FROM chunks""",
)
def chunk_stats(spark, sf):
    return chunking.chunk_stats(cut_lineage(dv.doc_chunks(spark, sf).select("token_count", "oversize"), "chunks"))


def _sweep_sql() -> str:
    arms, ctes = [], [dv.PARAS]
    for name, lo, hi in _BUDGETS:
        body = dv.packed_sql(lo, hi)
        for cte in ("sized", "sents0", "sents", "split", "pieces", "items0", "items", "pack", "chunks"):
            import re

            body = re.sub(rf"\b{cte}\b", f"{cte}_{hi}", body)
        ctes.append(body)
        arms.append(
            f"""SELECT '{name}' AS config, count(*) AS chunks, CAST(min(token_count) AS INT) AS tokens_min, CAST(max(token_count) AS INT) AS tokens_max,
            round(avg(token_count), 6) AS tokens_mean, count(*) FILTER (token_count < {lo}) AS under_min FROM chunks_{hi}"""
        )
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + " UNION ALL ".join(arms)


_BUDGETS = [("budget-400", 200, 400), ("budget-600", 300, 600), ("budget-800", 400, 800)]


@query("chunk_size_sweep", _sweep_sql())
def chunk_size_sweep(spark, sf):
    return chunking.chunk_size_sweep(dv.t(spark, sf, "documents").select("doc_id", "text"), _BUDGETS)
