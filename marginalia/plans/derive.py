"""Inputs of the registered queries, derived from the given tables by Spark, each with its SQL twin.

Every function reads whole tables. The SQL strings are common table expressions for the checker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.operators import chunking
from marginalia.sources.readers import read_parquet_table

STOP_SQL = ", ".join(f"'{w}'" for w in fv.STOP_WORDS)
WORD_OR_MARK_SQL = fv.P_WORD_OR_MARK


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet_table(spark, sf, name)


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"(CAST(trunc(len(regexp_extract_all({x}, '{WORD_OR_MARK_SQL}')) * 1.35::DOUBLE) AS INT) + 1)"


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> '')"


def hash_sql(x: str) -> str:
    return f"substr(sha256({x}), 1, 32)"


def fold_sql(x: str) -> str:
    return rf"regexp_replace({x}, '{fv.P_SUFFIX}', '\1')"


# ---- documents as chunk rows ------------------------------------------------------

VOLUMES = {"en": 1, "de": 2, "es": 3, "fr": 4}


def doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one row of the chunk table: language is the volume, source the chapter."""
    d = t(spark, sf, "documents")
    vol = F.lit(9)
    for k, v in VOLUMES.items():
        vol = F.when(F.col("lang") == k, F.lit(v)).otherwise(vol)
    part = F.floor(F.col("n_chars") / 1000)
    return (
        d.withColumn("volume", vol)
        .withColumn("chapter_num", F.regexp_extract("source", r"(\d+)$", 1).cast("int") + 1)
        .withColumn(
            "section_path",
            F.when(part < 1, F.array().cast("array<string>")).otherwise(
                F.array(F.concat(F.lit("Part "), part.cast("string")))
            ),
        )
        .select(
            F.col("doc_id").alias("id"),
            "volume",
            "chapter_num",
            F.col("source").alias("chapter_title"),
            "section_path",
            tx.heading_path(F.col("volume"), F.col("chapter_num"), F.col("source"), F.col("section_path")).alias(
                "heading_path"
            ),
            F.concat_ws("/", "lang", "source").alias("source_file"),
            tx.token_count(F.col("text")).alias("token_count"),
            F.concat(F.lit("c"), F.substring("source", 4, 1)).alias("commit_sha"),
            tx.content_hash(F.col("text")).alias("content_hash"),
            "text",
            "lang",
            "n_chars",
        )
    )


DOC_ROWS = f"""doc_rows AS (
  SELECT doc_id AS id,
    CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 9 END AS volume,
    CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) + 1 AS chapter_num,
    source AS chapter_title,
    CASE WHEN n_chars < 1000 THEN '' ELSE 'Part ' || (n_chars // 1000) END AS section,
    'Vol ' || (CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 9 END)
      || ' > Ch ' || (CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) + 1) || ': ' || source
      || CASE WHEN n_chars < 1000 THEN '' ELSE ' > Part ' || (n_chars // 1000) END AS heading_path,
    lang || '/' || source AS source_file,
    {tokens_sql('text')} AS token_count,
    'c' || substr(source, 4, 1) AS commit_sha,
    {hash_sql('text')} AS content_hash,
    text, lang, n_chars
  FROM documents)"""


# ---- documents cut into packed chunks ---------------------------------------------


def doc_chunks(spark: SparkSession, sf: str, lo: int = fv.MIN_TOKENS, hi: int = fv.MAX_TOKENS) -> DataFrame:
    """Packed chunks of all documents; every non-blank line is a paragraph."""
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    packed = chunking.pack_chunks(chunking.line_items(docs, hi), lo, hi)
    return packed.withColumn("id", chunking.chunk_id(F.col("doc_id"), F.col("chunk_no")))


LINES = rf"""raw AS (SELECT doc_id, lang, source, length(text) AS n, string_split(text, chr(10)) AS ls FROM documents),
lines0 AS (SELECT doc_id, lang, source, n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM raw),
lines AS (SELECT doc_id, lang, source, i, line,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
    CAST(least(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i), n) AS BIGINT) AS char_end
  FROM lines0)"""


def pieces_sql(hi: int, source: str = "paras", atomic: str = "false", cut_all: bool = False) -> str:
    """Paragraphs over the budget (all, with `cut_all`) cut into whole sentences filled up to it."""
    long = "true" if cut_all else f"tok > {hi}"
    cut = r"""string_split(regexp_replace(txt, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
    return f"""
sized AS (SELECT *, {tokens_sql('txt')} AS tok, {atomic} AS atomic FROM {source}),
sents0 AS (SELECT doc_id, i, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS j FROM sized WHERE {long} AND NOT atomic),
sents AS (SELECT *, {tokens_sql('s')} AS st FROM sents0),
split AS (
  SELECT doc_id, i, j, 1 AS piece, st AS used FROM sents WHERE j = 1
  UNION ALL
  SELECT p.doc_id, p.i, s.j, CASE WHEN p.used + s.st > {hi} THEN p.piece + 1 ELSE p.piece END,
    CASE WHEN p.used + s.st > {hi} THEN s.st ELSE p.used + s.st END
  FROM split p JOIN sents s ON s.doc_id = p.doc_id AND s.i = p.i AND s.j = p.j + 1),
pieces AS (SELECT a.doc_id, a.i, a.piece, string_agg(b.s, ' ' ORDER BY b.j) AS txt
  FROM split a JOIN sents b ON a.doc_id = b.doc_id AND a.i = b.i AND a.j = b.j GROUP BY 1, 2, 3),
items0 AS (
  SELECT doc_id, i, 0 AS piece, txt, tok, atomic FROM sized WHERE tok <= {hi} OR atomic
  UNION ALL
  SELECT doc_id, i, piece, txt, {tokens_sql('txt')}, false FROM pieces)"""


def packed_sql(lo: int, hi: int, section: str = "0", source: str = "paras", atomic: str = "false") -> str:
    """Recursive twin of the packing fold, over ``source`` (doc_id, i, txt, char_start, char_end)."""
    return f"""{pieces_sql(hi, source, atomic)},
items AS (SELECT x.*, p.char_start, p.char_end, {section} AS section,
    row_number() OVER (PARTITION BY x.doc_id ORDER BY x.i, x.piece) AS k
  FROM items0 x JOIN {source} p ON p.doc_id = x.doc_id AND p.i = x.i),
pack AS (
  SELECT doc_id, k, 0 AS chunk_no, tok AS used, (atomic AND tok > {hi}) AS alone, section FROM items WHERE k = 1
  UNION ALL
  SELECT p.doc_id, t.k,
    CASE WHEN p.alone OR (t.atomic AND t.tok > {hi}) OR (t.section <> p.section AND p.used >= {lo})
      OR p.used + t.tok > {hi} THEN p.chunk_no + 1 ELSE p.chunk_no END,
    CASE WHEN p.alone OR (t.atomic AND t.tok > {hi}) OR (t.section <> p.section AND p.used >= {lo})
      OR p.used + t.tok > {hi} THEN t.tok ELSE p.used + t.tok END,
    (t.atomic AND t.tok > {hi}), t.section
  FROM pack p JOIN items t ON t.doc_id = p.doc_id AND t.k = p.k + 1),
chunks AS (SELECT a.doc_id, a.chunk_no, arg_min(b.section, b.k) AS section, CAST(sum(b.tok) AS BIGINT) AS token_count,
    bool_or(a.alone) AS oversize, min(b.char_start) AS char_start, max(b.char_end) AS char_end,
    string_agg(b.txt, chr(10) || chr(10) ORDER BY b.k) AS text,
    CAST(a.doc_id * 16777216 + a.chunk_no AS BIGINT) AS id
  FROM pack a JOIN items b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY a.doc_id, a.chunk_no)"""


PARAS = f"""{LINES},
paras AS (SELECT doc_id, i, {strip_sql('line')} AS txt, char_start, char_end FROM lines WHERE {strip_sql('line')} <> '')"""


def chunks_sql(lo: int = fv.MIN_TOKENS, hi: int = fv.MAX_TOKENS) -> str:
    return f"WITH RECURSIVE {PARAS}, {packed_sql(lo, hi)}"


# ---- events as logs, requests and samples -----------------------------------------

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


EVENTS = r"""ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INT) AS k FROM events)"""


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as answered questions: value is latency and score, k names three consecutive chunks."""
    k = F.col("k").cast("long")
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("question "), F.col("user_id").cast("string")).alias("question"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("finished_at"),
        F.lit("demo").alias("profile"),
        F.lit("m").alias("model"),
        F.lit("v1").alias("prompt_version"),
        F.lit("hybrid").alias("retrieval_mode"),
        F.col("value").alias("total_ms"),
        F.array(k, k + 1, k + 2).alias("reranked_ids"),
        F.array(F.col("value") - 20, F.col("value") / 2, -F.col("k").cast("double")).alias("rerank_scores"),
        F.concat(F.lit("answer for "), F.col("user_id").cast("string"), F.lit(" ["), (k % 4).cast("string"), F.lit("]")).alias(
            "answer"
        ),
        (F.col("event_type") == "signup").alias("abstained"),
        F.when(F.col("event_type") == "error", "boom").alias("error"),
        "k",
        "user_id",
        "event_type",
    )


QUERY_LOG = f"""{EVENTS}, query_log AS (SELECT event_id AS id, 'question ' || user_id AS question, ts AS started_at,
    ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finished_at, value AS total_ms, k, user_id, event_type,
    'answer for ' || user_id || ' [' || (k % 4) || ']' AS answer,
    (event_type = 'signup') AS abstained, CASE WHEN event_type = 'error' THEN 'boom' END AS error FROM ev)"""


# ---- marked-up documents with a known structure ------------------------------------


def _clean_lines(text):
    """The lines of a text without marks: cleaned as a whole, as no step reaches over a line end."""
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} ,\n]", " "), " +", " ")
    return F.split(marks, "\n")


def marked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a marked-up file: line i becomes a construct chosen by its place, so that the
    expected blocks are known from the plain lines."""
    d = t(spark, sf, "documents")

    def part(line, i):
        # trimmed and named once a line: every construct repeats it
        named = F.when(F.trim(line) == "", F.lit("empty")).otherwise(F.trim(line))
        return tx.let(named, lambda x: construct(x, i))

    def construct(x, i):
        tag = F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))
        c = lambda *xs: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in xs])
        j = (i / 12).cast("int") % 3
        kinds = [
            c(F.repeat(F.lit("#"), j + 2), " ", x, " {#sec-", tag, "}"),
            c("Text ", x),
            c("- ", x, "\n- two"),
            c("```text\n", x, "\n```"),
            c("```{python}\n", x, "\n```"),
            c("| ", x, " | b |\n|---|---|\n\n: Cap ", x, " {#tbl-", tag, "}"),
            c("$$ ", x, " $$ {#eq-", tag, "}"),
            c("$$\n", x, "\n$$ {#eq-", tag, "}"),
            c("::: {#fig-", tag, ' fig-cap="', x, '"}\n![](x.png)\n:::'),
            c("::: {.callout-quiz}\n\n", x, "\n\n::: {.inner}\n", x, "\n:::\n:::"),
            c('::: {.callout-note title="', x, '"}\nInside ', x, "\n:::"),
            c("See @Sec-", F.col("doc_id").cast("string"), "-", (i - 11).cast("string"), " and @tbl-none-", tag, " ", x),
        ]
        out = F.lit("")
        for n, k in enumerate(kinds):
            out = F.when(i % 12 == n, k).otherwise(out)
        return out

    body = F.array_join(F.transform(_clean_lines(F.col("text")), part), "\n\n")
    head = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit(" {#ttl-"), F.col("doc_id").cast("string"), F.lit("}\n\n"))
    return d.select(
        F.col("doc_id").cast("string").alias("source_file"), "doc_id", "lang", "source", F.concat(head, body).alias("text")
    )


MARKED = f"""{LINES},
seg0 AS (SELECT doc_id, i, CASE WHEN trim(regexp_replace(regexp_replace(line, '[^\\p{{L}}\\p{{N}} ,]', ' ', 'g'), ' +', ' ', 'g')) = '' THEN 'empty'
    ELSE trim(regexp_replace(regexp_replace(line, '[^\\p{{L}}\\p{{N}} ,]', ' ', 'g'), ' +', ' ', 'g')) END AS x, doc_id || '-' || i AS tag FROM lines),
seg1 AS (SELECT *, CASE i % 12
    WHEN 0 THEN repeat('#', CAST((i // 12) % 3 + 2 AS INT)) || ' ' || x || ' {{#sec-' || tag || '}}'
    WHEN 1 THEN 'Text ' || x
    WHEN 2 THEN '- ' || x || chr(10) || '- two'
    WHEN 3 THEN '```text' || chr(10) || x || chr(10) || '```'
    WHEN 4 THEN '```{{python}}' || chr(10) || x || chr(10) || '```'
    WHEN 5 THEN '| ' || x || ' | b |' || chr(10) || '|---|---|' || chr(10) || chr(10) || ': Cap ' || x || ' {{#tbl-' || tag || '}}'
    WHEN 6 THEN '$$ ' || x || ' $$ {{#eq-' || tag || '}}'
    WHEN 7 THEN '$$' || chr(10) || x || chr(10) || '$$ {{#eq-' || tag || '}}'
    WHEN 8 THEN '::: {{#fig-' || tag || ' fig-cap="' || x || '"}}' || chr(10) || '![](x.png)' || chr(10) || ':::'
    WHEN 9 THEN '::: {{.callout-quiz}}' || chr(10) || chr(10) || x || chr(10) || chr(10) || '::: {{.inner}}' || chr(10) || x || chr(10) || ':::' || chr(10) || ':::'
    WHEN 10 THEN '::: {{.callout-note title="' || x || '"}}' || chr(10) || 'Inside ' || x || chr(10) || ':::'
    ELSE 'See @Sec-' || doc_id || '-' || (i - 11) || ' and @tbl-none-' || tag || ' ' || x END AS s FROM seg0),
seg AS (SELECT *, CAST(length('# Title ' || doc_id || ' {{#ttl-' || doc_id || '}}') + 2
    + coalesce(sum(length(s) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    (i = max(i) OVER (PARTITION BY doc_id)) AS is_last FROM seg1)"""


def _blocks_sql() -> str:
    opener = """'::: {.callout-note title="' || x || '"}'"""
    line = lambda kind, where, level="0", anchor="NULL", txt="s": (
        f"SELECT doc_id, i, start, length(s) AS len, is_last AS last, '{kind}' AS kind, {level} AS level, {anchor} AS anchor, {txt} AS txt FROM seg WHERE {where}"
    )
    return " UNION ALL ".join(
        [
            "SELECT doc_id, -1, 0, length('# Title ' || doc_id || ' {#ttl-' || doc_id || '}'), false, 'heading', 1, 'ttl-' || doc_id, 'Title ' || doc_id FROM documents",
            line("heading", "i % 12 = 0", "(i // 12) % 3 + 2", "'sec-' || tag", "x"),
            line("para", "i % 12 IN (1, 11)"),
            line("list", "i % 12 = 2"),
            line("code", "i % 12 = 3"),
            line("table", "i % 12 = 5", anchor="'tbl-' || tag", txt="'Table (tbl-' || tag || '): Cap ' || x || chr(10) || '| ' || x || ' | b |' || chr(10) || '|---|---|'"),
            line("equation", "i % 12 IN (6, 7)", anchor="'eq-' || tag", txt="'$$ ' || x || ' $$ (eq-' || tag || ')'"),
            """SELECT doc_id, i, start, length('::: {#fig-' || tag || ' fig-cap="' || x || '"}'), false, 'figure', 0, 'fig-' || tag, 'Figure (fig-' || tag || '): ' || x FROM seg WHERE i % 12 = 8""",
            f"SELECT doc_id, i, start, length({opener}), false, 'para', 0, NULL, '**' || x || '.**' FROM seg WHERE i % 12 = 10",
            f"SELECT doc_id, i, start + length({opener}) + 1, length('Inside ' || x), false, 'para', 0, NULL, 'Inside ' || x FROM seg WHERE i % 12 = 10",
        ]
    )


#: Every block of the marked-up documents, known from the plain lines.
BLOCKS = f"""{MARKED},
blk(doc_id, i, start, len, last, kind, level, anchor, txt) AS ({_blocks_sql()}),
spans AS (SELECT *, CAST(doc_id AS VARCHAR) AS source_file, CAST(start AS INT) AS char_start,
  CAST(start + len + CASE WHEN last THEN 0 ELSE 1 END AS INT) AS char_end FROM blk)"""
