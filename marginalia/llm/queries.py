"""Registered queries of this package and their checker SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    collocations,
    crosspolytope,
    decontam,
    hardneg,
    licences,
    lines,
    mixing,
    simhash,
    substrings,
    suffixes,
    tokens,
    toxicity,
    urlrules,
)
from marginalia.plans.derive import t as table

#: Public vocabulary of the token counts.
PIECES = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query(
    "op1_mixing",
    r"""
WITH lab AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 ELSE 0.5 END AS q FROM labels
             WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
          / coalesce(lab.q, 1.0)::DOUBLE AS k
      FROM documents d LEFT JOIN lab USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
        source_size * 2.0::DOUBLE AS top FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS nth,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
f AS (SELECT level FROM l WHERE level <= top / w ORDER BY nth LIMIT 1),
g AS (SELECT l.source, l.source_size, least(top, f.level * w) AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS LAST, d.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN 2 * upto - size <= 2 * rest THEN size ELSE 0 END)::BIGINT AS taken FROM p
""",
)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; labels of quality 1 and 0 weigh 2 and 0.5."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), corpus_pipeline.quality(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component of fingerprints within 4 bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_slots", "n_changed")


@query(
    "op7_lines",
    r"""
WITH x AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents),
y AS (SELECT doc_id, text, coalesce(source, chr(0)) AS site, nth,
             trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM x),
z AS (SELECT line, min((doc_id, nth)) AS first FROM y WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (SELECT y.doc_id, y.nth FROM y JOIN z USING (line) WHERE (y.doc_id, y.nth) <> z.first),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(gone.nth) AS n_removed,
             coalesce(string_agg(x.line, chr(10) ORDER BY x.nth) FILTER (WHERE gone.nth IS NULL), '') AS kept
      FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.nth = gone.nth GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
""",
)
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more, but for their first place."""
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_crosspolytope")
def op2_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row whose id is divisible by 20."""
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"))


@query("op6_suffixes")
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 400 bytes that start anywhere else too."""
    out = suffixes.long_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 20 words that start earlier too."""
    out = substrings.repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _licence_sql() -> str:
    """Fragments cut, joined and looked up in tables; rules as patterns over the numbers in order."""
    rules = licences.Rules.standard(tags=True)
    known = ", ".join(f"('{s}', {n}, {len(s.split())})" for s, n in rules.sentences.items())
    spaced = {lic: [p.replace(" (?:[0-9]+ )*", " (?: [0-9]+ )* ") for p in ps] for lic, ps in rules.patterns.items()}
    tests = ", ".join(
        "CASE WHEN " + " OR ".join(f"regexp_matches(ids, '{p}')" for p in ps) + f" THEN '{lic}' END" for lic, ps in spaced.items()
    )
    plain = f"regexp_replace(text, '{licences.COMMENT}', '\\1', 'g')"
    cut = rf"string_split(regexp_replace({plain}, '[.!?;:]+([ \t\r\n]|$)', chr(10), 'g'), chr(10))"
    return f"""
WITH known(s, n, words) AS (VALUES {known}),
x AS (SELECT row_number() OVER () AS row, doc_id, {cut} AS raw FROM documents),
y AS (SELECT row, doc_id, list_transform(raw, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS f FROM x),
i AS (SELECT row, doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM y),
b AS (SELECT DISTINCT split_part(s, ' ', 1) AS w FROM known),
j AS (SELECT row, doc_id, i, f, unnest(range(1, least((SELECT max(words) FROM known), len(f) - i + 1) + 1)) AS n
      FROM i JOIN b ON split_part(f[i], ' ', 1) = b.w),
h AS (SELECT row, doc_id, i, arg_max(known.n, j.n) AS n FROM j JOIN known ON known.s = array_to_string(f[i:i + j.n - 1], ' ') GROUP BY ALL),
z AS (SELECT row, doc_id, count(*) AS n_sentences, ' ' || string_agg(n::VARCHAR, '  ' ORDER BY i) || ' ' AS ids FROM h GROUP BY ALL),
f AS (SELECT row, doc_id, n_sentences, ids, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM z),
g AS (SELECT doc_id, n_sentences, CASE WHEN list_contains(found, 'BSD-3-Clause') AND NOT regexp_matches(ids, '{spaced["BSD-2-Clause"][-1]}')
        THEN list_filter(found, lambda x: x <> 'BSD-2-Clause') ELSE found END AS found FROM f),
u AS (SELECT doc_id, n_sentences, len(found) AS many, unnest(found) AS licence FROM g)
SELECT doc_id, licence, n_sentences FROM u WHERE many = 1 OR licence <> '{licences.RESERVED}'"""


@query("op4_licences", _licence_sql())
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the licences whose sentences they hold in a rule's order."""
    return licences.licences(table(spark, sf_dir, "documents"), licences.Rules.standard(tags=True))


@query("op9_tokens")
def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.Pieces.load(PIECES))


@query(
    "op11_hardneg",
    """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
             list_inner_product(a.v, c.v)::BIGINT AS score
      FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike),
f AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
      FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.alike
                     AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
      WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 3
""",
)
def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor's positives the first negatives inside the score range."""
    moved = F.when(F.pmod("id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


#: Rules that the url query judges by: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op12_urls",
    f"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
x AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlrules.UPPER}', '{urlrules.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
z AS (SELECT y.*, (SELECT max_by(h || p || ' ' || v, len(h || p)) FROM rules
                   WHERE (y.host = h OR ends_with(y.host, '.' || h)) AND starts_with(y.path, p)) AS hit FROM y)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), 'allow') AS verdict FROM z
""",
)
def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and path, the longest rule that fits, and its verdict (allow where none fits)."""
    rules = spark.createDataFrame(URL_RULES, urlrules.RULES)
    judged = urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query(
    "op13_collocations",
    rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{urlrules.UPPER}', '{urlrules.LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
g AS (SELECT lang, k AS size, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i),
c AS (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM c WHERE size > 1),
u AS (SELECT lang, unnest([array_to_string(ws[1:size - 1], ' '), array_to_string(ws[2:size], ' ')]) AS phrase, a FROM x WHERE size > 2),
m AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY ALL),
k AS (SELECT x.*, unnest(range(1, size)) AS k FROM x LEFT JOIN m USING (lang, phrase)
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * x.a),
f AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * k.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
      FROM k JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k.k], ' ')
             JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k.k + 1:k.size], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
""",
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
