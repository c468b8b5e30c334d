"""Hard negatives, URL rules and collocations against brute force: nulls, ties, repeats, long texts, clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import collocations, hardneg, urlrules


# --- hard negatives


def plain_negatives(rows, every, positives=5, negatives=3):
    """rows: (id, integer vector, label) that take part."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, lab in rows:
        if i % every:
            continue
        pos = sorted((-dot(v, w), j) for j, w, x in rows if x == lab and j != i)[:positives]
        for s, j in pos:
            neg = sorted((-dot(v, w), k) for k, w, x in rows if x != lab and 50 * -s <= 100 * dot(v, w) <= 95 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(neg)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    x = (r.standard_normal((300, 8)) / 3 + 0.3).astype(np.float32)
    x[100:140] = x[7]  # ties
    labels = r.integers(0, 4, 300)
    labels[200:] = 1  # a label with most of the rows
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels))]
    rows += [(400, None, 1), (401, [1.0] * 8, None), (410, [None] + [1.0] * 7, 1), (411, [float("inf")] * 8, 1)]
    rows += [(420, [float("nan")] * 8, 2), (None, [1.0] * 8, 1), (430, [0.5] * 3, 2), (440, [], 3), rows[10], rows[17]]
    return rows


def whole(rows):
    ok = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in ok]


def frame(spark, rows, kind="float"):
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return d.withColumn("id", F.lit("x")).withColumn("cb", F.lit(1)).withColumn("nth", F.lit(1))


def test_hard_negatives(spark, vectors):
    got = hardneg.hard_negatives(frame(spark, vectors), every=10, row_block=64, anchor_block=3)
    assert sorted(map(tuple, got.collect())) == plain_negatives(whole(vectors), 10)


def test_hard_negatives_of_wide_vectors_and_other_labels(spark, vectors):
    """Components too wide for two fields in a double; the label replaced by another column expression."""
    r = random.Random(2)
    rows = [(i, [r.randint(-(2**24), 2**24) / 256.0 for _ in range(5)], i % 3) for i in range(90)]
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hardneg.hard_negatives(frame(spark, rows, "double"), every=10, label=moved)
    want = [(i, [int(256 * x) for x in v], (y + 1) % 3 if i % 7 == 0 else y) for i, v, y in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(want, 10)
    with pytest.raises(ArithmeticError):
        hardneg.hard_negatives(frame(spark, [(0, [1e300], 1)], "double"))


def test_hard_negatives_of_little(spark, vectors):
    assert hardneg.hard_negatives(frame(spark, vectors).limit(0)).count() == 0
    alone = [(0, [1.0, 0.0], 1), (1, [0.8, 0.0], 2), (2, [-1.0, 0.0], 1)]
    assert hardneg.hard_negatives(frame(spark, alone)).count() == 0  # its positive's score is below 0


@pytest.mark.parametrize(("least", "most", "weight"), [(-256, 256, 2000), (0, 0, 1), (-(2**20), 2**19, 2**24), (-3, 9, 40)])
def test_packed_products_are_exact(least, most, weight):
    r = np.random.default_rng(0)
    p = hardneg.Packing(least, most, weight)
    dim = 6
    a = r.integers(-(weight // dim), weight // dim + 1, (5, dim))
    for n in (1, 2, 3, 17):
        c = r.integers(least, most + 1, (n, dim))
        c[0] = least
        c[-1] = most
        assert (p.scores(a, p.pack(c), n) == a @ c.T).all()


# --- url rules

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("example.com", "", "block"), ("example.com", "/e", "allow"), ("a.example.com", "/", "block"), ("", "", "block"),
    ("net", "/es/", "allow"), ("org", "/x/y/z", "block"), ("xample.com", "/en/deep/", "allow"), (None, "/", "block"),
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_judge(url, rules):
    host, path = plain_url(url)
    fits = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in rules
        if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/1?x=/en/", "http://example.com/en",
    "http://example.com/en/deep/x#y", "http://notexample.com/en/", "http://b.a.example.com", "http://b.a.example.com/q",
    "http://x.net/es/", "http://x.net/es", "ftp://x.org/x/y/zz", "http://x.org/x/y", "http://x.org//x/y/z", "://.com/", "a://b://example.com/en/",
    "http://example.com?q=://net/es/", "http://É.example.com/EN/", "http://example.com./en/", "http://x.com/" + "a/" * 20_000 + "\nb",
    "http://" + "a." * 5_000 + "example.com/en/\n",
]


@pytest.mark.parametrize("most_rules", [1000, 2])
def test_url_rules(spark, most_rules):
    """By the trie, and by the join that larger rule tables take."""
    urls = URLS + URLS[:9]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, urlrules.RULES)
    got = urlrules.judge_urls(pages, rules, most_rules=most_rules)
    got = got.select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls)
    for g in got:
        assert tuple(g)[1:] == plain_judge(urls[g.page_id], RULES), urls[g.page_id]


def test_url_rules_of_little(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], urlrules.RULES)
    got = urlrules.judge_urls(pages, none, otherwise="block").collect()
    assert sorted((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(1, "a.com", "/", None, "block"), (2, "", "", None, "block")]
    rules = spark.createDataFrame(RULES, urlrules.RULES)
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0


# --- collocations


def plain_collocations(rows, least, keep):
    f, n = {}, Counter()
    for lang, text in rows:
        lang, t = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        c = f.setdefault(lang, Counter())
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        got = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in cand.items()):
                continue
            cuts = [(2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            got.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(sorted(got)[:keep])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(8)
    words = ["the", "The", "of", "new", "york", "city", "é", "Ü", "x\u00a0y", "--", "a'b", "𝄞"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(r.randint(0, 60)):
            t.append(r.choice(["new york city hall", "one two three four", r.choice(words), r.choice(words)]))
            t.append(r.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "; "]))
        rows.append((r.choice(["en", "en", "en", "de", None]), "".join(t)))
    rows += [("en", None), ("en", ""), ("xx", " ,,. "), (None, "new york " * 30_000), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("run", [300, 2 << 20])
def test_collocations(spark, prose, run, monkeypatch):
    monkeypatch.setattr(collocations, "RUN", run)
    docs = spark.createDataFrame([(l_, t, "x", 1) for l_, t in prose], "lang string, text string, phrase string, a long").repartition(4)
    got = collocations.collocations(docs, least=6, keep=50, filter_bits=15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(prose, 6, 50)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_little(spark):
    docs = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0
    both = collocations.collocations(docs, least=1).collect()
    assert [tuple(r) for r in both] == [("en", 1, "a b", 1, 1, 1, 2, 1_000_000)]
