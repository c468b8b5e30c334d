"""Operators for training data against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import (
    components,
    crosspolytope,
    decontam,
    licences,
    lines,
    mixing,
    simhash,
    substrings,
    suffixes,
    tokens,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, h long"


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(d, t, "en", s, None if t is None else len(t), "x", 1, 2) for d, t, s in rows], DOCS
    ).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(r.choice(words) for _ in range(120))
    rows = [(0, base, "a"), (1, base, "b"), (2, base + " tail", None), (2, base + " other", "a"), (None, base, "c")]
    rows += [(3, None, "a"), (4, "", "b"), (5, " \n\t", "b"), (6, "one", "a"), (7, "x y " * 3000, "b"), (7, "x y " * 3000, "b")]
    rows += [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 90))), r.choice("abc")) for i in range(8, 60)]
    rows += [(None, None, None), (61, "Ünïcode é " * 40, "a")]
    return rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mix(spark, odd):
    got = mixing.mix(make(spark, odd), bucket_rows=4).collect()
    assert len(got) == len(odd)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (d is None, d or 0, len(words(t))) for d, t, _ in odd
    )
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert math.isclose(sum(rs[0].target for rs in by.values()), 1.5 * total)
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 2 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
        assert all(r.taken <= 2 * r.size for r in rs)
        left = [r for r in sorted(rs, key=lambda r: r.draw_key) if r.taken > r.epochs * r.size]
        assert all(r.taken % r.size == 0 for r in rs if r.size)
        assert {r.draw_key for r in left} <= {r.draw_key for r in rs}
    assert sorted(map(str, mixing.mix(make(spark, odd), bucket_rows=100).collect())) == sorted(map(str, got))
    assert mixing.mix(make(spark, [])).count() == 0


def test_mix_targets_reshare(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["a"] == 20 and t[None] == 200 and math.isclose(t["b"], 1.5 * 1110 - 220)


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 12)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (920, [0.0] * 12), (940, [float("nan")] * 12), (960, [None] * 12), (980, [1.0]), (None, [1.0] * 12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = crosspolytope.nearest(v, bucket=40, cell=16).collect()
    near = {}
    for g in sorted(got, key=lambda g: g["rank"]):
        near.setdefault(g.query_id, []).append(g)
    y = x.astype(float)
    hit = 0
    assert sorted(near) == list(range(0, 400, 20))
    for q, gs in near.items():
        s = y @ y[q]
        assert len(gs) == 20 and [g["rank"] for g in gs] == list(range(1, 21)) and q not in [g.vec_id for g in gs]
        assert all(math.isclose(g.score, s[g.vec_id], rel_tol=1e-12, abs_tol=1e-12) for g in gs)
        assert [(-g.score, g.vec_id) for g in gs] == sorted((-g.score, g.vec_id) for g in gs)
        s[q] = -np.inf
        hit += len({g.vec_id for g in gs} & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(near)
    assert crosspolytope.nearest(v.limit(0)).count() == 0
    few = crosspolytope.nearest(v.where("vec_id < 5")).collect()
    assert sorted(g.vec_id for g in few) == [1, 2, 3, 4]


def fingerprint(t, k=4):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("blocks", [3, 2])
def test_simhash_components(spark, blocks):
    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else [f"v{r.randrange(500)}" for _ in range(100)]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "Z"
        rows.append((i, " ".join(w), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, rows[1][1].upper(), "s"), (None, rows[1][1], "s")]
    f = [fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(f[i] ^ f[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    want = sorted(
        (d is None, d or 0, f"{x:016x}", min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None)))
        for i, ((d, _, _), x) in enumerate(zip(rows, f))
    )
    got = simhash.simhash_components(make(spark, rows), blocks=blocks).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.fingerprint, g.component_id) for g in got) == want


def test_every_pair_within_four_bits_meets():
    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, (500, 1)).astype(np.uint64)
    g = f.copy()
    for i in range(500):
        for b in r.choice(64, 4, replace=False):
            g[i, 0] ^= np.uint64(1 << int(b))
    for blocks in (3, 2):
        cuts = simhash.cut_blocks(1, blocks)
        both = [set(zip(*map(np.ndarray.tolist, simhash.anchors(x, cuts, 4 // blocks)))) for x in (f, g)]
        assert {i for i, _ in both[0] & both[1]} == set(range(500))


def test_near_duplicates(spark, odd):
    r = random.Random(9)
    long = [f"u{r.randrange(3000)}" for _ in range(400)]
    near, far = list(long), list(long)
    for i in range(0, 400, 50):
        near[i] = "edit"
    for i in range(0, 400, 9):
        far[i] = "edit"
    rows = odd + [(70, " ".join(long), "a"), (71, " ".join(near), "b"), (72, " ".join(far), "b")]
    out = simhash.near_duplicates(make(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = [x.doc_id for x in out.collect()]
    assert 70 in kept and 71 not in kept and 72 in kept
    assert 0 in kept and not {1, 2, None} & set(kept)
    assert kept.count(7) == 1 and 3 in kept and not {4, 5} & set(kept)
    assert set(range(8, 60)) <= set(kept)


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (200, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [
        (1, mit + "Unknown words here.\n" + notice, "a"), (2, notice + mit, "a"), (3, None, "a"), (4, "", "a"),
        (5, "Intro. Licensed under the Apache License, Version 2.0. Released under the MIT License!", "a"),
        (5, "SPDX-License-Identifier: MIT", "a"), (6, "licensed under nothing", "a"),
    ]
    got = sorted((r.doc_id, r.licence) for r in licences.licences(make(spark, rows)).collect())
    assert got == [(1, "MIT"), (5, "Apache-2.0"), (5, "MIT")]
    assert licences.licences(make(spark, [])).count() == 0


ITEM = "If a train travels 120 km in 2 hours towards the town of Berlin how far does the train go in 5 hours"


def test_leaks(spark):
    other = ITEM.replace("120", "90").replace("Berlin", "Paris").replace("5", "7")
    clash = ITEM.replace("2 hours", "3 hours").replace("5 hours", "4 hours")
    fill = "nothing of note is said in these words and they go on for some time before and after it all ends "
    rows = [
        (1, fill + ITEM + " " + fill, "a"), (2, fill + other, "a"), (3, fill * 4, "a"), (4, None, "a"), (5, "", "a"),
        (6, fill + clash, "a"), (7, ITEM.upper().replace("BERLIN", "Berlin"), "a"), (None, ITEM, "a"), (8, ITEM[:40], "a"),
    ]
    items = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(make(spark, rows), items).collect()}
    assert set(got) >= {1, 2, 6, None} and not {3, 4, 5, 8} & set(got)
    assert got[1].n_changed == 0 and got[2].n_changed == 3 and got[1].item_id == 10
    same = "give 4 apples to 4 friends and keep the others in the old wooden box by the door"
    items = spark.createDataFrame([(1, same)], "item_id long, text string")
    rows = [(1, same.replace("4", "6"), "a"), (2, same.replace("4 apples", "6 apples"), "a")]
    assert [r.doc_id for r in decontam.leaks(make(spark, rows), items).collect()] == [1]
    kept = decontam.decontaminate(make(spark, rows), items)
    assert [r.doc_id for r in kept.collect()] == [2] and len(kept.columns) == 8
    assert decontam.leaks(make(spark, rows), items.limit(0)).count() == 0


def test_suffix_expansion_begins_at_short_strings(monkeypatch):
    """Equal to brute force at lengths around the symbols that the first sort packs; few sorts of the whole text."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 7, 8, 9, 13, 14, 15, 16, 30):
        for _ in range(40):
            parts = [bytes(rng.choice([0, 97, 255], int(rng.integers(1, 70)), p=[0.1, 0.8, 0.1]).astype(np.uint8)) for _ in range(5)]
            weights = rng.integers(1, 3, 5)
            seen = Counter()
            for p, w in zip(parts, weights.tolist()):
                for i in range(len(p) - n + 1):
                    seen[p[i : i + n]] += w
            want = [[i for i in range(len(p) - n + 1) if seen[p[i : i + n]] >= 2] for p in parts]
            assert [g.tolist() for g in suffixes.repeated_starts(parts, weights, n)] == want
    sorts = []
    argsort = np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, **kw: sorts.append(len(x)) or argsort(x, **kw))
    text = np.append(np.tile(np.array([2, 3, 2, 2, 4], np.int16), 300), np.int16(0))
    suffixes.suffix_order(text, 400)
    assert len(sorts) <= 5  # depths 7, 21, 63, 189 and 567


def test_long_repeats(spark, odd):
    n = 60
    texts = [(d, (t or "").encode()) for d, t, _ in odd]
    seen = {}
    for _, t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    want = []
    for d, t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                m[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        kept = bytes(x for x, y in zip(t, m) if not y)
        want.append((d is None, d or 0, len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    for cell in (3000, 2):
        got = suffixes.long_repeats(make(spark, odd), length=n, gram=8, block_bytes=4000, cell=cell).collect()
        assert sorted((g.doc_id is None, g.doc_id or 0, *g[1:5]) for g in got) == sorted(want)
    assert suffixes.long_repeats(make(spark, []), length=n).count() == 0


def test_lines(spark):
    rows = [(i, f"own {i}\nBoiler plate \n\nshared", f"s{i % 12}") for i in range(24)]
    rows += [(50, None, "a"), (51, "", "a"), (52, "Boiler plate", None), (None, "Boiler plate\nx", "b")]
    rows += [(60, "rare", f"s{i}") for i in range(9)]
    got = lines.drop_boilerplate(make(spark, rows)).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, g)
    assert by[0].text == rows[0][1] and by[5].text == "own 5\n" and by[5].n_removed == 2 and by[5].n_lines == 4
    assert by[50].text is None and by[51].text == "" and by[52].text == "" and by[None].text == "x"
    assert by[60].text == "rare" and len(got) == len(rows)
    assert lines.drop_boilerplate(make(spark, [])).count() == 0


def test_repeated_windows(spark, odd):
    k = 5
    order = [(d is None, d or 0, d, (t or "")) for d, t, _ in odd]
    keyed = {(a, b, t): make_hash(spark, t) for a, b, _, t in order}
    docs = sorted({(a, b if not a else 0, keyed[a, b, t], t) for a, b, _, t in order})
    seen, want = set(), {}
    for a, b, _, t in docs:
        w, hit = words(t), None
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                hit[i : i + k] = True
            seen.add(x)
        kept = " ".join(x for x, y in zip(w, hit) if not y)
        want[a, b, t] = (len(w), int(hit.sum()), hashlib.sha256(kept.encode()).hexdigest())
    for block in (16 << 20, 3000):
        got = substrings.repeated_windows(make(spark, odd), k=k, block_bytes=block).collect()
        assert sorted((g.doc_id is None, g.doc_id or 0, *g[1:4]) for g in got) == sorted(
            (a, b, *want[a, b, t]) for a, b, _, t in order
        )
    assert substrings.repeated_windows(make(spark, [])).count() == 0


def make_hash(spark, t):
    key = (id(spark), t)
    if key not in _HASHES:
        _HASHES[key] = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    return _HASHES[key]


_HASHES: dict = {}


def test_token_counts(spark, odd):
    vocab = tokens.Pieces({"▁": -3.0, "▁w": -2.0, "w1": -2.5, "1": -3.0, "2": -3.0, "12": -4.0, "x": -2.0, "▁x": -2.2, "one": -4.0, "o": -5.0})

    def alone(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(i - 1, -1, -1):
                s = vocab.scores.get(word[j:i])
                if s is not None and best[j][0] + s > best[i][0]:
                    best[i] = (best[j][0] + s, best[j][1] + 1)
            n = len(word[i - 1].encode())
            if word[i - 1] not in vocab.scores and best[i - 1][0] + vocab.unknown * n > best[i][0]:
                best[i] = (best[i - 1][0] + vocab.unknown * n, best[i - 1][1] + n)
        return best[-1][1]

    want = sorted((d is None, d or 0, len(words(t)), sum(alone("▁" + w) for w in words(t))) for d, t, _ in odd)
    got = tokens.token_counts(make(spark, odd), vocab).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_words, g.n_tokens) for g in got) == want


def test_toxicity(spark):
    r = random.Random(4)
    calm = [f"c{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(calm) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["slurone", "slurtwo", "slurred"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None, None), (2000, "", "s"), (2001, "slurone", "s"), (2001, "slurone", "s"), (2002, "c1 " * 40000, "s")]
    docs = make(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.verdicts(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    truth = {d: t for d, _, t in labels}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert {g.doc_id for g in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(g.predicted == truth[g.doc_id] for g in held) >= 0.95 * len(held)
    assert toxicity.drop_toxic(docs, lab).columns == docs.columns
    none = toxicity.verdicts(docs, lab.limit(0)).collect()
    assert {g.score for g in none} == {0.0}
    assert toxicity.verdicts(make(spark, []), lab).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = p.table(spark, sf, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.cut_lineage(stage(spark, docs, sf), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.6 * len(ids)
        ids = now
    mixed = p.mixing_stage(spark, docs, sf).collect()
    assert {r.doc_id for r in mixed} <= ids and all(0 < r.taken <= 2 * r.size for r in mixed)


def test_near_duplicates_of_one_template(spark):
    """Links that fail do not take the place of links that pass: the groups are those of brute force."""
    r = random.Random(3)
    rows = []
    for d in range(120):
        w = [f"b{i}" for i in range(304)]
        for i in r.sample(range(304), 4):
            w[i] = f"d{d}x{i}"
        rows.append((d, " ".join(w), "s"))
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    for part in (8 << 20, 60_000):
        kept = sorted(x.doc_id for x in simhash.near_duplicates(make(spark, rows), part_bytes=part).collect())
        assert kept == sorted(set(root))


def test_near_duplicates_count_a_repeated_shingle_once(spark):
    r = random.Random(6)
    one, two = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(500)) for x in "pq")
    dashes = " -" * 700
    rows = [(1, one + dashes, "a"), (2, two + dashes, "a"), (3, one, "a"), (4, two + " " + two, "a")]
    assert sorted(x.doc_id for x in simhash.near_duplicates(make(spark, rows)).collect()) == [1, 2]


def test_leaks_judge_each_run_by_itself(spark):
    first = "give 4 apples to 4 friends and keep the others in the old wooden box by the door"
    second = "then walk slowly back along the river until the mill comes into sight again"
    items = spark.createDataFrame([(1, f"{first} today {second}")], "item_id long, text string")
    rows = [(1, first.replace("4 apples", "6 apples") + " tonight " + second, "a"), (2, first.replace("4 apples", "6 apples"), "a")]
    got = decontam.leaks(make(spark, rows), items).collect()
    assert [(r.doc_id, r.n_words, r.n_slots, r.n_changed) for r in got] == [(1, 14, 0, 0)]


def test_leaks_of_items_behind_and_before_names(spark):
    items = [
        (1, "What is the name of the river that runs past the mill"),
        (2, "Alice Brown sold her red bicycle to a neighbour of Brown"),
        (3, "in 5 of the old barns there were rats and mice"),
        (4, "count all the rusty bolts"),
        (5, "4 of 7"),
    ]
    docs = [
        "he said {} and so on", "he asked: {} and so on", "she told Bob {} Again and so on", "she told Bob Carter {} Smith did so",
        "it was 12 {} and so on", "it ended. {}",
    ]
    rows = [(10 * i + n, d.format(t), "a") for i, t in items for n, d in enumerate(docs)]
    rows.append((99, "he will count all the rusty nails and sold her red bicycle", "a"))
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_changed) for r in decontam.leaks(make(spark, rows), items).collect()}
    assert got == {10 * i + n: (i, 0) for i in (1, 2, 3, 4) for n in range(6)}
