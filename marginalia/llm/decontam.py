"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers, units and names become typed placeholders that keep their value; a text's template is its words with the
values left out. Windows of template words are hash-joined with those of the benchmark; the texts that meet are then
aligned word by word, and the values in the slots of the aligned run must be consistent: wherever the benchmark repeats
a value, so does the document. A question with other numbers or names is thus caught like a verbatim one.

Plan: documents give a window at every `stride` words, benchmark items at every word, so that a run of
`window + stride - 1` words always has a window in common. Where a document's window lies on slots and tells nothing, all
windows around it are given, so the run is met by any window of it that tells something. Exploded windows carry hash,
id and place only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.frames import packed, row_key, small
from marginalia.session import cut_lineage

#: Marks of the slots, from a private-use block: number, unit, name.
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
LAST = "\uf8ff"
#: Units that count as such right behind a number.
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|lbs|lb|oz|l|ml|mi|miles|mile|ft|feet|in|inches|inch|yd|yards|meters|metres|kilometers|"
    "grams|kilograms|pounds|liters|litres|s|sec|seconds|min|minutes|h|hr|hours|hour|days|day|weeks|week|months|month|"
    "years|year|mph|kmh|hz|w|kw|kwh|v|c|f|usd|eur|dollars|dollar|euros|cents|percent"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slotted_words(text: Column) -> Column:
    """Words of letters and digits, in lower case, slots marked: a mark and the value. Null has none.

    A number is a run of digits with inner points, commas, colons or strokes; a unit one of UNITS behind a number; a
    name one to three capitalised words behind a word or comma, so that the first word of a sentence is none.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, f"[{NUM}{UNIT}{NAME}]", " ")
    capital = r"\p{Lu}\p{Ll}+"
    name = rf"([\p{{L}}\p{{N}},;:] )({capital})(?: ({capital}))?(?: ({capital}))?"
    t = F.regexp_replace(t, name, f"$1{NAME}$2$3$4")
    numbered = F.regexp_replace(t, r"[0-9]+(?:[.,:/][0-9]+)*", f" {NUM}$0 ")
    numbered = F.regexp_replace(numbered, r"(?<=[0-9] {1,2})(?i:" + UNITS + r")(?![\p{L}\p{N}])", f"{UNIT}$0")
    t = F.when(t.rlike("[0-9]"), numbered).otherwise(t)
    # a value keeps its inner points, so that 1.5 and 15 differ
    t = F.regexp_replace(t, rf"(?<=[0-9])[.,:/](?=[0-9])", "")
    t = F.lower(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}-]+", " "))
    return F.filter(F.split(t, " "), lambda w: w != "")


def template(words: Column) -> Column:
    """The words without the values of their slots."""
    return F.transform(
        words, lambda w: F.when(w.between(NUM, LAST), F.substring(w, 1, 1)).otherwise(w)
    )


def _telling(part: Column) -> Column:
    """Whether a window has three different words that are no slots."""
    return F.size(F.filter(F.array_distinct(part), lambda w: ~w.isin(NUM, UNIT, NAME))) >= 3


def embedded_words(text: Column) -> Column:
    """The different slotted words of an item as it stands alone, behind a word or a number, or behind one or two
    capitalised words that share a name slot with its first words; what is before the item is left out again."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))

    def behind(before: str, capitals: str = "") -> Column:
        def cut(w: Column) -> Column:
            head = NAME + capitals.replace(" ", "").lower()
            rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
            if not capitals:
                return rest
            first = F.element_at(w, 2)
            alone = F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0)))
            # the slot is the item's own if it goes on
            own = F.array(F.concat(F.lit(NAME), F.substring(first, len(head) + 1, 1 << 30)))
            return F.when(first == head, alone).otherwise(F.concat(own, alone))

        return let(slotted_words(F.concat(F.lit(f"{before} {capitals}"), t)), cut)

    return F.array_distinct(
        F.array(slotted_words(text), behind("x"), behind("x", "Aa "), behind("x", "Aa Aa "), behind("1"))
    )


def windows(words: Column, n: Column | int, stride: Column | int, around: bool = False) -> Column:
    """(h, at) of each run of n template words at every `stride`; with `around` also of all runs less than a stride away
    from one that tells nothing."""
    step = F.lit(stride) if isinstance(stride, int) else stride

    def run(t: Column) -> Column:
        last = F.size(t) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), step)).otherwise(
            F.array().cast("array<int>")
        )
        if around:
            near = lambda i: F.sequence(F.greatest(i - step + 1, F.lit(0)), F.least(i + step - 1, last))
            starts = F.flatten(F.transform(starts, lambda i: F.when(_telling(F.slice(t, i + 1, n)), F.array(i)).otherwise(near(i))))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(t, i + 1, n)).alias("h"), i.alias("at")))

    return let(template(words), run)


def verbatim(words: Column, n: Column | int) -> Column:
    """(h, at) of the runs of n words that tell nothing by their template, values included."""
    def run(t: Column) -> Column:
        last = F.size(t) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: ~_telling(F.slice(t, i + 1, n)))
        # another seed than that of templates
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit("="), F.slice(words, i + 1, n)).alias("h"), i.alias("at")))

    return let(template(words), run)


def _judged(both: Column) -> Column:
    """For each aligned word whether the templates agree (ok) and the place behind the last slot that it contradicts."""

    def judge(words: Column) -> Column:
        slots = F.filter(words, lambda p: p["ok"] & p["iw"].between(NUM, LAST))

        def places(known: Column) -> Column:
            def behind(p: Column) -> Column:
                other = F.filter(
                    known, lambda q: (q["at"] < p["at"]) & (q["iw"] == p["iw"]) & (q["dw"] != p["dw"])
                )
                return F.coalesce(F.array_max(F.transform(other, lambda q: q["at"])) + 1, F.lit(0))

            return F.transform(
                words,
                lambda p: F.struct(
                    p["ok"].alias("ok"),
                    F.when(p["ok"] & p["iw"].between(NUM, LAST), behind(p)).otherwise(0).alias("behind"),
                ),
            )

        return let(slots, places)

    words = F.transform(
        both,
        lambda p, i: F.struct(
            F.coalesce(p["it"] == p["dt"], F.lit(False)).alias("ok"), i.alias("at"), p["iw"].alias("iw"), p["dw"].alias("dw")
        ),
    )
    return let(words, judge)


def longest_run(both: Column) -> Column:
    """(best, end): length and end of the longest run of equal template words whose slots are consistent."""
    names = ("at", "start", "behind", "best", "end")
    state = F.struct(*[F.lit(0).alias(x) for x in names])

    def step(s: Column, p: Column) -> Column:
        better = ~p["ok"] & (s["behind"] <= s["start"]) & (s["at"] - s["start"] > s["best"])
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(p["ok"], s["start"]).otherwise(s["at"] + 1).alias("start"),
            F.greatest(s["behind"], p["behind"]).alias("behind"),
            F.when(better, s["at"] - s["start"]).otherwise(s["best"]).alias("best"),
            F.when(better, s["at"]).otherwise(s["end"]).alias("end"),
        )

    # one word that differs closes the last run
    close = F.array(F.struct(F.lit(False).alias("ok"), F.lit(0).alias("behind")))
    return F.aggregate(F.concat(_judged(both), close), state, step)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 8,
    least: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, rk (row key), item_id, n_words (aligned), n_slots, n_changed (slots of other value) of each leak.

    A leak is a run of template words that a document and an item have in common, of `least` words or the whole item
    if that is shorter, with consistent slots. Items without a run of `window` words (or of all, if they have fewer)
    that has three different words besides slots are told as a whole only, by their words and values; with fewer than
    four words they match nothing. Each run of a pair is
    judged by itself, an inconsistent slot rejects its run; the longest consistent one is reported. An item counts in
    each form that the words before it give its first words, and a name at its ends may have grown by its neighbours.
    Null or empty texts, no items or no documents: no rows. Null ids are kept; rows that repeat id and text are one.
    Repeated items are reported under their smallest id. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.explode(embedded_words(F.col(item_text_col))).alias("iw"))
    items = items.groupBy("iw").agg(F.min("item_id").alias("item_id")).where(F.size("iw") > 0)
    items = cut_lineage(items.withColumn("form", F.xxhash64("iw")), "items")
    goal = F.least(F.size("iw"), F.lit(least))
    stride = items.where(F.size("iw") >= window).select(F.min(goal)).first()[0]
    stride = max(1, (stride if stride is not None else least) - window + 1)
    short = items.where((F.size("iw") < window) & _telling(template(F.col("iw"))))
    short = sorted(r[0] for r in short.select(F.size("iw")).distinct().collect())
    width = F.least(F.size("iw"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("iw") - width)
    dull = items.where((F.size("iw") >= 4) & ~F.exists(starts, lambda i: _telling(F.slice(template(F.col("iw")), i + 1, width))))
    dull = cut_lineage(dull, "dull-items")
    whole = sorted(r[0] for r in dull.select(F.size("iw")).distinct().collect())
    ours = items.select(
        "form", width.alias("width"), F.explode(windows(F.col("iw"), width, 1)).alias("x"), template(F.col("iw")).alias("t")
    )
    ours = ours.where(_telling(F.slice("t", F.col("x.at") + 1, F.col("width"))))
    ours = ours.select(F.col("x.h").alias("h"), "form", F.col("x.at").alias("iat"))
    exact = dull.select(F.xxhash64(F.lit("="), F.col("iw")).alias("h"), "form", F.lit(0).alias("iat"))
    ours = small(ours.unionByName(exact))

    rows = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text")
    )

    def places(words: Column) -> Column:
        more = [windows(words, n, 1) for n in short] + [verbatim(words, n) for n in whole]
        return F.concat(windows(words, window, stride, around=stride > 1), *more)

    theirs = rows.select("id", "rk", F.explode(let(slotted_words(F.col("text")), places)).alias("x"))
    theirs = theirs.select("id", "rk", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    hits = theirs.join(ours, "h").select("id", "rk", "form", (F.col("at") - F.col("iat")).alias("off")).distinct()
    hits = cut_lineage(hits, "hits")
    who = hits.select(F.col("id").alias("hid"), F.col("rk").alias("hrk")).distinct()
    found = rows.join(
        who, F.col("id").eqNullSafe(F.col("hid")) & (F.col("rk") == F.col("hrk")), "left_semi"
    ).dropDuplicates(["id", "rk"])
    found = cut_lineage(found.select("id", "rk", slotted_words(F.col("text")).alias("dw")), "found")
    pairs = hits.join(
        found.withColumnRenamed("id", "fid").withColumnRenamed("rk", "frk"),
        F.col("id").eqNullSafe(F.col("fid")) & (F.col("rk") == F.col("frk")),
    )
    # only the words opposite the item go on
    a = F.greatest(F.col("off"), F.lit(0))
    pairs = pairs.join(items, "form").select(
        "id", "rk", "item_id", F.size("iw").alias("n"), F.greatest(-F.col("off"), F.lit(0)).alias("skipped"),
        F.slice("iw", F.greatest(-F.col("off"), F.lit(0)) + 1, F.size("iw")).alias("iw"),
        F.slice("dw", a + 1, F.size("iw")).alias("dw"),
    )
    pairs = pairs.withColumn("both", F.arrays_zip(template("iw").alias("it"), template("dw").alias("dt"), "iw", "dw"))

    def grown(p: Column, i: Column) -> Column:
        name, at = F.substring(p["iw"], 2, 1 << 30), i + F.col("skipped")
        more = ((at == 0) & p["dw"].endswith(name)) | ((at == F.col("n") - 1) & p["dw"].startswith(p["iw"]))
        same = (p["it"] == NAME) & (p["dt"] == NAME) & more
        return p.withField("dw", F.when(same, p["iw"]).otherwise(p["dw"]))

    # a name at an end of the item that its neighbours have grown is the same name
    pairs = pairs.withColumn("both", F.transform("both", grown))
    pairs = pairs.withColumn("r", longest_run(F.col("both")))
    pairs = pairs.where(F.col("r.best") >= F.least("n", F.lit(least)))
    run = F.slice("both", F.col("r.end") - F.col("r.best") + 1, F.col("r.best"))
    slots = F.filter(run, lambda p: p["iw"].between(NUM, LAST))
    pairs = pairs.withColumn("slots", slots)
    changed = F.size(F.filter("slots", lambda p: p["iw"] != p["dw"]))
    return (
        pairs.select(
            F.col("id").alias("doc_id"), "rk", "item_id",
            F.struct(F.col("r.best").alias("n"), F.size("slots").alias("s"), (-changed).alias("c")).alias("x"),
        )
        .groupBy("doc_id", "rk", "item_id")
        .agg(F.max("x").alias("x"))
        .select(
            "doc_id", "rk", "item_id",
            F.col("x.n").cast("long").alias("n_words"),
            F.col("x.s").cast("long").alias("n_slots"),
            (-F.col("x.c")).cast("long").alias("n_changed"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs`, all columns, without the rows that `leaks` names."""
    bad = leaks(docs, benchmark, **how).select("doc_id", "rk").distinct()
    bad = small(bad.select(F.col("doc_id").alias("bad_id"), F.col("rk").alias("bad_rk")))
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    rows = docs.select(
        packed(docs).alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk")
    )
    return rows.join(
        bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("rk") == F.col("bad_rk")), "left_anti"
    ).select("row.*")
