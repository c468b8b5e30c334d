"""Marked-up documents to typed blocks, as one job over a table of lines.

A document is one input row, so everything that belongs to one document (its lines, its open
scopes) is bounded by one Spark row. A fold over the row's line array finds where fences,
scopes, equations and footnotes start and end; the fold stores something only where the state
changes, so its cost is linear in the lines. Lines and those marks are then exploded and all
further steps are windows and one aggregation over ``source_file``: one shuffle in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx

MARK = "struct<line_no:int,what:string,mode:string,dropped:boolean,was_dropped:boolean,in_figure:boolean>"
SCOPE = "struct<dropped:boolean,figure:boolean>"

#: The classes of lines that can make a block of a kind; a scope line holds a figure's caption or a callout's title.
LINES_OF = {
    "heading": ["heading"],
    "table": ["table"],
    "equation": ["equation"],
    "figure": ["image", "scope"],
    "code": ["code"],
    "list": ["text", "typeset"],
    "para": ["text", "typeset", "foot", "scope"],
}


def mask_comments(text: Column) -> Column:
    """Blank out comments with equal length so that offsets keep pointing into the source."""
    blank = lambda found, i: F.coalesce(F.repeat(F.lit(" "), F.length(F.get(found, i))), F.lit(""))
    masked = tx.let(
        F.regexp_extract_all(text, F.lit(fv.P_COMMENT), F.lit(0)),
        lambda found: F.array_join(
            F.transform(F.split(text, fv.P_COMMENT), lambda p, i: F.concat(p, blank(found, i))), ""
        ),
    )
    return F.when(text.contains("<!--"), masked).otherwise(text)


def body_start(text: Column) -> Column:
    """Offset behind a leading ``---`` header, 0 without one."""
    header = F.regexp_extract(F.substr(text, F.lit(4)), r"(?dms)\A(.*?^---\s*$)", 1)
    return F.when(text.startswith("---") & (header != ""), F.length(header) + 3).otherwise(F.lit(0))


def strip_front_matter(docs: DataFrame) -> DataFrame:
    return docs.withColumn("body_start", body_start(F.col("text"))).withColumn(
        "masked", mask_comments(F.col("text"))
    )


def running_sums(sizes: Column) -> Column:
    """The sum of an array of ints before each of its elements.

    A fold that appends copies its result at each step. Folding blocks of about the square root of the elements keeps
    that at n * sqrt(n), and the totals before the blocks are a fold of as many steps.
    """

    def before(xs: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def cut(xs: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))), F.lit(1)).cast("int")
        count = lambda n: F.ceil(F.size(xs) / n).cast("int")
        return tx.let(
            block, lambda n: F.transform(F.sequence(F.lit(0), count(n) - 1), lambda b: F.slice(xs, b * n + 1, n))
        )

    def join(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x))
        both = F.arrays_zip(parts.alias("p"), before(totals, F.lit(0)).alias("t"))
        return F.flatten(F.transform(both, lambda x: before(x["p"], x["t"])))

    return tx.let(sizes, lambda xs: tx.let(cut(xs), join))


def explode_lines(docs: DataFrame) -> DataFrame:
    """(source_file, text) to one row per line with its character span, line ends included.

    Offsets are summed inside the row, so no text leaves its task; a null text is one row without a span.
    """
    lines = F.split("text", "\n")
    starts = running_sums(F.transform(lines, lambda x: F.length(x) + 1))
    placed = F.arrays_zip(lines.alias("line"), starts.alias("char_start"))
    return (
        docs.select("source_file", F.length("text").alias("n"), F.posexplode_outer(placed).alias("line_no", "x"))
        .select("source_file", "line_no", "x.line", "x.char_start", "n")
        .withColumn("char_end", F.least(F.col("char_start") + F.length("line") + 1, "n"))
        .drop("n")
    )


def scope_attrs(stripped: Column) -> Column:
    g2 = F.regexp_extract(stripped, fv.P_SCOPE, 2)
    return F.when(g2.startswith("{"), F.regexp_extract(stripped, fv.P_SCOPE, 3)).otherwise(g2)


def _line_facts(line: Column, s: Column, drop_classes: list[str], drop_attrs: list[str]) -> Column:
    attrs = scope_attrs(s)
    parsed = tx.parse_attrs(attrs)

    def opened(p: Column) -> Column:
        dropped = F.arrays_overlap(p["classes"], F.array(*map(F.lit, drop_classes)))
        for a in drop_attrs:
            dropped = dropped | attrs.contains(a)
        return F.struct(
            dropped.alias("dropped"), F.coalesce(p["ident"].startswith("fig-"), F.lit(False)).alias("figure")
        )

    colons = s.startswith(":::") & s.rlike(fv.P_SCOPE)
    plain = F.struct(F.lit(False).alias("dropped"), F.lit(False).alias("figure"))
    return F.struct(
        s.alias("s"),
        F.when(s.startswith("```") | s.startswith("~~~"), F.regexp_extract(s, fv.P_FENCE, 1)).otherwise("").alias("fence"),
        F.when(colons, F.when(F.regexp_extract(s, fv.P_SCOPE, 2) != "", "open").otherwise("close"))
        .otherwise("")
        .alias("scope"),
        F.when(colons, tx.let(parsed, opened)).otherwise(plain).alias("frame"),
        F.when(s.startswith("$$"), F.when(s.rlike(fv.P_EQ_ONE_LINE), "one").otherwise("open")).otherwise("").alias("eq"),
        (line.startswith("[^") & line.rlike(fv.P_FOOTNOTE_DEF)).alias("foot"),
        ((s != "") & line.startswith("    ")).alias("indented"),
    )


def _first_line(masked: Column, skip_to: Column) -> Column:
    """The number of lines that start before ``skip_to``."""
    ends = F.regexp_count(F.substr(masked, F.lit(1), skip_to - 1), F.lit("\n"))
    return F.when(skip_to > 0, ends + 1).otherwise(F.lit(0))


def _marks(masked: Column, skip_to: Column, drop_classes: list[str], drop_attrs: list[str]) -> Column:
    """Where the state of the reader changes, as an array of marks (see MARK).

    The fold meets only lines that can change the state: those that open or close something and, in a text with footnotes,
    all others too, as any line may end one. The marks lie beside the small state: what `let` hands on is copied.
    """
    of_text = F.struct(_first_line(masked, skip_to).alias("skip_lines"), masked.contains("[^").alias("has_notes"))

    def may_change(s: Column, has_notes: Column) -> Column:
        return s.startswith(":::") | s.startswith("```") | s.startswith("$$") | s.startswith("~~~") | has_notes

    def facts(has_notes: Column) -> Column:
        lines = F.transform(
            F.split(masked, "\n"),
            lambda ln, i: F.struct(i.alias("i"), ln.alias("line"), tx.strip(ln).alias("s")),
        )
        return F.transform(
            F.filter(lines, lambda x: may_change(x["s"], has_notes)),
            lambda x: F.struct(x["i"].alias("i"), _line_facts(x["line"], x["s"], drop_classes, drop_attrs).alias("f")),
        )

    state = F.struct(
        F.lit("text").alias("mode"),
        F.lit("").alias("fence"),
        F.array().cast(f"array<{SCOPE}>").alias("scopes"),
        F.lit(None).cast(MARK).alias("mark"),
    )
    start = F.struct(state.alias("state"), F.array().cast(f"array<{MARK}>").alias("marks"))

    def happens(a: Column, i: Column, f: Column, was: Column, skip_lines: Column) -> Column:
        foot_ends = (a["mode"] == "foot") & ~f["indented"]
        free = (i >= skip_lines) & ((a["mode"] == "text") | foot_ends)
        here = (
            F.when(f["fence"] != "", "fence_open")
            .when(f["scope"] == "open", "scope_open")
            .when(f["scope"] == "close", "scope_close")
            .when(was, "")
            .when(f["eq"] == "one", "eq_one")
            .when(f["eq"] == "open", "eq_open")
            .when(f["foot"], "foot_open")
            .otherwise("")
        )
        return (
            F.when((a["mode"] == "fence") & f["s"].startswith(a["fence"]), "fence_close")
            .when((a["mode"] == "eq") & f["s"].startswith("$$"), "eq_close")
            .when(free & (here != ""), here)
            .when(foot_ends, "foot_end")
            .otherwise("")
        )

    def go_on(a: Column) -> Column:
        return F.struct(
            a["mode"].alias("mode"),
            a["fence"].alias("fence"),
            a["scopes"].alias("scopes"),
            F.lit(None).cast(MARK).alias("mark"),
        )

    def change(a: Column, i: Column, f: Column, what: Column, was: Column) -> Column:
        n = F.size(a["scopes"])
        scopes = (
            F.when(what == "scope_open", F.concat(a["scopes"], F.array(f["frame"])))
            .when(what == "scope_close", F.slice(a["scopes"], F.lit(1), F.greatest(n - 1, F.lit(0))))
            .otherwise(a["scopes"])
        )
        mode = (
            F.when(what == "fence_open", "fence").when(what == "eq_open", "eq").when(what == "foot_open", "foot").otherwise("text")
        )

        def build(sc: Column) -> Column:
            mark = F.struct(
                i.alias("line_no"),
                what.alias("what"),
                mode.alias("mode"),
                F.exists(sc, lambda d: d["dropped"]).alias("dropped"),
                was.alias("was_dropped"),
                F.exists(sc, lambda d: d["figure"]).alias("in_figure"),
            )
            return F.struct(
                mode.alias("mode"),
                F.when(what == "fence_open", f["fence"]).otherwise(a["fence"]).alias("fence"),
                sc.alias("scopes"),
                mark.alias("mark"),
            )

        return tx.let(scopes, build)

    def next_state(a: Column, i: Column, f: Column, skip_lines: Column) -> Column:
        return tx.let(
            F.exists(a["scopes"], lambda d: d["dropped"]),
            lambda was: tx.let(
                happens(a, i, f, was, skip_lines),
                lambda what: F.when(what == "", go_on(a)).otherwise(change(a, i, f, what, was)),
            ),
        )

    def noted(a: Column) -> Column:
        """The marks with that of the line before."""
        mark = a["state"]["mark"]
        return F.when(mark.isNull(), a["marks"]).otherwise(F.concat(a["marks"], F.array(mark)))

    def fold(t: Column) -> Column:
        return F.aggregate(
            facts(t["has_notes"]),
            start,
            lambda a, x: F.struct(
                next_state(a["state"], x["i"], x["f"], t["skip_lines"]).alias("state"), noted(a).alias("marks")
            ),
            noted,
        )

    return tx.let(of_text, fold)


def tagged_lines(
    docs: DataFrame,
    drop_classes: list[str] = fv.DROP_SCOPE_CLASSES,
    drop_attrs: list[str] = fv.DROP_SCOPE_ATTRS,
) -> DataFrame:
    """Every line with its span, its class and whether a dropped scope hides it."""
    w = W.partitionBy("source_file").orderBy("line_no", "is_line")
    text, masked = F.col("text"), F.col("masked")
    line_rows = F.transform(
        F.split(masked, "\n"),
        lambda ln, i: F.struct(i.alias("line_no"), ln.alias("line"), F.lit(None).cast(MARK).alias("mark")),
    )
    mark_rows = F.transform(
        F.col("marks"),
        lambda m: F.struct(m["line_no"].alias("line_no"), F.lit(None).cast("string").alias("line"), m.alias("mark")),
    )
    rows = (
        docs.select(
            "source_file",
            mask_comments(text).alias("masked"),
            F.length(text).alias("n"),
            body_start(text).alias("skip_to"),
        )
        .withColumn("marks", _marks(masked, F.col("skip_to"), drop_classes, drop_attrs))
        .select(
            "source_file",
            "n",
            "skip_to",
            F.inline_outer(F.concat(line_rows, mark_rows)),
        )
        .withColumn("is_line", F.col("line").isNotNull().cast("int"))
    )
    state = F.last("mark", ignorenulls=True).over(w)
    end = F.sum(F.coalesce(F.length("line") + 1, F.lit(0))).over(w).cast("int")
    tagged = (
        rows.withColumn("state", state)
        .withColumn("end", end)
        .filter("is_line = 1")
        .withColumn("char_start", F.col("end") - F.length("line") - 1)
        .withColumn("char_end", F.least("end", "n"))
        .withColumn("s", tx.strip(F.col("line")))
        .withColumn("at", F.when(F.col("state.line_no") == F.col("line_no"), F.col("state.what")))
        .withColumn("mode", F.coalesce(F.col("state.mode"), F.lit("text")))
        .withColumn("hidden", F.coalesce(F.col("state.dropped"), F.lit(False)))
    )
    free = (F.col("mode") == "text") & (F.coalesce(F.col("at"), F.lit("foot_end")) == "foot_end")
    cls = (
        F.when(F.col("char_start") < F.col("skip_to"), "skipped")
        .when(F.col("at").startswith("fence") | (F.col("mode") == "fence"), "code")
        .when(F.col("at").startswith("scope"), "scope")
        .when(F.col("at").startswith("eq") | (F.col("mode") == "eq"), "equation")
        .when(F.col("mode") == "foot", "foot")
        .when(F.col("hidden"), "hidden")
        .when(free & F.col("line").rlike(fv.P_HEADING), "heading")
        .when(free & F.col("line").rlike(fv.P_TABLE_LINE), "table")
        .when(free & F.col("s").startswith("!["), "image")
        .when(free & F.col("line").rlike(fv.P_TYPESET), "typeset")
        .when(F.col("s") == "", "blank")
        .otherwise("text")
    )
    order = W.partitionBy("source_file").orderBy("line_no")
    before = F.last(F.when(F.col("s") != "", F.col("cls")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, -1)
    )
    caption = (F.col("cls") == "text") & (before == "table") & F.col("line").rlike(fv.P_TABLE_CAPTION)
    return (
        tagged.withColumn("cls", cls)
        .withColumn("cls", F.when(caption, "caption").otherwise(F.col("cls")))
        .select("source_file", "line_no", "line", "s", "char_start", "char_end", "cls", "at", "hidden", "state")
    )


def fence_islands(docs: DataFrame, **options) -> DataFrame:
    """Lines inside fences with the number of their fence; ``kept`` tells display code from dropped cells."""
    b = _with_code(_grouped(tagged_lines(docs, **options)))
    return (
        b.filter("cls = 'code'")
        .select("source_file", "char_start", "char_end", "kept", F.explode("lines").alias("l"))
        .select("source_file", "char_start", "char_end", "l.line_no", "l.line", "kept")
    )


def scope_visibility(docs: DataFrame, **options) -> DataFrame:
    """Per line: is it inside a dropped scope?"""
    return tagged_lines(docs, **options).select(
        "source_file", "line_no", "line", ((F.col("cls") == "hidden") | F.col("hidden")).alias("dropped")
    )


def _grouped(lines: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Runs of lines that form one block, with their lines in order; only of the given classes of lines, if any are."""
    order = W.partitionBy("source_file").orderBy("line_no")
    cls, at = F.col("cls"), F.coalesce("at", F.lit(""))
    prev = F.coalesce(F.lag("cls").over(order), F.lit(""))
    textual = cls.isin("text", "typeset")
    # a hidden or skipped line ends nothing by itself: the scope line around it already did
    starts = (
        F.when(cls == "code", at == "fence_open")
        .when(cls == "equation", at.isin("eq_one", "eq_open"))
        .when(cls == "foot", at == "foot_open")
        .when(cls == "table", prev != "table")
        .when(cls == "caption", F.lit(False))
        .when(textual, ~prev.isin("text", "typeset"))
        .otherwise(True)
    )
    lines = lines.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(order))
    # a caption belongs to its table although blank lines lie between
    table_run = F.last(F.when(cls == "table", F.col("run")), ignorenulls=True).over(order)
    # lines from the first item of a run on are listed: the last item stands where the run starts or behind it
    is_item = (cls == "text") & F.col("line").rlike(fv.P_LIST_ITEM)
    run_start = F.max(F.when(F.col("starts"), F.col("line_no"))).over(order)
    last_item = F.max(F.when(is_item, F.col("line_no"))).over(order)
    lines = (
        lines.withColumn("is_caption", cls == "caption")
        .withColumn("_run", F.when(F.col("is_caption"), table_run).otherwise(F.col("run")))
        .withColumn("listed", F.when(~F.col("is_caption") & (last_item >= run_start), 1).otherwise(0))
        .withColumn("cls", F.when(F.col("is_caption"), "table").otherwise(cls))
        .withColumn("run", F.col("_run"))
    )
    shown = ~F.col("cls").isin("hidden", "skipped", "blank") if classes is None else F.col("cls").isin(*classes)
    return (
        lines.filter(shown)
        .groupBy("source_file", "run", "listed")
        .agg(
            F.max(F.when(F.col("cls") == "typeset", "a-typeset").otherwise(F.col("cls"))).alias("cls"),
            F.min(F.when(F.col("cls") != "typeset", F.col("char_start"))).alias("char_start"),
            F.max("char_end").alias("char_end"),
            F.sort_array(F.collect_list(F.struct("line_no", "line", "s", "at", "is_caption", "cls"))).alias("lines"),
            F.min_by("state", "line_no").alias("state"),
        )
        .filter("cls <> 'a-typeset'")
    )


def _with_code(groups: DataFrame, drop_langs: list[str] = fv.DROP_CODE_LANGS) -> DataFrame:
    """Add ``braced``, ``lang`` and ``kept`` of the fence that opens a group."""
    opener = F.col("lines")[0]["s"]
    g2 = F.regexp_extract(opener, fv.P_FENCE, 2)
    braced = g2.startswith("{")
    info = tx.strip(F.when(braced, F.regexp_extract(opener, fv.P_FENCE, 3)).otherwise(g2))
    is_code = F.col("cls") == "code"
    return (
        groups.withColumn("braced", F.when(is_code, braced))
        .withColumn("lang", F.when(is_code, F.lower(F.split(F.regexp_replace(info, r"^\.+", ""), r"\s+")[0])))
        .withColumn(
            "kept",
            ~(
                F.col("state.was_dropped")
                | (F.col("braced") & (F.col("lang").isin(drop_langs) | F.col("lang").startswith("=")))
            ),
        )
    )


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _inner(closing: str) -> Column:
    """Lines between the opening and the closing line of a group; the last line stays if nothing closes it."""
    n = F.size("lines")
    closed = F.col("lines")[n - 1]["at"] == closing
    return F.slice("lines", F.lit(2), n - F.when(closed, F.least(n, F.lit(2))).otherwise(F.lit(1)))


def _to_blocks(groups: DataFrame) -> DataFrame:
    """Add ``blocks``: the typed blocks of each group. The steps are columns of their own so that each
    text is taken apart and cleaned once, whatever kind it turns out to be."""
    cls, first = F.col("cls"), F.col("lines")[0]
    last = F.col("lines")[F.size("lines") - 1]
    is_list = (F.col("listed") == 1) & (cls == "text")
    caption = F.get(F.filter("lines", lambda x: x["is_caption"]), F.lit(0))["line"]
    kept = F.filter("lines", lambda x: x["cls"] != "typeset")

    # the text that may end in attributes, or the attributes themselves
    head = (
        F.when(cls == "heading", F.regexp_extract(first["line"], fv.P_HEADING, 2))
        .when(cls == "table", F.regexp_extract(caption, fv.P_TABLE_CAPTION, 1))
        .when((cls == "equation") & (first["at"] == "eq_one"), F.regexp_extract(first["s"], fv.P_EQ_ONE_LINE, 2))
        .when((cls == "equation") & (last["at"] == "eq_close"), last["s"])
    )
    attrs = (
        F.when(cls == "image", F.regexp_extract(first["s"], fv.P_IMAGE, 2))
        .when(cls == "scope", scope_attrs(first["s"]))
        .otherwise(F.regexp_extract("head", fv.P_TRAILING_ATTRS, 1))
    )
    kv = F.col("attrs.kv")
    shown = F.coalesce(_nonempty(kv["fig-cap"]), _nonempty(kv["fig-alt"]))
    prose = F.when(
        is_list, F.array_join(F.transform(kept, lambda x: F.regexp_replace(x["line"], r"\s+$", "")), "\n")
    ).otherwise(
        F.array_join(
            F.transform(
                kept,
                lambda x: F.when(x["at"] == "foot_open", F.regexp_extract(x["line"], fv.P_FOOTNOTE_DEF, 1)).otherwise(
                    x["s"]
                ),
            ),
            " ",
        )
    )
    raw = (
        F.when(cls.isin("heading", "table"), tx.strip(F.regexp_replace("head", fv.P_TRAILING_ATTRS, "")))
        .when(cls == "image", F.coalesce(_nonempty(F.regexp_extract(first["s"], fv.P_IMAGE, 1)), shown, F.lit("")))
        .when(cls == "scope", shown)
        .when(cls.isin("text", "foot"), prose)
    )
    staged = (
        groups.withColumn("head", head)
        .withColumn("attr_text", attrs)
        .withColumn("attrs", F.when(F.col("attr_text") != "", tx.parse_attrs(F.col("attr_text"))))
        .withColumn("raw", raw)
        .withColumn("clean", tx.clean_inline(F.col("raw")))
        .withColumn("title", F.when(cls == "scope", tx.clean_inline(_nonempty(kv["title"]))))
        .withColumn(
            "table_text",
            F.when(
                cls == "table",
                F.array_join(
                    F.transform(F.filter("lines", lambda x: ~x["is_caption"]), lambda x: tx.clean_inline(x["line"])), "\n"
                ),
            ),
        )
    )

    ident = F.col("attrs.ident")
    clean = F.coalesce("clean", F.lit(""))
    named = lambda what: F.when(ident.isNotNull(), F.concat(F.lit(what + " ("), ident, F.lit("): "))).otherwise(
        what + ": "
    )
    opens = (first["at"] == "scope_open") & ~F.col("state.was_dropped")
    code = F.regexp_replace(F.array_join(F.transform(_inner("fence_close"), lambda x: x["line"]), "\n"), r"\s+$", "")
    equation = F.when(first["at"] == "eq_one", tx.strip(F.regexp_extract(first["s"], fv.P_EQ_ONE_LINE, 1))).otherwise(
        tx.strip(F.array_join(F.transform(_inner("eq_close"), lambda x: x["s"]), "\n"))
    )
    text = (
        F.when(cls == "heading", clean)
        .when(
            cls == "table",
            F.when(clean != "", F.concat(named("Table"), clean, F.lit("\n"), "table_text")).otherwise(F.col("table_text")),
        )
        .when(
            cls == "equation",
            F.concat(
                F.lit("$$ "),
                equation,
                F.lit(" $$"),
                F.when(ident.isNotNull(), F.concat(F.lit(" ("), ident, F.lit(")"))).otherwise(""),
            ),
        )
        .when(cls == "image", F.when((clean != "") & ~F.col("state.in_figure"), F.concat(named("Figure"), clean)))
        .when(
            cls == "scope",
            F.when(opens & ident.startswith("fig-") & F.col("clean").isNotNull(), F.concat(named("Figure"), clean)),
        )
        .when(
            cls == "code",
            F.when(F.col("kept") & (code != ""), F.concat(F.lit("```"), "lang", F.lit("\n"), code, F.lit("\n```"))),
        )
        .otherwise(_nonempty(tx.strip(F.regexp_replace(clean, fv.P_TYPESET, ""))))
    )
    kind = (
        F.when(cls.isin("image", "scope"), "figure")
        .when(cls == "foot", "para")
        .when(cls == "text", F.when(is_list, "list").otherwise("para"))
        .otherwise(cls)
    )
    level = F.when(cls == "heading", F.length(F.regexp_extract(first["line"], fv.P_HEADING, 1))).otherwise(0)
    anchor = F.when(cls.isin("heading", "table", "equation", "image", "scope"), ident)
    callout = F.when(
        opens
        & ~F.col("state.dropped")
        & F.col("title").isNotNull()
        & F.exists("attrs.classes", lambda c: c.startswith("callout-")),
        F.concat(F.lit("**"), "title", F.lit(".**")),
    )

    def block(k: Column, x: str, lv: Column, an: Column) -> Column:
        return F.when(
            F.col(x).isNotNull(),
            F.struct(k.alias("kind"), F.col(x).alias("text"), lv.cast("int").alias("level"), an.cast("string").alias("anchor")),
        )

    return (
        staged.withColumn("text", text)
        .withColumn("callout", callout)
        .withColumn(
            "blocks",
            F.array_compact(
                F.array(block(kind, "text", level, anchor), block(F.lit("para"), "callout", F.lit(0), F.lit(None)))
            ),
        )
    )


def parse_blocks(docs: DataFrame, kinds: list[str] | None = None, **options) -> DataFrame:
    """(source_file, text) to blocks (source_file, block_no, kind, text, char_start, char_end, level, anchor).

    With ``kinds`` only lines that can make such a block are gathered and cleaned; ``block_no`` then counts those kept.
    """
    w = W.partitionBy("source_file").orderBy("char_start", "pos")
    classes = None if kinds is None else sorted({c for k in kinds for c in LINES_OF[k]})
    blocks = (
        _to_blocks(_with_code(_grouped(tagged_lines(docs, **options), classes)))
        .select("source_file", "char_start", "char_end", F.posexplode_outer("blocks").alias("pos", "b"))
        .filter("b is not null")
    )
    if kinds is not None:
        blocks = blocks.filter(F.col("b.kind").isin(*kinds))
    return (
        blocks
        .withColumn("block_no", (F.row_number().over(w) - 1).cast("int"))
        .select(
            "source_file", "block_no", "b.kind", "b.text", "char_start", "char_end", "b.level", "b.anchor"
        )
    )


def document_titles(blocks: DataFrame) -> DataFrame:
    """First non-empty level-1 heading of each document."""
    return (
        blocks.filter("kind = 'heading' and level = 1 and text <> ''")
        .groupBy("source_file")
        .agg(F.min_by("text", "block_no").alias("title"), F.min_by("anchor", "block_no").alias("anchor"))
    )


def collect_labels(blocks: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """anchor to label; the definition that is read last counts.

    Reading order is (volume, ordinal) of ``chapters`` (source_file, volume, ordinal), then the file name and block
    number; without ``chapters``, and for files that they lack (read first), only the latter.
    """
    label = F.when(F.col("kind") == "heading", F.concat(F.lit("§ "), "text")).otherwise(
        F.concat(F.initcap("kind"), F.lit(" ["), "anchor", F.lit("]"))
    )
    named = blocks.filter("anchor <> '' and kind in ('heading', 'figure', 'table', 'equation')")
    named = named.select("anchor", label.alias("label"), "source_file", "block_no")
    place = ["source_file", "block_no"]
    if chapters is not None:
        order = chapters.groupBy("source_file").agg(F.max(F.struct("volume", "ordinal")).alias("read"))
        named = named.join(order, "source_file", "left")
        place = ["read", *place]
    return named.groupBy("anchor").agg(F.max_by("label", F.struct(*place)).alias("label"))


def resolve_crossrefs(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace ``@id`` in prose, figures and tables by its label; unknown ids stay as they are.

    Only the distinct ids in use meet the label table, so a label that a third of all
    references name is looked up once; the resolved ids are then joined per reference.
    """
    keys = F.regexp_extract_all("text", F.lit(fv.P_CROSSREF), F.lit(1))
    touched = F.col("kind").isin("para", "list", "figure", "table")
    refs = blocks.filter(touched & F.col("text").contains("@")).select(
        "source_file", "block_no", F.posexplode(keys).alias("pos", "ref")
    )
    low = F.concat(F.lower(F.substring("ref", 1, 1)), F.substr("ref", F.lit(2)))
    used = refs.select("ref").distinct().withColumn("low", low)
    exact = labels.select(F.col("anchor").alias("ref"), F.col("label").alias("exact"))
    lowered = labels.select(F.col("anchor").alias("low"), F.col("label").alias("lowered"))
    known = (
        used.join(exact, "ref", "left")
        .join(lowered, "low", "left")
        .select(
            "ref",
            F.coalesce(
                F.when(F.col("exact") != "", F.col("exact")),
                F.when(F.col("lowered") != "", F.col("lowered")),
                F.concat(F.lit("@"), "ref"),
            ).alias("put"),
        )
    )
    per_block = (
        refs.join(known, "ref")
        .groupBy("source_file", "block_no")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "put"))).alias("puts"))
    )
    pieces = F.split("text", fv.P_CROSSREF)
    rebuilt = F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("puts"), i)["put"], F.lit("")))), ""
    )
    return (
        blocks.join(per_block, ["source_file", "block_no"], "left")
        .withColumn("text", F.when(F.col("puts").isNull(), F.col("text")).otherwise(rebuilt))
        .drop("puts")
    )


def substitute_values(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Put the i-th value of (source_file, ordinal, value) in place of the i-th inline placeholder.

    Placeholders inside executable cells do not count. Adds ``inline`` and ``resolved``.
    """
    either = fv.P_CELL + "|" + fv.P_PLACEHOLDER
    found = F.regexp_extract_all("text", F.lit(either), F.lit(0))
    supplied = values.groupBy("source_file").agg(
        F.map_from_entries(F.collect_list(F.struct("ordinal", "value"))).alias("supplied")
    )

    def number(tokens: Column) -> Column:
        """Each token with the ordinal of its placeholder, null for a cell."""
        slots = F.filter(F.transform(tokens, lambda t, i: F.when(~t.startswith("```"), i)), lambda i: i.isNotNull())
        return tx.let(
            slots,
            lambda s: F.transform(
                tokens,
                lambda t, i: F.struct(
                    t.alias("t"), F.when(~t.startswith("```"), F.array_position(s, i).cast("int") - 1).alias("slot")
                ),
            ),
        )

    def rendered(tokens: Column) -> Column:
        known = lambda x: F.coalesce(F.try_element_at("supplied", x["slot"]), F.lit("[value]"))
        put = F.transform(tokens, lambda x: F.when(x["slot"].isNull(), x["t"]).otherwise(known(x)))
        slots = F.filter(tokens, lambda x: x["slot"].isNotNull())
        return tx.let(
            put,
            lambda p: F.struct(
                F.array_join(
                    F.transform(F.split("text", either), lambda x, i: F.concat(x, F.coalesce(F.get(p, i), F.lit("")))), ""
                ).alias("text"),
                F.size(slots).alias("inline"),
                F.size(F.filter(slots, lambda x: F.try_element_at("supplied", x["slot"]).isNotNull())).alias("resolved"),
            ),
        )

    return (
        docs.join(supplied, "source_file", "left")
        .withColumn("supplied", F.coalesce("supplied", F.create_map().cast("map<int,string>")))
        .withColumn("_r", tx.let(found, lambda f: tx.let(number(f), rendered)))
        .withColumn("text", F.col("_r.text"))
        .withColumn("inline", F.col("_r.inline"))
        .withColumn("resolved", F.col("_r.resolved"))
        .drop("supplied", "_r")
    )
