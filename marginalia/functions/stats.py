"""Exact order statistics, guarded ratios and top-k helpers that hold for groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

#: Accuracy of the sketch that says where to look first, ranges that a range is cut into, and values that are ordered at once.
SKETCH = 10_000
BINS = 1_024
ORDERED = 65_536


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def select_ranks(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, float, Callable[[Column], Column]]],
    ordered: int = ORDERED,
) -> DataFrame:
    """Exact values at given 0-based positions of the sorted values of several columns, for groups of any size.

    ``wanted`` maps an output name to (value column, fraction, position as a function of the count n); the fraction only
    says where to look first. Per group a row of the outputs and of ``_n_<column>``, the counts; nulls do not count.

    A mergeable sketch guesses a narrow range for each position. Counts of the values in ranges below, inside and above the
    guess then prove which range encloses it; that one is cut again, until it holds one value or at most ``ordered`` rows,
    which are sorted. A wrong guess costs a further pass, never a result. All columns and positions share each pass: one
    for the sketch, one for the counts, one for the sorted rest; two for groups of at most ``ordered`` rows.
    """
    values = list(dict.fromkeys(v for v, _, _ in wanted.values()))
    kinds = {df.schema[v].dataType.simpleString() for v in values}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    # a constant that is computed: one row of ranges is then found by a hash join, not by a nested loop
    one = F.pmod(F.xxhash64(F.col(values[0])), F.lit(1)).alias("_k")
    by = keys or ["_k"]
    cols = F.array(*[F.struct(F.lit(v).alias("_value"), F.col(v).cast(kind).alias("_v")) for v in values])
    long = df.select(*keys, *([] if keys else [one]), F.inline(cols)).filter(F.col("_v").isNotNull())

    eps = 3.0 / SKETCH
    outs = list(wanted)
    edges = [e for _, f, _ in wanted.values() for e in (max(0.0, f - eps), min(1.0, f + eps))]
    first = long.groupBy(*by, "_value").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", edges, SKETCH).alias("_e")
    )
    states = F.array(
        *[
            F.struct(
                F.lit(o).alias("_out"), F.lit(v).alias("_of"), pos(F.col("_n")).cast("long").alias("_idx"),
                F.col("_e")[2 * i].alias("_glo"), F.col("_e")[2 * i + 1].alias("_ghi"),
            )
            for i, (o, (v, _, pos)) in enumerate(wanted.items())
        ]
    )
    state = first.select(*by, "_value", "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), F.inline(states))
    state = cut_lineage(state.filter("_of = _value").drop("_of"), "ranges")
    open_ = (F.col("_lo") < F.col("_hi")) & (F.col("_in") > ordered)

    def meet(s: DataFrame) -> DataFrame:
        """Values inside the ranges of their group, with the range's columns."""
        s = s.select(*[F.col(c).alias(f"_r{c}" if c in (*by, "_value") else c) for c in s.columns])
        cond = F.col("_v").between(F.col("_lo"), F.col("_hi")) & (F.col("_value") == F.col("_r_value"))
        for k in by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r{k}"))
        return long.join(s, cond)

    while not state.filter(open_).isEmpty():
        # both ends are ranges of their own, so infinite ones do not hide what lies between; halves do not overflow
        half = lambda c: F.col(c).cast("double") / 2
        share = F.nanvl((half("_v") - half("_glo")) / (half("_ghi") - half("_glo")), F.lit(0.0)) * (BINS - 2)
        bin_ = (
            F.when(F.col("_v") < F.col("_glo"), -1)
            .when(F.col("_v") > F.col("_ghi"), BINS)
            .when(F.col("_v") == F.col("_glo"), 0)
            .when(F.col("_v") == F.col("_ghi"), BINS - 1)
            .otherwise(F.least(F.lit(BINS - 2), F.floor(share).cast("int") + 1))
        )
        at = [*by, "_value", "_out"]
        counts = meet(state.filter(open_)).withColumn("_bin", bin_).groupBy(*at, "_bin").agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            *[F.first(c).alias(c) for c in ("_n", "_idx", "_below")],
        )
        # at most BINS + 2 rows a position
        upto = F.sum("_c").over(W.partitionBy(*at).orderBy("_bin")) + F.col("_below")
        next_ = counts.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_idx")) & (F.col("_upto") - F.col("_c") <= F.col("_idx")))
        next_ = next_.select(
            *by, "_value", "_n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_in"),
            "_out", "_idx", F.col("_lo").alias("_glo"), F.col("_hi").alias("_ghi"),
        )
        state = cut_lineage(state.filter(~open_).unionByName(next_), "ranges")

    done = state.filter(F.col("_lo") >= F.col("_hi")).select(*by, "_value", "_n", "_out", F.col("_lo").alias("_x"))
    rest = meet(state.filter(F.col("_lo") < F.col("_hi"))).groupBy(*by, "_value", "_n", "_out", "_idx", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_out").orderBy("_v")) + F.col("_below")
    rest = rest.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_idx")) & (F.col("_upto") - F.col("_c") <= F.col("_idx")))
    found = done.unionByName(rest.select(*by, "_value", "_n", "_out", F.col("_v").alias("_x")))
    picked = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_out") == o, F.col("_x"))).alias(o) for o in outs],
        *[F.coalesce(F.max(F.when(F.col("_value") == v, F.col("_n"))), F.lit(0)).alias(f"_n_{v}") for v in values],
    )
    return picked if keys else picked.drop("_k")


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, tuple[float, Callable[[Column], Column]]],
    count: str | None = None,
    ordered: int = ORDERED,
) -> DataFrame:
    """``select_ranks`` of one column: ``wanted`` maps an output name to (fraction, position); ``count`` names n."""
    out = select_ranks(df, keys, {o: (value, f, pos) for o, (f, pos) in wanted.items()}, ordered)
    n = f"_n_{value}"
    return out.withColumnRenamed(n, count) if count else out.drop(n)


def nearest_rank(p: float) -> tuple[float, Callable[[Column], Column]]:
    """Position of percentile p (0-100): round half to even of p/100 * (n-1)."""
    f = p / 100.0
    return f, lambda n: F.bround(F.lit(f) * (n - 1).cast("double"), 0)


def percentile_cont(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear-interpolated percentiles; ``columns`` maps an output name to (value column, fraction). All in the same passes."""
    pos = lambda n, f: F.lit(f) * (n - 1).cast("double")
    wanted = {}
    for name, (value, f) in columns.items():
        wanted[f"_a_{name}"] = (value, f, lambda n, f=f: F.floor(pos(n, f)))
        wanted[f"_b_{name}"] = (value, f, lambda n, f=f: F.ceil(pos(n, f)))
    st = select_ranks(df, keys, wanted)

    def between(name: str, value: str, f: float) -> Column:
        at = pos(F.col(f"_n_{value}"), f)
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        return (a + (b - a) * (at - F.floor(at))).alias(name)

    out = st.select(*keys, *[between(name, v, f) for name, (v, f) in columns.items()])
    # without keys one row, null where there are no values
    return out if keys else out.agg(*[F.max(name).alias(name) for name in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: str, rank: str = "rank", salts: int = 32) -> DataFrame:
    """The first k rows of each group with their rank.

    A group is first cut into ``salts`` parts by a hash of ``spread`` and each part keeps k rows, so a
    group that holds a third of the table is ranked by many tasks; the second step sees at most
    salts * k rows per group. Spark adds a map-side group limit to both. With one salt there is no first step, for
    groups that are known to be small.
    """
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    if salts == 1:
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        .withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= k)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= k)
    )


#: Lengths in seconds of the steps of a running total: within the last, only whole ones meet in one task.
STEPS = (60, 86_400)


def running_total(df: DataFrame, keys: list[str], ts: str, value: Column, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Per distinct (keys, ts): ``amount`` there, and ``total`` of everything up to and including it.

    A hierarchy of time: rows of one instant are summed first, then instants within a minute, minutes within a day, and
    days. So neither a hot key nor the whole table is one window group; what meets in one task is a row a day.
    """
    # instants at time-stamp precision; unix_micros works on both time-stamp types once cast
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    level = df.groupBy(*keys, F.col(ts).alias("ts")).agg(F.sum(value).alias("amount"))
    level = level.select("*", *[F.floor(micros / (s * 1_000_000)).alias(f"_s{s}") for s in steps])

    def total(rows: DataFrame, order: str, amount: str, left: tuple[int, ...]) -> DataFrame:
        """``rows`` with ``total``: running sums in ``order`` within the finest step, on top of the steps before it."""
        if not left:
            w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
            return rows.withColumn("total", F.sum(amount).over(w))
        step = f"_s{left[0]}"
        coarse = [f"_s{s}" for s in left[1:]]
        sums = rows.groupBy(*keys, step, *coarse).agg(F.sum(amount).alias("_sum"))
        before = total(sums, step, "_sum", left[1:]).select(
            *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(step).alias("_r_step"), (F.col("total") - F.col("_sum")).alias("_before")
        )
        cond = F.col(step) == F.col("_r_step")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        inner = W.partitionBy(*keys, step).orderBy(order)
        rows = rows.withColumn("_in", F.sum(amount).over(inner)).join(before, cond)
        return rows.withColumn("total", F.col("_in") + F.col("_before")).drop("_in", "_before", "_r_step", *[f"_r_{k}" for k in keys])

    return total(level, "ts", "amount", steps).drop(*[f"_s{s}" for s in steps])


def trailing_sum(
    events: DataFrame, keys: list[str], ts: str, value: Column, horizon_us: int, out: str, parts: int = 1
) -> DataFrame:
    """Per distinct (keys, ts): ``amount`` there and the sum of ``value`` over (ts - horizon, ts].

    Time is cut into blocks of horizon / ``parts``. An instant counts in its own block, and leaves again, moved by a whole
    horizon, in the block that many later; the sums of the blocks between stand at the start of each. One running sum per
    (key, block) over these rows is the trailing sum. Instants are summed once; what is copied is an instant twice and a
    block's sum ``parts`` times. More parts cut keys that are dense (or a table without keys) finer.
    """
    width = horizon_us // parts
    base = events.select(*keys, F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), value.alias("_val"))
    instants = base.groupBy(*keys, "ts", "_us").agg(F.sum("_val").alias("amount"))
    block = F.floor(F.col("_us") / width)
    none = F.lit(None).cast(instants.schema["ts"].dataType)
    moved = F.array(
        F.struct(block.alias("block"), F.col("_us").alias("at"), F.col("ts").alias("ts"), F.col("amount").alias("change")),
        F.struct((block + parts).alias("block"), (F.col("_us") + width * parts).alias("at"), none.alias("ts"), (-F.col("amount")).alias("change")),
    )
    rows = instants.select(*keys, "amount", F.inline(moved))
    sums = instants.groupBy(*keys, block.alias("_b")).agg(F.sum("amount").alias("change"))
    sums = sums.select(*keys, "change", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + parts)).alias("block"))
    sums = sums.select("*", F.lit(None).cast("long").alias("at"), none.alias("ts"))
    both = rows.unionByName(sums, allowMissingColumns=True)
    # rows at the start of a block have no time and come first; rows of one time count together
    w = W.partitionBy(*keys, "block").orderBy(F.col("at").asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(out, F.sum("change").over(w)).filter("ts is not null").select(*keys, "ts", "amount", out)


def number_rows(df: DataFrame, keys: list[str], order: str, out: str, width: int = 65_536) -> DataFrame:
    """Consecutive numbers from 1 per group in ``order`` (a unique integer), without one window per group.

    Rows are numbered inside ranges of ``width`` order values; the counts of earlier ranges are added.
    """
    df = df.withColumn("_range", F.floor(F.col(order) / width))
    inner = W.partitionBy(*keys, "_range").orderBy(order)
    outer = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = (
        df.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_c"))
        .select(*keys, "_range", F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn("_in", F.row_number().over(inner))
        .join(before, [*keys, "_range"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_range", "_in", "_before")
    )
