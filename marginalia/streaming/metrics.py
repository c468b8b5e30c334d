"""Counters, histograms, rates and alerts. Unless noted, a function takes a batch table or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions.stats import running_total

WATERMARK = "10 minutes"


def timed(events: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Event time as TIMESTAMP with a watermark (a watermark cannot be set on TIMESTAMP_NTZ)."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, watermark) if events.isStreaming else out


def counter_totals(events: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """Running totals by label set; in a stream use update or complete mode."""
    total = F.count("*") if amount is None else F.sum(amount)
    return events.groupBy(*labels).agg(total.alias("total"))


def bucket_counts(value: Column, edges: list[float]) -> Column:
    """Cumulative ``le`` counts as one aggregate: an array of (le, count) with a last +Inf entry."""
    return F.array(
        *[F.struct(F.lit(float(e)).alias("le"), F.count_if(value <= e).alias("count")) for e in edges],
        F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("count")),
    )


def latency_histogram(
    events: DataFrame,
    value: str,
    labels: list[str],
    edges: list[float] = fv.LATENCY_EDGES,
    ts: str = "ts",
    window: str = "5 minutes",
) -> DataFrame:
    """(window_start, labels, buckets, sum, count) per tumbling window; one row per group, combined map-side."""
    v = F.col(value)
    return (
        timed(events, ts)
        .groupBy(F.window(ts, window).alias("w"), *labels)
        .agg(bucket_counts(v, edges).alias("buckets"), F.sum(v).alias("sum"), F.count(v).alias("count"))
        .select(F.col("w.start").alias("window_start"), *labels, "buckets", "sum", "count")
    )


def bucket_rows(hist: DataFrame) -> DataFrame:
    """A histogram's buckets as rows (le, bucket_count)."""
    rest = [c for c in hist.columns if c != "buckets"]
    return hist.select(*rest, F.explode("buckets").alias("b")).select(
        *rest, F.col("b.le").alias("le"), F.col("b.count").alias("bucket_count")
    )


def histogram_quantile(buckets: Column, q: float) -> Column:
    """Quantile by linear interpolation inside cumulative buckets; the highest finite edge if it lies
    beyond; null without observations. The first bucket starts at 0 when its edge is positive."""
    total = F.element_at(buckets, F.lit(-1))["count"]
    want = total * F.lit(q)
    pos = F.array_position(F.transform(buckets, lambda b: b["count"] >= want), F.lit(True)).cast("int")
    here, before = F.get(buckets, pos - 1), F.get(buckets, pos - 2)
    low = F.when(pos == 1, F.least(here["le"], F.lit(0.0))).otherwise(before["le"])
    prev = F.coalesce(before["count"], F.lit(0))
    inside = F.when(
        here["count"] > prev, low + (here["le"] - low) * (want - prev) / (here["count"] - prev)
    ).otherwise(here["le"])
    top = F.get(buckets, F.size(buckets) - 2)["le"]
    return (
        F.when(total == 0, F.lit(None).cast("double"))
        .when(pos == F.size(buckets), top)
        .when((pos == 1) & (here["le"] <= 0), here["le"])
        .otherwise(inside)
    )


def sliding(events: DataFrame, labels: list[str], aggs: dict[str, Column], merge: dict[str, Column], window_s: int, slide_s: int, ts: str = "ts") -> DataFrame:
    """Aggregates over sliding windows (window_end, labels, ...), windows aligned to the epoch.

    In batch the rows are summed once into panes of the slide's length and only the panes are copied
    to the windows that hold them, so the fan-out does not multiply the data. In a stream the built-in
    sliding window keeps the state.
    """
    ev = timed(events, ts)
    if events.isStreaming:
        w = F.window(ts, f"{window_s} seconds", f"{slide_s} seconds").alias("w")
        return ev.groupBy(w, *labels).agg(*[c.alias(n) for n, c in aggs.items()]).select(
            F.col("w.end").alias("window_end"), *labels, *aggs
        )
    pane = F.floor(F.unix_timestamp(ts) / slide_s)
    panes = ev.groupBy(pane.alias("pane"), *labels).agg(*[c.alias(n) for n, c in aggs.items()])
    ends = F.sequence(F.col("pane") + 1, F.col("pane") + window_s // slide_s)
    return (
        panes.withColumn("end", F.explode(ends))
        .groupBy("end", *labels)
        .agg(*[c.alias(n) for n, c in merge.items()])
        .select(F.timestamp_seconds(F.col("end") * slide_s).alias("window_end"), *labels, *aggs)
    )


def sliding_histogram(
    events: DataFrame, value: str, labels: list[str], edges: list[float] = fv.LATENCY_EDGES, window_s: int = 300, slide_s: int = 30, ts: str = "ts"
) -> DataFrame:
    """(window_end, labels, buckets): cumulative ``le`` counts over sliding windows, added up from the counts of panes."""
    v = F.col(value)
    aggs = {f"_le{i}": F.count_if(v <= e) for i, e in enumerate(edges)} | {"_all": F.count(v)}
    rows = sliding(events, labels, aggs, {c: F.sum(c) for c in aggs}, window_s, slide_s, ts)
    ends = [F.struct(F.lit(float(e)).alias("le"), F.col(c).alias("count")) for e, c in zip([*edges, float("inf")], aggs, strict=True)]
    return rows.select("window_end", *labels, F.array(*ends).alias("buckets"))


def _counts(events: DataFrame, labels: list[str], window_s: int, slide_s: int, ts: str, **conds: Column) -> DataFrame:
    aggs = {"n": F.count("*")} | {k: F.count_if(c) for k, c in conds.items()}
    merge = {k: F.sum(k) for k in aggs}
    return sliding(events, labels, aggs, merge, window_s, slide_s, ts)


def windowed_rate(events: DataFrame, labels: list[str], window_s: int = 120, slide_s: int = 30, ts: str = "ts") -> DataFrame:
    """Events per second over sliding windows."""
    return _counts(events, labels, window_s, slide_s, ts).withColumn("rate", F.col("n") / F.lit(float(window_s)))


def increase_24h(events: DataFrame, labels: list[str], ts: str = "ts") -> DataFrame:
    """Count over 24 hours, every hour."""
    return _counts(events, labels, 86_400, 3_600, ts)


def error_ratio(events: DataFrame, bad: Column, window_s: int = 300, slide_s: int = 60, ts: str = "ts") -> DataFrame:
    """Share of rows for which ``bad`` holds, per sliding window (errors, abstentions)."""
    return _counts(events, [], window_s, slide_s, ts, bad=bad).withColumn("ratio", F.col("bad") / F.col("n"))


def score_heatmap(events: DataFrame, score: str, edges: list[float] = fv.SCORE_EDGES, window: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """(window_start, le, n): scores per bucket (not cumulative) and window."""
    bucket = F.lit(float("inf"))
    for e in reversed(edges):
        bucket = F.when(F.col(score) <= e, F.lit(float(e))).otherwise(bucket)
    return (
        timed(events, ts)
        .withColumn("le", bucket)
        .groupBy(F.window(ts, window).alias("w"), "le")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "le", "n")
    )


def inflight(requests: DataFrame, start: str = "started_at", end: str = "finished_at") -> DataFrame:
    """(ts, open_requests) at every instant a request starts or ends (batch).

    +1 / -1 are summed per instant, then totalled over buckets of time and within them.
    """
    deltas = requests.select(
        F.inline(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("d")),
                F.struct(F.col(end).alias("ts"), F.lit(-1).alias("d")),
            )
        )
    ).filter("ts is not null")
    return running_total(deltas, [], "ts", F.col("d")).select("ts", F.col("total").alias("open_requests"))


def inflight_now(deltas: DataFrame, labels: list[str]) -> DataFrame:
    """Open requests by label of a stream of +1 / -1 rows, in update mode."""
    return deltas.groupBy(*labels).agg(F.sum("d").alias("open_requests"))


Rule = tuple[str, str, str, float, str | None, float | None, int]


def rule_conditions(series: DataFrame, rules: list[Rule] = fv.ALERT_RULES) -> DataFrame:
    """(ts, name, value) gauge rows to (alert, hold_s, ts, value, active): each rule at each evaluation time.

    Rules are few; all series of one time stamp are brought into one row by a single aggregation.
    """
    names = sorted({r[1] for r in rules} | {r[4] for r in rules if r[4]})
    wide = series.groupBy("ts").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    each = []
    for alert, name, op, limit, guard, floor, hold in rules:
        hit = F.col(name) < limit if op == "<" else F.col(name) > limit
        if guard is not None:
            hit = hit & (F.col(guard) > floor)
        each.append(
            F.struct(
                F.lit(alert).alias("alert"),
                F.lit(hold).alias("hold_s"),
                F.col(name).alias("value"),
                F.coalesce(hit, F.lit(False)).alias("active"),
            )
        )
    return wide.select("ts", F.inline(F.array(*each)))


def alert_rules(conditions: DataFrame) -> DataFrame:
    """Add ``since`` and ``state`` (inactive, pending, firing) to rule conditions (batch).

    A window group is one rule on its evaluation grid: one row per evaluation, not per event.
    """
    w = W.partitionBy("alert").orderBy("ts")
    begins = F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))
    held = F.unix_timestamp("ts") - F.unix_timestamp("since")
    return (
        conditions.withColumn("_b", begins)
        .withColumn("since", F.when(F.col("active"), F.last(F.when(F.col("_b"), F.col("ts")), ignorenulls=True).over(w)))
        .withColumn(
            "state",
            F.when(~F.col("active"), "inactive").when(held >= F.col("hold_s"), "firing").otherwise("pending"),
        )
        .drop("_b")
    )


def latency_alerts(
    events: DataFrame, value: str, q: float = 0.99, name: str = "e2e_p99_seconds", rules: list[Rule] = fv.ALERT_RULES, window_s: int = 300, slide_s: int = 30
) -> DataFrame:
    """States of the rules on a latency quantile, from events (ts, value in seconds): panes, sliding histograms, quantile,
    rule and hold, in one plan. Windows without events are not evaluated."""
    hist = sliding_histogram(events, value, [], window_s=window_s, slide_s=slide_s)
    series = hist.select(F.col("window_end").alias("ts"), F.lit(name).alias("name"), histogram_quantile(F.col("buckets"), q).alias("value"))
    return alert_rules(rule_conditions(series.where("value is not null"), [r for r in rules if r[1] == name]))


def gauge_refresh(
    stream: DataFrame,
    compute: Callable[[DataFrame, int], None],
    checkpoint: str,
    seconds: int = 30,
    available_now: bool = False,
):
    """Recompute gauges from each micro-batch at most every ``seconds`` (or once over what is there);
    returns the running query. ``compute`` must be idempotent per batch id."""
    w = stream.writeStream.foreachBatch(compute).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()
