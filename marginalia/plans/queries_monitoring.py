"""Registered queries: coverage, gauges, counters, histograms, limits, alerts, benchmark summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.functions import text as tx
from marginalia.operators import quality
from marginalia.plans import derive as dv
from marginalia.plans.queries_tables import judge_scores
from marginalia.plans.registry import query
from marginalia.session import work_path
from marginalia.streaming import limits, metrics

NOW = "2024-01-30 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def now():
    return F.lit(NOW).cast("timestamp")


# ---- coverage ---------------------------------------------------------------------


@query(
    "coverage_chapters",
    f"WITH {dv.DOC_ROWS} SELECT volume, chapter_num, chapter_title, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(commit_sha) AS commit_sha FROM doc_rows GROUP BY 1, 2, 3",
)
def coverage_chapters(spark, sf):
    return quality.coverage_chapters(dv.doc_rows(spark, sf))


@query(
    "coverage_sections",
    f"WITH {dv.DOC_ROWS} SELECT volume, chapter_num, section, count(*) AS chunks, min(id) AS first_id FROM doc_rows GROUP BY 1, 2, 3",
)
def coverage_sections(spark, sf):
    return quality.coverage_sections(dv.doc_rows(spark, sf))


_HITS_SQL = f"""{dv.QUERY_LOG}, {dv.DOC_ROWS}, cites AS (SELECT id AS aid, unnest([k, k + 1, k + 2]) AS cid FROM query_log WHERE started_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY),
    hits AS (SELECT volume, chapter_num, count(DISTINCT aid) AS answers, count(*) AS citations FROM cites JOIN doc_rows ON id = cid GROUP BY 1, 2)"""


def hits(spark, sf):
    return quality.coverage_hits(dv.query_log(spark, sf), dv.doc_rows(spark, sf), now(), 7)


@query("coverage_hits", f"WITH {_HITS_SQL} SELECT * FROM hits")
def coverage_hits(spark, sf):
    return hits(spark, sf)


_ROLLUP_SQL = f"""WITH {_HITS_SQL}, ch AS (SELECT volume, chapter_num, count(*) AS chunks, sum(token_count) AS tokens FROM doc_rows GROUP BY 1, 2)
    SELECT volume, chapter_num, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(coalesce(answers, 0)) AS BIGINT) AS answers, CAST(sum(coalesce(citations, 0)) AS BIGINT) AS citations
    FROM ch LEFT JOIN hits USING (volume, chapter_num) GROUP BY ROLLUP (volume, chapter_num)"""


@query("coverage_rows", _ROLLUP_SQL)
def coverage_rows(spark, sf):
    return quality.coverage_rows(dv.doc_rows(spark, sf), hits(spark, sf))


@query(
    "coverage_tree",
    f"""WITH {_HITS_SQL}, sec AS (SELECT volume, chapter_num, section, count(*) AS n, min(id) AS f FROM doc_rows GROUP BY 1, 2, 3),
    ch AS (SELECT volume, chapter_num, string_agg(section || '=' || n, ';' ORDER BY f) AS sections FROM sec GROUP BY 1, 2)
    SELECT volume, chapter_num, sections, coalesce(answers, 0) AS answers, coalesce(citations, 0) AS citations,
      (SELECT count(*) FROM doc_rows d WHERE d.volume = ch.volume) AS volume_chunks FROM ch LEFT JOIN hits USING (volume, chapter_num)""",
)
def coverage_tree(spark, sf):
    """The nested tree, flattened again for comparison."""
    t = quality.coverage_tree(dv.doc_rows(spark, sf), hits(spark, sf))
    c = t.select("volume", F.col("chunks").alias("volume_chunks"), F.explode("chapters").alias("c"))
    label = F.transform("c.sections", lambda s: F.concat(s["title"], F.lit("="), s["chunks"].cast("string")))
    return c.select(
        "volume", "c.chapter_num", F.array_join(label, ";").alias("sections"), "c.answers", "c.citations", "volume_chunks"
    )


# ---- gauges -----------------------------------------------------------------------


@query(
    "gauges_24h",
    f"""WITH {dv.QUERY_LOG}, r AS (SELECT *, value - 20 AS top1, (value - 20 + value / 2 - k) / 3 AS mean FROM (SELECT q.*, e.value FROM query_log q JOIN ev e ON e.event_id = q.id)
      WHERE started_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND error IS NULL)
    SELECT count(*) AS queries_24h, round(coalesce(avg(abstained::INT), 0), 9) AS abstention_rate_24h, round(coalesce(quantile_cont(top1, 0.5), 0), 6) AS top1_score_p50, round(coalesce(quantile_cont(mean, 0.5), 0), 6) AS retrieval_score_p50 FROM r""",
)
def gauges_24h(spark, sf):
    g = quality.gauges_24h(dv.query_log(spark, sf), now())
    return g.select(
        "queries_24h",
        F.round("abstention_rate_24h", 9).alias("abstention_rate_24h"),
        F.round("top1_score_p50", 6).alias("top1_score_p50"),
        F.round("retrieval_score_p50", 6).alias("retrieval_score_p50"),
    )


@query(
    "gauges_7d",
    f"""WITH {dv.EVENTS} SELECT round(coalesce(avg((100 - k) / 100.0), 0), 9) AS nightly_groundedness, round(coalesce(avg(k / 100.0), 0), 9) AS nightly_faithfulness,
      CAST(coalesce(sum((k > 50)::INT), 0) AS BIGINT) AS judge_flagged_7d, count(*) AS judged_answers_7d, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_judge_run
    FROM ev WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY""",
)
def gauges_7d(spark, sf):
    g = quality.gauges_7d(judge_scores(spark, sf), now())
    r = lambda c: F.round(c, 9).alias(c)
    return g.select(
        r("nightly_groundedness"), r("nightly_faithfulness"), "judge_flagged_7d", "judged_answers_7d", "last_judge_run"
    )


# ---- counters and histograms ------------------------------------------------------


@query(
    "counter_totals",
    f"WITH {dv.EVENTS} SELECT event_type, user_id % 5 AS profile, CAST(sum(k) AS BIGINT) AS total FROM ev GROUP BY 1, 2",
)
def counter_totals(spark, sf):
    e = dv.events(spark, sf).withColumn("profile", F.col("user_id") % 5)
    return metrics.counter_totals(e, ["event_type", "profile"], F.col("k"))


_LE = ", ".join(f"({e}::DOUBLE)" for e in fv.LATENCY_EDGES)
_HIST_SQL = f"""{dv.EVENTS}, les AS (SELECT * FROM (VALUES {_LE}, (1e9::DOUBLE)) t(le)),
    h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, le, count(*) FILTER (value <= le) AS c FROM ev CROSS JOIN les GROUP BY 1, 2, 3)"""


def _hist(spark, sf):
    return metrics.latency_histogram(dv.events(spark, sf), "value", ["event_type"], window="1 day")


@query("latency_histogram", f"WITH {_HIST_SQL} SELECT window_start, event_type, le, c AS bucket_count FROM h")
def latency_histogram(spark, sf):
    rows = metrics.bucket_rows(_hist(spark, sf))
    le = F.when(F.col("le") == float("inf"), F.lit(1e9)).otherwise(F.col("le"))
    return rows.select("window_start", "event_type", le.alias("le"), "bucket_count")


@query(
    "histogram_quantile",
    f"""WITH {_HIST_SQL}, x AS (SELECT *, lag(le, 1, 0) OVER w AS lo, lag(c, 1, 0) OVER w AS pc, max(c) OVER (PARTITION BY window_start, event_type) AS n FROM h WINDOW w AS (PARTITION BY window_start, event_type ORDER BY le)),
    q AS (SELECT *, p FROM x CROSS JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) t(p)),
    f AS (SELECT *, row_number() OVER (PARTITION BY window_start, event_type, p ORDER BY le) AS rn FROM q WHERE c >= p * n AND n > 0)
    SELECT window_start, event_type, round(max(CASE WHEN p = 0.5 THEN v END), 9) AS p50, round(max(CASE WHEN p = 0.99 THEN v END), 9) AS p99 FROM
      (SELECT *, CASE WHEN le = 1e9 THEN 60 ELSE lo + (le - lo) * (p * n - pc) / (c - pc) END AS v FROM f WHERE rn = 1) GROUP BY 1, 2""",
)
def histogram_quantile(spark, sf):
    q = lambda p, n: F.round(metrics.histogram_quantile(F.col("buckets"), p), 9).alias(n)
    return _hist(spark, sf).select("window_start", "event_type", q(0.5, "p50"), q(0.99, "p99"))


def _sliding_sql(window_s: int, slide_s: int, labels: str = "event_type") -> str:
    lab = f", {labels}" if labels else ""
    return f"""{dv.EVENTS}, w AS (SELECT *, unnest(range(CAST(floor(epoch(ts) / {slide_s}) AS BIGINT) + 1, CAST(floor(epoch(ts) / {slide_s}) AS BIGINT) + 1 + {window_s // slide_s})) AS e FROM ev),
    s AS (SELECT make_timestamp(e * {slide_s} * 1000000) AS window_end{lab}, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM w GROUP BY ALL)"""


@query("windowed_rate", f"WITH {_sliding_sql(120, 30)} SELECT window_end, event_type, n, n / 120.0::DOUBLE AS rate FROM s")
def windowed_rate(spark, sf):
    return metrics.windowed_rate(dv.events(spark, sf), ["event_type"], 120, 30)


@query("increase_24h", f"WITH {_sliding_sql(86400, 3600)} SELECT window_end, event_type, n FROM s")
def increase_24h(spark, sf):
    return metrics.increase_24h(dv.events(spark, sf), ["event_type"])


@query(
    "error_ratio",
    f"WITH {_sliding_sql(3600, 300, '')} SELECT window_end, n, bad, round(bad::DOUBLE / n, 9) AS ratio FROM s",
)
def error_ratio(spark, sf):
    r = metrics.error_ratio(dv.events(spark, sf), F.col("event_type") == "error", 3600, 300)
    return r.withColumn("ratio", F.round("ratio", 9))


_SCORE_CASE = " ".join(f"WHEN value <= {e} THEN {e}" for e in fv.SCORE_EDGES)


@query(
    "score_heatmap",
    f"WITH {dv.EVENTS} SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, CAST(CASE {_SCORE_CASE} ELSE 1e9 END AS DOUBLE) AS le, count(*) AS n FROM ev GROUP BY 1, 2",
)
def score_heatmap(spark, sf):
    h = metrics.score_heatmap(dv.events(spark, sf), "value")
    return h.withColumn("le", F.when(F.col("le") == float("inf"), F.lit(1e9)).otherwise(F.col("le")))


@query(
    "inflight",
    f"""WITH {dv.QUERY_LOG}, d AS (SELECT started_at AS ts, 1 AS d FROM query_log UNION ALL SELECT finished_at, -1 FROM query_log), a AS (SELECT ts, sum(d) AS d FROM d GROUP BY 1)
    SELECT ts, CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS open_requests FROM a""",
)
def inflight(spark, sf):
    return metrics.inflight(dv.query_log(spark, sf))


# ---- alerts -----------------------------------------------------------------------

_SERIES_SQL = f"""{dv.EVENTS}, g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, count(*)::DOUBLE AS n, max(value) / 3 AS p99, (count(*) FILTER (event_type = 'error'))::DOUBLE / count(*) AS err, avg(k) / 60 AS ground,
      min(value) - 1 AS score, max(k) / 99.0::DOUBLE AS mem FROM ev GROUP BY 1)"""


def gauge_series(spark, sf):
    """Hourly gauges of the event stream under the names that the rules use."""
    w = F.window("ts", "1 hour")
    g = dv.events(spark, sf).groupBy(w.alias("w")).agg(
        F.count("*").cast("double").alias("queries_24h"),
        F.count("*").cast("double").alias("judged_answers_7d"),
        (F.max("value") / 3).alias("e2e_p99_seconds"),
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_ratio"),
        (F.avg("k") / 60).alias("nightly_groundedness"),
        (F.min("value") - 1).alias("retrieval_score_p50"),
        (F.max("k") / 99.0).alias("memory_ratio"),
    )
    names = [c for c in g.columns if c != "w"]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    return g.select(F.col("w.end").alias("ts"), F.inline(rows))


@query(
    "alert_rules",
    f"""WITH {_SERIES_SQL}, c AS (
      SELECT ts, 'GroundednessBelowThreshold' AS alert, 600 AS hold, ground < 0.8 AND n > 0 AS active FROM g UNION ALL
      SELECT ts, 'RetrievalScoreDrift', 1800, score < 0 AND n > 20 FROM g UNION ALL
      SELECT ts, 'P99LatencyAboveSLO', 300, p99 > 30 FROM g UNION ALL
      SELECT ts, 'GatewayErrorRate', 300, err > 0.05 FROM g UNION ALL
      SELECT ts, 'GPUMemoryNearCeiling', 300, mem > 0.97 FROM g),
    i AS (SELECT *, sum((NOT active)::INT) OVER (PARTITION BY alert ORDER BY ts) AS island FROM c),
    s AS (SELECT *, CASE WHEN active THEN min(ts) FILTER (active) OVER (PARTITION BY alert, island) END AS since FROM i)
    SELECT ts, alert, since, CASE WHEN NOT active THEN 'inactive' WHEN epoch(ts) - epoch(since) >= hold THEN 'firing' ELSE 'pending' END AS state FROM s""",
)
def alert_rules(spark, sf):
    return metrics.alert_rules(metrics.rule_conditions(gauge_series(spark, sf))).select("ts", "alert", "since", "state")


# ---- limits -----------------------------------------------------------------------


@query("key_hash", f"SELECT DISTINCT user_id, {dv.hash_sql(chr(39) + 'salt:' + chr(39) + ' || user_id')} AS key_hash FROM events")
def key_hash(spark, sf):
    u = dv.t(spark, sf, "events").select("user_id").distinct()
    return u.select("user_id", tx.key_hash(F.col("user_id").cast("string"), "salt").alias("key_hash"))


_DAY_EXCL = "INTERVAL '23:59:59.999999'"


@query(
    "attempts_24h",
    f"WITH {dv.EVENTS} SELECT DISTINCT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {_DAY_EXCL} PRECEDING AND CURRENT ROW) AS attempts FROM ev",
)
def attempts_24h(spark, sf):
    return limits.attempts_24h(dv.events(spark, sf), "user_id").select("user_id", "ts", F.col("attempts").cast("long").alias("attempts"))


@query(
    "spend_24h",
    f"""WITH {dv.EVENTS}, a AS (SELECT ts, sum(value) AS v FROM ev GROUP BY 1), s AS (SELECT ts, v, sum(v) OVER (ORDER BY ts RANGE BETWEEN {_DAY_EXCL} PRECEDING AND CURRENT ROW) AS t FROM a)
    SELECT ts, round(t, 3) AS spent_24h, round(t - v, 6) >= 6500 AS over_budget FROM s""",
)
def spend_24h(spark, sf):
    return limits.spend_24h(dv.events(spark, sf), 6500.0, cost="value").withColumn("spent_24h", F.round("spent_24h", 3))


_LIMIT_SQL = f"""WITH RECURSIVE {dv.EVENTS}, o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ev),
    f AS (SELECT user_id, r, event_id, [ts] AS held, true AS admitted FROM o WHERE r = 1
      UNION ALL SELECT o.user_id, o.r, o.event_id,
        CASE WHEN len(list_filter(held, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2 THEN list_append(list_filter(held, lambda x: x > o.ts - INTERVAL 24 HOUR), o.ts) ELSE list_filter(held, lambda x: x > o.ts - INTERVAL 24 HOUR) END,
        len(list_filter(held, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2
      FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
    SELECT event_id AS id, admitted FROM f"""


@query("rate_limit", _LIMIT_SQL)
def rate_limit(spark, sf):
    return limits.rate_limit(dv.events(spark, sf), 2, key="user_id", id="event_id")


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = dv.t(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(stream, spark, name, mode="append"):
    """Run a stream over what is there, into a written table, and read that."""
    path, check = work_path(spark, name), work_path(spark, name + "-check")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
    else:
        def keep(df, batch):
            df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path if mode == "append" else f"{path}/*")


@query("rate_limit_stream", _LIMIT_SQL)
def rate_limit_stream(spark, sf):
    """The stateful stream gives the verdicts of the batch form."""
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = limits.rate_limit_stream(event_stream(spark, sf), 2, key="user_id", id="event_id")
        return _drain(out, spark, "limit").select("id", "admitted")
    finally:
        if provider is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


@query(
    "reserve_settle",
    f"""WITH {dv.EVENTS}, done AS (SELECT event_id AS rid, ts + INTERVAL 1 SECOND AS done_at, value AS cost FROM ev WHERE k % 3 = 0
      UNION ALL SELECT r.event_id, l.done_at, l.cost FROM (SELECT user_id, ts + INTERVAL 2 SECOND AS done_at, value / 2 AS cost FROM ev WHERE k % 3 = 1) l ASOF JOIN ev r ON r.user_id = l.user_id AND r.ts <= l.done_at)
    SELECT e.event_id::VARCHAR AS request_id, round(coalesce(c, 0), 6) AS cost_usd FROM ev e LEFT JOIN (SELECT rid, arg_max(cost, done_at) AS c FROM done GROUP BY 1) x ON x.rid = e.event_id""",
)
def reserve_settle(spark, sf):
    """A third of the requests settle by id, a third by key alone, a third stay open."""
    e = dv.events(spark, sf).withColumn("request_id", F.col("event_id").cast("string")).withColumnRenamed("user_id", "key")
    m = F.col("k") % 3
    second = F.expr("INTERVAL '1' SECOND")
    done = e.filter(m < 2).select(
        F.when(m == 0, F.col("request_id")).alias("request_id"),
        "key",
        F.when(m == 0, F.col("ts") + second).otherwise(F.col("ts") + second + second).alias("ts"),
        F.when(m == 0, F.col("value")).otherwise(F.col("value") / 2).alias("cost_usd"),
    )
    out = limits.reserve_settle(e.select("request_id", "key", "ts"), done)
    return out.select("request_id", F.round("cost_usd", 6).alias("cost_usd"))


@query("gauge_refresh", f"WITH {dv.EVENTS} SELECT event_type, count(*) AS n, count(*) FILTER (k > 50) AS flagged FROM ev GROUP BY 1")
def gauge_refresh(spark, sf):
    """Gauges computed per micro-batch of the event stream and added up."""
    path, check = work_path(spark, "gauges"), work_path(spark, "gauges-check")

    def compute(df, batch):
        k = F.get_json_object("props", "$.k").cast("int")
        df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k > 50).alias("flagged")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    metrics.gauge_refresh(event_stream(spark, sf), compute, check, available_now=True).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))


# ---- benchmark summaries ----------------------------------------------------------


def samples(spark, sf):
    """Events as load-test samples."""
    k = F.col("k")
    ok = k % 7 != 0
    return dv.events(spark, sf).select(
        "event_id",
        F.col("event_type").alias("target"),
        (F.col("user_id") % 5).cast("int").alias("concurrency"),
        ok.alias("ok"),
        (F.col("value") / 2).alias("ttft_ms"),
        F.col("value").alias("total_ms"),
        k.cast("long").alias("output_tokens"),
        F.when(~ok, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
        F.create_map(F.lit("embed"), F.col("value") / 10, F.lit("generate"), F.col("value") / 4).alias("stage_ms"),
        (k > 80).alias("rerank_fallback"),
    )


SAMPLES_SQL = f"""{dv.EVENTS}, sm AS (SELECT event_id, event_type AS target, CAST(user_id % 5 AS INT) AS concurrency, k % 7 <> 0 AS ok, value / 2 AS ttft_ms, value AS total_ms, k, k > 80 AS fb, 'e' || event_id AS error FROM ev)"""


def _pct(col: str) -> str:
    return ", ".join(
        f"round(coalesce(max({col}) FILTER (r_{col} = round_even({p / 100}::DOUBLE * (n_ok - 1)::DOUBLE, 0)), 0), 1) AS {col[:-3]}_p{p}"
        for p in (50, 90, 99)
    )


@query(
    "bench_summary",
    f"""WITH {SAMPLES_SQL}, wall AS (SELECT target, concurrency, 10.0::DOUBLE + concurrency AS wall_s FROM sm GROUP BY 1, 2),
    b AS (SELECT target, concurrency, count(*) AS requests, count(*) FILTER (NOT ok) AS errors, sum(CASE WHEN ok THEN k ELSE 0 END) AS toks, count(*) FILTER (ok AND fb) AS rerank_fallbacks FROM sm GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, concurrency ORDER BY ttft_ms) - 1 AS r_ttft_ms, row_number() OVER (PARTITION BY target, concurrency ORDER BY total_ms) - 1 AS r_total_ms,
      count(*) OVER (PARTITION BY target, concurrency) AS n_ok FROM sm WHERE ok),
    p AS (SELECT target, concurrency, {_pct('ttft_ms')}, {_pct('total_ms')} FROM r GROUP BY 1, 2)
    SELECT b.target, b.concurrency, requests, errors, round(wall_s, 2) AS wall_s, round((requests - errors) / wall_s, 3) AS requests_per_s, round(toks / wall_s, 1) AS output_tokens_per_s,
      ttft_p50, ttft_p90, ttft_p99, total_p50, total_p90, total_p99, rerank_fallbacks FROM b JOIN wall w ON w.target = b.target AND w.concurrency = b.concurrency JOIN p ON p.target = b.target AND p.concurrency = b.concurrency""",
)
def bench_summary(spark, sf):
    s = samples(spark, sf)
    wall = s.groupBy("target", "concurrency").agg((F.lit(10.0) + F.max("concurrency")).alias("wall_s"))
    return quality.bench_summary(s, wall)


@query(
    "stage_p50",
    f"""WITH {SAMPLES_SQL}, st AS (SELECT target, concurrency, 'embed' AS stage, total_ms / 10 AS ms FROM sm WHERE ok UNION ALL SELECT target, concurrency, 'generate', total_ms / 4 FROM sm WHERE ok),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, concurrency, stage ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY target, concurrency, stage) AS n FROM st)
    SELECT target, concurrency, stage, round(ms, 1) AS p50_ms FROM r WHERE r = round_even(0.5::DOUBLE * (n - 1)::DOUBLE, 0)""",
)
def stage_p50(spark, sf):
    return quality.stage_p50(samples(spark, sf))


@query(
    "error_samples",
    f"WITH {SAMPLES_SQL} SELECT target, concurrency, CAST(n AS INT) AS n, error FROM (SELECT *, row_number() OVER (PARTITION BY target, concurrency ORDER BY event_id) AS n FROM sm WHERE NOT ok) WHERE n <= 5",
)
def error_samples(spark, sf):
    return quality.error_samples(samples(spark, sf), "event_id")


def _runs(spark, sf):
    m = F.col("user_id") % 3
    e = dv.events(spark, sf).withColumn("concurrency", F.when(m == 0, 1).when(m == 1, 8).otherwise(4))
    return e.groupBy(F.col("event_type").alias("name"), "concurrency").agg(
        F.sum("k").cast("double").alias("output_tokens_per_s"), F.min("value").alias("ttft_p50"), F.max("value").alias("total_p50")
    )


@query(
    "cells_pivot",
    f"""WITH {dv.EVENTS} SELECT event_type AS name, (sum(k) FILTER (user_id % 3 = 1))::DOUBLE AS model_output_tokens_per_s_c8, min(value) FILTER (user_id % 3 = 0) AS model_ttft_p50_c1,
      min(value) FILTER (user_id % 3 = 0) + 1 AS e2e_ttft_p50_c1, max(value) FILTER (user_id % 3 = 1) + 1 AS e2e_total_p50_c8 FROM ev GROUP BY 1""",
)
def cells_pivot(spark, sf):
    runs = _runs(spark, sf)
    e2e = runs.withColumn("ttft_p50", F.col("ttft_p50") + 1).withColumn("total_p50", F.col("total_p50") + 1)
    return quality.cells_pivot(runs, e2e)


@query("peak_usage", f"WITH {dv.EVENTS} SELECT 'u' || (user_id % 5) AS cell, max(value) AS peak_mib FROM ev GROUP BY 1")
def peak_usage(spark, sf):
    e = dv.events(spark, sf).select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("cell"), F.col("value").alias("used_mib")
    )
    return quality.peak_usage(e)


@query(
    "sweep_delta",
    f"""WITH {dv.EVENTS}, v AS (SELECT event_type AS variant, CAST(user_id % 5 AS INT) AS concurrency, sum(k)::DOUBLE AS tokens, max(value) AS peak FROM ev GROUP BY 1, 2)
    SELECT v.variant, v.concurrency, round((v.tokens / b.tokens - 1) * 100, 6) AS tokens_delta_pct, round((v.peak / b.peak - 1) * 100, 6) AS peak_delta_pct FROM v JOIN v b ON b.concurrency = v.concurrency AND b.variant = 'view'""",
)
def sweep_delta(spark, sf):
    v = dv.events(spark, sf).groupBy(
        F.col("event_type").alias("variant"), (F.col("user_id") % 5).cast("int").alias("concurrency")
    ).agg(F.sum("k").cast("double").alias("tokens"), F.max("value").alias("peak"))
    out = quality.sweep_delta(v, ["tokens", "peak"], "view")
    return out.select("variant", "concurrency", *[F.round(c, 6).alias(c) for c in ("tokens_delta_pct", "peak_delta_pct")])
