"""Registered queries: stream forms run over what is there and compared with SQL, and the latency alert in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fixed_values as fv
from marginalia.plans import derive as dv
from marginalia.plans import queries_monitoring as qm
from marginalia.plans.registry import query
from marginalia.session import work_path
from marginalia.streaming import limits, metrics


def stream_of(df: DataFrame, name: str, files: int = 1) -> DataFrame:
    """The rows of a table as a stream of files, a file a micro-batch."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream to its end; its rows with the number of the micro-batch that wrote them."""
    spark = stream.sparkSession
    path = work_path(spark, name)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", work_path(spark, name + "-check"))
    run.trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{fields}, batch int").parquet(path)


def with_rocksdb(spark: SparkSession, run):
    """`run()` while the session keeps stream state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, qm.ROCKSDB)
    try:
        return run()
    finally:
        if before is not None:
            spark.conf.set(key, before)


@query(
    "counter_totals_stream",
    f"WITH {dv.EVENTS} SELECT event_type, user_id % 5 AS profile, CAST(sum(k) AS BIGINT) AS total FROM ev GROUP BY 1, 2",
)
def counter_totals_stream(spark, sf):
    """Counters kept as state over several micro-batches; the last value of each label set."""
    e = dv.events(spark, sf).select("event_type", (F.col("user_id") % 5).alias("profile"), F.col("k").cast("long").alias("k"))
    totals = metrics.counter_totals(stream_of(e, "counted", 4), ["event_type", "profile"], F.col("k"))
    rows = drain(totals, "counters", "update")
    return rows.groupBy("event_type", "profile").agg(F.max_by("total", "batch").alias("total"))


@query(
    "inflight_stream",
    f"WITH {dv.EVENTS} SELECT event_type, CAST(count(*) - count(*) FILTER (k % 3 < 2) AS BIGINT) AS open_requests FROM ev GROUP BY 1",
)
def inflight_stream(spark, sf):
    """Open requests by label as state; two thirds of the requests have ended, some of them in an earlier micro-batch than
    they began."""
    e = dv.events(spark, sf)
    begun = e.select("event_type", F.lit(1).alias("d"))
    ended = e.where(F.col("k") % 3 < 2).select("event_type", F.lit(-1).alias("d"))
    open_ = metrics.inflight_now(stream_of(begun.unionByName(ended), "deltas", 4), ["event_type"])
    rows = drain(open_, "inflight", "update")
    return rows.groupBy("event_type").agg(F.max_by("open_requests", "batch").alias("open_requests"))


@query(
    "reserve_settle_stream",
    f"WITH {dv.EVENTS} SELECT event_id::VARCHAR AS request_id, round(CASE WHEN k % 3 = 0 THEN value ELSE 0 END, 6) AS cost_usd FROM ev",
)
def reserve_settle_stream(spark, sf):
    """Reservations joined with their completions, stream by stream; a row far ahead on both sides moves the watermark, so
    that reservations left open come out."""
    e = dv.events(spark, sf).withColumn("request_id", F.col("event_id").cast("string"))
    ahead = e.agg((F.max("ts") + F.expr("INTERVAL '10' DAY")).alias("ts"))
    mark = F.lit("ahead")  # not null: null ids would be filtered out before the watermark sees their time
    asked = e.select("request_id", F.col("user_id").cast("string").alias("key"), "ts")
    asked = asked.unionByName(ahead.select(mark.alias("request_id"), mark.alias("key"), "ts"))
    done = e.where(F.col("k") % 3 == 0).select("request_id", (F.col("ts") + F.expr("INTERVAL '1' SECOND")).alias("ts"), F.col("value").alias("cost_usd"))
    done = done.unionByName(ahead.select(mark.alias("request_id"), "ts", F.lit(0.0).alias("cost_usd")))
    out = limits.reserve_settle_stream(stream_of(asked, "reservations"), stream_of(done, "completions"))
    rows = drain(out, "settled", "append").where("request_id <> 'ahead'")
    return rows.select("request_id", F.round("cost_usd", 6).alias("cost_usd"))


_STATES = """c AS (
      SELECT ts, 'GroundednessBelowThreshold' AS alert, 600 AS hold, ground < 0.8 AND n > 0 AS active FROM g UNION ALL
      SELECT ts, 'RetrievalScoreDrift', 1800, score < 0 AND n > 20 FROM g UNION ALL
      SELECT ts, 'P99LatencyAboveSLO', 300, p99 > 30 FROM g UNION ALL
      SELECT ts, 'GatewayErrorRate', 300, err > 0.05 FROM g UNION ALL
      SELECT ts, 'GPUMemoryNearCeiling', 300, mem > 0.97 FROM g)"""
_HELD = """i AS (SELECT *, sum((NOT active)::INT) OVER (PARTITION BY alert ORDER BY ts) AS island FROM c),
    s AS (SELECT *, CASE WHEN active THEN min(ts) FILTER (active) OVER (PARTITION BY alert, island) END AS since FROM i)"""
_STATE = "CASE WHEN NOT active THEN 'inactive' WHEN epoch(ts) - epoch(since) >= hold THEN 'firing' ELSE 'pending' END AS state"


@query("alert_states_stream", f"WITH {qm._SERIES_SQL}, {_STATES}, {_HELD} SELECT ts, alert, {_STATE} FROM s")
def alert_states_stream(spark, sf):
    """The states of the rules with what holds kept as stream state."""
    conditions = metrics.rule_conditions(qm.gauge_series(spark, sf)).select("alert", "hold_s", "ts", "active")

    def run() -> DataFrame:
        return drain(limits.alert_states_stream(stream_of(conditions, "conditions")), "alerts", "append")

    return with_rocksdb(spark, run).select("ts", "alert", "state")


_LE = ", ".join(f"({e}::DOUBLE)" for e in fv.LATENCY_EDGES)


@query(
    "latency_alert",
    f"""WITH {dv.EVENTS}, les AS (SELECT * FROM (VALUES {_LE}, (1e9::DOUBLE)) t(le)),
    w AS (SELECT value / 3 AS v, unnest(range(CAST(floor(epoch(ts) / 30) AS BIGINT) + 1, CAST(floor(epoch(ts) / 30) AS BIGINT) + 11)) AS e FROM ev),
    h AS (SELECT e, le, count(*) FILTER (v <= le) AS c FROM w CROSS JOIN les GROUP BY 1, 2),
    x AS (SELECT *, lag(le, 1, 0) OVER o AS lo, lag(c, 1, 0) OVER o AS pc, max(c) OVER (PARTITION BY e) AS n FROM h WINDOW o AS (PARTITION BY e ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY le) AS rn FROM x WHERE c >= 0.99::DOUBLE * n AND n > 0),
    q AS (SELECT make_timestamp(e * 30000000) AS ts, CASE WHEN le = 1e9 THEN 60 ELSE lo + (le - lo) * (0.99::DOUBLE * n - pc) / (c - pc) END AS p99 FROM f WHERE rn = 1),
    c AS (SELECT ts, p99, 'P99LatencyAboveSLO' AS alert, 300 AS hold, p99 > 30 AS active FROM q), {_HELD}
    SELECT ts, alert, round(p99, 9) AS value, since, {_STATE} FROM s""",
)
def latency_alert(spark, sf):
    """Bucket panes of 30 seconds, their sums over five minutes, the quantile, the rule and how long it has held: one plan."""
    e = dv.events(spark, sf).withColumn("seconds", F.col("value") / 3)
    states = metrics.latency_alerts(e, "seconds")
    return states.select("ts", "alert", F.round("value", 9).alias("value"), "since", "state")
