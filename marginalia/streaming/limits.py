"""Rate limits, spend caps and reservations."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from marginalia.functions.stats import trailing_sum

DAY_US = 86_400_000_000


def attempts_24h(requests: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, ts, attempts): requests of the key in (ts - 24 h, ts], whether admitted or not."""
    return trailing_sum(requests, [key], ts, F.lit(1), DAY_US, "attempts")


def spend_24h(costs: DataFrame, budget: float, ts: str = "ts", cost: str = "cost_usd") -> DataFrame:
    """(ts, spent_24h, over_budget): spend of everyone in (ts - 24 h, ts]; a request at ts is refused
    when what was spent before it has reached the budget."""
    # money is summed exactly: the difference of two long totals must not drift
    t = trailing_sum(costs, [], ts, F.col(cost).cast("decimal(18,9)"), DAY_US, "spent_24h", parts=96)
    before = F.round((F.col("spent_24h") - F.col("amount")).cast("double"), 6)
    spent = F.round(F.col("spent_24h").cast("double"), 6)
    return t.select("ts", spent.alias("spent_24h"), (before >= budget).alias("over_budget"))


def _admit(times: np.ndarray, admitted: deque, limit: int, horizon: int) -> np.ndarray:
    """Verdicts for one key's requests in time order; ``admitted`` holds its last admitted times.

    While the limit is reached nothing changes until the oldest admission expires, so refused requests are skipped in
    one step: the loop runs once or twice per admission, whatever the number of requests.
    """
    out = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times) and limit > 0:
        while admitted and admitted[0] <= times[i] - horizon:
            admitted.popleft()
        if len(admitted) < limit:
            admitted.append(times[i])
            out[i] = True
            i += 1
        else:
            i = int(np.searchsorted(times, admitted[0] + horizon))
    return out


def rate_limit(requests: DataFrame, limit: int, key: str = "key", ts: str = "ts", id: str = "id", horizon_us: int = DAY_US) -> DataFrame:
    """(id, admitted): at most ``limit`` admitted requests per key in any trailing horizon (batch).

    Whether a request counts depends on the verdict before it, so requests are one ordered sequence up to a gap of a whole
    horizon, after which nothing that came before counts. A key is cut into sessions at such gaps (``idle_sessions``), and
    sessions are what tasks work on. Narrow rows are sorted by Spark (which spills) and streamed through Arrow batches; a
    task keeps ``limit`` time stamps of the current session, never its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()
        for pdf in batches:
            ok = np.zeros(len(pdf), dtype=bool)
            times = pdf["us"].to_numpy()
            keys, sessions = pdf["key"].to_numpy(), pdf["session"].to_numpy()
            same = (keys[1:] == keys[:-1]) & (sessions[1:] == sessions[:-1])
            edges = np.flatnonzero(np.r_[True, ~same]) if len(pdf) else []
            for a, b in zip(edges, [*edges[1:], len(pdf)], strict=True):
                if (keys[a], sessions[a]) != current:
                    current, admitted = (keys[a], sessions[a]), deque()
                ok[a:b] = _admit(times[a:b], admitted, limit, horizon_us)
            yield pd.DataFrame({"id": pdf["id"], "admitted": ok})

    narrow = requests.select(
        F.col(id).cast("long").alias("id"),
        F.col(key).alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
    )
    cut = idle_sessions(narrow, horizon_us)
    return cut.repartition("key", "session").sortWithinPartitions("key", "session", "us", "id").mapInPandas(run, "id long, admitted boolean")


def idle_sessions(rows: DataFrame, horizon_us: int) -> DataFrame:
    """(id, key, us) rows with ``session``, the block that the row's session starts in.

    A session ends where no request of the key follows for a whole horizon. Blocks of a horizon are summed up to their
    first and last time before they meet, so a key is a row a block where its gaps are looked for.
    """
    rows = rows.withColumn("block", F.floor(F.col("us") / horizon_us))
    by = W.partitionBy("key").orderBy("block")
    blocks = rows.groupBy("key", "block").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    fresh = F.col("first") - F.lag("last").over(by) >= horizon_us
    blocks = blocks.withColumn("start", F.when(F.coalesce(fresh, F.lit(True)), F.col("block")))
    blocks = blocks.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.last("start", ignorenulls=True).over(by).alias("session"))
    met = rows.join(blocks, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return met.select("id", "key", "us", "session")


class AdmittedTimes(StatefulProcessor):
    """Keeps the admitted times of one key within the horizon, at most ``limit`` of them."""

    def __init__(self, limit: int, horizon_us: int):
        self.limit, self.horizon = limit, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("admitted", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one key's rows of one micro-batch; maxFilesPerTrigger / maxOffsetsPerTrigger bound them
        pdf = pd.concat(list(rows)).sort_values(["us", "id"])
        admitted = deque(t[0] for t in self.times.get()) if self.times.exists() else deque()
        ok = _admit(pdf["us"].to_numpy(), admitted, self.limit, self.horizon)
        self.times.put([(int(t),) for t in admitted])
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "key": pdf["key"].to_numpy(), "admitted": ok})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, key: str = "key", ts: str = "ts", id: str = "id", horizon_us: int = DAY_US) -> DataFrame:
    """The same verdicts for a stream, in arrival order of micro-batches and time order within them.

    Needs the RocksDB state store provider.
    """
    schema = requests.select(key).schema
    key_type = schema[0].dataType.simpleString()
    rows = requests.select(
        F.col(id).cast("long").alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=AdmittedTimes(limit, horizon_us),
        outputStructType=f"id long, key {key_type}, admitted boolean",
        outputMode="Append",
        timeMode="None",
    )


class HeldSince(StatefulProcessor):
    """Remembers since when the condition of one alert has held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("us")
        since = self.since.get()[0] if self.since.exists() else None
        out = []
        for us, active, hold in zip(pdf["us"], pdf["active"], pdf["hold_s"], strict=True):
            since = (us if since is None else since) if active else None
            state = "inactive" if since is None else "firing" if us - since >= hold * 1_000_000 else "pending"
            out.append((key[0], us, state))
        if since is None:
            self.since.clear()
        else:
            self.since.update((int(since),))
        yield pd.DataFrame(out, columns=["alert", "us", "state"])

    def close(self) -> None:
        pass


def alert_states_stream(conditions: DataFrame) -> DataFrame:
    """Alert states of a stream of rule conditions (alert, hold_s, ts, active)."""
    rows = conditions.select("alert", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "active", "hold_s")
    return rows.groupBy("alert").transformWithStateInPandas(
        statefulProcessor=HeldSince(),
        outputStructType="alert string, us long, state string",
        outputMode="Append",
        timeMode="None",
    ).select("alert", F.timestamp_micros("us").alias("ts"), "state")


def latest_before(left: DataFrame, right: DataFrame, key: str, payload: str, bucket_seconds: int = 3_600) -> DataFrame:
    """For each left row (key, ts, ...) the ``payload`` of the last right row (key, ts, payload) at or before it.

    Both sides are ordered within (key, time bucket); what earlier buckets leave behind is carried in by
    a window over one row per bucket. So a hot key is spread over its buckets.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rest = [c for c in left.columns if c not in (key, "ts")]
    r = right.select(key, "ts", F.struct("ts", payload).alias("_r"), F.lit(None).cast(left.select(F.struct(*rest)).schema[0].dataType).alias("_l"))
    lft = left.select(key, "ts", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*rest).alias("_l"))
    both = r.unionByName(lft).withColumn("bucket", F.floor(us / (bucket_seconds * 1_000_000)))
    inner = W.partitionBy(key, "bucket").orderBy("ts", F.col("_l").isNotNull(), F.col(f"_r.{payload}"))
    outer = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        both.groupBy(key, "bucket")
        .agg(F.max("_r").alias("_m"))
        .withColumn("_carry", F.last("_m", ignorenulls=True).over(outer))
        .select(key, "bucket", "_carry")
    )
    return (
        both.withColumn("_in", F.last("_r", ignorenulls=True).over(inner))
        .filter("_l is not null")
        .join(carried, [key, "bucket"])
        .select(key, "ts", "_l.*", F.coalesce("_in", "_carry")[payload].alias(payload))
    )


def reserve_settle(reservations: DataFrame, completions: DataFrame) -> DataFrame:
    """Reservations (request_id, key, ts) with the cost of their completion, 0 while open (batch).

    A completion (request_id or null, key, ts, cost_usd) settles the reservation it names, else the
    latest reservation of its key; of several completions the last one counts.
    """
    named = completions.filter("request_id is not null").select("request_id", "ts", "cost_usd")
    loose = completions.filter("request_id is null").select("key", "ts", "cost_usd")
    found = latest_before(loose, reservations.select("key", "ts", "request_id"), "key", "request_id")
    settled = (
        named.unionByName(found.filter("request_id is not null").select("request_id", "ts", "cost_usd"))
        .groupBy("request_id")
        .agg(F.max_by("cost_usd", "ts").alias("cost_usd"))
    )
    return reservations.join(settled, "request_id", "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))


def reserve_settle_stream(reservations: DataFrame, completions: DataFrame, wait: str = "24 hours", watermark: str = "10 minutes") -> DataFrame:
    """Stream form: a reservation is joined with its completion on the request id for up to ``wait``; one
    that stays open comes out with cost 0 once the watermark has passed."""
    r = reservations.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).alias("r")
    c = (
        completions.select(F.col("request_id").alias("done_id"), F.col("ts").cast("timestamp").alias("done_at"), "cost_usd")
        .withWatermark("done_at", watermark)
        .alias("c")
    )
    cond = (
        (F.col("request_id") == F.col("done_id"))
        & (F.col("done_at") >= F.col("ts"))
        & (F.col("done_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    )
    return r.join(c, cond, "left_outer").select(
        "request_id", "key", "ts", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")
    )


