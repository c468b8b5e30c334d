"""Limits, alerts, order statistics, remapping, evaluation; stream results equal batch results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import stats
from marginalia.operators import evaluation, judging, maintenance, quality
from marginalia.streaming import limits, metrics

T0 = dt.datetime(2024, 1, 1)


def _requests(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "a", "b"]), T0 + dt.timedelta(minutes=rng.randint(0, 5 * 1440))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, ts timestamp"), rows


def _sequential(rows, limit):
    held, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        h = [x for x in held.get(k, []) if x > t - dt.timedelta(hours=24)]
        out[i] = len(h) < limit
        held[k] = h + [t] if out[i] else h
    return out


def test_rate_limit_equals_the_sequential_rule(spark):
    df, rows = _requests(spark)
    got = {r.id: r.admitted for r in limits.rate_limit(df.repartition(6), 3).collect()}
    assert got == _sequential(rows, 3)


def test_rate_limit_stream_over_batches(spark, tmp_path):
    df, rows = _requests(spark, 60, 2)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    src = str(tmp_path / "src")
    for n, part in enumerate((ordered[:25], ordered[25:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{src}/p={n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    q = (
        limits.rate_limit_stream(stream, 3)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(out).collect()}
    assert got == _sequential(rows, 3)


def test_attempts_and_spend(spark):
    df, rows = _requests(spark)
    got = {(r.key, r.ts): r.attempts for r in limits.attempts_24h(df).collect()}
    day = dt.timedelta(hours=24)
    assert got == {(k, t): sum(1 for _, k2, t2 in rows if k2 == k and t - day < t2 <= t) for _, k, t in rows}
    spent = {r.ts: (r.spent_24h, r.over_budget) for r in limits.spend_24h(df.withColumn("cost_usd", F.lit(0.5)), 10.0).collect()}
    for t, (s, over) in spent.items():
        window = [t2 for _, _, t2 in rows if t - day < t2 <= t]
        assert s == 0.5 * len(window)
        assert over == (0.5 * sum(1 for x in window if x < t) >= 10.0)


def test_reserve_settle(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    r = spark.createDataFrame([("r1", "a", at(0)), ("r2", "a", at(300)), ("r3", "b", at(5))], "request_id string, key string, ts timestamp")
    c = spark.createDataFrame(
        [("r1", "a", at(1), 1.0), (None, "a", at(900), 2.0), (None, "b", at(1), 9.0)],
        "request_id string, key string, ts timestamp, cost_usd double",
    )
    assert {x.request_id: x.cost_usd for x in limits.reserve_settle(r, c).collect()} == {"r1": 1.0, "r2": 2.0, "r3": 0.0}


def test_windowed_rate_stream_equals_batch(spark, tmp_path):
    df, _ = _requests(spark)
    src = str(tmp_path / "src")
    df.write.parquet(src)
    batch = {(r.window_end, r.key): r.n for r in metrics.windowed_rate(df, ["key"], 7200, 3600).collect()}
    got = {}

    def keep(b, _):
        got.update({(r.window_end, r.key): r.n for r in b.collect()})

    s = metrics.windowed_rate(spark.readStream.schema(df.schema).parquet(src), ["key"], 7200, 3600)
    s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert got == batch


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(T0, v) for v in (0.02, 0.02, 0.3, 70.0)], "ts timestamp, v double")
    h = metrics.latency_histogram(df, "v", [])
    r = h.select(metrics.histogram_quantile(F.col("buckets"), 0.5), metrics.histogram_quantile(F.col("buckets"), 0.99)).first()
    assert r[0] == pytest.approx(0.025) and r[1] == 60.0


def test_alert_needs_to_hold(spark):
    rows = [(T0 + dt.timedelta(minutes=m), "error_ratio", v) for m, v in [(0, 0.1), (4, 0.1), (5, 0.1), (6, 0.0), (7, 0.2)]]
    c = metrics.rule_conditions(spark.createDataFrame(rows, "ts timestamp, name string, value double"))
    got = [r.state for r in metrics.alert_rules(c).filter("alert = 'GatewayErrorRate'").orderBy("ts").collect()]
    assert got == ["pending", "pending", "firing", "inactive", "pending"]


def test_order_statistics_with_a_hot_value(spark):
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") < n // 3, 5.0).otherwise((F.col("id") * 7919) % 100_003).alias("v"))
    got = stats.order_statistics(df, [], "v", {f"p{p}": stats.nearest_rank(p) for p in (10, 50, 90, 99)}).first()
    s = sorted(r.v for r in df.collect())
    assert [got[f"p{p}"] for p in (10, 50, 90, 99)] == [s[round(p / 100 * (n - 1))] for p in (10, 50, 90, 99)]


def test_percentiles_without_values_or_keys(spark):
    rows = [(float(i), None) for i in range(5)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = stats.percentile_cont(df, [], {"a50": ("a", 0.5), "a90": ("a", 0.9), "b50": ("b", 0.5)}).collect()
    assert [tuple(r) for r in got] == [(2.0, 3.6, None)]
    empty = evaluation.nearest_rank_percentile(df.filter("a < 0"), [], "a", [50, 99]).collect()
    assert [tuple(r) for r in empty] == [(0.0, 0.0)]
    keyed = stats.percentile_cont(df.withColumn("k", F.lit(None).cast("string")), ["k"], {"x": ("a", 0.25), "y": ("a", 1.0)})
    assert [tuple(r) for r in keyed.collect()] == [(None, 1.0, 4.0)]


def test_large_groups_use_the_band_and_no_nested_loop(spark):
    df = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"))
    want = sorted(r.v for r in df.collect())
    ps = [1, 50, 99]
    out = evaluation.nearest_rank_percentile(df, [], "v", ps)
    assert list(out.first()) == [want[round(p / 100 * 49_999)] for p in ps]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_admission_skips_what_is_refused():
    r = random.Random(5)
    for limit in (0, 1, 3):
        times = sorted(r.randrange(400) for _ in range(300))
        admitted, want = [], []
        for t in times:
            ok = sum(a > t - 50 for a in admitted) < limit
            admitted += [t] * ok
            want.append(ok)
        held = limits.deque()
        got = [x for a in range(0, 300, 70) for x in limits._admit(limits.np.array(times[a : a + 70]), held, limit, 50)]
        assert got == want


def test_span_remap(spark):
    old = spark.createDataFrame(
        [("same", "f", 0, 10), ("moved", "f", 10, 5000), ("tied", "g", 0, 10), ("lost", "h", 0, 10)],
        "content_hash string, source_file string, char_start int, char_end int",
    )
    new = spark.createDataFrame(
        [("same", "f", 0, 10), ("n1", "f", 10, 100), ("n2", "f", 100, 9000), ("t2", "g", 5, 10), ("t1", "g", 0, 5), ("x", "h", 10, 20)],
        old.schema,
    )
    m = maintenance.span_overlap_remap(old, new, old.select("content_hash"), width=64)
    assert {r.old_hash: r.new_hash for r in m.collect()} == {"same": "same", "moved": "n2", "tied": "t1", "lost": None}


def test_recall_mrr_and_agreement(spark):
    ranked = spark.createDataFrame([(1, r, h) for r, h in enumerate("abc", 1)], "query_id int, rank int, content_hash string")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "query_id int, content_hash string")
    got = {r.query_id: (r.recall_at_1, r.recall_at_3, r.mrr) for r in evaluation.recall_at_k(ranked, rel, [1, 3]).collect()}
    assert got == {1: (0.5, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}
    pairs = spark.createDataFrame([(1, 1)] * 4 + [(0, 0)] * 4 + [(1, 0), (0, 1)], "a int, b int")
    r = evaluation.judge_agreement(pairs, "a", "b").first()
    assert r.agreement == pytest.approx(0.8) and r.kappa == pytest.approx(0.6) and r.trusted
    one = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert evaluation.cohen_kappa(one, "a", "b").first().kappa == 1.0
    assert evaluation.cohen_kappa(one.limit(0), "a", "b").first().kappa == 0.0


def test_abstention(spark):
    rows = list(zip([True, True, True, False, False], [True, True, False, True, False], strict=True))
    r = evaluation.abstention_scores(spark.createDataFrame(rows, "should_abstain boolean, abstained boolean")).first()
    assert (r.precision, r.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (r.hallucination_rate, r.false_abstention_rate) == (pytest.approx(1 / 3), 0.5)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"score": 5, "pass": true, "rationale": "ok"}', (5, True, "ok")),
        ('Here: {"score": 2} thanks', (2, False, "")),
        ("no json", (1, False, "unparseable judge output")),
        ('{"score": "x"}', (1, False, "invalid judge JSON")),
        ('{"score": 4.9, "pass": false}', (4, False, "")),
    ],
)
def test_parse_verdict(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "raw string").select(judging.parse_verdict(F.col("raw")).alias("v")).first().v
    assert (r.score, r.passed, r.rationale) == want


def test_bench_summary(spark):
    s = spark.createDataFrame(
        [("t", 1, True, 100.0, 1000.0, 60, None, {"embed": 5.0}, False), ("t", 1, True, 200.0, 2000.0, 40, None, {"embed": 7.0}, True), ("t", 1, False, 0.0, 0.0, 0, "boom", {}, False)],
        "target string, concurrency int, ok boolean, ttft_ms double, total_ms double, output_tokens long, error string, stage_ms map<string,double>, rerank_fallback boolean",
    )
    wall = spark.createDataFrame([("t", 1, 2.0)], "target string, concurrency int, wall_s double")
    r = quality.bench_summary(s, wall).first()
    assert (r.requests, r.errors, r.requests_per_s, r.output_tokens_per_s, r.total_p99, r.rerank_fallbacks) == (3, 1, 1.0, 50.0, 2000.0, 1)


@pytest.mark.parametrize("ordered", [stats.ORDERED, 20])
def test_ranks_of_several_columns_by_range_selection(spark, ordered):
    """Wrong guesses, hot values, infinities, one value only, null keys and columns without values."""
    r = random.Random(3)
    rows = []
    for i in range(6000):
        g = r.choice(["a", "a", "b", None])
        rows.append((g, r.choice([7.0, r.lognormvariate(0, 3)]), r.randrange(10**12), None if g == "b" else 1.5))
    rows += [("a", float("inf"), 5, 1.5), ("a", float("-inf"), 5, 1.5), ("c", None, 1, None), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y long, z double").repartition(5)
    wanted = {f"{c}{p}": (c, hint, stats.nearest_rank(p)[1]) for c in "xyz" for p, hint in ((0, 0.9), (37, 0.37), (99, 0.01), (100, 1.0))}
    got = {t.g: t for t in stats.select_ranks(df, ["g"], wanted, ordered).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, t in got.items():
        for i, c in enumerate("xyz", 1):
            s = sorted(row[i] for row in rows if row[0] == g and row[i] is not None)
            assert t[f"_n_{c}"] == len(s)
            for p in (0, 37, 99, 100):
                assert t[f"{c}{p}"] == (s[round(p / 100 * (len(s) - 1))] if s else None)


@pytest.mark.parametrize("parts", [1, 4])
def test_trailing_sums_in_blocks(spark, parts):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", None]), r.randrange(-500, 2000), r.randrange(1, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, us long, v int").select("k", F.timestamp_micros("us").alias("t"), "v")
    for keys in (["k"], []):
        out = stats.trailing_sum(df, keys, "t", F.col("v"), 100, "s", parts)
        got = {(x["k"] if keys else 0, x.us): (x.amount, x.s) for x in out.withColumn("us", F.unix_micros("ts")).collect()}
        mine = lambda k, row: not keys or row[0] == k  # noqa: E731, B023
        for (k, t), (amount, s) in got.items():
            assert amount == sum(x[2] for x in rows if mine(k, x) and x[1] == t)
            assert s == sum(x[2] for x in rows if mine(k, x) and t - 100 < x[1] <= t)
        assert len(got) == len({(x[0] if keys else 0, x[1]) for x in rows})


def test_trailing_sums_shuffle_thrice_and_scan_once(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 5).alias("key"), F.timestamp_micros(F.col("id") * 10**9).alias("ts"), F.lit(1).alias("cost_usd")).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    for df in (limits.attempts_24h(e), limits.spend_24h(e, 5.0)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "Join" not in final
        nodes = [x for x in final.split("\n") if "Exchange " in x and "Reused" not in x]
        assert len(nodes) <= 4  # the two uses of the instants share one exchange where it is planned twice


def test_running_total_over_years(spark):
    """Instants, minutes, days: what meets in one task is a row a day."""
    rows = [(i * 7 * 3600 * 10**6 + (i % 3) * 1000, 1 if i % 2 else -1, "a" if i % 3 else None) for i in range(4000)]  # over three years
    df = spark.createDataFrame(rows, "us long, d int, k string").select(F.timestamp_micros("us").alias("ts"), "us", "d", "k")
    for keys in ([], ["k"]):
        got = {(r["k"] if keys else 0, r.us): r.total for r in stats.running_total(df, keys, "ts", F.col("d")).withColumn("us", F.unix_micros("ts")).collect()}
        total, want = {}, {}
        for us, d, k in sorted(rows, key=lambda r: r[0]):
            k = k if keys else 0
            want[(k, us)] = total[k] = total.get(k, 0) + d
        assert got == want
    plan = stats.running_total(df, [], "ts", F.col("d"))._jdf.queryExecution().sparkPlan().toString()
    windows = [x for x in plan.split("\n") if " Window " in x or x.startswith("Window ")]
    assert len(windows) == 3 and sum("_s60" not in x and "_s86400" not in x.split("], [")[0] for x in windows) <= 1


def test_rate_limit_is_cut_at_idle_gaps(spark):
    r = random.Random(6)
    day = limits.DAY_US
    rows, t = [], 0
    for i in range(600):
        t += r.choice([1, day // 5, day // 3, day - 1, day, 2 * day])
        rows.append((i, "hot", t))
    rows += [(1000 + i, r.choice(["b", None]), r.randrange(9 * day)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    cut = limits.idle_sessions(df.select("id", "key", "us"), day)
    assert cut.where("key = 'hot'").select("session").distinct().count() > 100  # a hot key is as many tasks
    got = {x.id: x.admitted for x in limits.rate_limit(df, 2).collect()}
    held = {}
    for i, k, us in sorted(rows, key=lambda x: (x[2], x[0])):
        admitted = [x for x in held.get(k, []) if x > us - day]
        assert got[i] == (len(admitted) < 2), i
        held[k] = admitted + [us] * got[i]
    assert len(got) == len(rows)


def test_sliding_histograms_add_up_panes(spark):
    r = random.Random(9)
    rows = [(T0 + dt.timedelta(seconds=r.randrange(1200)), r.choice([0.2, 3.0, 40.0, 90.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    got = metrics.sliding_histogram(df, "v", [], [1.0, 50.0], 300, 30).collect()
    for x in got:
        mine = [v for t, v in rows if x.window_end - dt.timedelta(seconds=300) <= t < x.window_end]
        assert [(b.le, b["count"]) for b in x.buckets] == [(1.0, sum(v <= 1 for v in mine)), (50.0, sum(v <= 50 for v in mine)), (float("inf"), len(mine))]
    assert len(got) >= 40
    assert {s.state for s in metrics.latency_alerts(df, "v").collect()} == {"pending", "firing"}


def test_drift_with_a_judge_passed_in(spark):
    sample = spark.createDataFrame(
        [(1, "q?", "pumps move water", [7]), (2, "q?", "unknown", []), (3, "lost", "x", [7])],
        "id long, question string, answer string, reranked_ids array<long>",
    )
    chunks = spark.createDataFrame([(7, "Vol 1", "pumps move water", "h")], "id long, heading_path string, text string, content_hash string")

    def loader():
        # says nothing readable of the second answer
        return lambda prompts: ["no json" if "unknown" in p else '{"score": 4, "rationale": "fine"}' for p in prompts]

    model = judging.model_verdicts(loader)
    got = {r["query_log_id"]: r for r in judging.drift_scores(sample, chunks, "m", judge=model).collect()}
    assert (got[1]["judge_model"], round(got[1]["groundedness"], 3), got[1]["flagged"], got[1]["rationale"]) == ("m", 0.8, False, "g: fine | f: fine")
    assert round(got[2]["faithfulness"], 3) == 0.2 and got[2]["flagged"]

    # answers without any verdict have no score and are flagged
    some = judging.drift_scores(sample, chunks, judge=lambda p: judging.lexical_verdicts(p.filter("query_id <> 3")))
    got = {r["query_log_id"]: r for r in some.collect()}
    assert got[1]["faithfulness"] == 1.0 and not got[1]["flagged"]
    assert got[3]["faithfulness"] is None and got[3]["flagged"]
