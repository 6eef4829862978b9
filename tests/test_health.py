"""Feed health and backlog against brute force and asserted values."""

import random

import pytest
from pyspark.sql import functions as F

from chirpline.operators import backlog, health
from tests.conftest import at, naive

LOG = "feed string, target string, ts timestamp, success boolean, response_time double, event_id long"


def log(spark, rows):
    return spark.createDataFrame([(f, t, ts, ok, rt, i) for i, (f, t, ts, ok, rt) in enumerate(rows)], LOG)


@pytest.fixture(scope="module")
def dense():
    """Bursts with equal moments, exact window edges and a change of day."""
    rng = random.Random(5)
    rows = []
    for _ in range(700):
        feed = "hot" if rng.random() < 0.8 else f"f{rng.randrange(2)}"
        second = rng.choice([0, 1, 59, 60, 61, 120, 3599, 3600, 3601, 43_190, 43_260, 43_260 + 3600]) + rng.randrange(3)
        rows.append((feed, f"t{rng.randrange(4)}", at(seconds=second, microseconds=rng.choice([0, 1, 500_000, 999_999])),
                     rng.random() < 0.6, rng.choice([0.0, 0.5, 2.25, 100.0, 50_000.0])))
    return rows


def us(ts):
    return round((ts - at()).total_seconds() * 1_000_000)


def test_request_load(spark, dense):
    got = health.request_load(log(spark, dense), {"minute": (60, True), "strict": (60, False), "hour": (3600, True)}).collect()
    assert len(got) == len({(r[0], r[2]) for r in dense})
    for r in got:
        now = us(r["ts"].astimezone(at().tzinfo) if r["ts"].tzinfo else r["ts"].replace(tzinfo=at().tzinfo))
        mine = [(us(ts), us(ts) + round(rt * 1e6)) for f, _, ts, _, rt in dense if f == r["feed"]]
        for name, seconds, strict in (("minute", 60, 0), ("strict", 60, 1), ("hour", 3600, 0)):
            seen = [s for s, _ in mine if now - seconds * 1_000_000 + strict <= s < now]
            assert r[f"{name}_count"] == len(seen)
            oldest = r[f"{name}_oldest"]
            assert (oldest is None) == (not seen) and (not seen or us(oldest.replace(tzinfo=at().tzinfo)) == min(seen))
        assert r["n_requests"] == sum(s == now for s, _ in mine)
        assert r["active"] == sum(s < now < e for s, e in mine)


def test_load_takes_few_exchanges(spark, dense):
    out = health.quota_windows(log(spark, dense), health.quota_table(spark))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") <= 4


def test_quota_and_wait(spark):
    quotas = health.quota_table(spark, {"f": {"requests_per_minute": 2, "requests_per_hour": 10, "concurrent_requests": 5}})
    rows = [("f", "t", at(seconds=s), True, 0.1) for s in (0, 10, 20, 75)]
    got = {naive(r["ts"]): r for r in health.quota_windows(log(spark, rows), quotas).collect()}
    assert [got[naive(at(seconds=s))]["allowed"] for s in (0, 10, 20, 75)] == [True, True, False, True]
    assert got[naive(at(seconds=20))]["wait_time"] == pytest.approx(40.0)
    one = health.quota_table(spark, {"f": {"concurrent_requests": 1}})
    busy = {naive(r["ts"]): r["allowed"] for r in health.quota_windows(log(spark, [("f", "t", at(), True, 30.0), ("f", "t", at(1), True, 1.0), ("f", "t", at(seconds=20), True, 1.0)]), one).collect()}
    assert [busy[naive(at(seconds=s))] for s in (0, 20, 60)] == [True, False, True]
    waits = [r["wait_time"] for r in health.mirror_wait(log(spark, [("m", "t", at(seconds=i), True, 0.1) for i in range(16)])).orderBy("ts").collect()]
    assert waits[:15] == [0.0] * 15 and waits[15] == pytest.approx(45.0)
    limits = {r["feed"]: tuple(r)[1:] for r in health.quota_table(spark, {"x": {}}).collect()}
    assert limits["x"] == (30, 1000, 5) and limits[list(health.DEFAULT_QUOTAS)[0]] == (100, 3000, 10)


def fold(rows):
    avg, rate, streak = 0.0, 1.0, 0
    for _, _, _, ok, rt in rows:
        avg = rt if avg == 0 else 0.8 * avg + 0.2 * rt
        rate = 0.9 * rate + (0.1 if ok else 0.0)
        streak = 0 if ok else streak + 1
    return avg, rate, streak


def in_order(rows, feed):
    return [r for _, r in sorted(enumerate(rows), key=lambda p: (p[1][2], p[0])) if r[0] == feed]


def test_averages(spark, dense):
    many = [("long", "t", at(seconds=i), i % 3 == 0, float(i % 11)) for i in range(2500)]
    late = [("late", "t", at(seconds=i), True, 3.0 if i > 1700 else 0.0 if i else 7.0) for i in range(1800)]
    rows = dense + many + late + [("zero", "t", at(i), True, 0.0) for i in range(3)]
    got = {r["feed"]: r for r in health.feed_averages(log(spark, rows), ["ts", "event_id"]).collect()}
    for feed in {r[0] for r in rows}:
        avg, rate, _ = fold(in_order(rows, feed))
        assert got[feed]["avg_response_time"] == pytest.approx(avg, abs=1e-9) and got[feed]["success_rate"] == pytest.approx(rate, abs=1e-12)


def test_averages_of_one_moment_and_of_orders_that_are_no_times(spark):
    """A hot key within one moment is shared by tasks and still folds in order."""
    rng = random.Random(8)
    rows = [("hot", "same", i, float(rng.randrange(4))) for i in range(6000)] + [(f"k{i % 5}", f"o{i:04d}", 0, float(rng.randrange(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o string, i int, v double").repartition(8)
    got = {r["k"]: r["average"] for r in health.seeded_average(df, ["k"], ["o", "i"], "v", 0.9).collect()}
    for k in {r[0] for r in rows}:
        avg = 0.0
        for _, _, _, v in sorted(r for r in rows if r[0] == k):
            avg = v if avg == 0 else 0.9 * avg + 0.1 * v
        assert got[k] == pytest.approx(avg, abs=1e-9)
    plan = health._folded(df, ["k"], ["o", "i"], {"v": ("v", 0.9)})._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan


def test_asserted_averages_and_status(spark):
    def state(rows, now=at(60)):
        return health.feed_state(log(spark, rows), now, health.quota_table(spark), ["ts", "event_id"]).first()

    one = state([("f", "t", at(0), True, 1.5)])
    assert (one["avg_response_time"], one["success_rate"], one["status"]) == (1.5, 1.0, "healthy")
    two = state([("f", "t", at(0), True, 1.5), ("f", "t", at(1), False, 5.0)])
    assert two["consecutive_failures"] == 1 and two["success_rate"] == pytest.approx(0.9) and two["avg_response_time"] == pytest.approx(2.2)
    assert state([("f", "t", at(i), i == 0, 1.0) for i in range(7)])["status"] == "failed"
    assert state([("f", "t", at(i), False, 1.0) for i in range(2)])["status"] == "unknown"
    assert state([("f", "t", at(0), True, 40.0)])["status"] == "degraded"
    assert state([("f", "t", at(seconds=i), True, 1.0) for i in range(25)], at(seconds=25))["status"] == "rate_limited"


def test_streaks(spark, dense):
    seen = {r["feed"]: r for r in health.failure_streaks(log(spark, dense)).collect()}
    for feed, r in seen.items():
        mine = [x for x in dense if x[0] == feed]
        last = max((x[2] for x in mine if x[3]), default=None)
        assert r["consecutive_failures"] == sum(not x[3] and (last is None or x[2] > last) for x in mine)


STATE = "feed string, can_make_request boolean, status string, weight double, wait_time double"


def test_ranking(spark):
    state = spark.createDataFrame([("slow", True, "degraded", 0.9, 0.0), ("good", True, "healthy", 0.5, 0.0), ("dead", True, "failed", 1.0, 0.0), ("full", False, "rate_limited", 1.0, 12.0)], STATE)
    assert [r["feed"] for r in health.ranked_feeds(state).collect()] == ["good", "slow"]
    assert health.best_feed(state).first()["feed"] == "good"
    asks = spark.createDataFrame([("a", at(), "slow"), ("b", at(), "dead"), ("c", at(), None)], "value string, created_at timestamp, backend_preference string")
    assert {r["value"]: r["feed"] for r in health.choose_feed(asks, state).collect()} == {"a": "slow", "b": "good", "c": "good"}
    assert health.choose_feed(asks, state.filter("feed = 'dead'")).filter("feed is not null").count() == 0
    assert tuple(health.next_available(state).first()) == ("dead", 0.0)
    assert health.best_feed(state.filter("feed = 'full'")).count() == 0


def test_targets(spark):
    targets = spark.createDataFrame([("user", "fresh", 1.0, ""), ("user", "old", 1.0, ""), ("user", "never", 1.0, ""), ("user", "empty", 1.0, "")], "target_type string, value string, weight double, description string")
    rows = [("f", "fresh", at(-60), True, 1), ("f", "old", at(-600), True, 1), ("f", "old", at(-500), False, 0), ("f", "empty", at(-5), True, 0)]
    tries = spark.createDataFrame(rows, "feed string, target string, ts timestamp, success boolean, n_rows int")
    due = {r["value"]: r for r in backlog.due_targets(targets, tries, at()).collect()}
    assert sorted(due) == ["empty", "never", "old"]
    assert (due["old"]["error_count"], due["empty"]["error_count"], due["never"]["error_count"]) == (1, 1, 0)
    typed = tries.filter("target = 'fresh'").withColumn("target_type", F.lit("search"))
    assert {r["value"] for r in backlog.due_targets(targets, typed, at()).collect()} == {"fresh", "old", "never", "empty"}
    edge = backlog.due_targets(targets, tries, at(-60, seconds=30), 30)
    assert {r["value"] for r in edge.collect()} >= {"fresh"}
    r = backlog.collection_summary(tries, targets.count(), seconds=2).first()
    assert (r["targets_processed"], r["targets_total"], r["tweets_scraped"], r["success_rate"], r["tweets_per_second"]) == (3, 4, 2, 0.75, 1.0)
    assert backlog.feed_usage_map(tries).first()[0] == {"f": 3}


def test_backlog(spark):
    rows = [("low", 3, at(0)), ("normal1", 2, at(-1)), ("normal2", 2, at(0)), ("high", 1, at(-2)), ("gone", 0, at(-10)), ("edge", 3, at(-5))]
    asks = spark.createDataFrame([("user", v, p, c, 0, 3, None) for v, p, c in rows], "target_type string, value string, priority int, created_at timestamp, retry_count int, max_retries int, backend_preference string")
    names = lambda df: [r["value"] for r in df.collect()]
    assert sorted(names(backlog.live_requests(asks, at()))) == ["edge", "high", "low", "normal1", "normal2"]
    assert names(backlog.triage(asks, at(), 2)) == ["high", "normal2"]
    assert names(backlog.backlog_order(asks)) == ["gone", "high", "normal1", "normal2", "edge", "low"]
    assert backlog.backlog_counts(asks, at(), 2).first().asDict() == {"total": 6, "expired": 1, "queued": 2, "overflow": 3, "dropped": 4}
    tries = asks.withColumn("retry_count", F.when(F.col("value") == "low", 3).otherwise(2))
    plan = {r["value"]: (r["outcome"], r["retry_count"]) for r in backlog.retry_plan(tries).collect()}
    assert plan["low"] == ("failed", 3) and plan["high"] == ("requeue", 3)
