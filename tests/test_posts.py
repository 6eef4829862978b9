"""Validation, filters, summaries, signals and keyed updates on small tables."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from chirpline.operators import aggregate, filters, keyed, validate
from tests.conftest import at, naive, post


def ids(df):
    return sorted(r["tweet_id"] for r in df.collect())


def broken(posts, **change):
    row = post(1)
    row.update(change)
    return validate.check_posts(posts(row)).first()["violations"]


def test_record_rules(posts):
    assert broken(posts) == []
    assert broken(posts, content="   \n") == ["content empty"]
    assert broken(posts, content=None) == ["content missing"]
    assert broken(posts, likes=-1) == ["likes negative"]
    assert broken(posts, sentiment_score=2.0) == ["sentiment_score out of range"]
    assert broken(posts, sentiment_score=-1.0, sentiment_confidence=1.0) == []
    assert broken(posts, sentiment_confidence=float("nan")) == ["sentiment_confidence out of range"]
    assert broken(posts, user_id=None, timestamp=None) == ["user_id missing", "timestamp missing"]


def test_defaults_and_split(spark, posts):
    bare = spark.createDataFrame([("1", "u", "alice", " hi ", "2025-05-29 12:00:00")], "tweet_id string, user_id string, username string, content string, timestamp string")
    row = validate.valid_posts(bare).first()
    assert row["content"] == "hi" and row["likes"] == 0 and row["is_reply"] is False and row["scraped_at"] is not None
    df = posts(post(1), post(2, likes=-5), post(3, ""))
    assert ids(validate.valid_posts(df)) == ["1"] and ids(validate.quarantined_posts(df)) == ["2", "3"]


@pytest.fixture
def three(posts):
    return posts(post("a1", when=at(-120), sentiment_score=0.5, sentiment_label="positive", sentiment_confidence=0.5),
                 post("a2", when=at(-60)), post("b1", username="bob", when=at(0)))


def test_filters(three):
    assert ids(filters.get_posts(three, username="alice")) == ["a1", "a2"]
    assert ids(filters.get_posts(three, start_time=at(-30))) == ["b1"]
    assert ids(filters.get_posts(three, start_time=at(-60), end_time=at(-60))) == ["a2"]
    assert ids(filters.get_posts(three, limit=1)) == ["b1"]
    assert [r["tweet_id"] for r in filters.get_posts(three, ordered=True).collect()] == ["b1", "a2", "a1"]
    assert ids(filters.get_posts(three, username="", tweet_id="", limit=0)) == ["a1", "a2", "b1"]
    assert ids(filters.get_posts(three, with_sentiment=True)) == ["a1"]
    assert ids(filters.unscored(three)) == ["a2", "b1"] and ids(filters.unscored(three, False)) == ["a1", "a2", "b1"]
    assert filters.latest_scored(three).columns == ["tweet_id", "content", "sentiment_score", "sentiment_label", "confidence", "timestamp", "username"]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            filters.latest_scored(three, bad)


def test_search(posts):
    more = [T.StructField("lang", T.StringType()), T.StructField("replying_to", T.ArrayType(T.StringType())), T.StructField("pictures", T.ArrayType(T.StringType()))]
    df = posts(
        post(1, "Rates UP #Fed", lang="en", replying_to=[], pictures=["p"]),
        post(2, "rates down https://x.y", username="bob", lang="en", replying_to=["@al"], pictures=[], is_reply=True, when=at(24 * 60)),
        post(3, "steigt #fed", lang="de", replying_to=None, pictures=None), extra=more)
    find = lambda *a, **k: ids(filters.search_posts(df, *a, **k))
    assert find("rates") == ["1", "2"] and find("#FED") == ["1", "3"] and find("fed", mode="hashtag") == ["1", "3"]
    assert find("rates", language="en", to="@al") == ["2"]
    assert find("rates", since="2025-05-30") == ["2"] and find("rates", until="2025-05-30") == ["1"]
    assert find("bob", mode="user") == [] and find("bob", mode="user", replies=True) == ["2"]
    assert find("bob", mode="user", filters=["replies"]) == ["2"]
    assert find("e", filters=["images"]) == ["1"] and find("e", exclude=["media", "links"]) == ["3"]
    rows = filters.search_posts(df, ["rates", " fed "]).collect()
    assert sorted((r["term"], r["tweet_id"]) for r in rows) == [("fed", "1"), ("fed", "3"), ("rates", "1"), ("rates", "2")]
    for wrong in (dict(mode="x"), dict(near="Rome"), dict(since="2025-13-01"), dict(until="2006-03-21"), dict(since="9999-01-01"), dict(since="tomorrow"),
                  dict(filters=["nope"]), dict(exclude=["verified"])):
        with pytest.raises(ValueError):
            filters.search_posts(df, "a", **wrong)


def test_search_date_column(spark):
    values = {"2006-03-21": False, "2006-03-22": True, "2025-02-29": False, "2024-02-29": True, "2025-1-01": False, "2030-01-01": False, "x": False, None: False}
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = df.select("d", filters.is_valid_search_date(F.col("d"), F.lit("2026-01-01").cast("date")).alias("ok")).collect()
    assert {r["d"]: r["ok"] for r in got} == values


def scored(posts, *scores):
    return posts(*[post(i, sentiment_score=s, when=at(-i)) for i, s in enumerate(scores)])


def test_summary(posts):
    df = scored(posts, 0.5, -0.5, 0.0, 0.1, -0.1, None)
    r = aggregate.sentiment_summary(df, at()).first()
    assert (r["total_tweets"], r["positive_tweets"], r["negative_tweets"], r["neutral_tweets"]) == (5, 1, 1, 3)
    assert r["avg_sentiment"] == 0.0 and naive(r["earliest_tweet"]) == naive(at(-4)) and naive(r["latest_tweet"]) == naive(at(0))
    empty = aggregate.sentiment_summary(df, at(60 * 48)).first()
    assert empty["total_tweets"] == 0 and empty["avg_sentiment"] is None
    assert aggregate.sentiment_summary(df, at(), username="bob").first()["total_tweets"] == 0
    # the lower bound is inclusive
    assert aggregate.sentiment_summary(df, at(60), hours=1).first()["total_tweets"] == 1
    assert aggregate.post_count(df, at(58), hours=1).first()[0] == 3 and aggregate.post_count(df, hours=0).first()[0] == 6
    record = aggregate.summary_record(aggregate.sentiment_summary(df, at(60 * 48)), at()).first()
    assert record["total_tweets"] == 0 and record["average_sentiment"] is None


def test_stats(posts):
    df = posts(*[post(i, username=f"u{i % 2}", sentiment_score=0.1 if i % 2 == 0 else None) for i in range(5)])
    r = aggregate.table_stats(df).first()
    assert (r["total_tweets"], r["unique_users"], r["tweets_with_sentiment"]) == (5, 2, 3)
    assert aggregate.status_overview(df).first().asDict() == {"total_tweets": 5, "tweets_with_sentiment": 3}
    assert aggregate.recent_previews(df).count() == 3


@pytest.mark.parametrize("total, avg, up, down, signal, confidence", [
    (100, 0.6, 70, 20, "BUY", 0.9), (100, 0.31, 61, 20, "BUY", 0.615), (100, -0.4, 20, 70, "SELL", 0.75),
    (100, 0.3, 70, 20, "HOLD", 0.5), (100, 0.25, 60, 30, "HOLD", 0.5), (0, None, 0, 0, "HOLD", 0.0)])
def test_signal(spark, total, avg, up, down, signal, confidence):
    summary = spark.createDataFrame([(total, avg, up, down, total - up - down, None, None)],
                                    "total_tweets long, avg_sentiment double, positive_tweets long, negative_tweets long, neutral_tweets long, earliest_tweet timestamp, latest_tweet timestamp")
    r = aggregate.signal(summary).first()
    assert r["signal"] == signal and r["confidence"] == pytest.approx(confidence) and r["tweet_count"] == total
    reasons = {"BUY": f"Strong positive sentiment ({avg or 0:.2f}) with {up:.1f}% positive tweets",
               "SELL": f"Strong negative sentiment ({avg or 0:.2f}) with {down:.1f}% negative tweets",
               "HOLD": f"Mixed sentiment ({avg or 0:.2f}) suggests holding position"}
    assert r["reasoning"] == (reasons[signal] if total else "Insufficient data: no tweets available")


def test_rolling_windows(posts):
    df = posts(post(1, when=at(1), sentiment_score=0.4), post(2, when=at(6), sentiment_score=-0.2), post(3, when=at(6)))
    rows = {naive(r["window_start"]): r for r in aggregate.rolling_summary(df).collect()}
    assert sorted(rows) == [naive(at(m)) for m in (-10, -5, 0, 5)]
    assert rows[naive(at(-5))]["avg_sentiment"] == pytest.approx(0.1) and rows[naive(at(-5))]["total_tweets"] == 2
    assert rows[naive(at(5))]["total_tweets"] == 1


def test_scoring_run_counts(posts):
    r = aggregate.scoring_run_summary(scored(posts, 0.1, None, 0.3), seconds=0.5).first()
    assert (r["tweets_processed"], r["tweets_updated"], r["errors"], r["tweets_per_second"]) == (3, 2, 1, 3.0)
    assert aggregate.scoring_run_summary(scored(posts).limit(0)).first()["success_rate"] == 0.0


def test_weighted(spark, posts):
    df = posts(post(1, sentiment_score=1.0), post(2, sentiment_score=0.0), post(3, username="bob", sentiment_score=-1.0), post(4, username="eve", sentiment_score=1.0))
    targets = spark.createDataFrame([("user", "alice", 1.0, ""), ("user", "bob", 2.0, ""), ("search", "eve", 9.0, "")], "target_type string, value string, weight double, description string")
    r = aggregate.weighted_sentiment(df, targets).first()
    assert (r["n_users"], r["n_posts"]) == (2, 3) and r["weighted_sentiment"] == pytest.approx((1 - 2) / (2 + 2))


def test_upsert_modes(posts):
    old = posts(post(1, "old", sentiment_score=0.9, sentiment_label="positive", sentiment_confidence=0.5), post(2, "stays"))
    new = posts(post(1, "first", when=at(1)), post(1, "last", when=at(2)), post(3, "new"))
    out = {r["tweet_id"]: r for r in keyed.upsert(old, new, ["scraped_at"]).collect()}
    assert sorted(out) == ["1", "2", "3"] and out["1"]["content"] == "last" and out["1"]["sentiment_score"] is None
    kept = {r["tweet_id"]: r for r in keyed.upsert(old, new, ["scraped_at"], mode="preserve_scores").collect()}
    assert kept["1"]["content"] == "last" and kept["1"]["sentiment_score"] == 0.9
    with pytest.raises(ValueError):
        keyed.upsert(old, new, ["scraped_at"], mode="other")


def test_score_update(spark, posts):
    scores = spark.createDataFrame([("1", 0.1, "positive", 0.2, 1), ("1", 0.8, "positive", 0.9, 2), ("404", 0.5, "positive", 0.5, 1)], "tweet_id string, score double, label string, confidence double, n int")
    rows = {r["tweet_id"]: r for r in keyed.apply_scores(posts(post(1), post(2, sentiment_score=0.3)), scores, ["n"]).collect()}
    assert len(rows) == 2 and (rows["1"]["sentiment_score"], rows["1"]["sentiment_confidence"]) == (0.8, 0.9) and rows["2"]["sentiment_score"] == 0.3


def test_feed_choice(spark):
    tries = spark.createDataFrame([("t1", "a", 0, False), ("t1", "b", 1, True), ("t2", "a", 0, True), ("t2", "b", 1, True), ("t3", "a", 0, False), ("t3", "b", 1, False)],
                                  "target string, feed string, priority int, success boolean")
    won = {r["target"]: r for r in keyed.feed_winners(tries).collect()}
    assert {t: r["feed"] for t, r in won.items()} == {"t1": "b", "t2": "a", "t3": "none"}
    assert won["t3"]["error_message"] == "All backends failed" and won["t1"]["success"]
    rows = spark.createDataFrame([(t, f, f"{t}{f}{i}") for t in ("t1", "t2", "t3") for f in "ab" for i in range(50)], "target string, feed string, tweet_id string")
    kept = keyed.winner_rows(rows, keyed.feed_winners(tries)).collect()
    assert len(kept) == 100 and {(r["target"], r["feed"]) for r in kept} == {("t1", "b"), ("t2", "a")}


@pytest.mark.parametrize("n", [3, 60, 1500])
def test_first_n_of_a_large_group(spark, n):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("target"),
                                  F.lit(0).alias("page_no"), ((F.col("id") * 7919) % 5000).alias("pos"))
    rows = df.collect()
    want = {t: sorted(r["pos"] for r in rows if r["target"] == t)[:n] for t in {r["target"] for r in rows}}
    got = keyed.first_n_per_target(df, n).collect()
    assert {t: sorted(r["pos"] for r in got if r["target"] == t) for t in want} == want
    assert keyed.first_n_per_target(df, -1).count() == 5000


@pytest.mark.parametrize("limit", [1, 7, 30, 59, 60, 61, 500])
def test_large_limits_cut_like_small_ones(posts, monkeypatch, limit):
    rng = random.Random(2)
    df = posts(*[post(i, when=at(rng.randrange(6)) if i % 9 else None) for i in range(60)]).withColumn(
        "timestamp", F.when(F.col("tweet_id").cast("int") % 9 != 0, F.col("timestamp")))
    want = [r["tweet_id"] for r in filters.newest_first(df, limit).collect()]
    monkeypatch.setattr(filters, "TOP_ROWS", 0)
    assert [r["tweet_id"] for r in filters.newest_first(df, limit).collect()] == want and len(want) == min(limit, 60)
