"""Summaries of scored posts and the signal drawn from them."""

from pyspark.sql import Column, DataFrame, functions as F

from chirpline.functions.text import preview
from chirpline.functions.times import minus_seconds, moment
from chirpline.operators.filters import newest_first

# Beyond these scores a post counts as positive or negative.
POSITIVE_ABOVE, NEGATIVE_BELOW = 0.1, -0.1


def _measures() -> list[Column]:
    """Counts over scored rows only.

    Nulls are skipped by the aggregates themselves: a filter on the score
    would be pushed below the scoring expressions and evaluate them twice.
    """
    score, at = F.col("sentiment_score"), F.col("timestamp")
    scored = score.isNotNull()
    return [
        F.count(score).alias("total_tweets"),
        F.avg(score).alias("avg_sentiment"),
        F.count_if(score > POSITIVE_ABOVE).alias("positive_tweets"),
        F.count_if(score < NEGATIVE_BELOW).alias("negative_tweets"),
        F.count_if(score.between(NEGATIVE_BELOW, POSITIVE_ABOVE)).alias("neutral_tweets"),
        F.min(F.when(scored, at)).alias("earliest_tweet"),
        F.max(F.when(scored, at)).alias("latest_tweet"),
    ]


def sentiment_summary(posts: DataFrame, as_of, hours: float = 24, username: str | None = None,
                      by: list[str] = ()) -> DataFrame:
    """Counts and mean score of the scored posts of the last hours, per group if asked."""
    recent = posts.filter(F.col("timestamp") >= minus_seconds(moment(as_of), hours * 3600))
    if username:
        recent = recent.filter(F.col("username") == username)
    grouped = recent.groupBy(*by) if by else recent
    out = grouped.agg(*_measures())
    return out.filter(F.col("total_tweets") > 0) if by else out


def summary_record(summary: DataFrame, as_of) -> DataFrame:
    """A summary under its serving names."""
    return summary.select(
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
          for c in ("total_tweets", "positive_tweets", "negative_tweets", "neutral_tweets")],
        F.col("avg_sentiment").alias("average_sentiment"),
        moment(as_of).alias("last_updated"))


def post_count(posts: DataFrame, as_of=None, username: str | None = None, hours: float | None = None) -> DataFrame:
    out = posts
    if username:
        out = out.filter(F.col("username") == username)
    if hours:
        out = out.filter(F.col("timestamp") >= minus_seconds(moment(as_of), hours * 3600))
    return out.agg(F.count("*").alias("total_tweets"))


def table_stats(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count("*").alias("total_tweets"),
        F.countDistinct("username").alias("unique_users"),
        F.count("sentiment_score").alias("tweets_with_sentiment"),
        F.min("timestamp").alias("earliest_tweet"),
        F.max("timestamp").alias("latest_tweet"),
        F.max("scraped_at").alias("last_scraped"))


def status_overview(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("total_tweets"), F.count("sentiment_score").alias("tweets_with_sentiment"))


def recent_previews(posts: DataFrame, n: int = 3) -> DataFrame:
    """The newest posts, their text cut for display."""
    return newest_first(posts, n).select("tweet_id", "username", "timestamp", preview(F.col("content")).alias("preview"))


def system_stats(posts: DataFrame, as_of) -> DataFrame:
    return posts.agg(F.count("*").alias("total_tweets")).select(
        "total_tweets", F.lit("unknown").alias("uptime"), F.lit("unknown").alias("last_scrape"),
        F.lit("1.0.0").alias("api_version"), moment(as_of).alias("timestamp"))


# The signal rule.
STRONG_SCORE, STRONG_SHARE, SHARE_WEIGHT, MAX_CONFIDENCE, HOLD_CONFIDENCE = 0.3, 0.6, 0.5, 0.9, 0.5


def signal(summary: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD for every summary row, with confidence and reason."""
    keys = [c for c in summary.columns if c not in (
        "total_tweets", "avg_sentiment", "positive_tweets", "negative_tweets", "neutral_tweets",
        "earliest_tweet", "latest_tweet")]
    total, avg = F.col("total_tweets"), F.col("avg_sentiment")
    df = summary.withColumns({
        "__up": F.try_divide("positive_tweets", total),
        "__down": F.try_divide("negative_tweets", total),
    })
    up, down = F.col("__up"), F.col("__down")
    empty = total == 0
    buy = (avg > STRONG_SCORE) & (up > STRONG_SHARE)
    sell = (avg < -STRONG_SCORE) & (down > STRONG_SHARE)

    def sure(share):
        return F.least(F.lit(MAX_CONFIDENCE), F.abs(avg) + share * SHARE_WEIGHT)

    def reason(name, share):
        return F.format_string(f"Strong {name} sentiment (%.2f) with %.1f%% {name} tweets",
                               avg.cast("double"), (share * 100).cast("double"))

    return df.select(
        *keys,
        F.when(empty, "HOLD").when(buy, "BUY").when(sell, "SELL").otherwise("HOLD").alias("signal"),
        F.when(empty, 0.0).when(buy, sure(up)).when(sell, sure(down)).otherwise(HOLD_CONFIDENCE).alias("confidence"),
        F.when(empty, "Insufficient data: no tweets available")
        .when(buy, reason("positive", up)).when(sell, reason("negative", down))
        .otherwise(F.format_string("Mixed sentiment (%.2f) suggests holding position", avg.cast("double")))
        .alias("reasoning"),
        F.when(empty, 0.0).otherwise(avg).alias("sentiment_score"),
        total.alias("tweet_count"))


def trading_signal(posts: DataFrame, as_of, hours: float = 24, by: list[str] = ()) -> DataFrame:
    return signal(sentiment_summary(posts, as_of, hours, by=by)).withColumn("timestamp", moment(as_of))


def rolling_cells(posts: DataFrame, slide: str = "5 minutes", by: list[str] = ()) -> DataFrame:
    """Count, sum and bounds of the scores per slide-wide cell and group."""
    measures = _measures()
    return posts.groupBy(F.window("timestamp", slide).alias("cell"), *by).agg(
        F.count("sentiment_score").alias("n"), F.sum("sentiment_score").alias("s"), *measures[2:])


def windows_of_cells(cells: DataFrame, window: str = "15 minutes", slide: str = "5 minutes",
                     by: list[str] = ()) -> DataFrame:
    """Overlapping windows put together from cells; the window must be a multiple of the slide."""
    spread = cells.filter("n > 0").withColumn("window", F.window(F.col("cell.start"), window, slide))
    return spread.groupBy("window", *by).agg(
        F.sum("n").alias("total_tweets"), (F.sum("s") / F.sum("n")).alias("avg_sentiment"),
        *[F.sum(c).alias(c) for c in ("positive_tweets", "negative_tweets", "neutral_tweets")],
        F.min("earliest_tweet").alias("earliest_tweet"), F.max("latest_tweet").alias("latest_tweet"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
             "total_tweets", "avg_sentiment", "positive_tweets", "negative_tweets", "neutral_tweets",
             "earliest_tweet", "latest_tweet")


def rolling_summary(posts: DataFrame, window: str = "15 minutes", slide: str = "5 minutes",
                    by: list[str] = ()) -> DataFrame:
    """Summaries of overlapping windows.

    Posts are reduced to cells first, and only the cells are repeated for the
    windows they lie in.
    """
    return windows_of_cells(rolling_cells(posts, slide, by), window, slide, by)


def scoring_run_summary(scored: DataFrame, seconds: float | None = None) -> DataFrame:
    """What a scoring run did: every row without a score counts as an error."""
    done = scored.agg(F.count("*").alias("tweets_processed"), F.count("sentiment_score").alias("tweets_updated"))
    out = done.select(
        "*", (F.col("tweets_processed") - F.col("tweets_updated")).alias("errors"),
        (F.col("tweets_updated") / F.greatest("tweets_processed", F.lit(1))).alias("success_rate"))
    if seconds is None:
        return out
    return out.withColumns({"duration_seconds": F.lit(float(seconds)),
                            "tweets_per_second": F.col("tweets_processed") / max(float(seconds), 1.0)})


def summary_with_run(scored: DataFrame, as_of, hours: float | None = None) -> DataFrame:
    """The summary of the last hours together with the run's counters, in one pass."""
    inside = F.col("timestamp") >= minus_seconds(moment(as_of), (24 if hours is None else hours) * 3600)
    score = F.when(inside, F.col("sentiment_score"))
    windowed = scored.select("timestamp", score.alias("sentiment_score"), F.col("sentiment_score").alias("__any"))
    return windowed.agg(*_measures(), F.count("*").alias("tweets_processed"), F.count("__any").alias("tweets_updated")) \
        .withColumn("errors", F.col("tweets_processed") - F.col("tweets_updated"))


def weighted_sentiment(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean score with each user's target weight.

    Posts are summed per user before the join, so a user with a great share of
    the posts costs no more than any other.
    """
    users = posts.groupBy("username").agg(F.count("sentiment_score").alias("n"), F.sum("sentiment_score").alias("s"))
    weights = targets.filter("target_type = 'user'").groupBy(F.col("value").alias("username")).agg(
        F.max("weight").alias("w"))
    return users.filter("n > 0").join(weights, "username").agg(
        F.count("*").alias("n_users"), F.sum("n").alias("n_posts"),
        F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("weighted_sentiment"))
