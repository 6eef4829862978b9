"""Keyed updates of the posts table and choices between feeds."""

from pyspark.sql import Column, DataFrame, functions as F

from chirpline import schema
from chirpline.operators.skew import first_n


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; each task keeps one row per key before the shuffle."""
    return first_n(df, keys, [F.desc(c) for c in order], 1)


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, for posts seen again on a later page of a crawl."""
    return first_n(df, keys, [F.asc(c) for c in order], 1)


def upsert(existing: DataFrame, batch: DataFrame, order: list[str], mode: str = "replace", single: bool = False) -> DataFrame:
    """The table after a batch: a known id is replaced as a whole, a new one is added.

    ``existing`` has one row per id, so it needs no deduplication of its own:
    it only loses the ids of the batch. A small batch is broadcast for that,
    and the table is not shuffled. ``mode="preserve_scores"`` keeps the
    sentiment of a replaced post when the batch brings none. ``single`` says
    that the batch names no id twice.
    """
    if mode not in ("replace", "preserve_scores"):
        raise ValueError("mode must be 'replace' or 'preserve_scores'")
    columns = existing.columns
    fresh = (batch if single else latest_by_key(batch, ["tweet_id"], order)).select(*columns)
    kept = existing.join(fresh.select("tweet_id"), "tweet_id", "left_anti")
    if mode == "preserve_scores":
        old = existing.select("tweet_id", *[F.col(c).alias(f"__{c}") for c in schema.SENTIMENT])
        bare = F.col("sentiment_score").isNull()
        fresh = fresh.join(old, "tweet_id", "left").select(
            *[F.when(bare, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in schema.SENTIMENT else F.col(c)
              for c in columns])
    return kept.select(*columns).unionByName(fresh)


def apply_scores(posts: DataFrame, scores: DataFrame, order: list[str] = ()) -> DataFrame:
    """Write scores ``(tweet_id, score, label, confidence)`` into the posts by id.

    Ids without a post have no effect; of several scores for an id the last by
    ``order`` counts.
    """
    value = F.struct("score", "label", "confidence")
    # a struct of the order columns decides; without any, the greatest score does
    last = F.max_by(value, F.struct(*order)) if order else F.max(value)
    single = scores.groupBy("tweet_id").agg(last.alias("__new"))
    new = F.col("__new").isNotNull()
    sources = dict(zip(schema.SENTIMENT, ("score", "label", "confidence")))
    return posts.join(single, "tweet_id", "left").select(
        *[F.when(new, F.col(f"__new.{sources[c]}")).otherwise(F.col(c)).alias(c) if c in sources else F.col(c)
          for c in posts.columns])


def feed_winners(attempts: DataFrame, keys: list[str] = ("target",), feed: str = "feed",
                 priority: str = "priority") -> DataFrame:
    """Per target the first feed, in priority order, that succeeded, rows or no rows; else ``none``."""
    good = F.col("success")
    return attempts.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.when(good, F.col(feed)), F.when(good, F.col(priority))), F.lit("none")).alias(feed)
    ).withColumns({
        "success": F.col(feed) != "none",
        "error_message": F.when(F.col(feed) == "none", "All backends failed"),
    })


def winner_rows(rows: DataFrame, winners: DataFrame, keys: list[str] = ("target",), feed: str = "feed") -> DataFrame:
    """Rows of the feed that won for their target. The winners are broadcast or, if many, joined by key, where adaptive execution splits large targets."""
    on = [*keys, feed]
    return rows.join(winners.filter("success").select(*on), on, "left_semi")


def first_n_per_target(rows: DataFrame, n: int = 100, keys: list[str] = ("target",),
                       order: list[str] = ("page_no", "pos")) -> DataFrame:
    """The first ``n`` rows of each target in feed order; -1 keeps all."""
    if n == -1:
        return rows
    if n < 1:
        raise ValueError("n must be -1 or at least 1")
    return first_n(rows, list(keys), [F.asc(c) for c in order], n)


def retained(posts: DataFrame, cutoff: Column) -> DataFrame:
    return posts.filter(F.col("timestamp") >= cutoff)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Converted feeds as one table, matched by column name."""
    out = feeds[0]
    for other in feeds[1:]:
        out = out.unionByName(other)
    return out
