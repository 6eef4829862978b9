"""Targets that are due, the backlog of requests, and run reports."""

from pyspark.sql import Column, DataFrame, functions as F

from chirpline.functions.times import age_seconds, moment
from chirpline.operators.health import failure_streaks

# Fixed values.
MAX_AGE_HOURS = 6
COLLECT_EVERY_SECONDS = 30
EXPIRY_SECONDS = 300
CAPACITY = 1000


def _target_keys(attempts: DataFrame) -> list[str]:
    return [c for c in ("target_type", "target") if c in attempts.columns]


def target_state(attempts: DataFrame) -> DataFrame:
    """Per target: when it last brought rows, and the failures since.

    An attempt that stored no rows counts as a failure when the log says how
    many rows there were. A log that names the ``target_type`` keeps a user and
    a search of the same name apart.
    """
    ok = F.col("success") & (F.coalesce(F.col("n_rows"), F.lit(1)) > 0) if "n_rows" in attempts.columns else F.col("success")
    keys = _target_keys(attempts)
    return failure_streaks(attempts, keys, ok).select(
        *keys, F.col("last_success").alias("last_scraped"), F.col("consecutive_failures").alias("error_count"))


def due_targets(targets: DataFrame, attempts: DataFrame, as_of, min_age_seconds: float = MAX_AGE_HOURS * 3600) -> DataFrame:
    """Targets never collected or last collected at least that long ago."""
    state = target_state(attempts).withColumnRenamed("target", "value")
    age = age_seconds(F.col("last_scraped"), moment(as_of))
    return targets.join(state, ["value", *_target_keys(attempts)[:-1]], "left").withColumn("error_count", F.coalesce("error_count", F.lit(0).cast("long"))) \
        .filter(F.col("last_scraped").isNull() | (age >= min_age_seconds))


def expired(as_of) -> Column:
    return age_seconds(F.col("created_at"), moment(as_of)) > EXPIRY_SECONDS


def live_requests(requests: DataFrame, as_of) -> DataFrame:
    return requests.filter(~expired(as_of))


def backlog_order(requests: DataFrame) -> DataFrame:
    """Most urgent first, then oldest first."""
    return requests.orderBy("priority", "created_at")


def triage(requests: DataFrame, as_of, capacity: int = CAPACITY, tie: list[str] = ()) -> DataFrame:
    """The live requests that fit the capacity.

    Kept are the most urgent and among equals the newest, as the full queue
    gives up its least urgent and oldest entry. This looks at the whole backlog
    at once; a queue that decides at each arrival may also give up a request
    for a newcomer that is worse.
    """
    return live_requests(requests, as_of).orderBy("priority", F.desc("created_at"), *tie).limit(capacity)


def retry_plan(failed: DataFrame) -> DataFrame:
    """What happens to failed requests: again, one retry further, or given up."""
    again = F.col("retry_count") < F.col("max_retries")
    return failed.withColumns({
        "outcome": F.when(again, "requeue").otherwise("failed"),
        "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count"))})


def backlog_counts(requests: DataFrame, as_of, capacity: int = CAPACITY) -> DataFrame:
    """Requests by outcome: queued within capacity, dropped beyond it, dropped as expired."""
    seen = requests.agg(F.count("*").alias("total"), F.count_if(expired(as_of)).alias("expired"))
    live = F.col("total") - F.col("expired")
    kept = F.least(live, F.lit(capacity).cast("long"))
    return seen.select("total", "expired", kept.alias("queued"), (live - kept).alias("overflow"),
                       (F.col("expired") + live - kept).alias("dropped"))


def feed_usage(attempts: DataFrame) -> DataFrame:
    return attempts.filter("success").groupBy("feed").agg(F.count("*").alias("n"))


def feed_usage_map(attempts: DataFrame) -> DataFrame:
    """The usage histogram as one map; it has one entry per feed."""
    return feed_usage(attempts).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feed", "n")))).alias("backend_usage"))


def collection_summary(attempts: DataFrame, n_targets: Column | int, seconds: float | None = None) -> DataFrame:
    """One run: targets, rows, success rate and rows per second."""
    rows = F.coalesce(F.sum(F.when(F.col("success"), F.col("n_rows"))), F.lit(0)).cast("long") \
        if "n_rows" in attempts.columns else F.lit(None).cast("long")
    out = attempts.agg(F.countDistinct("target").alias("targets_processed"), rows.alias("tweets_scraped"),
                       F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"))
    total = n_targets if isinstance(n_targets, Column) else F.lit(n_targets)
    out = out.withColumns({
        "targets_total": total,
        "success_rate": F.col("successful_requests") / F.greatest("total_requests", F.lit(1))})
    if seconds is not None:
        out = out.withColumn("tweets_per_second", F.col("tweets_scraped") / max(float(seconds), 1.0))
    return out
