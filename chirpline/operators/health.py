"""Load, averages, status and ranking of feeds, computed from their attempt log."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirpline.functions.times import MICROS, age_seconds, minus_seconds, moment

# Limits per feed (per minute, per hour, at once), and of any other feed.
DEFAULT_QUOTAS = {"snscrape": (100, 3000, 10), "nitter": (30, 1000, 5)}
OTHER_QUOTA = (20, 500, 3)
OVERRIDE_QUOTA = (30, 1000, 5)
MIRROR_PER_MINUTE = 15
LIMITS = ("requests_per_minute", "requests_per_hour", "concurrent_requests")

# Decay of the averages and the status rules.
RESPONSE_DECAY, SUCCESS_DECAY = 0.8, 0.9
FAILED_STREAK, DEGRADED_SUCCESS, DEGRADED_SECONDS = 5, 0.7, 30.0


def quota_table(spark, overrides: dict | None = None) -> DataFrame:
    """Limits by feed: the defaults, with overrides whose missing limits get their own defaults."""
    rows = dict(DEFAULT_QUOTAS)
    for feed, limits in (overrides or {}).items():
        rows[feed] = tuple(limits.get(n, d) for n, d in zip(LIMITS, OVERRIDE_QUOTA))
    return spark.createDataFrame([(f, *q) for f, q in rows.items()], "feed string, " + ", ".join(f"{n} int" for n in LIMITS))


def with_limits(df: DataFrame, quotas: DataFrame) -> DataFrame:
    """Limits joined by feed; a feed without an entry gets the limits of any other feed."""
    joined = df.join(quotas, "feed", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(LIMITS, OTHER_QUOTA)})


def request_load(attempts: DataFrame, windows: dict | None = None) -> DataFrame:
    """What had been requested when each request started, one row per feed and moment.

    ``windows`` maps a name to ``(seconds, inclusive)``: how far back requests
    count, and whether one exactly that old still does. The result has
    ``<name>_count`` and ``<name>_oldest`` for each, the number of requests
    still ``active``, and ``n_requests`` starting at that very moment.

    The log of a feed is cut into buckets as long as the longest window. Each
    start is also shown to the bucket after its own, so all that a window looks
    back on lies in one bucket; what still runs at a bucket's beginning is a sum
    over the buckets before. No task holds more of a feed than two buckets.
    """
    windows = {"minute": (60, True), "hour": (3600, True)} if windows is None else windows
    names, shifts = list(windows), [sec * MICROS - (0 if inclusive else 1) for sec, inclusive in windows.values()]
    size = max([sec for sec, _ in windows.values()], default=3600) * MICROS
    start = F.unix_micros("ts")
    # one microsecond early, as "ended by now" is to be found by "strictly before now"
    end = start + F.greatest(F.round(F.coalesce(F.col("response_time"), F.lit(0.0)) * MICROS).cast("long") - 1, F.lit(0))
    bucket = F.floor(start / F.lit(size))

    def mark(kind, bucket, at, started, own, ended, origin=None):
        return F.struct(F.lit(kind).alias("kind"), bucket.alias("bucket"), at.alias("at"), F.lit(started).alias("started"), F.lit(own).alias("own"),
                        F.lit(ended).alias("ended"), (F.lit(None).cast("long") if origin is None else origin).alias("origin"))

    marks = attempts.select("feed", F.inline(F.array(
        mark(0, bucket, start, 1, 1, 0, start), mark(-1, bucket + 1, start, 1, 0, 0), mark(-2, F.floor(end / F.lit(size)), end, 0, 0, 1),
        *[mark(i + 1, bucket, start - s, 0, 0, 0, start) for i, s in enumerate(shifts)])))
    bases = marks.groupBy("feed", "bucket").agg((F.sum("own") - F.sum("ended")).alias("__more"))
    along = Window.partitionBy("feed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("feed", "bucket", F.coalesce(F.sum("__more").over(along), F.lit(0)).alias("__running"))
    before = Window.partitionBy("feed", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("feed", "bucket").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumns({f"__{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("started", "own", "ended")})
    if names:
        seen = seen.withColumn("__next", F.min(F.when(F.col("started") > 0, F.col("at"))).over(after))

    def of(kind, column):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    parts = [F.sum(F.when(F.col("kind") == 0, F.col("own"))).alias("n_requests"), (of(0, "__own") - of(0, "__ended")).alias("__here")]
    for i, name in enumerate(names):
        count = of(0, "__started") - of(i + 1, "__started")
        parts += [count.alias(f"{name}_count"), F.when(count > 0, F.timestamp_micros(of(i + 1, "__next"))).alias(f"{name}_oldest")]
    load = seen.filter("origin IS NOT NULL").groupBy("feed", "bucket", "origin").agg(*parts)
    return load.join(bases, ["feed", "bucket"]).select(
        "feed", F.timestamp_micros("origin").alias("ts"), "n_requests", *[f"{n}_{c}" for n in names for c in ("count", "oldest")],
        F.greatest(F.col("__here") + F.col("__running"), F.lit(0).cast("long")).alias("active"))


def _allowed() -> Column:
    return ((F.col("minute_count") < F.col("requests_per_minute"))
            & (F.col("hour_count") < F.col("requests_per_hour"))
            & (F.col("active") < F.col("concurrent_requests")))


def _wait(now: Column) -> Column:
    full = F.col("minute_count") >= F.col("requests_per_minute")
    left = F.greatest(F.lit(0.0), 60.0 - age_seconds(F.col("minute_oldest"), now))
    return F.when(~_allowed() & full, left).otherwise(0.0)


def quota_windows(attempts: DataFrame, quotas: DataFrame) -> DataFrame:
    """Whether the quota allowed a request at each moment of the log, and how long it had to wait."""
    return with_limits(request_load(attempts), quotas).withColumns({
        "allowed": _allowed(), "wait_time": _wait(F.col("ts"))})


def mirror_wait(attempts: DataFrame, per_minute: int = MIRROR_PER_MINUTE) -> DataFrame:
    """Requests of the last minute (exclusive) per mirror and the wait when they reach the limit."""
    load = request_load(attempts, {"mirror": (60, False)}).drop("active")
    left = F.greatest(F.lit(0.0), 60.0 - age_seconds(F.col("mirror_oldest"), F.col("ts")))
    return load.withColumn("wait_time", F.when(F.col("mirror_count") >= per_minute, left).otherwise(0.0))


def _folded(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, float]]) -> DataFrame:
    """What the values of each key add to moving averages, over all rows: ``n`` and, for each name, ``<name>_added`` and ``<name>_seed``.

    ``values`` maps a name to a column and its decay. A row weighs its decay to
    the power of the rows after it. Rows are dealt by range of key and order,
    whatever type the order has, into blocks that a large key and even one
    moment of it share. A block is reduced to its number of rows, its faded sum
    and its first value that is not zero; blocks are combined in their order,
    as many as there are tasks. ``<name>_seed`` is the weight that the first
    value that is not zero has beyond that of other rows.
    """
    dealt = rows.withColumn("__spread", F.xxhash64(*rows.columns)).repartitionByRange(*keys, *order, "__spread")
    dealt = dealt.withColumn("__block", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "__block").orderBy(*[F.desc(c) for c in order], F.desc("__spread"))
    aged = dealt.withColumn("__age", F.row_number().over(inside) - 1)
    parts = []
    for name, (column, decay) in values.items():
        faded = F.col(column) * F.pow(F.lit(decay), F.col("__age"))
        some = F.col(column) != 0
        parts += [F.sum(faded).alias(f"__{name}"), F.max_by(F.when(some, faded), F.when(some, F.col("__age"))).alias(f"__{name}_first")]
    blocks = aged.groupBy(*keys, "__block").agg(F.count("*").alias("__n"), *parts)
    later = Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    out = [F.sum("__n").alias("n")]
    for name, (_, decay) in values.items():
        fade, first = F.pow(F.lit(decay), F.col("__after")), F.col(f"__{name}_first")
        seed = F.min_by(first * fade, F.when(first.isNotNull(), F.col("__block")))
        out += [(F.sum(F.col(f"__{name}") * fade) * (1.0 - decay)).alias(f"{name}_added"),
                (F.coalesce(seed, F.lit(0.0)) * decay).alias(f"{name}_seed")]
    return blocks.groupBy(*keys).agg(*out)


def seeded_average(rows: DataFrame, keys: list[str], order: list[str], value: str, decay: float,
                   out: str = "average") -> DataFrame:
    """Exponential moving average per key over all its rows, seeded by the first value that is not zero."""
    used = rows.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("__v"))
    return _folded(used, keys, order, {"v": ("__v", decay)}).select(*keys, (F.col("v_added") + F.col("v_seed")).alias(out))


def averages(attempts: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    """Both moving averages of each feed.

    ``avg_response_time`` is seeded by the first value that is not zero;
    ``unseeded`` is what the same rows add to an average that has a past. A
    missing response time counts as zero.
    """
    used = attempts.select("feed", *order, F.coalesce("response_time", F.lit(0.0)).alias("__v"),
                           F.when(F.col("success"), 1.0).otherwise(0.0).alias("__ok"))
    folded = _folded(used, ["feed"], list(order), {"v": ("__v", RESPONSE_DECAY), "ok": ("__ok", SUCCESS_DECAY)})
    return folded.select(
        "feed", F.col("n").alias("n_attempts"), (F.pow(F.lit(SUCCESS_DECAY), F.col("n")) + F.col("ok_added")).alias("success_rate"),
        (F.col("v_added") + F.col("v_seed")).alias("avg_response_time"), F.col("v_added").alias("unseeded"))


def feed_averages(attempts: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    """Moving response time and success rate of each feed."""
    return averages(attempts, order).drop("n_attempts", "unseeded")


def failure_streaks(attempts: DataFrame, keys: list[str] = ("feed",), ok: Column | None = None) -> DataFrame:
    """Last success, last failure and the failures since the last success of each key."""
    good = F.col("success") if ok is None else ok
    log = attempts.select(*keys, "ts", good.alias("__ok"))
    last = log.groupBy(*keys).agg(F.max(F.when(F.col("__ok"), F.col("ts"))).alias("last_success"),
                                  F.max(F.when(~F.col("__ok"), F.col("ts"))).alias("last_failure"))
    # a key may hold most of the log: equal failures are merged, and a large key is split by adaptive execution
    failures = log.filter(~F.col("__ok")).groupBy(*keys, "ts").agg(F.count("*").alias("__n"))
    since = failures.join(last.select(*keys, "last_success"), list(keys)) \
        .filter(F.col("last_success").isNull() | (F.col("ts") > F.col("last_success"))) \
        .groupBy(*keys).agg(F.sum("__n").alias("consecutive_failures"))
    return last.join(since, list(keys), "left").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0).cast("long")))


def load_at(attempts: DataFrame, as_of) -> DataFrame:
    """Requests of the last minute and hour and requests still running at one moment, per feed."""
    now = moment(as_of)
    log = attempts.filter(F.col("ts") <= now)
    took = F.round(F.coalesce(F.col("response_time"), F.lit(0.0)) * MICROS).cast("long")
    minute, hour = F.col("ts") >= minus_seconds(now, 60), F.col("ts") >= minus_seconds(now, 3600)
    return log.groupBy("feed").agg(
        F.count_if(minute).alias("minute_count"), F.count_if(hour).alias("hour_count"),
        F.min(F.when(minute, F.col("ts"))).alias("minute_oldest"),
        F.count_if(F.unix_micros("ts") + took > F.unix_micros(now)).alias("active"))


def status() -> Column:
    return (F.when(F.col("consecutive_failures") >= FAILED_STREAK, "failed")
            .when(~F.col("can_make_request"), "rate_limited")
            .when((F.col("success_rate") < DEGRADED_SUCCESS) | (F.col("avg_response_time") > DEGRADED_SECONDS), "degraded")
            .when(F.col("last_success").isNull(), "unknown")
            .otherwise("healthy"))


def weight() -> Column:
    speed = F.greatest(F.lit(0.0), 1.0 - F.col("avg_response_time") / 30.0)
    return (F.col("success_rate") + speed) / 2.0


def feed_state(attempts: DataFrame, as_of, quotas: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    """One row per feed: load, limits, averages, streak, status, weight and wait at one moment."""
    now = moment(as_of)
    log = attempts.filter(F.col("ts") <= now)
    state = load_at(log, now).join(feed_averages(log, order), "feed").join(failure_streaks(log), "feed")
    return with_limits(state, quotas).withColumn("can_make_request", _allowed()).withColumns({
        "wait_time": _wait(now), "status": status(), "weight": weight()})


def _usable() -> Column:
    return F.col("can_make_request") & F.col("status").isin("healthy", "degraded", "unknown")


def ranked_feeds(state: DataFrame) -> DataFrame:
    """Usable feeds, best first: healthy ones before others, then by weight, then by name."""
    return state.filter(_usable()).orderBy(F.col("status") != "healthy", F.desc("weight"), "feed")


def best_feed(state: DataFrame) -> DataFrame:
    return ranked_feeds(state).limit(1)


def next_available(state: DataFrame) -> DataFrame:
    """The feed with the shortest wait, the first by name among equals."""
    first = F.struct("wait_time", "feed")
    return state.agg(F.min_by("feed", first).alias("feed"), F.min("wait_time").alias("wait_time"))


def choose_feed(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Each request's feed: the preferred one if usable, else the best one, else none."""
    best = best_feed(state).select("feed").scalar()
    usable = state.filter(_usable()).select(F.col("feed").alias("backend_preference"), F.lit(True).alias("__ok"))
    chosen = F.when(F.col("__ok"), F.col("backend_preference")).otherwise(best)
    return requests.join(usable, "backend_preference", "left").withColumn(
        "feed", chosen).drop("__ok")


def run_counters(attempts: DataFrame, as_of, quotas: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    """Per feed: requests processed and failed, with its state."""
    counts = attempts.groupBy("feed").agg(
        F.count_if("success").alias("requests_processed"), F.count_if(~F.col("success")).alias("requests_failed"))
    return counts.join(feed_state(attempts, as_of, quotas, order), "feed").select(
        "feed", "requests_processed", "requests_failed", "status", "success_rate", "avg_response_time", "active",
        "minute_count", "hour_count", "can_make_request", "wait_time")
