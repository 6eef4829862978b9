"""The given star-schema tables seen as posts, attempts, targets and requests."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chirpline import schema
from chirpline.session import run_dir
from chirpline.functions import text as tx

N_FEEDS = 3
FILE_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str, in_order: bool = False, files: int = 3) -> DataFrame:
    """The events as a stream of files landed one after the other, one for each batch.

    They are dealt to the files by hash, so that every batch after the first
    brings late rows, or by time with ``in_order``. A large batch is as many
    files as every other one, about one for ``FILE_ROWS`` rows, so that the
    number of batches does not grow with the table.
    """
    events, landed = table(spark, sf_dir, "events"), run_dir(spark, "landed")
    size = max(1, events.count() // (files * FILE_ROWS))
    part = F.pmod(F.xxhash64("event_id"), F.lit(files))
    if in_order:
        edges = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / files for k in range(1, files)])).first()[0] or []
        part = sum(((F.unix_micros(F.col("ts").cast("timestamp")) > e).cast("int") for e in edges), F.lit(0))
    for k in range(files):
        events.filter(part == k).repartition(size).write.mode("append").parquet(landed)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", size).parquet(landed)


def _name(user: Column) -> Column:
    return F.concat(F.lit("user"), user)


def posts_of(documents: DataFrame, events: DataFrame, also: list[str] = ()) -> DataFrame:
    """Each document as the post of the event with its number; not scored yet."""
    at = F.col("ts").cast("timestamp")
    joined = documents.join(events, F.col("doc_id") == F.col("event_id"))
    have = documents.columns
    return joined.select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.col("user_id").cast("string").alias("user_id"),
        _name(F.col("user_id")).alias("username"),
        (F.col("content") if "content" in have else tx.strip(F.col("text"))).alias("content"),
        at.alias("timestamp"),
        (at + F.make_dt_interval(secs=F.lit(30))).alias("scraped_at"),
        F.floor("value").cast("int").alias("likes"),
        F.floor(F.col("value") / 10).cast("int").alias("retweets"),
        (F.col("doc_id") % 7).cast("int").alias("replies"),
        (F.col("event_type") == "view").alias("is_reply"),
        (F.col("event_type") == "click").alias("is_retweet"),
        F.lit(None).cast("string").alias("reply_to"),
        F.col("source").alias("source_instance"),
        *[F.col(c) if c in have else F.lit(None).cast(schema.POSTS[c].dataType).alias(c) for c in schema.SENTIMENT],
        "lang", *also)


def posts(spark: SparkSession, sf_dir: str, also: list[str] = ()) -> DataFrame:
    """All posts."""
    documents = table(spark, sf_dir, "documents")
    return posts_of(documents, table(spark, sf_dir, "events"), also)


def scored_posts(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """Posts scored by ``score(df) -> df`` before they meet their events.

    The texts are read, scored and left behind: only scores go through the
    join's shuffle, unless a query wants the texts too.
    """
    documents = table(spark, sf_dir, "documents").withColumn("content", tx.strip(F.col("text"))).drop("text")
    return posts_of(score(documents), table(spark, sf_dir, "events"))


def rated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of which all but the replies already carry some score."""
    found = posts(spark, sf_dir)
    score = F.when(~F.col("is_reply"), F.least(F.col("likes") / 100.0, F.lit(1.0)))
    return found.withColumns({
        "sentiment_score": score,
        "sentiment_label": F.when(score.isNotNull(), F.when(score > 0.1, "positive").otherwise("neutral")),
        "sentiment_confidence": F.when(score.isNotNull(), F.lit(0.5)),
    })


def attempts_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("feed"), F.col("user_id") % N_FEEDS).alias("feed"),
        _name(F.col("user_id")).alias("target"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") / 10).alias("response_time"),
        "event_id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as a target, and every source of documents as a search term."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.lit("user").alias("target_type"), _name(F.col("user_id")).alias("value"),
        (1.0 + (F.col("user_id") % 3) * 0.1).alias("weight"), F.lit("").alias("description"))
    terms = table(spark, sf_dir, "documents").select("source").distinct().select(
        F.lit("search").alias("target_type"), F.col("source").alias("value"), F.lit(1.0).alias("weight"),
        F.lit("source").alias("description"))
    return users.unionByName(terms)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request for its user."""
    return table(spark, sf_dir, "events").select(
        F.lit("user").alias("target_type"), _name(F.col("user_id")).alias("value"),
        (F.col("user_id") % 4).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_id") % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        F.concat(F.lit("feed"), F.col("user_id") % 5).alias("backend_preference"), "event_id")
