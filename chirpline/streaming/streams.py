"""Continuous ingest, scoring, rolling summaries and feed health as Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from chirpline.functions.scoring import Scorer, make_scorer, score_posts
from chirpline.functions.times import utc_date
from chirpline.operators import health
from chirpline.operators.aggregate import rolling_cells, windows_of_cells
from chirpline.operators.skew import first_n
from chirpline.operators.validate import valid_posts
from chirpline.schema import HEALTH
from chirpline.session import run_dir
from chirpline.sources.store import PostTable

EVERY = "30 seconds"


def read_landed(spark: SparkSession, path: str, fields: StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files landing under a path, as a stream."""
    reader = spark.readStream.schema(fields).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to Parquet files."""
    return _start(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), once)


def upsert_stream(stream: DataFrame, table: PostTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upsert every batch; late and repeated posts replace. A batch that is run again changes nothing."""
    def store(batch: DataFrame, _: int) -> None:
        table.upsert(batch)

    return _start(stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), once)


def deduplicated(stream: DataFrame, delay: str = "1 hour", key: str = "tweet_id", at: str = "timestamp") -> DataFrame:
    """Each id once within the delay. Opt-in: rows later than the watermark are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def scored(stream: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Valid posts with scores; stateless."""
    return score_posts(valid_posts(stream), scorer or make_scorer())


def rolling_stream(stream: DataFrame, slide: str = "5 minutes", by: list[str] = (), delay: str | None = None) -> DataFrame:
    """Cells of a rolling summary as a stream.

    Cells are the only state. Windows are put together from them when read,
    so a window three cells wide does not triple the state. Without a
    ``delay`` late posts always count and the state keeps every cell.
    """
    return rolling_cells(stream.withWatermark("timestamp", delay) if delay else stream, slide, by)


def write_cells(cells: DataFrame, path: str, checkpoint: str, by: list[str] = (), once: bool = False) -> StreamingQuery:
    """Keep the last state of every cell, in one folder per UTC day.

    A batch rewrites the days of its cells. Run again, it writes the same.
    """
    spark = cells.sparkSession
    fields = StructType([*cells.schema.fields, StructField("day", DateType())])
    on = ["cell", *by]

    def store(batch: DataFrame, number: int) -> None:
        staged = f"{path}_changed"
        batch.withColumn("day", utc_date(F.col("cell.start"))).write.mode("overwrite").parquet(staged)
        changed = spark.read.schema(fields).parquet(staged)
        days = [r[0] for r in changed.select("day").distinct().collect()]
        if number:
            old = spark.read.schema(fields).parquet(path).filter(F.col("day").isin(days))
            kept = old.join(changed.select(*on), on, "left_anti").select(*fields.names).unionByName(changed)
        else:
            kept = changed
        kept.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return _start(cells.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint), once)


def rolling_from_cells(spark: SparkSession, path: str, fields: StructType, window: str = "15 minutes",
                       slide: str = "5 minutes", by: list[str] = ()) -> DataFrame:
    """Rolling windows from the last state of each cell."""
    return windows_of_cells(spark.read.schema(fields).parquet(path), window, slide, by)


LAST_HEALTH = StructType([*HEALTH.fields, StructField("batch", LongType())])


def fold_health(state: DataFrame, batch: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    """Health per feed after a further batch of attempts.

    Both averages are linear in what came before: the state is scaled down by
    the number of new attempts and the batch's own weighted sum is added. So a
    batch is reduced like any aggregation, and no feed's attempts have to pass
    through one task in order.
    """
    last = batch.groupBy("feed").agg(F.max(F.when(F.col("success"), F.col("ts"))).alias("ok"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("bad"))
    own = health.averages(batch, list(order)).select(
        "feed", F.col("n_attempts").alias("m"), F.col("success_rate").alias("rate"), F.col("avg_response_time").alias("seeded"),
        F.col("unseeded").alias("added"))
    both = state.join(own.join(last, "feed"), "feed", "full_outer").withColumn("newest", F.greatest("last_success", "ok"))
    # failures that come late, from before the last success, do not count
    failures = batch.filter(~F.col("success")).groupBy("feed", "ts").agg(F.count("*").alias("k"))
    since = failures.join(both.select("feed", "newest"), "feed").filter(F.col("newest").isNull() | (F.col("ts") > F.col("newest")))
    both = both.join(since.groupBy("feed").agg(F.sum("k").alias("streak")), "feed", "left")
    n, m = F.coalesce("n_attempts", F.lit(0).cast("long")), F.coalesce("m", F.lit(0).cast("long"))
    old_rate, old_time = F.coalesce("success_rate", F.lit(1.0)), F.coalesce("avg_response_time", F.lit(0.0))
    faded = F.pow(F.lit(health.SUCCESS_DECAY), m)
    quiet = F.col("m").isNull()
    zero = F.lit(0).cast("long")
    past = F.when(F.col("ok").isNotNull() & (F.col("last_success").isNull() | (F.col("ok") > F.col("last_success"))), zero)
    return both.select(
        "feed", (n + m).alias("n_attempts"),
        # the batch's own rate starts from 1.0: replace that start by the state
        F.when(quiet, old_rate).otherwise(F.col("rate") - faded + faded * old_rate).alias("success_rate"),
        F.when(quiet, old_time).when(old_time == 0, F.col("seeded")).otherwise(
            F.pow(F.lit(health.RESPONSE_DECAY), m) * old_time + F.col("added")).alias("avg_response_time"),
        F.col("newest").alias("last_success"),
        F.greatest("last_failure", "bad").alias("last_failure"),
        (past.otherwise(F.coalesce("consecutive_failures", zero)) + F.coalesce("streak", zero)).alias("consecutive_failures"))


def health_stream(attempts: DataFrame, path: str, checkpoint: str, order: list[str] = ("ts",), once: bool = False) -> StreamingQuery:
    """Fold every batch of attempts into the health table.

    Two folders take turns: a batch reads the one its predecessor wrote and
    writes the other, so it can be run again.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark, turn = batch.sparkSession, number % 2
        staged = f"{path}/attempts"
        batch.write.mode("overwrite").parquet(staged)
        before = spark.read.schema(HEALTH).parquet(f"{path}/health/turn={1 - turn}") if number else spark.createDataFrame([], HEALTH)
        if not number:  # what an earlier run left in the other folder must not look newer
            spark.createDataFrame([], LAST_HEALTH).write.mode("overwrite").parquet(f"{path}/health/turn={1 - turn}")
        after = fold_health(before, spark.read.schema(batch.schema).parquet(staged), order)
        after.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/health/turn={turn}")

    return _start(attempts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), once)


def latest_health(spark: SparkSession, path: str) -> DataFrame:
    """The health table after the last batch."""
    both = spark.read.schema(LAST_HEALTH).parquet(f"{path}/health")
    return first_n(both, ["feed"], [F.desc("batch")], 1).select(*HEALTH.names)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_into(stream: DataFrame, start: Callable, purpose: str) -> str:
    """Run a stream over what is there now, in new folders of the shared one; returns the output path."""
    base = run_dir(stream.sparkSession, purpose)
    run_to_end(start(stream, f"{base}/out", f"{base}/checkpoint", once=True))
    return f"{base}/out"
