"""The posts table as date-partitioned Parquet with snapshots and an index of ids, and its export ledger."""

import uuid
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chirpline import schema
from chirpline.functions.times import minus_seconds, moment, utc_date
from chirpline.operators import aggregate, filters, keyed, validate
from chirpline.operators.skew import all_of
from chirpline.session import file_system, run_dir
from chirpline.sources.snapshots import Snapshot, SnapshotLog

PARTITION = "post_date"
FORMATS = ("json", "csv", "parquet")
STORED = T.StructType([*schema.POSTS.fields, T.StructField(PARTITION, T.DateType())])
INDEX = T.StructType([T.StructField("tweet_id", T.StringType()), T.StructField("day", T.DateType()),
                      T.StructField("since", T.LongType()), T.StructField("bucket", T.IntegerType())])
#: Buckets of the index at first, entries of one from which on their number doubles, and runs of one after which they become one.
BUCKETS, BUCKET_ENTRIES, BUCKET_RUNS = 64, 1_000_000, 8


class PostTable:
    """Posts under ``path/posts`` (a folder per UTC day and run), their snapshots and index, and exports under ``path/exports``.

    A change writes the days it touches anew, into a folder of its own, and
    then publishes a snapshot that names it. What reads the table sees whole
    changes only, and a change that fails leaves the table as it was. The table
    has one writer at a time. Folders that no snapshot names go with ``vacuum``.

    The index says on which day an id lies. It is dealt into buckets by hash; a
    change reads the buckets of its own ids and adds a file to each. An id's
    last entry counts, and one for a day without the id costs no more than a
    look at that day.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_entries: int = BUCKET_ENTRIES):
        self.spark, self.path = spark, path.rstrip("/")
        self.posts_path, self.ids_path, self.exports_path = (f"{self.path}/{n}" for n in ("posts", "ids", "exports"))
        self.buckets, self.bucket_entries = buckets, bucket_entries
        self.log = SnapshotLog(spark, f"{self.path}/snapshots")
        if self.log.read() is None:
            self.log.publish(Snapshot(1, buckets=buckets))
        if not self._exists(self.exports_path):
            spark.createDataFrame([], schema.EXPORTS).write.parquet(self.exports_path)

    def _fs(self, folder: str):
        return file_system(self.spark, folder)

    def _exists(self, folder: str) -> bool:
        fs, target = self._fs(folder)
        return fs.exists(target)

    def _folders(self, at: Snapshot, days=None) -> list[str]:
        return [f"{self.posts_path}/run={at.days[d]}/{PARTITION}={d}" for d in (at.days if days is None else days) if d in at.days]

    def _days(self, at: Snapshot | None = None, days=None) -> DataFrame:
        """The rows of a snapshot (the last one), of some of its days or of all."""
        found = self._folders(at or self.log.read(), days)
        if not found:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", self.posts_path).parquet(*found).select(*STORED.names)

    def read(self) -> DataFrame:
        """All posts."""
        return self._days().select(*schema.POSTS.names)

    def query(self, start_time=None, end_time=None, tweet_id: str | None = None, **rest) -> DataFrame:
        """Filtered posts; time bounds prune the days, and an id is looked up in the index.

        Rows of a day lie in the order of their ids, and its files carry Bloom
        filters of them, so that most of a day is skipped for an id.
        """
        at = self.log.read()
        days = self._days(at, self._days_of(self.spark.range(1).select(F.lit(tweet_id).alias("tweet_id")), at) if tweet_id else None)
        if start_time is not None:
            days = days.filter(F.col(PARTITION) >= utc_date(moment(start_time)))
        if end_time is not None:
            days = days.filter(F.col(PARTITION) <= utc_date(moment(end_time)))
        return filters.get_posts(days.select(*schema.POSTS.names), start_time=start_time, end_time=end_time, tweet_id=tweet_id, **rest)

    def exports(self) -> DataFrame:
        return self.spark.read.schema(schema.EXPORTS).parquet(self.exports_path)

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by day into a run of their own: its days and the run."""
        run = f"r{uuid.uuid4().hex}"
        folder = f"{self.posts_path}/run={run}"
        dated = rows.select(*schema.POSTS.names, utc_date(F.col("timestamp")).alias(PARTITION))
        # adaptive execution splits the large days and joins the small ones
        sorted_ = dated.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, "tweet_id")
        sorted_.write.options(**{"parquet.bloom.filter.enabled#tweet_id": "true"}).partitionBy(PARTITION).parquet(folder)
        fs, target = self._fs(folder)
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        return {n.partition("=")[2]: run for n in names if n.startswith(f"{PARTITION}=")}

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64("tweet_id"), F.lit(count)).cast("int")

    def _index(self, at: Snapshot, buckets=None) -> DataFrame:
        """Entries of some buckets, or of all."""
        folders = [f"{self.ids_path}/run={r}/bucket={b}" for b in (at.ids if buckets is None else buckets) for r in at.ids.get(b, ())]
        if not folders:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).option("basePath", self.ids_path).parquet(*folders).select(*INDEX.names)

    def _days_of(self, ids: DataFrame, at: Snapshot) -> list[str]:
        """The days on which ids may lie, by the buckets of these ids alone."""
        touched = [r[0] for r in ids.select(self._bucket(at.buckets).alias("b")).distinct().collect()]
        last = self._index(at, touched).join(ids, "tweet_id", "left_semi").groupBy("tweet_id").agg(F.max_by("day", "since").alias("day"))
        return [d for d in (str(r[0]) for r in last.select("day").distinct().collect()) if d in at.days]

    def _indexed(self, added: DataFrame, at: Snapshot, number: int) -> dict:
        """The index with entries for the rows added (tweet_id, day): what of a snapshot changes with it."""
        def store(entries: DataFrame, count: int) -> dict[int, str]:
            run = f"r{uuid.uuid4().hex}"
            folder = f"{self.ids_path}/run={run}"
            entries.withColumn("bucket", self._bucket(count)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
            fs, target = self._fs(folder)
            names = [f.getPath().getName() for f in fs.listStatus(target)]
            return {int(n.partition("=")[2]): run for n in names if n.startswith("bucket=")}

        fresh = added.select("tweet_id", "day", F.lit(number).cast("long").alias("since"))
        ids = {b: list(runs) for b, runs in at.ids.items()}
        for b, run in store(fresh, at.buckets).items():
            ids.setdefault(b, []).append(run)
        count = at.n_ids + added.count()
        with_new = replace(at, ids=ids, n_ids=count)
        # few buckets grow long at a time; all are dealt anew when their number doubles
        many = at.buckets
        while count > many * self.bucket_entries:
            many *= 2
        long = list(ids) if many > at.buckets else [b for b, runs in ids.items() if len(runs) > BUCKET_RUNS]
        if long:
            last = self._index(with_new, long).groupBy("tweet_id").agg(F.max_by(F.struct("day", "since"), "since").alias("e")).select("tweet_id", "e.day", "e.since")
            ids = {b: runs for b, runs in ids.items() if b not in long}
            ids.update({b: [run] for b, run in store(last, many).items()})
            if many > at.buckets:
                count = self._index(replace(at, ids=ids)).count()
        return {"ids": ids, "n_ids": count, "buckets": many}

    def _replace(self, at: Snapshot, touched, rows: DataFrame | None, **index) -> None:
        """Publish a snapshot with ``rows`` in the place of some days."""
        days = {d: run for d, run in at.days.items() if d not in set(touched)}
        if rows is not None:
            days.update(self._written(rows))
        self.log.publish(replace(at, number=at.number + 1, days=days, **index))

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last ``keep`` snapshots names; returns how many. Not while older ones are being read."""
        alive = self.log.forget(keep)
        named = {f for at in alive for f in self._folders(at)} | {
            f"{self.ids_path}/run={r}/bucket={b}" for at in alive for b, runs in at.ids.items() for r in runs}
        gone = 0
        for root in (self.posts_path, self.ids_path):
            if self._exists(root):
                fs, target = self._fs(root)
                for run in fs.listStatus(target):
                    folder = f"{root}/{run.getPath().getName()}"
                    parts = [f"{folder}/{p.getPath().getName()}" for p in fs.listStatus(run.getPath()) if "=" in p.getPath().getName()]
                    dead = [p for p in parts if p not in named]
                    for path in ([folder] if len(dead) == len(parts) else dead):
                        fs.delete(self._fs(path)[1], True)
                    gone += len(dead)
        return gone

    @staticmethod
    def _day_list(dates: DataFrame) -> list[str]:
        """The distinct days of a frame: one value per day, whatever its number of rows."""
        return [str(r[0]) for r in dates.distinct().collect()]

    @contextmanager
    def _staged(self, rows: DataFrame, purpose: str):
        """Rows written to the shared folder for the time of a change, which reads them several times and must see the same ones."""
        folder = run_dir(self.spark, purpose)
        rows.write.parquet(folder)
        try:
            yield self.spark.read.schema(rows.schema).parquet(folder)
        finally:
            fs, target = self._fs(folder)
            fs.delete(target, True)

    def upsert(self, batch: DataFrame, order: list[str] | None = None, mode: str = "replace") -> int:
        """Insert or replace valid posts by id, the last one of each id; returns the number submitted.

        Without ``order`` the collection time decides, then the place in the
        feed (``feed_pos``) if the batch carries it. An order that does not
        decide between different rows of one id is refused.
        """
        order = list(order) if order else ["scraped_at", *(["feed_pos"] if "feed_pos" in batch.columns else [])]
        with self._staged(validate.valid_posts(batch), "batch") as checked:
            self._decided(checked, ["tweet_id"], order)
            return self._upsert(checked, order, mode)

    @staticmethod
    def _decided(rows: DataFrame, keys: list[str], order: list[str]) -> None:
        # whole rows are compared only where a place is taken twice
        shared = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in (*keys, *order)]).agg(F.count("*").alias("__n")).filter("__n > 1")
        same = all_of([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, *order)])
        values = F.struct(*[c for c in rows.columns if c not in keys])
        places = rows.join(shared, same, "left_semi").groupBy(*keys, *order).agg(F.min(values).alias("a"), F.max(values).alias("b"))
        if not shared.isEmpty() and not places.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
            raise ValueError(f"the order ({', '.join(order) or 'none'}) does not decide between rows of one id; add a column that does")

    def _upsert(self, checked: DataFrame, order: list[str], mode: str) -> int:
        submitted = checked.count()
        if not submitted:
            return 0
        at = self.log.read()
        ids = checked.select("tweet_id").distinct()
        # a batch that names no id twice is taken as it is: its texts need no shuffle to find the last of each id
        single = ids.count() == submitted
        new = self._day_list(checked.select(utc_date(F.col("timestamp"))))
        touched = sorted({*self._days_of(ids, at), *new})
        part = self._days(at, touched).select(*schema.POSTS.names)
        last = (checked if single else keyed.latest_by_key(checked, ["tweet_id"], list(order))).select("tweet_id", utc_date(F.col("timestamp")).alias("day"))
        self._replace(at, touched, keyed.upsert(part, checked, list(order), mode, single), **self._indexed(last, at, at.number + 1))
        return submitted

    def apply_scores(self, scores: DataFrame, order: list[str] = ()) -> None:
        """Write scores ``(tweet_id, score, label, confidence)`` by id."""
        with self._staged(scores, "scores") as fixed:
            self._decided(fixed, ["tweet_id"], list(order))
            at = self.log.read()
            touched = self._days_of(fixed.select("tweet_id").distinct(), at)
            if touched:
                part = self._days(at, touched).select(*schema.POSTS.names)
                self._replace(at, touched, keyed.apply_scores(part, fixed, order))

    def rescore(self, score, only_missing: bool = True) -> dict:
        """Score posts with ``score(df) -> df`` in place; returns the run's counters.

        Rows are scored where they lie: no join, and days without work stay.
        """
        at = self.log.read()
        per_day = filters.unscored(self._days(at), only_missing).groupBy(PARTITION).agg(F.count("*").alias("n")).collect()
        touched, processed = [str(r[PARTITION]) for r in per_day], sum(r["n"] for r in per_day)
        left = 0
        if touched:
            part = self._days(at, touched).select(*schema.POSTS.names)
            due = F.col("__due")
            marked = score(part.withColumns({
                "__due": F.col("sentiment_score").isNull() if only_missing else F.lit(True),
                **{f"__{c}": F.col(c) for c in schema.SENTIMENT}}))
            self._replace(at, touched, marked.select(*[
                F.when(due, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in schema.SENTIMENT else F.col(c)
                for c in schema.POSTS.names]))
            left = self._days(days=touched).filter(F.col("sentiment_score").isNull()).count()
        return {"tweets_processed": processed, "tweets_updated": processed - left, "errors": left,
                "success_rate": (processed - left) / max(processed, 1)}

    def cleanup_old_data(self, days: float, as_of=None) -> int:
        """Remove posts older than so many days; returns how many.

        Days that lie wholly before the cutoff leave the snapshot unread. Only
        the day of the cutoff is written anew. Files go with ``vacuum``.
        """
        now = moment(as_of) if as_of is not None else F.current_timestamp()
        cutoff = self.spark.range(1).select(minus_seconds(now, days * 86_400).alias("c")).select(
            F.unix_micros("c").alias("us"), utc_date(F.col("c")).alias("d")).first()
        limit, edge, at = F.timestamp_micros(F.lit(cutoff["us"])), str(cutoff["d"]), self.log.read()
        before = [d for d in at.days if d < edge]
        # counting whole days takes no column at all
        gone = self._days(at, before).count()
        last = self._days(at, [edge])
        old, n = last.agg(F.count_if(F.col("timestamp") < limit), F.count("*")).first()
        if gone + old:
            self._replace(at, [*before, *([edge] if old else [])], keyed.retained(last, limit) if 0 < old < n else None)
        return gone + old

    def clear(self, confirm: bool = False) -> int:
        """Empty the table; returns how many posts went. Does nothing unless confirmed."""
        at = self.log.read()
        count = self._days(at).count()
        if confirm:
            self._replace(at, at.days, None, ids={}, n_ids=0)
        return count

    def export_to_parquet(self, target: str) -> bool:
        """The whole table, newest first, and an entry in the ledger."""
        self.export("parquet", target, ordered=True)
        return True

    def export(self, fmt: str = "json", target: str | None = None, with_sentiment: bool = False, ordered: bool = False) -> int:
        """Write posts in a format; returns the number of rows, which the ledger records too.

        ``ordered`` sorts by time. The id breaks ties, so posts of one moment
        can still be split between tasks.
        """
        if fmt not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        target = target or f"{self.path}/tweets_export.{fmt}"
        rows = filters.get_posts(self.read(), with_sentiment=with_sentiment, ordered=ordered)
        # microseconds are kept in text formats too
        writer = rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(target)
        count = filters.get_posts(self.read(), with_sentiment=with_sentiment).count()
        ledger_row(self.spark, fmt, target, count).write.mode("append").parquet(self.exports_path)
        return count

    def stats(self) -> DataFrame:
        return aggregate.table_stats(self.read())

    def size_mb(self) -> DataFrame:
        return file_sizes(self.spark, self._folders(self.log.read()))


def ledger_row(spark: SparkSession, export_type: str, target: str, n: int, checksum: str | None = None) -> DataFrame:
    return spark.range(1).select(
        F.uuid().alias("export_id"), F.lit(export_type).alias("export_type"), F.lit(target).alias("file_path"),
        F.lit(n).cast("long").alias("row_count"), F.current_timestamp().alias("exported_at"),
        F.lit(checksum).cast("string").alias("checksum"))


def file_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Megabytes of the Parquet files under a path or several: one row per file is looked at, and no content."""
    if not path:
        return spark.range(1).select(F.lit(0.0).alias("size_mb"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / (1024.0 * 1024.0)).alias("size_mb"))
