"""Landed feeds, and their conversion to posts."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chirpline import schema
from chirpline.functions import text as tx
from chirpline.operators.skew import all_of, first_n, totals_before
from chirpline.session import stored

# Tags under which the feeds are stored.
RECORD_TAG, HTML_TAG, UNKNOWN = "snscrape", "nitter", "unknown"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON of the record feed."""
    return spark.read.schema(schema.RECORD_FEED).json(path)


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """One row per saved HTML file."""
    files = spark.read.option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("page_id"), F.col("_metadata.file_path").alias("url"),
                        F.col("value").alias("html"))


def first_records(records: DataFrame, max_rows: int = 100) -> DataFrame:
    """The first rows of each target, counted before any is converted or dropped."""
    return first_n(records, ["target"], [F.asc("feed_pos")], max_rows)


def first_items(items: DataFrame, n: int = 100, crawl: list[str] = (), page_order: str = "page_id", since: Column | None = None) -> DataFrame:
    """What a crawl reads of its timeline items until it has ``n`` posts and threads together; -1 reads all.

    A post counts when its link is new to the crawl, a thread with its closing
    item. Reading ends at the first post that finds ``n`` reached, and with the
    page on which they are reached, unless ``since`` holds for the crawl. Items
    of threads are not cut: those before that post stay, whatever the count.

    Counts run over pages within a crawl and over items within a page. A page
    is the largest group that one task holds. The items are written once,
    because they are read several times and pages are dear to parse; pass only
    the columns that are needed.
    """
    if n == -1:
        return items
    if n < 1:
        raise ValueError("n must be -1 or at least 1")
    items = stored(items, "items")
    page = [*crawl, page_order]
    own = [F.col(c) for c in page]
    known = F.col("kind").isin("post", "thread")
    first = items.filter(known).groupBy(*crawl, "link").agg(F.min(F.struct(F.col(page_order).alias("page"), F.col("pos"))).alias("at"))
    new = first.groupBy(*[F.col(c).alias(f"__{c}") for c in crawl], F.col("at.page").alias(f"__{page_order}")).agg(F.collect_list("at.pos").alias("__new"))

    def with_page(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, all_of([c.eqNullSafe(F.col(f"__{name}")) for c, name in zip(own, page)]), "left").drop(*[f"__{c}" for c in page])

    counts = (F.col("kind") == "post") & F.array_contains("__new", F.col("pos")) | F.col("is_thread_end")
    rows = with_page(items, new).withColumn("__counts", F.coalesce(counts, F.lit(False)).cast("long")).drop("__new")
    pages = totals_before(rows.groupBy(*page).agg(F.sum("__counts").alias("__n")), list(crawl), [page_order], "__n", "__before")
    rows = with_page(rows, pages.select(*[F.col(c).alias(f"__{c}") for c in page], "__before"))
    along = Window.partitionBy(*page).orderBy("pos")
    so_far = F.col("__before") + F.coalesce(F.sum("__counts").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (F.col("kind") == "post") & (F.col("__so_far") >= n)
    rows = rows.withColumn("__so_far", so_far).withColumn("__ended", F.max(ends).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    open_page = F.col("__before") < n
    if since is not None:
        last = rows.filter("__ended").groupBy(*[F.col(c).alias(f"__{c}") for c in crawl]).agg(F.min(page_order).alias("__last"))
        rows = rows.join(last, all_of([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in crawl]), "left")
        open_page = open_page | (since & (F.col("__last").isNull() | (F.col(page_order) <= F.col("__last"))))
    return rows.filter(open_page & ~F.col("__ended")).select(*items.columns)


def feed_place(rows: DataFrame, place: list[str] = ("feed_pos",)) -> list[Column]:
    """``feed_pos``, which orders the rows of a feed, if the rows have what makes it."""
    known = [c for c in place if c in rows.columns]
    return [(F.col(known[0]) if len(known) == 1 else F.struct(*known)).alias("feed_pos")] if known and len(known) == len(place) else []


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def posts_from_records(records: DataFrame, default_username: Column | None = None, now: Column | None = None) -> DataFrame:
    """Record feed to posts; rows still have to pass the record rules."""
    user = F.col("user")
    fallback = _filled(default_username) if default_username is not None else F.lit(None).cast("string")
    name = F.coalesce(_filled(user["username"]), fallback, F.lit(UNKNOWN))
    now = F.current_timestamp() if now is None else now
    return records.select(
        F.coalesce(F.col("id").cast("string"), F.lit(UNKNOWN)).alias("tweet_id"),
        F.coalesce(user["id"].cast("string"), name).alias("user_id"),
        name.alias("username"),
        F.coalesce("rawContent", "content", F.lit("")).alias("content"),
        F.coalesce(F.col("date"), now).alias("timestamp"),
        now.alias("scraped_at"),
        F.coalesce("likeCount", F.lit(0)).alias("likes"),
        F.coalesce("retweetCount", F.lit(0)).alias("retweets"),
        F.coalesce("replyCount", F.lit(0)).alias("replies"),
        F.lit(False).alias("is_reply"), F.lit(False).alias("is_retweet"), F.lit(None).cast("string").alias("reply_to"),
        F.lit(RECORD_TAG).alias("source_instance"),
        *[F.lit(None).cast(schema.POSTS[c].dataType).alias(c) for c in schema.SENTIMENT],
        F.col("date").isNull().alias("timestamp_imputed"), *feed_place(records))


def posts_from_html(items: DataFrame, mirror: Column, default_username: Column | None = None, now: Column | None = None,
                    place: list[str] = ()) -> DataFrame:
    """Extracted HTML posts to posts. ``place`` names the columns that order the items of a feed.

    A date that cannot be read becomes the collection time, and
    ``timestamp_imputed`` says so.
    """
    user, stats = F.col("user"), F.col("stats")
    fallback = _filled(default_username) if default_username is not None else F.lit(None).cast("string")
    name = F.coalesce(_filled(user["username"]), fallback, F.lit(UNKNOWN))
    now = F.current_timestamp() if now is None else now
    at = tx.parse_date(F.col("date"))
    return items.select(
        tx.id_from_link(F.col("link")).alias("tweet_id"), name.alias("user_id"), name.alias("username"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce(at, now).alias("timestamp"), now.alias("scraped_at"),
        F.coalesce(stats["likes"], F.lit(0)).alias("likes"),
        F.coalesce(stats["retweets"], F.lit(0)).alias("retweets"),
        F.coalesce(stats["comments"], F.lit(0)).alias("replies"),
        (F.size("replying_to") > 0).alias("is_reply"), F.col("is_retweet"),
        F.get("replying_to", F.lit(0)).alias("reply_to"),
        tx.feed_tag(HTML_TAG, mirror).alias("source_instance"),
        *[F.lit(None).cast(schema.POSTS[c].dataType).alias(c) for c in schema.SENTIMENT],
        at.isNull().alias("timestamp_imputed"), *feed_place(items, place))


def targets_from(spark: SparkSession, accounts: dict) -> DataFrame:
    """Targets from a parsed accounts file: users first, then search terms."""
    def rows(section, kind, key):
        return [(kind, t[key], float(t.get("weight", 1.0)), t.get("description", "") or "")
                for t in (accounts.get(section) or [])]

    users = spark.createDataFrame(rows("users", "user", "name"), schema.TARGETS)
    return users.unionByName(spark.createDataFrame(rows("terms", "search", "query"), schema.TARGETS))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a JSON accounts file with lists of ``users`` and ``terms``, in any store that Spark reads. Entries without a name are left out."""
    entry = "struct<name:string,query:string,weight:double,description:string>"
    found = spark.read.schema(f"users array<{entry}>, terms array<{entry}>").option("multiLine", True).json(path)

    def section(name, kind, key):
        one = found.select(F.explode(name).alias("t")).filter(F.col(f"t.{key}").isNotNull())
        return one.select(F.lit(kind).alias("target_type"), F.col(f"t.{key}").alias("value"), F.coalesce("t.weight", F.lit(1.0)).alias("weight"),
                          F.coalesce("t.description", F.lit("")).alias("description"))

    return section("users", "user", "name").unionByName(section("terms", "search", "query"))


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a YAML file; a missing or unreadable file gives none."""
    try:
        import yaml
    except ImportError:
        raise RuntimeError("reading a targets file needs PyYAML; pass its content to targets_from instead") from None
    try:
        with open(path, encoding="utf-8") as f:
            return targets_from(spark, yaml.safe_load(f) or {})
    except (OSError, yaml.YAMLError, KeyError, TypeError, AttributeError):
        return targets_from(spark, {})
