"""Selecting posts: by user, id, time and sentiment, and by search terms."""

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chirpline.functions import text as tx
from chirpline.functions.times import moment
from chirpline.operators.skew import all_of, first_n, totals_before


#: Rows up to which a limit is a top-k that ends in one task.
TOP_ROWS = 100_000


def newest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest posts first.

    A small limit is a top-k. A large one is a cut: rows are counted by moment,
    counts are added up from the newest moment on in many tasks, and the rows
    of the moments that fit stay, of the moment on the limit those that come
    first by id. The rest is a sort by range.
    """
    order = [F.desc("timestamp"), F.asc("tweet_id")]
    if not limit:
        return df.orderBy(*order)
    if limit <= TOP_ROWS:
        return df.orderBy(*order).limit(limit)
    # moments count down from now on; posts without a time come last, as in a sort
    back = F.coalesce(-F.unix_micros("timestamp"), F.lit((1 << 63) - 1))
    moments = df.groupBy(back.alias("__back")).agg(F.count("*").alias("__n")).withColumn("__all", F.lit(0))
    placed = totals_before(moments, ["__all"], ["__back"], "__n", "__before")
    whole = placed.filter(F.col("__before") + F.col("__n") <= limit).select("__back")
    edge = placed.filter((F.col("__before") < limit) & (F.col("__before") + F.col("__n") > limit)).first()
    marked = df.withColumn("__back", back)
    kept = marked.join(whole, "__back", "left_semi")
    if edge is not None:
        kept = kept.unionByName(first_n(marked.filter(F.col("__back") == edge["__back"]), ["__back"], [F.asc("tweet_id")], limit - edge["__before"]))
    return kept.select(*df.columns).orderBy(*order)


def get_posts(posts: DataFrame, username: str | None = None, tweet_id: str | None = None, start_time=None,
              end_time=None, limit: int | None = None, with_sentiment: bool = False,
              ordered: bool = False) -> DataFrame:
    """Posts that pass every given filter; an empty argument is no filter.

    Both time bounds are inclusive. A limit returns the newest posts. Without
    one the result is unordered unless ``ordered`` asks for the full sort.
    """
    tests = []
    if username:
        tests.append(F.col("username") == username)
    if tweet_id:
        tests.append(F.col("tweet_id") == tweet_id)
    if start_time is not None:
        tests.append(F.col("timestamp") >= moment(start_time))
    if end_time is not None:
        tests.append(F.col("timestamp") <= moment(end_time))
    if with_sentiment:
        tests.append(F.col("sentiment_score").isNotNull())
    kept = posts.filter(all_of(tests)) if tests else posts
    return newest_first(kept, limit) if limit or ordered else kept


def unscored(posts: DataFrame, only_missing: bool = True) -> DataFrame:
    return posts.filter(F.col("sentiment_score").isNull()) if only_missing else posts


def latest_scored(posts: DataFrame, limit: int = 10) -> DataFrame:
    """The newest scored posts in the serving layout; 1 to 100 of them."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = get_posts(posts.filter(F.col("sentiment_label").isNotNull()), limit=limit, with_sentiment=True)
    return rows.select("tweet_id", "content", "sentiment_score", "sentiment_label",
                       F.col("sentiment_confidence").alias("confidence"), "timestamp", "username")


# Names of content filters, and the first day a search may ask for.
CONTENT_FILTERS = (
    "nativeretweets", "media", "videos", "news", "verified", "native_video",
    "replies", "links", "images", "safe", "quote", "pro_video",
)
DAY_BEFORE_FIRST = dt.date(2006, 3, 21)
MODES = ("term", "hashtag", "user")


def is_valid_search_date(text: Column, today: Column | None = None) -> Column:
    """``YYYY-MM-DD``, a real day, after the first day and not after today."""
    shaped = F.coalesce(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False))
    day = F.when(shaped, text.try_cast("date"))
    last = F.current_date() if today is None else today
    return F.coalesce((day > F.lit(DAY_BEFORE_FIRST)) & (day <= last), F.lit(False))


def _search_day(name: str, value: str) -> dt.date:
    try:
        day = dt.date.fromisoformat(value) if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value) else None
    except ValueError:
        day = None
    if day is None or not DAY_BEFORE_FIRST < day <= dt.datetime.now(dt.timezone.utc).date():
        raise ValueError(f"invalid '{name}' date: use the YYYY-MM-DD format and a valid day")
    return day


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def content_flag(df: DataFrame, name: str) -> Column:
    """Whether a post passes one content filter, from the columns at hand."""
    if name not in CONTENT_FILTERS:
        raise ValueError(f"invalid filter '{name}'; valid filters are: {', '.join(CONTENT_FILTERS)}")
    if _has(df, name) and name != "replies" and not isinstance(df.schema[name].dataType, T.ArrayType):
        # "replies" is also the name of the reply counter, "videos" that of a list of them
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    filled = [c for c in ("pictures", "videos", "gifs") if _has(df, c)]

    def some(*columns):
        tests = [F.size(F.coalesce(F.col(c), F.array())) > 0 for c in columns if c in filled]
        if not tests:
            raise ValueError(f"filter '{name}' needs the media columns")
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    if name == "replies":
        return F.col("is_reply")
    if name == "nativeretweets":
        return F.col("is_retweet")
    if name == "images":
        return some("pictures")
    if name in ("videos", "native_video"):
        return some("videos", "gifs")
    if name == "media":
        return some("pictures", "videos", "gifs")
    if name == "links":
        link = F.rlike(F.col("content"), F.lit("https?://"))
        return link | (F.coalesce(F.col("external_link"), F.lit("")) != "") if _has(df, "external_link") else link
    if name == "quote" and _has(df, "quoted_post"):
        return F.col("quoted_post").isNotNull()
    raise ValueError(f"filter '{name}' needs a column of that name")


def _term_match(term: str, mode: str) -> Column:
    if mode == "user":
        return F.col("username") == term
    if mode == "hashtag":
        return F.array_contains(tx.hashtags(F.col("content")), term.lower())
    return F.contains(F.lower("content"), F.lit(term.lower()))


def search_posts(posts: DataFrame, terms, mode: str = "term", since: str | None = None, until: str | None = None,
                 near: str | None = None, language: str | None = None, to: str | None = None,
                 replies: bool = False, filters: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Posts for one or several terms.

    One term gives the posts as they are; a list gives one row per post and
    matching term, named in ``term``, out of a single scan. ``since`` is
    inclusive and ``until`` exclusive. In user mode replies are left out
    unless ``replies`` is set or content filters decide.
    """
    if mode not in MODES:
        raise ValueError("invalid mode: use 'term', 'hashtag' or 'user'")
    if near:
        raise ValueError("'near' needs a place, which posts do not carry")
    tests = []
    if since:
        tests.append(F.col("timestamp") >= moment(dt.datetime.combine(_search_day("since", since), dt.time())))
    if until:
        tests.append(F.col("timestamp") < moment(dt.datetime.combine(_search_day("until", until), dt.time())))
    if language:
        tests.append(F.col("lang") == language)
    if to:
        target = F.array_contains("replying_to", to) if _has(posts, "replying_to") else F.col("reply_to") == to
        tests.append(target)
    tests += [content_flag(posts, f) for f in filters or []]
    tests += [~content_flag(posts, e) for e in exclude or []]
    if mode == "user" and not replies and not filters:
        tests.append(~F.col("is_reply"))
    listed = [terms] if isinstance(terms, str) else list(terms)
    listed = [t.strip() for t in listed]
    if len(listed) == 1:
        return posts.filter(all_of([*tests, _term_match(listed[0], mode)]))
    found = F.array_compact(F.array(*[F.when(_term_match(t, mode), F.lit(t)) for t in listed]))
    base = posts.filter(all_of(tests)) if tests else posts
    return base.select("*", F.explode(found).alias("term"))
