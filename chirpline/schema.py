"""Schemas of the tables the package reads and writes.

Readers always pass one of these; nothing is inferred from data.
"""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


POSTS = _struct(
    ("tweet_id", _S, False),
    ("user_id", _S, False),
    ("username", _S, False),
    ("content", _S, False),
    ("timestamp", _TS, False),
    ("scraped_at", _TS, False),
    ("likes", _I, True),
    ("retweets", _I, True),
    ("replies", _I, True),
    ("is_reply", _B, True),
    ("is_retweet", _B, True),
    ("reply_to", _S, True),
    ("source_instance", _S, True),
    ("sentiment_score", _D, True),
    ("sentiment_label", _S, True),
    ("sentiment_confidence", _D, True),
)

REQUIRED = [f.name for f in POSTS.fields if not f.nullable]
COUNTERS = ["likes", "retweets", "replies"]
FLAGS = ["is_reply", "is_retweet"]
SENTIMENT = ["sentiment_score", "sentiment_label", "sentiment_confidence"]

EXPORTS = _struct(
    ("export_id", _S, False),
    ("export_type", _S, False),
    ("file_path", _S, False),
    ("row_count", _L, False),
    ("exported_at", _TS, True),
    ("checksum", _S, True),
)

# One post of the record feed, as landed in JSON. Every field may be absent.
RECORD_FEED = _struct(
    ("id", _L, True),
    ("user", _struct(("id", _L, True), ("username", _S, True)), True),
    ("date", _TS, True),
    ("likeCount", _I, True),
    ("retweetCount", _I, True),
    ("replyCount", _I, True),
    ("rawContent", _S, True),
    ("content", _S, True),
    ("target", _S, True),
    ("feed_pos", _L, True),
)

TARGETS = _struct(
    ("target_type", _S, False),
    ("value", _S, False),
    ("weight", _D, False),
    ("description", _S, False),
)

ATTEMPTS = _struct(
    ("feed", _S, False),
    ("target", _S, False),
    ("ts", _TS, False),
    ("success", _B, False),
    ("response_time", _D, True),
    ("n_rows", _I, True),
    ("error", _S, True),
)

REQUESTS = _struct(
    ("target_type", _S, False),
    ("value", _S, False),
    ("priority", _I, False),
    ("created_at", _TS, False),
    ("retry_count", _I, False),
    ("max_retries", _I, False),
    ("backend_preference", _S, True),
)

QUOTAS = _struct(
    ("feed", _S, False),
    ("requests_per_minute", _I, False),
    ("requests_per_hour", _I, False),
    ("concurrent_requests", _I, False),
)

_USER = _struct(("name", _S, True), ("username", _S, True), ("profile_id", _S, True), ("avatar", _S, True))
_URLS = T.ArrayType(_S)

# One post extracted from a saved HTML page, after the column functions decoded it.
HTML_POST = _struct(
    ("id", _S, True),
    ("link", _S, True),
    ("text", _S, True),
    ("user", _USER, True),
    ("date", _S, True),
    ("is_retweet", _B, True),
    ("is_pinned", _B, True),
    ("external_link", _S, True),
    ("replying_to", _URLS, True),
    ("quoted_post", _struct(
        ("link", _S, True), ("text", _S, True), ("user", _USER, True), ("date", _S, True),
        ("pictures", _URLS, True), ("videos", _URLS, True), ("gifs", _URLS, True)), True),
    ("stats", _struct(("comments", _I, True), ("retweets", _I, True), ("quotes", _I, True), ("likes", _I, True)), True),
    ("pictures", _URLS, True),
    ("videos", _URLS, True),
    ("gifs", _URLS, True),
)

# Health of a feed, folded batch by batch.
HEALTH = _struct(
    ("feed", _S, True),
    ("n_attempts", _L, True),
    ("success_rate", _D, True),
    ("avg_response_time", _D, True),
    ("last_success", _TS, True),
    ("last_failure", _TS, True),
    ("consecutive_failures", _L, True),
)
