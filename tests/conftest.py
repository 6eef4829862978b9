import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minutes=0, **parts):
    return dt.datetime(2025, 5, 29, 12, 0, tzinfo=UTC) + dt.timedelta(minutes=minutes, **parts)


def naive(value):
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


def post(tweet_id, content="a post", username="alice", when=None, **rest):
    when = when or at()
    row = dict(tweet_id=str(tweet_id), user_id=username, username=username, content=content, timestamp=when, scraped_at=when,
               likes=0, retweets=0, replies=0, is_reply=False, is_retweet=False, reply_to=None, source_instance=None,
               sentiment_score=None, sentiment_label=None, sentiment_confidence=None)
    return {**row, **rest}


@pytest.fixture
def posts(spark):
    from pyspark.sql import types as T

    from chirpline import schema

    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.POSTS.fields])

    def make(*rows, extra=()):
        fields = T.StructType([*loose.fields, *extra])
        return spark.createDataFrame([tuple(r.get(n) for n in fields.names) for r in rows], fields)

    return make
