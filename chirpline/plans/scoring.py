"""Scoring runs and the questions asked of scored posts."""

from pyspark.sql import DataFrame

from chirpline.functions.scoring import Scorer, make_scorer, score_posts
from chirpline.operators import aggregate, filters


def scoring_run(posts: DataFrame, scorer: Scorer | None = None, limit: int | None = None, only_missing: bool = True) -> DataFrame:
    """Posts that were due, with their scores. A limit takes the newest."""
    due = filters.unscored(posts, only_missing)
    if limit:
        due = filters.newest_first(due, limit)
    return score_posts(due, scorer or make_scorer())


def live_signal(posts: DataFrame, as_of, hours: float = 24, by: list[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """The signal over posts that have not been scored yet: only the asked hours are scored."""
    recent = filters.get_posts(posts, start_time=aggregate.minus_seconds(aggregate.moment(as_of), hours * 3600))
    return aggregate.trading_signal(score_posts(recent, scorer or make_scorer()), as_of, hours, by)
