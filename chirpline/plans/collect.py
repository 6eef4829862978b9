"""A collection run over landed feeds: convert, check, choose feeds, store, score."""

from pyspark.sql import Column, DataFrame, functions as F

from chirpline.functions.scoring import Scorer, make_scorer, score_posts
from chirpline.operators import keyed
from chirpline.sources import feeds, pages
from chirpline.sources.store import PostTable


def html_posts(saved: DataFrame, mirror: Column, default_username: Column | None = None, now: Column | None = None,
               crawl: list[str] = (), page_order: str = "page_id", number: int = -1, since: Column | None = None) -> DataFrame:
    """Saved pages to posts, each link once per crawl, the first in page order.

    ``crawl`` and ``page_order`` are columns of the pages, and ``since`` is made
    of the former. With ``number`` a crawl ends when it has so many posts and threads.
    """
    carry = [c for c in (*crawl, page_order) if c != "page_id"]
    items = pages.timeline_items(pages.parse_pages(saved, carry), keep=["page_id", *carry])
    items = feeds.first_items(items, number, list(crawl), page_order, since)
    # posts and threads share what has been seen
    single = keyed.first_by_key(items, [*crawl, "link"], [page_order, "pos"]).filter("kind = 'post'")
    return feeds.posts_from_html(single, mirror, default_username, now, [page_order, "pos"])


def collect(table: PostTable, batches: list[DataFrame], scorer: Scorer | None = None, analyze: bool = True) -> dict:
    """Store converted feed batches and, if asked, score what has no score yet."""
    stored = 0
    for batch in batches:
        stored += table.upsert(batch)
    out = {"tweets_scraped": stored}
    if analyze:
        used = scorer or make_scorer()
        out.update(table.rescore(lambda df: score_posts(df, used).drop("scoring_error")))
    return out


def run_pipeline(table: PostTable, records: DataFrame, saved: DataFrame, attempts: DataFrame, mirror: Column, scorer: Scorer | None = None,
                 default_username: Column | None = None, now: Column | None = None, page_order: str = "page_id", number: int = -1) -> dict:
    """A whole run: each target's first feed that succeeded is converted, checked, stored and scored.

    ``records`` and ``saved`` pages carry their ``target``; ``attempts`` say which feed (by its tag) succeeded for it.
    ``number`` limits what is taken of a target: records before any is converted, posts and threads of its pages.
    """
    winners = keyed.feed_winners(attempts).filter("success").select("target", "feed")

    def won(rows: DataFrame, tag: str) -> DataFrame:
        return rows.join(winners.filter(F.col("feed") == tag), "target", "left_semi")

    landed = won(records, feeds.RECORD_TAG)
    record = feeds.posts_from_records(landed if number == -1 else feeds.first_records(landed, number), default_username, now)
    html = html_posts(won(saved, feeds.HTML_TAG), mirror, default_username, now, ["target"], page_order, number)
    return collect(table, [record, html], scorer)


def fail_over(posts: DataFrame, attempts: DataFrame, keys: list[str] = ("target",)) -> DataFrame:
    """Posts of each target's winning feed; ``posts`` carries target and feed."""
    return keyed.winner_rows(posts, keyed.feed_winners(attempts, keys), keys)
