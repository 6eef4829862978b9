"""Every operator as a named query over the given tables, with the SQL that must agree."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chirpline import schema
from chirpline.functions import scoring, text as tx
from chirpline.functions.times import latest, minus_seconds
from chirpline.operators import aggregate, backlog, filters, health, keyed, threads, validate
from chirpline.plans import collect, oracle as o, rendered
from chirpline.plans.scoring import live_signal, scoring_run
from chirpline.session import run_dir
from chirpline.sources import feeds, pages, store, warehouse as wh
from chirpline.streaming import streams

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def comparable(df: DataFrame) -> DataFrame:
    """Times as wall-clock times, so that they compare without a zone."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
                       else F.col(f.name) for f in df.schema.fields])


def r6(column, name: str | None = None) -> Column:
    found = F.col(column) if isinstance(column, str) else column
    return F.round(found, 6).alias(name or column)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def joined(column, name: str, sep: str = "|") -> Column:
    return F.array_join(column, sep).alias(name)


COLUMNS = schema.POSTS.names


def as_of_posts(spark, sf):
    # all documents have their event, and only its time is needed
    return latest(wh.posts(spark, sf))


def as_of_events(spark, sf):
    return latest(wh.attempts(spark, sf), "ts")


def scored(spark, sf) -> DataFrame:
    """All posts with their scores."""
    return wh.scored_posts(spark, sf, scoring_run_all)


def scoring_run_all(posts: DataFrame) -> DataFrame:
    return scoring.score_posts(posts, scoring.make_scorer())


def recent_scored(spark, sf, hours: float) -> DataFrame:
    """Posts of the last hours with their scores: here the time filter comes first."""
    recent = filters.get_posts(wh.posts(spark, sf), start_time=minus_seconds(as_of_posts(spark, sf), hours * 3600))
    return scoring_run(recent)


def raw_posts(spark, sf) -> DataFrame:
    """Unchecked rows: some counters are negative, some scores out of range, some fields missing."""
    return wh.posts(spark, sf).withColumns({
        "likes": F.col("likes") - 1,
        "sentiment_score": (F.col("likes") - 40) / 100.0,
        "user_id": F.when(~F.col("is_retweet"), F.col("user_id")),
        "sentiment_confidence": F.col("retweets") / 10.0,
    })


# ---- scans, checks, filters ----

@query(f"WITH {o.POSTS} SELECT {o.COLS}, lang FROM posts")
def posts_scan(spark, sf):
    return wh.posts(spark, sf).select(*COLUMNS, "lang")


@query(f"WITH {o.POSTS}, {o.RAW} SELECT {o.COLS} FROM raw WHERE len(violations) = 0")
def posts_validated(spark, sf):
    return validate.valid_posts(raw_posts(spark, sf)).select(*COLUMNS)


@query(f"WITH {o.POSTS}, {o.RAW} SELECT tweet_id, array_to_string(violations, '|') AS violations FROM raw WHERE len(violations) > 0")
def posts_quarantine(spark, sf):
    return validate.quarantined_posts(raw_posts(spark, sf)).select("tweet_id", joined("violations", "violations"))


@query(f"""WITH {o.POSTS}, odd AS (SELECT tweet_id, CAST(tweet_id AS BIGINT) % 5 AS k FROM posts) SELECT p.tweet_id,
 CASE k WHEN 1 THEN 'likes malformed' WHEN 2 THEN 'timestamp malformed|timestamp missing' ELSE '' END AS violations,
 CASE WHEN k = 1 THEN 0 ELSE likes END AS likes FROM posts p JOIN odd USING (tweet_id) WHERE content <> ''""")
def posts_malformed(spark, sf):
    """Counters and dates that come as text, some of which cannot be read: all rows are judged and none stops the job."""
    k = F.pmod(F.col("tweet_id").cast("long"), F.lit(5))
    text = wh.posts(spark, sf).filter("content <> ''").withColumns({
        "likes": F.when(k == 1, "many").otherwise(F.col("likes").cast("string")),
        "timestamp": F.when(k == 2, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))})
    return validate.check_posts(text).select("tweet_id", joined("violations", "violations"), "likes")


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts WHERE username = 'user7'")
def posts_filter_user(spark, sf):
    return filters.get_posts(wh.posts(spark, sf), username="user7").select(*COLUMNS)


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts WHERE timestamp BETWEEN '2024-01-01 06:00:00' AND '2024-01-02 12:00:00'")
def posts_filter_time(spark, sf):
    return filters.get_posts(wh.posts(spark, sf), start_time="2024-01-01T06:00:00Z", end_time="2024-01-02T12:00:00Z").select(*COLUMNS)


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts WHERE tweet_id = '42'")
def posts_by_id(spark, sf):
    return filters.get_posts(wh.posts(spark, sf), tweet_id="42").select(*COLUMNS)


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts ORDER BY timestamp DESC, tweet_id LIMIT 20")
def posts_latest(spark, sf):
    return filters.get_posts(wh.posts(spark, sf), limit=20).select(*COLUMNS)


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.COLS} FROM rated WHERE sentiment_score IS NULL")
def posts_unscored(spark, sf):
    return filters.unscored(wh.rated_posts(spark, sf)).select(*COLUMNS)


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.COLS} FROM rated WHERE sentiment_score IS NOT NULL AND timestamp >= '2024-01-01 12:00:00'")
def posts_filter_scored(spark, sf):
    return filters.get_posts(wh.rated_posts(spark, sf), start_time="2024-01-01T12:00:00Z", with_sentiment=True).select(*COLUMNS)


@query(f"""WITH {o.POSTS}, {o.RATED} SELECT tweet_id, content, sentiment_score, sentiment_label, sentiment_confidence AS confidence,
 timestamp, username FROM rated WHERE sentiment_score IS NOT NULL ORDER BY timestamp DESC, tweet_id LIMIT 50""")
def latest_scored(spark, sf):
    return filters.latest_scored(wh.rated_posts(spark, sf), 50)


@query(f"""WITH {o.POSTS} SELECT tweet_id, t.term FROM posts, (VALUES ('the'), ('eau'), ('ung')) AS t(term)
 WHERE contains(lower(content), t.term)""")
def search_term(spark, sf):
    return filters.search_posts(wh.posts(spark, sf), ["the", "eau", "ung "]).select("tweet_id", "term")


@query(f"WITH {o.POSTS} SELECT tweet_id, username, is_reply FROM posts WHERE username = 'user7' AND NOT is_reply")
def search_user(spark, sf):
    return filters.search_posts(wh.posts(spark, sf), "user7", mode="user").select("tweet_id", "username", "is_reply")


@query(f"""WITH {o.POSTS} SELECT tweet_id, t.term FROM posts, (VALUES ('src1'), ('FR')) AS t(term)
 WHERE source_instance = lower(t.term) OR lang = lower(t.term)""")
def search_hashtag(spark, sf):
    tagged = wh.posts(spark, sf).withColumn(
        "content", F.concat(F.lit("#"), F.upper("source_instance"), F.lit(" "), "content", F.lit(" #"), "lang"))
    # tags that stand in the texts themselves do not name a source or a language
    return filters.search_posts(tagged, ["src1", "FR"], mode="hashtag").select("tweet_id", "term")


@query(f"""WITH {o.POSTS} SELECT tweet_id FROM posts WHERE contains(lower(content), 'a') AND is_retweet
 AND NOT regexp_matches(content, 'https?://')""")
def search_flags(spark, sf):
    return filters.search_posts(wh.posts(spark, sf), "A", filters=["nativeretweets"], exclude=["links"]).select("tweet_id")


FLAGS = {"nativeretweets": "is_retweet", "media": "likes % 2 = 0 OR likes % 3 = 0 OR likes % 5 = 0", "videos": "likes % 3 = 0 OR likes % 5 = 0", "news": "replies = 1",
         "verified": "replies = 2", "native_video": "likes % 3 = 0 OR likes % 5 = 0", "replies": "is_reply", "links": "regexp_matches(content, 'https?://') OR likes % 7 = 0",
         "images": "likes % 2 = 0", "safe": "replies <> 3", "quote": "likes % 11 = 0", "pro_video": "replies = 4"}


@query(f"WITH {o.POSTS} " + " UNION ALL ".join(f"SELECT '{n}' AS flag, count_if({t}) AS n, count_if(NOT ({t})) AS n_without FROM posts" for n, t in FLAGS.items()))
def content_flags(spark, sf):
    """Every content flag, asked for and excluded."""
    some = lambda k, v: F.when(F.col("likes") % k == 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    posts = wh.posts(spark, sf).withColumns({
        "pictures": some(2, "p"), "videos": some(3, "v"), "gifs": some(5, "g"), "external_link": F.when(F.col("likes") % 7 == 0, "http://x").otherwise(""),
        "quoted_post": F.when(F.col("likes") % 11 == 0, F.struct("lang")), "news": F.col("replies") == 1, "verified": F.col("replies") == 2,
        "safe": F.col("replies") != 3, "pro_video": F.col("replies") == 4})
    flags = {n: filters.content_flag(posts, n) for n in filters.CONTENT_FILTERS}
    sums = posts.agg(*[F.count_if(c).alias(n) for n, c in flags.items()], *[F.count_if(~c).alias(f"no_{n}") for n, c in flags.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n"), F.col(f"no_{n}").alias("n_without")) for n in flags])))


@query(f"""WITH {o.POSTS} SELECT tweet_id, lang FROM posts WHERE contains(lower(content), 'e') AND lang = 'en'
 AND timestamp >= '2024-01-01' AND timestamp < '2024-01-02'""")
def search_dated(spark, sf):
    return filters.search_posts(wh.posts(spark, sf), "e", since="2024-01-01", until="2024-01-02", language="en").select("tweet_id", "lang")


@query("""SELECT event_id, d AS day, regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND coalesce(try_cast(d AS DATE) > DATE '2006-03-21'
 AND try_cast(d AS DATE) <= DATE '2026-01-01', false) AS valid FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN
 concat(1995 + user_id, '/', 1 + event_id % 14) ELSE printf('%04d-%02d-%02d', 1995 + user_id, 1 + event_id % 14, 1 + event_id % 33) END AS d FROM events)""")
def search_dates_valid(spark, sf):
    year, month, day = F.col("user_id") + 1995, F.col("event_id") % 14 + 1, F.col("event_id") % 33 + 1
    text = F.when(F.col("event_type") == "error", F.concat(year.cast("string"), F.lit("/"), month.cast("string"))).otherwise(
        F.format_string("%04d-%02d-%02d", year, month, day))
    return wh.table(spark, sf, "events").select("event_id", text.alias("day")).withColumn(
        "valid", filters.is_valid_search_date(F.col("day"), F.lit("2026-01-01").cast("date")))


# ---- text ----

def linked_text(spark, sf) -> DataFrame:
    """Whole pages with a link, a mention and a tag put before them."""
    text = F.concat(F.lit("  Read "), "url", F.lit("?x=1&y=%20 @José_1 #Tag2\t"), "html")
    return wh.table(spark, sf, "pages").select("page_id", text.alias("text"))


@query(f"""WITH t AS (SELECT page_id, concat('  Read ', url, '?x=1&y=%20 @José_1', chr(160), '#Tag2', chr(9), html) AS text FROM pages)
 SELECT page_id, {o.clean('text')} AS plain, {o.clean('text', mentions=True, hashtags=True)} AS bare,
 trim(regexp_replace(text, '{o.WS}+', ' ', 'g')) AS spaced FROM t""")
def text_clean(spark, sf):
    text = F.col("text")
    return linked_text(spark, sf).select(
        "page_id", tx.clean_text(text).alias("plain"),
        tx.clean_text(text, remove_mentions=True, remove_hashtags=True).alias("bare"),
        tx.clean_text(text, remove_urls=False, lowercase=False).alias("spaced"))


@query(f"WITH {o.POSTS}, {o.WORDS} SELECT tweet_id, len(ws) AS n_words, array_to_string(ws, '|') AS words FROM words")
def tokens(spark, sf):
    return wh.posts(spark, sf).select("tweet_id", tx.tokens(F.col("content")).alias("w")).select(
        "tweet_id", F.size("w").alias("n_words"), joined("w", "words"))


@query("""SELECT page_id, 'https://pbs.twimg.com/' || split_part(url, '?', 1) AS picture, 'https://' || url AS gif, 'https://pbs.twimg.com/' || split_part(url, '?', 1) AS picture_enc,
 'https://' || split_part(url, '?', 1) AS gif_enc, 'https' || substr(replace(url, 'https', 'http'), 5) AS video,
 coalesce(nullif(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), ''), 'unknown') AS id FROM pages""")
def media_links(spark, sf):
    url = F.col("url")
    coded = F.replace(F.replace(F.replace(url, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("?"), F.lit("%3F"))
    based = F.concat(F.lit("/pic/enc/"), F.translate(F.base64(F.substring_index(url, "?", 1).cast("binary")), "\r\n", ""))
    data_url = F.concat(F.lit("/video/AB/https"), F.substring(F.replace(coded, F.lit("https"), F.lit("http")), F.lit(5), F.length(coded)))
    plain, enc = F.lit(False), F.lit(True)
    return wh.table(spark, sf, "pages").select(
        "page_id",
        tx.picture_url(F.concat(F.lit("/pic/"), coded), plain).alias("picture"), tx.gif_url(F.concat(F.lit("/pic/"), coded), plain).alias("gif"),
        tx.picture_url(based, enc).alias("picture_enc"), tx.gif_url(based, enc).alias("gif_enc"),
        tx.video_url(data_url, F.lit(None).cast("string"), plain).alias("video"), tx.id_from_link(url).alias("id"))


@query("""SELECT event_id, date_trunc('minute', ts) AS site_date, ts AS iso_date, CAST(NULL AS TIMESTAMP) AS bad_date,
 CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 1000) AS INTEGER) END AS n, 'user.' || user_id AS name, CAST(event_id AS VARCHAR) AS id FROM events""")
def text_fields(spark, sf):
    at = F.col("ts").cast("timestamp")
    return wh.table(spark, sf, "events").select(
        "event_id",
        tx.parse_date(F.date_format(at, "MMM d, yyyy '·' h:mm a 'UTC'")).alias("site_date"),
        tx.parse_date(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("iso_date"),
        tx.parse_date(F.concat(F.lit("around "), F.col("event_type"))).alias("bad_date"),
        tx.count_from_text(F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(" "), F.format_number(F.floor(F.col("value") * 1000), 0)))).alias("n"),
        tx.sanitise_username(F.concat(F.lit(" @user."), F.col("user_id"), F.lit("!"))).alias("name"),
        tx.id_from_link(F.concat(F.lit("https://twitter.com/u/status/"), F.col("event_id"), F.lit("#m"))).alias("id"))


# ---- scoring ----

@query(f"WITH {o.POSTS}, {o.WORDS}, {o.HITS}, {o.KEYWORD} SELECT tweet_id, p AS positive, n AS negative, n_words AS words, "
       "round(score, 6) AS score, round(confidence, 6) AS confidence, label FROM keyword")
def keyword_score(spark, sf):
    out = scoring.KeywordScorer().score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", "s.details.positive", "s.details.negative", "s.details.words", r6("s.score", "score"),
                      r6("s.confidence", "confidence"), "s.label")


@query(f"""WITH {o.POSTS}, {o.WORDS}, hit AS (SELECT tweet_id, list_filter(ws, lambda x: {o.hit('x', o.POS)} OR {o.hit('x', o.NEG)}) AS hs FROM words)
 SELECT tweet_id, array_to_string(flatten(list_transform(hs, lambda x: list_filter([
 '+' || list_filter({o.POS}, lambda k: contains(x, k) OR contains(k, x))[1], '-' || list_filter({o.NEG}, lambda k: contains(x, k) OR contains(k, x))[1]],
 lambda y: y IS NOT NULL))), '|') AS matched FROM hit""")
def keyword_matches(spark, sf):
    out = scoring.KeywordScorer(with_matches=True).score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", joined("s.details.matched", "matched"))


def lexicon(spark, sf) -> DataFrame:
    """A lexicon derived from the benchmark's words: the valence follows from the length."""
    words = wh.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), tx.WHITESPACE)).alias("w"))
    token = F.regexp_replace("w", "[^a-zà-ÿ]", "").alias("token")
    return words.select(token).distinct().filter("token <> ''").select(
        "token", (F.length("token") % 9 - 4).cast("double").alias("valence"))


@query(f"WITH {o.POSTS}, {o.LEXICON} SELECT tweet_id, round(compound, 6) AS score, round(least(abs(compound) + 0.1, 1.0), 6) AS confidence, "
       "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM lexed")
def lexicon_score(spark, sf):
    out = scoring.LexiconScorer(lexicon(spark, sf), scoring.LexiconRules.plain()).score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", r6("s.score", "score"), r6("s.confidence", "confidence"), "s.label")


@query(ORACLE["lexicon_score"])
def lexicon_score_joined(spark, sf):
    """The same over the join a large lexicon takes."""
    scorer = scoring.LexiconScorer(lexicon(spark, sf), scoring.LexiconRules.plain(), max_broadcast=0)
    out = scorer.score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", r6("s.score", "score"), r6("s.confidence", "confidence"), "s.label")


@query(f"WITH {o.POSTS}, {o.LEXICON}, rated AS (SELECT tweet_id, round(compound, 6) AS score FROM lexed) "
       "SELECT tweet_id, score FROM rated UNION ALL SELECT tweet_id, score FROM rated UNION ALL SELECT NULL, score FROM rated")
def lexicon_duplicates(spark, sf):
    """Repeated and missing ids over the join path: a rating follows from the text alone."""
    posts = wh.posts(spark, sf).select("tweet_id", "content")
    rows = posts.unionByName(posts).unionByName(posts.withColumn("tweet_id", F.lit(None).cast("string")))
    scorer = scoring.LexiconScorer(lexicon(spark, sf), scoring.LexiconRules.plain(), max_broadcast=0)
    return scorer.score(rows, "content", "s").select("tweet_id", r6("s.score", "score"))


@query(f"""WITH {o.POSTS}, {o.LEXICON}, {o.RULED} SELECT tweet_id, round(compound, 6) AS score, round(least(abs(compound) + 0.1, 1.0), 6) AS confidence,
 CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(up / whole, 6) AS pos, round(down / whole, 6) AS neg, round(flat / whole, 6) AS neu FROM ruled""")
def lexicon_rules(spark, sf):
    out = scoring.LexiconScorer(lexicon(spark, sf)).score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", r6("s.score", "score"), r6("s.confidence", "confidence"), "s.label",
                      *[r6(f"s.details.{n}", n) for n in ("pos", "neg", "neu")])


@query(f"""WITH {o.POSTS}, {o.WORDS}, {o.HITS}, {o.KEYWORD}, {o.LEXICON}, both_scores AS (SELECT tweet_id,
 0.6::DOUBLE * compound + 0.4::DOUBLE * k.score AS s, 0.6::DOUBLE * least(abs(compound) + 0.1::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * k.confidence AS c
 FROM keyword k JOIN lexed USING (tweet_id) WHERE k.content <> '' UNION ALL SELECT tweet_id, 0.0, 0.0 FROM keyword WHERE content = '') SELECT tweet_id, round(s, 6) AS score, round(c, 6) AS confidence,
 CASE WHEN abs(s) < 0.1 OR c < 0.3 THEN 'neutral' WHEN s > 0 THEN 'positive' ELSE 'negative' END AS label FROM both_scores""")
def ensemble_score(spark, sf):
    scorer = scoring.make_scorer(lexicon=lexicon(spark, sf), rules=scoring.LexiconRules.plain())
    out = scorer.score(wh.posts(spark, sf), "content", "s")
    return out.select("tweet_id", r6("s.score", "score"), r6("s.confidence", "confidence"), "s.label")


@query(ORACLE["ensemble_score"].replace("0.6::DOUBLE", "0.25::DOUBLE").replace("0.4::DOUBLE", "0.75::DOUBLE").replace("< 0.1 ", "< 0.02 ").replace("c < 0.3 ", "c < 0.2 "))
def ensemble_options(spark, sf):
    """Own weights and thresholds, and scores out of range refused."""
    options = {"lexicon_weight": 1.0, "keyword_weight": 3.0, "neutral_threshold": 0.02, "confidence_threshold": 0.2}
    scorer = scoring.make_scorer(options, lexicon(spark, sf), scoring.LexiconRules.plain())
    out = scoring.score_posts(wh.posts(spark, sf), scorer, strict=True)
    filled = F.col("content") != ""
    return out.select("tweet_id", r6(F.when(filled, F.col("sentiment_score")).otherwise(0.0), "score"), r6(F.when(filled, F.col("sentiment_confidence")).otherwise(0.0), "confidence"),
                      F.coalesce("sentiment_label", F.lit("neutral")).alias("label"))


@query(f"WITH {o.SCORED} SELECT tweet_id, username, round(sentiment_score, 6) AS sentiment_score, sentiment_label, "
       "round(sentiment_confidence, 6) AS sentiment_confidence FROM scored")
def posts_scored(spark, sf):
    return rounded(scored(spark, sf).select("tweet_id", "username", *schema.SENTIMENT), "sentiment_score", "sentiment_confidence")


@query(f"WITH {o.SCORED} SELECT count(*) AS tweets_processed, count(sentiment_score) AS tweets_updated, count(*) - count(sentiment_score) AS errors, "
       "round(count(sentiment_score) / greatest(count(*), 1), 6) AS success_rate FROM scored")
def scoring_run_summary(spark, sf):
    return rounded(aggregate.scoring_run_summary(scored(spark, sf)), "success_rate")


@query(f"WITH {o.SCORED} SELECT {o.MEASURES}, (SELECT count(*) FROM scored) AS tweets_processed, (SELECT count(sentiment_score) FROM scored) AS tweets_updated, "
       f"(SELECT count(*) - count(sentiment_score) FROM scored) AS errors FROM scored WHERE {o.RECENT}")
def summary_with_run(spark, sf):
    return rounded(aggregate.summary_with_run(scored(spark, sf), as_of_posts(spark, sf)), "avg_sentiment")


# ---- summaries and signals ----

@query(f"WITH {o.SCORED} SELECT {o.MEASURES} FROM scored WHERE {o.RECENT}")
def sentiment_summary(spark, sf):
    return rounded(aggregate.sentiment_summary(recent_scored(spark, sf, 24), as_of_posts(spark, sf)), "avg_sentiment")


@query(f"WITH {o.SCORED} SELECT username, {o.MEASURES} FROM scored WHERE timestamp >= (SELECT max(timestamp) FROM posts) - INTERVAL 48 HOUR GROUP BY username")
def sentiment_summary_by_user(spark, sf):
    return rounded(aggregate.sentiment_summary(recent_scored(spark, sf, 48), as_of_posts(spark, sf), 48, by=["username"]), "avg_sentiment")


@query(f"""WITH {o.SCORED} SELECT count(*) AS total_tweets, count_if(sentiment_score > 0.1) AS positive_tweets,
 count_if(sentiment_score < -0.1) AS negative_tweets, count_if(sentiment_score BETWEEN -0.1 AND 0.1) AS neutral_tweets,
 round(avg(sentiment_score), 6) AS average_sentiment, (SELECT max(timestamp) FROM posts) AS last_updated FROM scored WHERE {o.RECENT}""")
def summary_record(spark, sf):
    now = as_of_posts(spark, sf)
    return rounded(aggregate.summary_record(aggregate.sentiment_summary(recent_scored(spark, sf, 24), now), now), "average_sentiment")


@query(f"WITH {o.POSTS} SELECT count(*) AS total_tweets FROM posts WHERE timestamp >= (SELECT max(timestamp) FROM posts) - INTERVAL 12 HOUR")
def post_count(spark, sf):
    return aggregate.post_count(wh.posts(spark, sf), as_of_posts(spark, sf), hours=12)


@query(f"""WITH {o.POSTS}, {o.RATED} SELECT count(*) AS total_tweets, count(DISTINCT username) AS unique_users, count(sentiment_score) AS tweets_with_sentiment,
 min(timestamp) AS earliest_tweet, max(timestamp) AS latest_tweet, max(scraped_at) AS last_scraped FROM rated""")
def table_stats(spark, sf):
    return aggregate.table_stats(wh.rated_posts(spark, sf))


@query(f"WITH {o.POSTS}, {o.RATED} SELECT count(*) AS total_tweets, count(sentiment_score) AS tweets_with_sentiment FROM rated")
def status_overview(spark, sf):
    return aggregate.status_overview(wh.rated_posts(spark, sf))


@query(f"WITH {o.POSTS} SELECT tweet_id, username, timestamp, substr(content, 1, 50) || '...' AS preview FROM posts ORDER BY timestamp DESC, tweet_id LIMIT 3")
def status_recent(spark, sf):
    return aggregate.recent_previews(wh.posts(spark, sf))


@query(f"WITH {o.POSTS} SELECT count(*) AS total_tweets, 'unknown' AS uptime, 'unknown' AS last_scrape, '1.0.0' AS api_version, max(timestamp) AS timestamp FROM posts")
def system_stats(spark, sf):
    return aggregate.system_stats(wh.posts(spark, sf), as_of_posts(spark, sf))


@query(f"WITH {o.SCORED}, s AS (SELECT {o.MEASURES_RAW} FROM scored WHERE {o.RECENT}) SELECT {o.SIGNAL}, (SELECT max(timestamp) FROM posts) AS timestamp FROM s")
def trading_signal(spark, sf):
    return rounded(live_signal(wh.posts(spark, sf), as_of_posts(spark, sf)).drop("reasoning"), "confidence", "sentiment_score")


@query()
def trading_signal_reasons(spark, sf):
    """With the reason text, per user."""
    out = live_signal(wh.posts(spark, sf), as_of_posts(spark, sf), 48, by=["username"])
    return rounded(out, "confidence", "sentiment_score")


@query(f"WITH {o.POSTS}, {o.RATED}, s AS (SELECT username, {o.MEASURES_RAW} FROM rated WHERE sentiment_score IS NOT NULL AND {o.RECENT} GROUP BY username) "
       f"SELECT username, {o.SIGNAL}, (SELECT max(timestamp) FROM posts) AS timestamp FROM s")
def trading_signal_by_user(spark, sf):
    out = aggregate.trading_signal(wh.rated_posts(spark, sf), as_of_posts(spark, sf), by=["username"])
    return rounded(out.drop("reasoning"), "confidence", "sentiment_score")


@query(f"WITH {o.SCORED}, {o.WINDOWS} SELECT window_start, window_end, {o.MEASURES} FROM w GROUP BY ALL")
def rolling_summary(spark, sf):
    return rounded(aggregate.rolling_summary(scored(spark, sf)), "avg_sentiment")


@query(f"WITH {o.SCORED}, {o.WINDOWS}, s AS (SELECT window_start, window_end, {o.MEASURES_RAW} FROM w GROUP BY ALL) SELECT window_start, window_end, {o.SIGNAL} FROM s")
def trading_signal_by_window(spark, sf):
    out = aggregate.signal(aggregate.rolling_summary(scored(spark, sf)))
    return rounded(out.drop("reasoning"), "confidence", "sentiment_score")


@query(f"""WITH {o.SCORED} SELECT count(DISTINCT username) AS n_users, count(*) AS n_posts,
 round(sum(sentiment_score * (1.0 + (user_id::BIGINT % 3) * 0.1)::DOUBLE) / sum((1.0 + (user_id::BIGINT % 3) * 0.1)::DOUBLE), 6) AS weighted_sentiment FROM scored""")
def weighted_sentiment(spark, sf):
    return rounded(aggregate.weighted_sentiment(scored(spark, sf), wh.targets(spark, sf)), "weighted_sentiment")


# ---- keyed updates and the store ----

def seen_again(spark, sf) -> DataFrame:
    """Retweets collected a second and a third time, with more likes each time."""
    again = wh.posts(spark, sf).filter("is_retweet").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return again.withColumn("likes", F.col("likes") + F.col("seq"))


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.swap(likes='CASE WHEN is_retweet THEN likes + 2 ELSE likes END', **{c: f'CASE WHEN NOT is_retweet THEN {c} END' for c in schema.SENTIMENT})} FROM rated")
def upsert_latest(spark, sf):
    return keyed.upsert(wh.rated_posts(spark, sf), seen_again(spark, sf), ["seq"]).select(*COLUMNS)


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.swap(likes='CASE WHEN is_retweet THEN likes + 2 ELSE likes END')} FROM rated")
def upsert_preserve_scores(spark, sf):
    return keyed.upsert(wh.rated_posts(spark, sf), seen_again(spark, sf), ["seq"], mode="preserve_scores").select(*COLUMNS)


@query(f"WITH {o.POSTS} SELECT {o.swap(likes='CASE WHEN is_retweet THEN likes + 2 ELSE likes END')} FROM posts")
def dedup_latest(spark, sf):
    both = wh.posts(spark, sf).withColumn("seq", F.lit(0)).unionByName(seen_again(spark, sf))
    return keyed.latest_by_key(both, ["tweet_id"], ["seq"]).select(*COLUMNS)


@query(f"""WITH {o.POSTS}, {o.RATED}, s AS (SELECT tweet_id, replies / 10 AS score FROM posts WHERE is_reply)
 SELECT tweet_id, round(coalesce(s.score, sentiment_score), 6) AS sentiment_score, CASE WHEN s.score IS NULL THEN sentiment_label ELSE 'neutral' END AS sentiment_label,
 CASE WHEN s.score IS NULL THEN sentiment_confidence ELSE 0.25 END AS sentiment_confidence FROM rated LEFT JOIN s USING (tweet_id)""")
def apply_scores(spark, sf):
    new = wh.posts(spark, sf).filter("is_reply").select(
        "tweet_id", (F.col("replies") / 10).alias("score"), F.lit("neutral").alias("label"), F.lit(0.25).alias("confidence"))
    out = keyed.apply_scores(wh.rated_posts(spark, sf), new)
    return rounded(out.select("tweet_id", *schema.SENTIMENT), "sentiment_score")


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts WHERE timestamp >= (SELECT max(timestamp) FROM posts) - INTERVAL 1 DAY")
def retention_keep(spark, sf):
    posts = wh.posts(spark, sf)
    return keyed.retained(posts, minus_seconds(latest(posts), 86_400)).select(*COLUMNS)


def new_table(spark, sf) -> store.PostTable:
    table = store.PostTable(spark, run_dir(spark, "table"))
    table.upsert(wh.rated_posts(spark, sf))
    return table


@query(f"WITH {o.POSTS} SELECT {o.swap(likes='CASE WHEN is_retweet THEN likes + 2 ELSE likes END', scraped_at='timestamp')} FROM posts")
def store_upsert_ties(spark, sf):
    """One batch with repeats collected at one time: the last of each id in the feed counts, whatever the order of the rows."""
    table = store.PostTable(spark, run_dir(spark, "table"))
    first = wh.posts(spark, sf).withColumn("feed_pos", F.lit(0))
    batch = seen_again(spark, sf).withColumnRenamed("seq", "feed_pos").unionByName(first).withColumn("scraped_at", F.col("timestamp"))
    table.upsert(batch.repartition(F.rand(1)))
    return table.read()


@query(f"""WITH {o.POSTS}, {o.RATED} SELECT {o.swap(likes='CASE WHEN is_retweet THEN likes + 2 ELSE likes END',
    timestamp="CASE WHEN is_retweet THEN timestamp + INTERVAL 1 DAY ELSE timestamp END",
    **{c: f'CASE WHEN NOT is_retweet THEN {c} END' for c in schema.SENTIMENT})} FROM rated""")
def store_upsert(spark, sf):
    """A written table after an upsert that moves posts to another day."""
    table = new_table(spark, sf)
    day = F.make_dt_interval(days=F.lit(1))
    table.upsert(seen_again(spark, sf).withColumn("timestamp", F.col("timestamp") + day), order=["seq"])
    return table.read()


@query(f"""WITH {o.SCORED}, {o.RATED} SELECT r.tweet_id, round(coalesce(r.sentiment_score, s.sentiment_score), 6) AS sentiment_score,
 coalesce(r.sentiment_label, s.sentiment_label) AS sentiment_label FROM rated r JOIN scored s USING (tweet_id)
 WHERE r.timestamp >= (SELECT max(timestamp) FROM posts) - INTERVAL 1 DAY""")
def store_rescored_and_cleaned(spark, sf):
    """A written table whose unscored posts were scored and old posts removed."""
    table = new_table(spark, sf)
    scorer = scoring.make_scorer()
    table.rescore(lambda df: scoring.score_posts(df, scorer))
    table.cleanup_old_data(1, as_of_posts(spark, sf))
    return rounded(table.read().select("tweet_id", "sentiment_score", "sentiment_label"), "sentiment_score")


@query(f"""WITH {o.POSTS}, {o.RATED}, n AS (SELECT count(*) AS a, count(sentiment_score) AS s FROM rated)
 SELECT 'parquet' AS export_type, a AS row_count FROM n UNION ALL SELECT 'csv', a FROM n UNION ALL SELECT 'json', s FROM n""")
def export_ledger(spark, sf):
    table = new_table(spark, sf)
    base = run_dir(spark, "export")
    table.export_to_parquet(f"{base}/parquet")
    table.export("csv", f"{base}/csv")
    table.export("json", f"{base}/json", with_sentiment=True)
    return table.exports().select("export_type", "row_count")


@query(f"WITH {o.POSTS}, {o.RATED} SELECT 'parquet' AS kind, {o.COLS} FROM rated UNION ALL SELECT 'csv', {o.COLS} FROM rated "
       f"UNION ALL SELECT 'json', {o.COLS} FROM rated WHERE sentiment_score IS NOT NULL")
def export_content(spark, sf):
    """Exports read back: every row and column as it was written."""
    table, base = new_table(spark, sf), run_dir(spark, "export")
    table.export_to_parquet(f"{base}/parquet")
    table.export("csv", f"{base}/csv")
    table.export("json", f"{base}/json", with_sentiment=True)
    read = spark.read.schema(schema.POSTS)
    parts = {"parquet": read.parquet(f"{base}/parquet"), "json": read.json(f"{base}/json"),
             "csv": read.option("header", True).option("multiLine", True).option("escape", "\\").csv(f"{base}/csv")}
    return keyed.union_feeds(*[rows.select(F.lit(kind).alias("kind"), *COLUMNS) for kind, rows in parts.items()])


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.COLS} FROM rated WHERE timestamp BETWEEN '2024-01-01 06:00:00' AND '2024-01-02 12:00:00'")
def store_query(spark, sf):
    """The written table by time: only the folders of the days asked for are read."""
    return new_table(spark, sf).query(start_time="2024-01-01T06:00:00Z", end_time="2024-01-02T12:00:00Z").select(*COLUMNS)


@query(f"WITH {o.POSTS}, {o.RATED} SELECT {o.COLS} FROM rated WHERE tweet_id IN ('40', '77')")
def store_lookup(spark, sf):
    """Two posts of the written table by id, one of them after it moved to another day and back."""
    table, day = new_table(spark, sf), F.make_dt_interval(days=F.lit(40))
    one = wh.rated_posts(spark, sf).filter("tweet_id = '77'")
    table.upsert(one.withColumn("timestamp", F.col("timestamp") + day))
    table.upsert(one)
    return table.query(tweet_id="40").unionByName(table.query(tweet_id="77")).select(*COLUMNS)


@query(f"""WITH {o.POSTS} SELECT tweet_id, CASE WHEN is_retweet THEN 'fallback' ELSE username END AS username, content, likes, retweets, replies FROM posts WHERE content <> ''""")
def feed_landed(spark, sf):
    """The record feed written as JSON, as it lands, and read from there."""
    path = run_dir(spark, "records")
    records(spark, sf).write.json(path)
    posts = validate.valid_posts(feeds.posts_from_records(feeds.read_records(spark, path), F.lit("fallback")))
    return posts.select("tweet_id", "username", "content", "likes", "retweets", "replies")


@query()
def file_sizes(spark, sf):
    names = ("documents", "events", "pages")
    parts = [store.file_sizes(spark, f"{sf}/{n}.parquet").select(F.lit(n).alias("table"), "size_mb") for n in names]
    return keyed.union_feeds(*parts)


# ---- feeds ----

def records(spark, sf) -> DataFrame:
    """Posts as the record feed lands them; some lack the user, the raw text or the date."""
    posts = wh.posts(spark, sf)
    user = F.when(~F.col("is_retweet"), F.struct(F.col("user_id").cast("long").alias("id"), F.col("username").alias("username")))
    number = F.col("tweet_id").cast("long")
    return posts.select(
        number.alias("id"), user.alias("user"),
        F.when(~F.col("is_reply"), F.col("timestamp")).alias("date"),
        F.nullif(F.col("likes"), F.lit(0)).alias("likeCount"), F.col("retweets").alias("retweetCount"), F.col("replies").alias("replyCount"),
        F.when(F.col("lang") == "en", F.col("content")).alias("rawContent"), F.col("content"),
        F.col("username").alias("target"), number.alias("feed_pos"))


@query(f"""WITH {o.POSTS} SELECT tweet_id, CASE WHEN is_retweet THEN 'fallback' ELSE user_id END AS user_id, CASE WHEN is_retweet THEN 'fallback' ELSE username END AS username,
 content, CASE WHEN is_reply THEN TIMESTAMP '2024-06-01' ELSE timestamp END AS timestamp, likes, retweets, replies, 'snscrape' AS source_instance, is_reply AS timestamp_imputed
 FROM posts WHERE content <> ''""")
def feed_primary(spark, sf):
    now = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    posts = validate.valid_posts(feeds.posts_from_records(records(spark, sf), F.lit("fallback"), now))
    return posts.select("tweet_id", "user_id", "username", "content", "timestamp", "likes", "retweets", "replies", "source_instance", "timestamp_imputed")


@query(f"""WITH {o.POSTS} SELECT username AS target, tweet_id FROM posts QUALIFY row_number() OVER (PARTITION BY username ORDER BY tweet_id::BIGINT) <= 3""")
def first_n_per_target(spark, sf):
    return feeds.first_records(records(spark, sf), 3).select("target", F.col("id").cast("string").alias("tweet_id"))


def saved_pages(spark, sf) -> DataFrame:
    return rendered.timeline_pages(wh.posts(spark, sf, also=["event_type"]))


def items(spark, sf) -> DataFrame:
    return pages.timeline_items(pages.parse_pages(saved_pages(spark, sf)))


@query(f"""WITH {o.POSTS} SELECT CAST(tweet_id::BIGINT // 20 AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY tweet_id::BIGINT // 20 ORDER BY tweet_id::BIGINT) - 1 AS INTEGER) AS pos,
 CASE WHEN event_type IN ('signup', 'purchase') THEN 'thread' ELSE 'post' END AS kind, event_type = 'purchase' AS is_thread_end, tweet_id AS id,
 'https://twitter.com/' || username || '/status/' || tweet_id || '#m' AS link, replace(content, chr(10), ' ') AS text, 'User ' || user_id AS name, username,
 user_id AS profile_id, strftime(timestamp, '%b %-d, %Y · %-I:%M %p UTC') AS date, is_retweet, CASE WHEN is_reply THEN '@' || source_instance ELSE '' END AS replying_to,
 lang AS quoted, replies AS comments, retweets, likes, 'https://pbs.twimg.com/media/' || tweet_id || '.jpg' AS pictures FROM posts""")
def page_extract(spark, sf):
    return items(spark, sf).select(
        "page_id", "pos", "kind", "is_thread_end", "id", "link", "text", "user.name", "user.username", "user.profile_id", "date", "is_retweet",
        joined("replying_to", "replying_to"), F.col("quoted_post.text").alias("quoted"), "stats.comments", "stats.retweets", "stats.likes",
        joined("pictures", "pictures"))


@query(f"""WITH {o.POSTS} SELECT tweet_id, username AS user_id, username, replace(content, chr(10), ' ') AS content, date_trunc('minute', timestamp) AS timestamp, likes, retweets, replies,
 is_reply, is_retweet, CASE WHEN is_reply THEN '@' || source_instance END AS reply_to, 'nitter:https://mirror.example' AS source_instance, false AS timestamp_imputed
 FROM posts WHERE content <> '' AND event_type NOT IN ('signup', 'purchase')""")
def feed_html(spark, sf):
    now = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    found = collect.html_posts(saved_pages(spark, sf), F.lit("https://mirror.example"), now=now)
    return validate.valid_posts(found).select(
        "tweet_id", "user_id", "username", "content", "timestamp", "likes", "retweets", "replies", "is_reply", "is_retweet", "reply_to",
        "source_instance", "timestamp_imputed")


@query(f"WITH {o.POSTS} SELECT tweet_id, content FROM (SELECT tweet_id, replace(content, chr(10), ' ') AS content, event_type FROM posts) "
       "WHERE content <> '' AND event_type NOT IN ('signup', 'purchase', 'click')")
def crawl_posts(spark, sf):
    """Two rounds over the pages of one crawl. Clicks stand in threads first, so they do not count as posts later."""
    posts = wh.posts(spark, sf, also=["event_type"])
    once = rendered.timeline_pages(posts.withColumn("event_type", F.when(F.col("event_type") == "click", "signup").otherwise(F.col("event_type"))))
    rounds = [once.withColumn("page_no", F.col("page_id")), rendered.timeline_pages(posts).withColumn("page_no", F.col("page_id") + 1_000_000_000)]
    pages_ = keyed.union_feeds(*rounds).withColumns({"crawl": F.lit("c"), "page_id": F.col("page_no")})
    return validate.valid_posts(collect.html_posts(pages_, F.lit("m"), crawl=["crawl"], page_order="page_no")).select("tweet_id", "content")


@query(f"""WITH {o.POSTS}, i AS (SELECT tweet_id, content, event_type, tweet_id::BIGINT AS num, (tweet_id::BIGINT // 20) % 3 AS crawl, tweet_id::BIGINT // 20 AS page FROM posts),
 c AS (SELECT *, coalesce(sum((event_type <> 'signup')::INTEGER) OVER (PARTITION BY crawl ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM i),
 e AS (SELECT *, coalesce(max((event_type NOT IN ('signup', 'purchase') AND had >= 29)::INTEGER) OVER (PARTITION BY crawl ORDER BY num), 0) AS ended,
 min(had) OVER (PARTITION BY page) AS at_page FROM c)
 SELECT crawl, tweet_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'thread' ELSE 'post' END AS kind FROM e WHERE ended = 0 AND at_page < 29""")
def html_first_n(spark, sf):
    """The first 29 posts and threads of three crawls over the saved pages."""
    saved = saved_pages(spark, sf).withColumns({"crawl": F.col("page_id") % 3, "page_no": F.col("page_id")})
    found = pages.timeline_items(pages.parse_pages(saved, ["crawl", "page_no"]), ["page_id", "crawl", "page_no"]).select(
        "crawl", "page_no", "pos", "kind", "is_thread_end", "id", "link")
    return feeds.first_items(found, 29, ["crawl"], "page_no").select("crawl", F.col("id").alias("tweet_id"), "kind")


@query(f"""WITH {o.SCORED}, fed AS (SELECT s.*, CASE WHEN (tweet_id::BIGINT // 20) % 3 <> 0 THEN 'snscrape' WHEN (tweet_id::BIGINT // 20) % 2 = 0 THEN 'nitter:m' END AS feed FROM scored s)
 SELECT tweet_id, feed AS source_instance, round(sentiment_score, 6) AS sentiment_score, sentiment_label FROM fed
 WHERE content <> '' AND (feed = 'snscrape' OR feed = 'nitter:m' AND event_type NOT IN ('signup', 'purchase'))""")
def run_pipeline(spark, sf):
    """Records and saved pages of the same posts: one feed counts for each target, and what it brings is stored and scored."""
    table, target = store.PostTable(spark, run_dir(spark, "table")), F.col("page_id").cast("string")
    saved = saved_pages(spark, sf).withColumn("target", target)
    landed = records(spark, sf).withColumn("target", F.floor(F.col("id") / 20).cast("string"))
    page = F.col("target").cast("long")
    tried = landed.select("target").distinct().select("target", F.inline(F.array(
        F.struct(F.lit("snscrape").alias("feed"), F.lit(0).alias("priority"), (page % 3 != 0).alias("success")),
        F.struct(F.lit("nitter").alias("feed"), F.lit(1).alias("priority"), (page % 2 == 0).alias("success")))))
    collect.run_pipeline(table, landed, saved, tried, F.lit("m"))
    return rounded(table.read().select("tweet_id", "source_instance", "sentiment_score", "sentiment_label"), "sentiment_score")


@query(f"""WITH {o.POSTS} SELECT source_instance, count(*) AS n FROM (SELECT 'snscrape' AS source_instance FROM posts WHERE content <> '' UNION ALL
 SELECT 'nitter:' || source_instance FROM posts WHERE content <> '') GROUP BY 1""")
def feed_union(spark, sf):
    posts = wh.posts(spark, sf)
    html = posts.withColumn("source_instance", tx.feed_tag(feeds.HTML_TAG, F.col("source_instance"))).select(*COLUMNS)
    record = feeds.posts_from_records(records(spark, sf)).select(*COLUMNS)
    return validate.valid_posts(keyed.union_feeds(record, html)).groupBy("source_instance").agg(F.count("*").alias("n"))


@query(f"""WITH {o.POSTS}, t AS (SELECT CAST(tweet_id::BIGINT // 20 AS VARCHAR) AS page_id, tweet_id, tweet_id::BIGINT AS num, event_type = 'purchase' AS e FROM posts
 WHERE event_type IN ('signup', 'purchase')), g AS (SELECT *, coalesce(sum(e::INTEGER) OVER (PARTITION BY page_id ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM t)
 SELECT page_id, CAST(no AS BIGINT) AS thread_no, string_agg(tweet_id, ',' ORDER BY num) AS ids FROM g GROUP BY page_id, no HAVING bool_or(e)""")
def thread_assembly(spark, sf):
    found = threads.assemble_threads(items(spark, sf))
    return found.select("page_id", "thread_no", joined(F.transform("posts", lambda p: p["id"]), "ids", ","))


@query("""SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN strlen(html) < 2000 THEN 'Response too small' WHEN url NOT LIKE '%/search?%' THEN 'No timeline content' END AS reason,
 strlen(html) >= 2000 AND url LIKE '%/search?%' AS valid, 'Empty page' AS content_reason, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages""")
def page_status(spark, sf):
    return pages.page_status(wh.table(spark, sf, "pages")).select("page_id", "reason", "valid", "content_reason", "n_bytes")


@query(f"""WITH {o.POSTS}, p AS (SELECT *, tweet_id::BIGINT % 7 AS k FROM posts)
 SELECT tweet_id AS page_id, CASE WHEN k = 6 THEN 'HTTP error' WHEN k = 2 THEN 'Response too small' WHEN k = 0 THEN 'Error: No ' || user_id WHEN k = 1 THEN 'Protected account'
 WHEN k = 3 AND NOT is_reply THEN 'No timeline content' END AS reason, CASE k WHEN 0 THEN 'Fetching error: No ' || user_id WHEN 1 THEN 'Account is protected'
 WHEN 2 THEN 'Empty page' WHEN 3 THEN 'Empty page' END AS content_reason, CAST(k >= 4 AS INTEGER) AS n_items FROM p""")
def page_reasons(spark, sf):
    """A saved page for every reason for which a page is refused."""
    saved = rendered.failed_pages(wh.posts(spark, sf))
    return pages.page_status(saved).select("page_id", "reason", "content_reason", "n_items")


@query(f"""WITH {o.POSTS}, p AS (SELECT *, tweet_id::BIGINT % 2 = 0 AS enc, tweet_id::BIGINT % 3 = 0 AS gone FROM posts)
 SELECT tweet_id AS id, 'see https://site.example/' || user_id || '?a=1&b=2 and @u' AS text, 'https://pbs.twimg.com/media/' || tweet_id || '.jpg' AS picture,
 'https://v.example/' || tweet_id || '.m3u8' AS video, user_id AS profile_id, CASE WHEN gone THEN '' ELSE 'https://twitter.com/q/status/' || user_id END AS quote_link,
 CASE WHEN gone THEN '' ELSE 'quoted' END AS quote_text, CASE WHEN NOT gone THEN '@q' END AS quote_user FROM p""")
def page_odd_items(spark, sf):
    """Encoded media, quotes that are gone, and links to other sites."""
    found = pages.timeline_items(pages.parse_pages(rendered.odd_pages(wh.posts(spark, sf))))
    quote = F.col("quoted_post")
    return found.select("id", "text", F.get("pictures", F.lit(0)).alias("picture"), F.get("videos", F.lit(0)).alias("video"), "user.profile_id",
                        quote["link"].alias("quote_link"), quote["text"].alias("quote_text"), quote["user"]["username"].alias("quote_user"))


@query(f"""WITH {o.POSTS} SELECT DISTINCT CAST(tweet_id::BIGINT // 20 AS VARCHAR) AS page_id, '/search?cursor=' || tweet_id::BIGINT // 20 AS search_next,
 '/u?cursor=' || tweet_id::BIGINT // 20 AS user_next FROM posts""")
def page_links(spark, sf):
    parsed = pages.page_signs(saved_pages(spark, sf))
    both = pages.next_url(parsed, F.lit("term"), F.lit("u"), F.lit(False)).withColumnRenamed("next_url", "search_next")
    return pages.next_url(both, F.lit("user"), F.lit("u"), F.lit(False)).select("page_id", "search_next", F.col("next_url").alias("user_next"))


@query(f"""WITH {o.POSTS} SELECT CAST(page_id AS VARCHAR) AS page_id, id, link FROM (SELECT tweet_id::BIGINT // 20 AS page_id, tweet_id AS id,
 'https://twitter.com/' || username || '/status/' || tweet_id || '#m' AS link FROM posts WHERE tweet_id = '40')""")
def post_lookup(spark, sf):
    found = pages.timeline_items(pages.parse_pages(pages.holding(saved_pages(spark, sf), "40")))
    return pages.post_by_id(found, "40").select("page_id", "id", "link")


@query("""SELECT CAST(user_id AS VARCHAR) AS page_id, 'https://pbs.twimg.com/profile_images/' || user_id || '/a.jpg' AS image, 'User ' || user_id AS name, '@user' || user_id AS username,
 CAST(user_id AS VARCHAR) AS id, 'Writes & reads' AS bio, 'Place ' || user_id AS location, '' AS website, '1 Jan 2024' AS joined, CAST(count(*) AS INTEGER) AS tweets, 1234 AS following,
 CAST(sum(CAST(floor(value) AS INTEGER)) AS INTEGER) AS likes, 12 AS media FROM events GROUP BY user_id""")
def profile_extract(spark, sf):
    users = wh.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("posts"), F.sum(F.floor("value")).alias("likes"))
    return pages.profiles(rendered.profile_pages(users)).select(
        "page_id", "image", "name", "username", "id", "bio", "location", "website", "joined", "stats.tweets", "stats.following", "stats.likes", "stats.media")


@query("""SELECT 'user' || user_id AS username, 'following' AS direction, event_id // 40 AS page_no, CAST(row_number() OVER (PARTITION BY user_id, event_id // 40 ORDER BY event_id) - 1 AS INTEGER) AS pos,
 '@' || event_type || event_id AS other FROM events""")
def follow_edges(spark, sf):
    edges = wh.table(spark, sf, "events").select(
        F.concat(F.lit("user"), "user_id").alias("username"), F.floor(F.col("event_id") / 40).alias("page_no"), F.col("event_id").alias("pos"),
        F.concat(F.lit("@"), "event_type", "event_id").alias("other"))
    return pages.follow_edges(rendered.follow_pages(edges))


def feed_attempts(spark, sf) -> DataFrame:
    """The primary feed fails for every third user, the second one for odd users."""
    users = wh.table(spark, sf, "events").select("user_id").distinct()
    both = users.select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("priority"))
    return both.select(
        F.concat(F.lit("user"), "user_id").alias("target"), F.concat(F.lit("feed"), "priority").alias("feed"), "priority",
        F.when(F.col("priority") == 0, F.col("user_id") % 3 != 0).otherwise(F.col("user_id") % 2 == 0).alias("success"))


WINNERS = ("winners AS (SELECT DISTINCT 'user' || user_id AS target, CASE WHEN user_id % 3 <> 0 THEN 'feed0' WHEN user_id % 2 = 0 THEN 'feed1' ELSE 'none' END AS feed FROM events)")


@query(f"WITH {WINNERS} SELECT target, feed, feed <> 'none' AS success, CASE WHEN feed = 'none' THEN 'All backends failed' END AS error_message FROM winners")
def feed_failover(spark, sf):
    return keyed.feed_winners(feed_attempts(spark, sf))


@query(f"WITH {o.POSTS}, {WINNERS} SELECT target, feed, tweet_id FROM posts JOIN winners ON target = username WHERE feed <> 'none'")
def failover_rows(spark, sf):
    rows = wh.posts(spark, sf).select(F.col("username").alias("target"), F.explode(F.array(F.lit("feed0"), F.lit("feed1"))).alias("feed"), "tweet_id")
    return collect.fail_over(rows, feed_attempts(spark, sf)).select("target", "feed", "tweet_id")


@query("""SELECT 'user' || user_id AS target, coalesce('nitter:m' || min(CASE WHEN event_type <> 'error' AND event_id % 4 > user_id % 3 THEN event_id % 4 END), 'none') AS feed FROM events GROUP BY user_id""")
def mirror_failover(spark, sf):
    """Each event tries one of four mirrors; the first mirrors are down for some users."""
    tried = wh.table(spark, sf, "events").select(
        F.concat(F.lit("user"), "user_id").alias("target"), (F.col("event_id") % 4).alias("priority"),
        tx.feed_tag(feeds.HTML_TAG, F.concat(F.lit("m"), F.col("event_id") % 4)).alias("feed"),
        ((F.col("event_type") != "error") & (F.col("event_id") % 4 > F.col("user_id") % 3)).alias("success"))
    return keyed.feed_winners(tried).select("target", "feed")


@query(f"""WITH {o.POSTS} SELECT link, page_no, tweet_id FROM (SELECT 'https://x/' || user_id || '/' || replies AS link, tweet_id::BIGINT // 20 AS page_no, tweet_id FROM posts)
 QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_no, tweet_id) = 1""")
def dedup_first(spark, sf):
    rows = wh.posts(spark, sf).select(
        F.concat(F.lit("https://x/"), "user_id", F.lit("/"), "replies").alias("link"), F.floor(F.col("tweet_id").cast("long") / 20).alias("page_no"), "tweet_id")
    return keyed.first_by_key(rows, ["link"], ["page_no", "tweet_id"])


@query("""SELECT 'user' AS target_type, 'user' || user_id AS value, round(1.0 + (user_id % 3) * 0.1, 6)::DOUBLE AS weight FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT 'search', source, 1.0 FROM (SELECT DISTINCT source FROM documents)""")
def target_list(spark, sf):
    return rounded(wh.targets(spark, sf).select("target_type", "value", "weight"), "weight")


@query("""SELECT 'user' AS target_type, 'user' || user_id AS value, CASE WHEN user_id % 3 > 0 THEN round(1.0 + (user_id % 3) * 0.1, 6)::DOUBLE ELSE 1.0::DOUBLE END AS weight, '' AS description
 FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'search', source, 1.0::DOUBLE, 'source' FROM (SELECT DISTINCT source FROM documents)""")
def target_file(spark, sf):
    """The targets written as an accounts file, and read from it. Weights of 1 and empty descriptions are left out, as a reader fills them in."""
    path, t = run_dir(spark, "accounts"), wh.targets(spark, sf)
    weight, text = F.nullif(F.round("weight", 6), F.lit(1.0)), F.nullif("description", F.lit(""))
    one = F.struct(F.when(F.col("target_type") == "user", F.col("value")).alias("name"), F.when(F.col("target_type") == "search", F.col("value")).alias("query"),
                   weight.alias("weight"), text.alias("description"))
    kinds = {"users": "user", "terms": "search"}
    t.agg(*[F.collect_list(F.when(F.col("target_type") == k, one)).alias(n) for n, k in kinds.items()]).write.json(path)
    return feeds.read_targets(spark, path)


# ---- feed health ----

TIGHT = {"feed0": {"requests_per_minute": 1, "requests_per_hour": 5, "concurrent_requests": 2}, "feed1": {"requests_per_hour": 3}}


def quotas(spark):
    return health.quota_table(spark, TIGHT)


@query(f"WITH {o.LOAD}, {o.LIMITED} SELECT feed, ts, CAST(n AS BIGINT) AS n_requests, CAST(minute_count AS BIGINT) AS minute_count, CAST(hour_count AS BIGINT) AS hour_count, "
       "CAST(active AS BIGINT) AS active, allowed, round(CASE WHEN NOT allowed AND minute_count >= rpm THEN greatest(0.0::DOUBLE, 60.0 - (us - oldest) / 1000000.0) ELSE 0.0 END, 6) AS wait_time FROM limited")
def quota_windows(spark, sf):
    out = health.quota_windows(wh.attempts(spark, sf), quotas(spark))
    return rounded(out.select("feed", "ts", "n_requests", "minute_count", "hour_count", "active", "allowed", "wait_time"), "wait_time")


@query(f"WITH {o.LOAD} SELECT feed, ts, CAST(mirror_count AS BIGINT) AS mirror_count, round(CASE WHEN mirror_count >= 1 THEN greatest(0.0::DOUBLE, 60.0 - (us - mirror_oldest) / 1000000.0) ELSE 0.0 END, 6) AS wait_time FROM load")
def mirror_wait(spark, sf):
    return rounded(health.mirror_wait(wh.attempts(spark, sf), per_minute=1).select("feed", "ts", "mirror_count", "wait_time"), "wait_time")


@query(f"WITH {o.LOAD} SELECT feed, ts, CAST(active AS BIGINT) AS active FROM load")
def active_requests(spark, sf):
    return health.request_load(wh.attempts(spark, sf), {}).select("feed", "ts", "active")


@query(f"WITH {o.ATTEMPTS}, {o.EMA} SELECT feed, round(success_rate, 6) AS success_rate, round(avg_response_time, 6) AS avg_response_time FROM ema")
def feed_ema(spark, sf):
    return rounded(health.feed_averages(wh.attempts(spark, sf), ["ts", "event_id"]), "success_rate", "avg_response_time")


@query(f"""WITH {o.ATTEMPTS}, timed AS (SELECT feed, list(response_time ORDER BY ts, event_id) FILTER (WHERE response_time IS NOT NULL) AS v FROM attempts GROUP BY feed)
 SELECT feed, round(list_reduce(v, lambda a, b: CASE WHEN a = 0 THEN b ELSE 0.999::DOUBLE * a + 0.001::DOUBLE * b END), 6) AS slow FROM timed WHERE len(v) > 0""")
def feed_ema_slow(spark, sf):
    """A slow decay, in which the whole log has weight."""
    return rounded(health.seeded_average(wh.attempts(spark, sf), ["feed"], ["ts", "event_id"], "response_time", 0.999, "slow"), "slow")


@query(f"WITH {o.ATTEMPTS}, {o.STREAK} SELECT * FROM streak")
def failure_streak(spark, sf):
    return health.failure_streaks(wh.attempts(spark, sf))


def state(spark, sf):
    return health.feed_state(wh.attempts(spark, sf), as_of_events(spark, sf), quotas(spark), ["ts", "event_id"])


@query(f"WITH {o.STATE} SELECT feed, minute_count, hour_count, active, round(success_rate, 6) AS success_rate, round(avg_response_time, 6) AS avg_response_time, "
       "consecutive_failures, can_make_request, round(wait_time, 6) AS wait_time, status, round(weight, 6) AS weight FROM state")
def feed_status(spark, sf):
    return rounded(state(spark, sf).select("feed", "minute_count", "hour_count", "active", "success_rate", "avg_response_time", "consecutive_failures",
                                           "can_make_request", "wait_time", "status", "weight"), "success_rate", "avg_response_time", "wait_time", "weight")


@query(f"WITH {o.STATE} SELECT feed, status, round(weight, 6) AS weight FROM state WHERE usable ORDER BY status <> 'healthy', weight DESC, feed LIMIT 1")
def feed_rank(spark, sf):
    return rounded(health.best_feed(state(spark, sf)).select("feed", "status", "weight"), "weight")


@query(f"WITH {o.STATE} SELECT feed, round(wait_time, 6) AS wait_time FROM state ORDER BY wait_time, feed LIMIT 1")
def next_available(spark, sf):
    return rounded(health.next_available(state(spark, sf)), "wait_time")


@query(f"""WITH {o.STATE}, best AS (SELECT feed FROM state WHERE usable ORDER BY status <> 'healthy', weight DESC, feed LIMIT 1)
 SELECT event_id, coalesce(s.feed, (SELECT feed FROM best)) AS feed FROM events e LEFT JOIN state s ON s.usable AND s.feed = 'feed' || e.user_id % 5""")
def choose_feed(spark, sf):
    return health.choose_feed(wh.requests(spark, sf), state(spark, sf)).select("event_id", "feed")


@query(f"""WITH {o.STATE} SELECT feed, count_if(success) AS requests_processed, count_if(NOT success) AS requests_failed, any_value(state.status) AS status,
 any_value(state.minute_count) AS minute_count, any_value(state.hour_count) AS hour_count FROM attempts JOIN state USING (feed) GROUP BY feed""")
def run_counters(spark, sf):
    return health.run_counters(wh.attempts(spark, sf), as_of_events(spark, sf), quotas(spark), ["ts", "event_id"]).select(
        "feed", "requests_processed", "requests_failed", "status", "minute_count", "hour_count")


# ---- targets, backlog, runs ----

@query(f"WITH {o.ATTEMPTS}, {o.TARGET_STATE} SELECT target, last_scraped, error_count FROM tstate")
def target_state(spark, sf):
    return backlog.target_state(wh.attempts(spark, sf))


def _due(seconds):
    return (f"WITH {o.ATTEMPTS}, {o.TARGET_STATE}, t AS (SELECT DISTINCT 'user' AS target_type, target AS value FROM attempts UNION ALL SELECT DISTINCT 'search', source FROM documents) "
            f"SELECT target_type, value, last_scraped, coalesce(error_count, 0) AS error_count FROM t LEFT JOIN tstate ON target = value "
            f"WHERE last_scraped IS NULL OR last_scraped <= (SELECT max(ts) FROM attempts) - INTERVAL {seconds} SECOND")


@query(_due(6 * 3600))
def due_targets(spark, sf):
    out = backlog.due_targets(wh.targets(spark, sf), wh.attempts(spark, sf), as_of_events(spark, sf))
    return out.select("target_type", "value", "last_scraped", "error_count")


@query(_due(30))
def due_targets_continuous(spark, sf):
    out = backlog.due_targets(wh.targets(spark, sf), wh.attempts(spark, sf), as_of_events(spark, sf), backlog.COLLECT_EVERY_SECONDS)
    return out.select("target_type", "value", "last_scraped", "error_count")


BACKLOG_NOW = "(SELECT ts FROM events ORDER BY ts LIMIT 1) + INTERVAL 2 DAY"


def backlog_now(spark, sf):
    first = wh.requests(spark, sf).agg(F.min("created_at").alias("t"))
    return first.select(minus_seconds(F.col("t"), -2 * 86_400).alias("t")).scalar()


@query(f"SELECT event_id, CAST(user_id % 4 AS INTEGER) AS priority, ts AS created_at FROM events WHERE epoch_us({BACKLOG_NOW}) - epoch_us(ts) <= 300000000")
def live_requests(spark, sf):
    return backlog.live_requests(wh.requests(spark, sf), backlog_now(spark, sf)).select("event_id", "priority", "created_at")


@query(f"SELECT event_id, CAST(user_id % 4 AS INTEGER) AS priority, ts AS created_at FROM events WHERE epoch_us({BACKLOG_NOW}) - epoch_us(ts) <= 300000000 "
       "ORDER BY user_id % 4, ts DESC, event_id LIMIT 1000")
def backlog_triage(spark, sf):
    return backlog.triage(wh.requests(spark, sf), backlog_now(spark, sf), tie=["event_id"]).select("event_id", "priority", "created_at")


@query("SELECT event_id, CAST(user_id % 4 AS INTEGER) AS priority, ts AS created_at FROM events")
def backlog_ordered(spark, sf):
    return backlog.backlog_order(wh.requests(spark, sf)).select("event_id", "priority", "created_at")


@query(f"""WITH c AS (SELECT count(*) AS total, count_if(epoch_us({BACKLOG_NOW}) - epoch_us(ts) > 300000000) AS expired FROM events)
 SELECT total, expired, least(total - expired, 1000) AS queued, greatest(total - expired - 1000, 0) AS overflow, expired + greatest(total - expired - 1000, 0) AS dropped FROM c""")
def backlog_counts(spark, sf):
    return backlog.backlog_counts(wh.requests(spark, sf), backlog_now(spark, sf))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'requeue' ELSE 'failed' END AS outcome, CAST(CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE event_id % 5 END AS INTEGER) AS retry_count FROM events""")
def retry_plan(spark, sf):
    return backlog.retry_plan(wh.requests(spark, sf)).select("event_id", "outcome", "retry_count")


@query(f"""WITH {o.ATTEMPTS} SELECT feed, round(list_reduce(list(response_time ORDER BY ts, event_id), lambda a, b: 0.9::DOUBLE * a + 0.1::DOUBLE * b), 6) AS avg_wait FROM attempts GROUP BY feed""")
def queue_wait_average(spark, sf):
    """The slower average that queue waits and processing times use."""
    return rounded(health.seeded_average(wh.attempts(spark, sf), ["feed"], ["ts", "event_id"], "response_time", 0.9, "avg_wait"), "avg_wait")


@query(f"WITH {o.ATTEMPTS} SELECT feed, count(*) AS n FROM attempts WHERE success GROUP BY feed")
def feed_usage(spark, sf):
    return backlog.feed_usage(wh.attempts(spark, sf))


@query(f"""WITH {o.ATTEMPTS} SELECT count(DISTINCT target) AS targets_processed, CAST(sum(CASE WHEN success THEN retweets END) AS BIGINT) AS tweets_scraped, count(*) AS total_requests,
 count_if(success) AS successful_requests, (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(DISTINCT source) FROM documents) AS targets_total,
 round(count_if(success) / count(*), 6) AS success_rate FROM (SELECT a.*, CAST(floor(response_time) AS INTEGER) AS retweets FROM attempts a)""")
def collection_run_summary(spark, sf):
    log = wh.attempts(spark, sf).withColumn("n_rows", F.floor("response_time").cast("int"))
    total = wh.targets(spark, sf).agg(F.count("*").alias("n")).scalar()
    return rounded(backlog.collection_summary(log, total), "success_rate")


# ---- streams, run over what is there now ----

def post_stream(spark, sf, also=(), in_order=False) -> DataFrame:
    return wh.posts_of(wh.table(spark, sf, "documents"), wh.event_stream(spark, sf, in_order), also)


@query(ORACLE["posts_scored"])
def stream_scored(spark, sf):
    out = streams.scored(post_stream(spark, sf)).select("tweet_id", "username", *schema.SENTIMENT)
    path = streams.stream_into(out, streams.to_table, "scored")
    return rounded(spark.read.schema(out.schema).parquet(path), "sentiment_score", "sentiment_confidence")


@query(f"WITH {o.POSTS} SELECT tweet_id, username, timestamp FROM posts")
def stream_dedup(spark, sf):
    """Every post lands twice and is kept once."""
    twice = post_stream(spark, sf, in_order=True).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = streams.deduplicated(twice).select("tweet_id", "username", "timestamp")
    path = streams.stream_into(out, streams.to_table, "dedup")
    return spark.read.schema(out.schema).parquet(path)


@query(ORACLE["rolling_summary"])
def stream_rolling_summary(spark, sf):
    out = streams.rolling_stream(streams.scored(post_stream(spark, sf)))
    path = streams.stream_into(out, streams.write_cells, "rolling")
    return rounded(streams.rolling_from_cells(spark, path, out.schema), "avg_sentiment")


@query(f"WITH {o.POSTS} SELECT {o.COLS} FROM posts WHERE content <> ''")
def stream_upsert(spark, sf):
    table = store.PostTable(spark, run_dir(spark, "table"))
    start = lambda stream, path, checkpoint, once: streams.upsert_stream(stream, table, checkpoint, once)
    streams.stream_into(post_stream(spark, sf), start, "upsert")
    return table.read()


@query(f"WITH {o.ATTEMPTS}, {o.EMA}, {o.STREAK} SELECT feed, n AS n_attempts, round(success_rate, 6) AS success_rate, round(avg_response_time, 6) AS avg_response_time, "
       "last_success, last_failure, consecutive_failures FROM ema JOIN streak USING (feed)")
def stream_feed_health(spark, sf):
    log = wh.attempts_of(wh.event_stream(spark, sf, in_order=True))
    start = lambda stream, path, checkpoint, once: streams.health_stream(stream, path, checkpoint, ["ts", "event_id"], once)
    path = streams.stream_into(log, start, "health")
    return rounded(streams.latest_health(spark, path), "success_rate", "avg_response_time")
