"""SQL building blocks of the checks, written independently of the Spark plans."""

from chirpline import schema
from chirpline.functions.scoring import LexiconRules, ScoreConfig

# Whitespace and URLs, as the checking engine's regex spells them.
WS = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PUNCTUATION = "!?.,;:''\"()[]{}<>*_~#@&%$-"

COLS = ", ".join(schema.POSTS.names)
_NONE = "CAST(NULL AS DOUBLE) AS sentiment_score, CAST(NULL AS VARCHAR) AS sentiment_label, CAST(NULL AS DOUBLE) AS sentiment_confidence"
_KEYS = ("tweet_id, user_id, username, content, timestamp, scraped_at, likes, retweets, replies, is_reply, is_retweet, "
         "reply_to, source_instance")


def swap(**changes) -> str:
    """The post columns, some of them replaced."""
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in schema.POSTS.names)


POSTS = f"""posts AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS user_id, 'user' || user_id AS username,
 regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS content, ts AS timestamp, ts + INTERVAL 30 SECOND AS scraped_at,
 CAST(floor(value) AS INTEGER) AS likes, CAST(floor(value / 10) AS INTEGER) AS retweets, CAST(doc_id % 7 AS INTEGER) AS replies,
 event_type = 'view' AS is_reply, event_type = 'click' AS is_retweet, CAST(NULL AS VARCHAR) AS reply_to, source AS source_instance, {_NONE}, lang, event_type
 FROM documents JOIN events ON event_id = doc_id)"""

RAW = f"""shifted AS (SELECT {swap(likes='likes - 1', sentiment_score='CAST((likes - 40) / 100.0 AS DOUBLE)',
    user_id='CASE WHEN NOT is_retweet THEN user_id END', sentiment_confidence='CAST(retweets / 10.0 AS DOUBLE)')} FROM posts),
 raw AS (SELECT *, list_filter([CASE WHEN user_id IS NULL THEN 'user_id missing' END, CASE WHEN content = '' THEN 'content empty' END,
 CASE WHEN likes < 0 THEN 'likes negative' END, CASE WHEN sentiment_score NOT BETWEEN -1 AND 1 THEN 'sentiment_score out of range' END,
 CASE WHEN sentiment_confidence NOT BETWEEN 0 AND 1 THEN 'sentiment_confidence out of range' END], lambda v: v IS NOT NULL) AS violations FROM shifted)"""

RATED = f"""rated AS (SELECT {_KEYS}, CASE WHEN NOT is_reply THEN CAST(least(likes / 100.0, 1.0) AS DOUBLE) END AS sentiment_score,
 CASE WHEN NOT is_reply THEN CASE WHEN likes > 10 THEN 'positive' ELSE 'neutral' END END AS sentiment_label,
 CASE WHEN NOT is_reply THEN 0.5::DOUBLE END AS sentiment_confidence FROM posts)"""


def clean(text: str, mentions=False, hashtags=False) -> str:
    out = f"regexp_replace({text}, '{URL}', '', 'g')"
    if mentions:
        out = rf"regexp_replace({out}, '@[\p{{L}}\p{{N}}_]+', '', 'g')"
    if hashtags:
        out = rf"regexp_replace({out}, '#[\p{{L}}\p{{N}}_]+', '', 'g')"
    return f"trim(regexp_replace(lower({out}), '{WS}+', ' ', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


POS, NEG = _list(ScoreConfig().positive), _list(ScoreConfig().negative)


def hit(word: str, keywords: str) -> str:
    return f"len(list_filter({keywords}, lambda k: contains({word}, k) OR contains(k, {word}))) > 0"


WORDS = f"""words AS (SELECT tweet_id, content, list_filter(string_split_regex(lower(regexp_replace(content, '{URL}', '', 'g')), '{WS}+'), lambda x: x <> '') AS ws FROM posts)"""
# each different word is tested once
HITS = f"""vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM words), marked AS (SELECT w, CAST({hit('w', POS)} AS INTEGER) AS p, CAST({hit('w', NEG)} AS INTEGER) AS n FROM vocabulary),
 counts AS (SELECT tweet_id, sum(p) AS p, sum(n) AS n FROM (SELECT tweet_id, unnest(ws) AS w FROM words) JOIN marked USING (w) GROUP BY tweet_id)"""
KEYWORD = """keyword_raw AS (SELECT tweet_id, content, CAST(coalesce(p, 0) AS INTEGER) AS p, CAST(coalesce(n, 0) AS INTEGER) AS n, CAST(len(ws) AS INTEGER) AS n_words FROM words LEFT JOIN counts USING (tweet_id)),
 keyword_score AS (SELECT *, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p - n)::DOUBLE / greatest(n_words, 1) * 2)) END AS score,
 CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE least((p + n)::DOUBLE / greatest(n_words, 1) + 0.1::DOUBLE, 1.0::DOUBLE) END AS confidence FROM keyword_raw),
 keyword AS (SELECT *, CASE WHEN abs(score) < 0.1 THEN 'neutral' WHEN score > 0 THEN 'positive' ELSE 'negative' END AS label FROM keyword_score)"""
LEXICON = f"""lexicon AS (SELECT DISTINCT token, CAST(length(token) % 9 - 4 AS DOUBLE) AS valence FROM (SELECT regexp_replace(unnest(string_split_regex(lower(text), '{WS}+')), '[^a-zà-ÿ]', '', 'g') AS token FROM benchmark) WHERE token <> ''),
 spoken AS (SELECT tweet_id, unnest(string_split_regex(content, '{WS}+')) AS w FROM posts),
 rating AS (SELECT tweet_id, sum(valence) AS total FROM (SELECT tweet_id, lower(CASE WHEN length(trim(w, '{PUNCTUATION}')) < 2 THEN w ELSE trim(w, '{PUNCTUATION}') END) AS token FROM spoken) JOIN lexicon USING (token) GROUP BY tweet_id),
 lexed AS (SELECT tweet_id, coalesce(total / sqrt(total * total + 15), 0.0::DOUBLE) AS compound FROM posts LEFT JOIN rating USING (tweet_id))"""
_RULES = LexiconRules()
_MORE, _LESS, _DENY = (_list(sorted(w)) for w in (_RULES.boosters, _RULES.dampers, _RULES.negations))
# the lexicon's rules word by word; the shares count rated words, so sums start from them
RULED = f"""said AS (SELECT tweet_id, content, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT tweet_id, content, list_filter(string_split_regex(content, '{WS}+'), lambda x: x <> '') AS ws FROM posts)),
 bared AS (SELECT *, CASE WHEN length(trim(w, '{PUNCTUATION}')) < 2 THEN w ELSE trim(w, '{PUNCTUATION}') END AS b FROM said),
 marked_words AS (SELECT tweet_id, i, lower(b) AS low, (regexp_matches(b, '\\p{{Lu}}') AND NOT regexp_matches(b, '\\p{{Ll}}'))::INTEGER AS u,
  CASE WHEN list_contains({_MORE}, lower(b)) THEN {_RULES.boost}::DOUBLE WHEN list_contains({_LESS}, lower(b)) THEN -{_RULES.boost}::DOUBLE ELSE 0.0::DOUBLE END AS step,
  (list_contains({_DENY}, replace(replace(lower(b), '''', ''), '’', '')) OR lower(b) LIKE '%n''t' OR lower(b) LIKE '%n’t')::INTEGER AS d FROM bared),
 around AS (SELECT *, sum(u) OVER t AS capitals, count(*) OVER t AS n, min(CASE WHEN low = 'but' THEN i END) OVER t AS turn,
  lag(step, 1, 0.0::DOUBLE) OVER o AS s1, lag(step, 2, 0.0::DOUBLE) OVER o AS s2, lag(step, 3, 0.0::DOUBLE) OVER o AS s3, lag(u, 1, 0) OVER o AS u1, lag(u, 2, 0) OVER o AS u2, lag(u, 3, 0) OVER o AS u3,
  greatest(lag(d, 1, 0) OVER o, lag(d, 2, 0) OVER o, lag(d, 3, 0) OVER o) AS denied FROM marked_words WINDOW t AS (PARTITION BY tweet_id), o AS (PARTITION BY tweet_id ORDER BY i)),
 pushed AS (SELECT a.tweet_id, i, turn, denied, valence, sign(valence) AS g, capitals > 0 AND capitals < n AS loud, u, s1, s2, s3, u1, u2, u3
  FROM around a JOIN lexicon ON token = low WHERE valence <> 0 AND step = 0),
 valued AS (SELECT tweet_id, (valence + g * CASE WHEN loud AND u = 1 THEN {_RULES.caps} ELSE 0 END
  + g * ((s1 + sign(s1) * CASE WHEN loud AND u1 = 1 THEN {_RULES.caps} ELSE 0 END) * {_RULES.fade[0]} + (s2 + sign(s2) * CASE WHEN loud AND u2 = 1 THEN {_RULES.caps} ELSE 0 END) * {_RULES.fade[1]}
  + (s3 + sign(s3) * CASE WHEN loud AND u3 = 1 THEN {_RULES.caps} ELSE 0 END) * {_RULES.fade[2]})) * CASE WHEN denied = 1 THEN {_RULES.negation} ELSE 1 END
  * CASE WHEN turn IS NULL OR i = turn THEN 1 WHEN i < turn THEN {_RULES.before_but} ELSE {_RULES.after_but} END AS v FROM pushed),
 summed AS (SELECT tweet_id, sum(v)::DOUBLE AS total, coalesce(sum(v + 1) FILTER (v > 0), 0)::DOUBLE AS up, -coalesce(sum(v - 1) FILTER (v < 0), 0)::DOUBLE AS down, count_if(v <> 0) AS rated FROM valued GROUP BY tweet_id),
 sized AS (SELECT tweet_id, count(*) AS n FROM said GROUP BY tweet_id),
 pressed AS (SELECT p.tweet_id, coalesce(total, 0.0::DOUBLE) AS total, coalesce(up, 0.0::DOUBLE) AS up, coalesce(down, 0.0::DOUBLE) AS down, coalesce(n, 0) - coalesce(rated, 0) AS flat,
  least(length(content) - length(replace(content, '!', '')), 4) * {_RULES.exclamation} + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * {_RULES.question} ELSE {_RULES.many_questions} END AS e
  FROM (SELECT *, length(content) - length(replace(content, '?', '')) AS q FROM posts) p LEFT JOIN summed USING (tweet_id) LEFT JOIN sized USING (tweet_id)),
 shared AS (SELECT tweet_id, total + sign(total) * e AS total, up + CASE WHEN up > down THEN e ELSE 0 END AS up, down + CASE WHEN up < down THEN e ELSE 0 END AS down, flat FROM pressed),
 ruled AS (SELECT *, total / sqrt(total * total + {_RULES.alpha}) AS compound, CASE WHEN up + down + flat = 0 THEN 1 ELSE up + down + flat END AS whole FROM shared)"""
SCORED = f"""{POSTS}, {WORDS}, {HITS}, {KEYWORD}, scored AS (SELECT p.* EXCLUDE (sentiment_score, sentiment_label, sentiment_confidence),
 CASE WHEN p.content <> '' THEN k.score END AS sentiment_score, CASE WHEN p.content <> '' THEN CASE WHEN k.confidence < 0.3 THEN 'neutral' ELSE k.label END END AS sentiment_label,
 CASE WHEN p.content <> '' THEN k.confidence END AS sentiment_confidence FROM posts p JOIN keyword k USING (tweet_id))"""

_COUNTS = """count_if(sentiment_score > 0.1) AS positive_tweets, count_if(sentiment_score < -0.1) AS negative_tweets,
 count_if(sentiment_score BETWEEN -0.1 AND 0.1) AS neutral_tweets, min(CASE WHEN sentiment_score IS NOT NULL THEN timestamp END) AS earliest_tweet,
 max(CASE WHEN sentiment_score IS NOT NULL THEN timestamp END) AS latest_tweet"""
MEASURES = f"count(sentiment_score) AS total_tweets, round(avg(sentiment_score), 6) AS avg_sentiment, {_COUNTS}"
MEASURES_RAW = f"count(sentiment_score) AS total_tweets, avg(sentiment_score) AS avg_sentiment, {_COUNTS}"
RECENT = "timestamp >= (SELECT max(timestamp) FROM posts) - INTERVAL 24 HOUR"
SIGNAL = """CASE WHEN total_tweets = 0 THEN 'HOLD' WHEN avg_sentiment > 0.3 AND positive_tweets / total_tweets > 0.6 THEN 'BUY'
 WHEN avg_sentiment < -0.3 AND negative_tweets / total_tweets > 0.6 THEN 'SELL' ELSE 'HOLD' END AS signal,
 round(CASE WHEN total_tweets = 0 THEN 0.0::DOUBLE WHEN avg_sentiment > 0.3 AND positive_tweets / total_tweets > 0.6 THEN least(0.9::DOUBLE, avg_sentiment + positive_tweets / total_tweets * 0.5::DOUBLE)
 WHEN avg_sentiment < -0.3 AND negative_tweets / total_tweets > 0.6 THEN least(0.9::DOUBLE, abs(avg_sentiment) + negative_tweets / total_tweets * 0.5::DOUBLE) ELSE 0.5::DOUBLE END, 6) AS confidence,
 round(CASE WHEN total_tweets = 0 THEN 0.0::DOUBLE ELSE avg_sentiment END, 6) AS sentiment_score, total_tweets AS tweet_count"""
WINDOWS = """w AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) - b * INTERVAL 5 MINUTE AS window_start,
 time_bucket(INTERVAL 5 MINUTE, timestamp) - b * INTERVAL 5 MINUTE + INTERVAL 15 MINUTE AS window_end, scored.* FROM scored, range(3) AS r(b) WHERE sentiment_score IS NOT NULL)"""

ATTEMPTS = "attempts AS (SELECT 'feed' || user_id % 3 AS feed, 'user' || user_id AS target, ts, epoch_us(ts) AS us, event_type <> 'error' AS success, value / 10 AS response_time, event_id FROM events)"
LOAD = f"""{ATTEMPTS}, moments AS (SELECT feed, ts, us, count(*) AS n FROM attempts GROUP BY ALL),
 running AS (SELECT m.feed, m.us, count(*) AS active FROM moments m JOIN attempts a ON a.feed = m.feed AND a.us < m.us AND a.us + CAST(round(a.response_time * 1000000) AS BIGINT) > m.us GROUP BY ALL),
 load AS (SELECT m.*, coalesce(sum(n) OVER minute, 0) AS minute_count, coalesce(sum(n) OVER hour, 0) AS hour_count, coalesce(sum(n) OVER mirror, 0) AS mirror_count,
 min(us) OVER minute AS oldest, min(us) OVER mirror AS mirror_oldest, coalesce(active, 0) AS active FROM moments m LEFT JOIN running USING (feed, us)
 WINDOW minute AS (PARTITION BY feed ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING),
 hour AS (PARTITION BY feed ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING),
 mirror AS (PARTITION BY feed ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING))"""
_LIMITS = """CASE feed WHEN 'feed0' THEN 1 WHEN 'feed1' THEN 30 ELSE 20 END AS rpm, CASE feed WHEN 'feed0' THEN 5 WHEN 'feed1' THEN 3 ELSE 500 END AS rph,
 CASE feed WHEN 'feed0' THEN 2 WHEN 'feed1' THEN 5 ELSE 3 END AS atonce"""
LIMITED = f"limited AS (SELECT *, minute_count < rpm AND hour_count < rph AND active < atonce AS allowed FROM (SELECT *, {_LIMITS} FROM load))"
EMA = """ema AS (SELECT feed, count(*) AS n, list_reduce(list_prepend(1.0::DOUBLE, list(success::INTEGER::DOUBLE ORDER BY ts, event_id)), lambda a, b: 0.9::DOUBLE * a + 0.1::DOUBLE * b) AS success_rate,
 list_reduce(list(response_time ORDER BY ts, event_id), lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b) AS avg_response_time FROM attempts GROUP BY feed)"""


def _streak(key: str, name: str) -> str:
    return f"""{name}_last AS (SELECT {key}, max(CASE WHEN success THEN ts END) AS last_success, max(CASE WHEN NOT success THEN ts END) AS last_failure FROM attempts GROUP BY {key}),
 {name} AS (SELECT l.*, count_if(NOT a.success AND (l.last_success IS NULL OR a.ts > l.last_success)) AS consecutive_failures FROM {name}_last l JOIN attempts a USING ({key}) GROUP BY ALL)"""


STREAK = _streak("feed", "streak")
TARGET_STATE = _streak("target", "ts_raw") + ", tstate AS (SELECT target, last_success AS last_scraped, consecutive_failures AS error_count FROM ts_raw)"
STATE = f"""{ATTEMPTS}, {EMA}, {STREAK}, now_load AS (SELECT feed, count_if(us >= m - 60000000) AS minute_count, count_if(us >= m - 3600000000) AS hour_count, min(CASE WHEN us >= m - 60000000 THEN us END) AS oldest,
 count_if(us + CAST(round(response_time * 1000000) AS BIGINT) > m) AS active, any_value(m) AS m FROM attempts, (SELECT max(us) AS m FROM attempts) GROUP BY feed),
 limits AS (SELECT *, minute_count < rpm AND hour_count < rph AND active < atonce AS can_make_request FROM (SELECT *, {_LIMITS} FROM now_load)),
 told AS (SELECT *, CASE WHEN consecutive_failures >= 5 THEN 'failed' WHEN NOT can_make_request THEN 'rate_limited' WHEN success_rate < 0.7 OR avg_response_time > 30 THEN 'degraded'
 WHEN last_success IS NULL THEN 'unknown' ELSE 'healthy' END AS status, CASE WHEN NOT can_make_request AND minute_count >= rpm THEN greatest(0.0::DOUBLE, 60.0 - (m - oldest) / 1000000.0) ELSE 0.0::DOUBLE END AS wait_time,
 (success_rate + greatest(0.0::DOUBLE, 1.0 - avg_response_time / 30.0)) / 2.0 AS weight FROM limits JOIN ema USING (feed) JOIN streak USING (feed)),
 state AS (SELECT *, can_make_request AND status IN ('healthy', 'degraded', 'unknown') AS usable FROM told)"""
