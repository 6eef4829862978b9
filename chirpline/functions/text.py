"""Text and link functions as Column expressions."""

from pyspark.sql import Column, functions as F

# What counts as whitespace, a word character and a URL.
# Whitespace is spelled out because the regex engine's own class is narrower.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
WORD = r"[\p{L}\p{N}_]"
# Letters, digits and the range "$" to "_" (which holds / : ; = ? % and more), and "!".
# One character class, so a URL of any length is matched without recursion.
URL = r"https?://[!$-_a-z]+"


def strip(text: Column) -> Column:
    """Cut whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def without_urls(text: Column) -> Column:
    # the substring test is far cheaper than the regex, and most texts have no link
    return F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, URL, "")).otherwise(text)


def normalise(text: Column, *, remove_urls=True, remove_mentions=False, remove_hashtags=False, lowercase=True) -> Column:
    """The cleaning steps that come before whitespace is collapsed."""
    out = without_urls(text) if remove_urls else text
    if remove_mentions:
        out = F.regexp_replace(out, f"@{WORD}+", "")
    if remove_hashtags:
        out = F.regexp_replace(out, f"#{WORD}+", "")
    return F.lower(out) if lowercase else out


def clean_text(text: Column, **switches) -> Column:
    """Cleaned text: switches applied, runs of whitespace made one space, ends cut."""
    return F.btrim(F.regexp_replace(normalise(text, **switches), WHITESPACE, " "))


def spaced(text: Column, **switches) -> Column:
    """Cleaned text with a plain space for every whitespace character."""
    return F.translate(normalise(text, **switches), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))


def words_of(spaced_text: Column) -> Column:
    # splitting at one plain character needs no regex
    return F.array_remove(F.split(spaced_text, " "), "")


def tokens(text: Column, **switches) -> Column:
    """Words of the cleaned text; no words for an empty text."""
    return words_of(spaced(text, **switches))


def hashtags(text: Column) -> Column:
    """Lower-case tags of a text without the ``#``."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"#({WORD}+)"), F.lit(1)), F.lower)


def flatten_lines(text: Column) -> Column:
    """Strip, then turn each line break into a space."""
    return F.translate(strip(text), "\n", " ")


def preview(text: Column, length: int = 50) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


MOST = 2 ** 31 - 1


def count_from_text(text: Column) -> Column:
    """``"1,234"`` to 1234; empty, missing or unreadable text is 0. A count that no integer column holds is the largest that one holds."""
    number = strip(F.translate(text, ",", "")).try_cast("long")
    held = F.when(number > MOST, MOST).when(number < -MOST - 1, -MOST - 1).otherwise(number)
    return F.coalesce(held.cast("int"), F.lit(0))


def sanitise_username(name: Column) -> Column:
    # Fixed value: "+" to ":" is a range, it keeps + , - . / the digits and :
    return F.regexp_replace(name, r"[^A-Za-z0-9_+-:]", "")


def id_from_link(link: Column) -> Column:
    """Last part of the link's path; query and fragment do not count."""
    path = F.regexp_replace(link, r"[?#].*$", "")
    tail = F.substring_index(path, "/", -1)
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit("unknown"))


def feed_tag(feed: str, mirror: Column | None = None) -> Column:
    return F.lit(feed) if mirror is None else F.concat(F.lit(feed + ":"), mirror)


# Where media and avatars live.
MEDIA_HOST = "https://pbs.twimg.com"
SITE = "https://twitter.com"
DEFAULT_AVATAR = "https://abs.twimg.com/sticky/default_profile_images/default_profile_normal.png"


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and passes malformed input through."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def base64_tail(src: Column) -> Column:
    """The last path part, decoded from base64."""
    return F.try_to_binary(F.substring_index(src, "/", -1), F.lit("base64")).cast("string")


def _cut_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def _after(text: Column, mark: str) -> Column:
    """What lies between the first ``mark`` and the next one."""
    return F.get(F.split(text, mark), F.lit(1))


def picture_url(src: Column, encoded: Column) -> Column:
    return F.when(encoded, F.concat(F.lit(MEDIA_HOST + "/"), _cut_query(base64_tail(src)))).otherwise(
        F.concat(F.lit(MEDIA_HOST), _cut_query(percent_decode(_after(src, "/pic")))))


def video_url(data_url: Column, src: Column, encoded: Column) -> Column:
    plain = F.concat(F.lit("https"), _after(data_url, "https"))
    return F.when(data_url.isNull(), src).when(encoded, base64_tail(data_url)).otherwise(percent_decode(plain))


def gif_url(src: Column, encoded: Column) -> Column:
    return F.when(encoded, F.concat(F.lit("https://"), base64_tail(src))).otherwise(
        percent_decode(F.concat(F.lit("https://"), _after(src, "/pic/"))))


def avatar_url(src: Column, encoded: Column) -> Column:
    decoded = F.when(encoded, F.concat(F.lit(MEDIA_HOST + "/"), base64_tail(src))).otherwise(percent_decode(src))
    return F.coalesce(decoded, F.lit(DEFAULT_AVATAR))


def profile_id(avatar: Column) -> Column:
    found = F.regexp_extract(avatar, r"/profile_images/([^/]*)", 1)
    return F.when(F.contains(avatar, F.lit("/profile_images/")), found).otherwise(F.lit("unknown"))


# Date formats of the feeds, tried in this order.
DATE_FORMATS = [
    "MMM d, yyyy · h:mm a z",
    "MMM d, yyyy h:mm a z",
    "MMM d, yyyy",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d HH:mm:ss xx yyyy",
]
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"


def parse_date(text: Column) -> Column:
    """The site's own format, then a few common ones, then ISO; null if none fits."""
    trimmed = F.regexp_replace(strip(text), WEEKDAY, "")
    iso = F.when(F.rlike(trimmed, F.lit(r"^\d{4}-\d{2}")), trimmed.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(trimmed, F.lit(f)) for f in DATE_FORMATS])
