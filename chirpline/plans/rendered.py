"""Posts and users rendered as the saved pages the extractor reads."""

from pyspark.sql import Column, DataFrame, functions as F

PER_PAGE = 20


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _page(body: Column) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><body><div class=\"timeline\">"), body, F.lit("</div></body></html>"))


def timeline_pages(posts: DataFrame) -> DataFrame:
    """Twenty posts to a page by id. Signups' posts are thread items, purchases' end a thread."""
    number = F.col("tweet_id").cast("long")
    status = F.concat(F.lit("/"), F.col("username"), F.lit("/status/"), F.col("tweet_id"), F.lit("#m"))
    date = F.date_format("timestamp", "MMM d, yyyy '·' h:mm a 'UTC'")

    def stat(value):
        return F.concat(F.lit("<span class=\"tweet-stat\"><div class=\"icon-container\"><span></span> "),
                        F.format_number(value, 0), F.lit("</div></span>"))

    item = F.concat(
        F.lit("<div class=\""), F.col("item_class"), F.lit("\"><div class=\"tweet-body\">"),
        F.when(F.col("is_retweet"), "<div class=\"retweet-header\">retweeted</div>").otherwise(""),
        F.lit("<img class=\"avatar\" src=\"/pic/profile_images%2F"), F.col("user_id"), F.lit("%2Fa.jpg\">"),
        F.lit("<a class=\"fullname\" href=\"/u\">User "), F.col("user_id"), F.lit("</a><a class=\"username\" href=\"/u\">"),
        F.col("username"), F.lit("</a><span class=\"tweet-date\"><a href=\""), status, F.lit("\" title=\""), date,
        F.lit("\">1h</a></span>"),
        F.when(F.col("is_reply"), F.concat(F.lit("<div class=\"replying-to\">Replying to <a href=\"/x\">@"),
                                           F.col("source_instance"), F.lit("</a></div>"))).otherwise(""),
        F.lit("<div class=\"tweet-content media-body\">"), _escaped(F.col("content")),
        F.lit("</div><div class=\"attachments\"><img src=\"/pic/media%2F"), F.col("tweet_id"),
        F.lit(".jpg%3Fname%3Dsmall\"></div><div class=\"quote\"><div class=\"quote-text\">"), F.col("lang"),
        F.lit("</div></div>"),
        stat(F.col("replies")), stat(F.col("retweets")), stat(F.lit(0)), stat(F.col("likes")),
        F.lit("</div></div>"))
    kind = F.when(F.col("event_type") == "signup", "timeline-item thread") \
        .when(F.col("event_type") == "purchase", "timeline-item thread thread-last").otherwise("timeline-item")
    page = F.floor(number / PER_PAGE)
    rows = posts.withColumn("item_class", kind).select(page.alias("page_id"), F.struct(number.alias("at"), item.alias("html")).alias("i"))
    grouped = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["html"]).alias("items"))
    more = F.concat(F.lit("<div class=\"show-more\"><a href=\"?cursor="), F.col("page_id"), F.lit("\">Load more</a></div>"))
    return grouped.select(
        "page_id", F.concat(F.lit("https://mirror.example/search?f=tweets&q="), F.col("page_id")).alias("url"),
        _page(F.concat(F.array_join("items", "\n"), more)).alias("html"))


def profile_pages(users: DataFrame) -> DataFrame:
    """One profile page per user ``(user_id, posts, likes)``."""
    def stat(name, value):
        return F.concat(F.lit(f"<li class=\"{name}\"><span>{name}</span><span>"), F.format_number(value, 0), F.lit("</span></li>"))

    body = F.concat(
        F.lit("<div class=\"profile-banner\"><img src=\"/pic/https%3A%2F%2Fpbs.twimg.com%2Fprofile_banners%2F"), F.col("user_id"),
        F.lit("%2F1500x500\"></div><a class=\"profile-card-avatar\" href=\"/x\"><img src=\"/pic/pbs.twimg.com%2Fprofile_images%2F"),
        F.col("user_id"), F.lit("%2Fa.jpg\"></a><a class=\"profile-card-fullname\" href=\"/u\"> User "), F.col("user_id"),
        F.lit(" </a><a class=\"profile-card-username\" href=\"/u\">@user"), F.col("user_id"),
        F.lit("</a><div class=\"profile-bio\"><p>Writes &amp; reads</p></div>"
              "<div class=\"profile-location\"><span>icon</span><span>Place "), F.col("user_id"),
        F.lit("</span></div><div class=\"profile-joindate\"><span title=\"1 Jan 2024\">Joined</span></div>"
              "<ul class=\"profile-statlist\">"),
        stat("posts", F.col("posts")), stat("following", F.lit(1234)), stat("followers", F.lit(0)), stat("likes", F.col("likes")),
        F.lit("</ul><div class=\"photo-rail-header\"><div class=\"icon-container\">12 Photos</div></div>"))
    return users.select(F.col("user_id").alias("page_id"), F.concat(F.lit("/user"), F.col("user_id")).alias("url"), _page(body).alias("html"))


def follow_pages(edges: DataFrame) -> DataFrame:
    """Pages of the lists ``(username, page_no, pos, other)``, at most a page's worth of names each."""
    name = F.concat(F.lit("<a class=\"username\" href=\"/u\"> "), F.col("other"), F.lit(" </a>"))
    grouped = edges.groupBy("username", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("a")))), lambda i: i["a"]), "").alias("body"))
    return grouped.select(
        F.concat_ws("/", "username", "page_no").alias("page_id"), F.concat(F.lit("/"), "username", F.lit("/following")).alias("url"),
        _page(F.col("body")).alias("html"), "username", F.lit("following").alias("direction"), "page_no")


def failed_pages(posts: DataFrame) -> DataFrame:
    """A page for each post, which shows what the number of the post asks for: an error, a protected account, too little, nothing, or a post."""
    number = F.col("tweet_id").cast("long") % 7
    status = F.concat(F.lit("/u/status/"), F.col("tweet_id"))
    post = F.concat(F.lit("<div class=\"timeline-item\"><div class=\"tweet-body\"><span class=\"tweet-date\"><a href=\""), status,
                    F.lit("\" title=\"x\">1h</a></span></div></div>"))
    body = (F.when(number == 0, F.concat(F.lit("<div class=\"error-panel\"><span> No "), F.col("user_id"), F.lit(" </span></div>")))
            .when(number == 1, F.lit("<div class=\"timeline-header timeline-protected\"><h2>protected</h2></div>"))
            .when(number == 2, F.lit("<p>short</p>"))
            .when(number == 3, F.lit("<p>nothing here</p>"))
            .when(number == 4, F.lit("<div class=\"timeline&#45;item\">written with an entity</div>"))
            .otherwise(post))
    padding = F.when(number == 2, F.lit("")).otherwise(F.concat(F.lit("<!--"), F.repeat(F.lit("x"), 2000), F.lit("-->")))
    url = F.when(F.col("is_reply"), "https://mirror.example/search?q=x").otherwise("https://mirror.example/u")
    return posts.select(F.col("tweet_id").alias("page_id"), url.alias("url"), _page(F.concat(body, padding)).alias("html"),
                        (number != 6).alias("http_ok"))


def odd_pages(posts: DataFrame) -> DataFrame:
    """A page for each post with what few pages have: encoded media, quotes that are gone, links to other sites, videos and gifs."""
    number = F.col("tweet_id").cast("long")
    encoded = number % 2 == 0
    coded = lambda text: F.base64(F.encode(text, "utf-8"))
    picture = F.when(encoded, F.concat(F.lit("/pic/enc/"), coded(F.concat(F.lit("media/"), F.col("tweet_id"), F.lit(".jpg"))))).otherwise(
        F.concat(F.lit("/pic/media%2F"), F.col("tweet_id"), F.lit(".jpg%3Fname%3Dsmall")))
    avatar = F.when(encoded, F.concat(F.lit("/pic/enc/"), coded(F.concat(F.lit("profile_images/"), F.col("user_id"), F.lit("/a.jpg"))))).otherwise(
        F.concat(F.lit("/pic/profile_images%2F"), F.col("user_id"), F.lit("%2Fa.jpg")))
    video = F.when(encoded, F.concat(F.lit("/video/enc/F/"), coded(F.concat(F.lit("https://v.example/"), F.col("tweet_id"), F.lit(".m3u8"))))).otherwise(
        F.concat(F.lit("/video/1/https%3A%2F%2Fv.example%2F"), F.col("tweet_id"), F.lit(".m3u8")))
    quote = F.when(number % 3 == 0, F.lit("<div class=\"quote unavailable\">gone</div>")).otherwise(F.concat(
        F.lit("<div class=\"quote\"><a class=\"fullname\" href=\"/q\">Q</a><a class=\"username\" href=\"/q\">@q</a><span class=\"tweet-date\"><a href=\"/q/status/"),
        F.col("user_id"), F.lit("\" title=\"x\">1h</a></span><div class=\"quote-text\">quoted</div></div>")))
    body = F.concat(
        F.lit("<div class=\"timeline-item\"><div class=\"tweet-body\"><img class=\"avatar\" src=\""), avatar, F.lit("\"><span class=\"tweet-date\"><a href=\"/u/status/"),
        F.col("tweet_id"), F.lit("\" title=\"x\">1h</a></span><div class=\"tweet-content media-body\">see <a href=\"https://site.example/"), F.col("user_id"),
        F.lit("?a=1&amp;b=2\">site.example/…</a> and <a href=\"/u\">@u</a></div><div class=\"attachments\"><img src=\""), picture,
        F.lit("\"><video data-url=\""), video, F.lit("\"></video></div>"), quote, F.lit("</div></div>"))
    return posts.select(F.col("tweet_id").alias("page_id"), F.lit("https://mirror.example/u").alias("url"), _page(body).alias("html"))
