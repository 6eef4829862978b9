"""Posts, profiles and follow lists out of saved HTML pages.

Python only walks the markup and returns raw strings, in Arrow batches.
Decoding of links, media, counts and dates is done by column functions.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chirpline.functions import text as tx
from chirpline.operators.skew import spread
from chirpline.sources.markup import Node, parse

MIN_PAGE_BYTES = 2000

_S, _B, _N = T.StringType(), T.BooleanType(), T.IntegerType()
_STRINGS = T.ArrayType(_S)


def _fields(**types) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in types.items()]


_POST = _fields(
    href=_S, title=_S, text=_S, author=T.StructType(_fields(name=_S, username=_S, avatar=_S)), pictures=_STRINGS,
    videos=T.ArrayType(T.StructType(_fields(data_url=_S, src=_S))), gifs=_STRINGS)
_ITEM = T.StructType([
    *_fields(pos=_N, classes=_STRINGS), *_POST,
    *_fields(is_retweet=_B, is_pinned=_B, external_link=_S, card_link=_S, replying_to=_STRINGS, stats=_STRINGS,
             quote_classes=_STRINGS, quote=T.StructType(_POST))])
_KEYS = _fields(page_id=_S, url=_S)
_PAGE_SIGNS = T.StructType([*_KEYS, *_fields(
    error_text=_S, has_error_panel=_B, is_protected=_B, n_items=_N, n_plain_items=_N, is_encoded=_B, next_href=_S)])
_PAGE = T.StructType([*_PAGE_SIGNS.fields, *_fields(items=T.ArrayType(_ITEM))])
_PROFILE = T.StructType([*_KEYS, *_fields(
    avatar_src=_S, banner_src=_S, is_encoded=_B, name=_S, username=_S, bio=_S, location=_S, website=_S, joined=_S,
    stats=_STRINGS, media=_S)])
_FOLLOW = T.StructType([*_KEYS, *_fields(usernames=_STRINGS, next_href=_S)])


def _attr(node: Node | None, name: str):
    return node.attrs.get(name) if node is not None else None


def _text(node: Node | None):
    return node.text() if node is not None else None


def _media(box: Node | None) -> dict:
    if box is None:
        return {"pictures": [], "videos": [], "gifs": []}
    return {
        "pictures": [s for s in (_attr(i, "src") for i in box.all("img")) if s is not None],
        "videos": [{"data_url": _attr(v, "data-url"), "src": _attr(v.first("source"), "src")} for v in box.all("video", "")],
        "gifs": [s for s in (_attr(v.first("source"), "src") for v in box.all("video", "gif")) if s is not None],
    }


def _post(node: Node, box: Node | None) -> dict:
    date = node.first("span", "tweet-date")
    link = date.first("a") if date is not None else None
    body = node.first("div", "tweet-content media-body") or node.first("div", "quote-text")
    return {
        "href": _attr(link, "href"), "title": _attr(link, "title"), "text": _text(body),
        "author": {"name": _text(node.first("a", "fullname")), "username": _text(node.first("a", "username")),
                   "avatar": _attr(node.first("img", "avatar"), "src")},
        **_media(box),
    }


def _item(pos: int, node: Node) -> dict:
    card = _attr(node.first("a", "card-container"), "href")
    # anchors to another site are shown as their address
    node.links_to_text(lambda href: "https" in href)
    quote = node.first("div", "quote")
    body = node.first("div", "tweet-body")
    own = [n for n in body.inside if isinstance(n, Node) and n.tag == "div" and n.is_a("attachments")] if body is not None else []
    replying = node.first("div", "replying-to")
    return {
        "pos": pos, "classes": node.classes, **_post(node, own[0] if own else None),
        "is_retweet": node.first("div", "retweet-header") is not None,
        "is_pinned": node.first("div", "pinned") is not None,
        "external_link": _attr(node.first("a", "card-container"), "href"), "card_link": card,
        "replying_to": [a.text() for a in replying.all("a")] if replying is not None else [],
        "stats": [_text(s.first("div")) for s in node.all("span", "tweet-stat")],
        "quote_classes": quote.classes if quote is not None else None,
        "quote": _post(quote, quote.first("div", "attachments")) if quote is not None else None,
    }


def _last_more(page: Node):
    more = page.all("div", "show-more")
    return _attr(more[-1].first("a"), "href") if more else None


def _encoded(page: Node) -> bool:
    card = page.first("a", "profile-card-avatar")
    avatars = [card.first("img")] if card is not None else []
    return any("/enc/" in (_attr(i, "src") or "") for i in [*avatars, *page.all("img", "avatar")])


def _signs(page_id, url, page: Node, found: list[Node]) -> dict:
    panel = page.first("div", "error-panel")
    return {
        "page_id": page_id, "url": url, "error_text": _text(panel.first("span")) if panel is not None else None,
        "has_error_panel": panel is not None,
        "is_protected": page.first("div", "timeline-header timeline-protected") is not None,
        "n_items": len(found),
        "n_plain_items": sum(n.classes in (["timeline-item"], ["timeline-item", "thread"]) for n in found),
        "is_encoded": _encoded(page), "next_href": _last_more(page),
    }


def _page_signs(page_id, url, html) -> dict:
    page = parse(html or "")
    return _signs(page_id, url, page, page.all("div", "timeline-item"))


def _page(page_id, url, html) -> dict:
    page = parse(html or "")
    found = page.all("div", "timeline-item")
    # reading an item replaces its links, so the page's own signs come first
    return {**_signs(page_id, url, page, found), "items": [_item(i, n) for i, n in enumerate(found)]}


def _profile(page_id, url, html) -> dict | None:
    page = parse(html or "")
    name = page.first("a", "profile-card-fullname")
    if name is None:
        return None

    def within(tag, cls, inner, last=False):
        box = page.first(tag, cls)
        found = box.all(inner) if box is not None else []
        return (found[-1] if last else found[0]) if found else None

    stats = page.first("ul", "profile-statlist")

    def stat(cls):
        row = stats.first("li", cls) if stats is not None else None
        spans = row.all("span") if row is not None else []
        return spans[1].text() if len(spans) > 1 else None

    rail = page.first("div", "photo-rail-header")
    return {
        "page_id": page_id, "url": url,
        "avatar_src": _attr(within("a", "profile-card-avatar", "img"), "src"),
        "banner_src": _attr(within("div", "profile-banner", "img"), "src"), "is_encoded": _encoded(page),
        "name": name.text(), "username": _text(page.first("a", "profile-card-username")),
        "bio": _text(within("div", "profile-bio", "p")),
        "location": _text(within("div", "profile-location", "span", last=True)),
        "website": _attr(within("div", "profile-website", "a"), "href"),
        "joined": _attr(within("div", "profile-joindate", "span"), "title"),
        "stats": [stat(c) for c in ("posts", "following", "followers", "likes")],
        "media": _text(rail.first("div", "icon-container")) if rail is not None else None,
    }


def _follow(page_id, url, html) -> dict:
    page = parse(html or "")
    more = page.first("div", "show-more")
    return {"page_id": page_id, "url": url, "usernames": [a.text() for a in page.all("a", "username")],
            "next_href": _attr(more.first("a"), "href") if more is not None else None}


def _extract(pages: DataFrame, read, fields: T.StructType, carry: dict[str, Column] | None = None) -> DataFrame:
    """Run one reader over ``(page_id, url, html)``; pages leave in small batches.

    ``carry`` names further columns that go through with their page, so that
    the result need not be joined back to its pages.
    """
    carry = carry or {}
    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", *[c.alias(n) for n, c in carry.items()])
    names = list(carry)
    out = T.StructType([*fields.fields, *[slim.schema[n] for n in names]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64).to_pylist()
                found = ((read(p["page_id"], p["url"], p["html"]), p) for p in part)
                rows = [{**r, **{n: p[n] for n in names}} for r, p in found if r is not None]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # markup costs far more to walk than to read
    return spread(slim, "page_id", "url", "html").mapInArrow(run, out)


def parse_pages(pages: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row per page: its error signs, paging link and raw items, and the columns to ``carry``."""
    return _extract(pages, _page, _PAGE, {n: F.col(n) for n in carry})


#: Every sign of a page stands in one of these texts, or in a class that is written with entities.
MARKERS = ("error-panel", "timeline-", "show-more", "/enc/", "&#", "/enc&")
ENTITY_CLASS = r"class\s*=\s*[\"']?[^\"'>]*&"


def page_signs(pages: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """Each page's error signs, numbers of items and paging link; items are not extracted.

    Pages that hold none of the texts that make a sign are settled by that:
    their markup is not sent to Python.
    """
    html = F.col("html")
    marked = F.rlike(html, F.lit("|".join([*MARKERS, ENTITY_CLASS])))
    return _extract(pages.withColumn("html", F.when(marked, html)), _page_signs, _PAGE_SIGNS, carry)


def page_status(pages: DataFrame, min_bytes: int = MIN_PAGE_BYTES) -> DataFrame:
    """Which pages can be used, and why the others cannot.

    ``http_ok`` may be a column of ``pages``. ``valid`` is the request check,
    ``has_content`` the extractor's own; each comes with its reason.
    """
    ok = F.col("http_ok") if "http_ok" in pages.columns else F.lit(True)
    sized = pages.withColumns({"__bytes": F.octet_length("html"), "__ok": ok})
    found = page_signs(sized, {"n_bytes": F.col("__bytes"), "http_ok": F.col("__ok")})
    search = F.contains(F.col("url"), F.lit("/search?"))
    reason = (F.when(~F.col("http_ok"), "HTTP error").when(F.col("n_bytes") < min_bytes, "Response too small")
              .when(F.col("has_error_panel"), F.concat(F.lit("Error: "), F.coalesce(tx.strip(F.col("error_text")), F.lit(""))))
              .when(F.col("is_protected"), "Protected account")
              .when(~search & (F.col("n_items") == 0), "No timeline content"))
    content = (F.when(F.col("n_plain_items") > 0, None)
               .when(F.col("has_error_panel"), F.concat(F.lit("Fetching error: "), F.coalesce(tx.strip(F.col("error_text")), F.lit(""))))
               .when(F.col("is_protected"), "Account is protected").otherwise("Empty page"))
    return found.select("page_id", "url", "n_bytes", reason.isNull().alias("valid"), reason.alias("reason"),
                        content.isNull().alias("has_content"), content.alias("content_reason"),
                        "n_items", "is_encoded", "next_href")


def _user(author: Column, encoded: Column) -> Column:
    avatar = tx.avatar_url(author["avatar"], encoded)
    return F.struct(tx.strip(author["name"]).alias("name"), tx.strip(author["username"]).alias("username"),
                    tx.profile_id(avatar).alias("profile_id"), avatar.alias("avatar"))


def _decoded_media(post, encoded: Column) -> list[Column]:
    return [
        F.transform(post("pictures"), lambda s: tx.picture_url(s, encoded)).alias("pictures"),
        F.transform(post("videos"), lambda v: tx.video_url(v["data_url"], v["src"], encoded)).alias("videos"),
        F.transform(post("gifs"), lambda s: tx.gif_url(s, encoded)).alias("gifs"),
    ]


def _link(href: Column) -> Column:
    return F.when(href.isNull(), "").otherwise(F.concat(F.lit(tx.SITE), href))


def _date(title: Column) -> Column:
    return F.coalesce(F.substring_index(F.substring_index(title, "/", -1), "#", 1), F.lit(""))


def timeline_items(parsed: DataFrame, keep: list[str] = ("page_id",)) -> DataFrame:
    """One row per post of the parsed pages, decoded.

    ``kind`` is ``post`` or ``thread`` (``other`` for items that are neither),
    ``is_thread_end`` marks the item that ends its thread.
    """
    raw = parsed.select(*keep, "is_encoded", F.explode("items").alias("i")).select(*keep, "is_encoded", "i.*")
    encoded = F.col("is_encoded")
    href, quote = F.col("href"), F.col("quote")
    thread = F.array_contains("classes", "thread")
    gone = F.array_join("quote_classes", " ") == "quote unavailable"

    def stat(i):
        return tx.count_from_text(F.get("stats", F.lit(i)))

    def quoted(value):
        return F.when(gone, "").otherwise(value)

    quoted_post = F.struct(
        quoted(_link(quote["href"])).alias("link"),
        quoted(F.coalesce(tx.flatten_lines(quote["text"]), F.lit(""))).alias("text"),
        F.when(~gone, _user(quote["author"], encoded)).alias("user"),
        quoted(_date(quote["title"])).alias("date"),
        *_decoded_media(lambda f: quote[f], encoded))
    path = F.regexp_replace(_link(href), r"[?#].*$", "")
    return raw.select(
        *keep, "pos",
        F.when(F.size("classes") == 1, "post").when(thread, "thread").otherwise("other").alias("kind"),
        (thread & (F.size("classes") == 3)).alias("is_thread_end"),
        F.substring_index(path, "/", -1).alias("id"),
        _link(href).alias("link"),
        F.coalesce(tx.flatten_lines(F.col("text")), F.lit("")).alias("text"),
        _user(F.col("author"), encoded).alias("user"),
        _date(F.col("title")).alias("date"),
        "is_retweet", "is_pinned",
        F.coalesce("external_link", F.lit("")).alias("external_link"),
        F.coalesce("card_link", F.lit("")).alias("card_link"),
        F.transform("replying_to", tx.strip).alias("replying_to"),
        F.when(quote.isNotNull(), quoted_post).alias("quoted_post"),
        F.struct(stat(0).alias("comments"), stat(1).alias("retweets"), stat(2).alias("quotes"), stat(3).alias("likes")).alias("stats"),
        *_decoded_media(F.col, encoded))


def holding(saved: DataFrame, tweet_id: str) -> DataFrame:
    """The saved pages that may show a post: the only ones worth parsing for it."""
    return saved.filter(F.contains(F.col("html"), F.lit(f"/status/{tweet_id}")))


def post_by_id(items: DataFrame, tweet_id: str) -> DataFrame:
    """The post a status page was saved for: its first item."""
    return items.filter((F.col("pos") == 0) & (F.col("id") == tweet_id))


def next_url(parsed: DataFrame, mode: Column, term: Column, dated: Column) -> DataFrame:
    """The address of the page that follows, by search mode."""
    href = F.col("next_href")
    query = F.substring_index(href, "?", -1)
    user = F.concat(F.lit("/"), term, F.when(dated, "/search?").otherwise("?"), query)
    return parsed.withColumn("next_url", F.when(href.isNull(), None).when(mode == "user", user)
                             .otherwise(F.concat(F.lit("/search"), href)))


def profiles(pages: DataFrame) -> DataFrame:
    """One record per profile page."""
    raw = _extract(pages, _profile, _PROFILE)
    encoded = F.col("is_encoded")

    def decoded(src):
        part = F.get(F.split(src, "/enc/"), F.lit(1))
        return F.try_to_binary(part, F.lit("base64")).cast("string")

    banner = F.when(encoded, decoded(F.col("banner_src"))).otherwise(tx.percent_decode(F.col("banner_src")))
    owner = F.regexp_extract(banner, "profile_banners/([^/]*)", 1)
    plain = F.get(F.split(tx.percent_decode(F.col("avatar_src")), "/pic/"), F.lit(1))
    image = F.concat(F.lit("https://"), F.when(encoded, decoded(F.col("avatar_src"))).otherwise(plain))

    def clean(name):
        return F.coalesce(tx.strip(F.col(name)), F.lit("")).alias(name)

    names = ("tweets", "following", "followers", "likes")
    media = F.substring_index(F.translate(tx.strip(F.col("media")), ",", ""), " ", 1)
    return raw.select(
        "page_id", F.coalesce(image, F.lit("")).alias("image"), clean("name"), clean("username"),
        F.coalesce(owner, F.lit("")).alias("id"), clean("bio"), clean("location"),
        F.coalesce("website", F.lit("")).alias("website"), "joined",
        F.struct(*[tx.count_from_text(F.get("stats", F.lit(i))).alias(n) for i, n in enumerate(names)],
                 tx.count_from_text(media).alias("media")).alias("stats"))


def follow_edges(pages: DataFrame) -> DataFrame:
    """One row per name on the saved pages of follow lists.

    ``pages`` names the owner (``username``), the list (``direction``) and the
    page's place in it (``page_no``).
    """
    found = _extract(pages, _follow, _FOLLOW, {n: F.col(n) for n in ("username", "direction", "page_no")})
    return found.select(
        tx.sanitise_username(F.col("username")).alias("username"), "direction", "page_no",
        F.posexplode("usernames").alias("pos", "other")).withColumn("other", tx.strip(F.col("other")))
