"""Extraction from saved pages, and conversion of both feeds."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from chirpline.functions import text as tx
from chirpline.operators import keyed, threads, validate
from chirpline.operators.skew import totals_before
from chirpline.plans import collect
from chirpline.sources import feeds, markup, pages
from tests.conftest import at, naive


def b64(text):
    return base64.b64encode(text.encode()).decode()


def item(n, classes="timeline-item", text="hello", user="al", extra="", body_extra="", stats=("1", "2,000", "", "4"), avatar="/pic/profile_images%2F77%2Fa.jpg"):
    spans = "".join(f'<span class="tweet-stat"><div class="icon-container"> {s} </div></span>' for s in stats)
    return (f'<div class="{classes}">{extra}<div class="tweet-body"><a class="fullname" href="/{user}"> Al </a><a class="username" href="/{user}">@{user}</a>'
            f'<img class="avatar round" src="{avatar}"><span class="tweet-date"><a href="/{user}/status/{n}#m" title="Aug 16, 2024 · 6:03 PM UTC">16 Aug</a></span>'
            f'<div class="tweet-content media-body">{text}</div>{body_extra}{spans}</div></div>')


def frame(spark, *bodies, url="https://m.example/al"):
    return spark.createDataFrame([(str(i), url, f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id string, url string, html string")


def items(spark, *bodies):
    return pages.timeline_items(pages.parse_pages(frame(spark, *bodies))).orderBy("page_id", "pos").collect()


def test_one_post(spark):
    media = ('<div class="attachments"><img src="/pic/media%2Fx.jpg%3Fname%3Dsmall"><video data-url="/video/1/https%3A%2F%2Fv.example%2Fa.m3u8"></video>'
             '<video><source src="/v/plain.mp4"></video><video class="gif"><source src="/pic/video.example%2Fg.mp4"></video></div>')
    quote = ('<div class="quote"><a class="fullname" href="/q">Q</a><a class="username" href="/q">@q</a><span class="tweet-date"><a href="/q/status/5#m" title="Aug 1, 2024 · 1:00 AM UTC">x</a></span>'
             '<div class="quote-text">quoted<br>text</div><div class="attachments"><img src="/pic/media%2Fq.jpg"></div></div>')
    r = items(spark, item(123, text=' say\n&lt;b&gt; <a href="https://x.example/a?b=1">x.example/a…</a> <a href="/al">@al</a> ', body_extra=media + quote,
                          extra='<div class="retweet-header">r</div><div class="pinned">p</div><div class="replying-to">to <a href="/bo">@bo</a> <a href="/cy"> @cy </a></div><a class="card-container" href="http://card.example">c</a>'))[0]
    assert (r["id"], r["link"], r["kind"], r["is_thread_end"]) == ("123", "https://twitter.com/al/status/123#m", "post", False)
    assert r["text"] == "say <b> https://x.example/a?b=1 @al"
    assert r["user"].asDict() == {"name": "Al", "username": "@al", "profile_id": "77", "avatar": "/pic/profile_images/77/a.jpg"}
    assert r["date"] == "Aug 16, 2024 · 6:03 PM UTC" and r["is_retweet"] and r["is_pinned"] and r["replying_to"] == ["@bo", "@cy"]
    assert r["stats"].asDict() == {"comments": 1, "retweets": 2000, "quotes": 0, "likes": 4}
    assert r["pictures"] == ["https://pbs.twimg.com/media/x.jpg"] and r["gifs"] == ["https://video.example/g.mp4"]
    assert r["videos"] == ["https://v.example/a.m3u8", "/v/plain.mp4"] and r["external_link"] == "http://card.example"
    q = r["quoted_post"]
    assert (q["link"], q["text"], q["user"]["username"], q["pictures"]) == ("https://twitter.com/q/status/5#m", "quotedtext", "@q", ["https://pbs.twimg.com/media/q.jpg"])


def test_missing_parts(spark):
    bare, gone = items(spark, '<div class="timeline-item">x</div>' + item(2, body_extra='<div class="quote unavailable"><div class="quote-text">deleted</div></div>', stats=()))
    assert (bare["id"], bare["link"], bare["text"], bare["quoted_post"], bare["pictures"], bare["stats"]["likes"]) == ("", "", "", None, [], 0)
    assert bare["user"]["profile_id"] == "unknown" and bare["user"]["avatar"].endswith("default_profile_normal.png")
    assert (gone["quoted_post"]["text"], gone["quoted_post"]["user"], gone["quoted_post"]["link"]) == ("", None, "")


def test_encoded_media(spark):
    pic = f'<div class="attachments"><img src="/pic/enc/{b64("media/xy.jpg?n=1")}"><video data-url="/video/enc/{b64("https://v.example")}"></video></div>'
    r = items(spark, item(1, body_extra=pic, avatar="/pic/enc/" + b64("profile_images/88/a.jpg")))[0]
    assert r["pictures"] == ["https://pbs.twimg.com/media/xy.jpg"] and r["videos"] == ["https://v.example"]
    assert r["user"]["avatar"] == "https://pbs.twimg.com/profile_images/88/a.jpg" and r["user"]["profile_id"] == "88"


PAD = "<!--" + "x" * 2000 + "-->"


@pytest.mark.parametrize("body, url, valid, reason, content", [
    (item(1), "https://m/al", True, None, None),
    ('<div class="error-panel"><span> User not found </span></div>', "https://m/al", False, "Error: User not found", "Fetching error: User not found"),
    ('<div class="timeline-header timeline-protected">x</div>', "https://m/al", False, "Protected account", "Account is protected"),
    ("<p>none</p>", "https://m/al", False, "No timeline content", "Empty page"),
    ("<p>none</p>", "https://m/search?q=a", True, None, "Empty page"),
    (item(1, "timeline-item thread"), "https://m/al", True, None, None),
    (item(1, "timeline-item thread thread-last"), "https://m/al", True, None, "Empty page")])
def test_page_status(spark, body, url, valid, reason, content):
    r = pages.page_status(frame(spark, body + PAD, url=url)).first()
    assert (r["valid"], r["reason"], r["content_reason"], r["has_content"]) == (valid, reason, content, content is None)


def test_small_and_failed_pages(spark):
    assert pages.page_status(frame(spark, item(1, stats=()))).first()["reason"] == "Response too small"
    assert pages.page_status(frame(spark, item(1) + PAD).withColumn("http_ok", F.lit(False))).first()["reason"] == "HTTP error"


def test_next_page(spark):
    body = '<div class="show-more"><a href="/old">Newest</a></div>' + item(1) + '<div class="show-more"><a href="?f=tweets&cursor=AB">More</a></div>'
    parsed = pages.parse_pages(frame(spark, body, item(1)))
    for mode, dated, want in (("term", False, "/search?f=tweets&cursor=AB"), ("user", False, "/al?f=tweets&cursor=AB"), ("user", True, "/al/search?f=tweets&cursor=AB")):
        got = pages.next_url(parsed, F.lit(mode), F.lit("al"), F.lit(dated)).orderBy("page_id").collect()
        assert [r["next_url"] for r in got] == [want, None]


def test_threads_and_first_seen(spark):
    t, end = "timeline-item thread", "timeline-item thread thread-last"
    parsed = pages.timeline_items(pages.parse_pages(frame(
        spark, item(1, t) + item(2) + item(3, end) + item(4, end) + item(5, t), item(3, t) + item(6, end) + item(2) + item(7, "timeline-item other"))))
    ids = lambda df: [(r["page_id"], [p["id"] for p in r["posts"]]) for r in df.orderBy("page_id", "thread_no").collect()]
    assert ids(threads.assemble_threads(parsed)) == [("0", ["1", "3"]), ("0", ["4"]), ("1", ["3", "6"])]
    fresh = keyed.first_by_key(parsed, ["link"], ["page_id", "pos"])
    assert ids(threads.assemble_threads(parsed, fresh)) == [("0", ["1", "3"]), ("0", ["4"]), ("1", ["6"])]
    posts = collect.html_posts(frame(spark, item(1) + item(2), item(2, text="again") + item(3)), F.lit("m"))
    assert {r["tweet_id"]: r["content"] for r in posts.collect()} == {"1": "hello", "2": "hello", "3": "hello"}
    assert [r["id"] for r in pages.post_by_id(parsed, "1").collect()] == ["1"] and pages.post_by_id(parsed, "2").count() == 0


def test_html_feed(spark):
    body = item(1) + item(2, text="  ") + item(3, user="").replace("Aug 16, 2024 · 6:03 PM UTC", "yesterday")
    found = feeds.posts_from_html(pages.timeline_items(pages.parse_pages(frame(spark, body))), F.lit("http://test.com"), F.lit("fallback"), F.lit(at()).cast("timestamp"))
    rows = {r["tweet_id"]: r for r in validate.valid_posts(found).collect()}
    assert sorted(rows) == ["1", "3"]
    assert rows["1"]["source_instance"].endswith(":http://test.com") and (rows["1"]["likes"], rows["1"]["retweets"], rows["1"]["replies"]) == (4, 2000, 1)
    assert str(rows["1"]["timestamp"]) == "2024-08-16 18:03:00" and not rows["1"]["timestamp_imputed"]
    assert rows["3"]["timestamp_imputed"] and naive(rows["3"]["timestamp"]) == naive(at())


def test_record_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id": 1, "user": {"id": 7, "username": "al"}, "date": "2025-05-29T12:00:00Z", "likeCount": 3, "rawContent": "raw", "content": "c", "target": "al", "feed_pos": 0}\n'
        '{"id": 2, "content": "only content", "target": "al", "feed_pos": 1}\n{"target": "al", "feed_pos": 2}\n')
    records = feeds.read_records(spark, str(tmp_path))
    rows = {r["tweet_id"]: r for r in feeds.posts_from_records(records, F.lit("dflt"), F.lit(at()).cast("timestamp")).collect()}
    assert (rows["1"]["user_id"], rows["1"]["username"], rows["1"]["content"], rows["1"]["likes"], rows["1"]["retweets"]) == ("7", "al", "raw", 3, 0)
    assert (rows["2"]["user_id"], rows["2"]["username"], rows["2"]["content"], rows["2"]["timestamp_imputed"]) == ("dflt", "dflt", "only content", True)
    assert rows["unknown"]["content"] == "" and validate.valid_posts(feeds.posts_from_records(records)).count() == 2
    assert feeds.posts_from_records(records).filter("tweet_id = '2'").first()["username"] == "unknown"
    assert feeds.first_records(records, 1).count() == 1


def test_saved_files(spark, tmp_path):
    (tmp_path / "p.html").write_text(item(9))
    assert pages.timeline_items(pages.parse_pages(feeds.read_pages(spark, str(tmp_path)))).first()["id"] == "9"


PROFILE = ('<div class="profile-banner"><img src="{banner}"></div><a class="profile-card-avatar" href="/x"><img src="{avatar}"></a><a class="profile-card-fullname" href="/x"> Al </a>'
           '<a class="profile-card-username" href="/x">@al</a><div class="profile-bio"><p>bio &amp; more</p></div><div class="profile-location"><span>i</span><span> Rome </span></div>'
           '<div class="profile-website"><span><a href="https://al.example">al</a></span></div><div class="profile-joindate"><span title="1 May 2020">J</span></div><ul class="profile-statlist">'
           '<li class="posts"><span>Posts</span><span>1,024</span></li><li class="following"><span>F</span><span>5</span></li><li class="followers"><span>F</span><span>6</span></li><li class="likes"><span>L</span><span>7</span></li></ul>'
           '<div class="photo-rail-header"><div class="icon-container"> 1,200 Photos and videos</div></div>')


def test_profiles(spark):
    plain = PROFILE.format(banner="/pic/https%3A%2F%2Fpbs.twimg.com%2Fprofile_banners%2F42%2F1500", avatar="/pic/pbs.twimg.com%2Fprofile_images%2F42%2Fa.jpg")
    enc = PROFILE.format(banner="/pic/enc/" + b64("https://pbs.twimg.com/profile_banners/42/15"), avatar="/pic/enc/" + b64("pbs.twimg.com/profile_images/42/a.jpg"))
    rows = pages.profiles(frame(spark, plain, enc, item(1))).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r["image"], r["id"], r["name"], r["username"]) == ("https://pbs.twimg.com/profile_images/42/a.jpg", "42", "Al", "@al")
        assert (r["bio"], r["location"], r["website"], r["joined"]) == ("bio & more", "Rome", "https://al.example", "1 May 2020")
        assert r["stats"].asDict() == {"tweets": 1024, "following": 5, "followers": 6, "likes": 7, "media": 1200}


def test_targets_file(spark, tmp_path):
    path = tmp_path / "a.yml"
    path.write_text("users:\n  - name: u1\n    weight: 1.0\n  - name: u2\n    weight: 0.8\n    description: d\nterms:\n  - query: a b\n    weight: 1.2\n")
    rows = [tuple(r) for r in feeds.load_targets(spark, str(path)).collect()]
    assert sorted(rows) == [("search", "a b", 1.2, ""), ("user", "u1", 1.0, ""), ("user", "u2", 0.8, "d")]
    assert feeds.load_targets(spark, str(tmp_path / "none.yml")).count() == 0


def read_until(crawl, n, since):
    """What a crawl keeps, one item after the other; ``crawl`` is a list of pages of (kind, closes, link)."""
    kept, seen, had = [], set(), 0
    for p, page in enumerate(crawl):
        for pos, (kind, closes, link) in enumerate(page):
            if kind == "post":
                if had >= n:
                    return kept
                had += link not in seen
            if kind != "other":
                seen.add(link)
            had += closes
            kept.append((p, pos))
        if not since and had >= n:
            return kept
    return kept


@pytest.mark.parametrize("n", [1, 3, 7, -1])
def test_a_crawl_ends_at_its_number_of_posts_and_threads(spark, n):
    rng = random.Random(n)
    kinds = [("post", False), ("post", False), ("thread", False), ("thread", True), ("other", False)]
    crawls = {c: [[(*rng.choice(kinds), f"l{rng.randrange(12)}") for _ in range(rng.randrange(6))] for _ in range(rng.randrange(1, 9))] for c in range(40)}
    crawls[40] = [[("thread", False, "a")], [("post", False, f"p{i}") for i in range(n - 1)] + [("thread", False, "t"), ("thread", True, "u")],
                  [("thread", False, "v"), ("thread", True, "w"), ("post", False, "x"), ("thread", True, "y")]]
    rows = [(c, c % 2 == 0, p, pos, *item) for c, own in crawls.items() for p, page in enumerate(own) for pos, item in enumerate(page)]
    df = spark.createDataFrame(rows, "crawl int, dated boolean, page_id int, pos int, kind string, is_thread_end boolean, link string").repartition(5)
    got = {}
    for since in (None, F.col("dated")):
        found = feeds.first_items(df.drop("dated") if since is None else df, n, ["crawl", "dated"] if since is not None else ["crawl"], since=since)
        for r in found.collect():
            got.setdefault((since is not None, r["crawl"]), []).append((r["page_id"], r["pos"]))
    for with_dates in (False, True):
        for c, own in crawls.items():
            want = read_until(own, n if n > 0 else 10 ** 9, with_dates and c % 2 == 0)
            assert sorted(got.get((with_dates, c), [])) == want, (with_dates, c)


def test_totals_before_of_a_large_key(spark):
    rows = [("hot", i, i % 3) for i in range(2000)] + [("small", 5, 7), ("small", 2, 1), (None, 1, 4), (None, 2, 4)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(7)
    got = {(r["k"], r["at"]): r["b"] for r in totals_before(df, ["k"], ["at"], "v", "b").collect()}
    assert got == {(k, i): sum(x[2] for x in rows if x[0] == k and x[1] < i) for k, i, _ in rows}


def test_pages_without_marks_are_settled_like_others(spark):
    bodies = ["", "plain text", '<div class="error-panel"><span> gone </span></div>', '<div class="timeline&#45;item">x</div>', "<div class='a &amp; b timeline-item'>y</div>",
              '<div class="timeline-header timeline-protected"></div>', '<a class="profile-card-avatar"><img src="/pic/enc/x"></a>', '<img class="avatar" src="/pic/&#101;nc/x">',
              '<div class="show-more"><a href="?cursor=1">more</a></div>', '<div class="show&#x2d;more"><a href="?c">more</a></div>', "talk of timelines & more"]
    df = frame(spark, *bodies).unionByName(spark.createDataFrame([("none", "u", None)], "page_id string, url string, html string"))
    columns = ["page_id", "error_text", "has_error_panel", "is_protected", "n_items", "n_plain_items", "is_encoded", "next_href"]
    whole = {r["page_id"]: tuple(r) for r in pages.parse_pages(df).select(*columns).collect()}
    assert {r["page_id"]: tuple(r) for r in pages.page_signs(df).select(*columns).collect()} == whole


def test_counts_beyond_integers(spark):
    rows = [("1,234", 1234), ("9,876,543,210", 2 ** 31 - 1), ("-9876543210", -2 ** 31), ("", 0), ("x", 0), (None, 0)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert all(r["n"] == r["want"] for r in df.select("want", tx.count_from_text(F.col("t")).alias("n")).collect())


def test_targets_of_a_json_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"users": [{"name": "al", "weight": 2}, {"weight": 3}],\n "terms": [{"query": "q", "description": "d"}]}')
    assert [tuple(r) for r in feeds.read_targets(spark, str(tmp_path / "a.json")).collect()] == [("user", "al", 2.0, ""), ("search", "q", 1.0, "d")]


def test_pages_of_one_file_are_read_by_many_tasks(spark):
    one = frame(spark, *[item(n) for n in range(12)]).coalesce(1)
    for read in (pages.parse_pages(one), pages.page_signs(one), pages.profiles(one)):
        assert read.rdd.getNumPartitions() >= 4
    assert sorted(r.id for r in pages.timeline_items(pages.parse_pages(one)).collect()) == sorted(str(n) for n in range(12))


def test_searches_below_an_element_share_one_walk(monkeypatch):
    walks, walk = [], markup.Node.walk
    monkeypatch.setattr(markup.Node, "walk", lambda self: walks.append(self) or walk(self))
    page = markup.parse('<div class="a"><a href="https://x.example">see <b>x</b></a><p>one <i>two</i></p></div>')
    box = page.first("div", "a")
    walks.clear()
    assert [box.first("a").attrs["href"], len(box.all("i")), box.first("video"), box.first("p").text()] == ["https://x.example", 1, None, "one two"]
    assert walks.count(box) == 1
    box.links_to_text(lambda href: "https" in href)
    assert box.first("a") is None and box.first("b") is None and box.text() == "https://x.exampleone two"


def test_a_crawl_with_a_limit_reads_its_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(link):
        seen.add(1)
        return link

    rows = [("c", p, k, "post", False, f"l{p}{k}") for p in range(3) for k in range(4)]
    made = spark.createDataFrame(rows, "crawl string, page_no int, pos int, kind string, is_thread_end boolean, link string")
    found = feeds.first_items(made.withColumn("link", read.asNondeterministic()("link")), 6, ["crawl"], "page_no").collect()
    assert sorted((r.page_no, r.pos) for r in found) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)] and seen.value == len(rows)
