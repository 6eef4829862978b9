"""The written table, the run over feeds, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from chirpline import schema
from chirpline.functions.scoring import make_scorer, score_posts
from chirpline.operators import health, keyed
from chirpline.plans import collect
from chirpline.plans.scoring import live_signal, scoring_run
from chirpline.session import RECOMMENDED_CONF, run_dir, shared_dir
from chirpline.sources import warehouse
from chirpline.sources.store import PostTable
from chirpline.streaming import streams
from tests.conftest import at, naive, post

DAY = 24 * 60


@pytest.fixture
def table(spark):
    return PostTable(spark, run_dir(spark, "table"))


def content(table):
    return {r["tweet_id"]: r["content"] for r in table.read().collect()}


def days(spark, table):
    return sorted(str(r[0]) for r in table._days().select("post_date").distinct().collect())


def test_upsert_replaces_and_moves(spark, table, posts):
    assert table.upsert(posts()) == 0 and table.read().count() == 0
    assert table.upsert(posts(post(1, "a"), post(2, "b"), post(3, "c", when=at(DAY)), post(9, ""))) == 3
    assert content(table) == {"1": "a", "2": "b", "3": "c"}
    # 1 changes in place, 2 moves to the next day, 3 leaves its day empty
    assert table.upsert(posts(post(1, "a1"), post(1, "a2", scraped_at=at(1)), post(2, "b2", when=at(DAY)), post(3, "c2", when=at(2 * DAY)))) == 4
    assert content(table) == {"1": "a2", "2": "b2", "3": "c2"}
    table.upsert(posts(post(2, "b3", when=at(0))))
    assert content(table) == {"1": "a2", "2": "b3", "3": "c2"} and days(spark, table) == ["2025-05-29", "2025-05-31"]
    # the batch may come from the table itself
    table.upsert(table.read().withColumn("content", F.upper("content")))
    assert content(table) == {"1": "A2", "2": "B3", "3": "C2"}


def test_scores_and_reingest(spark, table, posts):
    table.upsert(posts(post(1, "good news"), post(2, "very bad", when=at(DAY))))
    table.apply_scores(spark.createDataFrame([("1", 0.8, "positive", 0.9), ("404", 0.1, "neutral", 0.1)], "tweet_id string, score double, label string, confidence double"))
    assert {r["tweet_id"]: r["sentiment_score"] for r in table.read().collect()} == {"1": 0.8, "2": None}
    scorer = make_scorer()
    score = lambda df: score_posts(df, scorer)
    assert table.rescore(score) == {"tweets_processed": 1, "tweets_updated": 1, "errors": 0, "success_rate": 1.0}
    rows = {r["tweet_id"]: r for r in table.read().collect()}
    assert rows["1"]["sentiment_score"] == 0.8 and rows["2"]["sentiment_label"] == "negative"
    assert table.rescore(score)["tweets_processed"] == 0
    assert table.rescore(score, only_missing=False)["tweets_updated"] == 2 and table.read().filter("tweet_id = '1'").first()["sentiment_score"] != 0.8
    table.upsert(posts(post(1, "good news")), mode="preserve_scores")
    assert table.read().filter("sentiment_score is null").count() == 0
    table.upsert(posts(post(1, "good news")))
    assert table.read().filter("sentiment_score is null").count() == 1


def test_retention(table, posts):
    table.upsert(posts(post("old", when=at(-10 * DAY)), post("edge", when=at(-5 * DAY)), post("just", when=at(-5 * DAY - 1)), post("new")))
    assert table.cleanup_old_data(5, at()) == 2 and sorted(content(table)) == ["edge", "new"]
    assert table.cleanup_old_data(5, at()) == 0
    assert table.cleanup_old_data(1) == 2 and content(table) == {}


def test_queries_prune_days(table, posts):
    table.upsert(posts(*[post(i, when=at(i * DAY)) for i in range(4)]))
    found = table.query(start_time=at(DAY), end_time=at(2 * DAY))
    assert sorted(r["tweet_id"] for r in found.collect()) == ["1", "2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(post_date" in plan
    assert table.query(username="nobody").count() == 0


def test_export_and_clear(spark, table, posts, tmp_path):
    table.upsert(posts(post(1, 'comma, "quote"'), post(2, "x", when=at(5), sentiment_score=0.5)))
    assert table.export_to_parquet(str(tmp_path / "p"))
    back = spark.read.schema(schema.POSTS).parquet(str(tmp_path / "p"))
    assert [r["tweet_id"] for r in back.collect()] == ["2", "1"]
    assert table.export("csv", str(tmp_path / "c")) == 2
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).filter("tweet_id = '1'").first()["content"] == 'comma, "quote"'
    assert table.export("json", str(tmp_path / "j"), with_sentiment=True) == 1
    line = next(p for p in (tmp_path / "j").glob("*.json") if p.stat().st_size).read_text().splitlines()[0]
    assert json.loads(line)["tweet_id"] == "2"
    ledger = {r["export_type"]: r for r in table.exports().collect()}
    assert {k: r["row_count"] for k, r in ledger.items()} == {"parquet": 2, "csv": 2, "json": 1}
    assert len({r["export_id"] for r in ledger.values()}) == 3 and ledger["csv"]["checksum"] is None
    with pytest.raises(ValueError):
        table.export("xml")
    assert table.stats().first()["total_tweets"] == 2 and table.size_mb().first()[0] > 0
    assert table.clear() == 2 and table.read().count() == 2
    assert table.clear(confirm=True) == 2 and table.read().count() == 0
    assert table.upsert(posts(post(5))) == 1


def test_collection_run(table, posts):
    out = collect.collect(table, [posts(post(1, "good news")), posts(post(2, "bad"), post(3, ""))])
    assert (out["tweets_scraped"], out["tweets_processed"], out["tweets_updated"]) == (2, 2, 2)
    assert table.read().filter("sentiment_score is not null").count() == 2
    assert collect.collect(table, [posts(post(4))], analyze=False) == {"tweets_scraped": 1}


def test_scoring_run_takes_the_newest(posts):
    df = posts(*[post(i, "good", when=at(i)) for i in range(5)], post(9, "good", when=at(60), sentiment_score=0.1))
    assert sorted(r["tweet_id"] for r in scoring_run(df, limit=2).collect()) == ["3", "4"]
    assert live_signal(df, at(60), hours=2).first()["signal"] == "BUY"


def test_shared_folder(spark):
    assert run_dir(spark, "x").startswith(shared_dir(spark)) and run_dir(spark, "x") != run_dir(spark, "x")
    assert "spark.sql.adaptive.enabled" in RECOMMENDED_CONF


def land(df, folder, part):
    df.write.mode("append").parquet(f"{folder}/part={part}")


@pytest.mark.parametrize(("rows", "in_order"), [(1_000_000, False), (1_000_000, True), (40, False), (40, True)])
def test_batches_of_events_do_not_grow_with_their_files(spark, tmp_path, monkeypatch, rows, in_order):
    """Events in many files land as three batches, in order of time where asked for."""
    monkeypatch.setattr(warehouse, "FILE_ROWS", rows)
    events = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    events.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = warehouse.event_stream(spark, str(tmp_path), in_order)
    start = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check"))
    streams.run_to_end(start.foreachBatch(lambda batch, _: seen.append([r[0] for r in batch.select("event_id").collect()])).start())
    assert len(seen) == 3 and sorted(x for own in seen for x in own) == list(range(600))
    if in_order:
        assert max(seen[0]) < min(seen[1]) and max(seen[1]) < min(seen[2])


def test_streams_in_several_batches(spark, table, posts, tmp_path):
    source = str(tmp_path / "in")
    waves = [posts(post(1, "good"), post(2, "bad")), posts(post(1, "good again", when=at(1)), post(3, ""), post(4, "good", when=at(7)))]
    cells = None
    for i, wave in enumerate(waves):
        land(wave, source, i)
        stream = lambda: streams.read_landed(spark, f"{source}/*", schema.POSTS)
        streams.run_to_end(streams.upsert_stream(stream(), table, str(tmp_path / "c1"), once=True))
        cells = streams.rolling_stream(streams.scored(stream()))
        streams.run_to_end(streams.write_cells(cells, str(tmp_path / "cells"), str(tmp_path / "c2"), once=True))
        streams.run_to_end(streams.to_table(streams.deduplicated(stream()), str(tmp_path / "dedup"), str(tmp_path / "c3"), once=True))
    assert content(table) == {"1": "good again", "2": "bad", "4": "good"}
    rows = {naive(r["window_start"]): r["total_tweets"] for r in streams.rolling_from_cells(spark, str(tmp_path / "cells"), cells.schema).collect()}
    assert rows == {naive(at(m)): n for m, n in ((-10, 3), (-5, 4), (0, 4), (5, 1))}
    assert sorted(r[0] for r in spark.read.schema(schema.POSTS).parquet(str(tmp_path / "dedup")).select("tweet_id").collect()) == ["1", "2", "3", "4"]


def test_health_folds_over_batches(spark, tmp_path):
    rows = [(f"f{i % 2}", "t", at(seconds=i), i % 3 == 0 and i < 14, 0.0 if i < 4 else float(i % 5), i) for i in range(40)]
    fields = "feed string, target string, ts timestamp, success boolean, response_time double, event_id long"
    whole = spark.createDataFrame(rows, fields)
    for n, (a, b) in enumerate(((0, 3), (3, 17), (17, 18), (18, 40))):
        land(spark.createDataFrame(rows[a:b], fields), str(tmp_path / "in"), n)
        log = streams.read_landed(spark, str(tmp_path / "in") + "/*", whole.schema)
        streams.run_to_end(streams.health_stream(log, str(tmp_path / "out"), str(tmp_path / "check"), ["ts", "event_id"], once=True))
    got = {r["feed"]: r for r in streams.latest_health(spark, str(tmp_path / "out")).collect()}
    want = health.feed_averages(whole, ["ts", "event_id"]).join(health.failure_streaks(whole), "feed").collect()
    for w in want:
        g = got[w["feed"]]
        assert g["n_attempts"] == 20 and g["consecutive_failures"] == w["consecutive_failures"]
        assert (g["last_success"], g["last_failure"]) == (w["last_success"], w["last_failure"])
        assert g["success_rate"] == pytest.approx(w["success_rate"]) and g["avg_response_time"] == pytest.approx(w["avg_response_time"])


def test_an_upsert_reads_the_buckets_and_days_of_its_ids(spark, posts):
    """Files read for one id do not grow with the table."""
    table, seen = PostTable(spark, run_dir(spark, "table"), buckets=16), []
    for wave in range(3):
        table.upsert(posts(*[post(f"{wave}-{i}", when=at(i % 64 * DAY)) for i in range(128)]))
        before = table.log.read()
        one = spark.createDataFrame([("0-5",)], "tweet_id string")
        touched = table._days_of(one, before)
        bucket = one.select(table._bucket(before.buckets)).first()[0]
        seen.append((len(touched), len(table._index(before, [bucket]).inputFiles()) - len(before.ids[bucket]), len(table._days(before, touched).inputFiles())))
        table.upsert(posts(post("0-5", f"wave {wave}", when=at(5 * DAY))))
        after = table.log.read()
        assert [d for d in after.days if after.days[d] != before.days[d]] == ["2025-06-03"]
        assert {b for b in after.ids if after.ids[b] != before.ids.get(b)} == {bucket}
        assert content(table)["0-5"] == f"wave {wave}" and table.read().count() == 128 * (wave + 1)
    assert seen == [(1, 0, 1)] * 3


def test_the_index_stays_small_and_right(spark, posts):
    table = PostTable(spark, run_dir(spark, "table"), buckets=2, bucket_entries=20)
    for wave in range(12):
        table.upsert(posts(*[post(i, f"{wave}", when=at((i + wave) % 3 * DAY)) for i in range(wave, wave + 10)]))
    snapshot = table.log.read()
    assert snapshot.buckets == 8 or snapshot.buckets == 4
    assert max(len(runs) for runs in snapshot.ids.values()) <= 9
    got = {r["tweet_id"]: (r["content"], r["timestamp"]) for r in table.read().collect()}
    assert len(got) == 21 and table.read().count() == 21
    for i in range(21):
        wave = min(i, 11)
        assert got[str(i)] == (str(wave), naive(at((i + wave) % 3 * DAY)))
    table.apply_scores(spark.createDataFrame([("3", 0.5, "positive", 0.9)], "tweet_id string, score double, label string, confidence double"))
    assert {r["tweet_id"] for r in table.read().filter("sentiment_score = 0.5").collect()} == {"3"}


class Stopped(Exception):
    pass


def by_id(df):
    return sorted(df.collect(), key=lambda r: r["tweet_id"])


@pytest.mark.parametrize("change", [
    lambda t, p: t.upsert(p(post(1, "new", when=at(DAY)), post(3, "new"))),
    lambda t, p: t.rescore(lambda df: score_posts(df, make_scorer())),
    lambda t, p: t.cleanup_old_data(1, at(DAY + 1)),
    lambda t, p: t.clear(confirm=True)])
def test_a_run_that_stops_before_it_publishes_changes_nothing(spark, table, posts, monkeypatch, change):
    table.upsert(posts(post(1, "old"), post(2, "old", when=at(DAY))))
    reader, old = table.read(), by_id(table.read())

    def stop(snapshot):
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(table.log, "publish", stop)
        with pytest.raises(Stopped):
            change(table, posts)
    again = PostTable(spark, table.path)
    assert by_id(again.read()) == old
    change(again, posts)
    assert by_id(reader) == old and by_id(again.read()) != old
    ids = [r[0] for r in again.read().select("tweet_id").collect()]
    assert len(ids) == len(set(ids))
    now = by_id(again.read())
    assert again.vacuum() > 0 and by_id(again.read()) == now and again.vacuum() == 0
    again.upsert(posts(post(1, "newest", when=at(2 * DAY))))
    assert content(again)["1"] == "newest"


def test_a_second_writer_is_refused(spark, table, posts):
    table.upsert(posts(post(1)))
    snapshot = table.log.read()
    with pytest.raises(RuntimeError, match="another writer"):
        table.log.publish(snapshot)
    assert table.log.read() == snapshot


def test_a_look_up_skips_most_of_a_day(spark, table):
    """The index leads to the day, and within it the order of ids lets the reader skip."""
    rows = spark.range(70_000).select(*[(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")) if f.name == "tweet_id" else F.lit("u") if f.name in ("user_id", "username")
                                         else F.lit("text") if f.name == "content" else F.lit(at()) if f.name in ("timestamp", "scraped_at") else F.lit(0) if f.name in ("likes", "retweets", "replies")
                                         else F.lit(False) if f.name in ("is_reply", "is_retweet") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.POSTS.fields])
    table.upsert(rows)
    table.upsert(rows.limit(1).withColumns({"tweet_id": F.lit("other"), "timestamp": F.lit(at(3 * DAY))}))
    found = table.query(tweet_id="n031234")
    assert [r["tweet_id"] for r in found.collect()] == ["n031234"] and "2025-06-01" not in str(found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert 0 < plan.metrics().apply("numOutputRows").value() <= 25_000
    assert table.query(tweet_id="nobody").collect() == [] and table.query(tweet_id="other").count() == 1


def test_a_batch_without_repeats_is_not_ranked(spark, posts):
    before, batch = posts(post(1), post(2)), posts(post(2, "new"), post(3))
    ranked, plain = (keyed.upsert(before, batch, ["scraped_at"], single=s) for s in (False, True))
    assert "Window" in ranked._jdf.queryExecution().toString() and "Window" not in plain._jdf.queryExecution().toString()
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("repeated", [False, True])
def test_only_a_batch_with_repeats_is_ranked_by_the_store(spark, posts, tmp_path, monkeypatch, repeated):
    said, upsert = [], keyed.upsert
    monkeypatch.setattr(keyed, "upsert", lambda *a: said.append(a[4]) or upsert(*a))
    table = PostTable(spark, str(tmp_path / "t"))
    rows = [post(1, "old"), post(2)] + [post(1, "late", scraped_at=at(5))] * repeated
    assert table.upsert(posts(*rows)) == len(rows) and said == [not repeated]
    assert {r.tweet_id: r.content for r in table.read().collect()} == {"1": "late" if repeated else "old", "2": "a post"}


def test_batch_of_the_ties_is_dealt_by_size(spark, tmp_path, monkeypatch):
    import datetime as dt

    from chirpline.plans import catalog

    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(n, f"text {n}", "en", "s") for n in range(9)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, day, n, "click", 5.0) for n in range(9)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    parts, upsert = [], PostTable.upsert
    monkeypatch.setattr(PostTable, "upsert", lambda self, batch: parts.append(batch.rdd.getNumPartitions()) or upsert(self, batch))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert {r.likes for r in catalog.store_upsert_ties(spark, str(tmp_path)).collect()} == {7}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts == [11]
