"""Every registered query against its SQL."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from chirpline.plans import catalog
from tools.compare import compare, database

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


# Without SQL, and what holds them instead.
ELSEWHERE = {
    "trading_signal_reasons": "test_reasons",
    "file_sizes": "test_file_sizes",
}
OWN = [n for n in entry.queries() if n in catalog.QUERIES]


@pytest.mark.parametrize("name", sorted(set(OWN) & set(entry.oracle_sql())))
def test_query(spark, con, name):
    n, problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert problem is None and n > 0


def test_every_query_is_checked():
    assert set(OWN) - set(entry.oracle_sql()) == set(ELSEWHERE)


def test_file_sizes(spark):
    got = {r["table"]: r["size_mb"] for r in entry.queries()["file_sizes"](spark, SMALL).collect()}
    assert got == {n: (Path(SMALL) / f"{n}.parquet").stat().st_size / 2 ** 20 for n in ("documents", "events", "pages")}


def test_reasons(spark):
    rows = entry.queries()["trading_signal_reasons"](spark, SMALL).collect()
    numbers = {r["username"]: r for r in entry.queries()["trading_signal_by_user"](spark, SMALL).collect()}
    assert rows
    for r in rows:
        shown = re.search(r"\((-?[0-9.]+)\)", r["reasoning"])
        if r["tweet_count"]:
            assert abs(float(shown[1]) - r["sentiment_score"]) <= 0.005 + 1e-9
            assert r["reasoning"].startswith({"BUY": "Strong positive", "SELL": "Strong negative", "HOLD": "Mixed"}[r["signal"]])
        else:
            assert r["reasoning"].startswith("Insufficient data")
    assert numbers


def test_exports_hold_texts_with_line_breaks(spark, tmp_path):
    texts = ["one line", "two\nlines", 'a "quoted"\n\nline, and more', "carriage\r\nreturn", "back\\\n\\slash\\", "x\ry"]
    n = len(texts)
    spark.range(n).selectExpr("id AS doc_id", f"element_at(array({', '.join(map(repr, texts))}), int(id) + 1) AS text", "'en' AS lang", "'web' AS source",
                              ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(n).selectExpr("id AS event_id", "id AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "20D AS value",
                              "if(id < 2, 'view', 'click') AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    found = entry.queries()["export_content"](spark, str(tmp_path)).collect()
    got = {kind: sorted(r["content"] for r in found if r["kind"] == kind) for kind in ("parquet", "csv", "json")}
    assert got == {"parquet": sorted(texts), "csv": sorted(texts), "json": sorted(texts[2:])}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
