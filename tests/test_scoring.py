import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chirpline.functions import scoring
from chirpline.functions.scoring import (
    EnsembleScorer, KeywordScorer, LexiconRules, LexiconScorer, ScoreConfig, make_scorer, rate_texts, rate_words, score_posts)
from tests.conftest import post

# words, positive, negative, score, confidence, label
KNOWN = {
    "This is good news!": (4, 2, 1, 0.5, 0.85, "positive"),
    "Bitcoin is going to the moon! 🚀 Bullish AF!": (9, 3, 1, 0.444444, 0.544444, "positive"),
    "Market crash incoming. Sell everything. Bearish signals.": (7, 1, 3, -0.571429, 0.671429, "negative"),
    "The Federal Reserve will meet next week to discuss rates.": (10, 0, 0, 0.0, 0.0, "neutral"),
    "The weather is okay today. Nothing special happening.": (8, 1, 1, 0.0, 0.35, "neutral"),
    "Check https://example.com/a?b=1 AWESOME": (2, 1, 0, 1.0, 0.6, "positive"),
    "https://example.com/x": (0, 0, 0, 0.0, 0.0, "neutral"),
}


def frame(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "tweet_id string, content string")


def brute(text, cfg=ScoreConfig()):
    """Hits of cleaned words, tried keyword by keyword."""
    found, p, n = [], 0, 0
    words = text.lower().split()
    for w in words:
        for sign, listed in (("+", cfg.positive), ("-", cfg.negative)):
            k = next((k for k in listed if k in w or w in k), None)
            if k:
                found.append(sign + k)
                p, n = (p + 1, n) if sign == "+" else (p, n + 1)
    return p, n, found, len(words)


def test_known_texts(spark):
    rows = KeywordScorer().score(frame(spark, KNOWN), "content", "s").select("content", "s.*").collect()
    for r in rows:
        d = r["details"]
        assert (d["words"], d["positive"], d["negative"], round(r["score"], 6), round(r["confidence"], 6), r["label"]) == KNOWN[r["content"]]
    ensemble = make_scorer().score(frame(spark, KNOWN), "content", "s").select("content", "s.label").collect()
    assert all(r["label"] == KNOWN[r["content"]][5] for r in ensemble)


def test_counts_and_matches_agree_with_brute_force(spark):
    # every part and every compound of keywords, in one text and alone
    cfg = ScoreConfig()
    words = sorted({k[i:j] for k in cfg.positive + cfg.negative for i in range(len(k)) for j in range(i + 1, len(k) + 1)})
    words += [a + b for a in cfg.positive[::3] for b in cfg.negative[::3]] + [b + "x" + a for a in cfg.positive[::4] for b in cfg.negative[::2]]
    words += ["unlikely", "likely", "winning", "unwinding", "xyz", "", "é"]
    texts = words + [" ".join(words)]
    got = KeywordScorer(cfg, with_matches=True).score(frame(spark, texts), "content", "s").select("content", "s.details").collect()
    for r in got:
        d = r["details"]
        assert (d["positive"], d["negative"], d["matched"], d["words"]) == brute(r["content"]), r["content"]


def test_special_characters_and_multi_word_keywords(spark):
    cfg = ScoreConfig(positive_keywords=["c++", "a.b"], market_positive=["very good"], negative_keywords=[], market_negative=["really bad"])
    got = KeywordScorer(cfg).score(frame(spark, ["xc++y axb good really q"]), "content", "s").select("s.details").first()[0]
    assert (got["positive"], got["negative"]) == (2, 1)


def test_options():
    assert ScoreConfig.from_dict({"keyword_weight": 1.0}).keyword_weight == 1.0
    with pytest.raises(ValueError):
        ScoreConfig.from_dict({"nope": 1})
    with pytest.raises(ValueError):
        make_scorer({"keyword_weight": 0.0})


class Fixed:
    def __init__(self, name, score, confidence=0.8, fail=False):
        self.name, self.value, self.confidence, self.fail = name, score, confidence, fail

    def score(self, df, text, out):
        s = F.struct(F.lit(self.value).alias("score"), F.lit("x").alias("label"), F.lit(self.confidence).alias("confidence"), F.lit(1).alias("details"))
        return df.withColumn(out, F.when(F.lit(not self.fail), s))


def ensemble(spark, members, text="some text"):
    return EnsembleScorer(members).score(frame(spark, [text]), "content", "s").select("s.*").first()


def test_ensemble_weights(spark):
    r = ensemble(spark, [(Fixed("a", 0.8), 0.6), (Fixed("b", 0.2), 0.4)])
    assert r["score"] == pytest.approx(0.56) and r["label"] == "positive"
    r = ensemble(spark, [(Fixed("a", 0.9, fail=True), 0.6), (Fixed("b", 0.5), 0.4)])
    assert r["score"] == pytest.approx(0.5)
    r = ensemble(spark, [(Fixed("a", 0.9, fail=True), 1.0)])
    assert (r["score"], r["label"], r["confidence"], r["error"]) == (0.0, "neutral", 0.0, "All analyzers failed")
    for blank in ("", "   "):
        r = ensemble(spark, [(Fixed("a", 0.9), 1.0)], blank)
        assert (r["score"], r["label"], r["confidence"], r["error"]) == (0.0, "neutral", 0.0, "Empty text")
    # low confidence is neutral whatever the score; exactly at the threshold it is not
    assert ensemble(spark, [(Fixed("a", 0.9, 0.29), 1.0)])["label"] == "neutral"
    assert ensemble(spark, [(Fixed("a", 0.1, 0.3), 1.0)])["label"] == "positive"
    assert ensemble(spark, [(Fixed("a", -0.5), 1.0)])["label"] == "negative"


def test_scoring_posts_isolates_bad_rows(spark, posts):
    df = posts(post(1, "good news"), post(2, ""), post(3, None))
    rows = {r["tweet_id"]: r for r in score_posts(df, make_scorer()).collect()}
    assert rows["1"]["sentiment_label"] == "positive" and rows["1"]["scoring_error"] is None
    assert rows["2"]["sentiment_score"] is None and rows["2"]["scoring_error"] == "Empty content"
    assert rows["3"]["scoring_error"] == "Empty content"
    odd = score_posts(posts(post(1)), Fixed("odd", 2.0)).first()
    assert odd["sentiment_score"] is None and odd["scoring_error"] == "Score out of range"
    with pytest.raises(Exception, match="out of range"):
        score_posts(posts(post(1)), Fixed("odd", 2.0), strict=True).collect()


LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("horrible", -2.5), ("love", 3.2)]


def rate(spark, texts, **options):
    lex = spark.createDataFrame(LEXICON, "token string, valence double")
    rows = LexiconScorer(lex, **options).score(frame(spark, texts), "content", "s").select("tweet_id", "s.*").collect()
    return [r for r in sorted(rows, key=lambda r: int(r["tweet_id"]))]


def test_lexicon_rules(spark):
    texts = ["good", "very good", "not good", "GOOD day", "good!!!", "good but bad", "barely good", "nothing here", "isn't good", "good??", "bad"]
    v = [r["score"] for r in rate(spark, texts)]
    good, very, negated, caps, loud, turned, barely, none, isnt, asked, bad = v
    assert good == pytest.approx(1.9 / (1.9 ** 2 + 15) ** 0.5)
    assert very > good > barely > 0 and negated < 0 and isnt == negated
    assert caps > good and loud > good and asked > good
    assert turned < 0 and none == 0 and bad < -0.05
    r = rate(spark, ["good"])[0]
    assert r["label"] == "positive" and r["confidence"] == pytest.approx(good + 0.1) and r["details"]["neu"] == 0
    assert rate(spark, ["good morning to you"])[0]["details"]["neu"] > 0.5


@pytest.mark.parametrize("rules", [LexiconRules(), LexiconRules.plain()])
def test_texts_are_rated_like_one_word_after_the_other(rules):
    rng = random.Random(3)
    words = ["good", "GOOD", "Great!", "bad", "(love)", "very", "VERY", "barely", "so", "not", "isn't", "ISN’T", "n't", "but", "BUT", "it", "a", "A",
             "É", "İ", "Über", "ß", "!!!", "?", "'", "x?"]
    gaps = [" ", " ", "  ", "\n", "\x1c", "　", "\x85"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", " ", "but"]
    lex = dict(LEXICON) | {"very": 1.0, "über": 2.0, "a": 0.5, "?": -1.0, "i̇": 1.5, "zero": 0.0}
    got = rate_texts(pa.array([*texts, None]), pa.array(list(lex)), np.array(list(lex.values())), rules)
    for text, row in zip([*texts, ""], got):
        assert row == pytest.approx(rate_words(text, lex, rules), abs=1e-12), text
    assert rate_texts(pa.array(["good"]), pa.array([], pa.string()), np.zeros(0), rules).tolist() == [[0, 0, 0, 1]]


def test_a_large_lexicon_is_joined_with_the_same_result(spark):
    texts = ["very good, (great) things!", "I LOVE it but it was horrible", "", "no 'good' at all, no GREAT", "plain"]
    joined = rate(spark, texts, max_broadcast=2)
    assert [r["score"] for r in joined] == [r["score"] for r in rate(spark, texts)]


def test_lexicon_and_keywords_together(spark):
    lex = spark.createDataFrame(LEXICON, "token string, valence double")
    out = make_scorer(lexicon=lex).score(frame(spark, ["good news"]), "content", "s").select("s.score", "s.details").first()
    lexical, keyword = out["details"]["lexicon"]["score"], out["details"]["keyword"]["score"]
    assert out["score"] == pytest.approx(0.6 * lexical + 0.4 * keyword)


def test_large_keyword_lists(spark):
    """50,000 keywords in an index, and short lists in either form, count like a loop over all of them."""
    rng = random.Random(4)
    words = lambda n, k: ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, k))) for _ in range(n)]
    for size, longest in ((25_000, 12), (15, 5)):
        lists = {"positive_keywords": words(size, longest) + ["two words", "dup", "dup"], "negative_keywords": words(size, longest), "market_positive": (), "market_negative": ()}
        texts = [" ".join(words(rng.randrange(5), 9) + rng.choice([[], ["two"], ["xyz"]])) for _ in range(30)] + ["", None]
        config = ScoreConfig(**lists)
        out = KeywordScorer(config, with_matches=True, large=0).score(frame(spark, texts), "content", "s").select("content", "s.*").collect()
        plain = KeywordScorer(config, large=0).score(frame(spark, texts), "content", "s").select("content", "s.*").collect()
        short = KeywordScorer(config, with_matches=True, large=1 << 30).score(frame(spark, texts), "content", "s").select("content", "s.*").collect() if size < 100 else out
        first = lambda keys, w: next((k for k in keys if k in w or w in k), None)
        for r, bare, other in zip(out, plain, short):
            if r["content"] is None:
                assert r["score"] is None and r["details"] is None
                continue
            found = [(first(config.positive, w), first(config.negative, w)) for w in r["content"].split()]
            assert r["details"]["positive"] == sum(p is not None for p, _ in found) and r["details"]["negative"] == sum(n is not None for _, n in found)
            assert r["details"]["matched"] == [s + k for p, n in found for s, k in (("+", p), ("-", n)) if k is not None]
            assert r["details"]["words"] == len(found) and (r["score"], r["confidence"]) == (bare["score"], bare["confidence"])
            assert (r["score"], r["details"]["matched"]) == (other["score"], other["details"]["matched"])


ODD_TEXTS = ["", None, "  ", "Good GOOD good!! but n't bad", "İstanbul É É 'moon' don’t", "a b ((gain)) ?? x", "loss " * 50, "!", None, "buy-sell buy"]


def test_texts_are_taken_apart_in_slices(monkeypatch):
    column = pa.array(ODD_TEXTS, pa.string())
    for most in (1, 30, 10_000):
        parts = list(scoring._slices(column, most))
        assert pa.concat_arrays(parts) == column
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= most for p in parts)
    assert [len(p) for p in scoring._slices(column.slice(3, 0), 5)] == [0]
    assert [p.to_pylist() for p in scoring._slices(column.slice(3, 2), 1)] == [[ODD_TEXTS[3]], [ODD_TEXTS[4]]]


@pytest.mark.parametrize("most", [1, 40])
def test_scores_do_not_depend_on_slices(spark, monkeypatch, most):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.5), ("gain", 1.0), ("é", 3.0), ("i̇stanbul", 1.5)], "token string, valence double")
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "n int, content string").coalesce(1)
    scorers = [scoring.KeywordScorer(), scoring.KeywordScorer(large=0, with_matches=True), scoring.LexiconScorer(lexicon), scoring.LexiconScorer(lexicon, max_broadcast=0)]

    def all_scores():
        return [sorted(map(str, s.score(posts, "content", "s").collect())) for s in scorers]

    whole = all_scores()
    slices, parts = scoring._slices, spark.sparkContext.accumulator(0)

    def small(texts, ignored=None):
        for part in slices(texts, most):
            parts.add(1)
            yield part

    monkeypatch.setattr(scoring, "_slices", small)
    assert all_scores() == whole and whole[2] == whole[3]
    assert parts.value > len(scorers)
