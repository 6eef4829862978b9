"""Sentiment scorers.

A scorer adds one struct column ``<score, label, confidence, details>`` to a
frame. It works on frames rather than on single expressions so that the words
of a text are split once, in their own projection, and then shared by every
expression that needs them.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Protocol, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chirpline.functions import text as tx
from chirpline.functions.keywords import KeywordIndex

# Default keyword lists.
POSITIVE = (
    "bullish", "moon", "pump", "gain", "profit", "win", "success", "good",
    "great", "excellent", "amazing", "awesome", "love", "like", "buy",
    "long", "bull", "rocket", "surge", "boom", "rally", "breakthrough",
)
NEGATIVE = (
    "bearish", "dump", "crash", "loss", "fail", "bad", "terrible",
    "awful", "hate", "sell", "short", "bear", "collapse", "panic",
    "fear", "drop", "fall", "decline", "risk", "concern", "worry",
)
MARKET_POSITIVE = (
    "prediction market", "forecast", "odds improving", "likely", "probable",
    "confident", "accurate", "correct", "winning", "resolved",
)
MARKET_NEGATIVE = (
    "unlikely", "doubtful", "wrong", "incorrect", "losing", "risky bet",
    "manipulation", "insider", "scam", "fake",
)


@dataclass(frozen=True)
class ScoreConfig:
    """Weights, thresholds, keyword lists and cleaning switches."""

    lexicon_weight: float = 0.6
    keyword_weight: float = 0.4
    neutral_threshold: float = 0.1
    confidence_threshold: float = 0.3
    positive_keywords: Sequence[str] = POSITIVE
    negative_keywords: Sequence[str] = NEGATIVE
    market_positive: Sequence[str] = MARKET_POSITIVE
    market_negative: Sequence[str] = MARKET_NEGATIVE
    remove_urls: bool = True
    remove_mentions: bool = False
    remove_hashtags: bool = False
    lowercase: bool = True

    def __post_init__(self):
        if not all([*self.positive, *self.negative]):
            raise ValueError("a keyword must not be empty")

    @classmethod
    def from_dict(cls, options: dict | None) -> "ScoreConfig":
        unknown = set(options or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown scoring option: {', '.join(sorted(unknown))}")
        return cls(**(options or {}))

    @property
    def positive(self) -> list[str]:
        return list(dict.fromkeys([*self.positive_keywords, *self.market_positive]))

    @property
    def negative(self) -> list[str]:
        return list(dict.fromkeys([*self.negative_keywords, *self.market_negative]))

    @property
    def switches(self) -> dict:
        return {k: getattr(self, k) for k in ("remove_urls", "remove_mentions", "remove_hashtags", "lowercase")}


def label(score: Column, threshold: float) -> Column:
    """Neutral inside the threshold (exclusive), else the sign."""
    return (
        F.when(F.abs(score) < threshold, "neutral").when(score > 0, "positive").otherwise("negative")
    )


def _clipped(value: Column, low: float, high: float) -> Column:
    # least() and greatest() would turn a missing value into a bound
    return F.when(value < low, low).when(value > high, high).otherwise(value)


#: Bytes of text that a task takes apart at a time, whatever the rows of its Arrow batches.
TEXT_BYTES = 1 << 22


def _slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Runs of consecutive texts of at most so many bytes, or one longer text; together they are the column. None at all gives one empty run."""
    most = TEXT_BYTES if most is None else most
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    start = 0
    while True:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end
        if start >= len(texts):
            return


def _rows_of(columns: dict[str, np.ndarray], kinds: pa.StructType, missing: pa.Array | None = None) -> pa.Array:
    """A struct column of arrays; rows marked as missing hold nulls."""
    mask = None if missing is None else np.asarray(missing)
    return pa.StructArray.from_arrays([pa.array(columns[f.name], f.type, mask=mask if f.name in columns and isinstance(columns[f.name], np.ndarray) else None)
                                       for f in kinds], fields=list(kinds))


class Scorer(Protocol):
    """Anything that can score a text column."""

    name: str

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add the struct column ``out``; a null struct means this scorer failed on the row."""


def _parts(keywords: Sequence[str]) -> list[str]:
    """Every piece of a keyword that a single word could be equal to."""
    pieces = {k[i:j] for k in keywords for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
    return sorted(p for p in pieces if not any(c in tx.WHITESPACE_CHARS for c in p))


def _cores(keywords: Sequence[str]) -> list[str]:
    """Single-word keywords that hold no other keyword: any word holding one of the rest holds one of these."""
    single = [k for k in keywords if not any(c in tx.WHITESPACE_CHARS for c in k)]
    return [k for k in single if not any(o != k and o in k for o in single)]


def _any_of(words: Sequence[str]) -> str:
    """Regex for any of some words, grouped by first letter behind a test for one of these letters."""
    def literal(text):
        return "".join(c if c.isalnum() else "\\" + c for c in text)

    tails: dict = {}
    for w in words:
        tails.setdefault(w[0], []).append(literal(w[1:]))
    groups = "|".join(f"{literal(c)}(?:{'|'.join(t)})" for c, t in sorted(tails.items()))
    return f"(?=[{''.join(literal(c) for c in sorted(tails))}])(?:{groups})"


def hits(keywords: Sequence[str]):
    """Test of one word: it holds a keyword, or a keyword holds it (so ``a`` and ``is`` hit too)."""
    parts, cores = _parts(keywords), _cores(keywords)

    def test(word: Column) -> Column:
        found = word.isin(parts)
        return found | F.rlike(word, F.lit(_any_of(cores))) if cores else found

    return test


#: Letters of the keyword lists from which on they travel to the tasks as a broadcast instead of within the plan.
LARGE_LISTS = 20_000


@dataclass(frozen=True)
class KeywordScorer:
    """Share of words that hit a keyword. Short lists are part of the plan; of long ones each task builds an index from a broadcast."""

    config: ScoreConfig = ScoreConfig()
    with_matches: bool = False
    name: str = "keyword"
    large: int = LARGE_LISTS

    def _indexed(self, df: DataFrame, text: str) -> DataFrame:
        """``_counted`` for large lists; with matches also ``__hits``."""
        sent, shown = df.sparkSession.sparkContext.broadcast((self.config.positive, self.config.negative)), self.with_matches
        fields = "up int, down int, n int" + (", hits array<string>" if shown else "")
        kinds = pa.struct([("up", pa.int32()), ("down", pa.int32()), ("n", pa.int32()), *([("hits", pa.list_(pa.string()))] if shown else [])])

        def counted(texts, lists):
            words = pc.split_pattern(pc.fill_null(texts, ""), " ")
            coded = pc.dictionary_encode(words.flatten())
            different, place, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
            first = [k.firsts(different) for k in lists]
            total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks[place])])[ends])
            out = {"up": total(first[0] >= 0), "down": total(first[1] >= 0), "n": total(np.array([w != "" for w in different], bool))}
            if shown:
                marks = [[sign + k.keywords[i] for sign, k, i in (("+", lists[0], a), ("-", lists[1], b)) if i >= 0] for a, b in zip(*first)]
                out["hits"] = [[m for w in place[x:y].tolist() for m in marks[w]] for x, y in zip(ends, ends[1:])]
            return _rows_of(out, kinds)

        @F.arrow_udf(fields)
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            lists = [KeywordIndex(k) for k in sent.value]
            for texts in batches:
                yield pa.concat_arrays([counted(part, lists) for part in _slices(texts)])

        cut = df.withColumn("__counts", count(tx.spaced(F.col(text), **self.config.switches)))
        names = {"__up": "up", "__down": "down", "__n": "n", **({"__hits": "hits"} if shown else {})}
        return cut.withColumns({c: F.col(f"__counts.{n}") for c, n in names.items()}).drop("__counts")

    def _counted(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``__up``, ``__down`` and ``__n``: words that hit, and all words; with matches also ``__words``.

        Words repeat, so the words of a slice of texts are dictionary-encoded
        and only the different ones are tested: a word hits because it holds a core keyword
        or because it is a part of a keyword. Sums over the texts follow.
        """
        lists = [self.config.positive, self.config.negative]
        tests = [(_parts(k), "|".join(re.escape(c) for c in _cores(k))) for k in lists]

        kinds = pa.struct([("up", pa.int32()), ("down", pa.int32()), ("n", pa.int32())])

        def counted(texts):
            words = pc.split_pattern(pc.fill_null(texts, ""), " ")
            coded = pc.dictionary_encode(words.flatten())
            different, place, ends = coded.dictionary, coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
            real = np.asarray(pc.not_equal(different, ""))

            def total(marks):
                sums = np.concatenate([[0], np.cumsum(marks[place])])
                return sums[ends[1:]] - sums[ends[:-1]]

            out = []
            for parts, cores in tests:
                found = np.asarray(pc.is_in(different, pa.array(parts, pa.string())))
                if cores:
                    found = found | np.asarray(pc.match_substring_regex(different, cores))
                out.append(total(found & real))
            return _rows_of({"up": out[0], "down": out[1], "n": total(real)}, kinds)

        @F.arrow_udf("up int, down int, n int")
        def count(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([counted(part) for part in _slices(texts)])

        cut = df.withColumn("__spaced", tx.spaced(F.col(text), **self.config.switches)).withColumn("__counts", count("__spaced"))
        cut = cut.withColumns({"__up": F.col("__counts.up"), "__down": F.col("__counts.down"), "__n": F.col("__counts.n")})
        if self.with_matches:
            cut = cut.withColumn("__words", tx.words_of(F.col("__spaced")))
        return cut.drop("__spaced", "__counts")

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        cfg = self.config
        if sum(map(len, [*cfg.positive, *cfg.negative])) > self.large:
            counted = self._indexed(df, text)
        else:
            counted = self._counted(df, text)
            counted = counted.withColumn("__hits", self._matches(F.col("__words"))) if self.with_matches else counted
        if not self.with_matches:
            counted = counted.withColumn("__hits", F.lit(None).cast("array<string>"))
        p, n, size = F.col("__up"), F.col("__down"), F.greatest(F.col("__n"), F.lit(1))
        none = (p + n) == 0
        value = F.when(none, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - n) / size * 2)))
        confidence = F.when(none, 0.0).otherwise(F.least((p + n) / size + 0.1, F.lit(1.0)))
        scored = counted.withColumns({"__value": value, "__conf": confidence})
        result = F.struct(
            F.col("__value").alias("score"),
            label(F.col("__value"), cfg.neutral_threshold).alias("label"),
            F.col("__conf").alias("confidence"),
            F.struct(p.alias("positive"), n.alias("negative"), F.col("__hits").alias("matched"),
                     F.col("__n").alias("words")).alias("details"),
        )
        return scored.withColumn(out, F.when(F.col(text).isNotNull(), result)).drop(
            "__words", "__up", "__down", "__n", "__hits", "__value", "__conf")

    def _matches(self, words: Column) -> Column:
        """Hits in word order, per word positive before negative, first keyword in list order."""
        def first(keywords, sign, word):
            listed = F.array(*[F.lit(k) for k in keywords])
            found = F.filter(listed, lambda k: F.contains(word, k) | F.contains(k, word))
            return F.concat(F.lit(sign), F.get(found, F.lit(0)))

        cfg = self.config
        up, down = hits(cfg.positive), hits(cfg.negative)
        return F.flatten(F.transform(
            F.filter(words, lambda w: up(w) | down(w)),
            lambda w: F.array_compact(F.array(first(cfg.positive, "+", w), first(cfg.negative, "-", w)))))


@dataclass(frozen=True)
class LexiconRules:
    """Rule constants after Hutto & Gilbert, "VADER", ICWSM 2014."""

    boost: float = 0.293
    caps: float = 0.733
    negation: float = -0.74
    exclamation: float = 0.292
    question: float = 0.18
    many_questions: float = 0.96
    before_but: float = 0.5
    after_but: float = 1.5
    alpha: float = 15.0
    fade: tuple = (1.0, 0.95, 0.9)
    boosters: frozenset = frozenset(
        "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially "
        "exceptionally extremely fabulously greatly highly hugely incredibly intensely majorly more most "
        "particularly purely quite really remarkably so substantially thoroughly totally tremendously "
        "unbelievably unusually utterly very".split())
    dampers: frozenset = frozenset(
        "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat "
        "sorta".split())
    negations: frozenset = frozenset(
        "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither "
        "never no nobody none nope nor not nothing nowhere shant shouldnt wasnt werent without wont wouldnt "
        "rarely seldom despite".split())

    @classmethod
    def plain(cls) -> "LexiconRules":
        """Sum of valences only, normalised."""
        return cls(0, 0, 1, 0, 0, 0, 1, 1, boosters=frozenset(), dampers=frozenset(), negations=frozenset())


_RATING = T.StructType([T.StructField(n, T.DoubleType()) for n in ("compound", "pos", "neg", "neu")])


ENTRY_BYTES = 200  # of a word and its valence in a dictionary, besides the letters
EDGES = "!?.,;:'\"()[]{}<>*_~#@&%$-"


def _spoken(raw: str) -> tuple[str, str, bool]:
    """A word without the marks around it: lowered, the same without apostrophes, and whether it is in capitals."""
    bare = raw.strip(EDGES)
    word = bare if len(bare) > 1 else raw
    low = word.lower()
    return low, low.replace("'", "").replace("\u2019", ""), word.isupper()


def rate_words(text: str, valence: dict, rules: LexiconRules, known: dict | None = None) -> tuple[float, float, float, float]:
    """Compound, positive, negative and neutral share of one text. ``known`` keeps words already taken apart."""
    known = {} if known is None else known
    words = []
    for raw in text.split():
        word = known.get(raw)
        if word is None:
            word = known[raw] = _spoken(raw)
        words.append(word)
    capitals = sum(w[2] for w in words)
    shouting = 0 < capitals < len(words)

    def denies(word):
        return word[1] in rules.negations or bool(rules.negations) and word[0].endswith(("n't", "n\u2019t"))

    scores = {}
    for i, (word, _, upper) in enumerate(words):
        v = valence.get(word, 0.0)
        if not v or word in rules.boosters or word in rules.dampers:
            continue
        sign = math.copysign(1.0, v)
        if shouting and upper:
            v += sign * rules.caps
        before = words[max(0, i - 3):i]
        for fade, (near, _, loud) in zip(rules.fade, reversed(before)):
            step = rules.boost if near in rules.boosters else -rules.boost if near in rules.dampers else 0.0
            if step and shouting and loud:
                step += math.copysign(rules.caps, step)
            v += sign * step * fade
        if any(denies(w) for w in before):
            v *= rules.negation
        scores[i] = v
    turn = next((i for i, w in enumerate(words) if w[0] == "but"), None)
    if turn is not None:
        scores = {i: v * (rules.before_but if i < turn else rules.after_but if i > turn else 1.0) for i, v in scores.items()}
    marks = text.count("?")
    emphasis = min(text.count("!"), 4) * rules.exclamation
    if marks > 1:
        emphasis += marks * rules.question if marks <= 3 else rules.many_questions
    total = sum(scores.values())
    total += math.copysign(emphasis, total) if total else 0.0
    compound = max(-1.0, min(1.0, total / math.sqrt(total * total + rules.alpha)))
    up = sum(s + 1 for s in scores.values() if s > 0)
    down = sum(s - 1 for s in scores.values() if s < 0)
    flat = len(words) - sum(1 for s in scores.values() if s)
    if up > -down:
        up += emphasis
    elif up < -down:
        down -= emphasis
    whole = (up - down + flat) or 1.0
    return compound, up / whole, -down / whole, flat / whole


def _trimmed(words: pa.Array) -> pa.Array:
    bare = pc.utf8_trim(words, EDGES)
    return pc.if_else(pc.greater(pc.utf8_length(bare), 1), bare, words)


def spoken_words(texts: pa.Array) -> pa.Array:
    """The different words of each text as ``rate_texts`` looks them up; null texts have none."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(split.flatten())
    many, words = len(texts), _trimmed(coded.dictionary)
    low = np.array(pc.ascii_lower(words).to_pylist(), object)
    for i in np.flatnonzero(~np.asarray(pc.string_is_ascii(words))):
        low[i] = _spoken(words[int(i)].as_py())[0]
    low = pc.dictionary_encode(pa.array(low, pa.string()))
    n, of = len(low.dictionary), np.repeat(np.arange(many), np.diff(split.offsets.to_numpy()))
    held = np.unique(of * max(n, 1) + low.indices.to_numpy()[coded.indices.to_numpy()])
    held = held[np.asarray(pc.not_equal(low.dictionary, ""))[held % max(n, 1)]] if n else held
    ends = np.searchsorted(held, np.arange(many + 1) * max(n, 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), low.dictionary.take(pa.array(held % max(n, 1))))


def _word_facts(words: pa.Array, tokens: pa.Array, valence: np.ndarray, rules: LexiconRules) -> dict[str, np.ndarray]:
    """What the rules ask of different words. Arrow folds ASCII words, Python the others, whose cases are not one letter for one."""
    words = _trimmed(words)
    low, plain, upper = (np.array(x.to_pylist(), object) for x in (
        pc.ascii_lower(words), pc.replace_substring(pc.ascii_lower(words), "'", ""), pc.ascii_is_upper(words)))
    for i in np.flatnonzero(~np.asarray(pc.string_is_ascii(words))):
        low[i], plain[i], upper[i] = _spoken(words[int(i)].as_py())
    low, plain = pa.array(low, pa.string()), pa.array(plain, pa.string())

    def among(column, some):
        return np.asarray(pc.is_in(column, pa.array(sorted(some), pa.string())))

    more, less = among(low, rules.boosters), among(low, rules.dampers)
    at = np.asarray(pc.fill_null(pc.index_in(low, tokens), -1))
    value = np.where(at >= 0, valence[at], 0.0) if len(valence) else np.zeros(len(at))
    denies = among(plain, rules.negations)
    if rules.negations:
        denies |= np.asarray(pc.or_(pc.ends_with(low, "n't"), pc.ends_with(low, "n\u2019t")))
    return {"value": np.where(more | less, 0.0, value), "step": rules.boost * more - rules.boost * (less & ~more), "denies": denies,
            "upper": upper.astype(bool), "turns": np.asarray(pc.equal(low, "but"))}


def rate_texts(texts: pa.Array, tokens: pa.Array, valence: np.ndarray, rules: LexiconRules) -> np.ndarray:
    """``rate_words`` for many texts at once, a row each; null texts rate as empty ones.

    Each different word is looked up once. Rules that look at the words before
    a rated one shift the array of word codes; sums run over the words of a text.
    """
    many = len(texts)
    filled = pc.fill_null(texts, "")
    split = pc.utf8_split_whitespace(filled)
    coded = pc.dictionary_encode(split.flatten())
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    real = np.asarray(pc.not_equal(coded.dictionary, ""))[coded.indices.to_numpy()] if len(coded.dictionary) else np.zeros(0, bool)
    code = coded.indices.to_numpy()[real]
    first = np.concatenate([[0], np.cumsum(real)])[ends]
    n = np.diff(first)
    of = np.repeat(np.arange(many), n)
    fact = _word_facts(coded.dictionary, tokens, valence, rules)
    upper = fact["upper"][code]
    capitals = np.bincount(of, upper, many)
    shouting = (capitals > 0) & (capitals < n)
    at = np.flatnonzero(fact["value"][code] != 0)
    v, text = fact["value"][code[at]], of[at]
    sign, place = np.sign(v), at - first[:-1][text]
    v = v + np.where(shouting[text] & upper[at], sign * rules.caps, 0.0)
    denied = np.zeros(len(at), bool)
    for k in range(1, 4):
        before = np.where(place >= k, at - k, at)
        step = np.where(place >= k, fact["step"][code[before]], 0.0)
        if k <= len(rules.fade):
            loud = (step != 0) & shouting[text] & upper[before]
            v = v + sign * np.where(loud, step + np.sign(step) * rules.caps, step) * rules.fade[k - 1]
        denied |= (place >= k) & fact["denies"][code[before]]
    v = np.where(denied, v * rules.negation, v)
    turning = np.flatnonzero(fact["turns"][code])[::-1]
    turn = np.full(many, -1)
    turn[of[turning]] = turning
    late = turn[text]
    v = np.where((late < 0) | (at == late), v, np.where(at < late, v * rules.before_but, v * rules.after_but))
    marks = np.asarray(pc.count_substring(filled, "?"))
    emphasis = np.minimum(np.asarray(pc.count_substring(filled, "!")), 4) * rules.exclamation
    emphasis = emphasis + np.where(marks > 1, np.where(marks <= 3, marks * rules.question, rules.many_questions), 0.0)
    total = np.bincount(text, v, many)
    total = total + np.sign(total) * emphasis
    compound = np.clip(total / np.sqrt(total * total + rules.alpha), -1.0, 1.0)
    up, down = np.bincount(text, np.where(v > 0, v + 1, 0.0), many), np.bincount(text, np.where(v < 0, v - 1, 0.0), many)
    flat = n - np.bincount(text, v != 0, many)
    rising, falling = up > -down, up < -down
    up, down = up + np.where(rising, emphasis, 0.0), down - np.where(falling, emphasis, 0.0)
    whole = up - down + flat
    whole = np.where(whole == 0, 1.0, whole)
    return np.stack([compound, up / whole, -down / whole, flat / whole], axis=1)


@dataclass(frozen=True)
class LexiconScorer:
    """Valence scorer over a lexicon table ``(token string, valence double)``.

    A lexicon of at most ``max_broadcast`` bytes goes to the tasks as one
    broadcast table. A larger one is joined to the distinct words of the
    distinct texts instead. A rating depends on nothing but the text, so both
    give every row the same, whatever its ids. The lexicon is read once for a
    scorer, however many frames it scores.
    """

    lexicon: DataFrame
    rules: LexiconRules = LexiconRules()
    max_broadcast: int = 16 << 20
    name: str = "lexicon"

    @functools.cached_property
    def _known(self) -> DataFrame:
        return self.lexicon.filter("token is not null and valence is not null").groupBy("token").agg(F.max("valence").cast("double").alias("valence"))

    @functools.cached_property
    def _sent(self):
        """The lexicon as a broadcast, or nothing if it is too large."""
        if (self._known.agg(F.sum(F.octet_length("token") + ENTRY_BYTES)).first()[0] or 0) > self.max_broadcast:
            return None
        found = self._known.toArrow().combine_chunks()
        return self.lexicon.sparkSession.sparkContext.broadcast(
            (found.column("token").combine_chunks().cast(pa.string()), found.column("valence").to_numpy()))

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        rules, sent = self.rules, self._sent

        kinds = pa.struct([(n, pa.float64()) for n in _RATING.names])

        def rows(texts: pa.Array, tokens, valence) -> pa.Array:
            rated = rate_texts(texts, tokens, valence, rules)
            return _rows_of({n: np.ascontiguousarray(rated[:, k]) for k, n in enumerate(_RATING.names)}, kinds, texts.is_null())

        if sent is not None:
            @F.arrow_udf(_RATING)
            def rate(texts: pa.Array) -> pa.Array:
                return pa.concat_arrays([rows(part, *sent.value) for part in _slices(texts)])

            rated = df.withColumn("__rate", rate(F.col(text)))
        else:
            @F.arrow_udf("array<string>")
            def spoken(texts: pa.Array) -> pa.Array:
                return pa.concat_arrays([spoken_words(part) for part in _slices(texts)])

            @F.arrow_udf(_RATING)
            def rate_found(texts: pa.Array, found: pa.Array) -> pa.Array:
                out, start = [], 0
                for part in _slices(texts):
                    pairs = found.slice(start, len(part)).flatten()
                    start += len(part)
                    tokens = pc.dictionary_encode(pairs.field("token"))
                    valence = np.zeros(len(tokens.dictionary))
                    valence[tokens.indices.to_numpy()] = pairs.field("valence").to_numpy(zero_copy_only=False)
                    out.append(rows(part, tokens.dictionary, valence))
                return pa.concat_arrays(out)

            used = df.select(F.md5(F.col(text)).alias("__key"), spoken(F.col(text)).alias("__words")).filter("__key is not null").dropDuplicates(["__key"])
            used = used.select("__key", F.explode("__words").alias("token"))
            found = used.join(self._known, "token").groupBy("__key").agg(F.collect_list(F.struct("token", "valence")).alias("__found"))
            rated = df.withColumn("__key", F.md5(F.col(text))).join(found, "__key", "left").withColumn(
                "__rate", rate_found(F.col(text), F.col("__found"))).drop("__found", "__key")
        value = F.col("__rate.compound")
        result = F.struct(
            value.alias("score"),
            F.when(value >= 0.05, "positive").when(value <= -0.05, "negative").otherwise("neutral").alias("label"),
            F.least(F.abs(value) + 0.1, F.lit(1.0)).alias("confidence"),
            F.struct(*[F.col(f"__rate.{n}") for n in ("pos", "neg", "neu", "compound")]).alias("details"),
        )
        return rated.withColumn(out, F.when(value.isNotNull(), result)).drop("__rate")


@dataclass(frozen=True)
class EnsembleScorer:
    """Weighted mean of scorers; a scorer that failed on a row leaves its weight to the rest."""

    members: Sequence[tuple]
    config: ScoreConfig = ScoreConfig()
    name: str = "ensemble"

    def __post_init__(self):
        if not [w for _, w in self.members if w > 0]:
            raise ValueError("no scorer available or configured")

    def score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        members = [(s, w) for s, w in self.members if w > 0]
        total = sum(w for _, w in members)
        names = [f"__{s.name}" for s, _ in members]
        for (scorer, _), name in zip(members, names):
            df = scorer.score(df, text, name)
        weights = {n: F.when(F.col(n).isNotNull(), F.lit(w / total)).otherwise(0.0)
                   for n, (_, w) in zip(names, members)}
        weight = sum(weights.values(), F.lit(0.0))

        def mean(field):
            parts = [weights[n] * F.coalesce(F.col(f"{n}.{field}"), F.lit(0.0)) for n in names]
            return F.try_divide(sum(parts, F.lit(0.0)), weight)

        blank = tx.strip(F.col(text)) == ""
        df = df.withColumns({
            "__blank": F.col(text).isNull() | blank,
            "__value": _clipped(mean("score"), -1.0, 1.0),
            "__conf": _clipped(mean("confidence"), 0.0, 1.0),
        })
        empty, value, conf = F.col("__blank"), F.col("__value"), F.col("__conf")
        unscored = empty | value.isNull()
        cfg = self.config
        tag = F.when(unscored | (conf < cfg.confidence_threshold), "neutral").otherwise(
            label(value, cfg.neutral_threshold))
        result = F.struct(
            F.when(unscored, 0.0).otherwise(value).alias("score"),
            tag.alias("label"),
            F.when(unscored, 0.0).otherwise(conf).alias("confidence"),
            F.when(empty, "Empty text").when(value.isNull(), "All analyzers failed").alias("error"),
            F.struct(*[F.col(n).alias(n[2:]) for n in names]).alias("details"),
        )
        return df.withColumn(out, result).drop("__blank", "__value", "__conf", *names)


def make_scorer(options: dict | ScoreConfig | None = None, lexicon: DataFrame | None = None,
                rules: LexiconRules = LexiconRules()) -> EnsembleScorer:
    """The configured ensemble. Without a lexicon only keywords count."""
    cfg = options if isinstance(options, ScoreConfig) else ScoreConfig.from_dict(options)
    members = [(KeywordScorer(cfg), cfg.keyword_weight)]
    if lexicon is not None:
        members.insert(0, (LexiconScorer(lexicon, rules), cfg.lexicon_weight))
    return EnsembleScorer(tuple(members), cfg)


def score_posts(posts: DataFrame, scorer: Scorer, text: str = "content", strict: bool = False) -> DataFrame:
    """Fill the three sentiment columns; rows that cannot be scored keep nulls and say why.

    A post without text is not scored at all. ``strict`` fails the job when a
    scorer returns a value out of range, instead of marking the row.
    """
    df = scorer.score(posts, text, "__s")
    value, conf = F.col("__s.score"), F.col("__s.confidence")
    missing = F.col(text).isNull() | (F.col(text) == "")
    wrong = ~(value.between(-1.0, 1.0) & conf.between(0.0, 1.0))
    problem = F.when(missing, "Empty content").when(value.isNull(), "Scorer failed")
    if not strict:
        problem = problem.when(wrong, "Score out of range")
    else:
        value = F.when(wrong, F.raise_error(F.lit("score or confidence out of range"))).otherwise(value)
    usable = problem.isNull()
    return df.withColumns({
        "sentiment_score": F.when(usable, value),
        "sentiment_label": F.when(usable, F.col("__s.label")),
        "sentiment_confidence": F.when(usable, conf),
        "scoring_error": problem,
    }).drop("__s")
