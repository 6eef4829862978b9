"""Piece encoding, alignment of tokenizers and spelling variants against plain versions and the libraries."""

import gc
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chirpline.llm import alignment, bytepairs, catalog, merging, sentencepieces, units, variants
from chirpline.llm.tokencount import byte_letters
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
BITS = ["▁", " ", "  ", "a", "the", "é", "日本", "\n", "\t", "\x00", "ü", "🎉", "<0x41>", "</s>", "<|endoftext|>", "́", "​", "ing", "\r\n",
        "\r", "';", "());", "﻿", "aaaa", " " * 20, "\xa0", "　", "ﬁ", "1234", "�", "can't", "\x85", "\x1c"]
ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
FORMS = ("n", "n_near", "form", "form_n", "root")


@pytest.fixture(scope="module")
def models():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte_model.encode_special_tokens = True
    return byte_model, {c: b for b, c in byte_letters().items()}, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = {i: "".join(rng.choice(BITS[i % 5 > 0:]) for _ in range(rng.randrange(0, 25))) for i in range(n)}
    return out | {n: None, n + 1: "", n + 2: " ", n + 3: "x" * 3000, n + 4: "aé" * 1500, n + 5: "word " * 4000, n + 6: "word " * 4000}


def by_key(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def frame(spark, texts, extra=True):
    """Texts with further columns of names that the operators use inside."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return df.withColumns({n: F.lit(7) for n in ("ids", "slice", "pair", "word", "n", "groups", "_part", "decoded")}) if extra else df


def saved(path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_pieces_like_the_library(spark, models, tmp_path):
    texts = odd_texts(1, 600)
    got = by_key(sentencepieces.op12_sentencepiece(spark, saved(tmp_path, documents=frame(spark, texts))), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == plain.pieces(texts, models[2])


def test_pieces_are_decoded_like_the_library(spark, models):
    rng = random.Random(2)
    rows = {i: [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 29871, 2, 1, 0, 259]) for _ in range(rng.randrange(8))] for i in range(800)}
    df = spark.createDataFrame([*rows.items(), (900, None), (901, [None, 263])], "doc_id long, ids array<int>").repartition(3)
    got = by_key(sentencepieces.decode(df), "text")
    assert got.pop(900) == (None,) and got.pop(901) == (models[2].decode([263]),)
    assert got == {i: (models[2].decode(ids),) for i, ids in rows.items()}
    ids = sentencepieces.encode(frame(spark, {1: "Ab́  c\n", 2: ""}))
    assert by_key(sentencepieces.decode(ids), "text") == {1: ("Ab́  c\n",), 2: ("",)}


def test_memory_of_pieces_forgets_without_harm(models):
    model = sentencepieces.PieceModel(remembered=3)
    texts = [t for t in odd_texts(3, 40).values() if t]
    for _ in range(2):
        for t in texts:
            ids, counts = model.ids(pa.array([t]))
            assert ids.tolist() == models[2].encode(t, add_eos=True) and counts.tolist() == [len(ids)]


def merge_text(text, rank):
    parts = list(text)
    while len(parts) > 1:
        best, i = min((rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == merging.NEVER:
            break
        parts[i:i + 2] = ["".join(parts[i:i + 2])]
    return parts


def test_backtracking_is_merging():
    """Random vocabularies in which longest matches often fail, some with equal ranks, one by one and together."""
    rng, stepped_back = random.Random(5), 0
    for trial in range(60):
        words = {"".join(rng.choice("abc") for _ in range(rng.choice([2, 2, 3, 3, 4]))) for _ in range(12)}
        ranks = {w: rng.randrange(8) if trial % 2 else i for i, w in enumerate(words)}
        rank = lambda a, b: ranks.get(a + b, merging.NEVER)  # noqa: B023, E731
        tokens = {t: i for i, t in enumerate([*"ab", *words])}
        encoder = merging.BacktrackEncoder(tokens, rank)
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
        want = [[tokens.get(p, encoder.virtual + ord(p[0])) for p in merge_text(t, rank)] for t in texts]
        ids, counts = encoder.encode_all(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert [encoder.encode(t) for t in texts] == want
        stepped_back += sum(len(w) > 1 for w in want)
    assert stepped_back


def test_models_travel_small_and_encode_as_before(models):
    """An automaton leaves its plain tables behind and makes them again where a long string needs them."""
    model = bytepairs.ByteModel()
    data = pickle.dumps(model.encoder.automaton)
    assert len(data) < 4_500_000
    there = pickle.loads(data)
    assert there.moves is None
    there.for_single_steps()
    assert (there.moves, there.fail, there.token) == (model.encoder.automaton.moves, model.encoder.automaton.fail, model.encoder.automaton.token)
    model.encoder.automaton = pickle.loads(data)
    rng = random.Random(8)
    units = list(dict.fromkeys(rng.choice(["", " ", "\xa0", "  "]) + "".join(rng.choice(["a", "Ing", "ß", "ª", "ɏ", "ɐ", "日", "7", "'ll", ",", "́"])
                               for _ in range(rng.randrange(1, 6))) for _ in range(500))) + ["ab" * 3000, "é" * 1200]
    ids, counts = model.encode_units(units)
    want = [models[0].encode(u, add_special_tokens=False).ids for u in units]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_aligner_holds_little_for_each_unit():
    both = alignment.Aligner(remembered=4000)
    rng, words = random.Random(3), set()
    while len(words) < 12_000:
        words.add("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)))
    texts = [pa.array([" ".join(list(words)[lo:lo + 1000])]) for lo in range(0, 12_000, 1000)]
    first = both.aligned(texts[0])
    both.start()
    tracemalloc.start()
    try:
        for text in texts[:4]:
            both.aligned(text)
        both.start()
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 250 * 4000
    for text in texts:
        both.aligned(text)
        assert len(both.memory) <= 2 * 5000
    assert all(np.array_equal(x, y) for x, y in zip(both.aligned(texts[0])[3], first[3]))


def test_shelf_finds_records_of_equal_hashes():
    shelf, asked = units.Shelf(3), []

    def ask(names, keys):
        flat, sizes = np.frombuffer(b"".join(keys), np.uint8), np.array([len(k) for k in keys], np.int32)

        def make(places):
            asked.append([keys[p] for p in places])
            own = [keys[p] * 2 for p in places]
            return [(np.frombuffer(b"".join(own), np.uint8), np.array([len(o) for o in own], np.int32))]

        return units.split_rows(*shelf.records(np.array(names, np.uint64), (flat, sizes), make)[0])

    assert ask([7, 9], [b"a", b"bb"]) == [b"aa", b"bbbb"]
    assert ask([9, 7, 5], [b"bb", b"c", b""]) == [b"bbbb", b"cc", b""] and asked[1] == [b"c", b""]
    assert shelf.new is None and len(shelf) == 4
    assert ask([1, 9], [b"d", b"bb"]) == [b"dd", b"bbbb"] and asked[2] == [b"d"]
    assert ask([], []) == []


def test_alignment_like_the_libraries(spark, models, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 3000)
    texts = odd_texts(4, 600)
    path = saved(tmp_path, documents=frame(spark, texts))
    assert by_key(alignment.op13_alignment(spark, path), *ALIGNED) == plain.alignment(texts, *models)


def test_groups_of_tokens(spark):
    got = by_key(alignment.align(frame(spark, {1: "hello world", 2: "a ▁", 3: None}), groups=True), "groups", "n_links")
    assert got == {1: ("23748|6312,28709;995|1526", 3), 2: ("", 0), 3: ("", 0)}


def test_pointers_meet_at_the_end_of_each_group():
    rng = random.Random(6)
    for _ in range(100):
        size = rng.randrange(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randrange(1, size + 1)), size})) for _ in range(2))
        group_a, group_b, _, _ = alignment.jump(a, b)
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        label = lambda end: min(c for c in cuts if c >= end)  # noqa: B023, E731
        assert [b[g] for g in group_a] == [label(e) for e in a.tolist()] and [b[g] for g in group_b] == [label(e) for e in b.tolist()]


def some_words(seed, n, letters="abcé", sizes=(1, 4, 7, 8, 9)):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n // 4)]
    out = {}
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        out["".join(w)] = rng.choice([1, 2, 3, 20, 30, 200, 400, 3000])
    return out


@pytest.mark.parametrize("most", [50_000, 3])
def test_variants(spark, most):
    words = some_words(7, 300) | {"z" * 900: 5, "z" * 400 + "y" + "z" * 499: 60, "z" * 899: 5000, "": 9}
    df = spark.createDataFrame([*words.items()], "word string, n long").repartition(3)
    got = by_key(variants.variants(df, most=most), *FORMS, key="word")
    want = plain.spelling_variants({w: n for w, n in words.items() if w})
    empty = got.pop("")
    assert got == want and empty == (9, 0, None, None, "")


def test_acceptor_of_several_groups():
    rng = random.Random(8)
    for _ in range(60):
        words = list({"".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(rng.choice([2, 10, 60]))})
        rng.shuffle(words)
        group = np.unique(sorted(rng.randrange(3) for _ in words), return_inverse=True)[1]
        codes, first = variants.char_codes(pa.array(words))
        machine = variants.Acceptor(codes, first[:-1], np.diff(first), group)
        a, b = machine.one_edit(np.full(int(group[-1]) + 1, 99))
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))
        assert got == sorted((i, j) for j in range(len(words)) for i in range(j) if group[i] == group[j] and plain.one_edit(words[i], words[j]))
        assert len(machine.final) <= len({w[i:] for w in words for i in range(len(w) + 1)}) + len(set(group.tolist()))


def test_words_of_documents(spark, tmp_path):
    rng = random.Random(9)
    words = [w for w in some_words(10, 150, letters="abcdeé", sizes=(7, 8, 9, 12)) if w]
    texts = {i: " ".join(rng.choice([str.upper, str.title, str])(rng.choice(words)) + rng.choice(["", ",", "1", "×", "-x"]) for _ in range(rng.randrange(60))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "12 34", 203: "a" * 5000 + " " + "a" * 5000}
    got = by_key(variants.op11_variants(spark, saved(tmp_path, documents=frame(spark, texts))), *FORMS, key="word")
    want = plain.spelling_variants(plain.marred_words(texts))
    assert got == want and any(w[2] for w in want.values())


def test_null_ids_and_repeated_rows(spark, models):
    rows = [(None, "repeated words"), (None, "repeated words"), (1, "repeated words"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    aligned = alignment.align(df).collect()
    assert sorted((str(r["doc_id"]), r["n_best"] == r["n_links"], r["count_sum"] == 3 * r["n_links"]) for r in aligned) == [
        ("1", True, True), ("1", True, True), ("None", True, True), ("None", True, True)]
    ids = [r["ids"] for r in sentencepieces.encode(df).collect()]
    assert sorted(ids) == sorted(models[2].encode(t or "", add_eos=True) for _, t in rows)
    found = by_key(variants.counted(variants.runs(df).withColumnRenamed("run", "word")), "n", key="word")
    assert found == {"repeated": (3,)}
    assert plain.marred_words({None: "repeated repeated"}) == {r["word"]: r["n"] for r in variants.counted(variants.marred(variants.runs(df))).collect()}


@pytest.mark.parametrize("name", ["op11_variants", "op12_sentencepiece", "op13_alignment"])
def test_no_documents(spark, tmp_path, name):
    path = saved(tmp_path, documents=spark.createDataFrame([], "doc_id long, text string, word int"))
    assert catalog.QUERIES[name](spark, path).collect() == []
