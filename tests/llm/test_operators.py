"""The dealt operators against plain versions, on random and awkward inputs."""

import ctypes
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chirpline.llm import (
    catalog, decontaminate, frames, licenses, linededup, ngramjoin, pack, pii, quality, substrings, tokencount, vectors, words)
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def variants(seed, n, words=60, bases=10, sizes=(3, 12, 40, 80)):
    """Texts of few words: random ones and edited copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice(sizes))] for _ in range(bases)]
    out = {}
    for i in range(n):
        if i % 3 == 0:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 20, 50]))]
        else:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[i] = rng.choice([" ", "\n", " \t"]).join(w)
    return out | {n: None, n + 1: "", n + 2: "A b C d E f g H i j K l m", n + 3: "a B c D e F G h I J k L M"}


@pytest.fixture
def docs(spark):
    def make(texts):
        return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)

    return make


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_decontamination(spark, docs, tmp_path):
    texts = variants(1, 200)
    items = {i: t for i, t in list(variants(1, 40).items())[1:12]} | {90: "w1", 91: "w2 w3 w4", 92: None, 93: "..."}
    path = saved(spark, tmp_path, documents=docs(texts), benchmark=spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = by_id(decontaminate.op2_decontaminate(spark, path), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == plain.contamination(texts, items)
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    shards = decontaminate.matched(docs(texts), frame, shard_words=20)
    one = by_id(decontaminate.matched(docs(texts), frame), "n_words", "item_ids", "spans")
    assert by_id(shards, "n_words", "item_ids", "spans") == one


def test_decontaminated_texts_keep_the_rest(spark, docs):
    item = " ".join(f"x{i}" for i in range(12))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = {1: "before " * 20 + item.upper() + " after." * 20, 2: item, 3: "nothing here", 4: None}
    got = by_id(decontaminate.decontaminate(docs(texts), items), "text")
    assert 2 not in got and got[3] == ("nothing here",) and got[4] == (None,)
    assert "x0" not in plain.low(got[1][0]) and got[1][0].startswith("before before") and got[1][0].endswith(" after.")


def test_spans_below_the_length_limit_stay(spark, docs):
    item = " ".join(f"x{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "y1 y2 y3")], "item_id long, text string")
    before, after = "before " * 60, " after" * 60
    texts = {n: before + " ".join(f"x{i}" for i in range(n)) + after for n in (9, 10, 24, 25, 30)} | {1: before + "y1 y2 y3" + after}
    got = by_id(decontaminate.decontaminate(docs(texts), items, max_span=25), "text")
    for n in texts:
        cut = n in (25, 30, 1)
        assert (got[n][0] == texts[n]) == (not cut) and (not cut or got[n][0] == before + after)


def test_lines(docs):
    rng = random.Random(3)
    lines = [t for t in variants(2, 60, words=80, sizes=(4, 12, 25, 40)).values() if t]
    texts = {i: "\n".join(rng.choice(lines).replace("\n", " ") for _ in range(rng.choice([0, 1, 2, 6]))) for i in range(250)}
    texts |= {500: None, 501: "\n\n", 502: "\n".join(["a b c d E f"] * 3)}
    got = by_id(linededup.dedup_lines(docs(texts), removed_col="gone"), "text", "gone")
    want = plain.line_dedup(texts)
    assert {d: (len(g), t or "") for d, (t, g) in got.items()} == {d: w[1:] for d, w in want.items()}


def test_lines_of_few_words(spark, docs, tmp_path):
    """Later repeats of short lines and of long lines of few words go as well, in the query and in the pipeline's stage."""
    import corpus_pipeline

    rng = random.Random(5)
    short = ["les.", "a b", "Yes yes YES", "w1 w2 w3 w4", "w1 w2 w3", "one two three four " * 250, " ".join(f"n{i}" for i in range(9)), " ".join(f"n{i}" for i in range(10)),
             " ".join(f"n{i}" for i in range(8)), "", "  "]
    texts = {i: "\n".join(rng.choice(short) for _ in range(rng.choice([1, 2, 6]))) for i in range(60)} | {90: None, 91: "seen once", 92: "new line\nles."}
    want = plain.line_dedup(texts, least=1)
    assert sum(w[1] for w in want.values()) > 100
    got = by_id(linededup.op3_line_dedup(spark, saved(spark, tmp_path, documents=docs(texts))), "n_lines", "n_removed", "kept_sha256")
    assert got == {d: (*w[:2], plain.sha(w[2])) for d, w in want.items()}
    kept = by_id(corpus_pipeline.drop_repeated_lines(spark, docs(texts), ""), "text")
    assert {d: t or "" for d, (t,) in kept.items()} == {d: w[2] for d, w in want.items() if not w[1] or w[2].strip()}


def test_near_groups(docs):
    texts = variants(4, 500)
    assert by_id(ngramjoin.near_duplicates(docs(texts)), "n_shingles", "component_id") == plain.near_groups(texts)


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (700, ngramjoin.GROUPS)).astype(np.uint16)
    points[300:400] = points[:100]
    points[300:400, :7] += 1
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngramjoin.CountTree(points, sizes)
    for i in range(0, 700, 50):
        want = np.flatnonzero(ngramjoin.likely(points[i], sizes[i], points, sizes))
        assert sorted(tree.search(points[i], sizes[i], ngramjoin.ABOVE, ngramjoin.OF).tolist()) == want.tolist()


def test_group_counts_beyond_16_bits_reject_no_link():
    whole = np.arange(200_000, dtype=np.uint64) * np.uint64(ngramjoin.GROUPS)  # all in one group
    sets = [whole, whole[20_000:], whole[:100_000], np.arange(500, dtype=np.uint64)]
    stored = [ngramjoin.point(s).tobytes() for s in sets]
    points, sizes = ngramjoin.read_points(pa.array(stored, pa.binary())), np.array([len(s) for s in sets])
    assert points.sum(axis=1, dtype=np.int64).tolist() == sizes.tolist()
    assert ngramjoin.likely(points[0], sizes[0], points, sizes).tolist() == [True, True, False, False]
    tree = ngramjoin.CountTree(points, sizes)
    assert sorted(tree.search(points[0], sizes[0], ngramjoin.ABOVE, ngramjoin.OF).tolist()) == [0, 1]
    pair = ngramjoin.BlockPair(1, 2)
    for k, s in enumerate(sets):
        pair.add(1 + k % 2, k, k, stored[k], s.tobytes())
    assert list(pair.links(ngramjoin.ABOVE, ngramjoin.OF)) == [(0, 1)]


def test_blocks_meet_in_as_many_cells_as_linked_sets_share(spark, monkeypatch):
    rows = [(k, b, b, b) for k in range(6) for b in (10, 20)] + [(9, 20, 20, 20), (9, 30, 30, 30), (9, 40, 1, 2), (11, 50, 7, 7), (11, 60, 7, 7)]
    frame = spark.createDataFrame(rows, "key long, block long, least long, most long").repartition(3)
    meets = ngramjoin.meeting_blocks(frame)
    want = {(10, 20): 6, (20, 30): 1, (20, 40): 1, (30, 40): 1, (40, 40): 1}
    assert {(r["bx"], r["by"]): r["cells"] for r in meets.collect()} == want
    smallest = spark.createDataFrame([(10, 40), (20, 60), (30, 9), (40, 10)], "block long, n long")
    left = ngramjoin.often_enough(meets, smallest, ngramjoin.ABOVE, ngramjoin.OF)
    assert {(r["bx"], r["by"]) for r in left.collect()} == {(10, 20), (30, 40), (40, 40)}


def test_token_sets_follow_only_likely_pairs():
    rng = np.random.default_rng(2)
    base, other, far = (np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(3))
    sets = {1: (1, base), 2: (2, base[:390]), 3: (2, other), 4: (1, far), 5: (2, base[:380])}
    pair, full = ngramjoin.BlockPair(1, 2), ngramjoin.BlockPair(1, 2)
    for sid, (block, tokens) in sets.items():
        comp = 1 if sid == 5 else sid  # already one component with set 1
        pair.add(block, sid, comp, ngramjoin.point(tokens).tobytes())
        full.add(block, sid, comp, ngramjoin.point(tokens).tobytes(), tokens.tobytes())
    assert sorted(pair.wanted(ngramjoin.ABOVE, ngramjoin.OF)) == [(1, 1), (2, 2)]
    assert list(full.links(ngramjoin.ABOVE, ngramjoin.OF)) == [(1, 2)]


def test_texts_are_encoded_in_bounded_slices(docs, monkeypatch):
    monkeypatch.setattr(pack, "arrow_map", lambda df, make, schema: make)
    step, rows = pack.token_pieces(docs({1: "x"}))(), ["some plain words, again and again. " * 700] * 240
    tracemalloc.start()
    try:
        found = sum(len(part["piece"]) for part in step(pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert found >= 240 and peak < 38, peak


class Captured:
    """Stands for a frame of one batch and shows what a stage's function makes of it."""

    def __init__(self, spark, batch, schema):
        self.sparkSession, self.batch, self.schema = spark, batch, schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


@pytest.fixture
def large_batch(spark):
    texts = [f"{i} " + "the cat sat on a mat and " * 30_000 for i in range(3)] + [None, "", "one two three four five six seven eight nine ten"]
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    return Captured(spark, pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}), schema)


def test_stages_hand_on_large_batches_in_slices(spark, large_batch):
    item = spark.createDataFrame([("i", "zero one two three four five six seven eight nine ten")], "item_id string, text string")
    before = large_batch.batch.to_pylist()
    for kept, rows in ((decontaminate.decontaminate(large_batch, item), before[:-1]), (quality.keep_good(large_batch, None), before),
                       (quality.keep_good(large_batch, quality.ByteConvNet(), 0.0), before), (quality.keep_good(large_batch, quality.ByteConvNet(), 1.1), [])):
        assert [r for b in kept for r in b.to_pylist()] == rows
        assert len(kept) > 1 and all(b.num_rows == 1 or b.nbytes < 1 << 21 for b in kept)


def test_packing_gives_memory_back_after_each_slice(large_batch, monkeypatch):
    given = []
    monkeypatch.setattr(pack, "give_back", lambda: given.append(1))
    made = pack.token_pieces(large_batch)
    assert len(given) == len(made) == len(list(words.text_slices(large_batch.batch.column("text"), pack.SLICE))) > 1


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the memory allocator has no such call")
def test_freed_memory_goes_back():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    blocks = [bytes(1000) for _ in range(200_000)]
    last = blocks[::100]
    del blocks
    before = held()
    frames.give_back()
    assert held() < before - 100 and len(last) == 2000


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres, rows = rng.standard_normal((5, 20)), []
    for i in range(400):
        v = centres[rng.integers(5)] + rng.standard_normal(20) * rng.choice([0, 0.02, 0.15, 0.3]) if i % 3 else rng.standard_normal(20)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(1000, None), (1001, [0.0] * 20), (1002, [float("nan")] * 20), (1003, [1.0, 2.0, 3.0]), (1004, [2.0, 4.0, 6.0]), (1005, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = plain.vectors(rows)
    assert by_id(vectors.near_vectors(frame), "n_links", "component_id", "kept", key="vec_id") == want
    monkeypatch.setattr(vectors.vector_links, "__defaults__", (vectors.COSINE, vectors.BLOCK, vectors.GRID, 40))
    assert by_id(vectors.near_vectors(frame), "n_links", "component_id", "kept", key="vec_id") == want


def test_vectors_meet_without_copies(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    near = [(centre + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.26])).astype(np.float32) for _ in range(150)]
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *rng.standard_normal((150, 64)).astype(np.float32)])]
    frame = spark.createDataFrame(rows, "sid long, vector array<float>").withColumns({"copies": F.lit(1).cast("long"), "dims": F.size("vector")})
    tiles = vectors.packed(frame, 32).collect()
    assert sorted(i for t in tiles for i in np.frombuffer(t["sid"], np.int64)) == list(range(300)) and len({t["no"] for t in tiles}) == len(tiles)
    assert max(len(t["vector"]) for t in tiles) == 32 * 64 * 4
    found = vectors.vector_links(frame, tile_rows=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    counts = {r["sid"]: r["n"] for r in found.groupBy("sid").agg(F.sum("links").alias("n")).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    links = unit @ unit.T >= vectors.COSINE
    want = links.sum(axis=1) - 1
    assert {i: n for i, n in counts.items() if n} == {i: int(n) for i, n in enumerate(want) if n} and want.max() > 30


def test_vectors_that_are_equal(spark):
    v, w, x = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, -0.0, 0.1]
    rows = [(1, v), (1, v), (1, w), (2, [1.0, -0.0, 0.0]), (3, x), (4, w), (None, v)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # an id with two vectors stands for both
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == [
        ("1", 2, 1), ("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("3", 2, 1), ("4", 2, 1), ("None", 0, None)]


AWKWARD = ["a   b  \n\n c's we're 're '' 'r !!'s x\x85y  z \x1c\x1d a\x1fb", "foo <|endoftext|> bar!!<|endoftext|><|endoftext|>x  <|endoftext|>  ",
           "日本語 テスト한국어 é́ １２３ ½   　x", "aaaa'veb 'll 'l 1234567890123 ____---- \t\t\tq", " " * 70 + "x" + "-" * 140 + "\n" * 5, ""]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_prefix_has_the_library_count():
    own, lib, rng = tokencount.PrefixCounter(), library(), random.Random(1)
    alphabet = "ab '\n\tré1!<|>-s tvmld　"
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    for text in texts:
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert own.counts(text).tolist() == want


def test_token_counts_and_prefixes(docs):
    texts = dict(enumerate(AWKWARD)) | {100: None, 101: "word " * 3000}
    lib = library()
    got = by_id(tokencount.token_counts(docs(texts)), "n_bytes", "n_tokens", "fit_chars")
    for i, text in texts.items():
        text = text or ""
        count = len(lib.encode(text, add_special_tokens=False).ids)
        assert got[i][:2] == (len(text.encode()), count)
        assert len(lib.encode(text[:got[i][2]], add_special_tokens=False).ids) <= tokencount.LIMIT
    stored = by_id(tokencount.prefix_counts(docs({1: "hello wide world"})), "prefix_tokens")
    assert stored[1][0] == [len(lib.encode("hello wide world"[:i]).ids) for i in range(1, 17)]


def test_substrings(docs, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(7)]
    base, texts = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(6)], {}
    for i in range(300):
        words = []
        for _ in range(rng.choice([0, 1, 2, 3])):
            b, a = rng.choice(base), rng.randrange(50)
            words += b[a:a + rng.choice([5, 13, 14, 25])] + [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5]))]
        texts[i * 3] = rng.choice([" ", "\n"]).join(words)
    texts |= {7: None, 2: " ".join(["is on"] * 40), 10: " ".join(["on is"] * 30), 1: texts[0]}
    want, columns = plain.substrings(texts), ("n_words", "n_removed", "kept_sha256")
    assert by_id(substrings.dedup_substrings(docs(texts)), *columns) == want
    monkeypatch.setattr(substrings, "HOT_ROWS", 20)
    monkeypatch.setattr(substrings, "SHARD_ROWS", 50)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    assert by_id(substrings.dedup_substrings(docs(texts)), *columns) == want


def test_frequent_anchor_is_not_held_by_one_shard(docs, monkeypatch):
    """Passages of one frequent anchor in ever different contexts: no shard holds the group, and what repeats is found."""
    rng, own = random.Random(9), substrings.Anchored()

    def hash_of(words):
        text = " ".join(words).encode()
        _, _, _, hashes = own.splitter.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return int(substrings.grams(hashes, substrings.ANCHOR)[0])

    phrase = min(([f"p{i}{j}" for j in range(5)] for i in range(500)), key=hash_of)
    again = [f"r{i}" for i in range(8)] + phrase + [f"s{i}" for i in range(8)]
    texts = {i: " ".join([f"x{rng.random()}" for _ in range(8)] + phrase + [f"y{rng.random()}" for _ in range(8)]) for i in range(200)}
    texts |= {300 + i: " ".join(again[i % 3:] + [f"z{i}"] + again[:18]) for i in range(20)} | {400: " ".join(phrase * 30), 401: " ".join(phrase * 12)}
    most, plain_hits = [], substrings.shard_hits

    def watched(rows, window):
        most.append(max([r["count"] for r in rows.groupBy("shard").count().collect()], default=0))
        return plain_hits(rows, window)

    monkeypatch.setattr(substrings, "shard_hits", watched)
    monkeypatch.setattr(substrings, "HOT_ROWS", 20)
    monkeypatch.setattr(substrings, "SHARD_ROWS", 20)
    columns = ("n_words", "n_removed", "kept_sha256")
    assert by_id(substrings.dedup_substrings(docs(texts)), *columns) == plain.substrings(texts)
    assert max(most) <= 100


def test_private_spans(spark, docs, tmp_path):
    rng = random.Random(2)
    parts = ["1", "2", "255", "300", ".", "@", "a", "b%", "-", " ", "+", "(", ")", "4111111111111111", "a@b.c", "é🎉", "\n", "+1 (555) 123-4567", "1.2.3.4", "(at)", "00"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for i in range(400)}
    texts |= {5000: "a@b.co " * 1000, 5001: "a" * 200_000, 5002: "1 " * 50_000, 5004: None, 5005: "(" * 3000 + "+1" + "(" * 3000}
    path = saved(spark, tmp_path, documents=docs(texts))
    found = pii.op8_pii(spark, path)
    got = by_id(found, "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: plain.private(t) for i, t in texts.items()}
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_a_labeler_that_errs_is_trusted_less():
    rows = []
    for votes, count in (((1, 1, 1, 1), 500), ((0, 0, 0, 1), 400), ((0, 0, 0, 0), 300), ((1, 1, 0, 0), 60), ((0, 1, 1, 1), 40)):
        rows.append(dict(zip(pii.LABELERS, votes)) | {"kind": 0, "size": 1, "count": count})
    share, yes, wrong = pii.reliabilities(rows)[0]
    assert 0.2 < share < 0.7 and yes[1] / wrong[1] > yes[3] / wrong[3]
    weights = pii.train_classifier(rows)
    score = [pii.sigmoid(sum(a * b for a, b in zip(weights, pii.features(r)))) for r in rows]
    assert score[0] > 0.8 and score[2] < 0.2 and score[4] > score[1]


def test_notices_in_windows_are_those_of_whole_texts():
    rng, search = random.Random(7), licenses.NoticeSearch()
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            notice = list(rng.choice(licenses.NOTICES)[0] if rng.random() < 0.7 else "some other words here")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(notice))
                notice[at:at + rng.randrange(2)] = rng.choice(["", "x", "e", " ", "mit"])
            parts.append("".join(notice))
        text = " ".join("".join(rng.choice(["", "the ", "x"]) + p + rng.choice(["", "s", " are", "ship is"]) for p in parts).split())
        found = search.find(text)[0]
        assert {m[2] for m in found} == {label for _, label, _, rule in search.notices if rule.search(text)}, text
        for start, end, _, edits, size in found:
            assert edits <= max(1, size // 10) and (not start or " " in text[start - 1:start + 1]) and (end == len(text) or " " in text[end - 1:end + 1])
    assert search.find("mit licensees are")[0] == [] and search.find("the mit licenseship is")[0] == []


def test_many_notices_in_one_text(docs):
    import time

    start = time.process_time()
    found, places = licenses.NoticeSearch().find(" ".join(["mit license"] * 80_000))
    assert len(places) == 80_000 and time.process_time() - start < 60
    text = "Mit\nLicense. " * 20_000
    got = by_id(licenses.license_scan(docs({1: text})), "n_words", "n_base", "first_word", "last_word")
    assert got[1] == (40_000, 20_000, 0, 39_998)


def test_licences(spark, docs, tmp_path):
    texts = {1: "Under the MIT License. mit license!", 2: "The Apache\nLicense and the GNU General-Public License", 3: "mit licens e", 4: None, 5: "",
             6: "released under the genral publc license today", 7: "general public", 8: "permission is hereby granted, free of charge"}
    path = saved(spark, tmp_path, documents=docs(texts))
    got = by_id(licenses.op9_licenses(spark, path), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {i: g[:5] for i, g in got.items()} == {i: plain.licences(t) for i, t in texts.items()}
    assert got[6][5] == "gpl" and 0.8 < got[6][6] < 1 and got[8][5] == "mit" and got[7][5] == "" and got[4][6] == 0.0


def test_quality_held_out():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, "/root/testdata/sf0.01").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(60, 70, n).astype(np.uint8)) for n in (5, 400, 0, 130)]
    x, first = quality.padded(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    labels, net = np.array([1, 0, 1, 0], np.float32), quality.ByteConvNet()

    def loss():
        p = 1 / (1 + np.exp(-((net.pooled(net.chunks(x, first), first) * net.weights).sum(axis=(1, 2)) + net.bias[0])))
        return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    found = net.gradients(x, first, labels)
    for w, g in zip((net.filters, net.weights, net.bias), found):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        w[at] += 1e-2
        up = loss()
        w[at] -= 2e-2
        down = loss()
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.1 * abs(g[at]) + 1e-4


def packed(rows, texts):
    """Assert the round trip and the places; returns the number of sequences."""
    lib, by_doc, sequences = library(), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = lib.encode(text or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part)) and (k == 0 or r["length"] == pack.SEQUENCE)
            at += r["length"]
        assert at == len(ids) and len(by_doc[doc]) == -(-len(ids) // pack.SEQUENCE)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= pack.SEQUENCE
    return len(sequences)


def test_packing(docs):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["the", "cat", "x1", "é"]) for _ in range(rng.choice([0, 10, 300, 900, 1500, 2500, 5000]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "word " * 2047, 503: "<|endoftext|> a"}
    from chirpline.llm.frames import written
    rows = pack.pack(written(pack.token_pieces(docs(texts)), "pieces"), block_items=50).collect()
    least = -(-sum(r["length"] for r in rows) // pack.SEQUENCE)
    assert packed(rows, texts) <= 1.1 * least + 2


def test_breeding_beats_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(600, 760, 1500)
    plain_bins = pack.random_packing(sizes, rng, pack.SEQUENCE, 0.0)
    bred = pack.evolve(sizes, [], rng, pack.SEQUENCE)
    assert np.bincount(bred, sizes).max() <= pack.SEQUENCE and len(np.unique(bred)) <= len(np.unique(plain_bins))


EDGE = {
    "decontaminate": lambda d: decontaminate.matched(d, d.sparkSession.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")),
    "line_dedup": linededup.dedup_lines,
    "near_duplicates": ngramjoin.near_duplicates,
    "token_counts": tokencount.token_counts,
    "substrings": substrings.dedup_substrings,
    "private": pii.find_private,
    "licences": licenses.license_scan,
    "quality": lambda d: quality.quality_scores(d, quality.ByteConvNet()),
    "cut": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(None, None)], "item_id long, text string")),
    "pieces": lambda d: pack.token_pieces(d).filter("piece = 0"),
}


@pytest.mark.parametrize("name", EDGE)
def test_awkward_rows_and_columns(spark, name):
    """Null ids and texts, repeated rows, a very long text and columns with clashing names: one row for each row; none for none."""
    fields = "doc_id long, text string, n_words string, sid long, key long, tid long, length long, piece long, spans string, n long, score string, comp long"
    rest = ("x", 1, None, 3, 4, None, "s", 5, None, 6)
    texts = [(None, "a b c d e f g"), (1, None), (2, ""), (3, "same old line of words here"), (3, "same old line of words here"), (4, "w1 w2 w3"), (5, "long words " * 20_000)]
    full = spark.createDataFrame([(*t, *rest) for t in texts], fields)
    assert EDGE[name](full).count() == len(texts)
    assert EDGE[name](full.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_pipeline(spark):
    """Each stage against its plain version, on what the stage before it kept."""
    import corpus_pipeline
    from chirpline.llm.frames import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    net = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test-pipeline")
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_classifier":
            texts = {i: (t or "").encode() for i, t in kept.items()}
            score = {i: net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for i, t in texts.items()}
            want = {i: t for i, t in kept.items() if score[i] >= quality.THRESHOLD}
        elif name == "line_dedup":
            want = {i: t for i, (n, gone, t) in plain.line_dedup(kept, least=1).items() if not gone or t.strip()}
        elif name == "ngram_jaccard_join":
            want = {i: kept[i] for i, (_, c) in plain.near_groups(kept).items() if c == i}
        else:
            left = plain.contamination(got, items)
            want = got
            assert not any(x[1] for x in left.values())
            assert all(kept[i] == got.get(i) for i, x in plain.contamination(kept, items).items() if not x[1])
        assert got == want
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        kept = got
    packed(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect(), kept)


def test_quality_is_that_of_the_text_alone(monkeypatch):
    """Scores equal a loop over bytes, whatever stands in the rows around and however many blocks are taken at once."""
    rng = np.random.default_rng(1)
    net = quality.ByteConvNet()
    net.filters, net.weights = rng.normal(0, 1, net.filters.shape).astype(np.float32), rng.normal(0, 0.05, net.weights.shape).astype(np.float32)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 7, 118, 119, 120, 121, 128, 130, 240, 250, 256, 300, 700)]
    want = [plain.quality(net, t) for t in texts]
    for span in (1, 3, quality.SPAN):
        monkeypatch.setattr(quality, "SPAN", span)
        for order in (range(len(texts)), rng.permutation(len(texts))):
            own = [texts[i] for i in order]
            got = net.probabilities(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
            assert got == pytest.approx([want[i] for i in order], abs=1e-4)


def test_secrets_are_found(docs):
    """Recall and precision over planted keys, in prose with long words, numbers and addresses."""
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choice(["the", "internationalisation", "donaudampfschifffahrt", "of", "1234567890", "a-long-hyphenated-word-list", "https://x.example/a/b"]) for _ in range(30))
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    forms = [lambda: "token = " + key("0123456789abcdef", 40), lambda: "api_key: AKIA" + key("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 8) + key("0123456789", 8),
             lambda: "Authorization bearer ghp_" + key("abcdefghijkABCDEFGHIJK0123456789", 36)]
    texts, planted = {}, set()
    for i in range(120):
        texts[i] = prose()
        if i % 3 == 0:
            planted.add(i)
            texts[i] += " " + rng.choice(forms)() + "\n" + prose()
    found = {r["doc_id"] for r in pii.find_private(docs(texts)).filter("exists(spans, s -> s.kind = 4)").collect()}
    assert len(found & planted) >= 0.9 * len(planted) and not found - planted
