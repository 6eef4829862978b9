"""Fuzzy search for short licence notices.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters
beyond ASCII; a text is searched as its words with one space between. A notice
may have some edits. Split into one piece more than the edits, at least one
piece is untouched in any match, so exact finds of the pieces name the places
to look at, and there the regex library's bounded-error search tells whether
and with how many edits the notice stands.

Places where the words of a base phrase stand one after the other are found by
its first piece and confirmed letter by letter; they always count. The places
to look at end with words, so that what is found in them is what the same
search finds in the whole text.

Defined cases: null or empty texts have no words, no places and score 0; rows
that repeat are judged each; other columns are not looked at.
"""

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.frames import arrow_map, doc_schema, table, texts_of
from chirpline.llm.words import Splitter, letter_words, raw, text_slices

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("mit license", "mit"), ("permission is hereby granted free of charge", "mit"),
    ("apache license", "apache"), ("licensed under the apache license version 2 0", "apache"),
    ("general public license", "gpl"), ("licensed under the gnu general public license", "gpl"),
    ("lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by", "cc"), ("creative commons attribution", "cc"),
    ("mozilla public license", "mpl"),
)


def allowed_edits(notice, letters_per_edit=10):
    return max(1, len(notice) // letters_per_edit)


def notice_rule(notice, edits):
    """A notice as whole words with a bounded number of edits; the fit of what is found first is improved."""
    return regex.compile(rf"(?e)\b(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}\b")


class NoticeSearch:
    """Fuzzy matches of a list of (notice, label) pairs, and exact places of (phrase, label) pairs."""

    def __init__(self, notices=NOTICES, letters_per_edit=10, base=BASE):
        self.notices, self.seeds, self.base = [], {}, base
        for k, (notice, label) in enumerate(notices):
            edits = allowed_edits(notice, letters_per_edit)
            self.notices.append((notice, label, edits, notice_rule(notice, edits)))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                self.seeds.setdefault(notice[a:b], ([], []))[0].append((k, a))
        for k, (phrase, _) in enumerate(base):
            # an untouched phrase holds all its pieces: the first one finds it
            piece = phrase[:len(phrase) // (allowed_edits(phrase, letters_per_edit) + 1)]
            self.seeds.setdefault(piece, ([], []))[1].append(k)

    def find(self, text):
        """Matches (start, end, label, edits, length of the notice) and base places (start, label), in characters of words with one space between."""
        windows, places = {}, []
        for seed, (uses, exact) in self.seeds.items():
            at = text.find(seed)
            while at >= 0:
                for k, a in uses:
                    notice, _, edits, _ = self.notices[k]
                    windows.setdefault(k, []).append((at - a - edits, at - a + len(notice) + edits))
                for k in exact:
                    phrase, label = self.base[k]
                    end = at + len(phrase)
                    if text.startswith(phrase, at) and (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                        places.append((at, label))
                at = text.find(seed, at + 1)
        matches = []
        for k, spans in windows.items():
            notice, label, _, rule = self.notices[k]
            spans.sort()
            joined = []
            for lo, hi in spans:
                # whole words only: a window must not make a border where the text has none
                lo = text.rfind(" ", 0, max(lo, 0)) + 1
                hi = text.find(" ", min(hi, len(text)))
                hi = len(text) if hi < 0 else hi
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            for lo, hi in joined:
                # the library takes no inserted letter at the very place where a search starts
                matches += [(m.start(), m.end(), label, sum(m.fuzzy_counts), len(notice)) for m in rule.finditer(text, max(lo - 1, 0), hi)]
        return sorted(matches), sorted(places)


def license_scan(docs: DataFrame, notices=NOTICES, base=BASE, letters_per_edit: int = 10, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base places, base labels, all labels, matches (words, label, edits) and the best match's score."""
    schema = doc_schema(
        ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"),
        ("labels", "array<string>"), ("matches", "array<struct<first:long,end:long,label:string,edits:int>>"), ("score", "double"),
        id_type=docs.schema[id_col].dataType)

    def make():
        splitter, search = Splitter(letter_words(), True), NoticeSearch(notices, letters_per_edit, base)
        fold = bytearray(bytes(range(256)).lower())
        for b in np.flatnonzero(~letter_words()):
            if not 65 <= b <= 90:
                fold[b] = 32
        fold = bytes(fold)

        def step(batch):
            texts = batch.column("text")
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts):
                first = splitter.split(data, offsets[lo:hi + 1])[2]
                out = {n: [] for n in ("n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score")}
                for row in range(hi - lo):
                    text = b" ".join(data[offsets[lo + row]:offsets[lo + row + 1]].tobytes().translate(fold).split()).decode()
                    found, places = search.find(text)
                    labels = {label for _, label in places}
                    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) if found or places else np.zeros(0, np.int64)
                    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: B023, E731
                    out["n_base"].append(len(places))
                    out["first_word"].append(word(places[0][0]) if places else None)
                    out["last_word"].append(word(places[-1][0]) if places else None)
                    out["base_labels"].append(sorted(labels))
                    out["labels"].append(sorted(labels | {m[2] for m in found}))
                    out["matches"].append([{"first": word(s), "end": word(e) + 1, "label": label, "edits": n} for s, e, label, n, _ in found])
                    out["score"].append(1.0 if places else max((1 - n / size for _, _, _, n, size in found), default=0.0))
                yield {"doc_id": batch.column("doc_id")[lo:hi], "n_words": np.diff(first), **out}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def op9_licenses(spark, sf_dir):
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score", F.size("matches").cast("long").alias("n_matches"))
