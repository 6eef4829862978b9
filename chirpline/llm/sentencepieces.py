"""Exact encoding and decoding with a merge-type piece model.

Spaces become U+2581 and one is put in front of a text. Two neighbours merge if
the pieces of the model hold both joined; the better score goes first. A
character that no merge takes in and that is no piece becomes its bytes.
``merging`` finds the pieces by backtracking over Aho-Corasick matches.

No piece of such a model goes on behind a letter into a U+2581, so a text may
be cut before each run of spaces, and around line feeds where no longer piece
holds one; the model is asked for both, and a text is one unit if it says
otherwise. A unit's ids are found once and remembered, a bounded number in
each worker process.

Decoding joins pieces, takes runs of byte pieces as UTF-8 (each byte that is
none becomes U+FFFD), U+2581 as space, control pieces as nothing, the unknown
piece as its surface, and drops the space put in front.

Defined cases: null texts are empty and have only the end id; an id array that
is null decodes to null, and null ids in it to nothing; texts of any length;
rows that repeat are each encoded; further columns are not looked at; no rows
give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.frames import arrow_map, doc_schema, lists, table, texts_of
from chirpline.llm.merging import NEVER, BacktrackEncoder
from chirpline.llm.units import Cutter, Recent, kept_in_process, row_sums, take_rows
from chirpline.llm.words import text_slices

DEFAULT_FILE = "piece_bpe_32k.model"
REMEMBERED = 300_000
#: Bytes of texts that are encoded at once.
SLICE = 1 << 22
SPACE, LINE, MARK = " ", "\n", "▁"
UNKNOWN_SURFACE = " ⁇ "
CONTROL, WORD, BYTE = 0, 1, 2


def model_path(path=None):
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class PieceModel:
    """Pieces, scores and kinds of a model file, with an own encoder and decoder."""

    def __init__(self, path=None, remembered=REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path(path))
        if model.normalize(" a  bÅﬁ\n") != "▁▁a▁▁bÅﬁ\n":
            raise ValueError("only models that keep texts as they are and put a space in front")
        pieces = [model.id_to_piece(i) for i in range(model.piece_size())]
        kind = [BYTE if model.is_byte(i) else CONTROL if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else WORD
                for i in range(len(pieces))]
        self.pieces = {p: i for i, p in enumerate(pieces) if kind[i] == WORD}
        self.end, self.byte_ids = model.eos_id(), {int(p[3:5], 16): i for i, p in enumerate(pieces) if kind[i] == BYTE}
        if len(self.byte_ids) != 256 or self.end < 0:
            raise ValueError("only models with byte pieces and an end piece")
        scores, NONE = {p: -model.get_score(i) for p, i in self.pieces.items()}, NEVER
        self.encoder = BacktrackEncoder(self.pieces, lambda a, b: scores.get(a + b, NONE))
        self.cutter = self.cutter_of(self.pieces)
        self.kind = np.array(kind, np.int8)
        surface = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, SPACE).encode() if k == WORD else b"" for p, k in zip(pieces, kind)]
        surface[model.unk_id()] = UNKNOWN_SURFACE.encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.memory = Recent(remembered)

    @staticmethod
    def cutter_of(pieces):
        """Cuts texts into parts that encode apart from each other."""
        long = [p for p in pieces if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            return Cutter("")
        return Cutter(SPACE, MARK, "" if any(LINE in p for p in long) else LINE)

    def encode_units(self, units):
        """Ids of strings whose spaces are marked, and how many each has."""
        ids, counts = self.encoder.encode_all(units)
        bare = np.flatnonzero(ids >= self.encoder.virtual)
        if len(bare):
            parts = [[self.byte_ids[b] for b in chr(c).encode()] for c in (ids[bare] - self.encoder.virtual).tolist()]
            more = np.ones(len(ids), np.int64)
            more[bare] = [len(p) for p in parts]
            unit = np.repeat(np.repeat(np.arange(len(units)), counts), more)
            is_bare = np.repeat(ids >= self.encoder.virtual, more)
            ids = np.repeat(ids, more)
            ids[is_bare] = np.concatenate(parts)
            counts = np.bincount(unit, minlength=len(units))
        return ids.astype(np.int32), counts

    def ids(self, texts):
        """Ids of an Arrow column of texts with the end id, and how many each row has."""
        unit, first, distinct = self.cutter.units(texts)
        found = self.memory.values(distinct, self.encoded)
        ids, sizes = take_rows(np.frombuffer(b"".join(found), np.int32), np.array([len(f) // 4 for f in found], np.int64), unit)
        counts = row_sums(sizes, first)
        return np.insert(ids, np.cumsum(counts), self.end), counts + 1

    def encoded(self, units):
        ids, counts = self.encode_units([u.replace(SPACE, MARK) for u in units])
        data, at = ids.tobytes(), [0, *np.cumsum(4 * counts).tolist()]
        return [data[x:y] for x, y in zip(at, at[1:])]

    def text_bytes(self, ids, first):
        """UTF-8 of the decoded rows of ids, and their sizes. ``first`` holds the first place of each row and the end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.surface[np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]
        at = np.concatenate([[0], ends])[first]
        kind = self.kind[ids]
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        lead = np.full(len(first) - 1, CONTROL)
        shown = np.flatnonzero(sizes > 0)[::-1]
        lead[rows[shown]] = kind[shown]
        # Bytes of two byte pieces must not become a letter across a piece that shows nothing.
        split = np.zeros(len(first) - 1, bool)
        gap = np.flatnonzero((kind[1:] == BYTE) & (sizes[:-1] == 0)) + 1
        split[rows[gap]] = True
        texts = []
        for r in range(len(first) - 1):
            data = out[at[r]:at[r + 1]].tobytes()
            if split[r] or not readable(data):
                data = self.repaired(ids[first[r]:first[r + 1]])
            texts.append(data[1:] if lead[r] == WORD and data[:1] == b" " else data)
        return texts

    def repaired(self, ids):
        """Bytes of one row in which bytes that are no UTF-8 become U+FFFD; runs of byte pieces are read on their own."""
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.surface[self.starts[i]])
                continue
            out.append(fixed(run))
            run = bytearray()
            out.append(self.surface[self.starts[i]:self.starts[i + 1]].tobytes())
        return b"".join([*out, fixed(run)])


def readable(data):
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def fixed(run):
    """A run of bytes with U+FFFD for each that belongs to no letter."""
    run, out, i = bytes(run), [], 0
    while i < len(run):
        size = 2 if run[i] >> 5 == 6 else 3 if run[i] >> 4 == 14 else 4 if run[i] >> 3 == 30 else 1
        part = run[i:i + size]
        if not readable(part):
            part, size = "�".encode(), 1
        out.append(part)
        i += size
    return b"".join(out)


def piece_model(path):
    return kept_in_process(("piece model", path), lambda: PieceModel(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (with the end id) of every text; with ``decoded`` also the text that these ids decode to."""
    schema = doc_schema(("ids", "array<int>"), *([("decoded", "string")] if decoded else []), id_type=docs.schema[id_col].dataType)

    def make():
        model = piece_model(path)

        def step(batch):
            texts = batch.column("text")
            for lo, hi in text_slices(texts, SLICE):
                ids, counts = model.ids(texts[lo:hi])
                out = {"doc_id": batch.column("doc_id")[lo:hi], "ids": lists(ids, counts, pa.int32())}
                if decoded:
                    out["decoded"] = pa.array(model.text_bytes(ids, np.concatenate([[0], np.cumsum(counts)])), pa.binary()).cast(pa.string())
                yield out

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def decode(frame: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every array of ids."""
    schema = doc_schema(("text", "string"), id_type=frame.schema[id_col].dataType)

    def make():
        model = piece_model(path)

        def step(batch):
            column = batch.column("ids")
            ids = np.asarray(column.flatten(), np.int64)
            counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(model.sizes)):
                raise ValueError("ids beyond the model's pieces")
            found = model.text_bytes(ids, np.concatenate([[0], np.cumsum(counts)]))
            yield {"doc_id": batch.column("doc_id"),
                   "text": pa.array([f if x.is_valid else None for f, x in zip(found, column)], pa.binary()).cast(pa.string())}

        return step

    rows = frame.select(F.col(id_col).alias("doc_id"), F.filter(F.col(ids_col), lambda x: x.isNotNull()).cast("array<int>").alias("ids"))
    return arrow_map(rows, make, schema)


def op12_sentencepiece(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents"), decoded=True)
    as_text = F.array_join(F.col("ids").cast(T.ArrayType(T.StringType())), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(as_text, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
