"""Byte-level merge encoding of many short strings at once, by backtracking over longest matches (``merging``)."""

import json

import numpy as np
import regex

from chirpline.llm.merging import NEVER, BacktrackEncoder
from chirpline.llm.tokencount import SPLIT, byte_letters
from chirpline.llm.units import row_sums, take_rows, tokenizer_path


#: Below this character the split pattern is the same here as in the library.
WIDE = "ɐ"
FAR = regex.compile(f"[^\0-{chr(ord(WIDE) - 1)}]")


class ByteModel:
    """Byte-level merges of a vocabulary file, with the split pattern of the library in front.

    With ``specials`` the special strings of the file are tokens wherever they
    stand complete, as the library has it; without, they are ordinary text.
    """

    def __init__(self, path=None, specials=False):
        from tokenizers import Tokenizer

        self.path = path = tokenizer_path(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: chr(b) for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special if specials else {}
        self.apart = regex.compile(f"({'|'.join(map(regex.escape, self.special))})") if self.special else None
        spell = lambda s: "".join(of[c] for c in s)
        tokens = {spell(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        own = {s: s for s in tokens}  # equal strings are one object, which the model carries once
        ranks = {tuple(own.setdefault(s, s) for s in map(spell, p)): r for r, p in enumerate(pairs)}
        self.encoder = BacktrackEncoder(tokens, lambda a, b: ranks.get((a, b), NEVER))
        self.split, self.library = regex.compile(SPLIT), Tokenizer.from_file(path).pre_tokenizer

    def spelling(self):
        """The bytes of each token."""
        return {i: s.encode("latin-1") for i, s in self.encoder.text_of.items()}

    def parts(self, text):
        if self.apart and self.apart.search(text):
            return [p for part in self.apart.split(text) if part for p in ([part] if part in self.special else self.pieces(part))]
        return self.pieces(text)

    def pieces(self, text):
        if text.isascii() or max(text) < WIDE:
            return self.split.findall(text)
        return [text[s:e] for _, (s, e) in self.library.pre_tokenize_str(text)]

    def encode_units(self, units):
        """Ids of all units in a row, and how many each has."""
        parts, counts, split, joined = [], [1] * len(units), self.split.findall, "\n".join(units)
        plain, narrow = not (self.apart and self.apart.search(joined)), not FAR.search(joined)
        for n, u in enumerate(units):
            # letters, with a space in front or without, are one piece
            if plain and (u.isalpha() or u[:1] == " " and u[1:].isalpha()) and (narrow or u.isascii()):
                parts.append(u)
            else:
                own = split(u) if plain and u.isascii() else self.parts(u)
                parts.extend(own)
                counts[n] = len(own)
        known = dict.fromkeys(parts)
        known = dict(zip(known, range(len(known))))
        named = {i: self.special[p] for p, i in known.items() if p in self.special}
        ids, sizes = self.encoder.encode_all([" " if i in named else p if p.isascii() else p.encode().decode("latin-1") for p, i in known.items()])
        for i, name in named.items():
            ids[int(sizes[:i].sum())] = name
        ids, sizes = take_rows(ids, sizes, np.array(list(map(known.__getitem__, parts)), np.int64))
        return ids, row_sums(sizes, np.concatenate([[0], np.cumsum(counts)]))
