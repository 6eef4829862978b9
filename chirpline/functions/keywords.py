"""Large keyword lists: which keyword of a list a word hits first, by an automaton and a table of endings."""

from bisect import bisect_left

import ahocorasick
import numpy as np

LAST = "\U0010ffff"


class KeywordIndex:
    """A word hits a keyword that it holds or that holds it.

    The keywords a word holds are found by an Aho-Corasick automaton. Those that
    hold it have an ending that starts with the word; all endings of all
    keywords are kept in order, so these lie side by side.
    """

    def __init__(self, keywords):
        self.keywords = list(dict.fromkeys(keywords))
        self.held = ahocorasick.Automaton()
        for i, k in enumerate(self.keywords):
            self.held.add_word(k, i)
        if self.keywords:
            self.held.make_automaton()
        endings = sorted((k[j:], i) for i, k in enumerate(self.keywords) for j in range(len(k)))
        self.endings, self.owner = [e for e, _ in endings], np.array([i for _, i in endings], np.int64)

    def first(self, word: str) -> int:
        """Place of the first keyword hit, or -1."""
        if not word or not self.keywords:
            return -1
        found = [i for _, i in self.held.iter(word)]
        lo = bisect_left(self.endings, word)
        hi = bisect_left(self.endings, word + LAST, lo)
        if hi > lo:
            found.append(int(self.owner[lo:hi].min()))
        return min(found, default=-1)

    def firsts(self, words) -> np.ndarray:
        return np.array([self.first(w) for w in words], np.int64)
