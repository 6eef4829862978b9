"""Generalised suffix automaton over integer symbols, and matching statistics of a stream against it."""


class SuffixAutomaton:
    """All runs of symbols of several sequences.

    State 0 is the root. ``length[s]`` is the longest run that ends in state s,
    ``link[s]`` the state of its longest suffix that ends in other places too.
    """

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _new(self, length, moves, link):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p, symbol, q):
        """A state for the runs that reach q from p, when q also holds longer ones."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence):
        """Add a sequence; returns the state of each of its prefixes."""
        last, ends = 0, []
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
            else:
                made = self._new(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = made
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                last = made
            ends.append(last)
        return ends

    def walk(self, sequence):
        """The stream's matching statistics: after each symbol, the state and the length of the longest known suffix."""
        moves, link, longest = self.next, self.link, self.length
        state = size = 0
        for symbol in sequence:
            to = moves[state].get(symbol)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = moves[state].get(symbol)
                if to is None:
                    size = 0
                    yield 0, 0
                    continue
                size = longest[state]
            state = to
            size += 1
            yield state, size

    def by_length(self):
        """States from the shortest to the longest, so that links come first."""
        return sorted(range(len(self.length)), key=self.length.__getitem__)

    def at_depth(self, state, depth):
        """The state of the suffix of that many symbols of what ended in ``state``."""
        while state and self.length[self.link[state]] >= depth:
            state = self.link[state]
        return state
