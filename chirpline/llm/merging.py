"""Exact encoding by merges without merging texts: backtracking over longest matches.

A merge-type tokenizer joins the neighbours of best rank, the leftmost of
equals, until none is left. Merges inside a stretch do not depend on what is
around it, so a row of tokens is the encoding exactly if every token comes out
of its own symbols and no two neighbours would merge across their border.
Each rest of a text therefore has one encoding at most, and a position before
which no token fits can be marked as failed for good.

``BacktrackEncoder`` finds the longest token that ends at each place with an
Aho-Corasick automaton and goes from the end to the front: on with the longest
that fits the token behind it and does not start at a failed position, to
shorter ones after it, and back where none does. Many short strings take
their steps together, as arrays; a long one goes alone.
"""

import numpy as np

NEVER = float("inf")
MOST_PAIRS = 1_000_000
#: Bits of a token or symbol number, strings from how many symbols on go alone, and slots of the table of judged pairs.
BITS, LONG, SLOT_BITS = 22, 2_000, 20


class TokenAutomaton:
    """Aho-Corasick automaton that gives the longest token ending at each place; ``shorter`` leads on to its suffixes."""

    def __init__(self, tokens):
        moves, depth = {}, [0]
        node_of = {}
        for text, token in tokens.items():
            node = 0
            for c in text:
                key = node << BITS | ord(c)
                node = moves.get(key)
                if node is None:
                    node = moves[key] = len(depth)
                    depth.append(depth[key >> BITS] + 1)
            node_of[token] = node
        self.moves, self.fail = moves, [0] * len(depth)
        for key in sorted(moves, key=lambda k: depth[moves[k]]):
            at, symbol = key >> BITS, key & (1 << BITS) - 1
            if at:
                self.fail[moves[key]] = self.step(self.fail[at], symbol)
        own = {node: token for token, node in node_of.items()}
        self.token = [-1] * len(depth)
        for node in sorted(range(len(depth)), key=depth.__getitem__):
            self.token[node] = own.get(node, self.token[self.fail[node]])
        self.shorter = {token: self.token[self.fail[node]] for token, node in node_of.items()}
        self.fails, self.tokens = np.array(self.fail, np.int32), np.array(self.token, np.int32)
        self.hash_moves()

    def hash_moves(self):
        """The moves as a table of hashed keys, at most half full; a key whose slot is taken stands in the next free one."""
        self.slot_bits = max(4, (2 * len(self.moves)).bit_length())
        keys, to = (np.fromiter(x, np.int64, len(self.moves)) for x in (self.moves.keys(), self.moves.values()))
        self.keys, self.to = np.full(1 << self.slot_bits, -1, np.int64), np.zeros(1 << self.slot_bits, np.int32)
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & len(self.keys) - 1
        self.to[at] = to

    def slots(self, keys):
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def __getstate__(self):
        return vars(self) | {"moves": None, "fail": None, "token": None}

    def drop_plain(self):
        """Plain values go until single steps need them."""
        self.moves = self.fail = self.token = None

    def for_single_steps(self):
        """Moves, failure links and tokens as plain values; they do not travel with the automaton."""
        if self.moves is None:
            held = self.keys >= 0
            self.moves = dict(zip(self.keys[held].tolist(), self.to[held].tolist()))
            self.fail, self.token = self.fails.tolist(), self.tokens.tolist()

    def step(self, node, symbol):
        while True:
            to = self.moves.get(node << BITS | symbol)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def steps(self, nodes, symbols):
        """``step`` for arrays."""
        out, left, nodes = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), nodes.copy()
        while len(left):
            key = nodes[left] << BITS | symbols[left]
            at = self.slots(key)
            held = self.keys[at]
            astray = np.flatnonzero((held != key) & (held >= 0))
            while len(astray):
                at[astray] = at[astray] + 1 & len(self.keys) - 1
                held[astray] = now = self.keys[at[astray]]
                astray = astray[(now != key[astray]) & (now >= 0)]
            hit = held == key
            out[left[hit]] = self.to[at[hit]]
            left = left[~hit & (nodes[left] > 0)]
            nodes[left] = self.fails[nodes[left]]
        return out


def judged_pairs():
    """An empty table of pairs and whether they fit."""
    return np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)


class BacktrackEncoder:
    """Encodes strings of symbols under tokens (string -> id) and ``rank(left, right)``, lower first, NEVER for no merge.

    A symbol that is no token gets the number ``virtual + ord(symbol)``.
    """

    most_pairs = MOST_PAIRS

    def __init__(self, tokens: dict[str, int], rank):
        self.rank, self.virtual = rank, max(tokens.values(), default=0) + 1
        self.text_of = {i: s for s, i in tokens.items()}
        self.automaton = TokenAutomaton(tokens)
        self.shorter = np.full(self.virtual, -1, np.int64)
        self.sizes = np.ones(self.virtual, np.int64)
        for s, i in tokens.items():
            self.shorter[i], self.sizes[i] = self.automaton.shorter[i], len(s)
        self.single = {ord(s): i for s, i in tokens.items() if len(s) == 1}
        self.forget()

    def forget(self, table=None):
        """Start anew with what is judged and traced; ``table`` is a table of judged pairs to go on with."""
        self.traces, self.fitting = {}, {}
        self.pairs, self.judged = table or judged_pairs()

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("traces", "fitting", "pairs", "judged")}

    def text(self, token):
        return self.text_of.get(token) or chr(token - self.virtual)

    def trace(self, token):
        """The merges of a token's symbols: rank, first and last part after each; then a row of rank NEVER. And the number of parts left."""
        found = self.traces.get(token)
        if found is None:
            parts, steps = list(self.text(token)), []
            while len(parts) > 1:
                best, i = min((self.rank(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                steps.append((best, parts[0], parts[-1]))
            steps.append((NEVER, parts[0], parts[-1]))
            found = self.traces[token] = steps, len(parts)
        return found

    def fits(self, token, after):
        """Whether a token is whole and stays apart from the one behind it (-1 for none), by merging both sides again."""
        left, parts = self.trace(token)
        known = parts == 1
        if known and after >= 0:
            right, i, j = self.trace(after)[0], 0, 0
            x, y = self.text(token)[-1], self.text(after)[0]
            while True:
                across, one, two = self.rank(x, y), left[i][0], right[j][0]
                if across < one and across <= two:
                    known = False
                    break
                if one == two == NEVER:
                    break
                if one <= two:
                    x, i = left[i][2], i + 1
                else:
                    y, j = right[j][1], j + 1
        if len(self.fitting) > self.most_pairs:
            self.fitting.clear()
        self.fitting[after << BITS | token] = known
        return known

    def encode(self, symbols):
        """Token numbers of a string, by single steps."""
        longest, node = [], 0
        self.automaton.for_single_steps()
        for c in map(ord, symbols):
            node = self.automaton.step(node, c)
            longest.append(self.automaton.token[node] if c in self.single or self.automaton.token[node] >= 0 else self.virtual + c)
        n, known = len(symbols), self.fitting
        failed, came, pos, after = bytearray(n + 1), [-1] * (n + 1), n, -1
        token = longest[n - 1] if n else -1
        while pos:
            while token >= 0:
                start = pos - (int(self.sizes[token]) if token < self.virtual else 1)
                if not failed[start]:
                    fit = known.get(after << BITS | token)
                    if self.fits(token, after) if fit is None else fit:
                        break
                token = self.next_shorter(token, symbols[pos - 1])
            else:
                if pos == n:
                    raise ValueError("no row of tokens gives this text")
                failed[pos] = 1
                token = after
                pos += int(self.sizes[token]) if token < self.virtual else 1
                after = came[pos]
                token = self.next_shorter(token, symbols[pos - 1])
                continue
            came[start], pos, after = token, start, token
            token = longest[pos - 1] if pos else -1
        out = []
        while pos < n:
            out.append(came[pos])
            pos += int(self.sizes[came[pos]]) if came[pos] < self.virtual else 1
        return out

    def next_shorter(self, token, last):
        """The longest token that is a proper suffix; a symbol that is no token comes last."""
        if token >= self.virtual:
            return -1
        found = int(self.shorter[token])
        return self.virtual + ord(last) if found < 0 and self.sizes[token] > 1 and ord(last) not in self.single else found

    def fit_all(self, token, after):
        """``fits`` for arrays of tokens."""
        code = after << BITS | token
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        strange = np.flatnonzero(self.pairs[slot] != code)
        out = self.judged[slot]
        if len(strange):
            known, own = self.fitting, []
            for c, t, a in zip(code[strange].tolist(), token[strange].tolist(), after[strange].tolist()):
                fit = known.get(c)
                own.append(self.fits(t, a) if fit is None else fit)
            out[strange] = own
            self.pairs[slot[strange]], self.judged[slot[strange]] = code[strange], out[strange]
        return out

    def encode_all(self, strings):
        """Token numbers of non-empty strings in a row, and how many each has."""
        sizes = np.array([len(s) for s in strings], np.int64)
        if not len(sizes) or sizes.max() <= LONG:
            return self.encode_short(strings, sizes)
        short = np.flatnonzero(sizes <= LONG)
        counts, parts = np.zeros(len(strings), np.int64), [None] * len(strings)
        ids, counts[short] = self.encode_short([strings[i] for i in short], sizes[short])
        for i, own in zip(short, np.split(ids, np.cumsum(counts[short])[:-1])):
            parts[i] = own
        for i in np.flatnonzero(sizes > LONG):
            parts[i] = np.array(self.encode(strings[i]), np.int64)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts

    def encode_short(self, strings, sizes):
        if not len(sizes):
            return np.zeros(0, np.int64), sizes
        n, many = int(sizes.sum()), len(strings)
        stop = np.cumsum(sizes)
        begin = stop - sizes
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        bare = ~np.isin(codes, np.array(list(self.single), np.int64))
        order = np.argsort(-sizes, kind="stable")
        reach = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")
        longest, nodes = np.empty(n, np.int64), np.zeros(many, np.int64)
        for j, m in enumerate(reach.tolist()):
            at = begin[order[:m]] + j
            nodes = self.automaton.steps(nodes[:m], codes[at])
            longest[at] = self.automaton.tokens[nodes]
        longest = np.where(bare & (longest < 0), self.virtual + codes, longest)
        # Borders are numbered by the place of the next symbol plus the string's number, so that no two strings share one.
        shift = np.arange(many)
        came, failed = np.full(n + many, -1, np.int64), np.zeros(n + many, bool)
        pos, after, token, active = stop.copy(), np.full(many, -1, np.int64), longest[stop - 1], np.arange(many)
        while len(active):
            t = token[active]
            back, ahead = active[t < 0], active[t >= 0]
            if len(back):
                if (pos[back] == stop[back]).any():
                    raise ValueError("no row of tokens gives this text")
                failed[pos[back] + shift[back]] = True
                last = after[back]
                pos[back] += self.size_of(last)
                after[back] = came[pos[back] + shift[back]]
                token[back] = self.shorter_of(last, codes[pos[back] - 1], bare[pos[back] - 1])
            t = token[ahead]
            start = pos[ahead] - self.size_of(t)
            fit = ~failed[start + shift[ahead]]
            go = np.flatnonzero(fit)
            fit[go] = self.fit_all(t[go], after[ahead[go]])
            who = ahead[~fit]
            token[who] = self.shorter_of(token[who], codes[pos[who] - 1], bare[pos[who] - 1])
            who, start, t = ahead[fit], start[fit], t[fit]
            came[start + shift[who]], pos[who], after[who] = t, start, t
            on = start > begin[who]
            token[who[on]] = longest[start[on] - 1]
            if not on.all():
                active = active[pos[active] > begin[active]]
        used, at, own = np.zeros(n + many, bool), begin + shift, np.arange(many)
        while len(at):
            used[at] = True
            at = at + self.size_of(came[at])
            on = at < stop[own] + own
            at, own = at[on], own[on]
        path = np.flatnonzero(used)
        return came[path], np.bincount(np.searchsorted(begin + shift, path, "right") - 1, minlength=many)

    def size_of(self, tokens):
        return np.where(tokens < self.virtual, self.sizes[np.minimum(tokens, self.virtual - 1)], 1)

    def shorter_of(self, tokens, last, bare):
        """``next_shorter`` for arrays, with the symbols they end with and whether those are no tokens."""
        own = tokens < self.virtual
        at = np.minimum(tokens, self.virtual - 1)
        found = np.where(own, self.shorter[at], -1)
        return np.where(own & (found < 0) & bare & (self.sizes[at] > 1), self.virtual + last, found)
