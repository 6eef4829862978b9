"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

ASCII_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Groups:
    def __init__(self, nodes):
        self.of = {n: n for n in nodes}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def contamination(docs, items, window=10):
    known = collections.defaultdict(set)
    for name, text in items.items():
        words = LETTERS.findall(low(text))
        k = min(window, len(words))
        for i in range(len(words) - k + 1) if words else ():
            known[tuple(words[i:i + k])].add(str(name))
    sizes, out = {len(k) for k in known}, {}
    for doc, text in docs.items():
        words, hit, ids = LETTERS.findall(low(text)), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if found := known.get(tuple(words[i:i + k])):
                    hit.update(range(i, i + k))
                    ids |= found
        out[doc] = (len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


def line_dedup(docs, least=5, above=9, of=10):
    places, first = [], {}
    for doc in sorted(docs):
        for n, line in enumerate(docs[doc].split("\n") if docs[doc] else []):
            words = frozenset(ASCII_SPACE.findall(low(line)))
            places.append((doc, n, words, line))
            if len(words) >= least:
                first.setdefault(words, (doc, n))
    sets = list(first)
    holders, alike = collections.defaultdict(list), set()
    for k, s in enumerate(sets):
        for w in s:
            holders[w].append(k)
    for k, s in enumerate(sets):
        shared = collections.Counter(j for w in s for j in holders[w] if j < k)
        if any(of * v >= above * (len(s) + len(sets[j]) - v) for j, v in shared.items()):
            alike.add(s)
    kept, gone = {d: [] for d in docs}, collections.Counter()
    for doc, n, words, line in places:
        if len(words) >= least and (words in alike or first[words] < (doc, n)):
            gone[doc] += 1
        else:
            kept[doc].append(line)
    return {d: (len(docs[d].split("\n")) if docs[d] else 0, gone[d], "\n".join(kept[d])) for d in docs}


def near_groups(docs, width=5):
    sets = {}
    for doc, text in docs.items():
        w = ASCII_SPACE.findall(low(text))
        sets[doc] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    holders = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    shared, groups = collections.Counter(), Groups(docs)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[(b, a)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {d: (len(sets[d]), groups.find(d)) for d in docs}


def substrings(docs, window=13):
    words = {d: ASCII_SPACE.findall(t or "") for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k:k + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < d:
                gone[k:k + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def private(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    spans = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(out))
    return (*(sum(s[1] == k for s in out) for k in range(4)), sha(spans))


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licences(text):
    words, places = LETTERS.findall(low(text)), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def vectors(rows, cosine=0.95):
    import numpy as np

    count, groups, by_size = {i: 0 for i, _ in rows}, Groups([i for i, _ in rows]), collections.defaultdict(list)
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_size[len(v)].append((i, v))
    for own in by_size.values():
        m = np.array([v for _, v in own], np.float32).astype(float)
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1))):
            x, y = own[a][0], own[b][0]
            count[x] += 1
            count[y] += 1
            groups.join(x, y)
    return {i: (count[i], groups.find(i), groups.find(i) == i) for i, _ in rows}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_variants(counts, factor=10):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def marred_words(docs, every=31, length=7, count=2):
    import zlib

    found = collections.Counter()
    for doc, text in docs.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def pieces(docs, model):
    """With the library itself: number of ids, digests of ids and of the decoded text."""
    out = {}
    for doc, text in docs.items():
        ids = model.encode(text or "", add_eos=True)
        out[doc] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    return out


def alignment(docs, byte_model, byte_of, piece_model):
    """With the libraries themselves. ``byte_of`` gives the byte of each letter of the first vocabulary."""
    tokens, links, groups = {}, {}, {}
    for doc, text in docs.items():
        if not text:
            continue
        a, b = byte_model.encode(" " + text, add_special_tokens=False).ids, piece_model.encode(text)
        spelled_a = [bytes(byte_of[c] for c in byte_model.id_to_token(t)) for t in a]
        names = [piece_model.id_to_piece(t) for t in b]
        spelled_b = [bytes([int(p[3:5], 16)]) if piece_model.is_byte(t) else p.replace("▁", " ").encode() for t, p in zip(b, names)]
        if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            continue
        places = []
        for spelled in (spelled_a, spelled_b):
            ends = [0]
            for s in spelled:
                ends.append(ends[-1] + len(s))
            places.append(list(zip(ends, ends[1:])))
        owner = [j for j, (s, e) in enumerate(places[1]) for _ in range(s, e)]
        tokens[doc] = a, b
        links[doc] = [(a[i], b[j]) for i, (s, e) in enumerate(places[0]) for j in range(owner[s], owner[e - 1] + 1)]
        cuts, at, own = {e for _, e in places[0]} & {e for _, e in places[1]}, 0, []
        for cut in sorted(cuts):
            own.append("|".join(",".join(str(t) for t, (s, _) in zip(ids, spans) if at <= s < cut) for ids, spans in zip((a, b), places)))
            at = cut
        groups[doc] = own
    held = collections.Counter(p for own in links.values() for p in set(own))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    return {doc: (len(tokens[doc][0]), len(tokens[doc][1]), len(groups[doc]), len(links[doc]), sum(held[p] == top[p[0]] for p in links[doc]),
                  sum(held[p] for p in links[doc]), sha(";".join(groups[doc]))) if doc in tokens else (0,) * 6 + ("",) for doc in docs}


def quality(net, text, width=8, step=2, block=128):
    """A network's probability for one byte string, byte by byte."""
    import math

    blocks = max(1, -(-(len(text) + width) // block))
    data = text + bytes(blocks * block + width - len(text))
    features = []
    for c in range(max(1, blocks - 1)):
        ends = min(blocks, c + 2) * block
        best = None
        for p in range(c * block, ends, step):
            response = sum(net.filters[j][data[p + j]].astype(float) for j in range(width))
            best = response if best is None else [max(a, b) for a, b in zip(best, response)]
        features.append([max(0.0, b) for b in best])
    if blocks > 1:
        # the last block is a chunk of its own too
        features.append([max(0.0, max(sum(float(net.filters[j][data[p + j]][f]) for j in range(width)) for p in range((blocks - 1) * block, blocks * block, step)))
                         for f in range(len(features[0]))])
    logit = float(net.bias[0])
    for f in range(len(features[0])):
        own = [x[f] for x in features]
        logit += max(own) * net.weights[0][f] + sum(own) / len(own) * net.weights[1][f] + min(own) * net.weights[2][f]
    return 1 / (1 + math.exp(-logit))
