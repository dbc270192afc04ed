"""Plain versions of the operators, for small tables."""
from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def substring(rows, size):
    """{id: (n_words, n_removed, kept)} for rows (id, text) with distinct ids."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def shingles(t, size):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(rows, size, percent=80):
    sets = {d: shingles(t, size) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeat_words(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    return len({k for i, g in enumerate(grams) if seen[g] > 1 for k in (i, i + 1, i + 2)})


class KneserNey:
    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            x = [*words(lower(t)), "</s>"]
            self.count.update(x)
            self.pairs.update(zip(["</s>", *x], x))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.before, self.after = Counter(w for _, w in self.pairs), {}
        for (u, _), c in self.pairs.items():
            self.after.setdefault(u, Counter())[min(c, 3)] += 1
        self.d, self.e = self.discounts(self.pairs.values()), self.discounts(self.before.values())

    @staticmethod
    def discounts(counts):
        k = Counter(counts)
        n = [k[i] for i in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0), i + 1) for i in range(3))]

    def low(self, w):
        total = len(self.pairs)
        if not total:
            return 1.0
        rest = sum(self.e[min(c, 3)] for c in self.before.values()) / total
        return max(self.before[w] - self.e[min(self.before[w], 3)], 0) / total + rest / (self.v + 1)

    def p(self, w, u):
        if u not in self.after:
            return self.low(w)
        c = self.pairs[u, w]
        return max(c - self.d[min(c, 3)], 0) / self.count[u] + sum(self.d[k] * n for k, n in self.after[u].items()) / self.count[u] * self.low(w)

    def score(self, t):
        x = [*words(lower(t)), "</s>"]
        return sum(math.log10(self.p(w, u)) for w, u in zip(x, ["</s>", *x]))

    def base(self, t):
        return sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in [*words(lower(t)), "</s>"])


def licences(rows, phrases, templates, least):
    """{id: (n_words, base places, base labels, labels, score)}: every template at every place."""
    alphanumeric = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {d: alphanumeric.findall(lower(t)) for d, t in rows}
    known = {w for _, t, keys in templates for x in (t, *keys) for w in x.split()}
    seen = Counter(w for t in texts.values() for w in set(t) & known)
    weight = {w: math.log((len(texts) + 1) / (seen[w] + 1)) + 0.05 for w in known}
    at = lambda words, phrase: [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    out = {}
    for d, text in texts.items():
        places, base = [], set()
        for phrase, label in phrases.items():
            found = at(text, phrase.split())
            places += found
            base |= {label} if found else set()
        labels, best = set(base), 0.0
        for label, template, keys in templates:
            words_of = template.split()
            for s in range(1 - len(words_of), len(text)):
                held = [w for k, w in enumerate(words_of) if 0 <= s + k < len(text) and text[s + k] == w]
                score = sum(weight[w] for w in held) / sum(weight[w] for w in words_of)
                if len(held) >= 2 and score >= least:
                    span = text[max(s, 0) : s + len(words_of) + 2]
                    if any(at(span, k.split()) for k in keys):
                        labels.add(label)
                        best = max(best, score)
        out[d] = (len(text), sorted(places), sorted(base), sorted(labels), 1.0 if base else min(best, 1.0))
    return out


def leaks(docs, items, template, window, literal, least, share, long_run):
    """{(doc id, item id): covered} by laying every item along every document. template(text): words as (kind, value, own word)."""
    out = {}
    for d, t in docs:
        doc = template(t)
        for i, u in items:
            item = template(u)
            n = min(window, len(item))
            covered, longest = set(), 0
            for apart in range(-len(item), len(doc)):
                own, kinds, same = set(), {}, set()
                for q in range(len(item) - n + 1):
                    if not 0 <= q + apart <= len(doc) - n:
                        continue
                    a, b = item[q : q + n], doc[q + apart : q + apart + n]
                    if [x[2] for x in a] == [x[2] for x in b]:
                        same.update(range(q, q + n))
                    if n >= least and [x[0] for x in a] == [x[0] for x in b] and sum(not x[1] for x in a) >= min(literal, n):
                        kinds |= {q + k: (x[1], y[1]) for k, (x, y) in enumerate(zip(a, b, strict=True))}
                votes = {}
                for theirs, mine in kinds.values():
                    if theirs:
                        votes.setdefault(theirs, Counter())[mine] += 1
                for q, (theirs, mine) in kinds.items():
                    if not theirs or mine == min(votes[theirs], key=lambda v: (-votes[theirs][v], v)):
                        own.add(q)
                good = own | same
                covered |= good
                longest = max([longest, *(sum(1 for _ in _run(good, q)) for q in good)])
            if item and covered and (len(covered) >= share * len(item) or longest >= long_run):
                out[d, i] = len(covered)
    return out


def _run(places, q):
    while q in places:
        yield q
        q += 1
