"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACED.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def near(rows):
    """(n_shingles, component) of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows)]


def repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def contaminated(rows, items, n=10):
    """(words, hit, item ids) of each row."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, who = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                found = windows.get(tuple(w[k : k + m]))
                if found:
                    hit.update(range(k, k + m))
                    who |= found
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def exact(rows):
    """(id, keep, size, sha) of each row with an id of its own."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)


def letters(text):
    s = re.sub(r"[\W\d_]+", " ", (text or "").lower())
    return f" {s.strip()} " if any(map(str.isalpha, s)) else ""


def profile(texts, ranked):
    """The most frequent n-grams, ties by length and code points."""
    c = Counter(s[k : k + n] for s in map(letters, texts) for n in (1, 2, 3) for k in range(len(s) - n + 1))
    del c[" "]
    return sorted(c, key=lambda g: (-c[g], len(g), [ord(x) for x in g]))[:ranked]


def languages(rows, learn, ranked=400):
    """(id, language, score) of each (id, text, lang) row by out-of-place distance to the profiles of the rows in `learn`."""
    by = defaultdict(list)
    for i, text, lang in rows:
        if lang is not None and i in learn and letters(text):
            by[lang].append(text)
    ranks = {lang: {g: r for r, g in enumerate(profile(texts, ranked))} for lang, texts in by.items()}
    out = []
    for i, text, _ in rows:
        own = profile([text], ranked)
        off = {lang: sum(min(abs(p.get(g, 2 * ranked) - r), ranked) for r, g in enumerate(own)) for lang, p in ranks.items()}
        best = min(off, key=lambda x: (off[x], x)) if own and off else None
        out.append((i, best or "und", 1 - off[best] / (ranked * len(own)) if best else 0.0))
    return out


def ngram_scores(rows, learn, order, priors):
    """(tokens, known, training tokens, unigram log10 probability, log10 probability) of each row; levels interpolated with Dirichlet priors."""
    import math

    counts, texts = Counter(), 0
    for i, t in rows:
        if i in learn:
            x = ["<s>", *words(t), "</s>"]
            texts += 1
            for k in range(1, order + 1):
                counts.update((tuple(x[a : a + k])) for a in range(k == 1, len(x) - k + 1))
    follow = Counter()
    for g, c in counts.items():
        if len(g) > 1:
            follow[g[:-1]] += c
    one = [c for g, c in counts.items() if len(g) == 1]
    n, v = sum(one), len(one)
    out = []
    for _, t in rows:
        x = ["<s>", *words(t), "</s>"]
        base = full = 0.0
        for a in range(1, len(x)):
            p = (counts[(x[a],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if a - k + 1 >= 0:
                    ctx = tuple(x[a - k + 1 : a])
                    whole = (texts if ctx == ("<s>",) else counts[ctx]) if k == 2 else follow[ctx]
                    prior = priors[min(k - 1, 2) - 1]
                    p = (counts[(*ctx, x[a])] + prior * p) / (whole + prior)
            full += math.log10(p)
        out.append((len(x) - 1, sum((w,) in counts for w in x[1:]), n, base, full))
    return out


def token_count(word, scores, unknown):
    """Tokens of the best segmentation of a word: of equal scores the one whose last piece is the longest, at every place."""
    best = [(0.0, 0)]
    longest = max(map(len, scores))
    for end in range(1, len(word) + 1):
        ways = [(best[a][0] + scores[word[a:end]], best[a][1] + 1) for a in range(max(0, end - longest), end) if word[a:end] in scores]
        if word[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())))
        top = max(w[0] for w in ways)
        best.append(next(w for w in ways if w[0] == top))
    return best[-1][1]
