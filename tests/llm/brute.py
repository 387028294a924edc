"""The operators again, as slowly and plainly as possible."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

LOWER = {k: k + 32 for k in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(docs):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    parts = components(sets, links)
    return {i: (len(sets[i]), parts[i]) for i in sets}


def repeats(docs):
    """{doc_id: (n_words, kept words)} of {doc_id: text}."""
    texts = {i: spaced(t) for i, t in docs.items()}
    source = {}
    for i in sorted(texts):
        for j in range(len(texts[i]) - 12):
            source.setdefault(tuple(texts[i][j : j + 13]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for j in range(len(w) - 12):
            if source[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        out[i] = (len(w), [x for j, x in enumerate(w) if j not in gone])
    return out


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, item ids sorted as strings)} of {doc_id: text} and [(item_id, text)]."""
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(i)
    lengths = {len(x) for x in windows}
    out = {}
    for i, t in docs.items():
        w, hit, found = alnum(t), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if got := windows.get(tuple(w[j : j + k])):
                    found |= got
                    hit.update(range(j, j + k))
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def mixture(rows, target, block_tokens, seed=7):
    """{doc_id: copies} of [(doc_id, source, text)], ids without repeats."""
    tokens = {i: len(spaced(t)) for i, _, t in rows}
    sources = Counter()
    for i, s, _ in rows:
        sources[s] += tokens[i]
    total = sum(sources.values())
    shares = {s: n / total for s, n in sources.items() if n}

    def entropy(a):
        p = {s: x**a for s, x in shares.items()}
        z = sum(p.values())
        return -sum(x / z * math.log(x / z) for x in p.values())

    want = target * math.log(len(shares)) - 1e-12
    lo, hi = 0.0, 1.0
    if entropy(1.0) >= want:
        lo = 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(mid) >= want else (lo, mid)
    a = round(lo, 6)
    z = sum(x**a for x in shares.values())
    mark = lambda *x: md5("-".join(map(str, (seed, *x))).encode()).hexdigest()
    copies = {}
    for s, n in sources.items():
        own = [i for i, source, _ in rows if source == s]
        if not n:
            copies |= dict.fromkeys(own, 0)
            continue
        wanted = math.floor(round(shares[s] ** a / z, 9) * total)
        passes, rest = divmod(wanted, n)
        n_blocks = max(1, -(-n // block_tokens))
        blocks = defaultdict(list)
        for i in own:
            blocks[int(mark(i, s)[:8], 16) % n_blocks].append(i)
        copies |= dict.fromkeys(own, passes)
        room = rest
        for b in sorted(blocks, key=lambda b: (mark(s, b), b)):
            size = sum(tokens[i] for i in blocks[b])
            if room >= size and room > 0:
                for i in blocks[b]:
                    copies[i] += 1
            elif room > 0:
                read = 0
                for i in sorted(blocks[b], key=lambda i: mark(i, s)):
                    read += tokens[i]
                    copies[i] += read <= room
            room -= size
    return a, copies
