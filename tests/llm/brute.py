"""The operators again, in plain Python over lists: slow, short and independent of Spark."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeat_words(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    return len({i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)})


def line_dedup(docs, min_chars=10):
    """docs: (id, text) with ids; [(id, n_lines, n_dropped, kept text)]."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(math.inf if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        i2 = math.inf if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) < i2)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, k):
    """The set of runs of k words (A-Z folded); a shorter text is one, an empty one has none and equals only empty ones."""
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def groups(n, linked):
    """Smallest index of each item's component."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: size}. Water-filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, free = sum(sizes.values()), {}, set(order)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= cap * sizes[s]}
        if not over:
            return full | {s: left * w[s] / total for s in free}
        for s in over:
            full[s] = cap * sizes[s]
        left -= sum(full[s] for s in over)
        free -= over
    return full


def mixing(rows):
    """rows: (id, source, size) -> [(id, source, size, copies)], by fair queueing over three epochs."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    queue = []
    for k, s in enumerate(order):
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for i, x, n in rows if x == s)
        run = 0
        for key, n, i in own:
            run += n
            queue += [((e * sizes[s] + run) / goal[s], k, e, key, run, i, s, n) for e in range(3) if goal[s]]
    queue.sort(key=lambda x: x[:5])
    total, taken = 0, Counter()
    for x in queue:
        total += x[7]
        if total > sum(sizes.values()):
            break
        taken[x[5], x[6], x[7], x[4]] += 1
    out = []
    for s in order:
        run = 0
        for key, n, i in sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for i, x, n in rows if x == s):
            run += n
            out.append((i, s, n, taken[i, s, n, run]))
    return out


def bm25(docs, queries, k=10, k1=1.2, b=0.75):
    """{query: [(doc, score)]}: every document scored against every query."""
    low = lambda t: (t or "").encode().lower().split()
    tf = [(i, Counter(low(t))) for i, t in docs]
    df = Counter(w for _, c in tf for w in c)
    mean = sum(sum(c.values()) for _, c in tf) / len(tf)
    out = {}
    for q, t in queries:
        scores = []
        for i, c in tf:
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            s = sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + norm) for w in set(low(t)) if w in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out
