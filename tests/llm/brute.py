"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(texts, percent=85):
    """Component number (smallest position) of every text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], sets


def repeated_words(docs, window=20):
    """``docs`` (id, text), no repeated ids: words, removed, digest."""
    first, out = {}, {}
    rows = sorted(docs)
    marks = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in first:
                gone[p : p + window] = [True] * window
            first.setdefault(key, (i, p))
        marks[i] = gone
    for i, t in rows:
        kept = " ".join(x for x, g in zip(words(t), marks[i]) if not g)
        out[i] = (len(marks[i]), sum(marks[i]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(texts, length=400):
    """Mask of the bytes of each text that lie in a string occurring elsewhere too."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask, until = [], 0
        for i in range(len(t)):
            if i + length <= len(t) and seen[t[i : i + length]] > 1:
                until = i + length
            mask.append(i < until)
        masks.append(mask)
    return masks


def base_counts(text):
    w = words(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if triples[(w[i], w[i + 1], w[i + 2])] > 1 for k in (i, i + 1, i + 2)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered)


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source name; nulls last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high, total = 0.0, float(sum(sizes.values())) * 10 + 10, sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap * sizes[s], weight[s] * mid) for s in names) < total:
            low = mid
        else:
            high = mid
    return {s: min(cap * sizes[s], weight[s] * high) for s in names}


def triples(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOW))
    return w


def group(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
