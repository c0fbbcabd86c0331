"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def last(key):
    return (key is None, key or 0)


def exact(rows):
    groups = defaultdict(list)
    for at, (key, text) in enumerate(rows):
        groups[sha(WHITE.sub("", text or ""))].append((-len(text or ""), last(key), at, key))
    out = []
    for digest, members in groups.items():
        best = min(members)
        out += [(key, best[3], len(members), at == best[2], digest) for _, _, at, key in members]
    return out


def near(rows, size=5, least=75):
    sets = []
    for _, text in rows:
        w = spaced(fold(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[root(i)] = min(key, smallest.get(root(i), key))
    return [(key, len(sets[i]), smallest.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def repeats(rows, window=35):
    all_words = [spaced(text) for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, all_words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), kept))
    return out


def lines(rows, least=10):
    def key_of(line):
        return fold(line.strip(" \t\n\x0b\f\r"))

    first = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            first[k] = min(first.get(k, last(key)), last(key))
    out = []
    for key, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if len(key_of(p)) < least or first[key_of(p)] == last(key)]
        out.append((key, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def leaks(rows, items, window=10):
    phrases = defaultdict(set)
    for item, text in items:
        w = lettered(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if size else 0):
            phrases[tuple(w[i : i + size])].add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for key, text in rows:
        w, hit, found = lettered(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                p = tuple(w[i : i + size])
                if p in phrases:
                    hit.update(range(i, i + size))
                    found |= phrases[p]
        out.append((key, len(w), sorted(hit), sorted(found)))
    return out
