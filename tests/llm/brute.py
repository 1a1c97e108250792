"""Plain versions of what the operators compute, for small inputs."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def bag(text, k=5):
    w = words(text)
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def probability_jaccard(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[q] / x[d], y[q] / y[d]) for q in keys) for d in x if d in y)


def classes(docs, least=0.8):
    """doc_id -> least id of its class, linking texts from ``least`` on; empty texts alone."""
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    bags = {i: bag(t) for i, t in docs}
    holders = collections.defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    for i, b in bags.items():
        for j in set().union(*(holders[s] for s in b)) if b else ():
            if j > i and find(i) != find(j):
                y = bags[j]
                common = len(b.keys() & y.keys())
                if max(b.values()) == max(y.values()) == 1:
                    s = common / (len(b) + len(y) - common)
                else:
                    s = probability_jaccard(b, y)
                if s >= least:
                    a, c = sorted((find(i), find(j)))
                    parent[c] = a
    return {i: find(i) for i in parent}
