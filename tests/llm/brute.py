"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=0, n=60, vocabulary=400):
    """Documents with exact and near copies, shared passages, repeated lines, odd characters, empties and nulls."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢XYZ,.") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t ", " "]) for _ in range(k))
    passage, base, line = text(70), text(150), "All rights reserved worldwide."
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2:
            t = text(rng.randrange(5, 60)) + passage + text(rng.randrange(0, 60))
        elif kind < 0.4:
            w = base.split(" ")
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind < 0.5:
            t = base
        elif kind < 0.6:
            t = line + "\n" + text(rng.randrange(20, 80))
        else:
            t = text(rng.choice([1, 3, 4, 5, 30, 120, 300]))
        out.append(t)
    out += [None, "", " \n\t", "one", "a b c d e", "a b c d e", "A b C d e"]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


def remove_repeats(docs, window):
    seen, out = {}, {}
    for d, t in sorted(docs):
        w = SPACE.findall(t or "")
        own = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = [False] * len(w)
        for i, k in enumerate(own):
            if seen.get(k, d) < d:
                gone[i : i + window] = [True] * window
        for k in own:
            seen.setdefault(k, d)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def shingles(text):
    w = SPACE.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def contamination(docs, items, window=10):
    table = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            table[tuple(w[k : k + n])].add(i)
    sizes, out = {len(k) for k in table}, {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(AZ))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := table.get(tuple(w[k : k + n])):
                    found |= got
                    hit[k : k + n] = [True] * n
        out[d] = (len(w), sum(hit), sorted(map(str, found)))
    return out


def quality(text):
    t = text or ""
    w, seen, dup = SPACE.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    r = sum(again)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, len(w) < 10 or 100 * r > 20 * len(w)


def lines(docs, min_sites, min_words=3, max_share=0.5):
    """docs: (id, text, site)."""
    size = lambda x: len(SPACE.findall(x))

    def on_sites(wanted, kept):
        sites = defaultdict(set)
        for _, t, s in docs:
            for line in (t or "").split("\n"):
                if size(line) >= min_words and s is not None and wanted(line) and kept(t):
                    sites[line].add(s)
        return {k for k, v in sites.items() if len(v) >= min_sites}

    spread = on_sites(lambda _: True, lambda _: True)
    own = lambda t: sum(size(x) for x in t.split("\n") if x in spread) <= max_share * size(t)
    boilerplate = on_sites(lambda x: x in spread, own)
    out = {}
    for d, t, _ in docs:
        if t is None:
            out[d] = (0, 0, None)
            continue
        ls = t.split("\n")
        kept = [x for x in ls if x not in boilerplate]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out
