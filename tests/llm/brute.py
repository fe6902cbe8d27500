"""Plain versions of the operators, row by row, to test against."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=True):
    return WORD.findall((text or "").translate(UPPER) if lower else (text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def dedup_lines(rows, boundary=3, limit=50):
    """doc_id -> (lines with a word, removed, text), by listing every candidate run."""
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
        return signed(seed)

    units, runs = {}, {}
    for i, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        units[i] = [(k, line, len(WORD.findall(line))) for k, line in enumerate(lines) if WORD.search(line)]
        own, u = set(), units[i]
        h = [signed(xxhash.xxh64(line.encode(), seed=42).intdigest()) for _, line, _ in u]
        w = [n for *_, n in u]
        cuts = [k for k in range(len(u)) if k == 0 or chained([h[k - 1], h[k]]) % boundary == 0 or w[k] > limit or w[k - 1] > limit]
        own |= {(a, b) for a, b in zip(cuts, [*cuts[1:], len(u)]) if b - a > 1}
        for k in range(len(u)):
            for step, make in ((1, lambda e: (k, e + 1)), (-1, lambda e: (e, k + 1))):
                total, e = 0, k
                while 0 <= e < len(u):
                    total += w[e]
                    if total > limit:
                        own.add(make(e))
                        break
                    e += step
        for a, b in own:
            runs.setdefault(tuple(line for _, line, _ in u[a:b]), []).append((i, a, b))
    gone = {}
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    out = {}
    for i, text in rows:
        if text is None:
            out[i] = (0, 0, None)
            continue
        lost = {units[i][k][0] for k in gone.get(i, ())}
        lines = text.split("\n")
        left = "\n".join(line for k, line in enumerate(lines) if k not in lost) if len(lost) < len(units[i]) or not lost else ""
        out[i] = (len(units[i]), len(lost), left)
    return out


def leaks(docs, items, share=0.75):
    return {
        (i, j, len(b), len(a & b))
        for i, t in docs for j, q in items
        for a, b in [(shingles(t, min(5, len(words(q)))) if 0 < len(words(q)) < 5 else shingles(t), shingles(q))]
        if b and len(a & b) >= share * len(b)
    }


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    w = words(text, lower=False)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def search(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item; rows
    with equal item id are one item."""
    from collections import Counter
    from math import floor, log

    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, all_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // all_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def tree(text):
    """(root, pieces as {hash: length}) by the definition of the Merkle tree."""
    import hashlib

    import regex
    import xxhash

    section = regex.compile(r"(?<=\n[\x20\t]{0,8}\n)|(?<=\n)(?=[#0-9A-Fa-f])")
    piece = regex.compile(r"(?<=[^\p{L}\p{N}\x20\t\n][\x20\t])|(?<=[dnry]\x20)")

    def cut(pattern, s):
        places = sorted({0, len(s), *(m.start() for m in pattern.finditer(s))})
        return [s[a:b] for a, b in zip(places, places[1:])]

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    held, roots = {}, []
    for part in cut(section, text or ""):
        lines = cut(regex.compile(r"(?<=\n)"), part)
        roots.append(digest(",".join(map(digest, lines))))
        for line in lines:
            for x in cut(piece, line):
                held[xxhash.xxh64(x.encode(), seed=42).intdigest() >> 20, len(x)] = len(x)
    return digest(";".join(roots)), held


def likeness(a, b):
    (root_a, a), (root_b, b) = a, b
    if root_a == root_b:
        return 1.0
    total = sum(a.values()) + sum(b.values())
    return min(0.999, 2.0 * sum(a[x] for x in a.keys() & b.keys()) / total) if total else 0.0


def align(tok, text):
    """(groups, links) of one text, token by token; None if it has no tokens."""
    if not text:
        return None
    ids = next(tok.ids([text]))
    if not tok.lossless(text, ids):
        return None
    tokens = [[(int(i), int(side.sizes(i))) for i in own] for side, own in zip(tok.sides, ids)]
    upto, groups, at = [0, 0], [([], [])], [0, 0]
    while at[0] < len(tokens[0]) or at[1] < len(tokens[1]):
        side = 0 if upto[0] <= upto[1] and at[0] < len(tokens[0]) else 1
        i, size = tokens[side][at[side]]
        groups[-1][side].append(i)
        upto[side] += size
        at[side] += 1
        if upto[0] == upto[1]:
            groups.append(([], []))
    groups.pop()
    return groups, [(a, b) for x, y in groups for a in x for b in y]


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)


def secrets(text):
    """(n_assign, n_access, n_hex, digest) of the base patterns."""
    import hashlib

    text = text or ""
    found = [("assign", m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1][0], kinds.index(x[0])))
    shown = ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)
    return (*(sum(k == kind for k, _ in found) for kind in kinds), hashlib.sha256(shown.encode()).hexdigest())
