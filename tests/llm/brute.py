"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def line_dedup(docs):
    """{doc_id: cleaned text} of (doc_id, text), ids unique."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components(prints, bits=2):
    """{key: smallest key of its component} of {key: print}."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(prints), 2):
        if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in prints}


def fold_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, item ids)}."""
    windows = []
    for item, text in items:
        w = fold_words(text)
        windows += [(item, w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []
    out = {}
    for doc, text in docs:
        w, hit, ids = fold_words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(item)
        out[doc] = (len(w), len(hit), sorted(map(str, ids)))
    return out


def substrings(docs, window=35):
    """[(n_words, n_removed, kept)] of texts."""
    split = [words(t) for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


class Spelling:
    """Two Kneser-Ney models over shared letter counts, by the definition, with dictionaries of strings."""

    D, PRIOR, ORDER = 0.75, 5.0, 6

    def __init__(self, texts, labelled):
        self.letters = Counter(x for word in {w for t in texts for w in t.lower().split()} for x in set(word + "\n"))
        self.n = {(c, k): Counter() for c in (0, 1) for k in range(1, self.ORDER + 1)}
        for text, c in labelled:
            for word in text.lower().split():
                spelt = f" {word}\n"
                for k in range(1, self.ORDER + 1):
                    self.n[c, k].update(spelt[i + 1 - k : i + 1] for i in range(max(1, k - 1), len(spelt)))
        for c in (0, 1):
            for k in range(1, self.ORDER):
                before = Counter(g[1:] for g in self.n[c, k + 1])
                self.n[c, k] = Counter({g: n if g[0] == " " else before[g] for g, n in self.n[c, k].items()})

    def p(self, context, letter, c):
        """Probability of a letter (None: one never seen) after the letters of its word so far, a space first."""
        p = ((self.letters[letter] if letter else 0) + 0.5) / (sum(self.letters.values()) + 0.5 * (len(self.letters) + 1))
        for k in range(1, self.ORDER + 1):
            if len(context) >= k - 1:
                last = context[len(context) + 1 - k :]
                after = {g: n for g, n in self.n[c, k].items() if g[:-1] == last and n}
                n = after.get(last + letter, 0) if letter else 0
                p = (max(0, n - self.D) + (self.D * len(after) + self.PRIOR) * p) / (sum(after.values()) + self.PRIOR)
        return p

    def likelihood(self, word, c):
        import math

        spelt = f" {word}\n"
        return sum(math.log(self.p(spelt[:i], spelt[i], c)) for i in range(1, len(spelt)))
