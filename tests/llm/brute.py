"""The operators' contracts, written plainly over lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = "[^\x20\x09-\x0D]+"
NORMAL = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def normal(text):
    return re.findall(NORMAL, lower(text))


def simhash(text):
    words = re.findall(BLANK, lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    prints = [simhash(t) for _, t in rows]
    distinct = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ distinct[i]) <= 3) + i + 1:
            parent[root(int(j))] = root(i)
    at = {int(p): root(i) for i, p in enumerate(distinct)}
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[at[p]] = min(least.get(at[p], doc), doc)
    return [(doc, f"{p:016x}", least.get(at[p])) for (doc, _), p in zip(rows, prints)]


def repeated_passages(rows, window=35):
    texts = [re.findall(BLANK, t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = normal(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, found = normal(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= items_here
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def rules(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = re.findall(BLANK, text)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(BLANK, x)]
        out.append((
            doc, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    return out


def licenses(rows):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    out = []
    for doc, text in rows:
        w = normal(text)
        starts, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return out


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(rows):
    out = []
    for doc, text in rows:
        found = []
        for order, kind in enumerate(KINDS):
            for m in re.finditer(PATTERNS[kind], text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": True,
                    "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15,
                }[kind]
                if good:
                    found.append((m.start(), order, m.end(), kind))
        found.sort()
        count = Counter(f[3] for f in found)
        out.append((doc, *(count[k] for k in KINDS), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found))))
    return out
