"""Plain versions of the operators, a text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LICENCE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def pii_fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def pii(text):
    """Spans kind:start:end by kind, then start."""
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if pii_fits(k, m[0])]


def trusted_edges(seeds, edges, rounds=3, confidence=0.8, support=5):
    """Edges {(kind, pattern, value): times} of the patterns that the last round trusts; seeds are (kind, value)."""
    known = {s: 1.0 for s in seeds}
    for _ in range(rounds):
        trusted = {}
        for node in {(k, p) for k, p, _ in edges}:
            at = [(known.get((k, v), 0.0), n) for (k, p, v), n in edges.items() if (k, p) == node]
            trust = sum(s * n for s, n in at) / sum(n for _, n in at)
            if trust >= confidence and sum(s >= confidence for s, _ in at) >= support:
                trusted[node] = trust
        known = {s: 1.0 for s in seeds}
        for k, p, v in edges:
            if (k, p) in trusted and (k, v) not in seeds:
                known[k, v] = 1 - (1 - known.get((k, v), 0.0)) * (1 - min(trusted[k, p], 0.99))
    return {e for e in edges if e[:2] in trusted}


def markov(samples, alphabet=128, back_off=1.0):
    """log probability of a character after another, backed off to how often it comes at all."""
    pairs = Counter(p for t in samples for p in zip(t, t[1:]))  # noqa: B905
    firsts, seconds = Counter(), Counter()
    for (a, b), n in pairs.items():
        firsts[a] += n
        seconds[b] += n
    total = sum(seconds.values()) + 0.5 * alphabet
    return lambda a, b: math.log((pairs[a, b] + back_off * (seconds[b] + 0.5) / total) / (firsts[a] + back_off))


def secrets(text):
    """Spans by start, then kind."""
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(SECRETS.items()) for m in re.finditer(p, text or "") if fits[k](m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def licences(text):
    words, base = LICENCE_WORD.findall(lower(text)), {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for phrase, label in base.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def kept_words(texts, window=35):
    """(words, removed, kept text) of each text."""
    split = [SPACED_WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        hit = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(words), len(hit), " ".join(w for i, w in enumerate(words) if i not in hit)))
    return out


def contamination(text, items, window=10):
    """(words, hit places, ids of items whose windows occur)."""
    words, hit, found = LICENCE_WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        parts = LICENCE_WORD.findall(lower(item))
        size = min(window, len(parts))
        for k in range(len(parts) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == parts[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(item_id)
    return words, hit, found


def simhash(text):
    words = SPACED_WORD.findall(lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def shingle_set(text, words=5):
    parts = SPACED_WORD.findall(lower(text))
    return frozenset(" ".join(parts[i : i + words]) for i in range(max(len(parts) - words + 1, min(len(parts), 1))))


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def groups(links, nodes):
    """The smallest node that each can reach."""
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def near_groups(prints, radius=2):
    nodes = sorted(set(prints))
    return groups([(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= radius], nodes)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
