"""Plain versions of the text operators: no Spark, no tricks, all pairs where pairs are asked for."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

MASK = (1 << 64) - 1
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(nodes, linked):
    """Smallest member by node, for a symmetric relation given as pairs."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Decontamination


def passage_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def repeated_passages(pins, strings, span=10):
    windows = defaultdict(set)
    for key, value in strings:
        words = passage_words(value)
        for i in range(max(1, len(words) - span + 1) if words else 0):
            windows[tuple(words[i:i + span])].add(key)
    sizes = {len(w) for w in windows}
    out = []
    for pin, notes in pins:
        words, hit, items = passage_words(notes), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (window := tuple(words[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[window]
        keys = sorted(str(i) for i in items if i is not None)
        out.append((pin, len(words), len(hit), len(keys), keys))
    return out


# SimHash groups


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(notes):
    words = blank_words((notes or "").translate(UPPER))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    return majority([xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs])


def near_pins(pins, radius=2):
    prints = [(pin, simhash(notes)) for pin, notes in pins]
    nodes = sorted({f for _, f in prints})
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= radius]
    group, low = groups(nodes, linked), {}
    for pin, f in prints:
        if pin is not None:
            low[group[f]] = min(pin, low.get(group[f], pin))
    return [(pin, signed(f), low.get(group[f])) for pin, f in prints]


# Lines


def levenshtein(a, b, most=None):
    """Edit distance; anything above ``most`` once it is passed."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[:len(a) - k], b[:len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    letters, row = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (letters != ord(x)))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if most is not None and row.min() > most:
            return most + 1
    return int(row[-1])


def near_lines(lines, similarity=0.8):
    """All pairs of lines with the edit similarity; letters that one has and the other hasn't are a lower bound of the distance."""
    bags, out = {x: Counter(x) for x in lines}, []
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if abs(len(a) - len(b)) > most:
                continue
            if max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total()) <= most and levenshtein(a, b, most) <= most:
                out.append((a, b))
    return out


def lines_of(pins):
    """Places by line, in lower case without outer blanks."""
    places = defaultdict(list)
    for pin, notes in pins:
        for no, raw in enumerate((notes or "").split("\n")):
            if line := raw.lower().strip(" "):
                places[line].append((pin, no))
    return places


def deduplicated_lines(pins, similarity=0.8):
    places = lines_of(pins)
    lines = sorted(places)
    group, kept = groups(lines, near_lines(lines, similarity)), {}
    for line in lines:
        kept[group[line]] = min(min(places[line]), kept.get(group[line], min(places[line])))
    gone = {p for line in lines for p in places[line] if p != kept[group[line]]}
    out = []
    for pin, notes in pins:
        parts = (notes or "").split("\n")
        out.append((pin, sum(bool(p.lower().strip(" ")) for p in parts), sum((pin, i) in gone for i in range(len(parts))),
                    None if notes is None else "\n".join(p for i, p in enumerate(parts) if (pin, i) not in gone)))
    return out



# Mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Target words by locale, by resharing the excess until none is above its cap."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    got, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total, excess, full = sum(weight[k] for k in open_), 0.0, set()
        for k in open_:
            got[k] += left * weight[k] / total
            if got[k] >= most * sizes[k]:
                excess += got[k] - most * sizes[k]
                got[k] = most * sizes[k]
                full.add(k)
        open_ -= full
        left = excess
        if not full:
            break
    return got


# Fingerprints


def _pair_hash(a, b):
    h = xxhash.xxh64_intdigest(a.encode(), seed=42)
    return h if b is None else xxhash.xxh64_intdigest(b.encode(), seed=h)


def fingerprint(notes):
    lanes, checks = [0] * 64, [0] * 4
    for part in (notes or "").split("\n"):
        for k, lit in enumerate((1, 2)):
            h = xxhash.xxh64_intdigest(part.encode(), seed=xxhash.xxh64_intdigest(lit.to_bytes(4, "little"), seed=42))
            checks[2 * k] = (checks[2 * k] + (h & 0xFFFFFFFF)) % (1 << 32)
            checks[2 * k + 1] = (checks[2 * k + 1] + (h >> 32)) % (1 << 32)
        words = re.split(r"[\x20\x09-\x0D]+", part)
        while len(words) > 1 and words[-1] == "":
            words.pop()  # nothing follows the last word
        for i, word in enumerate(words):
            if word:
                h = _pair_hash(word, words[i + 1] if i + 1 < len(words) else None)
                for b in range(64):
                    lanes[b] += 1 if h >> b & 1 else -1
    lanes = [(x + 32768) % 65536 - 32768 for x in lanes]
    return lanes, checks


def written(lanes, checks):
    return "".join(f"{c:08x}" for c in checks) + "".join(f"{x % 65536:04x}" for x in lanes)


def likeness(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: float(sum(i * j for i, j in zip(x, y)))
    norms = (dot(a[0], a[0]) * dot(b[0], b[0])) ** 0.5
    return max(0.0, min(1.0, dot(a[0], b[0]) / norms)) if norms else 0.0


def edited(pins):
    """(id, edited text, next text) by falling id, the first after the last."""
    order = sorted(pins, key=lambda p: (p[0] is None, -(p[0] or 0)))
    out = []
    for i, (pin, notes) in enumerate(order):
        notes, following = notes or "", order[(i + 1) % len(order)][1] or ""
        half = len(notes) // 2
        out.append((pin, notes[:len(notes) - half] + following[:half], following))
    return out


# Personal data


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(notes):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, notes or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def counted(spans):
    return Counter(k for k, _, _ in spans)
