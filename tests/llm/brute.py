"""The operators' rules, applied one document at a time."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k:k + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def linked(docs, width, num, den):
    sets = {}
    for doc, text in docs:
        w = plain_words((text or "").translate(LOWER))
        n = min(width, len(w))
        sets[doc] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return [(d, len(sets[d]), root(d)) for d in ids]


def quality(docs):
    out = []
    for doc, text in docs:
        w, text = plain_words(text), text or ""
        grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        repeated = {i for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for i in range(k, k + 5)}
        seen, twice = set(), 0
        for line in text.split("\n"):
            if line.strip(WHITE):
                twice += line in seen
                seen.add(line)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(repeated),
                    len(w) < 10 or 100 * len(repeated) > 20 * len(w)))
    return out


def lines(docs):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = collections.defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        cut = (text or "").split("\n")
        kept = [x for x in cut if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == doc]
        out.append((doc, len(cut), len(cut) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def tokens(docs, tokenizer):
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def water_fill(sizes, weights, epochs):
    """Targets by repeated clamping."""
    total, clamped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        level = (total - sum(epochs * sizes[i] for i in clamped)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > epochs * sizes[i]}
        if not over:
            return [epochs * s if i in clamped else level * weights[i] for i, s in enumerate(sizes)]
        clamped |= over


def fill_in_middle(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
        h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            row = (n, "plain", None, None, text)
        elif h[3] % 100 < 50:
            row = (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            row = (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        out.append((doc, *row[:4], *[hashlib.sha256(t.encode()).hexdigest() for t in (row[4], text)]))
    return out


def hard_negatives(rows):
    import math

    used = {}
    for one, vector, label in rows:
        if one is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = ((label + 1) % 10 if one % 7 == 0 else label, [math.floor(256 * x) for x in vector])
        used[one] = min(used.get(one, row), row)
    out = []
    for anchor, (label, v) in used.items():
        if anchor % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), one, own == label) for one, (own, w) in used.items() if one != anchor)
        for score, positive, _ in [o for o in others if o[2]][:5]:
            fit = [o for o in others if not o[2] and 80 * -score <= 100 * -o[0] <= 100 * -score]
            out += [(anchor, positive, k + 1, o[1], -score, -o[0]) for k, o in enumerate(fit[:5])]
    return out


def base_spans(text):
    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    number = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15)]
    return [(k, *m.span()) for k, pattern, check in rules for m in re.finditer(pattern, text or "") if check(m[0])]


def personal_data(docs):
    out = []
    for doc, text in docs:
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        out.append((doc, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    return out


def kept(docs, weight=300, spare=100):
    """doc -> kept of (doc, text, lang, source), from sorted lists of rounded values."""
    limits = {"marks": (200, False), "lines": (300, False), "repeats": (100, False), "length": (150, True)}
    measured, groups = {}, collections.defaultdict(list)
    for (doc, text, lang, source), row in zip(docs, quality([d[:2] for d in docs])):
        _, n, chars, symbols, dup, repeats, failed = row
        lines = sum(1 for x in (text or "").split("\n") if x.strip(WHITE))
        values = {"marks": 1000 * symbols // n, "lines": 1000 * dup // lines, "repeats": 1000 * repeats // n, "length": 100 * chars // n} if n else {}
        measured[doc] = (values, lang, source, failed)
        if not failed:
            for name, value in values.items():
                shift = max(value.bit_length() - 6, 0)
                for key in ((name, lang, source), (name, lang)):
                    groups[key].append(value >> shift << shift)
    fence = {}
    for key in [k for k in groups if len(k) == 3]:
        name, lang, _ = key
        own, whole = sorted(groups[key]), sorted(groups[name, lang])
        n, quartile = len(own), lambda x, q: x[-(-q * len(x) // 4) - 1]
        low, high = ((n * quartile(own, q) + weight * quartile(whole, q)) // (n + weight) for q in (1, 3))
        margin, below = limits[name]
        width = 3 * (high - low) + margin + (margin * spare // len(whole) if name == "length" else 0)
        fence[key] = (low - width if below else None, high + width)
    out = {}
    for doc, (values, lang, source, failed) in measured.items():
        fits = all((fence[n, lang, source][0] is None or v >= fence[n, lang, source][0]) and v <= fence[n, lang, source][1]
                   for n, v in values.items()) if not failed else False
        out[doc] = fits
    return out
