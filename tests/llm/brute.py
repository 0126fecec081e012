"""Brute-force versions that the operators are held against."""

import hashlib
import re
from collections import Counter

import xxhash
import zstandard

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(rows, window):
    """rows: (doc_id, text). {doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {k: SPACE_WORD.findall(t or "") for k, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def earlier_bytes(rows, window):
    """rows: (doc_id, text) in doc_id order. {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = b"\x01" * window
            seen.add(raw[i : i + window])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    words = SPACE_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(rows, k=5, percent=75):
    """{doc_id: (n_shingles, component_id)} over all pairs."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                continue
            n = len(x & y)
            if 100 * n >= percent * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return ALNUM_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def contaminated(rows, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256)}"""
    grams = {}
    for name, t in items:
        w = lower_words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    sizes = {len(g) for g in grams}
    out = {}
    for k, t in rows:
        w, names = lower_words(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    names |= grams[g]
                    hit[i : i + n] = [True] * n
        out[k] = (len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out


def repeat_words(text, window=8):
    words = SPACE_WORD.findall(text or "")
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + window)}
    return len(covered)


def strip_earlier_text(rows, window=100):
    """rows: (doc_id, text) in doc_id order. {doc_id: kept text}; bytes of split characters are left out."""
    seen, out = set(), {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = b"\x01" * window
            seen.add(raw[i : i + window])
        out[k] = None if t is None else bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def cleaned(rows, items, window=10):
    """[(doc_id, text without the spans of benchmark windows)]"""
    grams = {}
    for _, t in items:
        w = lower_words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(min(window, len(w)), set()).add(tuple(w[i : i + window]))
    out = []
    for k, t in rows:
        places = [(m.start(), m.end()) for m in ALNUM_WORD.finditer((t or "").translate({c: c + 32 for c in range(65, 91)}))]
        w = lower_words(t)
        hit = [False] * len(w)
        for n, known in grams.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit[i : i + n] = [True] * n
        parts, last, i = [], 0, 0
        while i < len(w):
            j = i
            while j < len(w) and hit[j]:
                j += 1
            if j > i:
                parts.append(t[last : places[i][0]])
                last = places[j - 1][1]
            i = max(j, i + 1)
        out.append((k, t if not parts else " ".join([*parts, t[last:]])))
    return out


def languages(labelled, texts, sample=100, most=64 << 10):
    """labelled: (text, lang) rows. [(language, score)] of texts, by a dictionary of each language's own rows."""
    small = [(t, lang) for t, lang in labelled if t is not None and lang is not None and len(t.encode()) <= 20_000]
    counts = Counter(lang for _, lang in small)
    place = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    by_place = sorted((lang, signed(place(t)) % 1_000_003 / 1_000_003, t) for t, lang in small)
    clean = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()).encode()
    joined = {}
    for lang, p, t in by_place:
        if p < min(1.0, sample / counts[lang]):
            joined.setdefault(lang, []).append(clean(t))
    joined = {lang: b" ".join(x) for lang, x in joined.items()}
    size = min(most, max(4096, min(map(len, joined.values()))))
    coders = []
    for lang in sorted(joined, key=lambda x: (-counts[x], x)):
        how = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(joined[lang][:size]), source_size=4000, min_match=3, write_content_size=0, write_dict_id=0, write_checksum=0)
        coders.append((lang, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(joined[lang][:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)))
    out = []
    for t in texts:
        raw = clean(t or "")
        if not raw:
            out.append("und")
            continue
        sizes = [(len(c.compress(raw)), i) for i, (_, c) in enumerate(coders)]
        out.append(coders[min(sizes)[1]][0])
    return out
