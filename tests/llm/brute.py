"""Plain loops that say what each operator must return."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    chars = sum(map(len, words))
    bad = 10 * symbols > len(words) or (upper > lower and upper > len(words)) or 2 * dup > len(lines) or chars > 20 * len(words)
    return len(words), chars, symbols, dup, len(hit), base, not base and not bad


def contamination(text, items):
    """n_words, n_hit, the ids of the items hit, contaminated."""
    words = BENCH_WORD.findall(ascii_lower(text or ""))
    hit, ids = set(), set()
    for key, item in items:
        own = BENCH_WORD.findall(ascii_lower(item or ""))
        size = min(13, len(own))
        for a in range(len(own) - size + 1 if own else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == own[a : a + size]:
                    hit.update(range(b, b + size))
                    ids.add(str(key))
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


def shingles(text, size=4):
    words = WORD.findall(ascii_lower(text or ""))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def near_duplicates(docs, size=4):
    """doc_id -> (n_shingles, component_id)."""
    sets = {key: shingles(text, size) for key, text in docs}
    owner = {key: key for key, _ in docs}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    low, high = sorted((root(a), root(b)))
                    owner[high] = low
    return {key: (len(sets[key]), root(key)) for key in keys}


def similar_lines(docs):
    """doc_id -> the text without lines that an earlier line resembles."""
    earlier, out = [], {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(WORD.findall(line.lower()))
            like = len(words) > 0 and any(
                100 * len(words & e) >= 80 * len(words | e) for e in earlier if 80 * len(e) <= 100 * len(words) and 80 * len(words) <= 100 * len(e)
            )
            if words:
                earlier.append(words)
            if not like:
                kept.append(line)
        out[key] = None if text is None else "\n".join(kept)
    return out


def repeated_spans(docs, length=400):
    """doc_id -> n_bytes, n_removed, n_spans, hash of what is left."""
    datas = {key: (text or "").encode() for key, text in docs}
    times = Counter(d[i : i + length] for d in datas.values() for i in range(len(d) - length + 1))
    out = {}
    for key, data in datas.items():
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if times[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
