"""Plain versions of the operators, one document at a time, to hold results against."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def decontaminate(docs, benchmark, window=10):
    """docs: (doc_id, text); benchmark: (item_id, text)."""
    items = {}
    for name, text in benchmark:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            items.setdefault(tuple(w[k : k + size]), set()).add(str(name))
    sizes = {len(k) for k in items}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                at = items.get(tuple(w[k : k + size]))
                if at:
                    found |= at
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def pieces(doc, text, encode):
    ids = [*encode(text or ""), 1]
    start, out = 0, []
    while start < len(ids):
        size = 2048
        while size > len(ids) - start:
            size //= 2
        crc = zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
        out.append((doc, start, size, crc, len(ids)))
        start += size
    return out
