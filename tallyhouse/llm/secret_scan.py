"""Secrets by patterns and a linear-chain conditional random field.

Patterns give the base spans. Around everything that could be a secret (words with digits, words that
announce one) tokens are tagged as begin, inside or outside of a secret from their shape, the words
beside them and what kind of file the text looks like, and decoded by Viterbi. The field is fitted on
the values of the base spans of a bounded sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import crf
from tallyhouse.llm.texts import bodies, flat_bytes, slices

KINDS = ("assign", "access", "hex", "tagged")
#: What the field is fitted on at most: texts with a long run of letters and digits and half as many with a digit but no such
#: run, and sequences of up to 100 tokens around the triggers of each kind of text.
FIT_DOCS, FIT_SEQUENCES = 800, 4_000
REACH = 60
SHORTEST = 12
# fixed values
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("passw", "secret", "token", "api")
#: Digits, words that announce a secret, and words whose letters change from lower to upper case more than once.
_TRIGGER = re.compile(r"[0-9]+|(?<![a-z])[a-z]++[A-Z]++[a-z]++[A-Z]|password|passwd|secret|token|api_?key|bearer|credential", re.I | re.A)
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_ANNOUNCE = frozenset("password passwd pwd secret token key apikey api_key bearer auth credential private acces pas pass".split())
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdef", *b"0123456789"]] = True
_LOWER, _UPPER, _MARK = np.zeros((3, 256), bool)
_LOWER[ord("a") : ord("z") + 1] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

Span = tuple[int, int, int]  # kind, start, end


def matches(text: str) -> list[tuple[Span, tuple[int, int]]]:
    """Base spans by start and kind, each with the place of its value."""
    low = text.lower()
    found = []
    if any(n in low for n in _NAMES):
        found += [((0, *m.span()), m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [((1, *m.span()), m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [((2, *m.span()), m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0][1], f[0][0]))


def _entropy(token: str) -> int:
    counts = Counter(token)
    return round(-sum(c / len(token) * math.log2(c / len(token)) for c in counts.values()))


def _size(n: int) -> int:
    return n if n < 4 else 4 + int(math.log2(n / 4) * 2)


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[int]]]]:
    """Tokens around triggers, one chain after the other: places and features."""
    marks = int(_MARK[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].sum()) / max(1, len(text))
    kind_of_file = (min(4, int(marks * 20)), text.count("\n") > len(text) / 60)
    for a, b in crf.regions(text, _TRIGGER, REACH):
        places = [m.span() for m in _TOKEN.finditer(text, a, b)]
        if not places:
            continue
        tokens = [text[x:y] for x, y in places]
        low = [t.lower() for t in tokens]
        kinds = []
        for t in tokens:
            if t[0].isalnum() or t[0] in "+/_-":
                has = "".join(k for k, p in (("9", "[0-9]"), ("a", "[a-z]"), ("A", "[A-Z]")) if re.search(p, t))
                turns = min(6, len(re.findall(r"[0-9]+|[A-Z]+|[a-z]+", t)))
                kinds.append(f"{has} {_size(len(t))} {turns} {_entropy(t)}")
            else:
                kinds.append(t)
        rows = []
        for i in range(len(tokens)):
            def at(values, k, i=i):
                return values[i + k] if 0 <= i + k < len(values) else "-"
            has, size, turns, entropy = (kinds[i].split(" ") + ["", "", ""])[:4]
            told = next((k for k in range(1, 6) if at(low, -k).rstrip("s") in _ANNOUNCE), 0)
            rows.append([crf.feature("bias"), crf.feature("has", has), crf.feature("size", size, has), crf.feature("turns", turns, has),
                         crf.feature("entropy", entropy, has), crf.feature("turns size", turns, size),
                         crf.feature("before", at(low, -1) if len(at(low, -1)) < 12 else "long"),
                         crf.feature("after", at(low, 1) if len(at(low, 1)) < 12 else "long"),
                         crf.feature("told", told), crf.feature("told has", bool(told), has, size),
                         crf.feature("sign", at(low, -1) in "=:\"'", has), crf.feature("file", *kind_of_file, has)])
        yield places, rows


def _unclear(token: str) -> bool:
    """Whether a token outside of all base spans may be a secret all the same, and so teaches nothing."""
    return len(token) >= SHORTEST and bool(re.search("[0-9]", token) and re.search("[A-Za-z]", token))


def sequences(text: str) -> Iterator[tuple]:
    """Features and labels of at most 100 tokens at a time around every trigger of a text; chains that hold what is
    unclear are left out."""
    values = [v for _, v in matches(text)]
    for places, features in stretches(text):
        ys = [0] * len(places)
        starts, ends = [x for x, _ in places], [y for _, y in places]
        for a, b in values:
            first = bisect_left(starts, a)
            for i in range(first, bisect_right(ends, b)):
                ys[i] = 1 if i == first else 2
        if any(not y and _unclear(text[p:q]) for y, (p, q) in zip(ys, places, strict=True)):
            continue
        for c in range(0, len(places), 100):
            yield features[c : c + 100], ys[c : c + 100], []


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_sequences: int = FIT_SEQUENCES) -> crf.Weights:
    """Weights fitted around every trigger of at most ``fit_docs`` distinct whole texts with a long run of letters and digits with
    a digit, and of half as many with a digit but no such run, which stand for what is outside; at most ``fit_sequences``
    sequences of each."""
    known = bodies(docs).where(F.col("text").rlike("[0-9]")).select("text")
    long = F.col("text").rlike("[A-Za-z0-9]*[0-9][A-Za-z0-9]{11,}")
    return crf.fit(crf.gather(known.where(long), fit_docs, sequences, fit_sequences)
                   + crf.gather(known.where(~long), fit_docs // 2, sequences, fit_sequences), 3)


def _likely(token: str) -> bool:
    """Digits and letters, or letters that change from lower to upper case more than once."""
    return bool(re.search("[0-9]", token) and re.search("[A-Za-z]", token)) or len(re.findall("[a-z][A-Z]", token)) > 1


def tagged(text: str, base: list[Span], weights: crf.Weights) -> list[Span]:
    """What Viterbi tags as a secret and no base span touches; a secret has at least ``SHORTEST`` characters, with
    a digit and a letter or with letters of changing case."""
    out: list[Span] = []
    for places, rows in stretches(text):
        tags, i = crf.viterbi(weights, crf.scores(weights, rows)), 0
        while i < len(places):
            j = i + 1
            if tags[i]:
                while j < len(places) and tags[j] == 2 and places[j][0] == places[j - 1][1]:
                    j += 1
                a, b = places[i][0], places[j - 1][1]
                if b - a >= SHORTEST and _likely(text[a:b]) and not any(x < b and a < y for _, x, y in base):
                    out.append((3, a, b))
            i = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def _runs(marks: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` (a power of two) marked bytes begin."""
    width = 1
    while width < size and len(marks) > width:
        marks = marks[:-width] & marks[width:]
        width *= 2
    return np.flatnonzero(marks) if width >= size else np.empty(0, np.int64)


def find(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (both as text) of every document.

    A null text is empty and has none; repeated rows give a row each; a null doc_id stays null; other
    columns are not looked at. Without anything to fit on, the base spans are all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for part in slices(batches):
            counts, base, spans = np.zeros((part.num_rows, 4), np.int64), [""] * part.num_rows, [""] * part.num_rows
            data, begins = flat_bytes(part["text"])
            turns = np.flatnonzero(_LOWER[data[:-1]] & _UPPER[data[1:]])
            marked = np.concatenate((np.flatnonzero(_DIGIT[data]), _runs(_LETTER[data], 16), turns))
            worth = set(np.unique(np.searchsorted(begins, marked, "right") - 1).tolist())
            for i, text in enumerate(part["text"].to_pylist()):
                if i in worth or "AKIA" in text or any(n in (low := text.lower()) for n in _NAMES) and ("=" in low or ":" in low):
                    found = [s for s, _ in matches(text)]
                    counts[i] = np.bincount([k for k, _, _ in found], minlength=4)
                    base[i] = joined(found)
                    spans[i] = joined(found + tagged(text, found, weights))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *(pa.array(counts[:, k]) for k in range(3)), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return bodies(docs).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
