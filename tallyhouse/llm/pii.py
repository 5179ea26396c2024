"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Around everything that could be part of an entity (digits, at signs) the
tokens of a document form chains; equal or similar tokens anywhere in the document are joined by skip
edges, so that labels agree across it. The field is fitted on the base spans of a bounded sample and
on what repeats them, without features that repeat the patterns, and adds what it is sure of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import crf
from tallyhouse.llm.texts import bodies, flat_bytes, slices

KINDS = ("email", "ip", "card", "phone")
#: What the field is fitted on at most: texts, and sequences of up to 120 tokens around their triggers.
FIT_DOCS, FIT_SEQUENCES = 600, 4_000
SURE = 0.9
REACH = 40
# fixed values
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_LEADS = frozenset("phone tel telephone call mobile fax mail email contact card visa account ip host address telefon anruf konto "
                   "téléphone carte compte teléfono tarjeta cuenta correo".split())
_MARKS = np.zeros(256, bool)
_MARKS[[*b"0123456789@"]] = True

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins as far left of its at sign as its letters reach."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    found: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((kind, *m.span()))
    return found


def stretch(text: str) -> tuple[list[tuple[int, int]], list[list[int]], np.ndarray, np.ndarray]:
    """Tokens around triggers: places, features, chain edges, skip edges. A skip edge goes from the first token of a kind to
    each later one, so that a label is two edges from every repetition however many there are."""
    places, chain = [], []
    for a, b in crf.regions(text, _TRIGGER, REACH):
        first = len(places)
        places.extend(m.span() for m in _TOKEN.finditer(text, a, b))
        chain.extend((i, i + 1) for i in range(first, len(places) - 1))
    tokens = [text[a:b].lower() for a, b in places]
    glued = [i > 0 and places[i - 1][1] == places[i][0] for i in range(len(places))]
    kinds = [crf.shape(text[a:b]) + str(min(b - a, 6)) if t[0].isdigit() else t if not t[0].isalnum() else "w" + str(min(b - a, 6))
             for (a, b), t in zip(places, tokens, strict=True)]
    lead = [t in _LEADS for t in tokens]
    rows = []
    for i in range(len(places)):
        def at(values, k, i=i):
            return values[i + k] if 0 <= i + k < len(places) else "-"
        near = [at(glued, k) for k in (-1, 0, 1, 2)]
        rows.append([crf.feature("bias"), crf.feature("k", kinds[i]), crf.feature("k-1", at(kinds, -1), near[1]),
                     crf.feature("k+1", at(kinds, 1), near[2]), crf.feature("k-2", at(kinds, -2), near[0], near[1]),
                     crf.feature("k+2", at(kinds, 2), near[2], near[3]), crf.feature("k-1 k", at(kinds, -1), kinds[i], near[1]),
                     crf.feature("k k+1", kinds[i], at(kinds, 1), near[2]),
                     crf.feature("k-1 k k+1", at(kinds, -1), kinds[i], at(kinds, 1), near[1], near[2]),
                     crf.feature("lead", any(lead[max(0, i - 4) : i]))])
    first_of: dict[str, int] = {}
    skips = set()
    for i, t in enumerate(tokens):
        if len(t) >= 3 and (t[0].isdigit() or "@" in tokens[max(0, i - 1) : i + 2]):
            for key in {t, t[-4:]} if t[0].isdigit() else {t}:  # the same token, or the same last digits
                if first_of.setdefault(key, i) < i - 1:
                    skips.add((first_of[key], i))
    return places, rows, np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skips), np.int64).reshape(-1, 2)


def labels_of(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """Per token 0, or 1 and the kind of the span that holds it; the first kind where spans overlap."""
    out = [0] * len(places)
    starts = [a for a, _ in places]
    for kind, a, b in sorted(spans, reverse=True):
        i = int(np.searchsorted(starts, a))
        while i < len(places) and places[i][1] <= b:
            out[i] = kind + 1
            i += 1
    return out


def agreed(labels: list[int], skips: list[tuple[int, int]]) -> list[int]:
    """Labels carried along skip edges to tokens without one, and over the few tokens between two such: what
    is an entity in one place of a document is one in the others."""
    out = list(labels)
    for x, y in [*skips, *reversed(skips)]:
        if out[x] != out[y] and 0 in (out[x], out[y]):
            out[x] = out[y] = out[x] or out[y]
    last = None
    for i, y in enumerate(out):
        if y:
            if last is not None and i - last <= 3 and out[last] == y:
                out[last + 1 : i] = [y] * (i - last - 1)
            last = i
    return out


def sequences(text: str) -> Iterator[tuple]:
    """Features, labels and skip edges of at most 120 tokens at a time, around every trigger of a text."""
    places, rows, chain, skips = stretch(text)
    ys = agreed(labels_of(places, base_spans(text)), skips.tolist())
    ends = set(range(1, len(places))) - set(chain[:, 1].tolist())
    cuts = [0, *sorted(ends), len(places)]
    low, high = skips.T
    for a, b in zip(cuts, cuts[1:], strict=False):
        for c in range(a, b, 120):
            d = min(b, c + 120)
            inner = skips[np.searchsorted(low, c) : np.searchsorted(low, d)]
            yield rows[c:d], ys[c:d], inner[inner[:, 1] < d] - c


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_sequences: int = FIT_SEQUENCES) -> crf.Weights:
    """Weights fitted around every digit and at sign of at most ``fit_docs`` distinct whole texts, on at most ``fit_sequences``
    sequences of them."""
    texts = bodies(docs).where(F.col("text").rlike("[0-9@]")).select("text")
    return crf.fit(crf.gather(texts, fit_docs, sequences, fit_sequences), len(KINDS) + 1)


def added(text: str, base: list[Span], weights: crf.Weights) -> tuple[list[Span], bool]:
    """What the field is sure of and no base span touches, and whether its messages settled."""
    places, rows, chain, skips = stretch(text)
    if not places:
        return [], True
    belief, settled = crf.beliefs(weights, crf.scores(weights, rows), chain, skips)
    label, sure = belief.argmax(1), belief.max(1) >= SURE
    joined = {b for _, b in chain.tolist()}
    out: list[Span] = []
    i = 0
    while i < len(places):
        j = i + 1
        if label[i] and sure[i]:
            while j < len(places) and j in joined and label[j] == label[i] and sure[j]:
                j += 1
            span = (int(label[i]) - 1, places[i][0], places[j - 1][1])
            if plausible(text[span[1] : span[2]], span[0]) and not any(a < span[2] and span[1] < b for _, a, b in base):
                out.append(span)
        i = j
    return out, settled


def plausible(text: str, kind: int) -> bool:
    """Whether a span has what every entity of its kind has."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return "@" in text[1:-1]
    return text[-1].isdigit() and {1: 4 <= digits <= 12 and text.count(".") == 3, 2: 13 <= digits <= 19, 3: 7 <= digits <= 15}[kind]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (both as text) of every document, and ``settled``, false where
    messages still moved after the last round.

    A null text is empty and has none; repeated rows give a row each; a null doc_id stays null; other
    columns are not looked at. Without anything to fit on, the base spans are all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, settled boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for part in slices(batches):
            counts, base, spans = np.zeros((part.num_rows, 4), np.int64), [""] * part.num_rows, [""] * part.num_rows
            settled = [True] * part.num_rows
            data, begins = flat_bytes(part["text"])
            for i in np.unique(np.searchsorted(begins, np.flatnonzero(_MARKS[data]), "right") - 1).tolist():
                text = part["text"][i].as_py()
                found = base_spans(text)
                counts[i] = np.bincount([k for k, _, _ in found], minlength=4)
                base[i] = joined(found)
                more, settled[i] = added(text, found, weights)
                spans[i] = joined(found + more)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *(pa.array(counts[:, k]) for k in range(4)), pa.array(base, pa.string()), pa.array(spans, pa.string()),
                 pa.array(settled)],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "settled"])

    return bodies(docs).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "settled")
