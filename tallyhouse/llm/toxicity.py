"""Toxicity by a learned lexicon, misspellings and context.

Words and word stems that mark toxic documents are learned from labelled rows. Words of the lexicon form
a trie; a Levenshtein automaton of every distinct word of a text is run along it, so terms with one
typing error, or two in long terms, are found too. Each match is read in its window of words: inside
quotation marks or next to a word of reporting it counts as quoted. A logistic model weighs terms,
misspellings, stems, quotations and density.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.pretokens import KEPT
from tallyhouse.llm.texts import bodies, slices, smallest, work_table

#: Labelled rows that the model is fitted on, at most so many of each label.
FIT_ROWS = 2_500
REJECT = 0.7
SUPPORT, LIFT, STRONG = 0.005, 5.0, 20.0
STEM = range(4, 8)
WINDOW = 8
_QUOTES = re.compile("[\"“”„«»‹›]")
_REPORTING = frozenset("said says wrote called calls quote quoted quotes word words term terms insult insults slur "
                       "sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó cita palabra".split())
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PUNCTUATION = re.compile("[“”„«»‹›‘’…–—¡¿]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FEATURES = 8
_EXACT, _STEM, _FUZZY, _QUOTED = 1, 2, 3, 4


def plain(text: str) -> str:
    """Lower-cased, with typographic punctuation as blanks."""
    low = text.lower()
    return low if low.isascii() else _PUNCTUATION.sub(" ", low)


def words(low: str) -> list[bytes]:
    return low.encode().translate(_LETTERS).split()


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automaton of a word: state ``e`` holds, as bits, how much of the word may be read with
    ``e`` errors."""

    def __init__(self, word: str, errors: int):
        self.last = 1 << len(word)
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.start = tuple((2 << e) - 1 for e in range(errors + 1))
        self.mask = 2 * self.last - 1

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        at = self.places.get(letter, 0)
        out = [(state[0] & at) << 1]
        for e in range(1, len(state)):
            # letter read as it is, put in, put for another, or a letter of the word left out
            out.append(((state[e] & at) << 1 | state[e - 1] | state[e - 1] << 1 | out[e - 1] << 1) & self.mask)
        return tuple(out)

    def errors(self, state: tuple[int, ...]) -> int | None:
        """Fewest errors with which the whole word is read."""
        return next((e for e, bits in enumerate(state) if bits & self.last), None)


class _Known(dict):
    """What is known of each word, found when first asked for."""

    def __init__(self, find: Callable[[str], tuple[int, str, float] | None]):
        self.find = find

    def __missing__(self, word: bytes) -> tuple[int, str, float] | None:
        if len(self) > KEPT:
            self.clear()
        found = self[word] = self.find(word.decode())
        return found


class Lexicon:
    """Terms and stems with their lift: how much more often toxic documents have them than others. The
    strong terms form a trie. ``known[word]`` is the kind, the term and the weight of a word, or None."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = dict(sorted(terms.items())), dict(sorted(stems.items()))
        self.trie: dict = {}
        self.begin, self.end, self.inside = set(), set(), {}
        for term in (t for t, lift in self.terms.items() if lift >= STRONG):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            k = errors_allowed(term)
            if k:
                # of k + 1 parts of a term with k errors one is whole
                cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
                self.begin.add(term[: cuts[1]])
                self.end.add(term[cuts[-2] :])
                for a, b in zip(cuts[1:-2], cuts[2:-1], strict=True):
                    self.inside.setdefault(term[a:b], set()).update(range(a - k, a + k + 1))
        self.begins = sorted({len(x) for x in self.begin})
        self.ends = sorted({len(x) for x in self.end})
        self.insides = sorted({len(x) for x in self.inside})
        self.stem_sizes = sorted({len(s) for s in stems})
        self.longest = max(map(len, terms), default=0) + 2
        self.known = _Known(self._find)

    def __reduce__(self):
        return Lexicon, (self.terms, self.stems)

    def _find(self, word: str) -> tuple[int, str, float] | None:
        if word in self.terms:
            return _EXACT, word, math.log(self.terms[word])
        for n in self.stem_sizes:
            if len(word) > n and word[:n] in self.stems:
                return _STEM, word[:n], math.log(self.stems[word[:n]])
        if 3 < len(word) <= self.longest and self._near(word):
            best = self._nearest(word)
            if best is not None:
                return _FUZZY, best, math.log(self.terms[best])
        return None

    def _near(self, word: str) -> bool:
        return (any(word[:n] in self.begin for n in self.begins) or any(word[-n:] in self.end for n in self.ends)
                or any(i in self.inside.get(word[i : i + n], ()) for n in self.insides for i in range(len(word) - n + 1)))

    def _nearest(self, word: str) -> str | None:
        """The term with the fewest errors, the first by name among equals, that the word's automaton accepts."""
        automaton, found = Automaton(word, 2), []
        todo = [(self.trie, automaton.start)]
        while todo:
            node, state = todo.pop()
            for letter, after in node.items():
                if letter == "":
                    errors = automaton.errors(state)
                    if errors is not None and errors <= errors_allowed(after):
                        found.append((errors, after))
                elif any(new := automaton.step(state, letter)):
                    todo.append((after, new))
        return min(found)[1] if found else None

    def features(self, text: str) -> list[float]:
        """What the model weighs, all 0 for a text without matches."""
        low = plain(text)
        found = list(map(self.known.__getitem__, words(low)))
        at = [i for i, f in enumerate(found) if f is not None]
        if not at:
            return [0.0] * FEATURES
        spans = [m.span() for m in _WORD.finditer(low)]
        marks = np.array([m.start() for m in _QUOTES.finditer(text.lower())], np.int64)
        weights = {kind: 0.0 for kind in (_EXACT, _STEM, _FUZZY, _QUOTED)}
        for i in at:
            kind, _, weight = found[i]
            first, last = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            before = np.searchsorted(marks, spans[i][0]) - np.searchsorted(marks, first)
            after = np.searchsorted(marks, last) - np.searchsorted(marks, spans[i][1])
            near = any(low[a:b] in _REPORTING for a, b in spans[max(0, i - 3) : i + 4])
            weights[_QUOTED if before % 2 and after or near else kind] += weight
        own = weights[_EXACT] + weights[_STEM] + weights[_FUZZY]
        best = max((found[i][2] for i in at if found[i][0] != _FUZZY), default=0.0)
        return [*map(math.log1p, weights.values()), math.log1p(sum({found[i][1]: found[i][2] for i in at}.values())),
                min(best, 5.0), min(1.0, 10 * own / len(found)), float(weights[_EXACT] > math.log(STRONG))]


def chosen(found: dict[tuple[str, bool], tuple[int, float]]) -> Lexicon:
    """The lexicon of what marks toxic documents, given how often each (term, whether a stem) does and its
    lift. A stem is as long as it can be without losing its words, and has more than one word."""
    full = {t: n for (t, stem), (n, _) in found.items() if not stem}
    stems: dict[str, float] = {}
    for term, stem in sorted(found, key=lambda k: (len(k[0]), k)):
        if not stem or any(term.startswith(s) for s in stems):
            continue
        most = found[term, True][0]
        longer = [t for t, s in found if s and t.startswith(term) and found[t, True][0] >= 0.95 * most]
        if most > 1.5 * max((n for t, n in full.items() if t.startswith(term)), default=0):
            best = max(longer, key=lambda t: (len(t), t))
            stems[best] = found[best, True][1]
    return Lexicon({t: found[t, False][1] for t in full if len(t) > 2 and not any(t.startswith(s) for s in stems)}, stems)


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.array([self.lexicon.features(t) for t in texts], float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[1:] + self.weights[0], -50, 50)))


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic model, the bias first, by Newton's method."""
    x = np.c_[np.ones(len(rows)), rows]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(keep), x.T @ (labels - p) - keep * w)
        w += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out() -> Column:
    """Whether a document's label is kept from fitting."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(toxic, text) of at most ``fit_rows`` documents of each label, those with the smallest hashes of their
    id. Ids that are labelled more than once have the larger label."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = work_table(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    parts = [smallest(known.where(F.col("toxic") == y), "h", fit_rows) for y in (0, 1)]
    wanted = parts[0].unionByName(parts[1]).drop("h")  # at most 2 * fit_rows ids
    return work_table(bodies(docs).join(F.broadcast(wanted), "doc_id").select("toxic", "text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from a bounded sample of labelled rows that are not held out."""
    sample = _sample(docs, labels, fit_rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            for toxic, text in zip(part["toxic"].to_pylist(), part["text"].to_pylist(), strict=True):
                here = {w.decode() for w in words(plain(text))}
                counts.update((w, False, toxic) for w in here)
                counts.update((s, True, toxic) for s in {w[:n] for w in here for n in STEM if len(w) > n})
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()),
             pa.array([n * k[2] for k, n in rows], pa.int64()), pa.array([n * (1 - k[2]) for k, n in rows], pa.int64())],
            names=["term", "stem", "a", "b"])

    totals = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    least = max(5, SUPPORT * toxic)
    # a document has few terms, so few terms are in many of the sample's documents: what is collected is bounded
    marking = (sample.mapInArrow(terms, "term string, stem boolean, a bigint, b bigint").groupBy("term", "stem")
               .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
               .where((F.col("a") >= least) & (F.col("a") * (clean + 1) >= LIFT * toxic * (F.col("b") + 1)))
               .collect())
    wanted = {(r.term, r.stem): r.a * (clean + 1) / (toxic * (r.b + 1)) for r in marking}

    def settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for part in slices(batches):
            for text in part["text"].to_pylist():
                here = [w.decode() for w in words(plain(text))]
                for i, w in enumerate(here):
                    for key in ((w, False), *((w[:n], True) for n in STEM if len(w) > n)):
                        if key in wanted:
                            found.add((*key, xxhash.xxh3_64_intdigest(" ".join(here[max(0, i - 1) : i + 2])) >> 1))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in
                                          enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["term", "stem", "around"])

    # copies of a document repeat its words with the words around them: a term counts once per such setting
    support = (sample.where("toxic = 1").mapInArrow(settings, "term string, stem boolean, around bigint").distinct()
               .groupBy("term", "stem").count().where(F.col("count") >= least))
    lexicon = chosen({(r.term, r.stem): (r["count"], wanted[r.term, r.stem]) for r in support.collect()})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [lexicon.features(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(features, "toxic int, x array<double>").collect()
    x = np.array([r.x for r in rows], float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, [r.toxic for r in rows]))
    return Model(lexicon, logistic(x[order], np.array([r.toxic for r in rows], float)[order]))


def scored(docs: DataFrame, model: Model, score: str = "score", text: str = "text") -> DataFrame:
    """The documents with one more column, their score from 0 to 1. Null counts as the empty text, which has
    the score of a text without matches; repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string()).fill_null("")], names=["text"])
            found = [mine.score(part["text"].to_pylist()) for part in slices(iter((texts,)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found or [np.empty(0)]))],
                                             names=[*batch.schema.names, score])
        mine.lexicon.known.clear()  # the worker may serve other stages

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(score)).schema)


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a null doc_id is not held out. Without labels
    every score is 0.5."""
    found = scored(bodies(docs), fit(docs, labels, fit_rows))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The documents that score below ``reject``, with all their columns."""
    score = f"score_{uuid.uuid4().hex}"
    return scored(docs, fit(docs, labels, fit_rows), score).where(F.col(score) < reject).drop(score)
