"""Benchmark decontamination with an FM-index per training shard.

A task indexes its documents shard by shard and searches the benchmark's windows backwards through
the ranks of a wavelet matrix; sampled suffix positions tell where they occur, and overlapping
occurrences merge into spans. The index has the benchmark's words as its alphabet: a word that the
benchmark lacks is in no window, so runs of such words are one separator, and stretches shorter than
the shortest window are left out. Nothing is shuffled.

The benchmark is a query set against all documents. It comes in blocks of at most ``BLOCK_WORDS``
words; each block is broadcast and searched in turn, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.suffixes import FmIndex
from tallyhouse.llm.texts import bodies, slices, whole_text

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 16 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ITEMS = pa.list_(pa.string())


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(_LOWER).split()


class Block:
    """Distinct windows of some items, as numbers of words, and the items that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        places: dict[tuple[int, ...], int] = {}
        owners: list[list[int]] = []
        names: dict[str, int] = {}
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in text]
            size, item = min(window, len(ids)), names.setdefault(name, len(names))
            for k in range(len(ids) - size + 1):
                at = places.setdefault(tuple(ids[k : k + size]), len(owners))
                if at == len(owners):
                    owners.append([])
                if item not in owners[at]:
                    owners[at].append(item)
        self.names, self.owners = list(names), owners
        self.bits = int(len(self.number) + 2).bit_length()
        by_size: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for phrase, at in places.items():
            by_size.setdefault(len(phrase), []).append((at, phrase))
        self.phrases = {size: (np.array([a for a, _ in found]), np.array([p for _, p in found], np.int64))
                        for size, found in by_size.items()}

    def search(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Per text of a shard: words, merged ranges of hit words, names of the items that occur."""
        rows, sizes = [], []
        for text in texts:
            found = words(text)
            rows.append(np.fromiter(map(self.number.get, found, repeat(1)), np.int32, len(found)))
            rows.append(np.ones(1, np.int32))
            sizes.append(len(found))
        begins = np.cumsum([0] + [s + 1 for s in sizes])
        text = np.concatenate(rows)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        place = self._worthwhile(text)
        if self.phrases and (text[place] > 1).any():
            index = FmIndex(text[place], self.bits)
            edges = np.zeros(len(text) + 1, np.int64)
            for size, (number, phrases) in self.phrases.items():
                row, low, high = index.intervals(phrases)
                which, found_at = index.locate(low, high)
                start = place[found_at]
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size, -1)
                doc = np.searchsorted(begins, start, "right") - 1
                for d, w in np.unique(np.stack((doc, number[row[which]]), 1), axis=0).tolist() if len(doc) else ():
                    items[d].update(self.owners[w])
            hit = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
            turns = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
            for d, (a, b) in zip(np.searchsorted(begins, turns[:, 0], "right") - 1, turns.tolist(), strict=True):
                spans[d].append((a - int(begins[d]), b - int(begins[d])))
        return sizes, spans, [[self.names[i] for i in sorted(x)] for x in items]

    def _worthwhile(self, text: np.ndarray) -> np.ndarray:
        """Places to index: stretches of benchmark words no shorter than the shortest window, and one
        separator after each."""
        known = text > 1
        ends = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8))).reshape(-1, 2)
        ends = ends[ends[:, 1] - ends[:, 0] >= min(self.phrases, default=1)]
        edge = np.zeros(len(text) + 2, np.int32)
        edge[ends[:, 0]] += 1
        edge[ends[:, 1] + 1] -= 1
        return np.flatnonzero(np.cumsum(edge)[: len(text)] > 0)


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of about ``most`` words; an item is in one block. Items come to the driver one
    partition at a time, and one block is held at once."""
    items, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), whole_text().alias("text"))
    for name, text in rows.toLocalIterator():
        found = words(text.encode())
        if held and held + len(found) > most:
            yield Block(items, window)
            items, held = [], 0
        if found:
            items.append((name, found))
            held += len(found)
    if items:
        yield Block(items, window)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, spans: str, items: str, n_words: str, window: int = WINDOW,
         block_words: int = BLOCK_WORDS, text: str = "text", cut: bool = False) -> DataFrame:
    """The documents with three more columns: words of the text, merged ranges of words that occurrences
    of benchmark windows cover, and the ids of the items that occur (as strings). With ``cut`` the
    ranges are cut from the texts instead, and the columns are those of the documents.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. Null texts have
    no words. Items of equal id count as one; items without words never occur.
    """
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = docs.withColumns({n_words: F.lit(0).cast("bigint"), spans: F.array().cast(kind),
                            items: F.array().cast("array<string>")})
    found = blocks(benchmark, window, block_words)
    block, after = next(found, None), next(found, None)
    if block is None:
        return docs if cut else out
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = _searched(out, shared, spans, items, n_words, text, docs.schema if cut and after is None else None)
        block, after = after, next(found, None)
    return out


def _searched(docs: DataFrame, shared, spans: str, items: str, n_words: str, text: str, cut: T.StructType | None) -> DataFrame:
    """The documents after one more block. After the last one the texts are cut if the schema of the cut
    documents is given; both happen in one pass, so a task has one Python worker."""
    names = docs.columns
    where = {name: names.index(name) for name in (spans, items, n_words, text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        filled = (_with_text(b, where[text]) for b in batches)
        for part in slices(filled, len(names), SHARD_BYTES):
            sizes, ranges, found = block.search(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist())
            columns = part.columns[:-1]
            old_spans, old_items = columns[where[spans]].to_pylist(), columns[where[items]].to_pylist()
            ranges = [merged([(s["start"], s["end"]) for s in old] + new) for old, new in zip(old_spans, ranges, strict=True)]
            if cut is not None:
                yield _cut(part.column(part.num_columns - 1), columns, ranges, cut, where[text])
                continue
            all_spans = [[{"start": a, "end": b} for a, b in r] for r in ranges]
            columns[where[spans]] = pa.array(all_spans, _SPANS)
            columns[where[items]] = pa.array([a + b for a, b in zip(old_items, found, strict=True)], _ITEMS)
            columns[where[n_words]] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return docs.mapInArrow(run, cut or docs.schema)


def _cut(texts: pa.Array, columns: list[pa.Array], ranges: list[list[tuple[int, int]]], schema: T.StructType, text: int) -> pa.RecordBatch:
    """The columns of the documents without the given ranges of words of the texts; ``n_chars`` follows."""
    rows = [i for i, r in enumerate(ranges) if r]
    if rows:
        new = {i: without(texts[i].as_py(), ranges[i]) for i in rows}
        columns[text] = _with_values(columns[text], new)
        if "n_chars" in schema.names:
            at = schema.names.index("n_chars")
            columns[at] = _with_values(columns[at], {i: len(t) for i, t in new.items()})
    return pa.RecordBatch.from_arrays(columns[: len(schema.names)], names=schema.names)


def _with_values(column: pa.Array, new: dict) -> pa.Array:
    values = column.to_pylist()
    for i, value in new.items():
        values[i] = value
    return pa.array(values, column.type)


def _with_text(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The batch and, as its last column, its texts without nulls."""
    text = batch.column(at).cast(pa.string()).fill_null("")
    return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "whole text"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document. Repeated rows give a
    row each; a null doc_id stays null; other columns are not looked at; with an empty benchmark
    nothing is hit."""
    found = mark(bodies(docs), benchmark, "spans", "items", "n_words", window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the passages that the benchmark has: each span is cut from the first
    character of its first word to the last of its last one, and ``n_chars`` follows. Texts without a
    span stay as they are, also null ones; every document stays, and so do all columns."""
    spans, items, n_words = (f"{name}_{uuid.uuid4().hex}" for name in ("spans", "items", "words"))
    return mark(docs, benchmark, spans, items, n_words, window, cut=True)


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for a, b in ranges:
        kept.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return "".join((*kept, text[last:]))
