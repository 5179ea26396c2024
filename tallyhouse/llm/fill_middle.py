"""Fill-in-middle by displacement scatter.

A text is cut twice into prefix, middle and suffix, whose order in the output differs from that in the text. All
bytes of a slice of texts lie in one array. Every part moves as a whole, so the output place of a byte is its
own place plus a shift that changes at the cuts only: the changes are written into a difference array, its
cumulative sum is the shift of every byte, and one scatter builds all outputs. The way back scans the
outputs for their marks, finds the shifts in the same way, and one gather reads the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.llm.texts import bodies, flat_bytes, slices

#: Marks of prefix, suffix and middle: three ASCII characters each, told apart by the one between the brackets.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Percent of texts that stay as they are, and of the others that are written suffix first.
PLAIN, SPM = 10, 20
SEED = 1
_FORMS = np.array(["plain", "psm", "spm"])
_PLAIN, _PSM, _SPM = 0, 1, 2
#: Parts (0 prefix, 1 middle, 2 suffix) and the letters of their marks in the order of the output.
_ORDER = {_PSM: (0, 2, 1), _SPM: (2, 0, 1)}
_LETTER = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and doc_id; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def _marks(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a mark begins among bytes, and its letter."""
    at = np.flatnonzero((flat[:-2] == 60) & (flat[2:] == 62)) if len(flat) >= MARK else np.empty(0, np.int64)
    letters = flat[at + 1]
    known = np.isin(letters, [m[1] for m in _LETTER.values()])
    return at[known], letters[known]


def _owners(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, places, "right") - 1


def _shifts(size: int, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The shift of every one of ``size`` bytes: ``moves`` of the last part that starts at or before it."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(moves, prepend=0))
    return np.cumsum(change[:-1])


def scattered(flat: np.ndarray, at: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of texts (``flat`` bytes between the places ``at``) that are cut at the two places ``cuts``
    each and written in ``forms``; all outputs in one array, and where each begins, with the end appended."""
    sizes = np.diff(np.concatenate((at[:-1, None], cuts, at[1:, None]), axis=1), axis=1)
    to = np.concatenate(([0], np.cumsum(np.diff(at) + np.where(forms == _PLAIN, 0, 3 * MARK))))
    begin = np.concatenate((at[:-1, None], cuts), axis=1)
    moves = np.repeat((to[:-1] - at[:-1])[:, None], 3, 1)
    out = np.empty(to[-1], np.uint8)
    for form, order in _ORDER.items():
        rows = np.flatnonzero(forms == form)
        place = to[rows].copy()
        for part in order:
            for k, byte in enumerate(_LETTER[part]):
                out[place + k] = byte
            place += MARK
            moves[rows, part] = place - begin[rows, part]
            place += sizes[rows, part]
    shift = _shifts(len(flat), begin.ravel(), moves.ravel())
    out[np.arange(len(flat)) + shift] = flat
    return out, to


def gathered(flat: np.ndarray, at: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs, from the outputs and their forms alone; the inverse of ``scattered``."""
    places, letters = _marks(flat)
    owner = _owners(at[:-1], places)
    used = forms[owner] != _PLAIN
    places, letters, owner = places[used], letters[used], owner[used]
    moved = np.flatnonzero(forms != _PLAIN)
    if len(places) != 3 * len(moved) or not np.array_equal(owner, np.repeat(moved, 3)):
        raise ValueError("an output does not hold its three marks")
    places = places.reshape(-1, 3)
    want = np.array([[_LETTER[p][1] for p in _ORDER[f]] for f in forms[moved].tolist()], np.uint8).reshape(-1, 3)
    if not np.array_equal(letters.reshape(-1, 3), want) or not np.array_equal(places[:, 0], at[moved]):
        raise ValueError("the marks of an output are not in the order of its form")
    sizes = np.diff(np.concatenate((places, at[moved + 1][:, None]), axis=1), axis=1) - MARK
    to = np.concatenate(([0], np.cumsum(np.diff(at) - np.where(forms == _PLAIN, 0, 3 * MARK))))
    starts, moves = np.empty((len(forms), 3), np.int64), np.empty((len(forms), 3), np.int64)
    starts[:], moves[:] = to[:-1, None], (at[:-1] - to[:-1])[:, None]
    for form, order in _ORDER.items():
        rows = np.flatnonzero(forms[moved] == form)
        doc, place = moved[rows], to[moved[rows]].copy()
        for part in range(3):
            k = order.index(part)
            starts[doc, part] = place
            moves[doc, part] = places[rows, k] + MARK - place
            place += sizes[rows, k]
    shift = _shifts(int(to[-1]), starts.ravel(), moves.ravel())
    return flat[np.arange(to[-1]) + shift], to


def _strings(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(
        np.ascontiguousarray(flat))]).cast(pa.string())


def _cut(part: pa.RecordBatch, plain: int, spm: int) -> pa.RecordBatch:
    flat, at = flat_bytes(part["text"])
    h1, h2, h3, h4 = (part[f"h{k}"].to_numpy() for k in (1, 2, 3, 4))
    begins = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # of code points
    first = np.searchsorted(begins, at)
    n = np.diff(first)
    marked = np.zeros(len(n), bool)
    places, _ = _marks(flat)
    owner = _owners(at[:-1], places)
    marked[owner[places + MARK <= at[owner + 1]]] = True
    forms = np.where((n == 0) | marked | (h3 % 100 >= 100 - plain), _PLAIN, np.where(h4 % 100 < spm, _SPM, _PSM))
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    is_plain = forms == _PLAIN
    cuts = begins[np.stack((first[:-1] + low, first[:-1] + high), 1)]
    cuts[is_plain] = at[1:][is_plain, None]
    out, to = scattered(flat, at, cuts, forms)
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], pa.array(n), pa.array(_FORMS[forms]), pa.array(low, mask=is_plain), pa.array(high - low, mask=is_plain),
         _strings(out, to)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every document.

    The cuts and the form of a text depend on the seed and its id alone, so that reruns and repeated rows agree.
    ``plain`` percent of the texts, empty ones and those that hold a mark stay plain: output is the text, and the two
    lengths are null. A null text is empty. Parts may be empty. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _cut(part, plain, spm)

    return bodies(docs, *draws(seed)).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, form, output, others) of ``fill_in_middle`` with ``text``, rebuilt from output and form. An output
    whose marks are not those of its form is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "output"):
            forms = np.select([np.asarray(part["form"]) == f for f in _FORMS], range(3))
            texts = _strings(*gathered(*flat_bytes(part["output"]), forms))
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    found = restore(rows)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("text", 256).alias("restored_sha256"))
