"""Passages that repeat anywhere in the corpus, by suffix arrays with common-prefix interval trees.

Every string of ``LENGTH`` bytes has one anchor: the least hash among its runs of ``GRAM`` bytes, the last
of equal ones. Equal strings have equal anchors at the same place, so a repeat can only be found among
the stretches that share an anchor. A stretch is all bytes of consecutive strings with one anchor.

1. Anchors are counted over the corpus, combined before they are shuffled. Most occur once: nothing
   there repeats.
2. Stretches equal in all their bytes (by 128 bits of hash) repeat whole, however many there are.
3. Where an anchor has several different stretches, each different one goes with its bytes to the
   task of its anchor. There a suffix array of the strings' starts is cut into intervals of common
   prefixes; a scan with a stack walks the tree of intervals, and those whose occurrences follow
   different bytes are the maximal repeats, with all their occurrences. An anchor with more than
   ``CROWD`` different stretches is not put into one task: its strings are counted by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.line_dedup import _powers
from tallyhouse.llm.near_dedup import mixed
from tallyhouse.llm.texts import bodies, flat_bytes, slices, whole_text, work_table

LENGTH = 200
GRAM = 40
CROWD = 20_000
#: Bytes of stretches that a task indexes at a time, unless one anchor has more.
INDEXED = 2 << 20
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 8 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place."""
    value, width, eight = data.astype(np.uint64) + np.uint64(1), 1, None
    while width < 32:
        value = value[:-width] * _powers(width) + value[width:]
        width *= 2
        if width == GRAM - 32:
            eight = value
    return mixed(value[: len(data) - GRAM + 1] * _powers(GRAM - 32) + eight[32 : 32 + len(data) - GRAM + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor place, first and last start, anchor hash) of every stretch of texts that lie end to end."""
    starts = np.ones(len(data), bool)
    for end in begins[1:].tolist():
        starts[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(starts[: max(0, len(data) - LENGTH + 1)])
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    value = gram_hashes(data)
    packed = (value & ~_PLACE) | (_PLACE - np.arange(len(value), dtype=np.uint64))
    place = (_PLACE - (_least(packed, LENGTH - GRAM + 1)[starts] & _PLACE)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = starts[np.r_[new[1:], len(starts)] - 1]
    return place[new], starts[new], last, value[place[new]]


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, whole, t1, t2, start, size, left) of every stretch; ``whole`` is a hash of its bytes and of
    where the anchor lies in them."""
    schema = "anchor bigint, whole bigint, t1 bigint, t2 bigint, start bigint, size int, left int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, begins = flat_bytes(part["text"])
            t1, t2 = part["t1"].to_numpy(), part["t2"].to_numpy()
            # a text beyond one piece is alone here; its pieces overlap by the bytes of a string less one
            for at in range(0, max(1, len(data) - LENGTH + 1), _PIECE):
                piece = data[at : at + _PIECE + LENGTH - 1]
                edges = begins if len(data) <= _PIECE else np.array([0, len(piece)])
                place, first, last, anchor = stretches(piece, edges)
                left, size = place - first, last + LENGTH - first
                whole = piece.tobytes()
                digest = [xxhash.xxh3_64_intdigest(whole[a : a + n], k) for a, n, k in
                          zip(first.tolist(), size.tolist(), left.tolist(), strict=True)]
                doc = np.searchsorted(begins, first + at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)),
                     pa.array(t1[doc]), pa.array(t2[doc]), pa.array(first + at - begins[doc]),
                     pa.array(size.astype(np.int32)), pa.array(left.astype(np.int32))],
                    names=["anchor", "whole", "t1", "t2", "start", "size", "left"])

    return docs.select("t1", "t2", "text").mapInArrow(run, schema)


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(high << 32 | low, return_inverse=True)[1]


def maximal_repeats(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of every maximal repeat of at least ``LENGTH`` bytes among the texts; an
    occurrence is (text, place). A repeat is maximal if its occurrences neither all follow the same byte
    nor all precede the same."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - LENGTH + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    if len(text) < 2:
        return
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begins[text] + within
    # ranks by the first 8, 16, ... 128 bytes; two overlapping ranks order by LENGTH bytes
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    rank, width = np.unique(np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1], 8
    while width < LENGTH // 2:
        rank = _ranked(rank[: len(rank) - width], rank[width:])
        width *= 2
    key = rank[place] << 32 | rank[place + LENGTH - width]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    before = np.where(within > 0, data[place - 1].astype(np.int64), 256 + text)[order]
    diverse = (size > 1) & (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first))
    for a, n in zip(first[diverse].tolist(), size[diverse].tolist(), strict=True):
        members = [(int(text[i]), int(within[i])) for i in order[a : a + n]]
        lefts = before[a : a + n].tolist()
        yield from _intervals(texts, members, lefts)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def _intervals(texts: list[bytes], members: list[tuple[int, int]], lefts: list[int]
               ) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The intervals of one group of places that share ``LENGTH`` bytes, by a scan with a stack over the common
    prefixes of neighbours, and of these the ones whose places follow different bytes."""
    tails = sorted((texts[t][p + LENGTH :], left, (t, p)) for (t, p), left in zip(members, lefts, strict=True))
    shared = [_common(x[0], y[0]) for x, y in zip(tails, tails[1:], strict=False)] + [-1]
    stack: list[tuple[int, int]] = []  # (bytes shared after LENGTH, first place of the interval)
    for i, depth in enumerate(shared):
        begin = i
        while stack and stack[-1][0] > depth:
            deep, begin = stack.pop()
            if len({left for _, left, _ in tails[begin : i + 1]}) > 1:
                yield LENGTH + deep, [at for _, _, at in tails[begin : i + 1]]
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def covered(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per text the merged ranges that maximal repeats cover."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    for length, places in maximal_repeats(texts):
        for t, p in places:
            ranges[t].append((p, p + length))
    return [merged(r) for r in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _searched(stretch: DataFrame) -> DataFrame:
    """(anchor, whole, ranges) of stretches (anchor, whole, bytes) that are sorted by anchor within partitions."""
    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = covered([r[2] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([[{"a": a, "b": b} for a, b in f] for f in found], _RANGES)], names=["anchor", "whole", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "whole", "bytes")), strict=True):
                if held > INDEXED and row[0] != last:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held, last = held + len(row[2]), row[0]
        if rows:
            yield solve(rows)

    return stretch.mapInArrow(run, "anchor bigint, whole bigint, ranges array<struct<a: int, b: int>>")


def _counted(stretch: DataFrame) -> DataFrame:
    """The same for stretches of crowded anchors: their strings are counted by 128 bits of hash."""
    schema = "anchor bigint, whole bigint, a int, h1 bigint, h2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, whole, data in zip(*(batch[c].to_pylist() for c in ("anchor", "whole", "bytes")), strict=True):
                n = len(data) - LENGTH + 1
                digests = b"".join(xxhash.xxh3_128_digest(data[a : a + LENGTH]) for a in range(n))
                h = np.frombuffer(digests, np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, whole)), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(h[:, 0]), pa.array(h[:, 1])], names=["anchor", "whole", "a", "h1", "h2"])

    strings = stretch.mapInArrow(run, schema)
    often = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    places = F.collect_list(F.struct("a", (F.col("a") + LENGTH).alias("b")))
    return strings.join(often, ["h1", "h2"]).groupBy("anchor", "whole").agg(places.alias("ranges"))


def spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, spans) of every document: ranges of bytes, not yet merged, that together are all bytes
    covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus."""
    keyed = bodies(docs, F.xxhash64(whole_text()).alias("t1"), F.xxhash64(F.lit(1), whole_text()).alias("t2"))
    rows = work_table(_anchors(keyed), "anchors")
    often = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    # stored, so that the join below reads both sides from plain shuffles, and a frequent anchor is split
    often = work_table(often.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")), "often")
    rows = work_table(rows.join(often, "anchor"), "repeated")
    alike = rows.where("alike").select("t1", "t2", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))

    mixed_rows = rows.where("NOT alike")
    kinds = work_table(mixed_rows.groupBy("anchor", "whole").agg(F.count("*").alias("times")), "stretches")
    crowds = work_table(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowds")
    wanted = mixed_rows.groupBy("t1", "t2").agg(F.collect_set(F.struct("anchor", "whole", "start", "size")).alias("wanted"))
    held = keyed.join(wanted, ["t1", "t2"]).select("doc_id", "text", "wanted").mapInArrow(
        _cut, "anchor bigint, whole bigint, bytes binary")
    held = held.groupBy("anchor", "whole").agg(F.first("bytes").alias("bytes"))
    if crowds.isEmpty():
        found = _searched(held.repartition("anchor").sortWithinPartitions("anchor", "whole"))
    else:
        few = held.join(crowds, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "whole")
        found = _searched(few).unionByName(_counted(held.join(crowds, "anchor", "left_semi")))
    # a stretch that occurs more than once repeats whole, also if it shares no string with another one
    # stored, so that the join below reads both sides from plain shuffles, and a frequent stretch is split
    found = work_table(kinds.join(found, ["anchor", "whole"], "left"), "found")
    full = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    ranges = F.explode(F.when(F.col("times") > 1, full).otherwise(F.col("ranges"))).alias("r")
    # equal texts have the same ranges, so each text is joined once
    once = mixed_rows.select("anchor", "whole", "t1", "t2", "start", "size").distinct()
    partly = once.join(found, ["anchor", "whole"]).select("t1", "t2", "start", ranges).select(
        "t1", "t2", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))
    per_text = alike.unionByName(partly).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return keyed.join(per_text, ["t1", "t2"], "left").select("doc_id", "text", "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for part in slices(batches):
        out: list[tuple[int, int, bytes]] = []
        for text, wanted in zip(part["text"].cast(pa.binary()).to_pylist(), part["wanted"].to_pylist(), strict=True):
            out.extend((w["anchor"], w["whole"], text[w["start"] : w["start"] + w["size"]]) for w in wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
             pa.array([r[2] for r in out], pa.binary())], names=["anchor", "whole", "bytes"])


def removed(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    A null text is empty; texts under ``LENGTH`` bytes lose nothing; repeated rows repeat each other and
    give a row each; a null doc_id stays null; other columns are not looked at.
    """
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, found in zip(part["text"].cast(pa.binary()).to_pylist(), part["spans"].to_pylist(), strict=True):
                ranges = merged([(s["a"], s["b"]) for s in found or ()])
                edges = [0, *(x for r in ranges for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *columns],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return spans(docs, crowd).mapInArrow(run, schema)
