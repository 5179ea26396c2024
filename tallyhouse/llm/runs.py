"""Periodic runs of words by online dyadic square catching.

Words arrive as a stream. Whenever a block of W words is complete, W a power of two and the block at a multiple of W,
it becomes a catcher for the periods p with W/2 <= p < W. Each word that is appended ends a suffix of W words;
a suffix that equals the block and begins p words after it completes a square of root p. A block also looks
back, at the suffixes that ended before it. Suffixes are compared by hashes that are doubled from level to level,
for all catchers of a level and a whole slice of documents at once.

A run of period p with at least four periods holds a catcher of its level, with p words to spare on one side, and
there the nearest equal suffix is exactly p words away; so each catcher has one square per side to report, and
no run is missed. A square is then extended word by word, which also confirms it, and squares of one
run merge: a later square inside what was extended with its period is not extended again. What is extended adds up to
the length of the runs found, and every level takes a few passes: n log n for n words, however periodic they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.near_dedup import mixed
from tallyhouse.llm.texts import bodies, slices, whole_text

#: Shortest run in words, and in periods; the catchers need no less than four periods.
SHORTEST, PERIODS = 6, 4
_FIRST = np.uint64(0xC2B2AE3D27D4EB4F)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Numbers(dict):
    """Numbers of words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _caught(words: np.ndarray, reach: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Squares by level, for blocks of 2, 4, 8 ... words: where a catcher begins, and the distance of the equal suffix,
    negative before it. Of level k the first ``reach[k]`` words belong to documents that are long enough for it."""
    value, half = words.astype(np.uint64), 1
    for n in reach:
        value = value[: n - half + 1]
        if len(value) <= half:
            return
        # a hash of twice as many words from those of both halves; mixed, so that no text is made to undo it
        value = mixed(value[:-half] * _FIRST + value[half:])
        width = 2 * half
        grid = np.zeros(-(-len(value) // width) * width, np.uint64)
        grid[: len(value)] = value
        grid = grid.reshape(-1, width)
        head = grid[:, :1]
        later = grid[:, 1:] == head  # suffixes that begin within the block
        earlier = grid[:-1, :0:-1] == head[1:]  # and within the block before it, from the end
        for block, same, first, sign in ((0, later, 1, 1), (1, earlier, 1, -1)):
            hit = np.flatnonzero(same.any(1))
            near = same[hit].argmax(1) + first
            used = near >= half  # nearer ones have their own level
            yield (hit[used] + block) * width, sign * near[used]
        half = width


def _extended(words: np.ndarray, x: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch [a, b) of words within [low, high) that holds x and x + p and has period p; empty if these differ."""
    if words[x] != words[x + p]:
        return x, x
    right, step = x + 1, 64
    while right + p < high:
        stop = min(right + step, high - p)
        differ = words[right:stop] != words[right + p : stop + p]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = stop, 4 * step
    left, step = x, 64
    while left > low:
        stop = max(low, left - step)
        differ = (words[stop:left] != words[stop + p : left + p])[::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left, step = stop, 4 * step
    return left, right + p


def runs_of(words: np.ndarray, at: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of every document, by start and period. ``words`` are the numbers of the
    words of all documents, ``at`` where a document begins among them, with the end appended."""
    if periods < 4:
        raise ValueError("the catchers find runs of four periods or more")
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    words = words[np.arange(len(words)) + np.repeat(at[:-1][order] - starts, sizes)]
    # the long documents come first: a level of blocks of W words is for periods from W / 2 on, so for 2 W words at least
    reach, least = [], 4
    while len(sizes) and sizes[0] >= least:
        reach.append(int(ends[np.searchsorted(-sizes, -max(shortest, least), "right") - 1]) if sizes[0] >= shortest else 0)
        least *= 2
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for where, gaps in _caught(words, reach):
        last: dict[int, tuple[int, int]] = {}
        owners = np.searchsorted(ends, where, "right")
        for x, p, doc in zip(where.tolist(), gaps.tolist(), owners.tolist(), strict=True):
            if p < 0:
                x, p = x + p, -p
            low, high = int(starts[doc]), int(ends[doc])
            a, b = last.get(p, (x, x))
            if x < low or x + p >= high or (a <= x and x + p < b):
                continue
            last[p] = a, b = _extended(words, x, p, low, high)
            if b - a >= max(shortest, periods * p):
                found[doc].append((a - low, b - a, p))
    out = [[] for _ in sizes]
    for doc, runs in zip(order.tolist(), found, strict=True):
        out[doc] = sorted(set(runs), key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, all in words, by start and period) and collapsed of every document.

    Words are runs of characters other than space and the control characters 9 to 13. A run is a longest stretch
    with a smallest period, of ``shortest`` words and ``periods`` periods at least. ``collapsed`` is the text with one
    period of every run: words that a run holds after its first period go, and words are joined by one space. A null text has no
    words; a document without runs has an empty array. Repeated rows have the same result each. Other columns are not
    looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.split() for t in part["text"].cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            numbers = _Numbers()
            words = np.concatenate([np.empty(0, np.int64), *(np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts)])
            runs = runs_of(words, np.concatenate(([0], np.cumsum(sizes))), shortest, periods)
            flat = [r for x in runs for r in x]
            rows = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, runs)]).astype(np.int32), rows)
            collapsed = pa.array(list(map(_collapsed, texts, runs)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes), lists.cast(_RUNS), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return bodies(docs).mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _words() -> Column:
    return F.regexp_extract_all(whole_text(), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document, by a hash of its id, repeat from some word on.

    With h the CRC-32 of the id in decimals, g = h / 10 rounded down and n words, documents with h % 10 = 0 have
    the word a + (i - a) % p of the text in every place i from a = g % n on, p = 1 + (n - a) / (3 + g % 8) rounded
    down. Others, and those without words, stay. A null id hashes like an empty one.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, _words())).withColumn("n", F.size("words").cast("bigint"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(places, lambda i: F.get("words", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with most periods (start, length, period, exponent_milli) and the hashes of all runs and of the
    collapsed text, of rows of ``find_runs``."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                       F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                       milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
