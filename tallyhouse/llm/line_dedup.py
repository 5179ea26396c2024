"""Fuzzy line dedup by MinHash of character shingles.

A line's shingles fall into bins by hash, and the least hash of each bin is its signature; an empty bin
borrows from the next one. Lines that agree in all bins of a band are candidates. A task first joins
the candidates among its own lines, so of each band key only one line per task is shuffled however
many lines share it. Candidates are verified on their whole shingle sets, and links are closed by a
distributed union-find. Then all lines of a band key that are still in different parts are compared in
blocks, block against block, so every pair that shares a band is verified or connected. Of each
component the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.graph import components, groups, met
from tallyhouse.llm.near_dedup import mixed
from tallyhouse.llm.texts import slices, whole_text, work_table

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
#: Band rows that a task holds before it joins what it has and starts afresh.
HELD = 2_000_000
#: Lines of a band key that are compared at a time, and shingles that a task holds while it compares them.
BLOCK, HELD_SHINGLES = 4096, 4_000_000
#: 64-bit words of an outline.
WORDS = 32
_SPACE = " \t\n\x0b\f\r"
_BASE = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(2**64 - 1)
SPARK_SEED = 42


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def shingle_hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of the ``size`` (a power of two) code points that begin at each place."""
    value, width = codes.astype(np.uint64), 1
    value += np.uint64(1)
    while width < size:
        longer = value[:-width] * _powers(width)
        longer += value[width:]
        value, width = longer, 2 * width
    return _mixed_here(value)


def _mixed_here(value: np.ndarray) -> np.ndarray:
    """``mixed`` in place: one array beside the values and not one a step."""
    moved = value >> np.uint64(30)
    value ^= moved
    value *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(value, np.uint64(27), out=moved)
    value ^= moved
    value *= np.uint64(0x94D049BB133111EB)
    np.right_shift(value, np.uint64(31), out=moved)
    value ^= moved
    return value


def line_signatures(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The lines of all texts, and the least hash per line and bin."""
    whole = "\n".join(texts)
    lines = whole.split("\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + 1) - sizes - 1
    least = np.full(len(lines) * BINS, _EMPTY, np.uint64)
    long = np.flatnonzero(sizes >= SHINGLE)
    if len(long):
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        value = shingle_hashes(codes)
        counts = sizes[long] - SHINGLE + 1
        owner = np.repeat(long, counts)
        first = np.cumsum(counts) - counts
        value = value[np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(starts[long], counts)]
        place = ((value >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64) + owner * BINS
        np.minimum.at(least, place, value)
    for i in np.flatnonzero(sizes < SHINGLE).tolist():  # a shorter line is one shingle
        value = xxhash.xxh3_64_intdigest(lines[i].encode())
        least[i * BINS + (value >> 32) * BINS // 2**32] = value
    return lines, _densified(least.reshape(len(lines), BINS))


def _densified(least: np.ndarray) -> np.ndarray:
    rows = np.flatnonzero((least == _EMPTY).any(1))
    if len(rows):
        part = least[rows]
        filled = np.where(np.tile(part, (1, 2)) != _EMPTY, np.arange(2 * BINS), 4 * BINS)
        after = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        steps = (after - np.arange(BINS)).astype(np.uint64)
        least[rows] = np.take_along_axis(part, after % BINS, 1) + steps * np.uint64(_BASE)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(least), b + 1, np.uint64)
        for r in range(ROWS):
            value = mixed(value * _powers(1) + least[:, b * ROWS + r])
        keys[:, b] = value
    return keys.view(np.int64)


def _joined(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Of lines and their keys (line, band): one row (key, node) per distinct key, and a row (key, node, other) for every pair of a line with the
    first and with the previous line of its key; no rows for no keys."""
    if not len(keys):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["key", "node", "other"])
    nodes, one = np.unique(nodes, return_index=True)
    keys, nodes = keys[one].ravel(), np.repeat(nodes, BANDS)
    order = np.argsort(keys, kind="stable")  # lines stay in order within a key
    keys, nodes = keys[order], nodes[order]
    head = np.r_[True, keys[1:] != keys[:-1]]
    lead = nodes[head][np.cumsum(head) - 1]
    member = np.flatnonzero(~head)
    a, b = np.r_[nodes[member], nodes[member]], np.r_[lead[member], nodes[member - 1]]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    pairs = np.stack((a, b), 1)[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]]
    spread = mixed(pairs[:, 0].astype(np.uint64)).view(np.int64)
    other = pa.concat_arrays([pa.nulls(int(head.sum()), pa.int64()), pa.array(pairs[:, 1], pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((keys[head], spread))), pa.array(np.concatenate((nodes[head], pairs[:, 0]))), other],
        names=["key", "node", "other"])


def _candidates(docs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of lines, by hash, that share a band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for part in slices(batches, most=1 << 20):
            lines, least = line_signatures(part["text"].to_pylist())
            found = np.array([xxhash.xxh64_intdigest(x, SPARK_SEED) for x in lines], np.uint64).view(np.int64)
            found, one = np.unique(found, return_index=True)
            used = np.array([lines[i].strip(_SPACE) != "" for i in one.tolist()], bool)  # blank lines are kept
            found, one = found[used], one[used]
            keys.append(band_keys(least[one]))
            nodes.append(found)
            held += keys[-1].size
            if held > HELD:
                yield _joined(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, held = [], [], 0
        if keys:
            yield _joined(np.concatenate(keys), np.concatenate(nodes))

    rows = docs.select(whole_text().alias("text")).mapInArrow(run, "key bigint, node bigint, other bigint")
    by_key = Window.partitionBy("key").orderBy("node")
    rep = F.when(F.col("other").isNull(), F.col("node"))
    # in the order of the nodes the least so far is the least of all: one sort, and no key is held whole
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = rows.select("node", "other", F.min(rep).over(so_far).alias("first"), F.lag(rep).over(by_key).alias("before"))
    first, before = F.when(F.col("other").isNull(), F.col("first")), F.when(F.col("other").isNull(), F.col("before"))
    return (shared.where("other IS NOT NULL OR first <> node OR before <> node")
            .select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("other", first, before))).alias("b"))
            .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _grams(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard(x: str, y: str, size: int = SHINGLE) -> float:
    """Jaccard of the sets of runs of ``size`` characters; a shorter line is one run."""
    a, b = _grams(x, size), _grams(y, size)
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def outlines(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set of hashes a row of bits, each element at one of them."""
    bits = np.zeros((len(starts) - 1, 64 * WORDS), bool)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    bits[owner, (sets >> np.uint64(64 - (64 * WORDS).bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def may_be_alike(bits_a, sizes_a, bits_b, sizes_b, similarity: float) -> np.ndarray:
    """Whether sets with these outlines can be alike. A bit of one that the other has not is an element that the other has
    not, so this rules out pairs that are not alike and no others."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64)
    common = np.minimum(sizes_a - only_a, sizes_b - only_b)
    return common >= similarity * (sizes_a + sizes_b - common) - 1e-9


def _outline_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _outlined(lines: DataFrame) -> DataFrame:
    """Lines (node, line) with the number of their shingles and their outline."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "line", most=1 << 20):
            sets, starts = shingle_sets(part["line"].to_pylist())
            bits = [row.tobytes() for row in outlines(sets, starts)]
            yield pa.RecordBatch.from_arrays([part["node"], part["line"], pa.array(np.diff(starts)), pa.array(bits, pa.binary())],
                                             names=["node", "line", "size", "outline"])

    return lines.select("node", "line").mapInArrow(run, "node bigint, line string, size bigint, outline binary")


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of lines that are alike: first those whose outlines allow it, then those whose shingles confirm it."""
    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_outline_of(batch[c]) for c in ("ox", "oy"))
                m, n = (batch[c].to_numpy() for c in ("sx", "sy"))
                yield batch.select(["a", "b"]).filter(pa.array(may_be_alike(x, m, y, n, similarity)))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "x", most=1 << 20):
                yield part.select(["a", "b"]).filter(pa.array(alike(part["x"].to_pylist(), part["y"].to_pylist(), similarity)))

    def side(node, **names):
        return lines.select(F.col("node").alias(node), *[F.col(c).alias(x) for c, x in names.items()])

    some = pairs.join(side("a", size="sx", outline="ox"), "a").join(side("b", size="sy", outline="oy"), "b")
    some = some.select("a", "b", "sx", "sy", "ox", "oy").mapInArrow(allowed, "a bigint, b bigint")
    return some.join(side("a", line="x"), "a").join(side("b", line="y"), "b").select("a", "b", "x", "y").mapInArrow(
        confirmed, "a bigint, b bigint")


def _split(lines: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between outlined lines of different parts that share a band, enough to connect all."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "line", most=1 << 20):
            least = line_signatures(part["line"].to_pylist())[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(band_keys(least).ravel()), pa.array(np.repeat(part["node"].to_numpy(), BANDS))], names=["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, ["key", "u", "v"]):
            links = linked(block, similarity)
            if links:  # most blocks are small and have none: no batch for those
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = lines.select("node", "line").mapInArrow(keyed, "key bigint, node bigint").join(roots, "node", "left")
    rows = work_table(rows.select("key", "node", F.coalesce("root", "node").alias("root")), "bands")
    # two lines of a key have been compared
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met(rows, BLOCK, lines, least=3, tasks=tasks).mapInArrow(run, "a bigint, b bigint")


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all lines, line by line, and where each line's begin, with the end appended."""
    whole = "\n".join(lines)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = np.maximum(sizes - SHINGLE + 1, 1)  # a shorter line is one shingle
    ends = np.cumsum(counts)
    firsts = ends - counts
    short = np.flatnonzero(sizes < SHINGLE)
    value = np.empty(int(counts.sum()), np.uint64)
    if len(short) < len(lines):
        at = np.arange(len(value)) + np.repeat(starts - firsts, counts)
        hashes = shingle_hashes(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
        at[firsts[short]] = 0
        value = hashes[at]
    value[firsts[short]] = [xxhash.xxh3_64_intdigest(lines[i].encode()) for i in short.tolist()]
    _sort_within(value, firsts, ends)
    new = _unlike_before(value, firsts)
    return value[new], np.r_[0, np.cumsum(new)[ends - 1]]


def _sort_within(value: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> None:
    """Sort each stretch in place; many short sorts are a tenth of one sort by stretch and value."""
    for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
        value[a:b].sort()


def _unlike_before(value: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it in its sorted stretch."""
    new = np.ones(len(value), bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    new[firsts] = True
    return new


def alike(x: list[str], y: list[str], similarity: float) -> np.ndarray:
    """Whether the Jaccard of the shingles of each pair of lines is at least ``similarity``."""
    (a, at), (b, bt) = shingle_sets(x), shingle_sets(y)
    m, n = np.diff(at), np.diff(bt)
    ends = np.cumsum(m + n)
    both, firsts = np.empty(len(a) + len(b), np.uint64), ends - m - n
    both[np.arange(len(a)) + np.repeat(firsts - at[:-1], m)] = a
    both[np.arange(len(b)) + np.repeat(firsts + m - bt[:-1], n)] = b
    _sort_within(both, firsts, ends)
    again = np.r_[0, np.cumsum(~_unlike_before(both, firsts))]
    common = again[ends] - again[firsts]
    return common / (m + n - common) >= similarity


def linked(block: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between lines of different parts of a block, a left and a right one, that are alike, enough to connect them. Shingles are
    made only of lines with an outline that allows it, and held up to HELD_SHINGLES."""
    node, part = block["node"].to_numpy(), block["root"].to_numpy().copy()
    left, right = (block[c].to_numpy() for c in ("left", "right"))
    bits, sizes, lines = _outline_of(block["outline"]), block["size"].to_numpy(), block["line"]
    sets: dict[int, np.ndarray] = {}
    held = 0

    def shingles(k: int) -> np.ndarray:
        nonlocal held
        if k not in sets:
            if held > HELD_SHINGLES:
                sets.clear()
                held = 0
            sets[k] = shingle_sets([lines[k].as_py()])[0]
            held += len(sets[k])
        return sets[k]

    links: list[tuple[int, int]] = []
    order = np.arange(len(node))
    for i in np.flatnonzero(left).tolist():
        # of two lines that are both left and right, the earlier tests the pair
        other = np.flatnonzero(right & (part != part[i]) & ~(left & right[i] & (order < i)))
        if not len(other):
            continue
        near = other[may_be_alike(bits[i], sizes[i], bits[other], sizes[other], similarity)]
        for j in near.tolist():
            if part[i] != part[j]:
                a, b = shingles(i), shingles(j)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common / (len(a) + len(b) - common) >= similarity:
                    links.append((int(node[i]), int(node[j])))
                    part[part == part[j]] = part[i]
    return links


def _document() -> tuple[Column, Column]:
    """What tells documents apart: the id, and the text's hash where ids repeat or are null."""
    return F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash")


def _lines() -> Column:
    return F.split(whole_text(), "\n", -1)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, node, line) of every line with a character that is not white space."""
    return (docs.select(*_document(), F.posexplode(_lines()).alias("line_no", "line"))
            .where(F.col("line").rlike(r"\S")).withColumn("node", F.xxhash64("line")))


def line_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, line_no, kept) of every line that is not blank: whether it is the first of its
    component, by doc_id (null last), text hash and line number."""
    pairs = work_table(_candidates(docs), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = occurrences(docs).select("node", "line").join(ends, "node", "left_semi")
    texts = work_table(_outlined(texts.groupBy("node").agg(F.first("line").alias("line"))), "lines")
    links = work_table(_verified(pairs, texts, similarity), "links")
    roots = work_table(components(links), "roots")
    more = work_table(_split(texts, roots, similarity), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    rows = work_table(occurrences(docs).select("doc_id", "text_hash", "line_no", "node"), "occurrences")
    rows = rows.join(roots, "node", "left").select(
        "doc_id", "text_hash", "line_no", F.coalesce("root", "node").alias("root"),
        F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "line_no").alias("place"))
    # stored, so that the join below reads both sides from plain shuffles, and a frequent line is split
    first = work_table(rows.groupBy("root").agg(F.min("place").alias("first")), "first")
    return rows.join(first, "root").select(
        "doc_id", "text_hash", "line_no", F.col("place").eqNullSafe(F.col("first")).alias("kept"))


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, any_kept, removed): whether a line that is not blank stays, and the numbers of those to remove, of
    every document that has any to remove."""
    gone = F.when(~F.col("kept"), F.col("line_no").cast("bigint"))
    return line_classes(docs, similarity).groupBy("doc_id", "text_hash").agg(
        F.bool_or("kept").alias("any_kept"), F.array_sort(F.collect_set(gone)).alias("removed")).where("size(removed) > 0")


def _same() -> list[Column]:
    return [F.col("x.text_hash") == F.col("y.text_hash"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))]


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines (from 0) of every document.

    Blank lines are never removed. A null or empty text has no lines. Repeated rows (equal doc_id and
    text) are one document and each show its result. Other columns are not looked at.
    """
    n_lines = F.when(whole_text() == "", F.lit(0)).otherwise(F.size(_lines())).cast("bigint").alias("n_lines")
    every = docs.select(*_document(), n_lines).alias("x")
    found = every.join(removals(docs, similarity).alias("y"), _same(), "left")
    removed = F.coalesce("y.removed", F.array().cast("array<bigint>"))
    return found.select("x.doc_id", "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that repeat an earlier one, with all their columns; ``n_chars``
    follows the text. A document that loses every line that is not blank goes; one that had none stays."""
    keyed = docs.select(F.struct("*").alias("row"), *_document(), whole_text().alias("text")).alias("x")
    found = keyed.join(removals(docs, similarity).alias("y"), _same(), "left").where(
        "removed IS NULL OR any_kept")
    kept = F.filter(F.split("x.text", "\n", -1), lambda _, i: ~F.array_contains("removed", i.cast("bigint")))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    found = found.select("row", "removed", text.alias("new_text"))
    columns = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(
            F.length("new_text")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
