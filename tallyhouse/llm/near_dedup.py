"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Every word shingle of a document is a Poisson process whose rate is its count; its arrivals fall on
the registers of the signature, each register keeps the shingle that arrives first, and a shingle
ends as soon as its next arrival is later than every register. Two documents then agree in a
register with their probability Jaccard. A second signature, of every shingle once, agrees with the Jaccard
of the distinct shingles; both are banded.

Equal texts are one node. Nodes that share a band are compared with the band's most connected node;
nodes that remain apart are compared with those whose signatures are closest, and then with all others of
the band. A link counts once the whole shingle sets confirm it. Classes are connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.graph import components, groups, met
from tallyhouse.llm.pretokens import KEPT
from tallyhouse.llm.texts import bodies, slices, whole_text, work_table

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
BANDS, ROWS = 25, 5
#: Agreement of signatures below which nothing is verified: five standard errors under the similarity.
LOWEST = 0.62
#: Closest nodes that are tried per band before all others are, and nodes of a band that are compared at a time.
NEIGHBOURS, BLOCK = 4, 4096
#: Nodes whose pairs a task holds before it hands them on.
HELD = 64
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash by word, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct runs of ``size`` lower-cased words, and how often each occurs.
    A text of fewer words is one run; one without words has none."""
    found = text.lower().encode().translate(_LETTERS).split()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(size, len(words))
    runs = len(words) - size + 1
    value = words[:runs].copy()
    for k in range(1, size):
        value = value * _STEP + words[k : k + runs]
    return np.unique(mixed(value), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Per set of weighted elements the element that arrives first in each register (a power of two)."""
    sizes = np.array([len(s) for s, _ in sets], np.int64)
    out = np.zeros(len(sets) * registers, np.uint64)
    if not sizes.sum():
        return out.reshape(len(sets), registers)
    element = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([c for _, c in sets]).astype(float)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed = mixed(element ^ _GOLD)
    first, stride = (seed >> np.uint64(8)).astype(np.int64), (seed >> np.uint64(32)).astype(np.int64) | 1
    best = np.full(len(out), np.inf)
    time, alive, points = np.zeros(len(element)), np.arange(len(element)), []
    for k in range(registers):
        # the arrivals at all registers of one element are exponential; they come in order, each at a register not yet visited
        draw = mixed(element[alive] + np.uint64(int(_GOLD) * (k + 1) & 2**64 - 1))
        wait = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        time = time + wait / (weight[alive] * (registers - k))
        late = best.reshape(len(sets), registers).max(1)
        going = time < late[owner[alive]]
        alive, time = alive[going], time[going]
        if not len(alive):
            break
        place = owner[alive] * registers + ((first[alive] + k * stride[alive]) & (registers - 1))
        np.minimum.at(best, place, time)
        points.append((place, time, alive))
    for place, when, who in points:
        won = best[place] == when
        out[place[won]] = element[who[won]]
    return out.reshape(len(sets), registers)


def both_signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per set the signature of its counted elements and that of the distinct ones, which is the same where
    all counts are equal."""
    counted = signatures(sets)
    uneven = [i for i, (_, c) in enumerate(sets) if len(c) and c.min() < c.max()]
    plain = counted.copy()
    if uneven:
        plain[uneven] = signatures([(sets[i][0], np.ones(len(sets[i][0]), np.int64)) for i in uneven])
    return np.stack((counted, plain), 1)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per document and band."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            value = mixed(value * _STEP + signature[:, b * rows + r])
        keys[:, b] = value
    return keys.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard of two weighted sets, and Jaccard of their elements."""
    union = np.union1d(a[0], b[0])
    if not len(union):
        return 1.0, 1.0
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0, 0.0
    # sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i): the first term wins where x_j / y_j is above x_i / y_i
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    above, below = np.r_[0.0, np.cumsum(x)], np.r_[np.cumsum(y[::-1])[::-1], 0.0]
    i = np.flatnonzero((x > 0) & (y > 0))
    ends = np.searchsorted(-ratio, -ratio[i], "left")
    total = above[ends] / x[i] + below[ends] / y[i]
    return float((1.0 / total).sum()), float(both.sum() / len(union))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, keys): the text's hash and the distinct band keys of both signatures, none for a text
    without words."""
    schema = "doc_id bigint, node bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            sets = [shingles(t, size) for t in part["text"].to_pylist()]
            n = np.array([len(s) for s, _ in sets], np.int64)
            both = both_signatures(sets)
            counted, plain = band_keys(both[:, 0]), band_keys(both[:, 1])
            keys = np.concatenate((counted, plain), 1)
            own = np.concatenate((np.ones_like(counted, bool), plain != counted), 1) & (n > 0)[:, None]
            ends = np.r_[0, np.cumsum(own.sum(1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["node"], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[own]))],
                names=["doc_id", "node", "keys"])
        _WORDS.clear()  # the worker may serve other stages

    return bodies(docs, _node()).mapInArrow(run, schema)


def _node():
    return F.xxhash64(whole_text()).alias("node")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, elements, counts, sketch) of the wanted nodes, as bytes; the sketch is 16 bits of each register
    of both signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, size) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["node"], pa.array([s.tobytes() for s, _ in sets], pa.binary()),
                 pa.array([c.astype(np.uint32).tobytes() for _, c in sets], pa.binary()),
                 pa.array([r.tobytes() for r in both_signatures(sets).astype(np.uint16)], pa.binary())],
                names=["node", "elements", "counts", "sketch"])
        _WORDS.clear()

    # copies of a text are combined before they are shuffled, however many there are
    texts = docs.select(_node(), whole_text().alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    return texts.join(wanted, "node", "left_semi").mapInArrow(
        run, "node bigint, elements binary, counts binary, sketch binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike enough, with both measures."""
    schema = "a bigint, b bigint, weighted double, plain double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch, side):
            return [(np.frombuffer(e, np.uint64), np.frombuffer(c, np.uint32))
                    for e, c in zip(batch[f"e{side}"].to_pylist(), batch[f"c{side}"].to_pylist(), strict=True)]

        for batch in batches:
            found = [probability_jaccard(x, y) for x, y in zip(read(batch, "a"), read(batch, "b"), strict=True)]
            weighted, plain = (np.array([f[k] for f in found], float) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array(weighted), pa.array(plain)],
                names=["a", "b", "weighted", "plain"]).filter(pa.array(np.maximum(weighted, plain) >= similarity))

    def side(name):
        return sets.select(F.col("node").alias(name), F.col("elements").alias(f"e{name}"), F.col("counts").alias(f"c{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, schema)


def links(docs: DataFrame, signed: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between nodes that share a band, enough to connect every class.

    First every node is compared with the most central node of each of its bands. Then each node outside
    the largest part of a band is compared with the few nodes of other parts that its signature is
    closest to, and last with every node of other parts whose signature agrees enough, so that no pair
    stays untested that shares a band and has not come into one part.
    """
    # copies of a text are one node before the nodes of a key are counted
    rows = signed.select("node", "keys").distinct().select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members"))
    # stored, so that the join reads both sides from plain shuffles, and a frequent key is split
    shared = work_table(shared.where("low < high").select("key", "members"), "shared")
    rows = work_table(rows.join(shared, "key"), "bands")
    sets = work_table(_sets(docs, rows.select("node").distinct(), size), "shingles")
    banded = rows.join(sets.select("node", "sketch"), "node")
    # a key with more nodes than a block is split by node hash here; later rounds compare block against block
    block = F.pmod(F.hash("node", "key"), F.ceil(F.col("members") / BLOCK).cast("int")).alias("block")
    blocks = banded.select("key", block, "node", "sketch").repartition("key", "block").sortWithinPartitions("key", "block")
    tested = work_table(_compared(blocks, ["key", "block"], _central), "pairs")
    found = work_table(_verified(tested, sets, similarity), "links")
    near = _compared(_met(rows, found, sets.select("node", "sketch")), ["key", "u", "v"], _closest)
    pairs = work_table(near.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = found.unionByName(work_table(_verified(pairs, sets, similarity), "links"))
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))
    last = _met(rows, found, sets.join(keys, "node")).mapInArrow(_linked(similarity), "a bigint, b bigint")
    return found.select("a", "b").unionByName(work_table(last, "links"))


def _met(rows: DataFrame, found: DataFrame, more: DataFrame) -> DataFrame:
    parts = rows.drop("members").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return met(parts, BLOCK, more)


def _linked(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verified links of all pairs of different parts that meet in a block and whose signatures agree enough. A
    pair is tested under the least key that it shares, and not once links of the block connect it, so only
    links leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["key", "u", "v"]):
            key, node, part = whole["key"][0].as_py(), whole["node"].to_numpy(), whole["root"].to_numpy().copy()
            left, right = whole["left"].to_numpy(), whole["right"].to_numpy()
            keys = [set(k) for k in whole["keys"].to_pylist()]
            elements, counts = whole["elements"].to_pylist(), whole["counts"].to_pylist()
            sketch = _sketches(whole)

            def weighted(i, elements=elements, counts=counts):
                return np.frombuffer(elements[i], np.uint64), np.frombuffer(counts[i], np.uint32)

            links: list[tuple[int, int]] = []
            for i in np.flatnonzero(left).tolist():
                # of two nodes that are both left and right, the earlier tests the pair
                other = np.flatnonzero(right & (part != part[i]) & ~(left & right[i] & (np.arange(len(node)) < i)))
                agree = _agreement(sketch[other], sketch[i])
                order = np.argsort(-agree, kind="stable")
                for j in other[order[agree[order] >= LOWEST]].tolist():
                    if part[i] != part[j] and min(keys[i] & keys[j]) == key and max(
                            probability_jaccard(weighted(i), weighted(j))) >= similarity:
                        links.append((node[i], node[j]))
                        part[part == part[j]] = part[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _sketches(whole: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(whole["sketch"].to_pylist()), np.uint16).reshape(whole.num_rows, 2, REGISTERS)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _agreement(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Share of equal registers, of the counted or of the distinct elements, whichever is more."""
    return (sketch == one).mean(2).max(1)


def _central(whole: pa.Table, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every node with the one that agrees most with all, of up to 64 that are tried."""
    tried = np.unique(np.linspace(0, len(sketch) - 1, 64).astype(int))
    agree = np.stack([_agreement(sketch, sketch[i]) for i in tried])
    best = agree.sum(1).argmax()
    near = np.flatnonzero(agree[best] >= LOWEST)
    yield near, np.full(len(near), tried[best])


def _closest(whole: pa.Table, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every left node with the right nodes of other parts that agree with it most."""
    root = whole["root"].to_numpy()
    right = np.flatnonzero(whole["right"].to_numpy())
    others, parts = sketch[right], root[right]
    for i in np.flatnonzero(whole["left"].to_numpy()).tolist():
        agree = _agreement(others, sketch[i])
        near = np.flatnonzero((agree >= LOWEST) & (parts != root[i]))
        near = near[np.argsort(-agree[near], kind="stable")[:NEIGHBOURS]]
        yield np.full(len(near), i), right[near]


def _compared(blocks: DataFrame, by: list[str], choose: Callable[[pa.Table, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]
              ) -> DataFrame:
    """Pairs (a, b) that ``choose`` picks among the nodes of each block, given their rows and signatures.
    Blocks are bounded, so no task holds a whole group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, by):
            node = whole["node"].to_numpy()
            sketch = _sketches(whole)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in choose(whole, sketch):
                held.append((node[a], node[b]))
                if len(held) == HELD:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

    def batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["a", "b"])

    return _ordered(blocks.mapInArrow(run, "a bigint, b bigint"))


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node and class_id of every document; class_id is the smallest doc_id of the class.

    Texts are alike if the probability Jaccard of their counted shingles or the Jaccard of the distinct
    ones reaches ``similarity``. Equal texts are always one class, also those without words; null counts
    as empty. Repeated rows give a row each. Null doc_ids come after all others; a class that has no
    other id has class_id null. Other columns are not looked at.
    """
    signed = work_table(_signed(docs, size), "signatures")
    roots = components(links(docs, signed, size, similarity))
    rooted = signed.select("doc_id", "node").join(roots, "node", "left").select(
        "doc_id", "node", F.coalesce("root", "node").alias("root"))
    rooted = work_table(rooted, "classes")
    first = work_table(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "first")
    return rooted.join(first, "root").select("doc_id", "class_id", "class_size", "node", "root")


def dedup(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class with all its columns: that of the smallest doc_id, then of the smallest
    text hash. Of rows equal in doc_id and text one stays."""
    kept = (classes(docs, size, similarity).where("doc_id <=> class_id")
            .groupBy("root", "doc_id", "node").agg(F.count("*").alias("times"))
            .groupBy("root").agg(F.min(F.struct("node", "doc_id", "times")).alias("k")).select("k.*"))
    kept = work_table(kept, "kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), _node())
    same = [F.col("x.node") == F.col("y.node"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))]
    once = keyed.alias("x").join(kept.where("times = 1").alias("y"), same, "left_semi").select("row.*")
    if kept.where("times > 1").isEmpty():
        return once
    repeated = keyed.alias("x").join(kept.where("times > 1").alias("y"), same, "left_semi")
    return once.unionByName(repeated.groupBy("doc_id", "node").agg(F.first("row").alias("row")).select("row.*"))
