"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample: k-means splits it into BRANCHES, each of these again, until a node holds
few vectors. Every row of the table then walks down to its leaf. A query keeps a priority queue of nodes by the distance
of their centres, opens the nearest one first, and visits leaves in the order in which they come out of the queue.
How many leaves are visited is calibrated: a sample of the rows is compared with all rows, and visits are widened
until the sample finds RECALL of its true neighbours.

Nearness is the inner product. The tree is over vectors with one more component, sqrt(M^2 - |x|^2) for the largest norm M,
under which the nearest vector to (query, 0) is the one with the largest inner product.

Equal vectors are one entry with its smallest ids: no more than those can be among the nearest. Leaves are
packed into shards of about SHARD bytes, a larger leaf into several; a query goes once to every shard with
a leaf that it visits, and the queries of a shard that many visit are dealt to several tasks. A task holds one shard
and a batch of queries at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.texts import smallest, work_table

#: Neighbours of a query, and the share of the true ones that the calibration sample has to find.
K, RECALL = 20, 0.97
#: Children of a node, rows of a leaf, and leaves at most (more rows make larger leaves, not a larger tree).
BRANCHES, LEAF_ROWS, LEAVES = 8, 256, 4096
#: The fit sample: bytes at most, and vectors a leaf. Vectors of the calibration sample.
FIT_BYTES, FIT_ROWS, CALIBRATION = 32 << 20, 32, 200
#: Bytes of vectors in a shard, and queries that a task compares with a shard.
SHARD, QUERIES = 2 << 20, 65_536
#: Queries that are compared at a time.
BATCH = 1024


@dataclass
class Tree:
    """Centres (of augmented vectors), the first and last child of every node (equal: a leaf), and its leaf number."""

    centres: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    norm: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that every vector reaches by the nearest centre at each node."""
        x, out = self.augmented(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.first[node] == self.last[node]:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(x[rows], self.centres[self.first[node] : self.last[node]])
            for k in np.unique(near).tolist():
                todo.append((int(self.first[node]) + k, rows[near == k]))
        return out

    def walks(self, queries: np.ndarray) -> Iterator[Iterator[int]]:
        """The leaves in the order in which each query visits them, best bin first."""
        q = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        for a in range(0, len(q), 256):
            yield from map(self._walk, _apart(q[a : a + 256], self.centres))

    def _walk(self, apart: np.ndarray) -> Iterator[int]:
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            a, b = int(self.first[node]), int(self.last[node])
            if a == b:
                yield int(self.leaf[node])
            for child, far in zip(range(a, b), apart[a:b].tolist(), strict=True):
                heapq.heappush(queue, (far, child))


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centres, but for a constant per vector."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _apart(x, centres).argmin(1)


def _split(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means of a node's vectors: centres, and which one each vector belongs to. Empty centres go."""
    centres = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sizes = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total[sizes > 0] / sizes[sizes > 0][:, None]
    return centres, _nearest(x, centres)


def grow(sample: np.ndarray, rows: int, norm: float, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES) -> Tree:
    """A tree from a sample of a table of ``rows`` vectors, so that a leaf has about ``leaf_rows`` of them."""
    rng = np.random.default_rng(11)
    wanted = min(leaves, max(1, rows // leaf_rows))
    most = max(len(sample) / wanted * 2, 2.0)
    none = np.zeros(1, np.int64)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), none, none, none, norm)
    x = tree.augmented(sample)
    centres, first, last, todo = [x.mean(0)], [0], [0], [(0, np.arange(len(x)))]
    while todo:
        node, members = todo.pop(0)
        if len(members) <= most or (x[members] == x[members[0]]).all():
            continue
        found, near = _split(x[members], rng)
        parts = [members[near == k] for k in range(len(found))]
        if sum(len(p) > 0 for p in parts) < 2:
            continue
        first[node], last[node] = len(centres), len(centres) + len(found)
        for centre, part in zip(found, parts, strict=True):
            todo.append((len(centres), part))
            centres.append(centre)
            first.append(0)
            last.append(0)
    ends = np.array(first) == np.array(last)
    leaf = np.full(len(centres), -1)
    # numbered from left to right in the tree, so that neighbouring numbers are neighbouring leaves
    stack, n = [0], 0
    while stack:
        node = stack.pop()
        if ends[node]:
            leaf[node], n = n, n + 1
        else:
            stack.extend(reversed(range(first[node], last[node])))
    return Tree(np.array(centres), np.array(first), np.array(last), leaf, norm)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def vectors(rows: DataFrame) -> DataFrame:
    """(key, vec_id, v) of the rows that take part: the id is known, and the vector has numbers only, one of them not zero.
    Vectors take part if they are as long as most are (of equally frequent lengths the longest). The key is a hash of the vector."""
    of = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{of}>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    zero = F.lit(0.0).cast(of)  # so that there is one zero
    rows = rows.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: x + zero).alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual.n if usual else 0)).select(F.xxhash64("v").alias("key"), "vec_id", "v")


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(key, ids) of every distinct vector, with its ``k`` smallest ids in ascending order."""
    order = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select("key", "vec_id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return work_table(few.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ids")


def _sample(rows: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """The ``most`` distinct vectors with the smallest keys."""
    few = F.broadcast(smallest(ids.select("key"), "key", most))  # at most as many as are fitted
    found = rows.select("key", "v").join(few, "key").groupBy("key").agg(F.any_value("v").alias("v")).toArrow()
    return _matrix(found["v"])[np.argsort(found["key"].to_numpy())]


def _top(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of every score that may be among the ``k`` largest of its row, ties included; ``least`` is the rounding
    by which scores of a row may be off."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return np.nonzero(scores >= (edge - least)[:, None])
    return np.nonzero(np.ones(scores.shape, bool))


def _first(by: tuple[np.ndarray, ...], owner: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first rows of every owner, in the order of the keys ``by``, the first key first."""
    order = np.lexsort((*reversed(by), owner))
    mine = owner[order]
    head = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.empty(0, np.int64)
    rank = np.arange(len(mine)) - np.repeat(head, np.diff(np.r_[head, len(mine)]))
    return order[rank < k]


def _best(q: np.ndarray, x: np.ndarray, smallest_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the ``k`` entries nearest to each query, ties to the smaller id. The product of matrices finds
    what may be among them; the score is summed for each pair alone, so it does not depend on what is beside it."""
    scale = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0.0))
    a, b = _top(q @ x.T, scale * 1e-12, k)
    score = (q[a] * x[b]).sum(1)
    few = _first((-score, smallest_id[b]), a, k)
    return a[few], b[few], score[few]


def _ranks(entries: DataFrame, tree: Tree, queries: np.ndarray, k: int) -> np.ndarray:
    """For every true neighbour of the calibration queries, how many leaves are visited before its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"])
                a, b, score = _best(queries, x, np.arange(len(x)), k + 1)
                leaf = batch["leaf"].to_numpy()[b]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(score), pa.array(leaf)], names=["q", "score", "leaf"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    near = entries.mapInArrow(run, "q bigint, score double, leaf bigint").withColumn("r", F.row_number().over(order))
    # the query is an entry itself, mostly the first one
    wanted: dict[int, list[int]] = {}
    for r in near.where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("q", "leaf").collect():
        wanted.setdefault(r.q, []).append(r.leaf)
    ranks: list[int] = []
    for q, walk in enumerate(tree.walks(queries)):
        place = {leaf: n for n, leaf in enumerate(walk)} if q in wanted else {}
        ranks.extend(place[leaf] for leaf in wanted.get(q, ()))
    return np.array(ranks, np.int64)


@dataclass
class Index:
    """The tree, the entries (key, ids, v, leaf) of all distinct vectors, and the leaves that a query visits."""

    tree: Tree
    entries: DataFrame
    visits: int
    recall: float


def index(rows: DataFrame, k: int = K, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, calibration: int = CALIBRATION) -> Index:
    """Fit the tree on a sample, send every vector to its leaf, and widen the visits from one leaf on until ``calibration``
    vectors find ``recall`` of their true neighbours among all. ``rows`` are those of ``vectors``."""
    ids = _smallest_ids(rows, k + 1)
    n = ids.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    seen = rows.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("width")).first()
    width = seen.width or 1
    sample = min(FIT_BYTES // (8 * width), FIT_ROWS * min(LEAVES, max(1, n // leaf_rows)))
    sample = _sample(rows, ids, max(1, sample)) if n else np.zeros((1, width))
    tree = grow(sample, n, seen.norm or 0.0, leaf_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one = pa.array(np.unique(batch["key"].to_numpy(), return_index=True)[1])  # repeated rows
                batch = batch.take(one)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(tree.leaf_of(_matrix(batch["v"])))], names=["key", "ids", "v", "leaf"])

    first = ids.select("key", "ids", F.col("ids")[0].alias("vec_id"))
    of = rows.schema["v"].dataType.simpleString()
    entries = rows.join(first, ["key", "vec_id"]).select("key", "ids", "v").mapInArrow(
        run, f"key bigint, ids array<bigint>, v {of}, leaf bigint")
    entries = work_table(entries, "entries")
    queries = _sample(rows, ids, calibration) if n else np.empty((0, width))
    ranks = _ranks(entries, tree, queries, k) if len(queries) else np.empty(0, np.int64)
    if not len(ranks):
        return Index(tree, entries, 1, 1.0)
    within = np.cumsum(np.bincount(ranks, minlength=tree.leaves)) / len(ranks)
    visits = int(np.argmax(within >= recall)) + 1
    return Index(tree, entries, visits, float(within[visits - 1]))


def _shards(rows: np.ndarray, visits: np.ndarray, width: int) -> np.ndarray:
    """Per leaf the first shard, the number of shards, and the tasks that the queries of its shards are dealt to. Neighbouring leaves
    share a shard of about SHARD bytes; a larger leaf has several of its own."""
    most = max(1, SHARD // (8 * width))
    out = np.ones((len(rows), 3), np.int64)
    shard, held, members = 0, 0, []

    def close() -> int:
        out[members, 0] = shard
        out[members, 2] = max(1, -(-int(visits[members].sum()) // QUERIES))
        return shard + 1

    for leaf, n in enumerate(rows.tolist()):
        if members and held + n > most:
            shard, held, members = close(), 0, []
        if n > most:
            out[leaf] = shard, -(-n // most), max(1, -(-int(visits[leaf]) // QUERIES))
            shard += int(out[leaf, 1])
        else:
            members.append(leaf)
            held += n
    if members:
        close()
    return out


def _counts(rows: DataFrame, leaves: int) -> np.ndarray:
    out = np.zeros(leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # a row a leaf
        out[r.leaf] = r["count"]
    return out


def _dealt(found: Index, walks: DataFrame) -> DataFrame:
    """Entries (asks false) and queries (asks true), sorted by shard and slot, entries first. A query comes once to each shard it
    visits, with the leaves that it visits there."""
    tree, entries = found.tree, found.entries
    width = tree.centres.shape[1] - 1
    plan = _shards(_counts(entries, tree.leaves), _counts(walks.select(F.explode("leaves").alias("leaf")), tree.leaves), width)
    of = entries.schema["v"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            query, lists = batch["query"].to_numpy(), batch["leaves"]
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            leaves = lists.flatten().to_numpy().astype(np.int64)
            step = max(1, SHARD // (8 * width * max(1, len(leaves) // len(query))))
            for a in range(0, len(query), step):
                b = min(a + step, len(query))
                mine = leaves[ends[a] : ends[b]]
                owner = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
                pieces = plan[mine, 1]
                leaf, owner = np.repeat(mine, pieces), np.repeat(owner, pieces)
                shard = plan[leaf, 0] + np.arange(len(leaf)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                order = np.lexsort((leaf, shard, owner))
                leaf, owner, shard = leaf[order], owner[order], shard[order]
                head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])])
                at = pa.ListArray.from_arrays(np.r_[head, len(leaf)].astype(np.int32), pa.array(leaf.astype(np.int32)))
                slot = query[owner[head]].view(np.uint64) % plan[leaf[head], 2].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[head]), pa.array(slot.astype(np.int64)), pa.array(query[owner[head]]),
                     batch["v"].take(pa.array(owner[head])), at], names=["shard", "slot", "query", "v", "leaves"])

    asked = walks.mapInArrow(ask, f"shard bigint, slot bigint, query bigint, v {of}, leaves array<int>")
    rows = [(leaf, *map(int, p)) for leaf, p in enumerate(plan)]
    places = entries.sparkSession.createDataFrame(rows, "leaf bigint, base bigint, pieces bigint, slots bigint")
    held = entries.join(F.broadcast(places), "leaf").select(  # a row a leaf is broadcast
        (F.col("base") + F.pmod("key", "pieces")).alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot"),
        F.lit(False).alias("asks"), "key", "ids", "v", F.array(F.col("leaf").cast("int")).alias("leaves"))
    asked = asked.select("shard", "slot", F.lit(True).alias("asks"), F.col("query").alias("key"),
                         F.lit(None).cast("array<bigint>").alias("ids"), "v", "leaves")
    return held.unionByName(asked).repartition("shard", "slot").sortWithinPartitions("shard", "slot", "asks")


class _Shard:
    """The entries of a shard by leaf."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.take(pa.array(np.unique(rows["key"].to_numpy(), return_index=True)[1])).combine_chunks()
        self.ids, x = rows["ids"].combine_chunks(), _matrix(rows["v"])
        leaf = rows["leaves"].combine_chunks().flatten().to_numpy()
        least = np.array([i[0].as_py() for i in self.ids], np.int64)
        self.leaves = {}
        for name in np.unique(leaf).tolist():
            at = np.flatnonzero(leaf == name)
            self.leaves[name] = at, x[at], least[at]

    def answer(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """(query, ids, score) of the ``k`` entries nearest to each query, in the leaves that it visits."""
        q, lists = _matrix(asked["v"]), asked["leaves"]
        owner = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for name in np.unique(wanted).tolist():
            if name in self.leaves:
                at, x, least = self.leaves[name]
                rows = owner[wanted == name]
                a, b, score = _best(q[rows], x, least, k)
                found.append((rows[a], at[b], score, least[b]))
        a, b, score, least = (np.concatenate(c) for c in zip(*found, strict=True))
        few = _first((-score, least), a, k)
        return pa.RecordBatch.from_arrays(
            [asked["key"].take(pa.array(a[few])), self.ids.take(pa.array(b[few])), pa.array(score[few])], names=["query", "ids", "score"])


def _compared(dealt: DataFrame, k: int) -> DataFrame:
    """(query, ids, score): of every shard and query the ``k`` nearest entries in the leaves that the query visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ready = [], None, None
        for batch in batches:
            by = [batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "slot", "asks")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in by], axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if at != (place := (by[0][a], by[1][a])):
                    held, at, ready = [], place, None
                if not by[2][a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    ready = ready or _Shard(held)
                    for c in range(a, b, BATCH):
                        yield ready.answer(batch.slice(c, min(BATCH, b - c)), k)

    return dealt.mapInArrow(run, "query bigint, ids array<bigint>, score double")


def nearest(found: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, near): of every query (query, v) up to ``k`` nearest ids with their scores (score, vec_id), nearest first."""
    tree, visits = found.tree, found.visits

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                leaves = [list(islice(w, visits)) for w in tree.walks(_matrix(part["v"]))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["query", "v", "leaves"])

    of = queries.schema["v"].dataType.simpleString()
    walks = work_table(queries.select("query", "v").mapInArrow(walk, f"query bigint, v {of}, leaves array<int>"), "walks")
    rows = _compared(_dealt(found, walks), k).select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    near = F.array_sort(F.collect_list(F.struct("r", "vec_id", "score")))
    return rows.groupBy("query").agg(near.alias("near"))


def search(rows: DataFrame, asks: Column, k: int = K, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row (vec_id, embedding) for which ``asks`` (of vec_id)
    holds, by the largest inner product in double precision, ties to the smaller vec_id.

    Rows without an id take no part, nor do vectors that are null, empty or zero, hold null or non-finite components, or are of
    another length than most. Repeated rows (equal id and vector) count once. Rows of one id with different vectors are
    candidates and queries each; a query never lists its own id, so one of these may list fewer than ``k``. Equal
    vectors are told by a 64-bit hash. Tables without such a row give no rows. Other columns are not looked at.
    """
    rows = vectors(rows)
    found = index(rows, k, recall, leaf_rows)
    asking = work_table(rows.where(asks).groupBy("key", "vec_id").agg(F.any_value("v").alias("v")), "asking")
    queries = asking.groupBy(F.col("key").alias("query")).agg(F.any_value("v").alias("v"))
    # stored, so that the join reads plain tables, and a vector that many rows ask for is split
    near = work_table(nearest(found, queries, k + 1), "near")
    rows = asking.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(near, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = rows.select("query_id", F.posexplode(others).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
