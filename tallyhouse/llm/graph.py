"""Connected components of links between nodes, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.texts import work_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node of the component.

    Distributed union-find: each task first joins the links of its own partition, so a node is left with
    one link per task however many it had. Then large and small stars (Kiveris et al. 2014) alternate,
    which hang the larger of a node's neighbours, then the smaller, onto its smallest neighbour, until
    every node has one link, to a root; the number of rounds grows with the logarithm of the longest
    path. Minima are combined before they are shuffled. Each round is stored in the shared folder.
    """
    star = work_table(_joined(links), "links")
    while not _settled(star):
        star = work_table(_joined(_small_star(_large_star(star))), "links")
    star = star.distinct()
    roots = star.select(F.col("b").alias("node")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


def _joined(links: DataFrame) -> DataFrame:
    """Per partition: each node with the smallest node that the partition's links connect it to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in up if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _large_star(star: DataFrame) -> DataFrame:
    both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(star: DataFrame) -> DataFrame:
    least = star.groupBy("a").agg(F.min("b").alias("m"))
    moved = star.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _settled(star: DataFrame) -> bool:
    """Whether every node has one link and no root has any."""
    none = F.lit(None).cast("bigint")
    ends = star.select(F.col("a").alias("node"), "b").unionByName(star.select(F.col("b").alias("node"), none.alias("b")))
    seen = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("root"))
    return seen.where("low <> high OR root AND low IS NOT NULL").isEmpty()


def met(rows: DataFrame, most: int, more: DataFrame, least: int = 2, tasks: int | None = None) -> DataFrame:
    """Distinct rows (key, node, root), with the columns of ``more`` by node, dealt to blocks (key, u, v), so that any two nodes of a key that have
    different roots meet in a block where one is ``left`` and the other ``right``.

    Only nodes outside the largest part of a key are left. Keys whose nodes have one root are left out, and
    those with fewer than ``least`` nodes; a key with more than ``most`` nodes is compared block against block, with about ``most`` nodes of each side.
    With ``tasks`` the blocks are dealt to so many, where their work does not follow their bytes.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("every"), F.max("n").alias("n"), F.max_by("root", "n").alias("main")).where(
            (F.col("every") > F.col("n")) & (F.col("every") >= least))
    blocks = {"us": F.ceil((F.col("every") - F.col("n")) / most).cast("int"), "vs": F.ceil(F.col("every") / most).cast("int")}
    # stored, so that the join reads both sides from plain shuffles, and a frequent key is split
    sizes = work_table(sizes.select("key", "main", *(b.alias(x) for x, b in blocks.items())), "parts")
    outside = F.col("root") != F.col("main")

    def place(u, v, left, right):
        return F.struct(u.alias("u"), v.alias("v"), left.alias("left"), right.alias("right"))

    def own(n):
        return F.pmod(F.hash("node", "key"), F.col(n))

    def every(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    yes, no = F.lit(True), F.lit(False)
    rights = F.transform(every("us"), lambda u: place(u, own("vs"), no, yes))
    lefts = F.transform(every("vs"), lambda v: place(own("us"), v, yes, no))
    places = F.when(F.col("vs") == 1, F.array(place(F.lit(0), F.lit(0), outside, yes))).when(
        outside, F.concat(rights, lefts)).otherwise(rights)
    dealt = rows.join(sizes, "key").select("key", "node", "root", F.explode(places).alias("at"))
    dealt = dealt.select("key", "at.*", "node", "root").join(more, "node")
    dealt = dealt.repartition(tasks, "key", "u", "v") if tasks else dealt.repartition("key", "u", "v")
    return dealt.sortWithinPartitions("key", "u", "v")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the numbers ``by``."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch[c].to_numpy() for c in by]
        edges = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            name = tuple(n[a] for n in names)
            if held and last != name:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)
