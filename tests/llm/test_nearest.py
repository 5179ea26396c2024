import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import nearest as nn

SCHEMA = "vec_id bigint, embedding array<double>, label string, key int, ids string, v string"


def brute(rows, every, k=20):
    """rows: (vec_id, vector or None), ids distinct. (query, rank, id, score) by comparing all with all."""
    fine = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(fine))
    x = np.array([fine[i] for i in ids.tolist()], np.float64)
    out = []
    for at in np.flatnonzero(ids % every == 0):
        score = (x * x[at]).sum(1)
        order = [j for j in np.lexsort((ids, -score)).tolist() if j != at][:k]
        out += [(int(ids[at]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


def recall(got, want):
    return len({r[::2] for r in got} & {r[::2] for r in want}) / len(want)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def wanted(table):
    return brute([(r.vec_id, list(r.embedding)) for r in table.collect()], 20)


def test_recall_and_scores_on_a_whole_table(spark, table, wanted):
    rows = nn.vectors(table)
    found = nn.index(rows, leaf_rows=32)
    assert 30 < found.tree.leaves < 200 and 1 < found.visits < found.tree.leaves and 0.97 <= found.recall < 1
    assert found.entries.count() == table.count()
    got = collected(nn.search(table, F.col("vec_id") % 20 == 0, leaf_rows=32))
    assert len(got) == len(wanted) and recall(got, wanted) >= 0.95
    scores = {r[::2]: r[3] for r in brute([(r.vec_id, list(r.embedding)) for r in table.collect()], 20, k=2000)}
    assert all(abs(scores[r[::2]] - r[3]) < 1e-12 for r in got)
    by_query = {}
    for q, rank, _, score in got:
        by_query.setdefault(q, []).append((rank, score))
    assert all([r for r, _ in x] == list(range(1, 21)) and sorted(s for _, s in x)[::-1] == [s for _, s in x] for x in by_query.values())


def test_more_recall_visits_more_leaves(spark, table, wanted):
    rows = nn.vectors(table)
    few, many = (nn.index(rows, recall=r, leaf_rows=64) for r in (0.5, 1.0))
    assert few.visits < many.visits and few.recall >= 0.5 and many.recall == 1


def test_all_leaves_are_exact_however_they_are_dealt(spark, table, wanted, monkeypatch):
    monkeypatch.setattr(nn, "SHARD", 64 * 8 * 40)  # 40 vectors: larger leaves have several shards
    monkeypatch.setattr(nn, "QUERIES", 30)
    monkeypatch.setattr(nn, "BATCH", 16)
    rows = nn.vectors(table)
    found = nn.index(rows, leaf_rows=64)
    found.visits = found.tree.leaves
    asking = rows.where("vec_id % 20 = 0").select(F.col("key").alias("query"), "v", "vec_id")
    near = nn.nearest(found, asking, 21).join(asking.select("query", "vec_id"), "query").collect()
    got = sorted((r.vec_id, *x) for r in near for x in enumerate([(n.vec_id, n.score) for n in r.near if n.vec_id != r.vec_id][:20], 1))
    want = {}
    for q, rank, i, score in wanted:
        want[q, rank] = i, score
    assert len(got) == len(want) and all(want[q, rank][0] == x[0] and abs(want[q, rank][1] - x[1]) < 1e-12 for q, rank, x in got)


def test_copies_ties_and_norms(spark):
    """A third of the rows is one vector; whole numbers give ties, and long vectors are near to everything."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0, 0.0, 3.0]) for i in range(300)]
    rows += [(2000 + i, [float(x) for x in rng.integers(-30, 31, 6)]) for i in range(5)]
    table = spark.createDataFrame([(i, v, "x", 1, "y", "z") for i, v in rows], SCHEMA).repartition(5)
    want = sorted(brute([(i, v) for i, v in rows], 20))
    assert collected(nn.search(table, F.col("vec_id") % 20 == 0)) == want
    assert recall(collected(nn.search(table, F.col("vec_id") % 20 == 0, leaf_rows=16)), want) >= 0.9
    few = table.where("vec_id < 8")
    assert collected(nn.search(few, F.col("vec_id") >= 0)) == sorted(brute([(r.vec_id, r.embedding) for r in few.collect()], 1))


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.9, -0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, -0.0]),
            (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.9, 0.0]), (20, [0.9, 0.0]), (40, [-1.0, 0.0]), (60, [1.0, 0.5])]
    table = spark.createDataFrame([(i, v, None, None, "y", "z") for i, v in rows], SCHEMA)
    want = brute([r for r in rows[:8] + rows[10:] if r[0] != 20] + [(20, [0.9, 0.0])], 20)
    got = nn.search(table, F.col("vec_id") % 20 == 0)
    assert collected(got) == sorted(want) and got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert nn.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nn.search(table.where("vec_id = 7 OR vec_id IS NULL"), F.lit(True)).count() == 0
    one = nn.search(table.where("vec_id = 0"), F.lit(True))
    assert one.count() == 0


def test_the_tree_holds_every_sample_once():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(500, 8)), np.ones((300, 8))))
    tree = nn.grow(x, 8000, float(np.sqrt((x * x).sum(1)).max()), leaf_rows=100)
    leaves = tree.leaf_of(x)
    assert set(leaves.tolist()) <= set(range(tree.leaves)) and len(set(leaves[500:].tolist())) == 1
    for walk in tree.walks(x[:10]):
        assert sorted(walk) == list(range(tree.leaves))
