import random

import numpy as np
import pytest

from tallyhouse.llm import graph, near_dedup as nd


def roots(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)] + [(700, 700)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots(links)
    assert {n: r for n, r in got.items()} == {n: r for n, r in want.items() if n in got}
    assert all(want[n] == n for n in set(want) - set(got))


def slow(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return total


def weighted(rng, size=30):
    items, counts = np.unique(rng.integers(0, 60, size), return_counts=True)
    return items.astype(np.uint64), counts


def test_probability_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(40):
        x, y = weighted(rng), weighted(rng)
        a, b = (dict(zip(*map(list, s), strict=True)) for s in (x, y))
        got = nd.probability_jaccard(x, y)
        assert got[0] == pytest.approx(slow(a, b)) and got[1] == pytest.approx(len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def test_registers_agree_as_often_as_probability_jaccard_says():
    rng = np.random.default_rng(7)
    errors = []
    for trial in range(150):  # other elements each time, so that the draws are independent
        x, y = ((e + np.uint64(1000 * trial), c) for e, c in (weighted(rng, 80), weighted(rng, 80)))
        one, two = nd.signatures([x, y])
        errors.append((one == two).mean() - nd.probability_jaccard(x, y)[0])
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_classes_against_all_pairs(spark, documents):
    got = {r.doc_id: r for r in nd.classes(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    sets = {d: nd.shingles(t) for d, t in texts.items()}
    links = [(a, b) for a in texts for b in texts
             if a < b and (texts[a] == texts[b] or len(sets[a][0]) and max(nd.probability_jaccard(sets[a], sets[b])) >= 0.8)]
    want = roots(links)
    assert {d: r.class_id for d, r in got.items()} == {d: want.get(d, d) for d in texts}
    assert len(set(want.values())) > 3
    assert sorted(r.doc_id for r in nd.dedup(documents).collect()) == sorted({r.class_id for r in got.values()})


def test_large_group_of_variants_is_one_class(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(300))) for i in range(20)]
    got = nd.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 200} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


@pytest.mark.parametrize("block", [3, nd.BLOCK])
def test_pairs_of_different_blocks_are_met(spark, block):
    rng = random.Random(6)
    rows = {(key, node, rng.randrange(1 + key)) for key in range(5) for node in range(40)}
    rows |= {(9, node, 100 + node) for node in range(2)}
    names = spark.range(40).selectExpr("id AS node", "'n' || id AS name")
    found = graph.met(spark.createDataFrame(sorted(rows), "key bigint, node bigint, root bigint"), block, names).collect()
    assert all(r.name == f"n{r.node}" for r in found)
    tasks = {}
    for r in found:
        tasks.setdefault((r.key, r.u, r.v), []).append(r)
    met = {(k[0], frozenset((x.node, y.node))) for k, t in tasks.items() for x in t for y in t if x.left and y.right and x.root != y.root}
    assert met == {(k, frozenset((x, y))) for k, x, p in rows for q, y, s in rows if k == q and p != s}
    assert block > 3 or max(map(len, tasks.values())) < 40


def test_near_copies_in_different_blocks_are_linked(spark, monkeypatch):
    """Copies count once, and pairs that the hash deals to different blocks of every band are still compared."""
    monkeypatch.setattr(nd, "BLOCK", 1)
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-1], "end"]))] + [(10 * i + 2, " ".join(words))] * 60
    got = nd.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id // 10 * 10, r.class_size) for r in got} == {(r.class_id, 62) for r in got} and len({r.class_id for r in got}) == 30


def test_links_beyond_the_closest_nodes(spark, monkeypatch):
    """Two texts at 0.805 that each have eight others at 0.794, which the signatures cannot tell from them."""
    monkeypatch.setattr(nd, "_central", lambda whole, sketch: [])
    rng = random.Random(4)
    rows = []

    def changed(words, at, n):
        return [*words[:at], *(f"w{rng.randrange(10**9)}" for _ in range(n)), *words[at + n :]]

    for i in range(12):
        one = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        two = changed(one, 268, 32)
        rows += [(100 * i, " ".join(one)), (100 * i + 1, " ".join(two))]
        for k in range(8):
            rows += [(100 * i + 10 + k, " ".join(changed(one, 5 + 30 * k, 30))), (100 * i + 20 + k, " ".join(changed(two, 5 + 30 * k, 30)))]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: d - 1 if d % 100 == 1 else d for d in got}


def test_near_copies_with_other_counts(spark):
    """A passage that is repeated often changes the counted shingles much and the distinct ones hardly."""
    rng = random.Random(3)
    rows = []
    for i in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(604)]
        longer = [*words[:200], *words[100:200] * 20, *words[200:]]
        weighted, plain = nd.probability_jaccard(nd.shingles(" ".join(words)), nd.shingles(" ".join(longer)))
        assert weighted < 0.5 < 0.95 < plain
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(longer))]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: d // 2 * 2 for d in range(16)}


def test_odd_rows(spark, odd):
    got = [(r.doc_id, r.class_id, r.class_size) for r in nd.classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (4, 4, 2), (None, None, 1), (5, 5, 1), (6, 6, 1)], key=str)
    kept = nd.dedup(odd)
    assert kept.dtypes == odd.dtypes
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None, 5, 6], key=str)
    assert nd.classes(odd.limit(0)).count() == 0 and nd.dedup(odd.limit(0)).count() == 0
