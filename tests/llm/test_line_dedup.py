import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyhouse.llm import line_dedup as ld
from tests.llm.test_near_dedup import roots


def brute(docs):
    """Removed line numbers per row of (doc_id, text), by comparing all pairs of distinct lines."""
    places = {}
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                places.setdefault(line, []).append((doc, i))
    lines = list(places)
    grams = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    by_gram = {}
    for i, g in enumerate(grams):
        for x in g:
            by_gram.setdefault(x, []).append(i)
    links = []
    for i, g in enumerate(grams):
        for j in {j for x in g for j in by_gram[x] if j < i}:
            if ld.jaccard(lines[i], lines[j]) >= 0.8:
                links.append((i, j))
    root, groups = roots(links), {}
    for i, x in enumerate(lines):
        groups.setdefault(root.get(i, i), []).extend(places[x])
    removed = {}
    for group in groups.values():
        for doc, i in sorted(group)[1:]:
            removed.setdefault(doc, []).append(i)
    return {d: sorted(r) for d, r in removed.items()}


def test_hash_of_a_line_is_the_same_in_spark(spark):
    lines = ["", "a", "été über ñ 日本", "x" * 100]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("xxhash64(line) as h").collect()
    assert [r.h & (2**64 - 1) for r in rows] == [xxhash.xxh64_intdigest(x, ld.SPARK_SEED) for x in lines]


def test_all_lines_against_brute_force(spark, documents):
    extra = [(9000 + i, f"This is page {i} of the same long report about nothing in particular, as was said above.\nshort\nline {i}")
             for i in range(40)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in ld.removed_lines(docs).collect()}
    assert {d: list(r.removed) for d, r in got.items() if r.n_removed} == want
    assert len(want) > 10 and all(got[d].n_lines == len(t.split("\n")) for d, t in rows)
    kept = {r.doc_id: r.text for r in ld.dedup(docs).collect()}
    for d, t in rows:
        lines = t.split("\n")
        left = [x for i, x in enumerate(lines) if i not in want.get(d, [])]
        if any(x.strip() for x in left):
            assert kept[d] == "\n".join(left)
        else:
            assert d not in kept


@pytest.mark.parametrize("block", [20, ld.BLOCK])
def test_pairs_within_a_family_of_templated_lines(spark, monkeypatch, block):
    """All lines of the family share bands; only planted pairs are alike."""
    monkeypatch.setattr(ld, "BLOCK", block)
    rng = random.Random(7)
    blob = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, rows = blob(95), []
    for i in range(150):
        tail = blob(25)
        rows += [(2 * i, f"{template}{tail}\n \n{blob(40)}"), (2 * i + 1, f"{template}{tail[:14]}{blob(11)}\n\t\n")]
    want = brute(rows)
    got = ld.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: list(r.removed) for r in got if r.n_removed} == want
    assert len(want) == 150


@pytest.mark.parametrize("words,held", [(1, 50), (32, ld.HELD_SHINGLES)])
def test_links_of_blocks(monkeypatch, words, held):
    """Every pair of a left and a right line of a block that is alike is connected, and no other."""
    monkeypatch.setattr(ld, "WORDS", words)
    monkeypatch.setattr(ld, "HELD_SHINGLES", held)
    rng = random.Random(3)
    found = 0
    for _ in range(60):
        base = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 90)))
        lines = []
        for _ in range(rng.randrange(1, 30)):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = rng.choice("xyzé")
            lines.append("".join(x))
        lines = sorted(set(lines))
        left = [rng.random() < 0.7 for _ in lines]
        right = [not x or rng.random() < 0.7 for x in left]
        nodes = pa.array(range(len(lines)), pa.int64())
        sets, starts = ld.shingle_sets(lines)
        assert [b - a for a, b in zip(starts, starts[1:])] == [len(ld._grams(x)) for x in lines]
        block = pa.table({"node": nodes, "root": nodes, "line": lines, "left": left, "right": right, "size": np.diff(starts),
                          "outline": pa.array([r.tobytes() for r in ld.outlines(sets, starts)], pa.binary())})
        r = block.to_pylist()
        want = [(x["node"], y["node"]) for x in r for y in r if x["node"] < y["node"] and (
            x["left"] and y["right"] or y["left"] and x["right"]) and ld.jaccard(x["line"], y["line"]) >= 0.8]
        got = ld.linked(block, 0.8)
        assert roots(got) == roots(want)
        assert {tuple(sorted(x)) for x in got} <= set(want)
        found += len(want)
    assert found > 20


def test_tasks_that_hold_blank_texts_only(spark):
    rows = [(1, ""), (2, " \n\t"), (3, "a line that is here twice"), (4, None), (5, "a line that is here twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    alone = docs.repartitionByRange(5, "doc_id")
    assert {r.doc_id: r.n_removed for r in ld.removed_lines(alone).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    blank = docs.where("doc_id IN (1, 2, 4)")
    assert {(r.doc_id, r.n_removed) for r in ld.removed_lines(blank).collect()} == {(1, 0), (2, 0), (4, 0)}
    assert ld.dedup(blank).count() == 3
    empty = ld._joined(np.empty(0, np.int64), np.empty(0, np.int64))
    assert empty.num_rows == 0 and empty.schema.names == ["key", "node", "other"]


def test_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_lines, list(r.removed)) for r in ld.removed_lines(odd).collect()), key=str)
    assert got == sorted([(1, 0, []), (2, 0, []), (3, 1, []), (4, 1, []), (4, 1, []), (None, 1, []), (5, 5, [3]), (6, 2, [])], key=str)
    kept = ld.dedup(odd)
    assert kept.dtypes == odd.dtypes and kept.count() == 8
    five = kept.where("doc_id = 5").first()
    assert five.text == "line one\nline two\n\n" and five.n_chars == 19 and five.ids == "e"
    assert ld.removed_lines(odd.limit(0)).count() == 0 and ld.dedup(odd.limit(0)).count() == 0


def test_pairs_are_alike_as_by_plain_jaccard():
    rng = random.Random(4)
    lines = ["", "short", "1234567", "12345678", "aaaaaaaaaaaaaaaaaaaa"] + ["".join(rng.choice("ab é") for _ in range(rng.randrange(40))) for _ in range(200)]
    x = [rng.choice(lines) for _ in range(600)]
    y = [v[: len(v) - rng.randrange(3)] if rng.random() < 0.6 else rng.choice(lines) for v in x]
    for similarity in (0.3, 0.8):
        want = [ld.jaccard(a, b) >= similarity for a, b in zip(x, y, strict=True)]
        assert ld.alike(x, y, similarity).tolist() == want and 50 < sum(want) < 590
