import random

import pytest

from tallyhouse.llm import decontaminate as d
from tallyhouse.llm.suffixes import suffix_array
from tallyhouse.llm.texts import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_every_document_against_brute_force(spark, documents):
    benchmark = table(spark, SF, "benchmark")
    got = sorted(pairs(d.hits(documents, benchmark), "*"))
    want = sorted(brute.decontaminate(pairs(documents, "doc_id", "text"), pairs(benchmark, "item_id", "text")))
    assert got == want
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("block_words", [4, 1_000_000])
def test_short_items_blocks_and_ties(spark, block_words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b c d É".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(40))) for i in range(60)] + [(7, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, text(n)) for i, n in enumerate([0, 2, 3, 3, 10, 11, 12])] + [(9, None), (1, "a b")],
                                  "item_id bigint, text string")
    marked = d.mark(d.bodies(docs), bench, "s", "i", "n", block_words=block_words)
    got = sorted((r.doc_id, r.n, sum(x.end - x.start for x in r.s), sorted(set(r.i))) for r in marked.collect())
    plain = brute.decontaminate(pairs(docs, "doc_id", "text"), pairs(bench, "item_id", "text"))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(plain)]
    assert sorted(len(g[3]) for g in got) == sorted(w[3] for w in plain)


def test_removal_leaves_no_window_of_the_input(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Before: One, two three four five six seven eight nine TEN. After", 5, "k"), (2, "clean", 5, None)],
                                 "doc_id bigint, text string, n_chars bigint, spans string")
    got = {r.doc_id: r for r in d.remove(docs, bench).collect()}
    assert got[1].text == "Before: . After" and got[1].n_chars == 15 and got[1].spans == "k"
    assert got[2].text == "clean" and got[2].n_chars == 5


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "plain text"), (2, None)], "item_id bigint, text string")
    got = sorted(pairs(d.hits(odd, bench), "doc_id", "n_words", "n_hit"), key=str)
    assert (4, 6, 2) in got and got.count((4, 6, 2)) == 2 and (None, 3, 0) in got and len(got) == 8
    assert d.remove(odd, bench).dtypes == odd.dtypes
    assert d.remove(odd, bench).count() == 8
    assert d.hits(odd.limit(0), bench).count() == 0
    assert d.hits(odd, bench.limit(0)).where("contaminated").count() == 0


def test_suffix_array():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        x = rng.integers(0, 3, n)
        order, ranks = suffix_array(x, 2)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        assert ranks[order].tolist() == list(range(n))
