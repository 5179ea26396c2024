import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import runs as rn


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute_runs(w, shortest=6, periods=4):
    """Every stretch of a period that no neighbour extends, of which the period is the smallest."""
    out = []
    for p in range(1, len(w) // periods + 1):
        a = 0
        while a + p < len(w):
            b = a
            while b + p < len(w) and w[b] == w[b + p]:
                b += 1
            if b > a and b + p - a >= max(shortest, periods * p) and smallest_period(w[a : b + p]) == p:
                out.append((a, b + p - a, p))
            a = max(b, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


def found(texts):
    words = np.array([x for t in texts for x in t], np.int64)
    return rn.runs_of(words, np.cumsum([0, *map(len, texts)]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=60), max_size=4))
def test_binary_words(texts):
    assert found(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 60)), max_size=6))
def test_powers(parts):
    text = [x for root, n in parts for x in (root * (n // len(root) + 1))[:n]]
    assert found([text, text[::-1], [9], text]) == [brute_runs(text), brute_runs(text[::-1]), [], brute_runs(text)]


def test_long_periods_and_neighbouring_documents():
    rng = random.Random(3)
    for p in (1, 2, 3, 5, 8, 31, 32, 33, 64, 100, 255, 256, 257):
        for n in (4 * p - 1, 4 * p, 4 * p + 1, 7 * p + 3):
            root = [rng.randrange(10**6) for _ in range(p)]
            text = [-1, *[root[i % p] for i in range(n)], -2, -3]
            want = [(1, n, p)] if n >= max(6, 4 * p) else []
            before = [rng.randrange(10**6) for _ in range(rng.randrange(70))]
            assert found([before, text, root * 2, root * 2]) == [[], want, *[brute_runs(root * 2)] * 2]
    fib, other = [0, 1], [0]
    while len(fib) < 3000:
        fib, other = fib + other, fib
    assert found([fib]) == [brute_runs(fib)]


def test_work_is_bounded_on_one_long_run():
    text = [0] * 300_000 + [1] + [0, 1, 2] * 100_000
    assert found([text]) == [[(0, 300_000, 1), (300_001, 300_000, 3)]]


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        rn.runs_of(np.zeros(9, np.int64), np.array([0, 9]), periods=2)


def test_whole_table_against_brute_force(spark, documents):
    docs = documents.select("doc_id", "text").repartition(3)
    got = [tuple(r) for r in rn.digests(rn.find_runs(rn.repeating(docs))).collect()]
    want = [brute(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10
    rows = rn.find_runs(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert [tuple(x) for x in r.runs] == brute_runs(texts[r.doc_id].split())


def test_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_words): r for r in rn.find_runs(odd).collect()}
    assert [tuple(x) for x in got[3, 60_000].runs] == [(0, 60_000, 1)] and got[3, 60_000].collapsed == "word"
    assert got[1, 0].runs == [] and got[1, 0].collapsed == "" and got[6, 0].collapsed == ""
    assert got[None, 3].collapsed == "no id here" and got[5, 6].collapsed == "line one line two line one"
    rows = rn.digests(rn.find_runs(rn.repeating(odd)))
    assert rows.count() == 8 and rows.where("doc_id = 4").count() == 2
    empty = hashlib.sha256(b"").hexdigest()
    one = rows.where("doc_id = 1").first()
    assert tuple(one) == (1, 0, None, None, None, None, empty, empty)
    assert rn.digests(rn.find_runs(rn.repeating(odd.limit(0)))).count() == 0
