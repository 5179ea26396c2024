import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import repeats as rp


def brute(rows, length=200):
    count = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(rng.randrange(5, 80))) for i in range(30)]
    rows += [(100 + i, prose(rng.randrange(20)) + passage + prose(rng.randrange(20))) for i in range(40)]
    base = prose(200)
    for i in range(25):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = "#"
        rows.append((200 + i, "".join(t)))
    rows += [(300, "ab" * 500), (301, "x" * 450), (302, base), (302, base), (303, None), (304, ""), (305, "ab" * 150 + "c" + "ab" * 140)]
    rows += [(306, prose(50) + passage[:200] + "Z"), (307, "Q" + passage[7:206] + "Y")]
    return rows


@pytest.mark.parametrize("crowd", [rp.CROWD, 3])
def test_planted_passages_against_brute_force(spark, crowd):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r)[:5] for r in rp.removed(docs, crowd).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("crowd", [rp.CROWD, 3])
def test_copies_of_one_stretch_under_a_crowded_anchor(spark, crowd):
    rng = random.Random(12)
    blob = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    grams = blob(200_000)
    at = int(rp.gram_hashes(np.frombuffer(grams.encode(), np.uint8)).argmin())  # the anchor wherever it stands
    rows = [(i, blob(90) + grams[at : at + rp.GRAM] + blob(90)) for i in range(8)]
    rows += [(20, rows[3][1]), (21, rows[5][1]), (22, rows[5][1])]
    got = sorted((tuple(r)[:5] for r in rp.removed(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) == 5 * 220


def test_every_document_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted((tuple(r)[:5] for r in rp.removed(documents).collect()), key=str)
    assert got == brute(rows) and any(r[2] for r in got)


def test_maximal_repeats():
    rng = random.Random(2)
    blob = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    a, b = blob(260), blob(210)
    texts = [blob(5) + a + b"1" + blob(9), b"2" + a + b"3", b"x" + a[10:] + b"9", b + blob(30), b"-" + b]
    got = {(n, frozenset(places)) for n, places in rp.maximal_repeats(texts)}
    assert got == {(260, frozenset({(0, 5), (1, 1)})), (250, frozenset({(0, 15), (1, 11), (2, 1)})),
                   (210, frozenset({(3, 0), (4, 1)}))}


def test_odd_rows(spark, odd):
    got = sorted((tuple(r)[:4] for r in rp.removed(odd).collect()), key=str)
    assert got.count((4, 30, 0, 0)) == 2 and (1, 0, 0, 0) in got and (3, 300_000, 300_000, 1) in got and len(got) == 8
    assert rp.removed(odd.limit(0)).count() == 0


def test_stretches_cover_every_string_once_and_agree_between_copies():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 3000).astype(np.uint8)
    data, begins = np.concatenate((text[:1000], text, text[500:2500])), np.array([0, 1000, 4000, 6000])
    place, first, last, anchor = rp.stretches(data, begins)
    starts = sorted(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    assert starts == [p for a, b in zip(begins, begins[1:], strict=False) for p in range(a, b - rp.LENGTH + 1)]
    at = {s: (p - s, h) for p, a, b, h in zip(place, first, last, anchor, strict=True) for s in range(a, b + 1)}
    assert all(at[p] == at[1000 + p] for p in range(801))
    assert all(at[4000 + p] == at[1500 + p] for p in range(1801))
