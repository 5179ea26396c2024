import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import spotsigs as ss


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest())
    return out


def brute_spots(text):
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    common, anchors, out = set(ss.COMMON), set(ss.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchors:
            chain, at = [w], i + 1
            while len(chain) < 3:
                while at < len(words) and words[at] in common:
                    at += 1
                if at >= len(words):
                    break
                chain.append(words[at])
                at += 1
            if len(chain) == 3:
                out.add(" ".join(chain))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_next_document(spark, documents, buckets):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(None, "last of all"), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    after = {r.doc_id: r.next_text for r in ss.with_next(docs, buckets).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert after == {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_edited_texts_and_likeness(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r for r in ss.edited(documents).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == brute_edits(rows)
    assert statistics.mean(r.near_edited for r in got.values()) > 0.35 > 0.1 > statistics.mean(r.near_next for r in got.values())
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_spots(spark):
    texts = ["The cat and the old dog of a house was in the green garden, it is said.", "the the the the the the one two", "", "nothing",
             "Die Katze und der alte Hund ist ein Tier", "x " * 50 + "the of in to cat for with dog", "the " * 3000 + "big cat"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    expected = spark.createDataFrame([(i, s) for i, t in enumerate(texts) for s in brute_spots(t)], "i int, s string")
    want = {r.i: set(r.h) for r in expected.groupBy("i").agg(F.collect_set(F.hash("s")).alias("h")).collect()}
    got = {r.i: set(r.s) for r in frame.select("i", ss.spots(F.col("text")).alias("s")).collect()}
    assert all(got[i] == w for i, w in want.items()) and len(want) >= 4
    assert all(len(got[i]) == 1 for i in set(got) - set(want))


def test_spots_of_all_documents_and_of_long_runs(spark, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    expected = spark.createDataFrame([(d, s) for d, t in rows.items() for s in brute_spots(t)], "d bigint, s string")
    want = {r.d: set(r.h) for r in expected.groupBy("d").agg(F.collect_set(F.hash("s")).alias("h")).collect()}
    got = {r.doc_id: set(r.s) for r in documents.select("doc_id", ss.spots(F.col("text")).alias("s")).collect()}
    assert all(got[d] == w for d, w in want.items()) and len(want) > 100
    long = ["the " * 300_000 + "big of in with for cat", "the a " * 150_000, "der Hund " + "of in to " * 100_000 + "Katze"]
    frame = spark.createDataFrame([(t,) for t in long], "t string").select(ss.spots(F.col("t")).alias("s"))
    spot = spark.range(1).select(F.hash(F.lit("the big cat")), F.hash(F.lit("der hund katze"))).first()
    sizes = [r.s for r in frame.collect()]
    assert sizes[0] == [spot[0]] and len(sizes[1]) == 1 and sizes[2] == [spot[1]]


def test_likeness_is_pruned_by_length(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 5], [1])], "a array<int>, b array<int>, c array<int>")
    a, b, c = (F.col(x) for x in "abc")
    got = row.select(ss.likeness(a, b), ss.likeness(a, b, 0.7), ss.likeness(a, c, 0.2), ss.likeness(a, c, 0.3), ss.length_class(a, 0.5)).first()
    assert tuple(got) == (0.6, 0.0, 0.25, 0.0, 2)


def test_odd_rows(spark, odd):
    got = ss.edited(odd).collect()
    assert len(got) == 8 and {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert ss.edited(odd.limit(0)).count() == 0 and ss.edited(odd.where("doc_id = 5")).first().near_next == 1
