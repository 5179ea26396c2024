import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import fill_middle as fm


def brute(doc, text, seed=1):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_whole_table_against_brute_force(spark, documents):
    extra = spark.createDataFrame(
        [(7000 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<P", "P>", "é", "日本<語>", "<", "<<P", "a\x00b", "<S>" * 9, ">"] * 12)],
        "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").unionByName(extra).repartition(3)
    want = sorted(brute(r.doc_id, r.text) for r in docs.collect())
    rows = fm.fill_in_middle(docs)
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in fm.restore(rows).collect()} == texts
    other = {r.doc_id: r.output for r in fm.fill_in_middle(docs, seed=2).collect()}
    assert other == {d: brute(d, t, 2)[5] for d, t in texts.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("a<P>é日\n𝄞")), st.integers(0, 9), st.integers(0, 9), st.integers(0, 2)), max_size=6))
def test_scatter_and_gather(texts):
    raw, cuts, forms, want = [], [], [], []
    for text, a, b, form in texts:
        form = 0 if any(m in text for m in ("<P>", "<S>", "<M>")) else form
        a, b = sorted((min(a, len(text)), min(b, len(text))))
        start = sum(map(len, raw))
        raw.append(text.encode())
        cuts.append([start + len(text[:a].encode()), start + len(text[:b].encode())] if form else [start + len(raw[-1])] * 2)
        forms.append(form)
        p, m, s = text[:a], text[a:b], text[b:]
        want.append([text, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}"][form].encode())
    flat = np.frombuffer(b"".join(raw), np.uint8)
    at = np.cumsum([0, *map(len, raw)])
    out, to = fm.scattered(flat, at, np.array(cuts, np.int64).reshape(-1, 2), np.array(forms, np.int64))
    assert [out[to[i] : to[i + 1]].tobytes() for i in range(len(raw))] == want
    back, again = fm.gathered(out, to, np.array(forms, np.int64))
    assert back.tobytes() == flat.tobytes() and again.tolist() == at.tolist()


def test_damaged_outputs_are_told():
    flat = np.frombuffer(b"<P>a<S>b<M", np.uint8)
    with pytest.raises(ValueError):
        fm.gathered(flat, np.array([0, len(flat)]), np.array([1]))
    flat = np.frombuffer(b"<S>a<P>b<M>", np.uint8)
    with pytest.raises(ValueError):
        fm.gathered(flat, np.array([0, len(flat)]), np.array([1]))


def test_odd_rows(spark, odd):
    got = fm.fill_in_middle(odd).collect()
    want = [brute(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    texts = sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
    assert sorted(str((r.doc_id, r.text)) for r in fm.restore(fm.fill_in_middle(odd)).collect()) == texts
    assert fm.digests(fm.fill_in_middle(odd.limit(0))).count() == 0
