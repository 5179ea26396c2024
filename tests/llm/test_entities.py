import random
import re

import numpy as np
import pytest

from tallyhouse.llm import crf, pii, secret_scan as ss

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"[0-9a-f]+")


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def noise(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_personal_patterns_against_plain_matching(documents):
    rng = random.Random(8)
    texts = [r.text for r in documents.collect()] + [noise(rng, "a.@-1+é ", 60) for _ in range(800)]
    texts += [noise(rng, "0123456789.- +()", 80) for _ in range(800)] + ["4380412818073016 4380-4128-1807-3016 000001.2.3.4 é@b.c.d"]
    for text in texts:
        assert sorted(pii.base_spans(text)) == sorted(plain_pii(text))


def test_secret_patterns_against_plain_matching(documents):
    rng = random.Random(8)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = [r.text for r in documents.collect()] + [noise(rng, "0af9g ", 90) for _ in range(300)]
    texts += [rng.choice(["ToKen", "api_key", "APIKEY", "secret", "paſſword"]) + noise(rng, "=: \"'", 3) + noise(rng, "Ab0=+/.-", 20) for _ in range(500)]
    texts += ["AKIA" + noise(rng, "AZ09a", 30) for _ in range(200)]
    for text in texts:
        want = [(0, *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12]
        want += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(2, *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 16]
        assert [s for s, _ in ss.matches(text)] == sorted(want, key=lambda s: (s[1], s[0]))


def test_message_passing_is_exact_on_a_chain_and_consistent_over_skips():
    rng = np.random.default_rng(3)
    weights = crf.Weights(np.zeros((crf.DIM, 3)), rng.normal(size=(3, 3)), np.eye(3) * 3)
    unary = rng.normal(size=(4, 3))
    chain = np.array([[0, 1], [1, 2], [2, 3]])
    got = crf.beliefs(weights, unary, chain, np.empty((0, 2), np.int64), rounds=60, damping=0.0)[0]
    want, best = np.zeros((4, 3)), (-np.inf, None)
    for path in np.ndindex(3, 3, 3, 3):
        score = sum(unary[i, y] for i, y in enumerate(path)) + sum(weights.step[a, b] for a, b in zip(path, path[1:], strict=False))
        best = max(best, (score, list(path)))
        for i, y in enumerate(path):
            want[i, y] += np.exp(score)
    assert got == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-4)
    assert crf.viterbi(weights, unary) == best[1]
    far = np.array([[4.0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0.5, 0]])
    flat = crf.Weights(weights.unary, np.zeros((3, 3)), weights.skip)
    assert crf.beliefs(flat, far, chain, np.array([[0, 3]]))[0].argmax(1)[3] == 0
    assert crf.beliefs(flat, far, chain, np.empty((0, 2), np.int64))[0].argmax(1)[3] == 1


def test_personal_data(spark, documents):
    rows = pii.find(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        want = sorted(plain_pii(texts[r.doc_id]))
        assert r.base == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert set(r.base.split(",")) <= set(r.spans.split(",")) or not r.base
        assert not re.search("[0-9@]", texts[r.doc_id]) or r.n_email == sum(k == 0 for k, _, _ in want)
        assert re.search("[0-9@]", texts[r.doc_id]) or r.spans == ""


def test_a_repeated_number_without_its_prefix_is_found(spark):
    text = lambda n: f"Please call +1 (212) 555-{n} today or at once. Later on, as I said, you may call 1 (212) 555-{n} again."
    docs = spark.createDataFrame([(i, text(1000 + 7 * i)) for i in range(60)], "doc_id bigint, text string")
    rows = pii.find(docs).collect()
    assert all(r.n_phone == 1 for r in rows)
    assert sum(r.spans.count("phone") > 1 for r in rows) >= 50


def test_secrets(spark, documents):
    rng = random.Random(3)
    key = lambda: noise(rng, "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", 20)
    extra = [(5000 + i, f"settings for it: token = \"{noise(rng, 'abcdef0123456789', 40)}\" and so on") for i in range(40)]
    extra += [(6000 + i, f"settings for it: token = {key()}{i} and so on") for i in range(40)]
    extra += [(7000 + i, f"settings for it: tokens = \"{noise(rng, 'abcdef0123456789', 13)}-{noise(rng, 'abcdef0123456789', 13)}\" and so on") for i in range(20)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {r.doc_id: r for r in ss.find(docs).collect()}
    for doc, text in docs.collect():
        assert got[doc].base == ss.joined([s for s, _ in ss.matches(text)])
        assert not re.search("[0-9]", text) or got[doc].n_hex == sum(s[0] == 2 for s, _ in ss.matches(text))
    assert sum("tagged" in got[7000 + i].spans for i in range(20)) >= 10
    assert sum("tagged" in r.spans for d, r in got.items() if d < 5000) <= 3


def test_messages_reach_every_repetition_and_settle(spark):
    again = " then, quite a while later in this text, people wrote 1 (212) 555-{0} once more and"
    texts = [(i, f"Call +1 (212) 555-{2000 + i} today,{again.format(2000 + i) * 30} that is all.") for i in range(30)]
    rows = pii.find(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sum(r.spans.count("phone") == 31 for r in rows) >= 25
    assert all(r.settled for r in rows)


def test_planted_entities_that_the_patterns_miss(spark, documents):
    texts = [r.text for r in documents.select("text").limit(120).collect()]
    forms = [("Call +44 20 7946 {0} today.", "20 7946 {0}"), ("Card 4380-4128-1807-3016 was used, no. {0}.", "4380.4128.1807.3016")]
    rows, planted = [], {}
    for i, text in enumerate(texts):
        first, again = (f.format(1000 + i) for f in forms[i % 2])
        head = f"{text} {first} {text} Again it was "
        planted[i] = (len(head), len(head) + len(again))
        rows.append((i, f"{head}{again} as one may read."))
    found = wrong = 0
    for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        a, b = planted[r.doc_id]
        more = [tuple(map(int, s.split(":")[1:])) for s in set(r.spans.split(",")) - set(r.base.split(","))]
        found += any(x < b and a < y for x, y in more)
        wrong += len(more) - sum(x < b and a < y for x, y in more)
    assert found >= 0.9 * len(texts) and wrong <= 0.05 * len(texts)


def test_the_kind_of_file_is_that_of_the_whole_text():
    prose = "plain words of a long story " * 900
    code = "a=(1);{}[]!?*" * 8_000
    last = lambda text: next(ss.stretches(text + " token 12345"))[1][-1][-1]
    assert len(prose) > 20_000 and last(prose + code) == last(code) != last(prose)


def test_fitted_around_every_trigger(spark):
    far = "no entity is here. " * 400
    docs = spark.createDataFrame([(i, f"In {i} {far} write to a{i}@b{i}.org {far} or c{i}@d.net") for i in range(20)], "doc_id bigint, text string")
    got = crf.gather(docs.select("text"), 20, pii.sequences, 1000)
    assert sum(1 in ys for _, ys, _ in got) == 40
    assert len(crf.gather(docs.select("text"), 20, pii.sequences, 7)) == 7


@pytest.mark.parametrize("operator", [pii, ss])
def test_odd_rows(operator, odd):
    rows = operator.digest(operator.find(odd)).collect()
    assert len(rows) == 8 and all(r.spans == "" for r in rows)
    assert operator.find(odd.limit(0)).count() == 0
