import random
import zlib

import pytest

from tallyhouse.llm import toxicity as tox
from tallyhouse.llm.texts import table

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie_against_edit_distance():
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abcd") for _ in range(rng.randrange(a, b)))
    terms = sorted({word(3, 12) for _ in range(25)})
    lexicon = tox.Lexicon(dict.fromkeys(terms, 50.0), {})
    for _ in range(1500):
        w = word(4, 13)
        best = min(((distance(w, t), t) for t in terms if distance(w, t) <= tox.errors_allowed(t)), default=None)
        got = lexicon.known[w.encode()]
        assert (got and got[:2]) == (None if best is None else (tox._EXACT, w) if best[0] == 0 else (tox._FUZZY, best[1]))


@pytest.fixture(scope="module")
def model(spark):
    return tox.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    rows = tox.scores(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 800
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_misspelled_terms_and_quotations(model):
    term = max(model.lexicon.terms, key=lambda t: (model.lexicon.terms[t] > 100, len(t)))
    wrong = term[:2] + "x" + term[3:]
    plain = "The weather was fine and nothing else happened on that long day by the river."
    clean, exact, fuzzy = model.score([plain, f"{plain} You {term}, what a {term}.", f"{plain} You {wrong}, what a {wrong}."])
    assert clean < 0.3 and exact > 0.7 and fuzzy > clean
    quoted = model.lexicon.features(f'{plain} The word "{term}" was quoted.')
    assert quoted[3] > 0 and quoted[0] == 0


def test_odd_rows(spark, odd, model):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = tox.scores(odd, labels)
    assert got.count() == 8 and got.where("score IS NULL OR held_out IS NULL").count() == 0
    assert tox.scores(odd, labels.limit(0)).where("score <> 0.5").count() == 0
    assert tox.scores(odd.limit(0), labels).count() == 0
    kept = tox.scored(odd, model, "z").drop("z")
    assert kept.dtypes == odd.dtypes and kept.where("text IS NULL").count() == 1
    assert tox.accept(odd, table(spark, SF, "labels").limit(0)).dtypes == odd.dtypes
