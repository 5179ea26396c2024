import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyhouse.llm import decontaminate, near_dedup, toxicity
from tallyhouse.llm.texts import table
from tests.llm import brute
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import roots

SF = "/root/testdata/sf0.001"


def plain_run(docs, benchmark, model):
    """The stages on a dict of texts, one after the other."""
    docs = {d: t for d, t in docs.items() if model.score([t])[0] < toxicity.REJECT}
    gone = brute_lines(sorted(docs.items()))
    left = {}
    for d, t in docs.items():
        lines = [x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])]
        if any(x.strip() for x in lines):
            left[d] = "\n".join(lines)
    sets = {d: near_dedup.shingles(t) for d, t in left.items()}
    links = [(a, b) for a in left for b in left if a < b and (left[a] == left[b] or max(near_dedup.probability_jaccard(sets[a], sets[b])) >= 0.8)]
    root = roots(links)
    kept = {d: t for d, t in left.items() if root.get(d, d) == d}
    windows = set()
    for _, text in benchmark:
        w = brute.words(text)
        windows.update(tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1 if w else 0))
    out = {}
    for d, t in kept.items():
        w = brute.words(t)
        hit = {i for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(k, k + n)}
        ranges = decontaminate.merged([(i, i + 1) for i in hit])
        out[d] = decontaminate.without(t, ranges) if ranges else t
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return out, [p for d, t in out.items() for p in brute.pieces(d, t, lambda x: lib.encode(x, add_special_tokens=False).ids)]


def test_run_against_plain_stages(spark, documents):
    model = toxicity.fit(documents, table(spark, SF, "labels"))
    texts, pieces = plain_run({r.doc_id: r.text for r in documents.collect()},
                              [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()], model)
    got = cp.run(spark, SF)
    assert sorted(tuple(r)[:5] for r in got.drop("ids").collect()) == sorted(pieces)
    assert 100 < len(texts) < 200


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.dtypes == odd.dtypes
    assert out.where("doc_id = 4").count() >= 1 and out.where("doc_id IS NULL").count() == 1
    assert stage(spark, odd.limit(0), SF).count() == 0
