import public_tokenizers
from tokenizers import Tokenizer

from tallyhouse.llm import packing, token_counts
from tests.llm import brute

HARD = ["", " ", "  a  b ", "a\n b", "aaaaaaaaaaaaa  aaaa", "x <|endoftext|> y<|endoftext|>z", " <|endoftext|>", "it's I'LL 12 45",
        "\x1c a \x85 b", "日本語 テスト 🙂🙂", "<|endof <|endoftext|", "\t\t x\r\n\r\n y   ", "b" * 5000, None]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def frame(spark, documents):
    hard = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    return documents.select("doc_id", "text").unionByName(hard)


def test_counts_equal_the_library(spark, documents):
    docs, lib = frame(spark, documents), library()
    got = {r.doc_id: tuple(r) for r in token_counts.count_tokens(docs).collect()}
    for doc, text in docs.collect():
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert got[doc] == (doc, len((text or "").encode()), n, n > 1024)


def test_pieces_equal_the_library(spark, documents):
    docs, lib = frame(spark, documents), library()
    rows = packing.packed(packing.pack(docs)).collect()
    want = [p for doc, text in docs.collect()
            for p in brute.pieces(doc, text, lambda t: lib.encode(t, add_special_tokens=False).ids)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)


def test_buckets_hold_equal_lengths(spark, documents, tmp_path):
    path = str(tmp_path / "buckets")
    packing.write_buckets(packing.pack(documents), path)
    stored = spark.read.parquet(path)
    assert stored.where("octet_length(ids) <> 4 * length").count() == 0
    assert stored.count() == packing.pack(documents).count()


def test_odd_rows(spark, odd):
    counts = [tuple(r) for r in token_counts.count_tokens(odd).collect()]
    assert len(counts) == 8 and (1, 0, 0, False) in counts and (2, 0, 0, False) in counts
    pieces = packing.packed(packing.pack(odd))
    assert pieces.where("doc_id = 1").count() == 1 and pieces.select("doc_id").distinct().count() == 7
    assert packing.pack(odd.limit(0)).count() == 0 and token_counts.count_tokens(odd.limit(0)).count() == 0
