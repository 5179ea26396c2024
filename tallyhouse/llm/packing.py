"""Packing by power-of-two decomposition: every document is cut into pieces whose lengths are powers
of two, and pieces of equal length form a bucket. A piece is a training sequence of its own, so no
sequence crosses documents and none is padded."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.pretokens import KEPT, byte_letters, cut
from tallyhouse.llm.texts import bodies, slices

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class _Chunks(dict):
    """Token ids by chunk, as little-endian unsigned 32-bit numbers, found when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = array("I", self.encode(self.before + chunk)).tobytes()
        return ids


class Encoder:
    """Token ids of whole texts, equal to those of the library ``tokenizers`` for the same file, special
    strings included. The file's vocabulary is applied as ranks by tiktoken, which takes a third of
    the time for single chunks."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b"".join(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(chunk: str) -> list[int]:
            if any(s in chunk for s in special):
                return own.encode(chunk, allowed_special="all")
            return own.encode_ordinary(chunk)

        self.first, self.rest = _Chunks(encode, ""), _Chunks(encode, " ")

    def forget(self) -> None:
        self.first.clear()
        self.rest.clear()

    def ids(self, text: str) -> bytes:
        if len(self.first) + len(self.rest) > KEPT:
            self.forget()
        head, *rest = cut(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, rest))


@lru_cache(maxsize=4)
def _encoder(name: str) -> Encoder:
    return Encoder(name)


def binary_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Powers of two that sum to n, longest first, none above ``longest`` (a power of two)."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, longest: int = SEQUENCE, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A document is its token ids and then ``end_id``; ``ids`` holds a piece's ids as little-endian
    unsigned 32-bit numbers. Each piece is one sequence (offset 0) of the bucket that ``length`` names.
    A null or empty text is the single ``end_id``; repeated rows are packed once each; a null doc_id
    stays null; other columns are not looked at; an empty table gives no rows. Nothing is shuffled:
    a document is tokenised and cut where it is read.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for part in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = encoder.ids(text) + tail
                total, start = len(ids) // 4, 0
                for n in binary_lengths(total, longest):
                    rows.append((doc, start, n, total, ids[4 * start : 4 * (start + n)]))
                    start += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        encoder.forget()  # the worker may serve other stages

    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    return bodies(docs).mapInArrow(run, SCHEMA).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str, spread: int = 16) -> None:
    """Store pieces with one folder per length. A length that holds most rows is spread over
    ``spread`` files, so it is not one task."""
    salt = F.pmod(F.hash("sequence_id"), F.lit(spread))
    pieces.repartition("length", salt).write.partitionBy("length").parquet(path)


def packed(pieces: DataFrame) -> DataFrame:
    """Digest of each piece."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
