"""Token counts by rank-synchronous merging of ragged arrays.

The new pre-tokens of a batch lie end to end in one array of symbols. In every round each pre-token
applies its lowest-ranked pair at all places at once; pre-tokens without a pair drop out. What is
left of a pre-token at the end are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyhouse.llm.pretokens import Kept, byte_letters
from tallyhouse.llm.texts import bodies, byte_lengths, slices

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_NO_RANK = np.int32(2**31 - 1)


class Merger:
    """Vocabulary and merges of a byte-level BPE file as arrays."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = set(special)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of each pair of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NO_RANK), at

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of every word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = sizes.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            joined = word[1:] == word[:-1]
            rank, place = self.ranks(symbols[:-1], symbols[1:])
            rank[~joined] = _NO_RANK
            begins = np.flatnonzero(np.r_[True, ~joined])
            lowest = np.minimum.reduceat(np.r_[rank, _NO_RANK], begins)
            lowest = np.repeat(lowest, np.diff(np.r_[begins, len(symbols)]))
            hit = (rank == lowest[:-1]) & (rank != _NO_RANK)
            # in a row of equal symbols the pairs overlap: every second one counts, from the left
            chained = hit[1:] & hit[:-1]
            if chained.any():
                at = np.flatnonzero(hit)
                run_start = np.r_[True, np.diff(at) > 1]
                first = np.maximum.accumulate(np.where(run_start, at, 0))
                hit[at[(at - first) % 2 == 1]] = False
            taken = np.flatnonzero(hit)
            if not len(taken):
                break
            symbols[taken] = self.made[place[taken]]
            np.subtract.at(counts, word[taken], 1)
            alive = lowest != _NO_RANK
            alive[taken + 1] = False
            symbols, word = symbols[alive], word[alive]
        return counts

    def solve(self, chunks: list[str]) -> list[int]:
        """Tokens of every chunk."""
        owner: list[int] = []
        found: dict[str, int] = {}
        uses: list[int] = []
        extra = np.zeros(len(chunks), np.int64)
        for i, text in enumerate(chunks):
            for part in self.specials.split(text) if self.specials and "<" in text else (text,):
                if part in self.special:
                    extra[i] += 1
                    continue
                for word in self.pattern.findall(part):
                    owner.append(i)
                    uses.append(found.setdefault(word, len(found)))
        if not found:
            return extra.tolist()
        counts = self.survivors([w.encode() for w in found])
        np.add.at(extra, np.array(owner), counts[np.array(uses)])
        return extra.tolist()


@lru_cache(maxsize=4)
def _counter(name: str) -> Kept:
    return Kept(Merger(name).solve)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens, for every document.

    Special strings inside a text count as their one token. A null or empty text has 0 tokens; repeated
    rows give a row each; a null doc_id stays null; other columns are not looked at. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _counter(tokenizer)
        for part in slices(batches):
            counts = [sum(chain((head,), rest)) for head, rest in kept.of(part["text"].to_pylist())]
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(byte_lengths(part["text"])), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return bodies(docs).mapInArrow(run, SCHEMA)
