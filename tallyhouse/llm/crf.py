"""Conditional random fields over tokens: a linear chain, and one with skip edges between distant tokens.

Sequences are short stretches of text around what could be an entity. Features are hashed into a fixed
number of weights. Weights are fitted by maximum likelihood along the chain, given the labels at the
far ends of skip edges (pseudo-likelihood); inference is Viterbi on a chain and loopy message passing
with skip edges.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.texts import smallest, work_table

DIM = 1 << 13


class Stretch(NamedTuple):
    """Tokens of a text around its triggers: their places, and the features of each."""

    places: list[tuple[int, int]]
    features: list[list[int]]


def feature(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % DIM


def regions(text: str, triggers: re.Pattern, reach: int) -> list[tuple[int, int]]:
    """Merged ranges of ``reach`` characters around every trigger, widened to white space."""
    out: list[tuple[int, int]] = []
    for m in triggers.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shape(token: str) -> str:
    """Letters and digits by kind, runs shortened."""
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", token)))


class Weights(NamedTuple):
    unary: np.ndarray  # feature, label
    step: np.ndarray  # label before, label
    skip: np.ndarray  # label at the far end, label


def zero(labels: int) -> Weights:
    return Weights(np.zeros((DIM, labels)), np.zeros((labels, labels)), np.zeros((labels, labels)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def scores(weights: Weights, features: list[list[int]]) -> np.ndarray:
    """Unary scores (token, label)."""
    if not features:
        return np.zeros((0, weights.unary.shape[1]))
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.fromiter((f for fs in features for f in fs), np.int64, sizes.sum())
    return np.add.reduceat(weights.unary[flat], np.cumsum(sizes) - sizes)


def gather(texts: DataFrame, most_texts: int, sequences: Callable[[str], Iterator[tuple]], most: int) -> list[tuple]:
    """Labelled sequences (features, labels, skip edges) that ``sequences`` makes of whole texts.

    They are made of the ``most_texts`` distinct texts with the smallest hashes, in tasks, and ``most`` of them at most, again
    those with the smallest hashes, come to the driver. Only the hashes of all texts are stored to choose from.
    """
    hashed = texts.withColumn("h", F.xxhash64("text"))
    chosen = smallest(work_table(hashed.select("h").distinct(), "sample"), "h", most_texts)
    picked = hashed.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                rows = [(np.array(f, np.int16).tobytes(), np.array(y, np.int8).tobytes(), np.array(e, np.int32).tobytes())
                        for f, y, e in sequences(text) if f]
                if rows:
                    columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]
                    columns += [pa.array([h] * len(rows)), pa.array(range(len(rows)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["features", "labels", "edges", "h", "place"])

    made = picked.select("h", "text").mapInArrow(run, "features binary, labels binary, edges binary, h bigint, place bigint")
    made = work_table(made.withColumn("key", F.xxhash64("h", "place")), "sequences")
    out = []
    for row in smallest(made, "key", most).collect():
        ys = np.frombuffer(row.labels, np.int8)
        edges = np.frombuffer(row.edges, np.int32).reshape(-1, 2)
        out.append((np.frombuffer(row.features, np.int16).reshape(len(ys), -1), ys.tolist(), edges.tolist()))
    return out


def fit(sequences: list[tuple[list[list[int]], list[int], list[tuple[int, int]]]], labels: int, rounds: int = 80,
        rate: float = 0.1, ridge: float = 1e-3) -> Weights:
    """Weights of sequences (features, labels, skip edges), all fitted together by Adam. Every token has as
    many features as every other. No sequences give zero weights."""
    weights = zero(labels)
    sequences = [s for s in sequences if len(s[0])]
    if not sequences:
        return weights
    longest = max(len(s[0]) for s in sequences)
    count, width = len(sequences), len(sequences[0][0][0])
    feats = np.zeros((count, longest, width), np.int64)
    gold, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    far = np.zeros((count, longest, labels))
    for i, (fs, ys, edges) in enumerate(sequences):
        n = len(fs)
        feats[i, :n], gold[i, :n], real[i, :n] = fs, ys, True
        for a, b in edges:
            far[i, a, ys[b]] += 1
            far[i, b, ys[a]] += 1
    hot = np.eye(labels)[gold] * real[..., None]
    total = real.sum()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for k in range(1, rounds + 1):
        unary = weights.unary[feats].sum(2) + far @ weights.skip
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            new = _log_sum(forward[:, t - 1, :, None] + weights.step, 1) + unary[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        norm = _log_sum(forward[:, -1], 1)
        pairs = np.zeros((labels, labels))
        for t in range(longest - 2, -1, -1):
            after = backward[:, t + 1] + unary[:, t + 1]
            both = forward[:, t, :, None] + weights.step + after[:, None, :] - norm[:, None, None]
            pairs += (np.exp(np.minimum(both, 0)) * real[:, t + 1, None, None]).sum(0)
            new = _log_sum(weights.step + after[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        belief = np.exp(np.minimum(forward + backward - norm[:, None, None], 0)) * real[..., None]
        error = hot - belief
        grad_unary = np.zeros_like(weights.unary)
        np.add.at(grad_unary, feats[real], error[real][:, None, :])
        seen = np.einsum("ita,itb->ab", hot[:, :-1], hot[:, 1:])
        grads = (grad_unary, seen - pairs, np.einsum("ita,itb->ab", far, error))
        for w, g, (m, v) in zip(weights, grads, moments, strict=True):
            g = g / total * 50 - ridge * w
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return weights


def viterbi(weights: Weights, unary: np.ndarray) -> list[int]:
    """The best labels of one chain."""
    if not len(unary):
        return []
    best, back = unary[0], []
    for row in unary[1:]:
        both = best[:, None] + weights.step
        back.append(both.argmax(0))
        best = both.max(0) + row
    path = [int(best.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def beliefs(weights: Weights, unary: np.ndarray, chain: np.ndarray, skips: np.ndarray, rounds: int = 400,
            damping: float = 0.5) -> tuple[np.ndarray, bool]:
    """Marginals (token, label) of a graph with chain edges and skip edges (rows of two tokens), by loopy message
    passing: in every round each edge sends in both directions what its end believes without that edge. Rounds go on
    until no message moves; the second result says whether that was so after ``rounds`` of them."""
    n, labels = unary.shape
    edges = np.concatenate((chain, skips)).reshape(-1, 2)
    if not len(edges):
        return (np.exp(unary - _log_sum(unary, 1)[:, None]) if n else unary), True
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    size = len(edges)
    pair = np.concatenate((np.broadcast_to(weights.step, (len(chain), labels, labels)),
                           np.broadcast_to(weights.skip, (len(skips), labels, labels))))
    pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
    other = np.r_[np.arange(size) + size, np.arange(size)]
    sent, moved = np.zeros((2 * size, labels)), np.inf
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, sent)
        new = _log_sum((total[source] - sent[other])[:, :, None] + pair, 1)
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - sent).max()
        sent = damping * sent + (1 - damping) * new
        if moved < 1e-3:
            break
    total = unary.copy()
    np.add.at(total, target, sent)
    return np.exp(total - _log_sum(total, 1)[:, None]), bool(moved < 1e-3)
