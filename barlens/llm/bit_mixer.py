"""Logistic mixing of hashed-context bit predictors over the bytes of words, in numpy.

A word is read bit by bit, with a space after it. Each predictor hashes a context (the last 2, 3 or 5 bytes of the word so far, or all of
them) together with the bits of the byte so far to a cell of a table; the cell knows how often the next bit was 0 and 1. The cells'
log-odds are mixed with weights chosen by two gates, each by how sure two of the longer contexts are. A last
table corrects the mixed chance by how often such chances came true. Every bit's two chances add up to 1, so the words' do as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Bytes of context; 0: all of the word so far.
ORDERS = (2, 3, 5, 0)
#: Cells of each predictor's table, as a power of two: 10.5 million cells of 2 bytes whatever the size of the corpus.
BITS = (20, 20, 22, 22)
GATES_A, GATES_B = 64, 64
#: Cells of the correction: nodes of a byte, times steps of the log-odds.
STEPS = 33
STEP = 0.1
#: What each cell has seen of either bit before it has seen any.
PRIOR = 0.1
RATE = 0.02
LEAST = 1e-6
CHUNK = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: How sure a cell is, in 8 steps of the bit length of what it has seen.
_SURE = np.array([0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 7, 7, 7], np.int64)


@dataclass
class Bytes:
    """Words as bytes: each beginning of a word, up to some byte, is held once, with its last byte and a hash of each context before that.

    ``of`` gives for each byte of the words the place of the beginning that ends with it."""

    data: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=list)

    def weights(self, by_word: np.ndarray) -> np.ndarray:
        """Each beginning's sum over the words that begin with it."""
        return np.bincount(self.of, np.repeat(by_word, self.lengths).astype(float), len(self.data))


def chunks(lengths: np.ndarray, most: int = CHUNK) -> Iterator[slice]:
    """Runs of words of about ``most`` bytes."""
    ends, at = np.cumsum(lengths + 1), 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, end)
        at = end


def read_words(words: list[bytes]) -> Bytes:
    """A polynomial hash is a difference of running sums, so contexts of any length cost the same."""
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    n = len(data)
    begin = np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        power, inverse = np.cumprod(np.full(n, _M)), np.cumprod(np.full(n, _INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])

        def hashed(at: np.ndarray, since: np.ndarray) -> np.ndarray:
            h = (sums[at] - sums[since]) * inverse[since] + (at - since).astype(np.uint64) * _K2
            h = (h ^ (h >> np.uint64(29))) * _K1
            return h ^ (h >> np.uint64(32))

        _, first, of = np.unique(hashed(np.arange(1, n + 1), begin), return_index=True, return_inverse=True)
        begin = begin[first]
        return Bytes(data[first], of, starts, lengths, [hashed(first, np.maximum(begin, first - k) if k else begin) for k in ORDERS])


def cells(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (context + node.astype(np.uint64) * _K3) * _M
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bits_of(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, bit) for the eight bits of each byte, the highest first; a node is the bits so far after a 1."""
    wide = data.astype(np.int64)
    for t in range(8):
        yield (1 << t) | (wide >> (8 - t)), (wide >> (7 - t)) & 1


def count_cells(words: list[bytes], weights: np.ndarray, k: int) -> np.ndarray:
    """Weighted counts of bits 0 and 1 in each cell of predictor ``k``, interleaved."""
    counts = np.zeros(2 << BITS[k], np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for part in chunks(lengths):
        read = read_words(words[part])
        weight = read.weights(weights[part]).astype(np.int64)
        for node, bit in bits_of(read.data):
            np.add.at(counts, 2 * cells(read.contexts[k], node, BITS[k]) + bit, weight)
    return counts


def states(counts: np.ndarray) -> np.ndarray:
    """Cells as pairs of bytes: log-odds of a 1 in steps of ``STEP``, and the bit length of the number of bits seen, 15 at most."""
    zeros, ones = counts[::2], counts[1::2]
    odds = np.log((ones + PRIOR) / (zeros + PRIOR))
    out = np.empty((len(zeros), 2), np.int8)
    out[:, 0] = np.clip(np.rint(odds / STEP), -127, 127)
    out[:, 1] = np.minimum(np.ceil(np.log2(zeros + ones + 1.0)), 15)
    return out


@dataclass
class Mixer:
    """Tables of states, one for each predictor, weights for each gate, and the correction."""

    tables: list[np.ndarray]
    weights_a: np.ndarray = field(default_factory=lambda: np.full((GATES_A, len(ORDERS)), 0.3))
    weights_b: np.ndarray = field(default_factory=lambda: np.zeros((GATES_B, len(ORDERS))))
    correction: np.ndarray | None = None

    def inputs(self, read: Bytes, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each predictor, and the two gates."""
        found = [self.tables[k][cells(read.contexts[k], node, BITS[k])] for k in range(len(ORDERS))]
        odds = np.stack([f[:, 0] for f in found]).astype(np.float32) * np.float32(STEP)
        sure = [_SURE[f[:, 1]] for f in found]
        return odds, sure[-1] * 8 + sure[-2], sure[-3] * 8 + sure[-4]

    def mixed(self, odds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(odds.shape[1])
        for k in range(len(ORDERS)):
            total += (self.weights_a[a, k] + self.weights_b[b, k]) * odds[k]
        return np.clip(total, -16, 16)

    def chance(self, total: np.ndarray, node: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-total))
        if self.correction is not None:
            p = (p + self.correction[node, step_of(total)]) / 2
        return np.clip(p, LEAST, 1 - LEAST)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 chance of each word with the space after it."""
        out = np.zeros(len(words))
        for part in chunks(np.fromiter(map(len, words), np.int64, len(words))):
            read = read_words(words[part])
            bits = np.zeros(len(read.data))
            for node, bit in bits_of(read.data):
                p = self.chance(self.mixed(*self.inputs(read, node)), node)
                bits += np.log10(np.where(bit == 1, p, 1 - p))
            out[part] = np.add.reduceat(bits[read.of], read.starts)
        return out

    def learn(self, words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pass of online gradient steps with a rate for each weight; changes the weights and returns each gate's mass."""
        squares = [np.full_like(self.weights_a, 1e-6), np.full_like(self.weights_b, 1e-6)]
        mass = [np.zeros(GATES_A), np.zeros(GATES_B)]
        for part in chunks(np.fromiter(map(len, words), np.int64, len(words)), CHUNK // 32):
            read = read_words(words[part])
            weight = read.weights(weights[part])
            for node, bit in bits_of(read.data):
                odds, a, b = self.inputs(read, node)
                off = (bit - 1 / (1 + np.exp(-self.mixed(odds, a, b)))) * weight
                for gate, own, square, m in ((a, self.weights_a, squares[0], mass[0]), (b, self.weights_b, squares[1], mass[1])):
                    seen = np.bincount(gate, weight, len(own))
                    m += seen
                    for k in range(len(ORDERS)):
                        step = np.bincount(gate, off * odds[k], len(own)) / np.maximum(seen, 1e-9)
                        square[:, k] += step * step
                        own[:, k] += np.where(seen > 0, RATE * step / np.sqrt(square[:, k]), 0)
        return mass[0], mass[1]

    def outcomes(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Weighted bits 0 and 1 for each node and step of the mixed log-odds."""
        counts = np.zeros((2, 256 * STEPS), np.int64)
        for part in chunks(np.fromiter(map(len, words), np.int64, len(words))):
            read = read_words(words[part])
            weight = read.weights(weights[part]).astype(np.int64)
            for node, bit in bits_of(read.data):
                at = node * STEPS + step_of(self.mixed(*self.inputs(read, node)))
                np.add.at(counts, (bit, at), weight)
        return counts


def step_of(total: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(total, -8, 8) * 2).astype(np.int64) + STEPS // 2


def correction_of(counts: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Chances of a 1 by node and step; a cell that saw little stays near its step's own chance."""
    centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
    zeros, ones = counts.reshape(2, 256, STEPS)
    return (ones + prior * centre) / (zeros + ones + prior)
