"""Token-id output: documents packed into rows of fixed length by best-fit-decreasing.

Documents longer than a row are split, losing nothing. Segments of a block of documents are placed from the longest to the
shortest, each into the row with the least capacity that still holds it; a segment tree over capacities finds that row.
Blocks are runs of a task's input of bounded numbers of tokens, so memory is bounded, there is no shuffle, and a lost
task is repeated from its input alone; only the last rows of a block are not full.

Each result row is a row of the matrix: ``ids`` (little-endian, fixed width, padded), ``cu_seqlens`` (cumulative segment
lengths, from 0), ``resets`` (offsets at which positions start again at 0), and for each segment its doc_id, the number of its input row
(which tells repeated rows and null ids apart) and its first token in the document.

Defined cases: null and empty texts have no tokens and are in no row; a null doc_id is kept as null; repeated rows
are packed each for itself, under row numbers of their own; other columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._common import bounded_batches, read_table
from .bpe import load_ranks, public_vocabulary

LENGTH = 2048
BLOCK_TOKENS = 8_000_000
PAD = 0


class CapacityTree:
    """Bins by remaining capacity; finds the least capacity, at least as large as asked for, that some bin has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of a best fit, which is removed; None if no bin has room."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.count[node]:
                    node += 1
        capacity = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths``, none of which is above ``capacity`` or 0; equal lengths in order."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = tree.take(lengths[i])
        if fit is None:
            room, number = capacity, len(bins)
            bins.append([])
        else:
            room, number = fit
        bins[number].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], number)
    return bins


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def pack_block(docs: list[tuple[object, int, np.ndarray]], length: int, width: str) -> pd.DataFrame:
    """The rows of one block of (doc_id, row number, ids)."""
    segments = [(d, at, ids[at : at + length], r) for d, r, ids in docs for at in range(0, len(ids), length)]
    rows = []
    for own in best_fit_decreasing([len(s[2]) for s in segments], length):
        parts = [segments[i] for i in own]
        ends = np.cumsum([len(p[2]) for p in parts])
        ids = np.full(length, PAD, dtype=width)
        ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
        rows.append((ids.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[0] for p in parts], [p[3] for p in parts], [p[1] for p in parts], int(ends[-1])))
    return pd.DataFrame(rows, columns=["ids", "cu_seqlens", "resets", "doc_ids", "doc_rows", "doc_offsets", "n_tokens"])


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The packed matrix of the texts of ``df``, ids in 2 bytes where the vocabulary allows it, else in 4."""
    bounded_batches(df.sparkSession)
    width = "<u2" if max(load_ranks(path).values()) < 1 << 16 else "<u4"

    def blocks(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple[object, int, np.ndarray]]]:
        encode = _tokenizer(path, pattern).encode_to_numpy
        block, tokens = [], 0
        for batch in batches:
            for d, r, t in zip(batch["id"], batch["row"], batch["text"], strict=True):
                if t:
                    ids = encode(t, disallowed_special=()).astype(width)
                    if block and tokens + len(ids) > block_tokens:
                        yield block
                        block, tokens = [], 0
                    block.append((None if pd.isna(d) else int(d), r, ids))
                    tokens += len(ids)
        if block:
            yield block

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches):
            rows = pack_block(block, length, width)
            for at in range(0, len(rows), 2000):
                yield rows.iloc[at : at + 2000]

    schema = "ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_rows array<long>, doc_offsets array<long>, n_tokens long"
    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text", "monotonically_increasing_id() AS row").mapInPandas(run, schema)


def unpack(rows: Iterable[tuple], width: str = "<u2") -> dict[int, tuple[int | None, np.ndarray]]:
    """doc_id and ids of each input row from (ids, cu_seqlens, doc_ids, doc_rows, doc_offsets), for tests and readers."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    named: dict[int, int | None] = {}
    for raw, ends, docs, numbers, offsets in rows:
        ids = np.frombuffer(raw, dtype=width)
        for d, r, at, a, b in zip(docs, numbers, offsets, ends, ends[1:], strict=False):
            named[r] = d
            parts.setdefault(r, []).append((at, ids[a:b]))
    return {r: (named[r], np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])])) for r, p in parts.items()}


def position_ids(resets: list[int], n_tokens: int, length: int = LENGTH) -> np.ndarray:
    """Positions within segments; 0 in the padding."""
    out = np.zeros(length, dtype=np.int32)
    for a, b in zip(resets, [*resets[1:], n_tokens], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), *public_vocabulary())
