"""Byte-level BPE by merge replay over blocks of the corpus.

Each task gathers the distinct words (pre-tokens) of the texts in its Arrow batches. An inverted index from token pair to the
positions where the pair stands in those words then lets every merge be applied in rank order to all its words at
once; a merge touches only the neighbours of its positions. Documents are encoded by looking their words up, and
decoded from the ids through the table of token bytes. Merges never cross words, so a block's index gives what one
index over the corpus would; there is no shuffle, and a block's words bound the memory.

Defined cases: null and empty texts have no ids; each row is encoded for itself, so repeated rows are equal; very long
texts are encoded whole; other columns of the input stay, but one named as an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, read_table

#: Before a block, a worker forgets the units and words that it has encoded if it holds more units than this.
MAX_KNOWN_UNITS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Ragged:
    """Rows of ids of differing length, in one flat array."""

    def __init__(self, flat: np.ndarray | None = None, start: np.ndarray | None = None, length: np.ndarray | None = None):
        self.flat = np.empty(0, dtype=np.int32) if flat is None else flat
        self.start = np.empty(0, dtype=np.int64) if start is None else start
        self.length = np.empty(0, dtype=np.int64) if length is None else length

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows one after the other."""
        length = self.length[rows]
        first = np.cumsum(length) - length
        return self.flat[np.repeat(self.start[rows] - first, length) + np.arange(length.sum())]

    def followed_by(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate((self.flat, other.flat)), np.append(self.start, other.start + len(self.flat)), np.append(self.length, other.length))


def merge_leftmost(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, merging the leftmost pair of least rank again and again; a heap of pairs, so that long words take n log n."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heapq.heappush(queue, (ranks[pair], i, len(pair)))

    for i in range(len(parts)):
        offer(i)
    while queue:
        rank, i, length = heapq.heappop(queue)
        j = after[i]
        # Of a place that was merged since, the pair is another: ranks tell it but for its length.
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != length or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in parts if p is not None]


def distinct(places: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])] if len(places) else places


class MergeReplay:
    """Encodes sets of words by replaying the merges over an inverted index of token pairs."""

    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        get = ranks.get
        pairs = [(get(t[:s]), get(t[s:]), rank) for t, rank in ranks.items() for s in range(1, len(t))]
        table = np.array([(a * self.base + b, rank) for a, b, rank in pairs if a is not None and b is not None], dtype=np.int64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.values = np.append(table[:, 0], 1 << 62), np.append(table[:, 1], self.NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair of tokens, NONE where there is none or an end stands in the pair."""
        keys = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], self.NONE)

    def encode(self, words: Sequence[bytes]) -> Ragged:
        """The ids of each distinct word, in order."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if not all(words):
            raise ValueError("a word is empty")
        # A word that is a token needs no merge.
        rest = np.flatnonzero(whole < 0)
        todo = [words[w] for w in rest.tolist()]
        done = self._replay(todo) if todo else Ragged()
        one = np.flatnonzero(whole >= 0)
        start, length = np.empty(len(words), dtype=np.int64), np.ones(len(words), dtype=np.int64)
        start[rest], length[rest] = done.start, done.length
        start[one] = len(done.flat) + np.arange(len(one))
        return Ragged(np.concatenate((done.flat, whole[one].astype(np.int32))), start, length)

    def _replay(self, todo: list[bytes]) -> Ragged:
        # One array of tokens for all words, -1 at each word's ends; left and right link the tokens that still stand.
        lengths = np.fromiter(map(len, todo), dtype=np.int64, count=len(todo))
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1]) + 1
        token = np.full(n, -1, dtype=np.int32)
        inside = np.ones(n, dtype=bool)
        inside[0] = False
        inside[ends] = False
        token[inside] = self.single[np.frombuffer(b"".join(todo), dtype=np.uint8)]
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        right[-1] = n - 1
        pair = np.full(n, self.NONE, dtype=np.int32)
        for a in range(0, n - 1, 1 << 18):  # in parts, as looking pairs up takes much more room than their ranks
            b = min(a + (1 << 18), n - 1)
            pair[a:b] = self.pair_ranks(token[a:b], token[a + 1 : b + 1])
        # The inverted index: for each merge the positions where its pair stands, or stood when they were added.
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        late: list[np.ndarray] = []

        def add(places: np.ndarray) -> None:
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip([int(ranks[0]), *ranks[cuts].tolist()], np.split(places, cuts) if len(cuts) else [places], strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)

        at = np.flatnonzero(pair != self.NONE).astype(np.int32)
        if len(at):
            add(at)
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            i = found[0] if len(found) == 1 else distinct(np.concatenate(found))
            i = i[pair[i] == rank]  # a neighbour's merge may have taken one of the two
            if not len(i):
                continue
            j = right[i]
            if (pair[j] == rank).any():
                i = self._leftmost(i, j)
                j = right[i]
            k = right[j]
            token[i], token[j] = rank, -2
            pair[j] = self.NONE
            right[i], left[k] = k, i
            p = left[i]
            touched = distinct(np.concatenate((p[token[p] >= 0], i)))
            new = self.pair_ranks(token[touched], token[right[touched]])
            pair[touched] = new
            some = new != self.NONE
            if some.any():
                touched, new = touched[some], new[some]
                if new.min() <= rank:
                    late.append(touched[new <= rank])
                add(touched)
        stand = np.flatnonzero(token >= 0)
        ids = token[stand].astype(np.int32)
        cuts = np.searchsorted(stand, np.append(0, ends))
        start, length = cuts[:-1], np.diff(cuts)
        if late:  # a merge made a pair of no higher rank: there the order within the word decides, so go by word
            again = np.unique(np.searchsorted(ends, np.concatenate(late)))
            parts = [np.array(merge_leftmost(todo[w], self.ranks), dtype=np.int32) for w in again.tolist()]
            length[again] = list(map(len, parts))
            start[again] = len(ids) + np.cumsum(length[again]) - length[again]
            ids = np.concatenate((ids, *parts))
        return Ragged(ids, start, length)

    @staticmethod
    def _leftmost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of overlapping places, as in a run of one letter, every other from the left."""
        taken, free, kept = set(), i.tolist(), []
        for a, b in zip(free, j.tolist(), strict=True):
            if a not in taken:
                kept.append(a)
                taken.add(b)
        return np.array(kept, dtype=np.int64)


#: A unit is white space and what follows up to the next; no piece of the pattern goes on from one unit to the next,
#: unless there is other white space than these six characters.
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def units(text: str) -> list[str]:
    return [text] if not text.isascii() and _OTHER_SPACE.search(text) else _UNIT.findall(text)


class Encoder:
    """The units and words that a worker has encoded, and their ids.

    A block's new units get numbers as they appear; their new words are replayed together, and texts become ids by
    gathering from the units' arrays.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay = MergeReplay(load_ranks(path))
        self.pieces = regex.compile(pattern)
        self.bytes_of = [self.replay.tokens.get(i) for i in range(self.replay.base)]
        self.text_of = [str(i) for i in range(self.replay.base)]
        self.forget()

    def forget(self) -> None:
        self.unit_no: dict[str, int] = defaultdict(count().__next__)
        self.word_no: dict[str, int] = defaultdict(count().__next__)
        self.units, self.words = Ragged(), Ragged()

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The ids of each text of a block."""
        if len(self.unit_no) > MAX_KNOWN_UNITS:
            self.forget()
        codes = [np.fromiter(map(self.unit_no.__getitem__, units(t)), dtype=np.int32) for t in texts]
        split = list(map(self.pieces.findall, islice(self.unit_no, len(self.units.start), None)))
        of_words = np.fromiter(map(self.word_no.__getitem__, chain.from_iterable(split)), dtype=np.int32)
        new_words = [w.encode() for w in islice(self.word_no, len(self.words.start), None)]
        self.words = self.words.followed_by(self.replay.encode(new_words))
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ids, lengths = self.words.gather(of_words), np.append(0, np.cumsum(self.words.length[of_words]))
        cuts = np.append(0, np.cumsum(n_words))
        start, stop = lengths[cuts[:-1]], lengths[cuts[1:]]
        self.units = self.units.followed_by(Ragged(ids, start, stop - start))
        for c in codes:
            yield self.units.gather(c)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One for a worker's life."""
    return Encoder(path, pattern)


@contextmanager
def remembering(path: str, pattern: str) -> Iterator[Encoder]:
    """The worker's encoder; what it remembers of a task's texts goes with the task, as the worker lives on for other stages."""
    encoder = _encoder(path, pattern)
    try:
        yield encoder
    finally:
        encoder.forget()


def encode_texts(texts: Sequence[str], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text. The texts are one block: their new words are replayed together."""
    return _encoder(path, pattern).encode(texts)


def decode_ids(ids: Iterable[int], path: str, pattern: str) -> bytes:
    """The bytes of the ids; an unknown id raises."""
    return _encoder(path, pattern).decode(ids)


def blocks(texts: Iterable[str], max_chars: int = 2_000_000):
    """Runs of the texts of at most ``max_chars`` characters, or of one longer text."""
    block, chars = [], 0
    for t in texts:
        if block and chars + len(t) > max_chars:
            yield block
            block, chars = [], 0
        block.append(t)
        chars += len(t)
    if block:
        yield block


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array of ids for each text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with remembering(path, pattern) as encoder:
            for texts in batches:
                yield pd.Series([ids for block in blocks(texts.fillna("")) for ids in encoder.encode(block)], dtype="object")

    return df.withColumn(ids_col, to_ids(F.col(text_col)))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each array of ids (none for null)."""

    @F.pandas_udf("binary")
    def to_bytes(ids: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(x if x is not None else [], path, pattern) for x in ids], dtype="object")

    return df.withColumn(bytes_col, to_bytes(F.col(ids_col)))


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes within the task, so that ids needn't leave it."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with remembering(path, pattern) as encoder:
            for texts in batches:
                rows = []
                for block in blocks(texts.fillna("")):
                    for ids in encoder.encode(block):
                        own = ids.tolist()
                        rows.append((len(own), hashlib.sha256(encoder.decimal(own).encode()).hexdigest(), hashlib.sha256(encoder.decode(own)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a rank file and the pattern that goes with it, as installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), *public_vocabulary())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every row's ids (one row for each copy that the mix emits), their number and digests."""
    path, pattern = public_vocabulary()
    return digests(docs, path, pattern)
