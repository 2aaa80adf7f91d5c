"""Quality rules as weak supervision: rules vote or abstain, and a posterior probability replaces all-must-pass filtering.

One pass over whole texts gives counts; rules turn them into votes (1 good, -1 bad, 0 abstain). Documents are then counted by
pattern of votes, which is all that expectation-maximisation needs: the driver receives at most 3 to the number of
rules counts, whatever the size of the corpus, and all documents take part. It estimates the share of good documents and
each rule's chance of each vote for good and for bad ones. A document is kept if its pattern's posterior is at least one half.

Defined cases: a null or empty text has no words, fails the base rules and is not kept, and no rule but the
one on short texts votes on it; repeated rows are counted and judged alike; an empty table gives an empty result; other columns stay,
but those named as output columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize, read_table

SYMBOLS = b"#*$%&|<>"
#: An abstention is weak evidence: it shifts the odds by this factor at most.
MAX_SILENCE = 3.0
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended long, n_distinct long"


def counts(text: str | None) -> tuple[int, ...]:
    """Counts of a whole text; words are split at space and ``\\x09``-``\\x0D`` alone."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(raw.count, [bytes([c]) for c in SYMBOLS])), 0, 0, 0, 0, 0)
    # Code points are the bytes that do not continue one.
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, [bytes([c]) for c in SYMBOLS]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in b".!?\"':;" for line in lines)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > 3:
        keys = (codes[:-2] * len(numbers) + codes[1:-1]) * len(numbers) + codes[2:] if len(numbers) < 1_000_000 else np.unique(np.stack((codes[:-2], codes[1:-1], codes[2:])), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            again = np.zeros(n - 2, dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), ended, len(numbers))


def brute_counts(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) the plain way, for tests."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered))


@dataclass(frozen=True)
class Rule:
    """A condition and the vote that it casts where it holds: 1 good, -1 bad. Elsewhere, and on nulls, it abstains."""

    name: str
    holds: Column
    vote: int

    def column(self) -> Column:
        return F.when(F.coalesce(self.holds, F.lit(False)), self.vote).otherwise(0).cast("int")


def rules() -> list[Rule]:
    """The production rules. A rule says what it knows and abstains otherwise; ratios without words or lines are null."""

    def per(top: str, below: str) -> Column:
        return F.try_divide(F.col(top), F.col(below))

    symbols, ended, repeated, duplicates, long = per("n_symbols", "n_words"), per("n_ended", "n_lines"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("word_chars", "n_words")
    variety = per("n_distinct", "n_words")
    return [
        Rule("short", F.col("n_words") < 50, -1),
        Rule("symbols", symbols > 0.1, -1),
        Rule("duplicate_lines", (duplicates > 0.3) & (F.col("n_dup_lines") >= 3), -1),
        Rule("repeated_words", repeated > 0.3, -1),
        Rule("odd_word_length", (long < 2.5) | (long > 16), -1),
        Rule("unended_lines", ended < 0.3, -1),
        Rule("few_words", (variety < 0.2) & (F.col("n_distinct") < 200), -1),
        Rule("prose", (symbols < 0.02) & (ended >= 0.8) & long.between(3, 12), 1),
        Rule("fresh", (repeated < 0.2) & (duplicates < 0.2) & (symbols < 0.05), 1),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule the chance of votes -1, 0, 1 given bad and good."""

    good: float
    chances: np.ndarray  # rule, class (bad, good), vote + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of "good" for each row of votes."""
        logs = np.log([1 - self.good, self.good])[None, :].repeat(len(votes), axis=0)
        for r in range(votes.shape[1]):
            own = np.log(self.chances[r])
            own[0, 1] = own[1, 1] + np.clip(own[0, 1] - own[1, 1], -np.log(MAX_SILENCE), np.log(MAX_SILENCE))
            logs += own[:, votes[:, r] + 1].T
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 200, strength: float = 0.005, start: float = 0.8) -> LabelModel:
    """Fit on distinct vote patterns and their numbers.

    Starts from rules of accuracy ``start``, whose bad votes count double. Each rule's estimate is drawn towards its start by a
    share ``strength`` of the documents, and no rule is held to vote good more often for bad documents than for good ones, or
    bad more often for good ones, so the classes cannot change places.
    """
    m, total = votes.shape[1], n.sum()
    p = 1 / (1 + np.exp(-np.log(start / (1 - start)) * np.where(votes < 0, 2 * votes, votes).sum(axis=1)))
    cast = np.stack([np.bincount(votes[:, r] + 1, weights=n, minlength=3) / total for r in range(m)])
    prior = np.empty((m, 2, 3))
    for c in range(2):
        lean = np.array([start, 1.0, 1 - start])[:: 1 if c == 0 else -1]
        prior[:, c] = (cast + 1e-3) * lean
    prior /= prior.sum(axis=2, keepdims=True)
    good, chances = 0.5, prior.copy()
    for _ in range(rounds):
        mass = np.stack(((1 - p) * n, p * n), axis=1)
        good = float(np.clip(mass[:, 1].sum() / total, 0.02, 0.98))
        for r in range(m):
            for c in range(2):
                w = np.bincount(votes[:, r] + 1, weights=mass[:, c], minlength=3) + strength * total * prior[r, c]
                chances[r, c] = np.maximum(w / w.sum(), 1e-6)
            for vote, c in ((0, 1), (2, 0)):  # bad votes for good documents, good votes for bad ones
                if chances[r, c, vote] > chances[r, 1 - c, vote]:
                    chances[r, :, vote] = chances[r, :, vote].mean()
            chances[r] /= chances[r].sum(axis=1, keepdims=True)
        new = LabelModel(good, chances.copy()).posterior(votes)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return LabelModel(good, chances)


def judge(df: DataFrame, text_col: str = "text", least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (default: all) with the counts, ``base_failed``, ``votes``, ``quality`` (posterior) and ``kept``."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf(_COUNTS)
    def count_all(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=[c.split()[0] for c in _COUNTS.split(", ")])

    carried = [c for c in (df.columns if keep is None else keep) if c not in {x.split()[0] for x in _COUNTS.split(", ")} | {"votes", "quality", "base_failed", "kept"}]
    counted = df.select(*carried, count_all(F.col(text_col)).alias("__counts")).select(*carried, "__counts.*")
    voted = materialize(counted.withColumn("votes", F.array(*[r.column() for r in rules()])), "votes")
    patterns = voted.groupBy("votes").count().collect()  # at most 3 to the number of rules
    quality = F.lit(None).cast("double")
    if patterns:
        votes, n = np.array([list(p["votes"]) for p in patterns]), np.array([p["count"] for p in patterns], dtype=float)
        posterior = expectation_maximisation(votes, n).posterior(votes)
        table = F.create_map(*[F.lit(x) for v, q in zip(votes.tolist(), posterior.tolist(), strict=True) for x in (",".join(map(str, v)), q)])
        quality = F.try_element_at(table, F.array_join(F.col("votes").cast("array<string>"), ","))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
