"""Secret scans: fixed patterns, and a battery of randomness tests on what looks like an encoded key.

Pass 1 counts, over the whole texts of all documents, which character follows which in tokens too short to be keys: the model of
ordinary text (66 x 66 counts come to the driver). Pass 2 finds the pattern spans and tests each further run of 20 or more key
characters. The run's encoding is the smallest alphabet that holds it. The battery asks how well "each character drawn at random"
explains the run: chi-squared uniformity over that alphabet, a runs test about its middle, and lag-1 serial correlation, joined to
one p-value; a run that it rejects is no key. So the battery is a gate: it can only take runs away. What is tested for discovery is another
statistic, the evidence against ordinary text, as a likelihood ratio of the uniform draw to the text model, in which each pair of neighbouring
characters counts. Under the text model the ratio exceeds x with a chance of 1/x at most, whatever the length, so
8/ratio (for the alphabets that may be chosen) is a p-value that takes account of length: each character of a random key adds evidence.
The p-values are counted in bins for each stratum (encoding, length class) over all documents, each stratum's Benjamini-Hochberg
threshold comes from the few hundred counts, and the runs that pass it and that the battery does not reject are added. The rate is
held in each stratum; over all of them only the expected number of false runs is, as a share of the expected number of runs found.

Defined cases: a null text is empty and has no spans; equal starts are ordered as assign, access, hex, random; tokens that
overlap a pattern span are not tested; repeated rows get equal results; other columns of the input are not returned by
``scan``, and stay in ``redact``; where there is no text to count, the model is letters as frequent as in English that keep their class.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, materialize, read_table

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "api")

MIN_RUN = 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Alphabets by size; a run's encoding is the first that holds all its characters.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Per cent of the letters a to z in English text.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: p-values are counted in tenths of a power of ten, up to this many.
BINS = 200


#: What the counts start from: a share that keeps the class of the character before, and the weight in counts of each character.
SAME_CLASS, PRIOR_COUNTS = 0.85, 200.0


def _prior() -> np.ndarray:
    """Chances of the next character (before, next) without any counts: letters as in English, a tenth as many capitals."""
    chars = ALPHABETS["mixed"]
    share = np.array([LETTERS[ord(c.lower()) - 97] * (0.1 if c.isupper() else 1) if c.isalpha() else 1.0 if c.isdigit() else 0.5 for c in chars])
    kind = np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in chars])
    same = kind[:, None] == kind[None, :]
    within = same * share / (same * share).sum(axis=1, keepdims=True)
    return SAME_CLASS * within + (1 - SAME_CLASS) * share / share.sum()


_CODES = {name: np.full(128, -1, dtype=np.int64) for name in ALPHABETS}
for _name, _chars in ALPHABETS.items():
    _CODES[_name][[ord(c) for c in _chars]] = np.arange(len(_chars))
_SYMBOL = _CODES["mixed"]
_N = len(ALPHABETS["mixed"])


def _upper(z: float) -> float:
    """The standard normal's mass above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def count_pairs(texts: list[str | None]) -> np.ndarray:
    """How often each character follows each in tokens of fewer than MIN_RUN key characters, as a flat array (before, next)."""
    raw = np.frombuffer("\n".join(t or "" for t in texts).encode(), dtype=np.uint8)
    code = np.where(raw < 128, _SYMBOL[raw & 127], -1)
    edges = np.flatnonzero(np.diff(code >= 0, prepend=False, append=False))
    short = np.zeros(len(code) + 1, dtype=np.int64)
    starts, ends = edges[::2], edges[1::2]
    few = ends - starts < MIN_RUN
    np.add.at(short, starts[few], 1)
    np.add.at(short, ends[few], -1)
    inside = np.cumsum(short)[:-1] > 0
    at = np.flatnonzero(inside[1:] & inside[:-1])
    return np.bincount(code[at] * _N + code[at + 1], minlength=_N * _N)


def text_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Logarithms of the chances that a character (row) is followed by another (column) in ordinary text, from all rows of ``df``."""

    def run(batches):
        total = np.zeros(_N * _N, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                total += count_pairs(batch["text"].iloc[at : at + 200].tolist())
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(text_col).alias("text")).mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return model_of({r["pair"]: r["n"] for r in rows})


def model_of(counts: dict[int, int]) -> np.ndarray:
    total = np.zeros(_N * _N)
    total[list(counts)] = list(counts.values())
    total = total.reshape(_N, _N) + PRIOR_COUNTS * _prior()
    return np.log(total / total.sum(axis=1, keepdims=True))


def battery(run: str, model: np.ndarray) -> tuple[str, float, float]:
    """Encoding, p-value of "drawn at random" (Fisher's join of the three tests) and log10 of the p-value of "ordinary text"."""
    raw = np.frombuffer(run.encode("ascii"), dtype=np.uint8)
    for name, table in _CODES.items():
        x = table[raw]
        if x.min() >= 0:
            break
    k, n = len(ALPHABETS[name]), len(x)
    counts = np.bincount(x, minlength=k).astype(float)
    chi2 = k / n * float((counts**2).sum()) - n
    p_uniform = _upper((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = x >= k / 2
    runs = 1 + int((high[1:] != high[:-1]).sum())
    p_runs = 2 * _upper(abs(runs - (n + 1) / 2) / math.sqrt((n - 1) / 4))
    d = x - x.mean()
    spread = float((d**2).sum())
    p_serial = 2 * _upper(abs(float((d[1:] * d[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    p_random = math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees of freedom, above 2 * half
    y = _SYMBOL[raw]
    ratio = -(n - 1) * math.log(k) - float(model[y[:-1], y[1:]].sum())
    return name, p_random, min(0.0, (math.log(len(ALPHABETS)) - ratio) / math.log(10))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the pattern spans, in order."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, spans: list[tuple[int, int, int]], alpha: float, model: np.ndarray) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, bin) of the runs outside the spans that the battery does not reject at ``alpha``.

    Every run that is tested gets a row, as the false-discovery control counts them all; bin -1 marks the rejected."""
    found, at = [], 0
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        k = at
        while k < len(spans) and spans[k][0] < m.end() and spans[k][2] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            continue
        name, p_random, p_text = battery(m.group(), model)
        n = m.end() - m.start()
        level = -1 if p_random < alpha else min(BINS - 1, int(-10 * p_text))
        found.append((m.start(), m.end(), f"{name}:{min(5, n.bit_length() - 4)}", level))
    return found


_FOUND = T.StructType(
    [
        T.StructField("base", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.StringType()), T.StructField("level", T.IntegerType())]))),
    ]
)


def find(df: DataFrame, model: np.ndarray, text_col: str = "text", out_col: str = "found", alpha: float = 0.01) -> DataFrame:
    """``df`` with the pattern spans and the tested runs of each whole text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(_FOUND)
    def scan_texts(texts: pd.Series) -> pd.DataFrame:
        base, runs = [], []
        for text in texts:
            spans = base_spans(text or "")
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            runs.append([{"start": s, "end": e, "stratum": t, "level": b} for s, e, t, b in candidates(text or "", spans, alpha, model)])
        return pd.DataFrame({"base": base, "runs": runs})

    return df.withColumn(out_col, scan_texts(F.col(text_col)))


def thresholds(found: DataFrame, q: float = 0.01, out_col: str = "found") -> dict[str, int]:
    """The least level that counts as a secret, by stratum: Benjamini-Hochberg at ``q`` over all runs of all documents.

    The driver receives one count for each of at most 40 strata and 201 levels."""
    run = F.explode(f"{out_col}.runs").alias("r")
    counts = found.select(run).groupBy("r.stratum", "r.level").count().collect()
    total: dict[str, int] = {}
    by: dict[str, dict[int, int]] = {}
    for stratum, level, n in counts:
        total[stratum] = total.get(stratum, 0) + n
        by.setdefault(stratum, {})[level] = n
    least = {}
    for stratum, levels in by.items():
        seen = 0
        for level in sorted((x for x in levels if x >= 0), reverse=True):
            seen += levels[level]
            if 10 ** (-level / 10) <= q * seen / total[stratum]:  # the least certain p-value of the level
                least[stratum] = level
    return least


def all_spans(least: dict[str, int], out_col: str = "found"):
    """The pattern spans and the runs that reach their stratum's level, as an ordered array of (start, kind, end)."""
    level = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else None
    runs = F.col(f"{out_col}.runs")
    passed = F.filter(runs, lambda r: F.coalesce(r["level"] >= F.try_element_at(level, r["stratum"]), F.lit(False))) if least else F.filter(runs, lambda r: F.lit(False))
    added = F.transform(passed, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), r["end"].alias("end")))
    return F.array_sort(F.concat(F.col(f"{out_col}.base"), added))


def joined(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """(id, base, spans) for every row; the intermediate table in shared storage holds no texts."""
    found = materialize(find(df.select(F.col(id_col), F.col(text_col)), text_model(df, text_col), text_col).select(id_col, "found"), "secrets")
    return found.select(id_col, F.col("found.base").alias("base"), all_spans(thresholds(found, q)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", marker: str = "[SECRET]", q: float = 0.01) -> DataFrame:
    """``df`` with each secret's characters replaced by ``marker``; overlapping spans become one marker.

    Rows and spans are written to shared storage once, so texts are scanned once, and a row keeps its own spans."""
    name = "found"
    while name in df.columns:
        name += "_"
    found = materialize(find(df, text_model(df, text_col), text_col, name), "secrets")
    least = thresholds(found, q, name)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is not None and len(own):
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], marker]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype="object")

    return found.withColumn(text_col, replaced(F.col(text_col), all_spans(least, name))).drop(name)


def of_kind(k: int):
    """Whether a span is of that kind (of one parameter: Spark would give a second one the span's place)."""
    return lambda s: s["kind"] == k


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, spans = F.col("base"), F.col("spans")
    n = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", *n, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, secrets replaced by a marker and ``n_chars`` brought in line."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
