"""Toxicity scores from a counterfactual-regularised linear classifier.

Training: a bounded sample of labelled texts gives binary word and word-prefix features. For each labelled sentence
with an identity term, the term is swapped for its alternatives and the squared change of the score is added to the
loss, so that the weights of identity terms move together and a neutral mention of a group does not raise a score.
Which terms are swapped: those of IDENTITY_GROUPS (a parameter; four languages), and groups that the sample itself gives, so that
the penalty acts on corpora whose names for people are not listed: its most frequent words that tell nothing of the label
(chi-squared below NEUTRAL_CHI2, in half of the texts at most), each four of about equal frequency being alternatives of one another.
Equal swaps are counted in Spark; the driver gets the distinct ones with their counts, a few for each pair of terms.
Scoring: Arrow batches of whole texts against the few thousand weights, one pass, no shuffle.

Defined cases: a null or empty text scores as a text without words (the intercept alone); rows without a usable label
(null, or not 0/1) are not trained on; without both labels in the sample every text gets the smoothed share of label 1; a null id counts as the
empty text for the fold; of rows that repeat an id, the least text is trained on; repeated rows score alike; the input's other
columns stay, but one named as an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batches_of, bounded_batches, id_text, materialize, read_table

#: Groups of terms that are swapped for one another. Fixed values, by language.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    # English
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("black", "white", "asian", "african", "european", "hispanic", "latino", "arab", "human"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "single"),
    ("immigrants", "refugees", "migrants", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "able"),
    ("elderly", "old", "young", "adult"),
    # French
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "croyants"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    # German
    ("frauen", "männer", "mädchen", "jungen", "menschen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "gläubige"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    # Spanish
    ("mujeres", "hombres", "chicas", "chicos", "personas"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "creyentes"),
    ("negros", "asiáticos", "africanos", "europeos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: Words that the sample gives: how many at most, how many are alternatives of one another, and the chi-squared they stay below.
DERIVED_TERMS, DERIVED_GROUP, NEUTRAL_CHI2 = 64, 4, 1.0

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5)
#: Features below this chi-squared are not used: of a hundred thousand that tell nothing, about one reaches it.
MIN_CHI2 = 19.5
#: But with few labels that is too strict: this many of the largest are used anyway.
MIN_FEATURES = 256


def features(text: str) -> set[str]:
    """The distinct words of the lower-cased text, and the prefixes (marked with ``*``) of longer words."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


def alternatives(groups) -> dict[str, list[str]]:
    """For each term the others of its groups, in order."""
    found: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            found.setdefault(term, []).extend(o for o in group if o != term and o not in found.get(term, ()))
    return found


def _own(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def counterfactuals(text: str, swaps: dict[str, list[str]]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each sentence, each of its identity terms and each swap: the features it loses and those it gains."""
    changes = []
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        for term in sorted(words & swaps.keys()):
            rest = words - {term}
            has = lambda f: f in rest if f[-1] != "*" else any(len(w) >= len(f) and w.startswith(f[:-1]) for w in rest)  # noqa: B023, E731
            mine = [f for f in _own(term) if not has(f)]
            for other in swaps[term]:
                new = [f for f in _own(other) if not has(f)]
                changes.append((tuple(f for f in mine if f not in new), tuple(f for f in new if f not in mine)))
    return changes


@dataclass
class ToxicityModel:
    """Weights of features, and the intercept; the swaps that it was trained with, and in how many places of the sample they stood."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    swaps: dict[str, list[str]] = field(default_factory=dict)
    n_swaps: int = 0

    def score(self, text: str | None) -> float:
        if not text:
            return float(1 / (1 + np.exp(-self.intercept)))
        get, words = self.weights.get, set(_WORD.findall(text.lower()))
        parts = [self.intercept, *[get(w) for w in words & self.weights.keys()]]
        for n in PREFIXES:
            parts += [get(p + "*", 0.0) for p in {w[:n] for w in words if len(w) > n}]
        # The sum does not depend on the order of the words.
        return float(1 / (1 + np.exp(-min(max(math.fsum(parts), -30.0), 30.0))))

    def gap(self, texts: list[str | None]) -> float:
        """The mean change of the score, either way, over all swaps in the sentences of ``texts``."""
        changes = [abs(self.score(s) - self.score(_WORD.sub(lambda m: o if m.group() == term else m.group(), s))) for t in texts for s in _SENTENCE.split((t or "").lower()) for term in sorted(set(_WORD.findall(s)) & self.swaps.keys()) for o in self.swaps[term]]  # noqa: B023
        return float(np.mean(changes)) if changes else 0.0


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, n, toxic, chi2) of the features in ``sample`` (label, features)."""
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    expected = F.col("n") * F.lit(pos / max(n, 1))
    chi2 = F.pow(F.col("toxic") - expected, 2) / F.greatest(expected * F.lit(1 - pos / max(n, 1)), F.lit(1e-9))
    return counts.withColumn("chi2", chi2).withColumn("share", F.col("n") / F.lit(max(n, 1)))


def select_features(counts: DataFrame, max_features: int, min_df: int) -> list[str]:
    """Features in ``min_df`` texts with the largest chi-squared of at least MIN_CHI2."""
    best = counts.where(F.col("n") >= min_df).orderBy(F.desc("chi2"), "feature").limit(max_features).select("feature", "chi2")
    return [r["feature"] for i, r in enumerate(best.collect()) if r["chi2"] >= MIN_CHI2 or i < MIN_FEATURES]


def derived_groups(counts: DataFrame, min_df: int) -> list[tuple[str, ...]]:
    """Groups of frequent words that tell nothing of the label, by frequency."""
    neutral = counts.where((F.col("n") >= min_df) & (F.col("share") <= 0.5) & (F.col("chi2") < NEUTRAL_CHI2) & ~F.endswith("feature", F.lit("*")))
    words = [r["feature"] for r in neutral.orderBy(F.desc("n"), "feature").limit(DERIVED_TERMS).select("feature").collect()]
    groups = [tuple(words[i : i + DERIVED_GROUP]) for i in range(0, len(words), DERIVED_GROUP)]
    return [g for g in groups if len(g) > 1]


@dataclass
class Problem:
    """The loss to be minimised: weighted logistic loss, an L2 term, and the mean squared change of the score under the swaps.

    Row ``r[i]`` has feature ``c[i]``; swap ``so[i]`` loses (``ss`` -1) or gains (+1) feature ``sc[i]`` and stands in ``times`` places."""

    y: np.ndarray
    importance: np.ndarray
    r: np.ndarray
    c: np.ndarray
    so: np.ndarray
    sc: np.ndarray
    ss: np.ndarray
    times: np.ndarray
    l2: float
    counterfactual: float

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """The loss and its gradient by the weights and the intercept."""
        n, m = len(self.y), len(w)
        z = b + np.bincount(self.r, weights=w[self.c], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = (p - self.y) * self.importance
        value = float((self.importance * (np.logaddexp(0, z) - self.y * z)).sum()) + self.l2 / 2 * float(w @ w)
        gw = np.bincount(self.c, weights=e[self.r], minlength=m) + self.l2 * w
        if len(self.times):
            change = np.bincount(self.so, weights=self.ss * w[self.sc], minlength=len(self.times))
            share = self.counterfactual * self.times / self.times.sum()
            value += float((share * change**2).sum())
            gw += 2 * np.bincount(self.sc, weights=self.ss * (share * change)[self.so], minlength=m)
        return value, gw, float(e.sum())


def problem(rows: pd.DataFrame, swaps: list[tuple[list[int], list[int], int]], l2: float = 1e-4, counterfactual: float = 1.0) -> Problem:
    """From ``rows`` (label, at: places in the vocabulary) and ``swaps`` (places lost, places gained, times); the rarer label is
    weighted by the root of the labels' ratio."""
    y = rows["label"].to_numpy(dtype=float)
    n, pos = len(y), float(y.sum())
    lengths = rows["at"].map(len).to_numpy()
    r, c = np.repeat(np.arange(n), lengths), np.fromiter(chain.from_iterable(rows["at"]), dtype=np.int64, count=int(lengths.sum()))
    parts = [(k, f, sign) for k, (lost, gained, _) in enumerate(swaps) for fs, sign in ((lost, -1.0), (gained, 1.0)) for f in fs]
    so, sc, ss = (np.array([p[i] for p in parts], dtype=t) for i, t in ((0, int), (1, int), (2, float)))
    importance = np.where(y == float(pos < n / 2), np.sqrt(max(pos, n - pos) / max(min(pos, n - pos), 1)), 1.0)
    return Problem(y, importance / max(importance.sum(), 1), r, c, so, sc, ss, np.array([s[2] for s in swaps], dtype=float), l2, counterfactual)


def fit(rows: pd.DataFrame, swaps: list[tuple[list[int], list[int], int]], vocabulary: list[str], steps: int = 400, **options) -> ToxicityModel:
    """Minimise the loss of :func:`problem` with Adam."""
    y, m = rows["label"].to_numpy(dtype=float), len(vocabulary)
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if float(y.sum()) in (0, len(y)):
        return ToxicityModel(float(np.log(prior / (1 - prior))))
    own = problem(rows, swaps, **options)
    w, b, mw, vw, mb, vb = np.zeros(m), float(np.log(prior / (1 - prior))), np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        _, gw, gb = own.loss(w, b)
        rate = 0.1 / (1 + t / 100)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(float(b), {f: float(w[k]) for k, f in enumerate(vocabulary) if abs(w[k]) > 1e-3})


def train(documents: DataFrame, labels: DataFrame, max_train_rows: int = 16384, max_features: int = 4096, min_df: int = 8, groups=IDENTITY_GROUPS, **options) -> ToxicityModel:
    """Fit on at most ``max_train_rows`` labelled documents (the bound of the sample; those whose hashed ids are least).

    Only the sampled ids are joined to the texts. The driver gets the selected features, the distinct swaps and, for each sampled
    document, the places of its features.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def featurise(batches):
        for batch in batches:
            yield batch.assign(features=[sorted(features(t)) for t in batch["text"].fillna("")])

    with batches_of(documents.sparkSession, 500):
        rows = materialize(joined.mapInPandas(featurise, "doc_id long, label int, text string, features array<string>"), "toxicity-sample")
        counts = materialize(feature_counts(rows), "toxicity-features")
        swaps = alternatives([*groups, *derived_groups(counts, min_df)])

        def swapped(batches):
            found = Counter()
            for batch in batches:
                for t in batch["text"].fillna(""):
                    found.update(counterfactuals(t, swaps))
            if found:
                yield pd.DataFrame({"lost": [" ".join(a) for a, _ in found], "gained": [" ".join(b) for _, b in found], "n": list(found.values())})

        seen = rows.select("text").mapInPandas(swapped, "lost string, gained string, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").collect()
        touched = sorted({f for r in seen for c in ("lost", "gained") for f in r[c].split()})
        vocabulary = list(dict.fromkeys(select_features(counts, max_features, min_df) + touched))
        place = {f: k for k, f in enumerate(vocabulary)}

        def places(batches):
            for batch in batches:
                yield pd.DataFrame({"label": batch["label"], "at": [[place[f] for f in fs if f in place] for fs in batch["features"]]})

        placed = rows.orderBy("doc_id").mapInPandas(places, "label int, at array<int>").toPandas()
    at = lambda fs: [place[f] for f in fs.split()]
    model = fit(placed, [(at(r["lost"]), at(r["gained"]), r["n"]) for r in seen], vocabulary, **options)
    model.swaps, model.n_swaps = swaps, sum(r["n"] for r in seen)
    return model


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` (0 to 1; a column of that name is replaced)."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return df.withColumn(score_col, scored(F.col(text_col)))


def held_out():
    """Whether a row's label must not be learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(id_text()) % 5 == 0


def train_on_labels(documents: DataFrame, spark: SparkSession, sf_dir: str) -> ToxicityModel:
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return train(documents, labels.where(~held_out()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    scored = score(documents, train_on_labels(documents, spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier does not reject, with unchanged columns."""
    model = train_on_labels(docs, spark, sf_dir)
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)
