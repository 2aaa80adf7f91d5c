"""Language-model scores of whole texts: logistic mixing of hashed-context bit predictors, learned from all training documents.

1. Tasks count the words of their documents; Spark sums them by word. All that follows is learned from distinct words with their counts.
2. Tables of bits seen after hashed contexts (:mod:`bit_mixer`) are summed by pages of cells. Documents of one fold are left out at
   first: on their words the gated mixing weights are learned online, task by task, and averaged, and the correction is counted. Then the
   tables take in that fold too.
3. Each distinct word is scored once. A text is a product over its words, times a gate over classes of documents (languages): the chance of a
   word under a class is its own chance times the class's share among the word's occurrences, divided by the sum of that over all words,
   so that it is a distribution again. The classes' weights are refined by each word of the text; what comes of this after all words is
   the log of the sum over classes of prior times product, so only sums by class are needed.
4. The most frequent words, 2^17 at most, are broadcast; rows of (document, word) are joined for the others alone, none of which has more
   than a 2^17th of all occurrences, so that none is hot.

The word list and the joins grow with the corpus; the tables have 10.5 million cells (21 MB) at any size, the number of classes is at
most ``MAX_CLASSES`` (the documents of all rarer values form one class together).

Defined cases: a null text is empty and has the end alone; a null id counts as the empty text in the choice of the fold and stays null; repeated rows
and ids are documents of their own; a null class value is the empty one; without training documents every bit has the chance one half and
``base_score`` is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import bit_mixer
from ._common import batches_of, bounded_batches, id_text, materialize, read_table
from ._words import WORDS, words_in

FOLDS, HELD, TUNE = 7, 2, 3
END = b"\n"
MAX_CLASSES = 8
#: Occurrences that a class is given of each word before any is seen.
CLASS_PRIOR = 1.0
#: At most so many words are frequent enough to be broadcast.
FREQUENT = 1 << 17
#: Words whose cells one task sums, and whose bits one task learns from.
TABLE_WORDS = 2_000_000
LEARN_WORDS = 250_000
#: Words of an Arrow batch.
SCORED_WORDS = 20_000
PAGE = 1 << 16
#: A task sends on what it has counted when it holds so many words.
HELD_WORDS = 400_000


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cls, fit, tune, held): occurrences by class and part of the corpus, in parts of bounded size."""
    counts: dict[tuple[int, int], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (cls, part), own in counts.items():
            words = [*own]
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                n, none = pa.array([own[w] for w in some], pa.int64()), pa.array([0] * len(some), pa.int64())
                columns = [pa.array(some, pa.binary()), pa.array([cls] * len(some), pa.int32()), *(n if part == p else none for p in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "cls", "fit", "tune", "held"])
        counts.clear()

    for batch in batches:
        for fold, cls, text in zip(*(batch.column(c) for c in ("fold", "cls", "text")), strict=True):
            own = counts.setdefault((cls.as_py(), {TUNE: 1, HELD: 2}.get(fold.as_py(), 0)), Counter())
            for words in words_in(text.as_py(), WORDS):
                own.update(words)
            own[END] += 1
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from flush()
    yield from flush()


def _words_of(batches: Iterator[pa.RecordBatch], *names: str) -> tuple[list[bytes], list[np.ndarray]]:
    held = [(b.column("word").to_pylist(), [b.column(c).to_numpy() for c in names]) for b in batches if b.num_rows]
    return [w for words, _ in held for w in words], [np.concatenate([n[i] for _, n in held]) if held else np.zeros(0, np.int64) for i in range(len(names))]


def gather_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that a task's words touch, by pages: places and counts, compressed."""
    words, counts = _words_of(batches, "fit", "tune")
    names, types = ["k", "page", "part", "cells"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for k in range(len(bit_mixer.ORDERS)):
        for part, weights in enumerate(counts):
            some = np.flatnonzero(weights)
            table = bit_mixer.count_cells([words[i] for i in some], weights[some], k)
            rows = []
            for page in range(len(table) // (2 * PAGE)):
                own = table[page * 2 * PAGE : (page + 1) * 2 * PAGE]
                places = np.flatnonzero(own)
                if len(places):
                    rows.append((k, page, part, zlib.compress(places.astype("<u4").tobytes() + own[places].astype("<i8").tobytes(), 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def merge_page(rows: pd.DataFrame) -> pd.DataFrame:
    """One page of a predictor's states: from the counts of the first part alone, and from all."""
    counts = np.zeros((2, 2 * PAGE), np.int64)
    for part, packed in zip(rows["part"], rows["cells"], strict=True):
        raw = zlib.decompress(packed)
        n = len(raw) // 12
        counts[part, np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)
    fit, every = (bit_mixer.states(c).tobytes() for c in (counts[0], counts[0] + counts[1]))
    return pd.DataFrame([(rows["k"].iloc[0], rows["page"].iloc[0], fit, every)], columns=["k", "page", "fit", "every"])


def read_tables(pages: DataFrame, column: str) -> list[np.ndarray]:
    tables = [np.zeros((1 << b, 2), np.int8) for b in bit_mixer.BITS]
    found = pages.select("k", "page", column).toArrow()
    for k, page, raw in zip(*found.columns, strict=True):
        at = page.as_py() * PAGE
        tables[k.as_py()][at : at + PAGE] = np.frombuffer(raw.as_buffer(), np.int8).reshape(PAGE, 2)
    return tables


def learn_weights(words: DataFrame, shared: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Gated weights, learned online by each task on its share of ``words`` (word, tune), averaged by what each gate has seen."""
    n = len(bit_mixer.ORDERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (counts,) = _words_of(batches, "tune")
        if own:
            mixer = bit_mixer.Mixer(shared.value)
            mass = np.concatenate(mixer.learn(own, counts))
            weights = np.concatenate([mixer.weights_a, mixer.weights_b]) * mass[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mass)), pa.int32()), pa.array(mass), *map(pa.array, weights.T.copy())], names=["gate", "mass", *(f"w{k}" for k in range(n))])

    schema = "gate int, mass double, " + ", ".join(f"w{k} double" for k in range(n))
    sums = words.mapInArrow(run, schema).groupBy("gate").agg(F.sum("mass").alias("mass"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(n)))
    start = bit_mixer.Mixer([])
    both = np.concatenate([start.weights_a, start.weights_b])
    for gate, mass, *weights in sums.where("mass > 0").collect():
        both[gate] = np.round(np.array(weights) / mass, 6)
    return both[: bit_mixer.GATES_A], both[bit_mixer.GATES_A :]


def learn_correction(words: DataFrame, shared: Broadcast, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (counts,) = _words_of(batches, "tune")
        if own:
            zeros, ones = bit_mixer.Mixer(shared.value, *weights).outcomes(own, counts)
            some = np.flatnonzero(zeros + ones)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(zeros[some]), pa.array(ones[some])], names=["cell", "zeros", "ones"])

    counts = np.zeros((2, 256 * bit_mixer.STEPS), np.int64)
    for cell, zeros, ones in words.mapInArrow(run, "cell long, zeros long, ones long").groupBy("cell").agg(F.sum("zeros"), F.sum("ones")).collect():
        counts[:, cell] = zeros, ones
    return bit_mixer.correction_of(counts)


def score_words(vocabulary: DataFrame, tables: Broadcast, weights: tuple[np.ndarray, np.ndarray], correction: np.ndarray) -> DataFrame:
    """``vocabulary`` with the log10 chance of each word as ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = bit_mixer.Mixer(tables.value, *weights, correction)
        for batch in batches:
            yield batch.append_column("score", pa.array(mixer.log10(batch.column("word").to_pylist())))

    return vocabulary.mapInArrow(run, StructType([*vocabulary.schema.fields, StructField("score", DoubleType())]))


def learned_scores(vocabulary: DataFrame, pages: DataFrame, tune: DataFrame) -> DataFrame:
    """The scores of all words, written: weights and correction are learned on the tables without the fold of ``tune``, scores come from all."""
    context = vocabulary.sparkSession.sparkContext
    fit = context.broadcast(read_tables(pages, "fit"))
    weights = learn_weights(tune, fit)
    correction = learn_correction(tune, fit, weights)
    fit.destroy()
    del fit  # the driver's own copy
    every = context.broadcast(read_tables(pages, "every"))
    scored = materialize(score_words(vocabulary, every, weights, correction), "scores")
    every.destroy()
    return scored


def class_numbers(docs: DataFrame) -> tuple[list[str], list[int]]:
    """The most frequent class values of training documents, and the number of such documents by class; the last class has all other values."""
    counts = docs.where(F.col("fold") != HELD).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(MAX_CLASSES - 1).collect()
    every = counts.agg(F.sum("n")).first()[0] or 0
    return [r["value"] for r in top], [*(r["n"] for r in top), every - sum(r["n"] for r in top)]


def least_frequent(counts: DataFrame) -> int:
    """The least number of occurrences that at most ``FREQUENT`` words have, by counts ``n`` of words on a logarithmic scale of some hundred steps."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    words, least = 0, 1 << 62
    for r in steps:
        words += r["words"]
        if words > FREQUENT:
            break
        least = r["least"]
    return least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang") -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    value = F.coalesce(F.col(f"`{class_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), value.alias("value"), text.alias("text"))
    rows = rows.withColumn("fold", F.crc32(id_text("id").cast("binary")) % FOLDS)
    names, n_docs = class_numbers(rows)
    n_classes = len(n_docs)
    cls = reduce(lambda c, k: c.when(F.col("value") == names[k], k), range(len(names)), F.when(F.lit(False), 0)).otherwise(len(names))

    counted = rows.select("fold", cls.cast("int").alias("cls"), "text").mapInArrow(count_words, "word binary, cls int, fit long, tune long, held long")
    by_class = [F.sum(F.when(F.col("cls") == k, F.col("fit") + F.col("tune")).otherwise(0)).alias(f"c{k}") for k in range(n_classes)]
    # In order, as words that begin alike share their first bits.
    summed = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("fit", "tune", "held")), *by_class)
    vocabulary = materialize(summed.repartitionByRange("word").sortWithinPartitions("word"), "words")
    trained = F.col("fit") + F.col("tune")
    total = vocabulary.agg(
        F.coalesce(F.sum(trained), F.lit(0)).alias("n"), F.count_if(trained > 0).alias("v"), F.count_if(F.col("tune") > 0).alias("tune"), F.coalesce(F.sum(trained + F.col("held")), F.lit(0)).alias("all"),
        *(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(n_classes)),
    ).first()

    words = vocabulary.where(trained > 0).select("word", "fit", "tune").coalesce(math.ceil((total["v"] + 1) / TABLE_WORDS))
    pages = materialize(words.mapInArrow(gather_cells, "k int, page int, part int, cells binary").groupBy("k", "page").applyInPandas(merge_page, "k int, page int, fit binary, every binary"), "pages")
    # The order is the words' own hash, so that a rerun learns the same.
    tune = vocabulary.where("tune > 0").select("word", "tune").repartition(math.ceil((total["tune"] + 1) / LEARN_WORDS), "word").sortWithinPartitions(F.xxhash64("word"), "word")
    with batches_of(spark, SCORED_WORDS):
        scored = learned_scores(vocabulary, pages, tune)

    # The chance of a word under a class: its own, times what the class has of it, by that product's sum over all words.
    share = [(total[f"c{k}"] + 1 / n_classes) / (total["n"] + 1) for k in range(n_classes)]
    own = [(F.col(f"c{k}") + CLASS_PRIOR * share[k]) / (trained + CLASS_PRIOR) for k in range(n_classes)]
    beyond = scored.where(trained > 0).agg(*(F.coalesce(F.sum(F.pow(F.lit(10.0), "score") * (own[k] - share[k])), F.lit(0.0)) for k in range(n_classes))).first()
    gate = [F.log10(own[k] / F.lit(max(share[k] + beyond[k], 1e-12))).alias(f"g{k}") for k in range(n_classes)]
    base = F.log10((trained + 1) / F.lit(float(total["n"] + total["v"] + 1))).alias("base")
    sums = ["known", "base", "score", *(f"g{k}" for k in range(n_classes))]
    least = least_frequent(scored.select((trained + F.col("held")).alias("n")))
    frequent = trained + F.col("held") >= least
    valued = scored.select("word", frequent.alias("frequent"), (trained > 0).cast("double").alias("known"), base, "score", *gate)
    listed = valued.where("frequent").select("word", *sums).toArrow()
    places = {w: i for i, w in enumerate(listed.column("word").to_pylist())}
    table = spark.sparkContext.broadcast((places, np.stack([listed.column(c).to_numpy() for c in sums], axis=1)))
    del listed, places

    head = pa.struct([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.float64()) for c in sums)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with the sums of its frequent words, under a word that no text can hold; then a row for each other word."""
        places, values = table.value
        columns = ["key", "word", "times", "head"]
        for batch in batches:
            numbers, tokens, sizes, parts = batch.column("key").to_pylist(), [], [], []
            keys: list[int] = []
            rest: list[bytes] = []
            times: list[int] = []
            for key, text in zip(numbers, batch.column("text"), strict=True):
                own, letters = Counter((END,)), 0
                for found in words_in(text.as_py(), WORDS):
                    own.update(found)
                    letters += sum(map(len, found))
                at = np.fromiter(map(places.get, own, repeat(-1)), np.int64, len(own))
                n = np.fromiter(own.values(), np.int64, len(own))
                tokens.append(int(n.sum()))
                sizes.append(letters + tokens[-1])  # a space or the end after each
                parts.append(n[at >= 0] @ values[at[at >= 0]])
                before = len(rest)
                rest.extend(compress(own, at < 0))
                keys += [key] * (len(rest) - before)
                times += n[at < 0].tolist()
            summed = np.array(parts).reshape(len(numbers), len(sums))
            about = [batch.column("id"), pa.array([f == HELD for f in batch.column("fold").to_pylist()], pa.bool_()), pa.array(tokens, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, summed.T.copy())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([b" %d" % k for k in numbers], pa.binary()), pa.array([0] * len(numbers), pa.int64()), pa.StructArray.from_arrays(about, fields=list(head))], names=columns)
            for a in range(0, len(keys), 100_000):
                some = slice(a, a + 100_000)
                made = [pa.array(keys[some], pa.int64()), pa.array(rest[some], pa.binary()), pa.array(times[some], pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(made[0]), head)], names=columns)

    schema = "key long, word binary, times long, head struct<id: long, held_out: boolean, n_tokens: long, n_bytes: long, " + ", ".join(f"{c}: double" for c in sums) + ">"
    dealt = rows.select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), "fold", "text").mapInArrow(split, schema)
    joined = dealt.join(valued.where("NOT frequent").drop("frequent"), "word", "left")
    # Numbers alone, so that they are summed by hash.
    about = [F.max("head.id").alias("id"), F.max("head.held_out").alias("held_out"), F.max("head.n_tokens").alias("n_tokens"), F.max("head.n_bytes").alias("n_bytes")]
    added = [F.sum(F.coalesce(F.col(f"head.{c}"), F.col(c) * F.col("times"), F.lit(0.0))).alias(c) for c in sums]
    by_doc = joined.groupBy("key").agg(*about, *added)
    weighed = [F.lit(math.log10(n + 1 / n_classes) - math.log10(sum(n_docs) + 1)) + F.col(f"g{k}") for k, n in enumerate(n_docs)]
    best = F.greatest(*weighed) if n_classes > 1 else weighed[0]
    score = F.col("score") + best + F.log10(reduce(lambda a, b: a + b, [F.pow(F.lit(10.0), w - best) for w in weighed]))
    return by_doc.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        F.round("base", 9).alias("base_score"), F.round(score, 9).alias("score"), F.round(-score / math.log10(2) / F.col("n_bytes"), 9).alias("bits_per_byte"),
    )


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))
