"""Audit of how far the sources of a language diverge in their use of terms, in whole numbers throughout.

Terms are runs of letters (A-Z lower-cased). Tasks count them by (lang, source) before anything is shuffled; a language keeps the terms
that at least ``MIN_DOCS`` of its documents hold. Its kept terms are dealt into blocks by hash and its sources into tiles by
number; a task gets one block of two tiles as a dense matrix of int64 counts, turns it into smoothed shares, and computes all
pairs of sources by broadcasting. Spark sums the partial pair values over blocks and merges each block's leading terms.
A tile holds at most ``SOURCES`` sources and a block about ``TERMS`` terms whatever the size of the corpus, so a task's memory is
bounded; the number of pairs of sources of a language is the size of the result itself.

Defined cases: null text, lang and source are empty strings; repeated rows and repeated ids count as documents of their own; a group
without terms has the smoothed share of count 0 everywhere; a language without kept terms gives pairs of value 0; a language
with one source gives no pairs; ties go by the UTF-8 order of the item; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, materialize, read_table
from ._words import TERMS as TERM_BYTES
from ._words import words_in

MIN_DOCS = 10
#: Rows of the `term` part for each group.
TOP = 10
#: Terms of a block on average, and sources of a tile at most: two tiles of a block hold 4 MB of counts.
TERMS = 4096
SOURCES = 64
#: A task sends on what it has counted when it holds so many (group, term) entries.
HELD = 300_000
PARTIAL = "lang string, source string, term string, n long, d long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) in a task's documents, in parts of bounded size."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in counts.items():
            terms = [*n]
            for at in range(0, len(terms), 50_000):
                own = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([d[t] for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            n, d = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in words_in(text.as_py(), TERM_BYTES):
                n.update(words)
                seen.update(words)
            d.update(seen)
        if sum(len(n) for n, _ in counts.values()) + len(counts) > HELD:
            yield from flush()
    yield from flush()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total) in int64, by two digits groups, so that no product overflows."""
    high, rest = np.divmod(counts * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial pair values and leading terms of one block of terms and two tiles of sources (the same one twice on the diagonal).

    Rows without a term name the groups; the others are the cells of the matrix that are not 0.
    """
    head, cells = rows[rows["term"].isna()].sort_values("place"), rows[rows["term"].notna()]
    lang, low, high, n_terms = head["lang"].iloc[0], int(head["low"].iloc[0]), int(head["high"].iloc[0]), int(head["n_terms"].iloc[0])
    names, tiles, places = head["source"].to_numpy(), head["tile"].to_numpy(), head["place"].to_numpy()
    codes, terms = pd.factorize(cells["term"], sort=True)
    counts, totals = np.zeros((len(head), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    counts[np.searchsorted(places, cells["place"].to_numpy()), codes] = cells["n"].to_numpy()
    totals[codes] = cells["total"].to_numpy()
    p = shares(counts + 2, (head["size"].to_numpy(np.int64) + 2 * n_terms)[:, None]) if len(terms) else counts
    out: list[tuple[str, str, str, str, int]] = []
    for a in np.flatnonzero(tiles == low):
        others = np.flatnonzero(tiles == high)
        others = others[others > a]
        sums = divergences(p[a], p[others]).sum(axis=1)
        out += [(lang, names[a], "pair", names[b], int(v)) for b, v in zip(others, sums, strict=True)]
    if low == high and len(terms):
        q = shares(totals + 2, np.int64(head["lang_size"].iloc[0] + 2 * n_terms))
        for a in range(len(head)):
            above = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            values = divergences(p[a, above], q[above])
            lead = np.lexsort((above, -values))[:TOP]
            out += [(lang, names[a], "term", terms[above[k]], int(values[k])) for k in lead]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from each other source and the terms it leads in."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    named = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    every = Window.partitionBy("lang", "term")
    # Dealt once by (lang, term): the counts of a group and the language's own need no further shuffle.
    counted = named.mapInArrow(count_terms, PARTIAL).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counted = counted.withColumns({"total": F.sum("n").over(every), "df": F.sum("d").over(every), "first": F.min("source").over(every) == F.col("source")})
    kept = materialize(counted.where(F.col("df") >= min_docs).select("lang", "source", "term", "n", "total", "first"), "terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("own_terms"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["size", "own_terms"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns(
        {
            "place": F.row_number().over(by_lang.orderBy("source")) - 1,
            "tiles": F.ceil(F.count(F.lit(1)).over(by_lang) / SOURCES),
            "lang_size": F.sum("size").over(by_lang),
            "n_terms": F.sum("own_terms").over(by_lang),
        }
    )
    groups = groups.withColumns({"tile": F.floor(F.col("place") / SOURCES), "blocks": F.greatest(F.lit(1), F.ceil(F.col("n_terms") / TERMS))})
    groups = materialize(groups.drop("own_terms"), "groups")

    cells = kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    columns = ["lang", "source", "place", "tile", "tiles", "size", "lang_size", "n_terms", "block", "term", "n", "total"]
    dealt = cells.select(columns).unionByName(heads.select(columns)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}).drop("with", "tiles")
    found = materialize(dealt.groupBy("lang", "block", "low", "high").applyInPandas(compare_tile, "lang string, source string, part string, item string, value long"), "tiles")

    half = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, found.where("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents", ["text", "lang", "source"]))


OP13_SQL = r"""
WITH named AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM named
), vocabulary AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM vocabulary GROUP BY lang
), counted AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN vocabulary USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM named) LEFT JOIN counted USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, y.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.size + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (y.total + 2) // (l.size + 2 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN vocabulary y USING (lang)
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = y.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms)
WHERE rank <= 10
"""
