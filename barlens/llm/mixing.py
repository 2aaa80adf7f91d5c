"""Mixing sources to target weights with DataFrame functions only.

Sizes in words are summed by source. Every source has a weight and a share of the corpus total by weight, at most ``most`` times its own size;
the excess of the stopped sources is shared again by weight until none is above. A source's rate is its target over its size:
each document is emitted floor(rate) times, and once more if the hash of its id falls below the fraction. The sources' rates
are broadcast when their number is small; otherwise they are joined on (source, salt), as one source may hold a
large part of all rows. Draws are independent, so a source of few, very long documents can miss its target: of about 50
documents by a third, of 500 by a tenth.

Defined cases: a null text has size 0, and a document of size 0 is taken like any other of its source but adds no words; a null
source is a source of its own, ordered last; a source without words has target 0 and is not taken; rows that repeat an id
share one decision; an empty table gives an empty result; the input's other columns stay, helper columns take unused names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import id_text, materialize, read_table, whole_text

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No target is above this many times its source's size.
MOST = 3
#: Up to so many sources (about 50 bytes each) the table of rates is broadcast.
MAX_BROADCAST_SOURCES = 50_000
SALTS = 32


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and ``\\x09``-``\\x0D``."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, size): one row for each source.

    Sharing again and again by weight ends where each target is the lesser of its stop and weight times one level.
    Sources in order of stop over weight: those before the first that the level of the rest leaves at or below its stop are
    stopped; from there on levels only fall, so its level is the largest of those that hold.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The windows below have one row for each source, not for each document.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        by_source.withColumn("weight", place.cast("double"))
        .withColumn("stop", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("stop") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    )
    return levels.select("source", "source_size", F.least("stop", F.col("weight") * F.col("level")).alias("target"))


def chance(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed alone (52 bits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(id_col))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def with_copies(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, seed: str, copies: str) -> DataFrame:
    """``docs`` with the columns of ``targets`` that are not its own key, and ``copies``."""
    rates = targets.withColumnRenamed("source", "__source")
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    if targets.count() <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS))
        salted = rates.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__salt", salt).join(salted, same & (F.col("__salt") == F.col("__salt_r"))).drop("__salt", "__salt_r")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (chance(id_col, seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.floor(rate) + extra).drop("__source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(whole_text(text_col)).alias("size"))
    targets = materialize(source_targets(sizes, weights, most), "targets")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    taken = with_copies(rows, targets, "doc_id", "source", seed, "copies").where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    sized = materialize(docs.select("doc_id", "source", word_count(whole_text()).alias("size")), "sizes")
    targets = materialize(source_targets(sized), "targets")
    taken = with_copies(sized, targets, "doc_id", "source", "mix", "copies")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, source_size * 3.0::DOUBLE AS stop, source_size * 3.0::DOUBLE / weight AS ratio FROM by_source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios
), targets AS (
  SELECT source, source_size, least(stop, weight * (SELECT max(level) FROM levels WHERE ratio >= level)) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus; a document that is taken twice has two rows, one that is not taken has none."""
    return mix(docs)
