"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits by exact tiled comparison.

Fingerprints are made in Arrow batches. Only distinct ones are compared. Two that differ in at most r bits agree in one of
r + 1 blocks of bits, so each goes to r + 1 buckets, one for each block; groups of buckets are sorted by bucket and population
count and compared tile by tile with numpy's exclusive-or and bit counts, skipping tile pairs that share no bucket or
whose population counts differ beyond r. A bucket larger than a group is dealt out as pairs of tiles, by population count
and a hash, with the same skip. A group returns a spanning forest of its links, not the links. Components of the forests are
those of all links.

The pipeline's stage drops texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Its candidates are the texts whose fingerprints,
of these shingles, are linked by the same tiled comparison at 3 bits, which are the closest copies. At 0.8 fingerprints differ in about 10 of 64 bits and often in 15, and buckets
for such a radius are 4 bits wide, which is all pairs; so MinHash bands add what is further apart (0.997 of pairs at 0.8, more above). Every
candidate is verified on the whole texts.

Defined cases: a null or empty text has fingerprint zero and is linked as any other; fewer than three words are one
shingle; repeated rows share a component; a null doc_id is never a component's id while there is another (in
``drop_near_duplicates`` it stays only when its whole component has none); other columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, materialize, read_table
from ._shingles import band_keys, kept_shingles, shingles_of, words_of
from .components import connected_components
from .jaccard import THRESHOLD
from .jaccard import near_links as jaccard_links

SHINGLE = 3
SEED = 42
_xxh64 = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text: a bit is 1 if it is in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only \x20 and \x09-\x0D part words
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if n > 1 or len(words) == SHINGLE else iter([b" ".join(words)])
    return majority(np.fromiter(map(_xxh64, shingles), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def hex16(fp: Column) -> Column:
    """A fingerprint, kept as a signed long, as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _blocks(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that cover all bits."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each link, and all that share their labels, the lesser label."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def link_tiles(fps: np.ndarray, bucket: np.ndarray, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a bucket with the one that stands for it: a forest over all links within buckets."""
    counts = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((counts, bucket))
    fps, bucket, counts = fps[order], bucket[order], counts[order]
    labels = np.arange(len(fps))
    for i in range(0, len(fps), tile):
        a = slice(i, min(i + tile, len(fps)))
        for j in range(i, len(fps), tile):
            b = slice(j, min(j + tile, len(fps)))
            if bucket[b.start] != bucket[a.stop - 1] and j > i:
                break  # later tiles share no bucket with this one
            if bucket[a.start] == bucket[b.stop - 1] and counts[b.start] - counts[a.stop - 1] > radius:
                break  # one bucket, sorted by population count: later tiles differ even more
            near = np.bitwise_count(fps[a, None] ^ fps[None, b]) <= radius
            near &= bucket[a, None] == bucket[None, b]
            x, y = np.nonzero(near)
            _join_labels(labels, x + a.start, y + b.start)
    moved = labels != np.arange(len(fps))
    return fps[moved], fps[labels[moved]]


def near_links(fps: DataFrame, radius: int = 2, group_rows: int = 4096) -> DataFrame:
    """(u, v): a forest with the components of all links between the distinct fingerprints ``fps`` (fp, long)."""
    n = fps.count()
    groups = max(1, -(-n // group_rows))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("bucket")) for k, (s, w) in enumerate(_blocks(radius))])
    dealt = fps.select("fp", F.inline(keys))
    hot = materialize(dealt.groupBy("k", "bucket").count().where(F.col("count") > group_rows), "hot-buckets")
    if hot.take(1):
        dealt = dealt.join(hot, ["k", "bucket"], "left")
        parts = F.ceil(F.col("count") / group_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        # A tile is (population count, part). A row goes to every pair of its own tile and one within the radius.
        others = F.flatten(
            F.transform(
                F.sequence(F.greatest(F.lit(0), F.bit_count("fp") - radius), F.bit_count("fp") + radius),
                lambda c: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: c * F.lit(1 << 20) + p),
            )
        )
        mine = F.bit_count("fp") * F.lit(1 << 20) + own
        pairs = F.transform(others, lambda o: F.concat_ws("-", F.least(o, mine), F.greatest(o, mine)))
        dealt = dealt.select("fp", "k", "bucket", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(""))).otherwise(pairs)).alias("pair"))
    else:
        dealt = dealt.withColumn("pair", F.lit(""))
    shared = F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("string")
    grouped = dealt.select("fp", "bucket", "k", F.when(F.col("pair") == "", shared).otherwise(F.concat_ws("/", "bucket", "pair")).alias("g"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = link_tiles(rows["fp"].to_numpy().view(np.uint64), rows["bucket"].to_numpy(), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return grouped.groupBy("k", "g").applyInPandas(compare, "u long, v long")


def group_fingerprints(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, best) for the fingerprints of ``rows`` (fp, best; the latter any orderable column): the least ``best`` of all
    rows whose fingerprints can be reached."""
    fps = materialize(rows.groupBy("fp").agg(F.min("best").alias("best")), "fingerprints")
    linked = connected_components(near_links(fps.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = materialize(fps.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "best"), "linked")
    least = named.groupBy("component").agg(F.min("best").alias("best"))
    return named.select("fp", "component").join(least, "component").select("fp", "best")


def _with_fingerprints(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their fingerprint and a number, in shared storage; rows without a doc_id are the last to stand for others."""
    bounded_batches(docs.sparkSession)
    row = F.struct(*columns).alias("row")
    return materialize(docs.select(row, fingerprint_of("text").alias("fp"), F.monotonically_increasing_id().alias("rid")), "simhash").withColumn(
        "best", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    )


def simhash_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    rows = _with_fingerprints(docs, ["doc_id"])
    groups = group_fingerprints(rows.select("fp", "best"), radius).select("fp", F.col("best.doc_id").alias("component_id"))
    return rows.select("row.doc_id", "fp").join(groups, "fp")


def drop_near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each component, the one with the least doc_id; columns unchanged."""
    rows = _with_fingerprints(docs, docs.columns)
    kept = group_fingerprints(rows.select("fp", "best"), radius).select(F.col("best.rid").alias("rid")).distinct()
    return rows.join(kept, "rid", "left_semi").select("row.*")


def brute_force(texts: dict[int, str | None], radius: int = 2) -> dict[int, int]:
    """Component ids from all pairs, for tests."""
    fps = {i: fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in fps}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    def pairs() -> Iterator[tuple[int, int]]:
        ids = sorted(fps)
        yield from ((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :])

    for a, b in pairs():
        if (fps[a] ^ fps[b]).bit_count() <= radius and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in fps}


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash_components(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return linked.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Bits by which fingerprints of five-word shingles may differ for their texts to be compared, whatever their bands.
STAGE_RADIUS = 3
#: MinHash bands of whole texts: a pair at 0.8 collides with probability 1 - (1 - 0.8^3)^8 = 0.997.
BANDS, ROWS = 8, 3
_NO_WORDS = np.zeros(1, dtype=np.uint64)


def _words(text: str | None) -> np.ndarray:
    words = words_of(text)[2]
    return words if len(words) else _NO_WORDS


@F.pandas_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _whole_texts(texts: pd.Series) -> pd.DataFrame:
    digests, prints, bands = [], [], []
    for at in range(0, len(texts), 200):
        words = list(map(_words, texts.iloc[at : at + 200]))
        shingles = list(map(shingles_of, words))
        digests += map(xxhash.xxh3_128_digest, words)
        prints += map(majority, shingles)
        bands += list(band_keys(np.concatenate(shingles), np.cumsum([0, *map(len, shingles[:-1])]), BANDS, ROWS))
    return pd.DataFrame({"digest": digests, "fp": np.array(prints, dtype=np.uint64).view(np.int64), "bands": bands})


@F.pandas_udf(T.BinaryType())
def _whole_shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([kept_shingles(shingles_of(_words(t))) for t in texts], dtype="object")


def fingerprint_buckets(rows: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """(id, bucket) for ``rows`` (id, fp): one bucket for all whose fingerprints can be reached in steps of ``radius`` bits."""
    fps = materialize(rows.select("fp").distinct(), "fingerprints")
    linked = connected_components(near_links(fps, radius)).select(F.col("node").alias("fp"), "component")
    return rows.join(linked, "fp", "left").select("id", F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp")).alias("bucket"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of texts with that Jaccard similarity of five-word shingles, the one with the least doc_id; columns unchanged."""
    bounded_batches(docs.sparkSession)
    row = F.struct(*docs.columns).alias("row")
    rows = materialize(docs.select(row, _whole_texts("text").alias("whole"), F.monotonically_increasing_id().alias("rid")), "near-copies").select("row", "rid", "whole.digest", "whole.fp", "whole.bands")
    # Shingles are not stored: only those of colliding texts are made, after the semi-join.
    own = F.xxhash64("digest")
    found = rows.select(own.alias("id"), "bands", _whole_shingles("row.text").alias("shingles"))
    near = fingerprint_buckets(rows.select(own.alias("id"), "fp").distinct())
    linked = connected_components(jaccard_links(found, threshold, more=near)).withColumnRenamed("node", "id")
    best = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    least = rows.groupBy("digest").agg(F.min(best).alias("best")).withColumn("id", own).join(linked, "id", "left")
    kept = least.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid"))
    return rows.join(kept, "rid", "left_semi").select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates (five-word shingles, Jaccard 0.8)."""
    return drop_near_copies(docs)
