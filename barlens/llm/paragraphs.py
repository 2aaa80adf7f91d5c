"""Substring dedup by paragraphs: bands find candidates, exact edit distance verifies them, components decide removals.

Passages are copied with other text before and after them, with other line breaks, and with words changed, so a paragraph is not a line: it is
a run of WIDTH words that begins where the text itself says. Of any WINDOW successive places in a text, the one whose
five words have the least hash begins a paragraph (winnowing; Schleimer et al., 2003). Any passage of WIDTH + WINDOW - 1 = 43 words
or more therefore has, wherever it stands, at least one paragraph in common with its exact copies; shorter passages of 20 words and
more are found with a chance that grows with their length. The whole text is cut so; lines and their lengths play no part.

That least hash is a MinHash of the window, and a changed word seldom moves it, so it is the band: paragraphs that begin with equal
five words collide. They are linked if at most a fifth of the words have to be changed, left out or put in (edit similarity 0.8 or more, on
64-bit hashes of all words). Jaccard similarity of five-word shingles would not do: one changed word in the middle of 20 takes away 5 of 16.

A first pass over whole texts gives each paragraph's place, a 128-bit digest of its words (A-Z as a-z) and its band. Bands are
aggregated to the least and greatest paragraph, so that a band that only copies share is dropped at once. A second pass gives the words of
paragraphs whose bands are left, found by a bitmap of fixed size and then by a join; from then on equal paragraphs are one. Groups of
bands go to tasks. Two paragraphs within four edits have three successive words in common behind the first five, so a band is parted by such runs.
They also have all words but four in common, and so, in any one order of words, one of the first five of each: with the rarest words first,
paragraphs made from one form with other words in its gaps, of which few are near, seldom meet. A part of more than PART_ROWS paragraphs goes to the buckets of
its five rarest words, and these again, as long as that halves the pairs at least.
In each bucket all are compared with a centre, and by the triangle inequality only those between four and eight edits from it need be
compared with the ones it takes. A task returns fewer links than it has paragraphs. A band with more than BAND_ROWS distinct
paragraphs does not go to one task: each of them goes to the buckets of its own five rarest words, by counts in a table of fixed size, and only what is
still large there is dealt out as pairs of tiles.

What is reported are the paragraphs whose component stands in two rows or more. The first paragraph of each component (least
doc_id, then place) stays, the others are removed. Where a removed paragraph and the next one in the text go on like the
first ones that stay, its end is moved to the start of the next, so that a passage is removed in one piece, but for up to
23 words at either end.

Defined cases: null and empty texts and texts of fewer words than WIDTH have no paragraphs; what is repeated within one row alone
is not reported; rows that repeat a doc_id are rows of their own; a null doc_id is ordered last; very long texts are cut whole;
of a run of equal words or phrases, in which all places are alike, about one place in WINDOW is taken; ``remove`` keeps all
other columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batches_of, materialize, read_table
from ._shingles import SHINGLE, mixed, shingles_of, words_of
from .components import connected_components

#: Words of a paragraph, and places of which one begins one.
WIDTH, WINDOW = 20, 24
THRESHOLD = 0.8
#: Words of the runs that part a large band, and bits of the bitmap of bands.
RUN = 3
BITMAP_BITS = 24
#: Rows of a group of bands on average, those from which a band is parted, and those from which a part within a task is.
GROUP_ROWS, BAND_ROWS, PART_ROWS = 1024, 20_000, 64
#: Bits of the table that counts the words of large bands.
COUNT_BITS = 18
#: Characters of the texts that a task cuts together.
BLOCK_CHARS = 1_000_000


def places(keys: np.ndarray, window: int) -> np.ndarray:
    """The leftmost place of the least key in each window of that many (of all, if fewer); of equal keys that follow one another, one in ``window``."""
    if len(keys) <= window:
        return np.array([keys.argmin()]) if len(keys) else np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(keys, window)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    apart = np.append(True, (keys[at[1:]] != keys[at[:-1]]) | (np.diff(at) >= window))
    if apart.all():
        return at
    run = at[np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))]
    turn = (at - run) // window
    return at[apart | (np.diff(turn, prepend=0) > 0)]


def cut(texts: Iterable[str | None], width: int, window: int) -> tuple[list, np.ndarray]:
    """(text, number, start, end, step, band) of each paragraph as arrays, and the hashes of its words (paragraph, word).

    step: a hash of the words from this paragraph's start to the next one's, 0 for a text's last one."""
    text_no, number, start, end, step, band, runs = [], [], [], [], [], [], []
    for i, text in enumerate(texts):
        starts, ends, words = words_of(text)
        if len(words) < width:
            continue
        shingles = shingles_of(words)
        at = places(shingles[: len(words) - width + 1], window)
        text_no.append(np.full(len(at), i))
        number.append(np.arange(len(at)))
        start.append(starts[at])
        end.append(ends[at + width - 1])
        sums = np.cumsum(shingles)[at]
        step.append(np.append((sums[1:] - sums[:-1]) >> np.uint64(32), np.uint64(0)).astype(np.uint32))
        band.append(shingles[at])
        runs.append(words[at[:, None] + np.arange(width)])
    if not text_no:
        return [np.empty(0, dtype=np.int64)] * 4 + [np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint64)], np.empty((0, width), dtype=np.uint64)
    return [*map(np.concatenate, (text_no, number, start, end, step, band))], np.concatenate(runs)


def binaries(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    n, size = len(values), values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(values))])


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BLOCK_CHARS`` characters."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t or "") > BLOCK_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t or "")
    yield first, len(texts)


def digests(runs: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(r) for r in np.ascontiguousarray(runs)]


def extract(docs: DataFrame, width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """(rid, doc_id, number, start, end, step, digest, band) from ``docs`` (rid, doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, stop in blocks(texts):
                (text_no, number, start, end, step, band), runs = cut(texts[first:stop], width, window)
                if not len(number):
                    continue
                row = pa.array(text_no + first)
                columns = [batch.column("rid").take(row), batch.column("doc_id").take(row), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(step.view(np.int32)), pa.array(digests(runs), pa.binary()), pa.array(band.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "number", "start", "end", "step", "digest", "band"])

    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, number int, start long, end long, step int, digest binary, band long")


def bitmap_of(bands: DataFrame) -> np.ndarray:
    """One bit for each value of the bands' last bits: 2 MB at any number of bands, so what it lets through is joined exactly afterwards."""
    bit = F.col("band").bitwiseAND((1 << BITMAP_BITS) - 1)
    by = bands.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((band & {(1 << BITMAP_BITS) - 1}) & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    found = by.toArrow()
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def colliding_words(docs: DataFrame, bands: DataFrame, width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """(digest, id, band, words): each distinct paragraph of ``docs`` (text) whose band is among ``bands``, with the 64-bit hashes of its words."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(bands))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, stop in blocks(texts):
                (*_, band), runs = cut(texts[first:stop], width, window)
                low = band & np.uint64((1 << BITMAP_BITS) - 1)
                own = np.flatnonzero(bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                if len(own):
                    columns = [pa.array(digests(runs[own]), pa.binary()), pa.array(band[own].view(np.int64)), binaries(runs[own])]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "band", "words"])

    found = docs.select("text").mapInArrow(run, "digest binary, band long, words binary").join(bands, "band", "left_semi")
    return found.groupBy("digest").agg(F.first("band").alias("band"), F.first("words").alias("words")).withColumn("id", F.xxhash64("digest"))


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Words changed, left out or put in to make each row of ``b`` of the same row of ``a``: at most that many where it is ``most`` or less, exact up to
    twice ``most``, and more than that beyond."""
    n = a.shape[1]
    out = (a != b).sum(axis=1)
    for at in range(0, len(a), 20_000):
        part = at + np.flatnonzero(out[at : at + 20_000] > most)
        x, y = a[part], b[part]
        # Words without a like bound the edits from below; what is left needs the whole table.
        low = n - (y[:, :, None] == x[:, None, :]).any(axis=2).sum(axis=1)
        out[part] = 2 * most + 1
        part, x, y = part[low <= 2 * most], x[low <= 2 * most], y[low <= 2 * most]
        row = np.repeat(np.arange(n + 1, dtype=np.int16)[:, None], len(part), axis=1)
        for i in range(n if len(part) else 0):
            after = np.empty_like(row)
            after[0] = i + 1
            changed = row[:-1] + (y != x[:, i : i + 1]).T
            for k in range(1, n + 1):
                np.minimum(np.minimum(row[k] + 1, after[k - 1] + 1), changed[k - 1], out=after[k])
            row = after
        if len(part):
            out[part] = np.minimum(row[-1], 2 * most + 1)
    return out


def runs_of(words: np.ndarray) -> np.ndarray:
    """A hash of each run of ``RUN`` words behind the band's five, row by row."""
    rest = words[:, SHINGLE:]
    n = rest.shape[1] - RUN + 1
    out = np.zeros((len(words), n), dtype=np.uint64)
    for k in range(RUN):
        out = (out ^ rest[:, k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sharing(words: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Buckets parted so that rows which share no run of ``RUN`` words behind the first five, directly or through others, are apart."""
    runs = runs_of(words) ^ (bucket.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
    _, key = np.unique(runs, return_inverse=True)
    key = key.reshape(runs.shape)
    label = np.arange(len(words))
    while True:
        least = np.full(key.max() + 1, len(words))
        np.minimum.at(least, key.ravel(), np.repeat(label, key.shape[1]))
        after = least[key].min(axis=1)
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after


def numbered(words: np.ndarray) -> np.ndarray:
    """The words behind the band's five, row by row in order of their hashes; a word's second place in a row and further ones count as words of their own."""
    rest = np.sort(words[:, SHINGLE:], axis=1)
    at = np.broadcast_to(np.arange(rest.shape[1]), rest.shape)
    first = np.maximum.accumulate(np.where(np.diff(rest, axis=1, prepend=~rest[:, :1]) != 0, at, 0), axis=1)
    return rest ^ (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def rarest(words: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` + 1 words of each row that have the least ``counts``, ties to the lesser word. Rows of equally many words, all different,
    that have all but ``most`` in common have one of these in common, as long as a word's count is the same in both."""
    return np.lexsort((words, counts), axis=1)[:, : most + 1]


def parted(words: np.ndarray, bucket: np.ndarray, most: int, part_rows: int = PART_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): for all pairs of rows of a ``bucket`` within ``most`` edits a bucket that holds both. Buckets of more than ``part_rows`` rows are parted by
    their rarest words, the parts again by the words that are rare in them, as long as that halves the number of pairs."""
    own, row, found, below = numbered(words), np.arange(len(words)), [], 0
    while len(row):
        _, bucket, size = np.unique(bucket, return_inverse=True, return_counts=True)
        large = size[bucket] > part_rows
        found.append((row[~large], bucket[~large] + below))
        below += len(size)
        row, bucket = row[large], bucket[large]
        if not len(row):
            break
        keys = own[row]
        _, code, counts = np.unique(mixed(keys ^ mixed(bucket.astype(np.uint64) + np.uint64(1))[:, None]), return_inverse=True, return_counts=True)
        code = code.reshape(keys.shape)
        code = np.take_along_axis(code, rarest(keys, counts[code], most), 1)
        n = np.bincount(code.ravel())
        # Each row of a part stands for as many pairs as the part has rows.
        pairs = np.bincount(bucket, weights=n[code].sum(axis=1), minlength=len(size))
        spared = (2 * pairs <= size.astype(float) ** 2)[bucket]
        found.append((row[~spared], bucket[~spared] + below))
        below += len(size)
        row, bucket = np.repeat(row[spared], code.shape[1]), code[spared].ravel()
        met = n[bucket] > 1
        row, bucket = row[met], bucket[met]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, bucket)


def forest_of(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than ``n`` links with the components of the links between rows below ``n``."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != label[label]).any():
            label = label[label]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def edit_forest(ids: np.ndarray, words: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of all pairs within a bucket that are within ``most`` edits, fewer than there are rows.

    In rounds, all parts of buckets at once: a part's centre is compared with its rows. Those within ``most`` are linked to it and done, as what is more than twice ``most``
    from the centre cannot be within ``most`` of them; rows in between are linked to one of those that are done, if any is near. The rest go on."""
    links: list[tuple[np.ndarray, np.ndarray]] = []
    _, bucket = np.unique(bucket, return_inverse=True)
    rows, bucket = parted(words, sharing(words, bucket), most)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    while len(rows):
        first = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        size = np.diff(np.append(first, len(rows)))
        several = np.repeat(size > 1, size)
        rows, bucket, size = rows[several], bucket[several], size[size > 1]
        if not len(rows):
            break
        first = np.cumsum(size) - size
        centre = rows[first].copy()
        for g in np.flatnonzero(size > 8):
            own = words[rows[first[g] : first[g] + size[g]]]
            common = np.array([v[c.argmax()] for v, c in (np.unique(col, return_counts=True) for col in own.T)])
            centre[g] = rows[first[g] + (own != common).sum(axis=1).argmin()]
        d = edit_distances(words[np.repeat(centre, size)], words[rows], most)
        near = d <= most
        linked = near & (rows != np.repeat(centre, size))
        links.append((rows[linked], np.repeat(centre, size)[linked]))
        between = (d > most) & (d <= 2 * most)
        for g in np.unique(np.repeat(np.arange(len(size)), size)[between]):
            part = slice(first[g], first[g] + size[g])
            done, away = rows[part][linked[part]], d[part][linked[part]]
            left, far = rows[part][between[part]], d[part][between[part]]
            for at in range(0, len(done), 256):
                # By the triangle inequality, too, only some of those done can be near one that is so far from the centre.
                x, y = np.nonzero(away[at : at + 256][None] >= far[:, None] - most)
                met = edit_distances(words[left[x]], words[done[at + y]], most) <= most
                who, which = np.unique(x[met], return_index=True)
                links.append((left[who], done[at + y[met][which]]))
                keep = np.ones(len(left), dtype=bool)
                keep[who] = False
                left, far = left[keep], far[keep]
                if not len(left):
                    break
        rows, bucket = rows[~near], bucket[~near]
    if not links:
        return ids[:0], ids[:0]
    u, v = forest_of(*(np.concatenate(x) for x in zip(*links, strict=True)), len(words))
    return ids[u], ids[v]


def edit_links(found: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, group_rows: int = GROUP_ROWS, bucket_rows: int = BAND_ROWS) -> DataFrame:
    """(u, v) ids: a forest with the components of all links between the paragraphs of ``found`` (id, band, words), a written table with a row for each id."""
    most = int((1 - threshold) * width + 1e-9)
    large = materialize(found.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("band"), "large-bands")

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        """Each paragraph's words, apart from band to band."""
        words = np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u8").reshape(batch.num_rows, width)
        return mixed(numbered(words) ^ mixed(batch.column("band").to_numpy().view(np.uint64))[:, None])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in filter(len, batches):
            total += np.bincount((keys_of(batch) >> np.uint64(64 - COUNT_BITS)).ravel().astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    inside = found.join(large, "band", "left_semi").select("id", "band", "words")
    by = inside.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    table[by.column("at").to_numpy()] = by.column("n").to_numpy()
    table = found.sparkSession.sparkContext.broadcast(table)

    def by_rare_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each paragraph once for each of its rarest words."""
        for batch in filter(len, batches):
            keys = keys_of(batch)
            keys = np.take_along_axis(keys, rarest(keys, table.value[(keys >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], most), 1)
            row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), pa.array(keys.ravel().view(np.int64))], names=["id", "bucket"])

    spread = materialize(inside.mapInArrow(by_rare_words, "id long, bucket long"), "parted-bands")
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = found.join(large, "band", "left_anti").select("id", F.col("band").alias("bucket"), F.lit(1).cast("long").alias("n"))
    keyed = materialize(small.unionByName(spread.join(shared, "bucket").select("id", "bucket", "n")), "buckets")
    groups = max(1, -(-keyed.count() // group_rows))
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.concat_ws("/", "bucket", F.least(p, mine), F.greatest(p, mine)))
    together = F.array(F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("string"))
    dealt = keyed.join(found.select("id", "words"), "id").select("id", "words", "bucket", F.explode(F.when(F.col("n") > bucket_rows, tiles).otherwise(together)).alias("g"))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(rows["words"]), "<u8").reshape(len(rows), width)
        u, v = edit_forest(rows["id"].to_numpy(), words, rows["bucket"].to_numpy(), most)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.groupBy("g").applyInPandas(verify, "u long, v long")


def repeated(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """The paragraphs of ``docs`` (rid, doc_id, text) that have a copy or near copy in another row: (rid, doc_id, number, start, end,
    component_id, copies, removed). number: place among the text's paragraphs; start, end: code points; component_id: doc_id of the
    component's first paragraph; copies: its number of paragraphs."""
    with batches_of(docs.sparkSession, 1000):
        found = materialize(extract(docs, width, window), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "number", "step")
    distinct = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min("rid").alias("low"), F.max("rid").alias("high"))
    own = F.xxhash64("digest")
    shared = materialize(found.groupBy("band").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("band"), "shared-bands")
    with batches_of(docs.sparkSession, 1000):
        words = materialize(colliding_words(docs, shared, width, window), "colliding")
    linked = connected_components(edit_links(words, threshold, width)).withColumnRenamed("node", "id")
    # Only paragraphs that have a copy or a link can be in a component of two rows. Joined by digest, by which they are dealt already.
    linked = materialize(words.select("id", "digest").join(linked, "id").select("digest", "component"), "linked-paragraphs")
    named = distinct.join(linked, "digest", "left").withColumn("id", own).where(F.col("component").isNotNull() | (F.col("low") < F.col("high")))
    named = materialize(named.withColumn("component", F.coalesce("component", "id")), "paragraph-components")
    groups = named.groupBy("component").agg(F.sum("n").alias("copies"), F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    groups = groups.where(F.col("low") < F.col("high")).select("component", "copies", "first")
    of_digest = materialize(named.select("digest", "component").join(groups, "component").select("digest", "copies", "first"), "repeated-paragraphs")
    member = found.select("rid", "doc_id", "number", "start", "end", "step", "digest").join(of_digest, "digest")
    kept = F.col("rid").eqNullSafe(F.col("first.rid")) & (F.col("number") == F.col("first.number"))
    member = member.withColumn("removed", ~kept)
    after = lambda c: F.lead(c).over(Window.partitionBy("rid").orderBy("number"))
    goes_on = (
        F.col("removed") & after("removed") & (after("number") == F.col("number") + 1)
        & (after("first.rid") == F.col("first.rid")) & (after("first.number") == F.col("first.number") + 1) & (F.col("step") == F.col("first.step"))
    )
    end = F.when(goes_on, F.greatest("end", after("start"))).otherwise(F.col("end"))
    return member.select("rid", "doc_id", "number", "start", end.alias("end"), F.col("first.doc_id").alias("component_id"), "copies", "removed")


def remove(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """``docs`` without the removed paragraphs."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid")), "numbered")
    out = repeated(rows, threshold, width, window).where("removed").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        result = []
        for text, own in zip(texts, spans, strict=True):
            if own is not None:
                parts, at = [], 0
                for s in own:
                    parts.append(text[at : max(at, s["start"])])
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            result.append(text)
        return pd.Series(result, dtype="object")

    cleaned = rows.join(out, "rid", "left").withColumn("text", without("text", "spans"))
    return cleaned.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns])


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumn("rid", F.monotonically_increasing_id())
    return repeated(docs).drop("rid")
