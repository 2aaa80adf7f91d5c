"""Prefix trie of conversations: which beginnings conversations share, and what sharing them saves.

A prefix of d turns is known by a chained SHA-256: the digest of its first d - 1 turns and of its last turn. Conversations are sorted
within the tasks and chained turn by turn, so memory does not grow with a conversation's length. Every prefix is a row; rows of one
(depth, digest) are the members of a node, and a node stands for its least member.

Sums over subtrees: if a conversation represents a node, it represents all nodes below it on its own path. What it represents is
first summed along its path from below; each prefix of the path then carries that sum to its own node, so each node's value reaches
all its ancestors, and the rows are one for each prefix: their number grows with the turns, not with the square of a path's length.

Defined cases: rows with a null conv_id are left out; a null role or text is empty; turns are ordered by number, null first, equal ones by the
digest of role and text, so repeated rows are turns of their own; a rebuilt conversation without turns is a member of the root alone;
``c % 20`` has the sign of c, as in SQL; an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, read_table
from .mixing import word_count

#: Conversations c to c + 19 begin with turns of c, at most HEADS - 1 of them.
FAMILY = 20
HEADS = 4
ROOT = bytes(32)
#: Ids of a node's ends are joined within ranges of 2^12 ids, so no list is longer.
END_BITS = 12
PREFIXES = "conv long, depth long, digest binary, words long, last boolean"


def turn_rows(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, digest, words) of each turn; texts go no further than this."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = table.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), word_count(text).alias("words"))
    return rows.where(F.col("conv").isNotNull())


def crc_rest(column: str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefixes of the rebuilt conversations from rows in order of (base, others than the base, conv, place)."""
    base = conv = None
    heads: list[tuple[bytes, int]] = []
    skip = depth = 0
    digest = ROOT
    out: list[tuple[int, int, bytes, int, bool]] = []
    held: tuple[int, int, bytes, int] | None = None

    def step(turn: bytes, words: int) -> None:
        nonlocal depth, digest, held
        if held is not None:
            out.append((*held, False))
        depth, digest = depth + 1, hashlib.sha256(digest + turn).digest()
        held = (conv, depth, digest, words)

    def batch_of() -> pa.RecordBatch:
        names = ["conv", "depth", "digest", "words", "last"]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        for of, own, begins, turn, words in zip(*(batch.column(c).to_pylist() for c in ("base", "conv", "h", "digest", "words")), strict=True):
            if own != conv:
                if held is not None:
                    out.append((*held, True))
                if of != base:
                    base, heads = of, []
                conv, depth, digest = own, 0, ROOT
                held = (conv, 0, ROOT, 0)
                skip = 0 if own == of else begins
                for head in heads[:skip]:
                    step(*head)
            if own == base and len(heads) < HEADS - 1:
                heads.append((turn, words))
            if skip:
                skip -= 1
            else:
                step(turn, words)
        yield batch_of()
    if held is not None:
        out.append((*held, True))
        yield batch_of()


def rebuilt_prefixes(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """A row for each prefix, the empty one included, of each rebuilt conversation."""
    rows = turns.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": crc_rest("conv", HEADS)})
    return rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "digest").select("base", "conv", "h", "digest", "words").mapInArrow(chain, PREFIXES)


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): the hash of the ascending ids of the conversations that end at a node, read as a stream."""
    parts = prefixes.where("last").groupBy("depth", "digest", F.shiftright("conv", END_BITS).alias("part"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if (depth, digest) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows_of(out)
        if at is not None:
            yield rows_of([(*at, state.hexdigest())])

    def rows_of(out: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "digest", "ends_sha256"])

    ordered = joined.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "part").select("depth", "digest", "ids")
    return ordered.mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def nodes(prefixes: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``prefixes``, a table that can be read again.

    The root's members are all conversations: they are summed map-side and never joined by key.
    """
    count = lambda df: df.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("ends"))
    top, rest = prefixes.where("depth = 0"), prefixes.where("depth > 0")
    root = count(top.groupBy()).first()
    own = top.withColumns({c: F.lit(root[c]).cast("long") for c in ("rep", "n", "ends")})
    # Written first: a join of two tables is one that Spark splits where many conversations share a node.
    counted = materialize(count(rest.groupBy("depth", "digest")), "nodes")
    known = rest.join(counted, ["depth", "digest"]).select(own.columns).unionByName(own)

    path = Window.partitionBy("conv").orderBy("depth")
    whole = Window.partitionBy("conv")
    mine = F.col("rep") == F.col("conv")
    value = F.when(mine, (F.col("n") - 1) * F.col("words")).otherwise(0)
    carried = known.withColumns(
        {
            "mine": mine,
            "saved": F.sum(value).over(whole) - F.sum(value).over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + value,
            "leaf": F.max((mine & (F.col("ends") == F.col("n")) & F.col("last")).cast("long")).over(whole),
            "child": F.coalesce(F.lead(mine).over(path), F.lit(False)).cast("long"),
            "parent": F.lag("rep").over(path),
        }
    )
    summed = carried.groupBy("depth", "digest").agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(F.col("mine"), F.col("parent"))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ended = summed.join(end_digests(prefixes), ["depth", "digest"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.lower(F.hex("digest")).alias("node"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_rows(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return nodes(materialize(rebuilt_prefixes(turns), "prefixes")).drop("node")


OP12_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  -- crc32 of the decimal id: a byte goes in by exclusive-or, then eight shifts, written as -1
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 4 END AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), rebuilt AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT c.conv_id, 0, [], 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
)
SELECT a.conv_id, a.depth::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words)::BIGINT AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked d ON d.depth >= a.depth AND d.path[1:a.depth] = a.path
GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.path, a.ends_sha256
"""
