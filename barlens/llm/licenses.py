"""License scans by a positional index of rare words, with DataFrame functions only.

Templates are phrases with a label and mandatory words. Pass 1 keeps, for each text, the number of words and, of the rare words that
any template has, the positions. Their document frequencies over all documents give inverse document frequencies. Each template's
anchor is its mandatory word of the highest inverse document frequency (where none is mandatory: as many of its rarest words as
leave too little weight for a match without any of them). Only the anchors that a file has are looked up in the templates' postings: each
proposes the place where a template would start. There the template's other words are compared with the file's at their relative
positions; a place counts if its share of matched inverse document frequency reaches the template's least score and all its key
words stand in place.

All of this is within a text's row: nothing is exploded or shuffled but the counts of words, so a common licence line or
a hot source gathers no rows. Templates are a parameter; their index is a few hundred entries, in the plan itself. Words in COMMON are
no anchors and weigh as if every document had them, but they are compared like any other.

Defined cases: a null or empty text has no words and no labels, and score 0; equal labels are named once; repeated rows are scanned
each for itself; other columns of the input are not returned, the id is carried under its own name; a template without a possible
anchor is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, read_table, whole_text


@dataclass(frozen=True)
class Template:
    """``key``: positions of the words that must stand; by default all. ``least``: share of the weight that must match."""

    name: str
    label: str
    phrase: str
    base: bool = False
    key: tuple[int, ...] | None = None
    least: float = 1.0

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def keys(self) -> tuple[int, ...]:
        return tuple(range(len(self.words))) if self.key is None else self.key


#: The base phrases and their labels.
BASE = (
    Template("base-mit", "mit", "mit license", base=True),
    Template("base-apache", "apache", "apache license", base=True),
    Template("base-gpl", "gpl", "general public license", base=True),
)
#: Further notices, as their authors publish them; key words are counted from 0.
NOTICES = (
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", key=(0, 3, 11), least=0.75),
    Template("apache-grant", "apache", "licensed under the apache license version", key=(0, 3, 4), least=0.75),
    Template("gpl-grant", "gpl", "under the terms of the gnu general public license", key=(5, 6, 7, 8), least=0.75),
    Template("lgpl", "lgpl", "gnu lesser general public license", key=(1, 2, 3, 4), least=0.8),
    Template("agpl", "agpl", "gnu affero general public license", key=(1, 2, 3, 4), least=0.8),
    Template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", key=(0, 6, 11), least=0.75),
    Template("isc", "isc", "permission to use copy modify and or distribute this software for any purpose", key=(0, 4, 7), least=0.75),
    Template("mpl", "mpl", "mozilla public license", key=(0, 1, 2)),
    Template("epl", "epl", "eclipse public license", key=(0, 1, 2)),
    Template("boost", "bsl", "boost software license", key=(0, 1, 2)),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", key=(4, 6, 9, 10), least=0.75),
    Template("cc0", "cc0", "creative commons zero", key=(0, 1, 2)),
    Template("cc-by", "cc-by", "licensed under cc by", key=(0, 2, 3)),
    Template("cc-by-long", "cc-by", "creative commons attribution", key=(0, 1, 2)),
    Template("proprietary", "all-rights-reserved", "all rights reserved", key=(1, 2)),
)
TEMPLATES = BASE + NOTICES
#: Words of templates that are no anchors; they are too frequent in text to tell anything.
COMMON = frozenset("a all and any are by for free in into is of or person source the this to under use with without copy terms version".split())
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each between single spaces: ' a b c '."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, upper, lower), F.lit(" ")), _SPLIT, " ")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    """The words that are looked up."""
    return sorted({w for t in templates for w in t.words} - COMMON)


def find_hits(df: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    """(id, n_words, hits, words): the positions and words of each text that the templates know; its words, where there is a hit."""
    known = vocabulary(templates)
    line = df.select(F.col(id_col), spaced(whole_text(text_col)).alias("line"))
    # A text with one word or none has no part to split; the array of words is made only where a known word may stand.
    n_words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) - 1
    likely = F.lit(False)
    for stem in sorted(prefixes(known)):
        likely = likely | F.contains(F.col("line"), F.lit(" " + stem))
    parted = line.select(id_col, n_words.cast("long").alias("n_words"), F.when(likely, F.split(F.trim("line"), " ")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: h["word"].isin(known))
    return parted.select(id_col, "n_words", hits.alias("hits"), "words").select(id_col, "n_words", "hits", F.when(F.size("hits") > 0, F.col("words")).alias("words"))


def prefixes(words: list[str]) -> set[str]:
    """The words that have no other of them as a prefix."""
    return {w for w in words if not any(w != o and w.startswith(o) for o in words)}


def inverse_document_frequencies(found: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """For each template word; the driver receives one count for each that is looked up."""
    total = found.count()
    df = {r["word"]: r["count"] for r in found.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count().collect()}
    return {w: 1.0 if w in COMMON else math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for t in templates for w in t.words}


def anchors(template: Template, idf: dict[str, float]) -> list[int]:
    """Positions of words of which every match of the template has at least one: the fewest and rarest."""
    rare = sorted((i for i, w in enumerate(template.words) if w not in COMMON), key=lambda i: (-idf[template.words[i]], i))
    must = [i for i in rare if i in template.keys][:1]
    if must:
        return must
    rest, spare = (1 - template.least) * sum(idf[w] for w in template.words) + 1e-9, 0.0
    for k, i in enumerate(rare):
        spare += idf[template.words[i]]
        if spare > rest:
            return rare[: k + 1]
    raise ValueError(f"template {template.name} needs a mandatory or weightier word that is not in COMMON")


def matches(templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """Of a row of :func:`find_hits`: (template, place, score) of all verified places, each once."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        for i in anchors(t, idf):
            postings.setdefault(t.words[i], []).append((number, i))
    index = F.create_map(*[x for w, rows in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("template"), F.lit(i).alias("offset")) for t, i in rows]))])
    word = lambda t, i, w: F.struct(F.lit(w).alias("word"), F.lit(idf[w]).alias("weight"), F.lit(i in t.keys).alias("key"))
    parts = F.array(*[F.array(*[word(t, i, w) for i, w in enumerate(t.words)]) for t in templates])
    totals, least = (F.array(*[F.lit(v) for v in values]) for values in ([sum(idf[w] for w in t.words) for t in templates], [t.least - 1e-9 for t in templates]))
    leads = F.filter("hits", lambda h: h["word"].isin(sorted(postings)))
    proposed = F.transform(leads, lambda h: F.transform(F.try_element_at(index, h["word"]), lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["offset"]).alias("place"))))

    def score(c: Column) -> Column:
        # A word out of place adds nothing; a missing key word rules the place out.
        held = F.transform(F.get(parts, c["template"]), lambda p, i: F.when(F.get(F.col("words"), c["place"] + i) == p["word"], p["weight"]).when(p["key"], F.lit(float("-inf"))).otherwise(F.lit(0.0)))
        return F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.get(totals, c["template"])

    scored = F.transform(F.array_distinct(F.flatten(proposed)), lambda c: F.struct(c["template"].alias("template"), c["place"].alias("place"), score(c).alias("score")))
    return F.filter(scored, lambda m: m["score"] >= F.get(least, m["template"]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    found = materialize(find_hits(df, id_col, text_col, templates), "license-hits")
    rows = found.select(id_col, "n_words", F.when(F.size("hits") > 0, matches(templates, inverse_document_frequencies(found, templates))).alias("placed"))
    base = F.filter("placed", lambda m: F.get(F.array(*[F.lit(t.base) for t in templates]), m["template"]))
    named = lambda placed: F.transform(placed, lambda m: F.get(F.array(*[F.lit(t.label) for t in templates]), m["template"]))
    starts = lambda placed: F.transform(placed, lambda m: m["place"].cast("long"))
    names = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    rows = rows.select(id_col, "n_words", "placed", base.alias("base"))
    return rows.select(
        id_col,
        "n_words",
        F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts("base")).alias("first_word"),
        F.array_max(starts("base")).alias("last_word"),
        names(named("base")).alias("base_labels"),
        names(named("placed")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("placed", lambda m: m["score"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
