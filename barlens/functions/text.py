"""Scores and classes of texts, tolerant parsing of times and JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlens.functions.columns import clip, col


def words_of(text: Column | str) -> Column:
    """Lower-case words of the letters a to z."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z]+"), lambda w: w != "")


def lexicon_score(text: Column | str, lexicon: dict[str, float], intensifiers: tuple[str, ...], negators: tuple[str, ...], boost: float = 1.5, flip: float = -0.8, limit: float = 3.0) -> Column:
    """Sum of the words' scores, times ``boost`` or ``flip`` after an intensifier or a negator, clipped to +-``limit``; null text scores 0."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    factor = lambda b: F.when(b.isin(*intensifiers), boost).when(b.isin(*negators), flip).otherwise(1.0)

    def total(words: Column) -> Column:
        hits = F.transform(words, lambda w, i: F.coalesce(F.try_element_at(table, w) * factor(F.coalesce(F.get(words, i - 1), F.lit(""))), F.lit(0.0)))
        return clip(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x), -limit, limit)

    # Bound by a lambda, so that a text is split once.
    return F.element_at(F.transform(F.array(words_of(F.coalesce(col(text), F.lit("")))), total), 1)


def phrase_tokens(text: Column | str, terms: list[str]) -> Column:
    """The text's words with every phrase of ``terms`` (words of a to z with single spaces) as one token: from left to right, the longest
    phrase that begins at a word, and on from its end. Null text has no tokens."""
    phrases = sorted({t for t in terms if " " in t}, key=lambda t: (-t.count(" "), t))
    words = words_of(F.coalesce(col(text), F.lit("")))
    if not phrases:
        return words
    # Every word stands between spaces of its own, so that phrases which follow one another share none.
    spaced = F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    marked = F.regexp_replace(spaced, "( (?:" + "|".join(p.replace(" ", "  ") for p in phrases) + ") )", "<$1>")
    found = F.regexp_extract_all(marked, F.lit("(<[^>]*>| [a-z]+ )"), 1)
    return F.transform(found, lambda t: F.regexp_replace(F.trim(F.translate(t, "<>", "")), "  ", " "))


def phrase_hits(text: Column | str, lexicon: dict[str, float], intensifiers: dict[str, float], negators: tuple[str, ...], window: int = 2, flip: float = -0.8) -> Column:
    """Array of (place, phrase, score): the tokens of :func:`phrase_tokens` that the lexicon has, in order, each with its number from 0.

    A score is the phrase's value, times that of the nearest intensifier among the ``window`` tokens before it, times ``flip`` if the token just before it is a negator."""
    table, stronger = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (lexicon, intensifiers))

    def hits(tokens: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            boost = F.coalesce(*[F.try_element_at(stronger, F.get(tokens, i - back)) for back in range(1, window + 1)], F.lit(1.0))
            turn = F.when(F.coalesce(F.get(tokens, i - 1).isin(*negators), F.lit(False)), flip).otherwise(1.0)
            return F.struct(i.cast("int").alias("place"), token.alias("phrase"), (F.try_element_at(table, token) * boost * turn).alias("score"))

        return F.filter(F.transform(tokens, one), lambda h: h["score"].isNotNull())

    # Bound by a lambda, so that a text is matched once.
    return F.element_at(F.transform(F.array(phrase_tokens(text, [*lexicon, *intensifiers, *negators])), hits), 1)


def phrase_score(hits: Column, limit: float = 3.0) -> Column:
    """Sum of the scores of :func:`phrase_hits`, clipped to +-``limit``."""
    return clip(F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["score"]), -limit, limit)


def keyword_hits(text: Column | str, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords stand in the lower-cased text."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def tiered_score(text: Column | str, tiers: list[tuple[float, tuple[str, ...]]], limit: float = 10.0) -> Column:
    """Weighted count of the keywords of each tier, clipped."""
    return clip(sum((keyword_hits(text, words) * weight for weight, words in tiers), F.lit(0.0)), -limit, limit)


def first_class(text: Column | str, classes: list[tuple[str, tuple[str, ...]]], other: str = "other") -> Column:
    """The first class with a keyword in the text."""
    low, out = F.lower(F.coalesce(col(text), F.lit(""))), None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def heat(hits: Column) -> Column:
    return F.when(hits >= 3, "hot").when(hits >= 1, "warm").otherwise("cold")


def tolerant_timestamp(raw: Column | str) -> Column:
    """ISO, slashed and compact dates, and epochs in seconds (10 digits) or milliseconds (13); else null."""
    c = F.trim(col(raw))
    digits = F.try_to_number(c, F.lit("9999999999999")).cast("long")
    formats = [F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd")]
    epoch = F.when(c.rlike(r"^\d{13}$"), F.timestamp_millis(digits)).when(c.rlike(r"^\d{10}$"), F.timestamp_seconds(digits)).when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    return F.coalesce(epoch, *[F.when(~c.rlike(r"^\d+$"), f) for f in formats])


def first_json(text: Column | str) -> Column:
    """The first ``{...}`` with at most two levels of braces, as text; null if there is none."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})", 1)
    return F.when(found != "", found)


def parsed_scores(content: Column | str) -> Column:
    """Array of (i, s) from a JSON array of objects that stands in a text; s clipped to [-1, 1]."""
    raw = F.regexp_extract(F.coalesce(col(content), F.lit("")), r"(\[.*\])", 1)
    items = F.from_json(F.when(raw != "", raw), "array<struct<i:int,s:double>>", {"mode": "PERMISSIVE"})
    return F.transform(F.filter(items, lambda x: x["i"].isNotNull() & x["s"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), clip(x["s"], -1.0, 1.0).alias("s")))


def clean_title(html: Column | str) -> Column:
    """Tags and entities dropped, white space run together."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(html), "<[^>]*>", " "), "&[a-zA-Z#0-9]+;", " "), r"\s+", " "))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two texts' sets of words; 0 where both are empty."""
    x, y = F.array_distinct(words_of(a)), F.array_distinct(words_of(b))
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


# Dates.


def announcement_date(quarter_end: Column | str) -> Column:
    """Last legal day of publication: Q1 30 April, H1 31 August, Q3 31 October, year 30 April of the next."""
    q = col(quarter_end)
    y = F.year(q)
    return F.when(F.month(q) == 3, F.make_date(y, F.lit(4), F.lit(30))).when(F.month(q) == 6, F.make_date(y, F.lit(8), F.lit(31))).when(F.month(q) == 9, F.make_date(y, F.lit(10), F.lit(31))).otherwise(F.make_date(y + 1, F.lit(4), F.lit(30)))


def market_open(ts: Column | str) -> Column:
    """Weekdays 9:30 to 11:30 and 13:00 to 15:00."""
    t = col(ts)
    minute = F.hour(t) * 60 + F.minute(t)
    return (F.weekday(t) < 5) & (minute.between(570, 689) | minute.between(780, 899))


def trading_days(start: Column | str, end: Column | str) -> Column:
    """Estimate: calendar days times 252 / 365."""
    return F.floor(F.datediff(col(end), col(start)) * 252 / 365).cast("int")
