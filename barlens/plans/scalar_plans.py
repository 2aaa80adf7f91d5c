"""Queries of text, date, valuation, cost and execution functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions import columns, finance, text
from barlens.functions.columns import quantised, quantised_sql
from barlens.operators import execution
from barlens.operators.expression import series
from barlens.plans.stat_plans import _BARS, _S, q, quantise
from barlens.sources import views

#: The test corpus is invented prose, so its function words stand for a lexicon.
LEXICON = {"with": 0.5, "for": 0.25, "was": 1.0, "from": -0.5, "that": -0.25, "not": -1.0, "idiot": -2.0, "stupid": -1.5}
INTENSIFIERS, NEGATORS = ("and", "the"), ("of", "to")
TIERS = [(2.0, ("license", "apache")), (1.0, ("rights", "the and")), (-1.5, ("idiot", "scum", "trash"))]
CLASSES = [("legal", ("license", "rights reserved")), ("abuse", ("idiot", "moron", "scum")), ("article", ("the ", "der ", "la "))]


def sentiment(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", text.lexicon_score("text", LEXICON, INTENSIFIERS, NEGATORS).alias("score"), text.tiered_score("text", TIERS).alias("catalyst"), text.first_class("text", CLASSES).alias("category"), text.heat(text.keyword_hits("text", ("license", "rights", "apache", "mit"))).alias("heat"))


#: Phrases that stand within one another, share words with modifiers, and follow one another.
PHRASES = {"the": 0.1, "of the": 0.4, "and the": -0.3, "with": 0.5, "was": 1.0, "was not": -1.2, "for the": 0.6, "rights reserved": 0.8, "all rights reserved": 1.1, "mit license": 0.9, "idiot": -2.0, "der": 0.2, "und der": -0.6, "la": 0.3, "de la": -0.4, "en": 0.05}
STRONGER, REVERSED = {"and": 1.5, "that": 1.4, "as of": 1.6, "que": 1.3, "die": 1.2}, ("not", "to", "in", "no longer", "el")


def phrases(spark, sf_dir):
    """Scores by phrases of every whole document: the longest one at each place, with the words before it."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", text.phrase_hits("text", PHRASES, STRONGER, REVERSED).alias("hits"))
    longest = F.aggregate("hits", F.lit(""), lambda a, h: F.when(F.length(h["phrase"]) > F.length(a), h["phrase"]).otherwise(a))
    places = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["place"])
    return d.select("doc_id", F.size("hits").cast("long").alias("n_hits"), places.alias("places"), longest.alias("longest"), quantised(text.phrase_score("hits")).alias("score"))


def items(spark, sf_dir):
    """Mean over a source's documents of (2 * score of the first line + score of the next 500 characters) / 2."""
    d = views.table(spark, sf_dir, "documents")
    title, body = F.split("text", "\n", 2)[0], F.substring("text", 1, 500)
    score = lambda c: text.lexicon_score(c, LEXICON, INTENSIFIERS, NEGATORS)
    return d.groupBy("source").agg(quantised(F.avg((2 * score(title) + score(body)) / 2)).alias("score"), F.count(F.lit(1)).alias("n"))


def titles(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_title(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.length(text.clean_title("html")).alias("n"))


def similar(spark, sf_dir):
    b = views.table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", quantised(text.jaccard("text", "other")).alias("similarity"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))


def times(spark, sf_dir):
    """A time 7305 days after each order, written in one of seven ways, read back."""
    moment = F.col("o_orderdate") + F.expr("interval 7305 days")
    at = lambda f: F.date_format(moment, f)
    ways = [at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd'T'HH:mm:ss"), at("yyyy/MM/dd HH:mm"), at("yyyyMMdd"), F.unix_timestamp(moment).cast("string"), F.concat(F.unix_timestamp(moment).cast("string"), F.lit("123")), F.lit("soon")]
    raw = F.get(F.array(*ways), (F.col("o_orderkey") % 7).cast("int"))
    d = views.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return d.select("o_orderkey", F.date_format(text.tolerant_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def json_scores(spark, sf_dir):
    """The first object in a note on each event, and the scores in a list of them."""
    e = views.table(spark, sf_dir, "events")
    note = F.concat(F.lit("about "), F.col("props"), F.lit(' and {"c": 2}'))
    scores = F.concat(F.lit('[{"i": 1, "s": '), (F.col("event_id") % 40 / 8.0).cast("string"), F.lit('}, {"i": 2}, {"i": '), (F.col("event_id") % 9).cast("string"), F.lit(', "s": 0.25}]'))
    d = e.select("event_id", F.when(F.col("event_id") % 10 > 0, note).otherwise("none").alias("note"), F.when(F.col("event_id") % 7 > 0, scores).alias("scores"))
    joined = F.array_join(F.transform(text.parsed_scores("scores"), lambda x: F.concat_ws(":", x["i"].cast("string"), x["s"].cast("string"))), ",")
    return d.select("event_id", text.first_json("note").alias("object"), F.coalesce(joined, F.lit("")).alias("scores"))


def dates(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    return o.select("o_orderkey", text.announcement_date(end).alias("announced"), text.trading_days(F.to_date("o_orderdate"), text.announcement_date(end)).alias("days"), quantised(columns.half_life_weight(F.datediff(text.announcement_date(end), F.to_date("o_orderdate")) * 24.0, 720.0)).alias("weight"))


def open_hours(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", text.market_open("ts").alias("open"))


def codes(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("SH60", "SZ30", "68", "00", "BJ83", "92"))), (F.col("c_custkey") % 6 + 1).cast("int")), F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.when(F.col("c_custkey") % 2 == 0, ".SH").otherwise(""))
    c = views.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", columns.normalised_code("raw").alias("code"), columns.price_limit_ratio("raw").alias("limit_ratio"))


def _companies(spark, sf_dir) -> DataFrame:
    """A made-up balance sheet for each part: equity, debt, cash flow, growth and beta from its price and size."""
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 40).alias("equity"), (F.col("p_size") * 500.0).alias("debt"), (F.col("p_retailprice") * 2 - F.col("p_size") * 30.0).alias("cash"), ((F.col("p_size") % 13) / 100.0).alias("growth"), (F.lit(0.6) + (F.col("p_partkey") % 10) / 10.0).alias("beta"), "p_size")


def valuation(spark, sf_dir):
    c = _companies(spark, sf_dir).withColumn("wacc", finance.wacc(F.col("equity"), F.col("debt"), F.col("beta")))
    value = finance.dcf(F.col("cash"), F.col("growth"), F.col("wacc"))
    methods = {"dcf": value, "pe": F.col("cash") * 12, "pb": F.col("equity") * (1 + F.col("growth"))}
    c = c.withColumns({"dcf": value, "target": finance.weighted_target(methods, {"dcf": 0.5, "pe": 0.3, "pb": 0.2})})
    gap = F.col("target") / F.col("equity") - 1
    verdict = F.when(gap > 0.1, "discount").when(gap < -0.1, "premium").otherwise("fair")
    marks = finance.flags({"debt": F.col("debt") > F.col("equity"), "cash": F.col("cash") < 0, "growth": F.col("growth") > 0.11})
    return c.select("p_partkey", *[quantised(x).alias(x) for x in ("wacc", "dcf", "target")], verdict.alias("verdict"), F.array_join(marks, ",").alias("flags"), quantised(finance.linear_score(F.col("growth"), 0.0, 0.1) * 0.6 + finance.linear_score(F.col("beta"), 1.6, 0.6) * 0.4).alias("score"))


def sensitivity(spark, sf_dir):
    c = _companies(spark, sf_dir)
    grid = spark.createDataFrame([(g, r) for g in (-0.01, 0.0, 0.01) for r in (0.08, 0.1, 0.12)], "dg double, rate double")
    return c.crossJoin(F.broadcast(grid)).select("p_partkey", "dg", "rate", quantised(finance.dcf(F.col("cash"), F.col("growth") + F.col("dg"), F.col("rate"))).alias("value"))


def costs(spark, sf_dir):
    l = views.table(spark, sf_dir, "lineitem")
    daily = l.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    o = l.join(daily, "l_suppkey").select("l_suppkey", "l_extendedprice", "l_quantity", (F.col("total") / 100).alias("adv"))
    cost = finance.impact(F.col("l_extendedprice"), F.col("adv")) + finance.turnover_cost(F.lit(1.0))
    return quantise(o.groupBy("l_suppkey").agg((F.sum(cost * F.col("l_extendedprice")) / F.sum("l_extendedprice") * 1e4).alias("bps"), F.avg(finance.square_root_impact(F.col("l_extendedprice"), F.col("adv")) * 1e4).alias("sqrt_bps"), F.count(F.lit(1)).alias("n")), "l_suppkey", "n")


def slices(spark, sf_dir):
    """Schedules of all parent orders."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.floor(F.col("o_totalprice") / 10).alias("qty"), (F.col("o_orderkey") % 100 / 100.0).alias("urgency"))
    return execution.schedule(o, execution.urgency_style(F.col("urgency")))


def fills(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    target = bars.groupBy("asset").agg((F.max("volume") * 2).alias("target"))
    return quantise(execution.capped_fills(target, bars), "asset", "t")


def switch(spark, sf_dir):
    return quantise(execution.kill_switch(views.supplier_bars(spark, sf_dir).withColumn("equity", F.col("close")), "asset", 0.5), "asset", "t", "tripped")


def flow(spark, sf_dir):
    return execution.flow_counts(views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "recent")


def ids(spark, sf_dir):
    return execution.order_ids(views.table(spark, sf_dir, "events"), "ord", "user_id", "ts", "event_id").select("event_id", "client_order_id")


def replay(spark, sf_dir):
    return execution.replayed(views.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def rules(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    chain = [
        ("blacklist", F.col("c_mktsegment") != "MACHINERY"),
        ("order_limit", F.col("o_totalprice") <= 250_000),
        ("position_limit", F.col("o_totalprice") <= F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 60),
        ("price_band", F.abs(F.col("o_orderkey") % 25 - 12) <= 11),
    ]
    return o.select("o_orderkey", F.coalesce(finance.first_failure(chain), F.lit("pass")).alias("verdict"), finance.target_shares(F.lit(0.03), 1e6, F.col("o_totalprice") / 1000).alias("shares"))


def matching(spark, sf_dir):
    """Fills of half of each supplier's volume against limits of 10 % around the last close."""
    b = views.supplier_bars(spark, sf_dir).withColumn("prev", F.lag("close").over(series()))
    side = F.when(F.col("close") >= F.col("open"), "buy").otherwise("sell")
    blocked = F.coalesce(finance.limit_blocked(side, F.col("close"), F.col("prev"), F.lit(0.1)), F.lit(False))
    return b.select("asset", "t", side.alias("side"), blocked.alias("blocked"), quantised(finance.bar_fill(F.col("volume") / 2, F.col("volume"), blocked)).alias("filled"))


_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda w: w <> '')"


def _lexicon_sql(c: str) -> str:
    value = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEXICON.items()) + " ELSE 0 END"
    listed = lambda ws: ", ".join(f"'{w}'" for w in ws)
    w = _WORDS.format(c=f"coalesce({c}, '')")
    factor = f"CASE WHEN b IN ({listed(INTENSIFIERS)}) THEN 1.5::DOUBLE WHEN b IN ({listed(NEGATORS)}) THEN -0.8::DOUBLE ELSE 1.0 END"
    return f"least(greatest(coalesce(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({w}, list_prepend('', {w})[:-2]), lambda p: (list_transform([p[1]], lambda w: {value}))[1] * (list_transform([p[2]], lambda b: {factor}))[1])), lambda a, x: a + x), 0), -3), 3)"


def _phrases_sql() -> str:
    """Tokens by the same rule, then one row a token."""
    terms = sorted({p for p in [*PHRASES, *STRONGER, *REVERSED] if " " in p}, key=lambda p: (-p.count(" "), p))
    spaced = f"list_aggregate(list_transform({_WORDS.format(c="coalesce(text, '')")}, lambda w: ' ' || w || ' '), 'string_agg', '')"
    marked = f"regexp_replace(coalesce({spaced}, ''), '( (?:{'|'.join(p.replace(' ', '  ') for p in terms)}) )', '<\\1>', 'g')"
    tokens = f"list_transform(regexp_extract_all({marked}, '<[^>]*>| [a-z]+ '), lambda t: replace(trim(translate(t, '<>', '')), '  ', ' '))"
    case = lambda c, of: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in of.items()) + " END"
    return f"""WITH w AS (SELECT doc_id, {tokens} AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w
    ), y AS (SELECT doc_id, i, w[i + 1] AS p, CASE WHEN i > 0 THEN w[i] END AS b1, CASE WHEN i > 1 THEN w[i - 1] END AS b2 FROM x
    ), h AS (SELECT doc_id, i, p, {case('p', PHRASES)} * coalesce({case('b1', STRONGER)}, {case('b2', STRONGER)}, 1) * CASE WHEN b1 IN ({', '.join(f"'{n}'" for n in REVERSED)}) THEN -0.8::DOUBLE ELSE 1 END AS s FROM y
    ), a AS (SELECT doc_id, count(*) AS n, sum(i)::BIGINT AS places, first(p ORDER BY len(p) DESC, i) AS longest, sum(s ORDER BY i) AS s FROM h WHERE s IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_hits, coalesce(places, 0) AS places, coalesce(longest, '') AS longest, {quantised_sql('least(greatest(coalesce(s, 0), -3), 3)')} AS score FROM documents LEFT JOIN a USING (doc_id)"""


def _hits(c: str, ws) -> str:
    return " + ".join(f"contains(lower(coalesce({c}, '')), '{w}')::INT" for w in ws)


_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in CLASSES) + " ELSE 'other' END"
_CO = "co AS (SELECT p_partkey, p_retailprice AS price, p_retailprice * 40 AS equity, p_size * 500.0::DOUBLE AS debt, p_retailprice * 2 - p_size * 30.0::DOUBLE AS cash, (p_size % 13) / 100.0::DOUBLE AS growth, 0.6::DOUBLE + (p_partkey % 10) / 10.0::DOUBLE AS beta, p_size FROM part)"


def _dcf_sql(growth: str, rate: str) -> str:
    flows = " + ".join(f"cash * pow(1 + ({growth}), {y}.0::DOUBLE) / pow(1 + {rate}, {y}.0::DOUBLE)" for y in range(1, 6))
    return f"({flows} + cash * pow(1 + ({growth}), 5.0::DOUBLE) * 1.025::DOUBLE / ({rate} - 0.025::DOUBLE) / pow(1 + {rate}, 5.0::DOUBLE))"


_SLICES = {s: "[" + ", ".join(f"{w!r}::DOUBLE" for w in execution.slice_weights(s)) + "]" for s in ("twap", "vwap", "shortfall")}
_ANNOUNCED = "CASE quarter(o_orderdate) WHEN 1 THEN make_date(year(o_orderdate), 4, 30) WHEN 2 THEN make_date(year(o_orderdate), 8, 31) WHEN 3 THEN make_date(year(o_orderdate), 10, 31) ELSE make_date(year(o_orderdate) + 1, 4, 30) END"

QUERIES = {
    "phrase_sentiment": phrases,
    "text_scores": sentiment,
    "item_scores": items,
    "page_titles": titles,
    "token_similarity": similar,
    "tolerant_times": times,
    "json_scores": json_scores,
    "announcement_dates": dates,
    "market_hours": open_hours,
    "code_rules": codes,
    "valuation": valuation,
    "valuation_sensitivity": sensitivity,
    "transaction_costs": costs,
    "order_slices": slices,
    "capped_fills": fills,
    "kill_switch": switch,
    "flow_control": flow,
    "order_ids": ids,
    "log_replay": replay,
    "risk_rules": rules,
    "limit_matching": matching,
}
ORACLE_SQL = {
    "phrase_sentiment": _phrases_sql(),
    "text_scores": f"SELECT doc_id, {_lexicon_sql('text')} AS score, least(greatest(" + " + ".join(f"({_hits('text', ws)}) * {w}::DOUBLE" for w, ws in TIERS) + f", -10), 10) AS catalyst, {_CLASS} AS category, CASE WHEN {_hits('text', ('license', 'rights', 'apache', 'mit'))} >= 3 THEN 'hot' WHEN {_hits('text', ('license', 'rights', 'apache', 'mit'))} >= 1 THEN 'warm' ELSE 'cold' END AS heat FROM documents",
    "item_scores": "WITH d AS (SELECT source, string_split(text, chr(10))[1] AS title, left(text, 500) AS body FROM documents) SELECT source, " + q({"score": f"avg((2 * {_lexicon_sql('title')} + {_lexicon_sql('body')}) / 2)"}) + ", count(*) AS n FROM d GROUP BY source",
    "page_titles": r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)
    SELECT page_id, """ + ", ".join(f"{f}trim(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')){e}" for f, c, e in (("", "t", " AS title"), ("length(", "html", ") AS n"))) + " FROM p",
    "token_similarity": f"""WITH w AS (SELECT item_id, text, list_distinct({_WORDS.format(c='text')}) AS w FROM benchmark)
    SELECT a.item_id, """ + q({"similarity": "len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w)))"}) + ", length(a.text) - length(replace(a.text, ' ', '')) AS spaces FROM w a JOIN w b ON b.item_id = a.item_id + 1",
    "tolerant_times": """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 7305 DAY AS m FROM orders) SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 3 THEN strftime(m, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(m, '%Y-%m-%d %H:%M:00') ELSE strftime(m, '%Y-%m-%d %H:%M:%S') END AS moment FROM o""",
    "json_scores": """WITH e AS (SELECT event_id, props, event_id % 40 / 8.0::DOUBLE AS s, event_id % 9 AS i FROM events)
    SELECT event_id, CASE WHEN event_id % 10 > 0 THEN props END AS object, CASE WHEN event_id % 7 > 0 THEN '1:' || least(greatest(s, 0), 1)::VARCHAR || ',' || i::VARCHAR || ':0.25' ELSE '' END AS scores FROM e""",
    "announcement_dates": f"WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {_ANNOUNCED} AS announced FROM orders) SELECT o_orderkey, announced, CAST(floor((announced - d) * 252 / 365.0::DOUBLE) AS INT) AS days, " + q({"weight": "pow(0.5::DOUBLE, greatest((announced - d) * 24.0::DOUBLE, 0) / 720)"}) + " FROM a",
    "market_hours": "SELECT event_id, isodow(ts) <= 5 AND ((hour(ts) * 60 + minute(ts)) BETWEEN 570 AND 689 OR (hour(ts) * 60 + minute(ts)) BETWEEN 780 AND 899) AS open FROM events",
    "code_rules": "WITH r AS (SELECT c_custkey, (['60', '30', '68', '00', '83', '92'])[c_custkey % 6 + 1] || lpad(c_custkey::VARCHAR, 4, '0') AS code FROM customer) SELECT c_custkey, code, CASE WHEN left(code, 2) IN ('30', '68') THEN 0.2::DOUBLE WHEN left(code, 2) IN ('83', '92') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS limit_ratio FROM r",
    "valuation": f"WITH {_CO}, w AS (SELECT *, least(greatest(equity / (equity + debt) * (0.025::DOUBLE + beta * 0.06::DOUBLE) + debt / (equity + debt) * {0.045 * (1 - 0.25)!r}::DOUBLE, 0.05), 0.2) AS wacc FROM co), v AS (SELECT *, {_dcf_sql('growth', 'wacc')} AS dcf, cash * 12 AS pe, equity * (1 + growth) AS pb FROM w), t AS (SELECT *, (CASE WHEN dcf > 0 THEN dcf * 0.5::DOUBLE ELSE 0 END + CASE WHEN pe > 0 THEN pe * 0.3::DOUBLE ELSE 0 END + CASE WHEN pb > 0 THEN pb * 0.2::DOUBLE ELSE 0 END) / (CASE WHEN dcf > 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN pe > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN pb > 0 THEN 0.2::DOUBLE ELSE 0 END) AS target FROM v) SELECT p_partkey, "
    + q({"wacc": "wacc", "dcf": "dcf", "target": "target", "score": "least(greatest(growth / 0.1::DOUBLE * 100, 0), 100) * 0.6::DOUBLE + least(greatest((beta - 1.6::DOUBLE) / (0.6::DOUBLE - 1.6::DOUBLE) * 100, 0), 100) * 0.4::DOUBLE"})
    + ", CASE WHEN target / equity - 1 > 0.1::DOUBLE THEN 'discount' WHEN target / equity - 1 < -0.1::DOUBLE THEN 'premium' ELSE 'fair' END AS verdict, array_to_string(list_filter([CASE WHEN debt > equity THEN 'debt' END, CASE WHEN cash < 0 THEN 'cash' END, CASE WHEN growth > 0.11::DOUBLE THEN 'growth' END], lambda x: x IS NOT NULL), ',') AS flags FROM t",
    "valuation_sensitivity": f"WITH {_CO}, g AS (SELECT unnest([-0.01, 0.0, 0.01])::DOUBLE AS dg), r AS (SELECT unnest([0.08, 0.1, 0.12])::DOUBLE AS rate) SELECT p_partkey, dg, rate, " + q({"value": _dcf_sql("growth + dg", "rate")}) + " FROM co, g, r",
    "transaction_costs": "WITH d AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 100 AS adv FROM lineitem GROUP BY 1), o AS (SELECT l_suppkey, l_extendedprice AS v, adv, least(l_extendedprice / adv, 1) AS p FROM lineitem JOIN d USING (l_suppkey)) SELECT l_suppkey, count(*) AS n, "
    + q({"bps": "sum((0.3::DOUBLE / sqrt(252.0::DOUBLE) * (0.1::DOUBLE * p + 0.142::DOUBLE * pow(p, 0.6::DOUBLE)) + 0.0017::DOUBLE) * v) / sum(v) * 1e4", "sqrt_bps": "avg(0.0045::DOUBLE * sqrt(v / adv) * 1e4)"})
    + " FROM o GROUP BY l_suppkey",
    "order_slices": f"""WITH o AS (SELECT o_orderkey AS order_id, floor(o_totalprice / 10) AS whole, CASE WHEN (o_orderkey % 100) / 100.0::DOUBLE >= 0.7 THEN 'shortfall' WHEN (o_orderkey % 100) / 100.0::DOUBLE >= 0.3 THEN 'vwap' ELSE 'twap' END AS style FROM orders
    ), s AS (SELECT order_id, style, whole, unnest(generate_series(0, 7))::INT AS slot, unnest(CASE style WHEN 'twap' THEN {_SLICES['twap']} WHEN 'vwap' THEN {_SLICES['vwap']} ELSE {_SLICES['shortfall']} END) AS w FROM o), c AS (SELECT *, floor(whole * w) AS qty FROM s)
    SELECT order_id, slot, style, CASE WHEN slot = 7 THEN whole - sum(qty) OVER (PARTITION BY order_id) + qty ELSE qty END AS qty FROM c""",
    "capped_fills": _BARS
    + ", f AS (SELECT asset, t, volume * 0.1::DOUBLE AS cap, max(volume) OVER (PARTITION BY asset) * 2 AS target, coalesce(sum(volume * 0.1::DOUBLE) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bars) SELECT asset, t, "
    + q({"fill": "greatest(0, least(cap, target - before))", '"left"': "greatest(0, target - before - cap)"})
    + " FROM f",
    "kill_switch": _BARS
    + ", d AS (SELECT asset, t, close / max(close) OVER w - 1 AS dd FROM bars WINDOW w AS (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT asset, t, bool_or(dd <= -0.5::DOUBLE) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS tripped, "
    + q({"drawdown": "dd"})
    + " FROM d",
    "flow_control": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "order_ids": "SELECT event_id, 'ord-' || user_id || '-' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::VARCHAR, 6, '0') AS client_order_id FROM events",
    "log_replay": "SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id",
    "risk_rules": "SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'blacklist' WHEN o_totalprice > 250000 THEN 'order_limit' WHEN o_totalprice > greatest(c_acctbal, 0) * 60 THEN 'position_limit' WHEN abs(o_orderkey % 25 - 12) > 11 THEN 'price_band' ELSE 'pass' END AS verdict, CAST(floor(0.03::DOUBLE * 1e6 / (o_totalprice / 1000) / 100) * 100 AS BIGINT) AS shares FROM orders JOIN customer ON o_custkey = c_custkey",
    "limit_matching": _BARS
    + f", p AS (SELECT *, lag(close) {_S} AS prev, CASE WHEN close >= open THEN 'buy' ELSE 'sell' END AS side FROM bars), b AS (SELECT *, coalesce(CASE WHEN side = 'buy' THEN close >= round(prev * (1 + 0.1::DOUBLE), 2) - 1e-9 ELSE close <= round(prev * (1 - 0.1::DOUBLE), 2) + 1e-9 END, false) AS blocked FROM p) SELECT asset, t, side, blocked, "
    + q({"filled": "CASE WHEN blocked OR volume <= 0 THEN 0 ELSE least(volume / 2, volume * 0.1::DOUBLE) END"})
    + " FROM b",
}
