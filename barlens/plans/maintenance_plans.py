"""Queries of panel upkeep, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.operators import maintenance
from barlens.plans.stat_plans import _BARS, _S, q, quantise
from barlens.sources import views

CUT = "1998-07-01"


def heads(spark, sf_dir):
    return quantise(maintenance.dirty_heads(views.supplier_bars(spark, sf_dir), 1.5), "asset", "t")


def splice(spark, sf_dir):
    return maintenance.rescaled_splice(views.supplier_bars(spark, sf_dir), CUT).select("asset", "t", *[quantised(c).alias(c) for c in ("open", "close")])


def disclosures(spark, sf_dir):
    """Orders' dates by priority: shipped, promised in a third of the cases, else ordered."""
    pit = views.point_in_time(spark, sf_dir)
    rows = pit.select("symbol", F.to_date(F.date_trunc("quarter", "report_date")).alias("quarter"), F.when(F.col("report_id") % 2 == 0, F.to_date("publish")).alias("actual"), F.when(F.col("report_id") % 3 == 0, F.date_add("report_date", 30)).alias("promised"), F.col("report_date").alias("first"))
    return maintenance.disclosure_dates(rows, ["actual", "promised", "first"])


def members(spark, sf_dir):
    m = views.membership(spark, sf_dir).where("asset % 7 <> 0")
    s = views.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1 OR s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("asset"))
    return maintenance.extended_members(m.select("asset", "start", "end"), s, "2002-01-01")


def holes(spark, sf_dir):
    return maintenance.gaps(views.supplier_bars(spark, sf_dir))


QUERIES = {"dirty_heads": heads, "splice_rescale": splice, "disclosure_dates": disclosures, "membership_extension": members, "panel_gaps": holes}
ORACLE_SQL = {
    "dirty_heads": _BARS
    + f", n AS (SELECT asset, t, close, lead(close) {_S} AS nx, row_number() {_S} AS n FROM bars), r AS (SELECT asset, t, greatest(close, nx) / least(close, nx) AS ratio FROM n WHERE n = 1) SELECT asset, t, "
    + q({"ratio": "ratio"})
    + " FROM r WHERE ratio >= 1.5",
    "splice_rescale": _BARS
    + f", k AS (SELECT asset, coalesce(arg_max(close, t) FILTER (t < DATE '{CUT}') / arg_min(close, t) FILTER (t >= DATE '{CUT}'), 1) AS k FROM bars GROUP BY asset), s AS (SELECT *, CASE WHEN t >= DATE '{CUT}' THEN k ELSE 1 END AS f FROM bars JOIN k USING (asset)) SELECT asset, t, "
    + q({"open": "open * f", "close": "close * f"})
    + " FROM s",
    "disclosure_dates": "WITH "
    + views.SQL["pit"]
    + " SELECT symbol, CAST(date_trunc('quarter', report_date) AS DATE) AS quarter, max(coalesce(CASE WHEN report_id % 2 = 0 THEN CAST(publish AS DATE) END, CASE WHEN report_id % 3 = 0 THEN report_date + 30 END, report_date)) AS announced FROM pit GROUP BY ALL",
    "membership_extension": "WITH "
    + views.SQL["membership"]
    + """, m AS (SELECT asset, start_date, end_date FROM membership WHERE asset % 7 <> 0), c AS (SELECT s_suppkey AS asset FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 7 = 0)
    SELECT asset, start_date AS start, CASE WHEN end_date = (SELECT max(end_date) FROM m) AND asset IN (SELECT asset FROM c) THEN DATE '2002-01-01' ELSE end_date END AS "end" FROM m
    UNION ALL SELECT asset, DATE '2002-01-01', DATE '2002-01-01' FROM c WHERE asset NOT IN (SELECT asset FROM m)""",
    "panel_gaps": _BARS
    + ", cal AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT t FROM bars)), g AS (SELECT asset, idx + 1 AS idx, lead(idx) OVER (PARTITION BY asset ORDER BY idx) - idx - 1 AS length FROM bars JOIN cal USING (t)) SELECT * FROM g WHERE length > 0",
}
