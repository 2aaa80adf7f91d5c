"""Queries of decision rules: debates, bridges for private companies, retraining, cost-aware trading; with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions import finance
from barlens.functions.columns import quantised
from barlens.operators import stats
from barlens.plans.stat_plans import _IC, _R, panel, q, returns
from barlens.sources import views


def debates(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    points = {"price": (F.col("p_retailprice") < 1200, F.col("p_retailprice") > 1700), "size": (F.col("p_size") > 30, F.col("p_size") < 10), "key": (F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0)}
    bull, bear, verdict = finance.debate(points)
    return p.select("p_partkey", bull.alias("bull"), bear.alias("bear"), verdict.alias("verdict"))


def bridge(spark, sf_dir):
    """Each brand's revenue at the exact median multiple (a part's size over ten, from 1 to 30) over all its parts; equal sizes are counted first."""
    p = views.table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("revenue"), F.count(F.lit(1)).alias("n"))
    m = F.col("p_size") / 10.0
    b = p.groupBy("p_brand").agg(F.sum("revenue").cast("double").alias("revenue"), F.percentile(F.when(m.between(1.0, 30.0), m), 0.5, F.col("n")).alias("middle"))
    return b.select("p_brand", quantised(finance.private_value(F.col("revenue"), F.array("middle"), low=1.0)).alias("value"))


def retraining(spark, sf_dir):
    """When a model that is fitted anew each January and July is due before that: its age is the days since."""
    ic = stats.rank_ic(stats.paired(*panel(spark, sf_dir))).withColumn("ic", quantised("ic"))
    w = Window.orderBy("t")
    fitted = F.max(F.when(F.month("t").isin(1, 7), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = ic.select("t", F.avg("ic").over(w.rowsBetween(-5, 0)).alias("recent"), F.avg("ic").over(w.rowsBetween(-23, -6)).alias("before"), F.datediff("t", fitted).alias("days"))
    d = d.where("before IS NOT NULL").select("t", quantised("recent").alias("recent"), quantised("before").alias("before"), "days")
    return d.select("t", "recent", "days", F.coalesce(finance.retrain_due(F.col("recent"), F.col("before"), F.col("days")), F.lit("no")).alias("due"))


def trades(spark, sf_dir):
    """Weights moved from equal to volume-less inverse deviation only where the mean return pays for it."""
    m = returns(spark, sf_dir).groupBy("asset").agg(F.avg("r").alias("alpha"), F.stddev_samp("r").alias("sd")).where("sd > 0")
    s = m.agg(F.sum(1 / F.col("sd")).alias("s"), F.count(F.lit(1)).alias("n"))
    d = m.crossJoin(F.broadcast(s)).select("asset", "alpha", (1 / F.col("sd") / F.col("s")).alias("target"), (1 / F.col("n")).alias("current"))
    return d.select("asset", quantised(finance.traded_weight(F.col("target"), F.col("current"), F.col("alpha"), 0.25), 1e6).alias("weight"))


QUERIES = {"debates": debates, "private_bridge": bridge, "retrain_triggers": retraining, "cost_aware_trades": trades}
ORACLE_SQL = {
    "debates": """WITH d AS (SELECT p_partkey, (p_retailprice < 1200)::INT + (p_size > 30)::INT + (p_partkey % 3 = 0)::INT AS bull, (p_retailprice > 1700)::INT + (p_size < 10)::INT + (p_partkey % 5 = 0)::INT AS bear FROM part)
    SELECT p_partkey, bull, bear, CASE WHEN bull - bear >= 2 THEN 'buy' WHEN bear - bull >= 2 THEN 'avoid' ELSE 'wait' END AS verdict FROM d""",
    "private_bridge": "WITH p AS (SELECT p_brand, p_retailprice, p_size / 10.0::DOUBLE AS m FROM part) SELECT p_brand, "
    + q({"value": "CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) * (quantile_cont(m, 0.5) FILTER (m BETWEEN 1 AND 30)) * 0.75::DOUBLE * 1.1::DOUBLE"})
    + " FROM p GROUP BY p_brand",
    "retrain_triggers": _IC
    + """, i AS (SELECT t, floor(ic * 1e4 + 0.5) / 1e4 AS ic FROM ic), d AS (SELECT t, avg(ic) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent, avg(ic) OVER (ORDER BY t ROWS BETWEEN 23 PRECEDING AND 6 PRECEDING) AS before, date_diff('day', max(CASE WHEN month(t) IN (1, 7) THEN t END) OVER (ORDER BY t), t) AS days FROM i
    ), e AS (SELECT t, days, """
    + q({"recent": "recent", "before": "before"})
    + " FROM d WHERE before IS NOT NULL) SELECT t, recent, days, CASE WHEN recent < 0 THEN 'sign' WHEN recent < 0.5::DOUBLE * before THEN 'decay' WHEN days > 90 THEN 'age' ELSE 'no' END AS due FROM e",
    "cost_aware_trades": _R
    + ", m AS (SELECT asset, avg(r) AS alpha, stddev_samp(r) AS sd FROM r GROUP BY asset HAVING stddev_samp(r) > 0), d AS (SELECT asset, alpha, 1 / sd / sum(1 / sd) OVER () AS tg, 1.0::DOUBLE / count(*) OVER () AS cu FROM m) SELECT asset, "
    + "CAST(floor((CASE WHEN abs(alpha * (tg - cu)) > 0.25::DOUBLE * abs(tg - cu) THEN tg ELSE cu END) * 1e6 + 0.5) AS DOUBLE) / 1e6 AS weight FROM d",
}
