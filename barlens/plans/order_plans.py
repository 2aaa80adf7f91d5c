"""Queries of orders, margin, risk decomposition, triggers, valuation methods and robustness, with their DuckDB twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.operators import orders
from barlens.operators.expression import series
from barlens.plans.stat_plans import _BARS, _R, q, quantise, returns
from barlens.sources import views

MONEY = "decimal(18,2)"


def _held(spark, sf_dir):
    """(account, asset, value, qty): what each customer bought of each part."""
    l, o = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("account"), F.col("l_partkey").alias("asset"))
    return bought.agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("value"), F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("qty"))


def order_generation(spark, sf_dir):
    """Orders towards nine tenths of each customer's purchases with a third of them held, cash of three tenths, lots of five, twelve positions at most."""
    h = _held(spark, sf_dir)
    h = h.join(h.groupBy("account").agg(F.sum(F.col("value").cast(MONEY)).cast("double").alias("total")), "account")
    t = h.select("account", "asset", (F.col("value") / F.col("total")).alias("weight"), (F.col("value") / F.col("qty")).alias("price"), F.floor(F.col("qty") / 3).alias("held"), F.floor(F.col("qty") * 0.9).alias("target"), "total")
    return orders.generated_orders(t, F.col("total") * 0.3, lot=5, max_positions=12)


def realised(spark, sf_dir):
    l, o = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fills = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("asset"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").cast(MONEY).alias("value"))
    return quantise(orders.realised_weights(fills), "account", "asset")


def _contracts(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", (F.col("p_retailprice") * (F.col("p_size") % 5 + 1)).alias("unit"), (F.lit(0.08) + (F.col("p_size") % 3) / 50.0).alias("rate"), (F.col("p_partkey") % 97 * 100.0).alias("notional"), (F.col("p_partkey") % 13 * 80.0).alias("cash"))


def sizing(spark, sf_dir):
    lots, margin, note = orders.sized_lots(F.col("notional"), F.col("unit"), F.col("rate"), F.col("cash"))
    return _contracts(spark, sf_dir).select("p_partkey", lots.cast("long").alias("lots"), quantised(margin).alias("margin"), note.alias("note"))


def margins(spark, sf_dir):
    """Notional, margin and gross exposure of each brand's contracts, against an equity of a million."""
    c = _contracts(spark, sf_dir)
    lots, margin, _ = orders.sized_lots(F.col("notional"), F.col("unit"), F.col("rate"), F.col("cash"))
    d = c.select("p_brand", (lots * F.col("unit")).cast("decimal(18,4)").alias("n"), margin.cast("decimal(18,4)").alias("m"))
    d = d.groupBy("p_brand").agg(F.sum("n").cast("double").alias("notional"), F.sum("m").cast("double").alias("margin"))
    return quantise(d.withColumn("exposure", F.col("notional") / 1e6), "p_brand")


def _sectors(spark, sf_dir):
    return views.supplier_industry(spark, sf_dir).select("asset", F.col("sector").alias("g"))


def _volumes(spark, sf_dir):
    return views.supplier_bars(spark, sf_dir).groupBy("asset").agg(F.sum(F.col("amount").cast(MONEY)).cast("double").alias("weight"))


def one_hot(spark, sf_dir):
    regions = sorted(r["r_name"] for r in views.table(spark, sf_dir, "region").select("r_name").collect())
    return orders.one_hot(_sectors(spark, sf_dir), "g", regions).select("asset", *[F.col(g).alias(g.lower().replace(" ", "_")) for g in regions])


def decomposition(spark, sf_dir):
    return orders.group_risk(returns(spark, sf_dir), _sectors(spark, sf_dir), _volumes(spark, sf_dir)).select("factor", *[quantised(c).alias(c) for c in ("exposure", "variance", "share")])


def stress(spark, sf_dir, n: int = 50_000):
    """Losses of the volume-weighted portfolio under joint normal moves of the sectors' returns with a common shock of -0.05."""
    r = returns(spark, sf_dir).where("r is not null").join(_sectors(spark, sf_dir), "asset").groupBy("g", "t").agg(F.avg("r").alias("f"))
    pairs = r.alias("a").join(r.alias("b"), "t").groupBy(F.col("a.g").alias("a"), F.col("b.g").alias("b")).agg(F.covar_samp("a.f", "b.f").alias("c")).collect()
    held = _volumes(spark, sf_dir).join(_sectors(spark, sf_dir), "asset").groupBy("g").agg(F.sum("weight").alias("w")).collect()
    names = sorted({x["g"] for x in held} & {x["a"] for x in pairs})
    w, cov = {x["g"]: x["w"] for x in held}, {(x["a"], x["b"]): x["c"] or 0.0 for x in pairs}
    exposure = np.array([w[g] for g in names]) / sum(w[g] for g in names)
    covariance = np.array([[cov.get((a, b), 0.0) for b in names] for a in names])
    losses = orders.simulated_losses(spark.range(n).withColumnRenamed("id", "draw"), exposure, covariance, np.full(len(names), -0.05))
    return orders.loss_summary(losses)


def _marks(spark, sf_dir):
    """The last bar of each supplier with means over the last 20 bars."""
    last = series().rowsBetween(-19, 0)
    b = views.supplier_bars(spark, sf_dir)
    b = b.select("asset", "t", "close", "volume", F.avg("close").over(last).alias("mean"), F.max("close").over(last).alias("high"), F.avg("volume").over(last).alias("mean_volume"), F.count(F.lit(1)).over(Window.partitionBy("asset")).alias("n"), F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("t"))).alias("back"))
    return b.where("back = 1")


def _catalysts(spark, sf_dir):
    """The strongest event of each key in the last seven days of the log, by absolute score, ties to the later one."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), "ts", "event_id", (F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0) * F.least(F.col("value") / 100, F.lit(1.0))).alias("s"))
    end = e.agg(F.max("ts").alias("end"))
    recent = e.crossJoin(F.broadcast(end)).where(F.col("ts") > F.col("end") - F.expr("interval 7 days"))
    return recent.groupBy("asset").agg(F.max_by("s", F.struct(F.abs("s"), F.col("ts"), F.col("event_id"))).alias("event"), F.count_if(F.col("s") > 0).alias("good"), F.count_if(F.col("s") < 0).alias("bad"))


def context(spark, sf_dir):
    return _catalysts(spark, sf_dir).select("asset", quantised("event").alias("strongest"), "good", "bad")


def triggers(spark, sf_dir):
    m = _marks(spark, sf_dir).join(_catalysts(spark, sf_dir), "asset", "left")
    m = m.select("asset", orders.valuation_tier(F.col("mean") * 1.05 / F.col("close") - 1).alias("valuation"), orders.technical_score(*[F.col(c) for c in ("close", "mean", "high", "volume", "mean_volume", "n")]).alias("technical"), orders.catalyst_score(F.col("event")).alias("catalyst"))
    score, fired = orders.trigger(F.col("catalyst"), F.col("valuation"), F.col("technical"))
    return m.select("asset", *[quantised(c).alias(c) for c in ("valuation", "technical", "catalyst")], quantised(score).alias("score"), fired.alias("triggered"))


def pe_percentiles(spark, sf_dir):
    b = views.supplier_bars(spark, sf_dir).withColumn("last", F.max_by("close", "t").over(Window.partitionBy("asset")))
    below, target = orders.percentile_target("close", F.col("last"), F.lit(0.8))
    return quantise(b.groupBy("asset").agg(below.alias("percentile"), target.alias("target")), "asset")


def multiples(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").withColumn("ebitda", F.col("p_size") * 10.0).withColumn("debt", F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") * 30.0)).withColumn("net", F.coalesce("debt", F.lit(0.0)) - 50.0)
    ratio = p.groupBy("p_brand").agg((F.sum((F.col("p_retailprice") + F.col("net")).cast(MONEY)).cast("double") / F.sum(F.col("ebitda").cast(MONEY)).cast("double")).alias("ratio"))
    d = p.join(ratio, "p_brand")
    return d.select("p_partkey", quantised(orders.pb_roe_target(F.lit(5.0) + F.col("p_size"), F.lit(0.05) + F.col("p_size") / 500.0, F.col("p_retailprice") / 3)).alias("pb_roe"), quantised(orders.ev_ebitda_target(F.col("ratio"), F.col("ebitda"), F.col("net"))).alias("ev_ebitda"), quantised(orders.enterprise_value(F.col("p_retailprice"), [F.col("debt")], [F.lit(50.0)])).alias("ev"))


def peers(spark, sf_dir):
    """Share of a brand's parts that are cheaper than each part."""
    w = Window.partitionBy("p_brand")
    return views.table(spark, sf_dir, "part").select("p_partkey", quantised((F.rank().over(w.orderBy("p_retailprice")) - 1) / F.count(F.lit(1)).over(w)).alias("percentile"))


def trade_rates(spark, sf_dir):
    sd = returns(spark, sf_dir).groupBy("asset").agg(F.stddev_samp("r").alias("sd"))
    return sd.where("sd is not null").select("asset", quantised(orders.constant_rate(F.col("sd"), 0.142, 0.5, 8)).alias("rate"))


def _adv(spark, sf_dir):
    b = views.supplier_bars(spark, sf_dir)
    return b.groupBy("asset").agg((F.sum(F.col("amount").cast(MONEY)).cast("double") / F.count(F.lit(1))).alias("adv"), F.max_by("close", "t").alias("price"))


def latest(spark, sf_dir):
    return quantise(_adv(spark, sf_dir), "asset")


def capacity(spark, sf_dir):
    grid = spark.createDataFrame([(1e4,), (1e5,), (1e6,), (1e7,)], "capital double")
    return quantise(orders.capacity_curve(_adv(spark, sf_dir), grid, 0.2, 8.0), "capital")


def robust(spark, sf_dir):
    """Next returns of suppliers that rose over 1, 3 and 6 bars, by sector: spread over the three parameters."""
    w = series()
    b = views.supplier_bars(spark, sf_dir).select("asset", (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"), *[(F.col("close") > F.lag("close", k).over(w)).alias(f"up{k}") for k in (1, 3, 6)])
    runs = b.select("asset", "fwd", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"up{k}").alias("up")) for k in (1, 3, 6)])).alias("p")).where("p.up and fwd is not null")
    runs = runs.join(_sectors(spark, sf_dir), "asset").groupBy("g", "p.k").agg(F.avg("fwd").alias("ret"))
    return quantise(orders.robustness(runs, ["g"], "ret"), "g", "n")


def held_benchmark(spark, sf_dir):
    return quantise(orders.buy_and_hold(views.supplier_bars(spark, sf_dir), 0.5, 12), "assets")


def sampled(spark, sf_dir):
    """A fixed sample of 40 suppliers by hash, every seventh of them in order of key marked for checks."""
    s = views.table(spark, sf_dir, "supplier").select("s_suppkey").orderBy(F.md5(F.concat(F.lit("42:"), F.col("s_suppkey").cast("string"))), "s_suppkey").limit(40)
    return s.select("s_suppkey", ((F.row_number().over(Window.orderBy("s_suppkey")) - 1) % 7 == 0).alias("checked"))


def audit(spark, sf_dir):
    """Whether each order's total is the sum of its lines to one basis point."""
    net = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("decimal(18,4)")).cast("double")
    o = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(net.alias("parts")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.abs(F.col("parts") - F.col("o_totalprice")) <= 1e-4 * F.col("o_totalprice"), F.lit(False)).alias("agrees"))


_HELD = "h AS (SELECT o_custkey AS account, l_partkey AS asset, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_CONTRACTS = "c AS (SELECT p_partkey, p_brand, p_retailprice * (p_size % 5 + 1) AS unit, 0.08::DOUBLE + (p_size % 3) / 50.0::DOUBLE AS rate, p_partkey % 97 * 100.0::DOUBLE AS notional, p_partkey % 13 * 80.0::DOUBLE AS cash FROM part), l AS (SELECT *, floor(notional / unit) AS lots, floor(cash / (unit * rate)) AS most FROM c), n AS (SELECT *, CASE WHEN unit <= 0 THEN 'invalid' WHEN lots < 1 THEN 'below one lot' WHEN lots * unit * rate <= cash THEN '' WHEN most < 1 THEN 'no cash' ELSE 'capped' END AS note FROM l), z AS (SELECT *, CASE note WHEN '' THEN lots WHEN 'capped' THEN most ELSE 0 END AS taken FROM n)"
_SECTOR_R = _R + ", " + views.SQL["industry"] + ", rg AS (SELECT r.asset, t, r, sector AS g FROM r JOIN industry USING (asset) WHERE r IS NOT NULL), fr AS (SELECT g, t, avg(r) AS f FROM rg GROUP BY g, t)"
_RECENT = "e AS (SELECT user_id AS asset, ts, event_id, CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * least(value / 100, 1.0::DOUBLE) AS s FROM events), k AS (SELECT asset, last(s ORDER BY abs(s), ts, event_id) AS event, count(*) FILTER (s > 0) AS good, count(*) FILTER (s < 0) AS bad FROM e WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 7 DAY GROUP BY asset)"
_ADV = "d AS (SELECT asset, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS adv, last(close ORDER BY t) AS price FROM bars GROUP BY asset)"

QUERIES = {
    "order_generation": order_generation,
    "realised_weights": realised,
    "position_sizing": sizing,
    "portfolio_margin": margins,
    "industry_one_hot": one_hot,
    "risk_decomposition": decomposition,
    "factor_stress": stress,
    "event_context": context,
    "three_factor_trigger": triggers,
    "pe_percentile": pe_percentiles,
    "multiple_valuations": multiples,
    "peer_percentiles": peers,
    "trade_rates": trade_rates,
    "latest_prices": latest,
    "capacity_curve": capacity,
    "robustness": robust,
    "buy_and_hold": held_benchmark,
    "universe_sample": sampled,
    "sample_audit": audit,
}
ORACLE_SQL = {
    "order_generation": f"""WITH RECURSIVE {_HELD}, w AS (SELECT *, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY account) AS DOUBLE) AS total FROM h
    ), t AS (SELECT account, asset, value / qty AS price, floor(qty / 3) AS held, floor(qty * 0.9::DOUBLE) AS target, total, row_number() OVER (PARTITION BY account ORDER BY value / total DESC, asset) AS place FROM w
    ), k AS (SELECT * REPLACE (CASE WHEN place <= 12 THEN target ELSE 0 END AS target) FROM t
    ), b AS (SELECT *, floor((target - held) / 5) * 5 AS want, row_number() OVER (PARTITION BY account ORDER BY place) AS n FROM k WHERE target > held AND floor((target - held) / 5) * 5 > 0
    ), f AS (SELECT account, NULL::BIGINT AS asset, 0.0::DOUBLE AS qty, 0::BIGINT AS n, total * 0.3::DOUBLE AS cash FROM b WHERE n = 1
      UNION ALL SELECT b.account, b.asset, CASE WHEN b.want * b.price <= f.cash THEN b.want ELSE greatest(floor(f.cash / (b.price * 5)) * 5, 0) END, b.n,
        f.cash - CASE WHEN b.want * b.price <= f.cash THEN b.want ELSE greatest(floor(f.cash / (b.price * 5)) * 5, 0) END * b.price FROM f JOIN b ON b.account = f.account AND b.n = f.n + 1)
    SELECT account, asset, 'sell' AS side, CAST(held - target AS DOUBLE) AS qty FROM k WHERE held > target UNION ALL SELECT account, asset, 'buy', qty FROM f WHERE qty > 0""",
    "realised_weights": "WITH n AS (SELECT o_custkey AS account, l_suppkey AS asset, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0 GROUP BY ALL), g AS (SELECT *, sum(abs(net)) OVER (PARTITION BY account) AS gross FROM n) SELECT account, asset, "
    + q({"weight": "CAST(net AS DOUBLE) / CAST(gross AS DOUBLE) * 1.0::DOUBLE"})
    + " FROM g WHERE gross > 0",
    "position_sizing": f"WITH {_CONTRACTS} SELECT p_partkey, CAST(taken AS BIGINT) AS lots, " + q({"margin": "taken * unit * rate"}) + ", note FROM z",
    "portfolio_margin": f"WITH {_CONTRACTS}, s AS (SELECT p_brand, CAST(sum(CAST(taken * unit AS DECIMAL(18,4))) AS DOUBLE) AS notional, CAST(sum(CAST(taken * unit * rate AS DECIMAL(18,4))) AS DOUBLE) AS margin FROM z GROUP BY p_brand) SELECT p_brand, " + q({"notional": "notional", "margin": "margin", "exposure": "notional / 1e6::DOUBLE"}) + " FROM s",
    "industry_one_hot": "WITH " + views.SQL["industry"] + " SELECT asset, " + ", ".join(f"(sector = '{g}')::INT AS {g.lower().replace(' ', '_')}" for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM industry",
    "risk_decomposition": _SECTOR_R
    + """, own AS (SELECT asset, var_samp(r - f) AS own FROM rg JOIN fr USING (g, t) GROUP BY asset), v AS (SELECT asset, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM bars GROUP BY asset
    ), w AS (SELECT asset, weight / sum(weight) OVER () AS h FROM v), x AS (SELECT sector AS g, sum(h) AS exposure FROM w JOIN industry USING (asset) GROUP BY 1
    ), c AS (SELECT a.g AS a, b.g AS b, covar_samp(a.f, b.f) AS c FROM fr a JOIN fr b USING (t) GROUP BY ALL), p AS (SELECT a, sum(c * exposure) AS marginal FROM c JOIN x ON x.g = b GROUP BY a
    ), o AS (SELECT g AS factor, exposure, exposure * marginal AS variance FROM x JOIN p ON a = g UNION ALL SELECT 'specific', 1.0::DOUBLE, coalesce(sum(h * h * own), 0) FROM w JOIN own USING (asset)) SELECT factor, """
    + q({"exposure": "exposure", "variance": "variance", "share": "CASE WHEN sum(variance) OVER () > 0 THEN variance / sum(variance) OVER () ELSE 0 END"})
    + " FROM o",
    "event_context": f"WITH {_RECENT} SELECT asset, " + q({"strongest": "event"}) + ", good, bad FROM k",
    "three_factor_trigger": _BARS
    + f", {_RECENT}, b AS (SELECT asset, close, volume, avg(close) OVER w AS mean, max(close) OVER w AS high, avg(volume) OVER w AS mv, count(*) OVER (PARTITION BY asset) AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY t ROWS 19 PRECEDING) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY t DESC) = 1"
    + """), i AS (SELECT *, mean * 1.05::DOUBLE / close - 1 AS implied, close >= high * 0.995::DOUBLE AS up, close > mean AS above, volume > 1.2::DOUBLE * mv AS loud FROM b LEFT JOIN k USING (asset)
    ), s AS (SELECT asset, CASE WHEN implied IS NULL THEN 0.5::DOUBLE WHEN implied >= 0.3::DOUBLE THEN 1.0::DOUBLE WHEN implied >= 0.15::DOUBLE THEN 0.8::DOUBLE WHEN implied >= 0 THEN 0.5::DOUBLE WHEN implied >= -0.1::DOUBLE THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS valuation,
      CASE WHEN n < 25 THEN 0.5::DOUBLE WHEN up AND above AND loud THEN 1.0::DOUBLE WHEN up OR (above AND loud) THEN 0.7::DOUBLE WHEN above THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS technical,
      CASE WHEN event IS NULL THEN 0.5::DOUBLE WHEN event > 0 THEN greatest(event, 0.5::DOUBLE) WHEN event < 0 THEN greatest(event, 0.1::DOUBLE) ELSE 0.0::DOUBLE END AS catalyst FROM i
    ), z AS (SELECT *, 0.4::DOUBLE * catalyst + 0.3::DOUBLE * valuation + 0.3::DOUBLE * technical AS score FROM s) SELECT asset, """
    + q({c: c for c in ("valuation", "technical", "catalyst", "score")})
    + ", score >= 0.6::DOUBLE AND valuation >= 0.6::DOUBLE AND (catalyst >= 0.7::DOUBLE OR technical >= 0.7::DOUBLE) AS triggered FROM z",
    "pe_percentile": _BARS
    + ", b AS (SELECT asset, close, last_value(close) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM bars), p AS (SELECT asset, avg(CASE WHEN close < lc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS below, quantile_cont(close, 0.25) AS lo, quantile_cont(close, 0.5) AS mid, quantile_cont(close, 0.75) AS hi FROM b GROUP BY asset) SELECT asset, "
    + q({"percentile": "below", "target": "CASE WHEN below > 0.7::DOUBLE THEN greatest(lo, mid * 0.9::DOUBLE) WHEN below < 0.3::DOUBLE THEN least(hi, mid * 1.1::DOUBLE) ELSE mid END * 0.8::DOUBLE"})
    + " FROM p",
    "multiple_valuations": "WITH p AS (SELECT *, p_size * 10.0::DOUBLE AS ebitda, CASE WHEN p_partkey % 4 > 0 THEN p_size * 30.0::DOUBLE END AS debt FROM part), n AS (SELECT *, coalesce(debt, 0) - 50.0::DOUBLE AS net FROM p), r AS (SELECT p_brand, CAST(sum(CAST(p_retailprice + net AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(ebitda AS DECIMAL(18,2))) AS DOUBLE) AS ratio FROM n GROUP BY p_brand) SELECT p_partkey, "
    + q({"pb_roe": "(0.05::DOUBLE + p_size / 500.0::DOUBLE) / (1 / (5.0::DOUBLE + p_size)) * (p_retailprice / 3)", "ev_ebitda": "ratio * 1.05::DOUBLE * ebitda - net", "ev": "CASE WHEN coalesce(debt, 0) > 0 THEN p_retailprice + coalesce(debt, 0) - 50.0::DOUBLE END"})
    + " FROM n JOIN r USING (p_brand)",
    "peer_percentiles": "SELECT p_partkey, " + q({"percentile": "(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1)::DOUBLE / count(*) OVER (PARTITION BY p_brand)"}) + " FROM part",
    "trade_rates": _R + ", s AS (SELECT asset, stddev_samp(r) AS sd FROM r GROUP BY asset HAVING stddev_samp(r) IS NOT NULL) SELECT asset, " + q({"rate": f"least(greatest(0.5::DOUBLE * greatest(sd, 0) / {2 * 0.142 * 8 + 1e-9!r}::DOUBLE, 0), 1)"}) + " FROM s",
    "latest_prices": _BARS + f", {_ADV} SELECT asset, " + q({"adv": "adv", "price": "price"}) + " FROM d",
    "capacity_curve": _BARS
    + f", {_ADV}, g AS (SELECT capital, capital / (SELECT count(*) FROM d WHERE adv > 0) / adv AS share FROM d, (SELECT unnest([1e4, 1e5, 1e6, 1e7])::DOUBLE AS capital) WHERE adv > 0) SELECT capital, "
    + q({"participation": "quantile_cont(share, 0.5)", "net": "0.2::DOUBLE - avg(sqrt(share)) * 45.0::DOUBLE / 1e4::DOUBLE * 8.0::DOUBLE"})
    + " FROM g GROUP BY capital",
    "robustness": _BARS
    + ", " + views.SQL["industry"]
    + ", b AS (SELECT asset, lead(close) OVER w / close - 1 AS fwd, close > lag(close, 1) OVER w AS u1, close > lag(close, 3) OVER w AS u3, close > lag(close, 6) OVER w AS u6 FROM bars WINDOW w AS (PARTITION BY asset ORDER BY t)), u AS (SELECT asset, fwd, 1 AS k FROM b WHERE u1 UNION ALL SELECT asset, fwd, 3 FROM b WHERE u3 UNION ALL SELECT asset, fwd, 6 FROM b WHERE u6), s AS (SELECT sector AS g, k, avg(fwd) AS ret FROM u JOIN industry USING (asset) WHERE fwd IS NOT NULL GROUP BY ALL) SELECT g, count(*) AS n, "
    + q({"median": "quantile_cont(ret, 0.5)", "mean": "avg(ret)", "dispersion": "CASE WHEN abs(avg(ret)) > 1e-10 THEN stddev_samp(ret) / abs(avg(ret)) END"})
    + " FROM s GROUP BY g",
    "buy_and_hold": _BARS
    + f", c AS (SELECT asset FROM bars GROUP BY asset HAVING count(*) >= (SELECT count(DISTINCT t) FROM bars) * 0.5::DOUBLE), p AS (SELECT t, avg(close) AS p, count(*) AS n FROM bars JOIN c USING (asset) GROUP BY t), d AS (SELECT t, p, n, p / lag(p) OVER (ORDER BY t) - 1 AS r, p / max(p) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM p) SELECT max(n) AS assets, "
    + q({"annual": "pow(last(p ORDER BY t) / first(p ORDER BY t), 1 / (count(*) / 12.0::DOUBLE)) - 1", "sharpe": f"avg(r) / stddev_samp(r) * {float(np.sqrt(12))!r}::DOUBLE", "drawdown": "min(dd)"})
    + " FROM d",
    "universe_sample": "WITH s AS (SELECT s_suppkey FROM supplier ORDER BY md5('42:' || s_suppkey::VARCHAR), s_suppkey LIMIT 40) SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 7 = 0 AS checked FROM s",
    "sample_audit": "WITH p AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,4))) AS DOUBLE) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(abs(parts - o_totalprice) <= 1e-4 * o_totalprice, false) AS agrees FROM orders LEFT JOIN p ON l_orderkey = o_orderkey",
}
