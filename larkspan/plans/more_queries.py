"""Registered queries of the outcome operators, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, outcomes, panel, policy, predict
from ..sources import reviews as R
from .oracle import _CHOICES, _DELTA, _EVENTS, _N, _S, _SE, _SNAP, _net
from .queries import T, query

#: Reviews that both ends of an outcome need, in the tables at hand.
LEAST = 10


def _r(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


@query
def g11_event_counts(spark, d):
    return events.permissive_events(T(spark, d, "nation").panel).groupBy("aspect", "city").agg(F.count("*").alias("n"))


@query
def g23_violations(spark, d):
    s = T(spark, d).shared
    return outcomes.violations(s, policy.all_policies(s), ["fix_weakest", "largest_peer_gap", "most_criticised", "reliability_aware", "peer_relative"]).select("strategy", "eligible", "chosen", "violations", *_r("abstain_rate"))


@query
def g24_errors_by_city(spark, d):
    return outcomes.errors_by_city(predict.score_lags(panel.unit_periods(T(spark, d).mentions)), 1998).select("city", "n", *_r("mae", "rmse"))


@query
def g27_unit_levels(spark, d):
    return outcomes.unit_levels(panel.unit_periods(T(spark, d).mentions)).select("unit", "n", *_r("level"))


@query
def j05_outcomes_around(spark, d):
    o = outcomes.outcomes_around(panel.unit_periods(T(spark, d).mentions))
    return o.select("unit", "period", *_r("before_A", "now_A", "next_A", "before_B", "now_B", "next_B"))


@query
def j10_peer_scores(spark, d):
    t = T(spark, d)
    return outcomes.peer_scores(panel.unit_periods(t.mentions), t.edges).select("unit", "period", "known", *_r("peer_score", "peer_exposure"))


@query
def j10_aspect_exposure(spark, d):
    t = T(spark, d)
    return outcomes.aspect_exposure(t.panel, t.edges, t.actionable).select("unit", "ord", "known", "rising", *_r("exposure"))


@query
def j20_picker_agreement(spark, d):
    return outcomes.picker_agreement(policy.all_policies(T(spark, d).snapshot), "fix_weakest", "most_criticised").select("n", *_r("agree"))


@query
def w04_cells_around(spark, d):
    c = events.cells(T(spark, d, "nation").whole)
    return c.select("unit", "aspect", "ord", *_r("net_0", "net", "net_2", "mean_score_0", "mean_score_2"))


@query
def p15_samples(spark, d):
    s = outcomes.samples(T(spark, d).panel, LEAST)
    return s.groupBy("timing").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("x_A", "x_B", "y_A", "y_B")])


@query
def p26_rolling_folds(spark, d):
    return outcomes.rolling_folds(T(spark, d).mentions.select("period", F.col("ord").cast("bigint").alias("ord"))).withColumn("fold", F.col("fold").cast("bigint"))


def _slope(spark, d, x: str, y: str):
    return outcomes.cluster_slope(outcomes.samples(T(spark, d).panel, LEAST).where("timing = 'contemp_level'"), y, x, "unit")


@query
def m05_cluster_slope(spark, d):
    return _slope(spark, d, "x_A", "y_B").select("n", "clusters", *_r("beta", "se"))


@query
def m08_combined_folds(spark, d):
    return outcomes.combine_folds(_slope(spark, d, "x_A", "y_B"), _slope(spark, d, "x_B", "y_A")).select("n", "clusters", *_r("beta", "se", "low", "high"))


@query
def r10_panel_sample(spark, d):
    return outcomes.keyed_sample(T(spark, d).panel.select("unit", "period", "aspect", "total"), ["unit", "period", "aspect"], 500)


@query
def v08_repeated_keys(spark, d):
    return outcomes.repeated(R.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def f20_scaled_nets(spark, d):
    return outcomes.scaled(T(spark, d).panel.where("has"), "net", ["unit", "period"]).select("unit", "period", "aspect", *_r("scaled"))


_RISE = "pr AS (SELECT unit AS peer, ord, mean_score AS s, CASE WHEN lag(ord) OVER c=ord-1 THEN mean_score-lag(mean_score) OVER c END AS rise FROM up WINDOW c AS (PARTITION BY unit ORDER BY ord))"
_SMP = f"""smp AS (SELECT *, lag(ord) OVER c AS ord0, lead(ord) OVER c AS ord2, lag(xa) OVER c AS xa0, lag(xb) OVER c AS xb0, lag(ha) OVER c AS ha0, lag(hb) OVER c AS hb0, lag(n_a) OVER c AS na0, lag(n_b) OVER c AS nb0,
 lead(n_a) OVER c AS na2, lead(n_b) OVER c AS nb2, lag(mean_a) OVER c AS ma0, lag(mean_b) OVER c AS mb0, lead(mean_a) OVER c AS ma2, lead(mean_b) OVER c AS mb2
 FROM (SELECT *, {_net("pos_a", "neg_a")} AS xa, {_net("pos_b", "neg_b")} AS xb, pos_a+neg_a>0 AS ha, pos_b+neg_b>0 AS hb FROM panel) WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)),
tim AS (SELECT 'lagged_change' AS timing, unit, xa-xa0 AS x_a, xb-xb0 AS x_b, ma2-mean_a AS y_a, mb2-mean_b AS y_b FROM smp WHERE ord0=ord-1 AND ha AND hb AND ha0 AND hb0 AND ord2=ord+1 AND n_a>={LEAST} AND n_b>={LEAST} AND na2>={LEAST} AND nb2>={LEAST}
 UNION ALL SELECT 'contemp_change', unit, xa-xa0, xb-xb0, mean_a-ma0, mean_b-mb0 FROM smp WHERE ord0=ord-1 AND ha AND hb AND ha0 AND hb0 AND n_a>={LEAST} AND n_b>={LEAST} AND na0>={LEAST} AND nb0>={LEAST}
 UNION ALL SELECT 'lagged_level', unit, xa, xb, ma2, mb2 FROM smp WHERE ha AND hb AND ord2=ord+1 AND na2>={LEAST} AND nb2>={LEAST}
 UNION ALL SELECT 'contemp_level', unit, xa, xb, mean_a, mean_b FROM smp WHERE ha AND hb AND n_a>={LEAST} AND n_b>={LEAST})"""


def _fit(name: str, x: str, y: str) -> str:
    return f"""{name}d AS (SELECT unit, {x}-avg({x}) OVER () AS dx, {y}-avg({y}) OVER () AS dy FROM tim WHERE timing='contemp_level'),
{name}b AS (SELECT sum(dx*dy)/sum(dx*dx) AS beta, sum(dx*dx) AS sxx FROM {name}d),
{name}g AS (SELECT unit, sum(dx*(dy-beta*dx)) AS s, count(*) AS n FROM {name}d, {name}b GROUP BY unit),
{name} AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, (SELECT beta FROM {name}b) AS beta, sqrt(sum(s*s))/(SELECT sxx FROM {name}b) AS se FROM {name}g)"""


_AROUND = ", ".join(f"round(CASE WHEN lag(ord) OVER c=ord-1 THEN lag(mean_{f}) OVER c END,9) AS before_{f.upper()}, round(mean_{f},9) AS now_{f.upper()}, round(CASE WHEN lead(ord) OVER c=ord+1 THEN lead(mean_{f}) OVER c END,9) AS next_{f.upper()}" for f in "ab")

MORE_ORACLE = {
    "g11_event_counts": f"{_N}, {_DELTA}, {_EVENTS} SELECT aspect, city, count(*) AS n FROM ev GROUP BY ALL",
    "g23_violations": f"""{_SNAP}, {_CHOICES}, el AS (SELECT DISTINCT unit FROM snap WHERE eligible), st AS (SELECT unnest(['fix_weakest','largest_peer_gap','most_criticised','reliability_aware','peer_relative']) AS strategy)
 SELECT strategy, (SELECT count(*) FROM el) AS eligible, count(c.unit) AS chosen, count(*) FILTER (c.aspect='STANDARD') AS violations, round(1.0e0-CAST(count(c.unit) AS DOUBLE)/(SELECT count(*) FROM el),9) AS abstain_rate
 FROM st LEFT JOIN (SELECT * FROM choices WHERE unit IN (SELECT unit FROM el)) c USING (strategy) GROUP BY strategy""",
    "g24_errors_by_city": f"{_S} SELECT city, count(*) AS n, round(avg(abs(e)),9) AS mae, round(sqrt(avg(e*e)),9) AS rmse FROM (SELECT city, ord, lead(mean_score) OVER (PARTITION BY unit ORDER BY ord)-mean_score AS e FROM up) WHERE ord>1998 AND e IS NOT NULL GROUP BY city",
    "g27_unit_levels": f"{_S} SELECT unit, CAST(sum(n_b) AS BIGINT) AS n, round(sum(CAST(n_b AS DOUBLE)*mean_b)/sum(n_b),9) AS level FROM up WHERE n_b>0 AND mean_b IS NOT NULL GROUP BY unit HAVING sum(n_b)>=30",
    "j05_outcomes_around": f"{_S} SELECT unit, period, {_AROUND} FROM up WINDOW c AS (PARTITION BY unit ORDER BY ord)",
    "j10_peer_scores": f"""{_SE}, {_RISE}, seen AS (SELECT unit, ord, avg(s) AS peer_score, count(rise) AS known, count(*) FILTER (rise>=0.15e0) AS rising FROM edges JOIN pr USING (peer) GROUP BY unit, ord)
 SELECT up.unit, period, coalesce(known,0) AS known, round(peer_score,9) AS peer_score, round(CASE WHEN known>0 THEN CAST(rising AS DOUBLE)/known END,9) AS peer_exposure FROM up LEFT JOIN seen ON seen.unit=up.unit AND seen.ord=up.ord""",
    "j10_aspect_exposure": f"""{_SE}, {_DELTA}, m AS (SELECT unit AS peer, ord, delta FROM deltas WHERE has AND prev_has AND aspect<>'STANDARD')
 SELECT unit, ord, count(*) AS known, count(*) FILTER (delta>=0.15e0) AS rising, round(CAST(count(*) FILTER (delta>=0.15e0) AS DOUBLE)/count(*),9) AS exposure FROM edges JOIN m USING (peer) GROUP BY unit, ord""",
    "j20_picker_agreement": f"{_SNAP}, {_CHOICES} SELECT count(*) AS n, round(avg(CASE WHEN a.aspect=b.aspect THEN 1.0e0 ELSE 0.0e0 END),9) AS agree FROM choices a JOIN choices b ON a.unit=b.unit AND a.strategy='fix_weakest' AND b.strategy='most_criticised'",
    "w04_cells_around": f"""{_N} SELECT unit, aspect, ord, round(net_0,9) AS net_0, round(net,9) AS net, round(net_2,9) AS net_2, round(s0,9) AS mean_score_0, round(s2,9) AS mean_score_2 FROM (SELECT *, lag(net) OVER c AS net_0, lead(net) OVER c AS net_2,
 lag(mean_score) OVER c AS s0, lead(mean_score) OVER c AS s2, lag(ord) OVER c AS o0, lead(ord) OVER c AS o2 FROM panel WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)) WHERE o0=ord-1 AND o2=ord+1""",
    "p15_samples": f"{_S}, {_SMP} SELECT timing, count(*) AS n, round(avg(x_a),9) AS \"x_A\", round(avg(x_b),9) AS \"x_B\", round(avg(y_a),9) AS \"y_A\", round(avg(y_b),9) AS \"y_B\" FROM tim GROUP BY timing",
    "p26_rolling_folds": f"""{_S}, r AS (SELECT period, row_number() OVER (ORDER BY ord) AS i FROM (SELECT DISTINCT period, ord FROM base)), f AS (SELECT unnest(range(1, (SELECT max(i)-1 FROM r))) AS fold)
 SELECT fold, period, CASE WHEN i<=fold THEN 'train' WHEN i=fold+1 THEN 'val' ELSE 'test' END AS part FROM r, f WHERE i<=fold+2""",
    "m05_cluster_slope": f"{_S}, {_SMP}, {_fit('f', 'x_a', 'y_b')} SELECT n, clusters, round(beta,9) AS beta, round(se,9) AS se FROM f",
    "m08_combined_folds": f"""{_S}, {_SMP}, {_fit('f', 'x_a', 'y_b')}, {_fit('h', 'x_b', 'y_a')}, both_ AS (SELECT f.n+h.n AS n, least(f.clusters,h.clusters) AS clusters, (f.beta+h.beta)/2.0e0 AS beta, 0.5e0*sqrt(f.se*f.se+h.se*h.se) AS se FROM f, h)
 SELECT n, clusters, round(beta,9) AS beta, round(se,9) AS se, round(beta-1.959964e0*se,9) AS low, round(beta+1.959964e0*se,9) AS high FROM both_""",
    "r10_panel_sample": f"{_S} SELECT unit, period, aspect, total FROM panel ORDER BY md5(concat_ws('|','42',unit,period,aspect)), unit, period, aspect LIMIT 500",
    "v08_repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1",
    "f20_scaled_nets": f"{_S} SELECT unit, period, aspect, round(CASE WHEN max(net) OVER w-min(net) OVER w>0 THEN (net-min(net) OVER w)/(max(net) OVER w-min(net) OVER w) ELSE 0.0e0 END,9) AS scaled FROM panel WHERE has WINDOW w AS (PARTITION BY unit, period)",
}
