"""SQL of the registered queries, for an engine that has the same tables as views."""

from __future__ import annotations

from ..functions import text as X
from ..functions.score import Z_ALPHA, Z_POWER
from ..operators.policy import CROWDING, WEIGHT_GRIDS
from ..operators.traveller import PERSONAS

_NET = "(2.0e0*((CAST({p} AS DOUBLE)+{k}e0/2.0e0)/(CAST({p}+{n} AS DOUBLE)+{k}e0))-1.0e0)"


def _net(p: str, n: str, k: str = "10.0") -> str:
    return _NET.format(p=p, n=n, k=k)


def _base(grain: str) -> str:
    if grain == "supplier":
        unit, name, period, ord_ = "l_suppkey", "s_name", "CAST(year(l_shipdate) AS VARCHAR)", "year(l_shipdate)"
    else:
        unit, name, period, ord_ = "CAST(n_nationkey AS BIGINT)", "n_name", "concat(year(l_shipdate),'Q',quarter(l_shipdate))", "year(l_shipdate)*4+quarter(l_shipdate)"
    mark = "substr(sha1(concat_ws('|',l_orderkey,l_linenumber,l_partkey,l_suppkey,strftime(l_shipdate,'%Y-%m-%d'))),8,1)"
    return f"""base AS (SELECT {unit} AS unit, {name} AS unit_name, r_name AS city, {period} AS period, {ord_} AS ord, p_type AS aspect,
 l_returnflag='R' AS isneg, l_quantity AS score, CASE WHEN {mark} IN ('0','2','4','6','8','a','c','e') THEN 'A' ELSE 'B' END AS fold, CAST(l_shipdate AS DATE) AS d
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
counts AS (SELECT unit, period, aspect, count(*) FILTER (NOT isneg) AS pos, count(*) FILTER (isneg) AS neg, count(*) FILTER (NOT isneg AND fold='A') AS pos_a, count(*) FILTER (isneg AND fold='A') AS neg_a,
 count(*) FILTER (NOT isneg AND fold='B') AS pos_b, count(*) FILTER (isneg AND fold='B') AS neg_b FROM base GROUP BY ALL),
up AS (SELECT unit, period, min(city) AS city, min(ord) AS ord, count(*) AS n_reviews, count(*) FILTER (fold='A') AS n_a, count(*) FILTER (fold='B') AS n_b, avg(score) AS mean_score,
 avg(score) FILTER (fold='A') AS mean_a, avg(score) FILTER (fold='B') AS mean_b FROM base GROUP BY unit, period),
panel0 AS (SELECT up.*, aspect, coalesce(pos,0) AS pos, coalesce(neg,0) AS neg, coalesce(pos_a,0) AS pos_a, coalesce(neg_a,0) AS neg_a, coalesce(pos_b,0) AS pos_b, coalesce(neg_b,0) AS neg_b
 FROM up CROSS JOIN (SELECT DISTINCT p_type AS aspect FROM part) LEFT JOIN counts USING (unit, period, aspect)),
panel AS (SELECT *, pos+neg AS total, pos+neg>0 AS has, {_net("pos", "neg")} AS net, CAST(pos+neg AS DOUBLE)/(CAST(pos+neg AS DOUBLE)+10.0e0) AS rel FROM panel0)"""


_BOUNDS = {
    "supplier": ("make_date(CAST(period AS BIGINT),1,1)", "make_date(CAST(period AS BIGINT),12,31)"),
    "nation": ("make_date(CAST(substr(period,1,4) AS BIGINT),CAST(substr(period,6,1) AS BIGINT)*3-2,1)", "last_day(make_date(CAST(substr(period,1,4) AS BIGINT),CAST(substr(period,6,1) AS BIGINT)*3,1))"),
}


def _periods(grain: str) -> str:
    a, b = _BOUNDS[grain]
    return f"periods AS (SELECT period, min(ord) AS ord, (SELECT min(d) FROM base)<={a} AND (SELECT max(d) FROM base)>={b} AS complete FROM base GROUP BY period)"


def _places(grain: str) -> str:
    if grain == "supplier":
        src, unit = "supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey", "s_suppkey"
    else:
        src, unit = "nation JOIN region ON n_regionkey=r_regionkey", "CAST(n_nationkey AS BIGINT)"
    return f"""places AS (SELECT {unit} AS unit, r_name AS city, 45.0e0+CAST(embedding[1] AS DOUBLE)*5.0e0 AS lat, 10.0e0+CAST(embedding[2] AS DOUBLE)*5.0e0 AS lon FROM {src} JOIN embeddings ON vec_id={unit}),
pairs AS (SELECT a.city, a.unit, b.unit AS peer, 12742.0e0*asin(sqrt(least(1.0e0,greatest(0.0e0,
 sin((radians(b.lat)-radians(a.lat))/2.0e0)*sin((radians(b.lat)-radians(a.lat))/2.0e0)+cos(radians(a.lat))*cos(radians(b.lat))*sin((radians(b.lon)-radians(a.lon))/2.0e0)*sin((radians(b.lon)-radians(a.lon))/2.0e0))))) AS km
 FROM places a JOIN places b ON a.city=b.city AND a.unit<>b.unit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY km, peer) AS rnk FROM pairs),
edges AS (SELECT unit, peer, rnk, km FROM ranked WHERE rnk<=10)"""


def _snap(grain: str) -> str:
    return f"""WITH {_base(grain)}, {_periods(grain)}, {_places(grain)},
rec AS (SELECT unit, city, aspect, has, CASE WHEN has THEN net END AS net, CASE WHEN has THEN rel END AS rel, total AS mentions, pos, neg AS neg_mentions, CASE WHEN total>0 THEN CAST(neg AS DOUBLE)/CAST(total AS DOUBLE) END AS neg_rate, n_reviews
 FROM panel WHERE period=(SELECT max_by(period,ord) FROM periods WHERE complete)),
near AS (SELECT unit, peer FROM edges WHERE peer IN (SELECT unit FROM rec)),
ok AS (SELECT * FROM rec WHERE has AND mentions>=5 AND rel>=0.3e0),
stats AS (SELECT r.unit, r.aspect, median(ok.net) AS peer_median, count(*) AS peer_n, count(*) FILTER (ok.net<r.net) AS below, count(*) FILTER (ok.net=r.net) AS equal FROM near JOIN ok ON ok.unit=near.peer JOIN rec r ON r.unit=near.unit AND r.aspect=ok.aspect GROUP BY ALL),
weak AS (SELECT unit, aspect AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY net, aspect) AS rn FROM ok) WHERE rn=1),
pw AS (SELECT near.unit, weakest FROM near JOIN weak ON weak.unit=near.peer),
header AS (SELECT rec.unit, count(*) FILTER (has) AS n_measured, any_value(lat) AS lat, any_value(lon) AS lon, coalesce((SELECT count(*) FROM near WHERE near.unit=rec.unit),0) AS peer_count FROM rec LEFT JOIN places ON places.unit=rec.unit GROUP BY rec.unit),
snap0 AS (SELECT rec.*, peer_count, peer_median, coalesce(peer_n,0) AS peer_n, peer_median-net AS gap,
 CASE WHEN net IS NOT NULL THEN 100.0e0*(CAST(coalesce(below,0) AS DOUBLE)+0.5e0*CAST(coalesce(equal,0)+1 AS DOUBLE))/CAST(coalesce(peer_n,0)+1 AS DOUBLE) END AS percentile,
 CASE WHEN (SELECT count(*) FROM pw WHERE pw.unit=rec.unit)>0 THEN CAST((SELECT count(*) FROM pw WHERE pw.unit=rec.unit AND pw.weakest=rec.aspect) AS DOUBLE)/CAST((SELECT count(*) FROM pw WHERE pw.unit=rec.unit) AS DOUBLE) END AS weak_share,
 CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates' WHEN n_reviews<10 THEN 'insufficient_reviews' WHEN peer_count<2 THEN 'insufficient_peers' WHEN n_measured=0 THEN 'no_measured_aspects' END AS ineligible_reason
 FROM rec LEFT JOIN stats USING (unit, aspect) JOIN header ON header.unit=rec.unit),
snap AS (SELECT *, ineligible_reason IS NULL AS eligible FROM snap0)"""


def _gate(actionable: bool = True, peers: bool = False, rate: bool = False, crowding: bool = False) -> str:
    out = "CASE WHEN NOT eligible THEN 'unit_ineligible' WHEN NOT has THEN 'no_measurement' WHEN net IS NULL THEN 'nonfinite_net' WHEN mentions<5 THEN 'insufficient_mentions' WHEN coalesce(rel,0)<0.3e0 THEN 'insufficient_reliability'"
    if actionable:
        out += " WHEN aspect='STANDARD' THEN 'not_actionable'"
    if rate:
        out += " WHEN NOT coalesce(neg_rate BETWEEN 0 AND 1, false) THEN 'invalid_neg_rate'"
    if peers:
        out += " WHEN gap IS NULL THEN 'nonfinite_gap' WHEN peer_n<2 THEN 'insufficient_peers'"
    if crowding:
        out += " WHEN NOT coalesce(weak_share BETWEEN 0 AND 1, false) THEN 'crowding_unavailable'"
    return out + " END"


def _minmax(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 0 THEN ({c}-min({c}) OVER w)/(max({c}) OVER w-min({c}) OVER w) ELSE 0.0e0 END"


def _scores(weights=WEIGHT_GRIDS["current-default"], intensity: float = 0.0, value: dict | None = None) -> str:
    g, c, u = (f"{x}e0" for x in weights)
    v = ""
    if value:
        kept = {a: max(0.0, x) for a, x in value.items()}
        mean = sum(kept.values()) / len(kept)
        v = "CASE aspect " + " ".join(f"WHEN '{a}' THEN {x / mean!r}e0" for a, x in sorted(kept.items())) + " ELSE 1.0e0 END"
    deficit = f"{g}*g+{c}*c"
    s = f"({v})*({deficit})" if v else deficit
    s += f"-{u}*(1.0e0-rel)" + (f"-{intensity}e0*{CROWDING}e0*weak_share" if intensity else "")
    return f"(SELECT *, {s} AS score FROM (SELECT *, {_minmax('gap')} AS g, {_minmax('neg_rate')} AS c FROM snap WHERE {_gate(peers=True, rate=True, crowding=intensity > 0)} IS NULL WINDOW w AS (PARTITION BY unit)))"


def _picked(source: str) -> str:
    return f"SELECT unit, aspect, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, aspect) AS rn FROM {source}) WHERE rn=1"


def _by(score: str, **gates) -> str:
    return _picked(f"(SELECT *, {score} AS score FROM snap WHERE {_gate(**gates)} IS NULL)")


_POLICIES = {
    "fix_weakest": _by("-net"), "largest_peer_gap": _by("gap", peers=True), "most_criticised": _by("CAST(neg_mentions AS DOUBLE)"),
    "reliability_aware": _by("-net*rel"), "peer_relative": _picked(_scores()),
}
_CHOICES = "choices AS (" + " UNION ALL ".join(f"SELECT unit, '{k}' AS strategy, aspect, score FROM ({q})" for k, q in _POLICIES.items()) + ")"


def _rounded(q: str) -> str:
    return f"{_snap('supplier')} SELECT unit, aspect, round(score,9) AS score FROM ({q})"


_S, _N = f"WITH {_base('supplier')}", f"WITH {_base('nation')}"
_SP, _NP = f"{_S}, {_periods('supplier')}", f"{_N}, {_periods('nation')}"
_SE, _NE = f"{_S}, {_places('supplier')}", f"{_N}, {_places('nation')}"
_SNAP = _snap("supplier")

_DELTA = """deltas AS (SELECT * FROM (SELECT *, net-lag(net) OVER c AS delta, lag(ord) OVER c AS prev_ord, lag(has) OVER c AS prev_has, lag(total) OVER c AS prev_total,
 row_number() OVER c - 1 AS before, count(*) OVER (PARTITION BY unit, aspect) - row_number() OVER c AS after FROM panel WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)) WHERE prev_ord=ord-1)"""
_EVENTS = "ev AS (SELECT * FROM deltas WHERE delta>=0.15e0 AND total>=5 AND before>=2 AND after>=2)"
_CELLS = """cells AS (SELECT * FROM (SELECT panel.*, lag(net) OVER c AS net_0, lead(net) OVER c AS net_2, lag(rel) OVER c AS rel_0, lead(rel) OVER c AS rel_2, lag(ord) OVER c AS ord_0, lead(ord) OVER c AS ord_2, lead(complete) OVER c AS complete_2
 FROM panel JOIN (SELECT period, complete FROM periods) USING (period) WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)) WHERE ord_0=ord-1 AND ord_2=ord+1)""".replace("SELECT panel.*,", "SELECT panel.*, complete,")
_JUMPS = "SELECT unit, city, aspect, period, ord, round({s}(net-net_0),9) AS jump, round({s}(net_2-net_0),9) AS stay FROM cells WHERE {s}(net-net_0)>=0.2e0 AND {s}(net_2-net_0)>=0.1e0 AND rel_0>=0.3e0 AND rel>=0.3e0 AND rel_2>=0.3e0 AND has AND complete_2"
_POOL = """state AS (SELECT unit AS control, city, aspect, ord, q1, coalesce(q1-q2,0.0e0) AS trend FROM (SELECT *, lag(has) OVER c AS had, lag(ord) OVER c AS po, lag(net) OVER c AS q1, lag(net,2) OVER c AS q2 FROM panel WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)) WHERE po=ord-1 AND had),
pool AS (SELECT e.city, e.aspect, e.ord, e.unit, f.control FROM ev e JOIN state m ON m.control=e.unit AND m.aspect=e.aspect AND m.ord=e.ord JOIN state f ON f.city=e.city AND f.aspect=e.aspect AND f.ord=e.ord AND f.control<>e.unit
 WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.unit=f.control AND x.aspect=f.aspect AND abs(x.ord-f.ord)<=2))"""
_LAGS = "lags AS (SELECT unit, city, period, ord, n_reviews, mean_score AS y, lag(mean_score) OVER u AS lag1, lag(mean_score,2) OVER u AS lag2, mean_score-lag(mean_score) OVER u AS trend, lead(mean_score) OVER u AS y_next, lag(ord) OVER u=ord-1 AS contiguous FROM up WINDOW u AS (PARTITION BY unit ORDER BY ord))"

_WEIGHTS = "CASE aspect WHEN 'ECONOMY' THEN 2.0e0 WHEN 'PROMO' THEN 1.0e0 WHEN 'STANDARD' THEN 1.0e0 WHEN 'LARGE' THEN 0.5e0 ELSE 0.0e0 END"
_MATCH = f"""wt AS (SELECT *, {_WEIGHTS} AS w FROM snap),
match AS (SELECT unit, city, bool_and(eligible) AS eligible, sum(w*rel*net) FILTER (has AND w*rel>0)/sum(w*rel) FILTER (has AND w*rel>0) AS score, coalesce(sum(w) FILTER (has AND w*rel>0)/sum(w),0.0e0) AS coverage FROM wt GROUP BY unit, city)"""
_FLIPS = "CAST(round_even(0.3e0*CAST(neg_mentions AS DOUBLE),0) AS BIGINT)"
_IMPROVE = f"imp AS (SELECT *, {_net('(pos+flips)', '(neg_mentions-flips)')} AS after_net FROM (SELECT *, {_FLIPS} AS flips FROM snap WHERE has))"
_BAL = "sum(CAST(mentions AS DOUBLE)*net) FILTER (has) OVER (PARTITION BY unit)/sum(CAST(mentions AS DOUBLE)) FILTER (has) OVER (PARTITION BY unit)"
_OUTC = f"""{_IMPROVE}, outc0 AS (SELECT *, CAST(mentions AS DOUBLE)*(after_net-net)/CAST(sum(mentions) OVER (PARTITION BY unit) AS DOUBLE) AS g, {_BAL} AS b FROM imp),
outc AS (SELECT unit, city, aspect, net, flips, round(b,9) AS balance_before, round(b+g,9) AS balance_after, round((b+g)-b,9) AS balance_gain, round(((b+g)-b)*2.5e0,9) AS rating_points, round(((b+g)-b)*2.5e0*5.0e0,9) AS revenue_pct FROM outc0)"""
_GAIN = f"""{_OUTC}, chosen AS ({_POLICIES['peer_relative']}),
cmp AS (SELECT outc.*, coalesce(outc.aspect=chosen.aspect,false) AS recommended, row_number() OVER (PARTITION BY outc.unit ORDER BY rating_points DESC, outc.aspect) AS rnk
 FROM outc LEFT JOIN chosen ON chosen.unit=outc.unit WHERE (outc.unit, outc.aspect) IN (SELECT (unit, aspect) FROM snap WHERE {_gate()} IS NULL))"""


def _regex(words: list[str]) -> str:
    return "(?i)" + "|".join(("" if " " in w else "\\b") + w for w in words)


def _list(words: list[str]) -> str:
    return ",".join("'" + w + "'" for w in words)


_ASPECT_NAMES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_LABELS = "WITH lab AS (SELECT l.doc_id, quality, toxic, lang, CAST(n_chars>1500 AS INTEGER) AS long_text FROM labels l JOIN documents d ON l.doc_id=d.doc_id)"
_HEADER_N = _snap("nation")


def _scaled_if(c: str) -> str:
    x = f"CASE WHEN ok THEN {c} END"
    return f"CASE WHEN max({x}) OVER w-min({x}) OVER w>0 THEN ({c}-min({x}) OVER w)/(max({x}) OVER w-min({x}) OVER w) ELSE 0.0e0 END"


def _follow(rounds: int) -> str:
    """Rounds of asking for a recommendation on the measures as they are, and improving it."""
    keep = "unit, aspect, has, eligible, rel, mentions, peer_n, peer_median, net, p, neg_mentions, neg_rate, gap, b0"
    out = [f"st0 AS (SELECT {keep}, true AS on_ FROM (SELECT *, pos AS p, {_BAL} AS b0 FROM snap))"]
    for i in range(1, rounds + 1):
        out += [
            f"a{i} AS (SELECT *, CASE WHEN ok THEN 0.45e0*g+0.35e0*c-0.2e0*(1.0e0-rel) END AS score FROM (SELECT *, {_scaled_if('gap')} AS g, {_scaled_if('neg_rate')} AS c FROM (SELECT *, {_gate(peers=True, rate=True)} IS NULL AS ok FROM st{i - 1}) WINDOW w AS (PARTITION BY unit)))",
            f"f{i} AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC NULLS LAST, aspect)=1 AS first_ FROM a{i})",
            f"m{i} AS (SELECT *, CASE WHEN first_ AND score IS NOT NULL AND on_ THEN CAST(round_even(0.3e0*CAST(neg_mentions AS DOUBLE),0) AS BIGINT) ELSE 0 END AS fl FROM f{i})",
            f"n{i} AS (SELECT * REPLACE (p+fl AS p, neg_mentions-fl AS neg_mentions) FROM m{i})",
            f"o{i} AS (SELECT * REPLACE (CASE WHEN fl>0 THEN {_net('p', 'neg_mentions')} ELSE net END AS net, CASE WHEN fl>0 THEN CAST(neg_mentions AS DOUBLE)/CAST(mentions AS DOUBLE) ELSE neg_rate END AS neg_rate) FROM n{i})",
            f"q{i} AS (SELECT * REPLACE (CASE WHEN fl>0 THEN peer_median-net ELSE gap END AS gap), {_BAL} AS bn, max(fl) OVER (PARTITION BY unit)>0 AS go_on FROM o{i})",
            f"st{i} AS (SELECT {keep}, go_on AS on_ FROM q{i})",
        ]
    return ", ".join(out)


def _step(i: int) -> str:
    when = "CASE WHEN score IS NOT NULL THEN round({},9) END AS {}"
    more = ", ".join(when.format(x, n) for x, n in (("b0", "balance_before"), ("bn", "balance_after"), ("bn-b0", "balance_gain"), ("(bn-b0)*2.5e0", "rating_points"), ("(bn-b0)*2.5e0*5.0e0", "revenue_pct")))
    return f"SELECT unit, CAST({i} AS BIGINT) AS round, CASE WHEN score IS NOT NULL THEN aspect END AS aspect, CAST(fl AS BIGINT) AS flips, score IS NOT NULL AND fl=0 AS stalled, {more} FROM q{i} WHERE first_ AND on_"


_PERSONA_ROWS = ",".join(f"('{name}',{i},{float(w.get(a, 0))}e0)" for name, w in PERSONAS.items() for i, a in enumerate(X.ASPECTS, 1))
_MATCHED = "sum(w*rel*net) FILTER (has AND w*rel>0)/sum(w*rel) FILTER (has AND w*rel>0)"
_PLACE = "row_number() OVER (PARTITION BY city ORDER BY round(score,9) DESC NULLS LAST, s_name, unit)"

def _strict(fold: str, name: str, aspects: str) -> str:
    """Strict events before the cooldown, as CTE `name`0, and after, as `name`: fold is '', '_a' or '_b'."""
    pos, neg = f"pos{fold}", f"neg{fold}"
    net = _net(pos, neg)
    return f"""{name}p AS (SELECT unit, city, period, ord, aspect, {pos} AS pos, {neg} AS neg, {pos}+{neg} AS total, {pos}+{neg}>0 AS has, {net} AS net FROM panel JOIN (SELECT period, complete FROM periods) USING (period) WHERE complete),
{name}w AS (SELECT *, net-lag(net) OVER c AS delta, lag(ord) OVER c AS po, lag(has) OVER c AS ph, lag(total) OVER c AS pt, lag(pos) OVER c AS pp, lag(neg) OVER c AS pn, CASE WHEN lag(ord,2) OVER c=ord-2 THEN lag(total,2) OVER c ELSE 0 END AS p2,
 coalesce(lag(ord,2) OVER c=ord-2 AND lag(has,2) OVER c AND lag(ord) OVER c=ord-1 AND lag(has) OVER c AND lead(ord) OVER c=ord+1 AND lead(has) OVER c AND lead(ord,2) OVER c=ord+2 AND lead(has,2) OVER c,false) AS around FROM {name}p WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)),
{name}c AS (SELECT * FROM {name}w WHERE po=ord-1 AND has AND ph AND total>=5 AND pt>=5 AND p2>=3 AND delta>=0.15e0 AND {aspects} AND ord-(SELECT min(ord) FROM {name}p)>=2 AND (SELECT max(ord) FROM {name}p)-ord>=2),
{name}q AS (SELECT unit, aspect, ord, sum(exp(lgamma(a0+i)+lgamma(b0+b1)-lgamma(a0+i+b0+b1)-ln(b1+i)-(lgamma(1.0e0+i)+lgamma(b1)-lgamma(1.0e0+i+b1))-(lgamma(a0)+lgamma(b0)-lgamma(a0+b0)))) AS p_rise
 FROM (SELECT unit, aspect, ord, pos+5.0e0 AS a1, neg+5.0e0 AS b1, pp+5.0e0 AS a0, pn+5.0e0 AS b0, unnest(range(0,CAST(pos+5 AS BIGINT))) AS i FROM {name}c) GROUP BY ALL),
{name}m AS (SELECT unit AS peer, aspect, ord, delta FROM {name}w WHERE po=ord-1 AND has AND ph),
{name}0 AS (SELECT c.unit, c.city, c.aspect, c.period, c.ord, c.around, any_value(q.p_rise) AS p_rise, count(*) AS known, count(*) FILTER (m.delta>=0.15e0) AS improving, row_number() OVER (PARTITION BY c.unit, c.aspect ORDER BY c.ord) AS nr
 FROM {name}c c JOIN {name}q q ON q.unit=c.unit AND q.aspect=c.aspect AND q.ord=c.ord AND q.p_rise>=0.8e0 JOIN edges e ON e.unit=c.unit JOIN {name}m m ON m.peer=e.peer AND m.aspect=c.aspect AND m.ord=c.ord GROUP BY c.unit, c.city, c.aspect, c.period, c.ord, c.around HAVING count(*)>=2),
{name}r AS (SELECT unit, aspect, ord, nr, true AS keep, ord AS last FROM {name}0 WHERE nr=1 UNION ALL SELECT n.unit, n.aspect, n.ord, n.nr, n.ord-r.last>2, CASE WHEN n.ord-r.last>2 THEN n.ord ELSE r.last END FROM {name}r r JOIN {name}0 n ON n.unit=r.unit AND n.aspect=r.aspect AND n.nr=r.nr+1),
{name} AS (SELECT x.* FROM {name}0 x JOIN {name}r r USING (unit, aspect, nr) WHERE keep)"""


_RUN = "WITH RECURSIVE " + f"{_NP}, {_places('nation')}".removeprefix("WITH ")
_SETS = ", ".join([_strict("_a", "sa", "aspect<>'STANDARD'"), _strict("_b", "sb", "aspect<>'STANDARD'"), _strict("", "sn", "aspect<>'STANDARD'"), _strict("", "sc", "aspect='STANDARD'")])
_RUN_ALL = f"{_RUN}, {_SETS}, run AS (SELECT 'A' AS set, * FROM sa UNION ALL SELECT 'B', * FROM sb UNION ALL SELECT 'ALL', * FROM sn UNION ALL SELECT 'CONTROL', * FROM sc)"

ORACLE: dict[str, str] = {
    "g01_mention_counts": f'{_S} SELECT unit, period, aspect, pos, neg, pos_a AS "pos_A", neg_a AS "neg_A", pos_b AS "pos_B", neg_b AS "neg_B" FROM counts',
    "g02_unit_period_scores": f'{_S} SELECT unit, period, city, n_reviews, n_a AS "n_A", n_b AS "n_B", round(mean_score,9) AS mean_score FROM up',
    "g03_first_seen": f"{_S} SELECT unit, min(unit_name) AS unit_name, min(city) AS city, CAST(min(d) AS VARCHAR) AS first_day FROM base GROUP BY unit",
    "g04_period_coverage": f"{_N} SELECT period, count(DISTINCT d) AS days, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, count(*) AS n FROM base GROUP BY period",
    "g05_stream_counters": f"{_S} SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS no_date, count(*) FILTER (isneg) AS negative, count(*) FILTER (NOT isneg) AS positive, count(*) FILTER (fold='A') AS fold_a FROM base",
    "g06_fold_outcomes": f'{_S} SELECT unit, period, round(mean_a,9) AS "mean_A", round(mean_b,9) AS "mean_B", round(mean_score,9) AS mean_score FROM up',
    "g07_unit_dimension": f"WITH {_places('supplier')} SELECT unit, city, round(lat,9) AS lat, round(lon,9) AS lon FROM places",
    "g08_pivot_nets": f"{_S} SELECT unit, period, " + ", ".join(f"max(CASE WHEN aspect='{a}' AND has THEN round(net,9) END) AS net_{a.lower()}" for a in _ASPECT_NAMES) + " FROM panel GROUP BY unit, period",
    "g09_coverage_by_aspect": f"{_S} SELECT aspect, count(*) AS cells, count(*) FILTER (has) AS measured, count(DISTINCT unit) AS units, CAST(sum(total) AS BIGINT) AS mentions, median(total) AS median_mentions FROM panel GROUP BY aspect",
    "g09_coverage_by_city": f"{_S} SELECT city, count(*) AS cells, count(*) FILTER (has) AS measured, count(DISTINCT unit) AS units, CAST(sum(total) AS BIGINT) AS mentions, median(total) AS median_mentions FROM panel GROUP BY city",
    "g10_prior_sensitivity": f"{_S}, e AS (SELECT net, 5.0e0 AS prior, {_net('pos', 'neg', '5.0')} AS other FROM panel WHERE has UNION ALL SELECT net, 10.0e0, {_net('pos', 'neg', '10.0')} FROM panel WHERE has UNION ALL SELECT net, 20.0e0, {_net('pos', 'neg', '20.0')} FROM panel WHERE has) SELECT prior, round(avg(other),9) AS mean_net, round(stddev_pop(other),9) AS sd_net, round(corr(other,net),9) AS corr_main FROM e GROUP BY prior",
    "g18_panel_audit": f"{_S}, nm AS (SELECT unit_name, count(DISTINCT unit) AS ids FROM base GROUP BY unit_name) SELECT count(DISTINCT unit) AS units, count(*) FILTER (NOT has) AS empty_cells, count(*) AS cells, (SELECT count(*) FROM nm) AS names, (SELECT count(*) FILTER (ids>1) FROM nm) AS shared_names FROM panel",
    "g35_panel_stats": f"{_S} SELECT round(avg(mean_score),8) AS mean, round(stddev_samp(mean_score),8) AS sd, (SELECT count(*) FROM (SELECT unit FROM up GROUP BY unit HAVING count(*)>=4)) AS units_with_4 FROM up",
    "j04_dense_panel": f"{_S} SELECT unit, period, aspect, pos, neg, total, has, CASE WHEN total>0 THEN CAST(pos-neg AS DOUBLE)/CAST(total AS DOUBLE) END AS raw_net, net, rel FROM panel",
    "p01_complete_periods": f"SELECT * FROM ({_SP} SELECT period, CAST(ord AS INTEGER) AS ord, complete FROM periods) UNION ALL SELECT * FROM ({_NP} SELECT period, CAST(ord AS INTEGER) AS ord, complete FROM periods)",
    "p14_all_measured": f"{_S} SELECT unit, period, count(*) FILTER (has) AS measured, bool_and(has) AS all_measured FROM panel GROUP BY unit, period",
    "p18_measurement_verdict": f"{_S} SELECT cells, measured, CASE WHEN CAST(measured AS DOUBLE)/cells>=0.9e0 AND med>=10 THEN 'STRONG' WHEN CAST(measured AS DOUBLE)/cells>=0.6e0 THEN 'USABLE' ELSE 'WEAK' END AS verdict FROM (SELECT count(*) AS cells, count(*) FILTER (has) AS measured, median(total) AS med FROM panel)",
    "q14_fold_panel": f"{_S} SELECT unit, period, aspect, round({_net('pos_a', 'neg_a')},12) AS net_a, round({_net('pos_b', 'neg_b')},12) AS net_b, pos_a+neg_a>0 AS has_a, pos_b+neg_b>0 AS has_b FROM panel",
    "v02_panel_integrity": f"{_S} SELECT count(*) AS n_rows, count(*) FILTER (aspect NOT IN (SELECT p_type FROM part)) AS unknown_aspect, count(*) FILTER (NOT regexp_matches(period,'^\\d{{4}}(Q[1-4])?$')) AS bad_period, count(*) FILTER (pos<0 OR neg<0 OR pos+neg<>total) AS bad_counts, count(*) FILTER (pos_a+pos_b<>pos OR neg_a+neg_b<>neg) AS bad_folds, count(*) FILTER (has<>(total>0)) AS bad_measured, count(*) FILTER (net IS NULL OR abs(net)>1) AS bad_net, (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY unit, period, aspect HAVING count(*)>1)) AS repeated FROM panel",
    "v05_fold_reconciliation": f"{_S}, r AS (SELECT unit, period, min(n_reviews) AS n2, min(mean_score) AS m2 FROM panel GROUP BY unit, period) SELECT count(*) FILTER (u.unit IS NOT NULL AND r.unit IS NOT NULL) AS \"both\", count(*) FILTER (r.unit IS NULL) AS left_only, count(*) FILTER (u.unit IS NULL) AS right_only, count(*) FILTER (n_reviews<>n2) AS n_mismatch, count(*) FILTER (abs(mean_score-m2)>=1e-6) AS mean_mismatch FROM up u FULL JOIN r ON u.unit=r.unit AND u.period=r.period",
    "s04_source_audit": "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS units, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day, count(*) FILTER (l_quantity IS NULL) AS no_score FROM lineitem",
    "f01_normalise": "SELECT conv_id, turn, sha1(lower(regexp_replace(regexp_replace(text,'^\\s+|\\s+$','','g'),'\\s+',' ','g'))) AS h FROM conversations",
    "f02_placeholder": f"WITH t AS (SELECT o_orderkey, (['No Negative',' nothing. ','N/A','Great stay','','none!;','All Good'])[o_orderkey%7+1] AS t FROM orders), n AS (SELECT o_orderkey, lower(trim(t)) AS n FROM t) SELECT o_orderkey, n='' OR n IN ({_list(X.NEGATIVE_PLACEHOLDERS)}) OR trim(n,' .!,;') IN ({_list(X.NEGATIVE_PLACEHOLDERS)}) AS placeholder FROM n",
    "f03_keyword_gate": "WITH t AS (SELECT concat(p_name,' ',p_type,' near the metro, staff room') AS t FROM part) " + " UNION ALL ".join(f"SELECT '{a}' AS aspect, count(*) AS n FROM t WHERE regexp_matches(t,'{_regex(w)}') HAVING count(*)>0" for a, w in X.ASPECT_KEYWORDS.items()),
    "f04_city_country": "WITH a AS (SELECT n_nationkey, (['London','Utrecht','Paris'])[n_nationkey%3+1] AS city, (['United Kingdom','Netherlands'])[n_nationkey%2+1] AS country FROM nation) SELECT * FROM a",
    "f05_hashed_ids": "SELECT s_suppkey, 'd1_europe:'||substr(sha1(lower(trim(s_name))),1,12) AS id, 'd1_europe:'||substr(sha1(lower(trim(s_name))),1,16) AS legacy_id FROM supplier",
    "f06_fingerprint": "WITH f AS (SELECT page_id, sha1(concat_ws('|',url,'1/2/2017',CAST(page_id AS VARCHAR),'x','')::BLOB || unhex(sha1(url)) || unhex(sha1(html))) AS fingerprint FROM pages) SELECT page_id, fingerprint, CASE WHEN substr(fingerprint,8,1) IN ('0','2','4','6','8','a','c','e') THEN 'A' ELSE 'B' END AS fold FROM f",
    "f07_fold_split": f"{_S} SELECT fold, count(*) AS n FROM base GROUP BY fold",
    "f08_date_parse": "SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 2 THEN CAST(make_date(year(o_orderdate),1,31) AS VARCHAR) END AS day FROM orders",
    "f09_quarter_label": "SELECT concat(year(o_orderdate),'Q',quarter(o_orderdate)) AS quarter, strftime(o_orderdate,'%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL",
    "f10_quarter_bounds": "WITH q AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) SELECT concat(y,'Q',q) AS quarter, CAST(make_date(y,q*3-2,1) AS VARCHAR) AS first_day, CAST(last_day(make_date(y,q*3,1)) AS VARCHAR) AS last_day, CAST(y*4+q AS INTEGER) AS ord FROM q",
    "f12_shrinkage": f"{_S} SELECT unit, period, aspect, {_net('pos', 'neg', '5.0')} AS net5, {_net('pos', 'neg', '20.0')} AS net20, CAST(total AS DOUBLE)/(CAST(total AS DOUBLE)+5.0e0) AS rel5 FROM panel",
    "f15_haversine": f"WITH {_places('supplier')} SELECT unit, round(12742.0e0*asin(sqrt(least(1.0e0,greatest(0.0e0,sin((radians(48.2082e0)-radians(lat))/2.0e0)*sin((radians(48.2082e0)-radians(lat))/2.0e0)+cos(radians(lat))*cos(radians(48.2082e0))*sin((radians(16.3738e0)-radians(lon))/2.0e0)*sin((radians(16.3738e0)-radians(lon))/2.0e0))))),6) AS km, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok FROM places",
    "f16_url_slug": "WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url),'[?#].*$',''),'/+$','') AS url FROM pages) SELECT page_id, url, regexp_replace(list_extract(string_split(url,'/'),-1),'\\..*$','') AS slug FROM u",
    "f17_formula_guard": "WITH t AS (SELECT c_custkey, concat((['=',' +','@','a','-',''])[c_custkey%6+1],c_name) AS t FROM customer) SELECT c_custkey, CASE WHEN regexp_matches(t,'^[\\t\\r\\n]|^\\s*[=+\\-@]') THEN ''''||t ELSE t END AS t FROM t",
    "f18_opaque_ids": "SELECT s_suppkey, sha256('input'||chr(0)||CAST(s_suppkey AS VARCHAR)) AS id FROM supplier",
    "f19_truncation": "SELECT item_id, substr(text,1,40) AS head, CAST(length(substr(text,1,800)) AS BIGINT) AS n FROM benchmark",
    "f21_percentile_rank": "WITH c AS (SELECT c_custkey, c_mktsegment, CAST(floor(c_acctbal/100) AS BIGINT) AS v FROM customer), g AS (SELECT c_mktsegment, v, count(*) AS equal FROM c GROUP BY ALL), w AS (SELECT *, sum(equal) OVER (PARTITION BY c_mktsegment ORDER BY v) AS upto, sum(equal) OVER (PARTITION BY c_mktsegment) AS total FROM g) SELECT c_custkey, round(100.0e0*(CAST(upto-equal AS DOUBLE)+0.5e0*CAST(equal AS DOUBLE))/CAST(total AS DOUBLE),9) AS pct FROM c JOIN w USING (c_mktsegment, v)",
    "f22_medians": "SELECT l_returnflag, l_linestatus, median(l_quantity) AS median, quantile_cont(l_quantity,0.9) AS p90 FROM lineitem GROUP BY ALL",
    "f25_half_even": "SELECT p_size, CAST(round_even(CAST(p_size AS DOUBLE)*0.5e0,0) AS BIGINT) AS half, count(*) AS n FROM part GROUP BY p_size",
    "f28_power_table": f"WITH g AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round({Z_ALPHA + Z_POWER!r}e0*0.5e0*sqrt(1.0e0/n+1.0e0/(n*2)),9) AS mde, CAST(ceil(2.0e0*({Z_ALPHA + Z_POWER!r}e0*0.5e0/0.07e0)*({Z_ALPHA + Z_POWER!r}e0*0.5e0/0.07e0)) AS BIGINT) AS n_per_arm FROM g",
    "f31_personas": f"""{_SNAP}, asp AS (SELECT aspect, row_number() OVER (ORDER BY aspect) AS i FROM (SELECT DISTINCT p_type AS aspect FROM part)), ws AS (SELECT * FROM (VALUES {_PERSONA_ROWS}) AS v(persona, i, w)), wt AS (SELECT snap.*, persona, w FROM snap JOIN asp USING (aspect) JOIN ws USING (i))
 SELECT persona, unit, round({_MATCHED},9) AS score, round(coalesce(sum(w) FILTER (has AND w*rel>0)/sum(w),0.0e0),9) AS coverage FROM wt GROUP BY persona, unit""",
    "f32_criticism": f"{_SNAP} SELECT unit, aspect, neg_mentions, neg_rate, CAST(neg_mentions AS DOUBLE)/CAST(n_reviews AS DOUBLE) AS neg_per_review FROM snap",
    "f34_labels": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name)>1 THEN concat(p_name,' (',p_partkey,')') ELSE p_name END AS label FROM part",
    "f36_stratum_key": "SELECT concat_ws('|',lang,source) AS stratum, count(*) AS n FROM documents GROUP BY 1",
    "f40_coercion": "SELECT count(*) AS n, count(*) FILTER (TRY_CAST(regexp_extract(substr(props,6),'(\\d+)',1) AS BIGINT)>=0) AS counts, CAST(0 AS BIGINT) AS flags FROM events",
    "f41_safe_ratio": "WITH e AS (SELECT trim(event_type) AS kind, count(*) AS n, count(*) FILTER (value>1e9) AS big FROM events GROUP BY 1) SELECT kind, n, CASE WHEN big<>0 THEN CAST(n AS DOUBLE)/CAST(big AS DOUBLE) END AS ratio FROM e",
    "f42_json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props,'$.none')) AS none FROM events GROUP BY event_type",
    "j06_knn_k": f"WITH {_places('supplier')} SELECT unit, peer, rnk AS rank, round(km,6) AS km FROM edges",
    "j07_radius": f"WITH {_places('supplier')} SELECT unit, peer, row_number() OVER (PARTITION BY unit ORDER BY km, peer) AS rank, round(km,6) AS km FROM pairs WHERE km<=120.0e0",
    "j08_mutual": f"WITH {_places('supplier')}, e AS (SELECT unit, peer FROM ranked WHERE rnk<=5) SELECT e.unit, e.peer FROM e JOIN e b ON b.unit=e.peer AND b.peer=e.unit",
    "g14_graph_metrics": f"WITH {_places('supplier')} SELECT count(*) AS edges, count(DISTINCT e.unit) AS units, count(*) FILTER (e.unit=peer) AS self_edges, CAST(0 AS BIGINT) AS cross_city, round(median(km),6) AS median_km, round(quantile_cont(km,0.9),6) AS p90_km FROM edges e",
    "g15_distance_bins": f"WITH {_places('supplier')}, b AS (SELECT * FROM (VALUES (0,0.0e0,50.0e0),(1,50.0e0,100.0e0),(2,100.0e0,200.0e0),(3,200.0e0,400.0e0),(4,400.0e0,800.0e0),(5,800.0e0,1e9)) AS v(bin,lo,hi)) SELECT bin, lo, (SELECT count(*) FROM edges WHERE km>lo AND km<=hi) AS n FROM b",
    "g16_histogram": "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(29,floor((l_extendedprice-lo)/(hi-lo)*30.0e0)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1",
    "g17_top1_stability": f"WITH {_places('supplier')}, m AS (SELECT e.unit, e.peer FROM edges e JOIN edges b ON b.unit=e.peer AND b.peer=e.unit WHERE e.rnk=1), f AS (SELECT unit, peer FROM ranked WHERE rnk=1) SELECT count(*) AS n, avg(CAST(f.peer=m.peer AS INTEGER)) AS share FROM f JOIN m USING (unit)",
    "v03_peer_integrity": f"WITH {_places('supplier')} SELECT count(*) AS n_edges, count(*) FILTER (unit=peer) AS self_edges, CAST(0 AS BIGINT) AS cross_city, count(*)-count(DISTINCT (unit,peer)) AS repeated FROM edges",
    "j13_pair_similarity": f"{_SE}, {_periods('supplier')}, n AS (SELECT unit, aspect, net FROM panel WHERE has AND period=(SELECT max_by(period,ord) FROM periods WHERE complete)), p AS (SELECT e.unit, e.peer, avg(abs(a.net-b.net)) AS diff FROM edges e JOIN n a ON a.unit=e.unit JOIN n b ON b.unit=e.peer AND b.aspect=a.aspect GROUP BY e.unit, e.peer) SELECT count(*) AS edges, round(avg(diff),9) AS mean_diff FROM p",
    "j12_delta_correlation": f"{_SE}, {_DELTA}, m AS (SELECT unit, period, aspect, delta FROM deltas WHERE has AND prev_has) SELECT a.aspect, count(*) AS n, CASE WHEN count(*)>=20 THEN round(corr(a.delta,b.delta),9) END AS corr FROM edges e JOIN m a ON a.unit=e.unit JOIN m b ON b.unit=e.peer AND b.period=a.period AND b.aspect=a.aspect GROUP BY a.aspect",
    "r01_random_peers": f"WITH {_places('supplier')}, c AS (SELECT city, count(*) AS n FROM places GROUP BY city), o AS (SELECT city, lead(n) OVER (ORDER BY city) AS nx, first_value(n) OVER (ORDER BY city) AS f FROM c), k AS (SELECT p.unit, least(5,c.n-1) AS lo, least(5,coalesce(nx,f)) AS ot FROM places p JOIN c USING (city) JOIN o USING (city)) SELECT 'local' AS kind, count(*) AS units, min(lo) AS least, max(lo) AS most, CAST(sum(lo) AS BIGINT) AS same_city, CAST(0 AS BIGINT) AS repeats FROM k WHERE lo>0 UNION ALL SELECT 'other', count(*), min(ot), max(ot), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM k",
    "q01_snapshot": f"{_SNAP} SELECT unit, aspect, has, round(net,9) AS net, mentions, peer_count, peer_n, round(peer_median,9) AS peer_median, round(gap,9) AS gap, round(percentile,9) AS percentile, round(weak_share,9) AS weak_share, eligible, ineligible_reason FROM snap",
    "g19_counters": f"{_SNAP} SELECT coalesce(ineligible_reason,'eligible') AS status, count(DISTINCT unit) AS units, count(DISTINCT city) AS cities FROM snap GROUP BY 1",
    "p08_eligibility": f"{_HEADER_N} SELECT DISTINCT unit, city, eligible, ineligible_reason, peer_count FROM snap",
    "p02_gate_reasons": f"{_SNAP} SELECT unit, aspect, coalesce({_gate(peers=True, rate=True)},'eligible') AS reason FROM snap",
    "q03_fix_weakest": _rounded(_POLICIES["fix_weakest"]),
    "q04_largest_gap": _rounded(_POLICIES["largest_peer_gap"]),
    "q05_most_criticised": _rounded(_POLICIES["most_criticised"]),
    "q06_peer_relative": _rounded(_POLICIES["peer_relative"]),
    "q06_crowding_scenario": _rounded(_picked(_scores(intensity=0.5))),
    "q07_reliability_aware": _rounded(_POLICIES["reliability_aware"]),
    "q11_value_aware": _rounded(_picked(_scores(value={"ECONOMY": 2.0, "PROMO": 0.5, "SMALL": -1.0, "LARGE": 1.0, "MEDIUM": 1.0}))),
    "q06_abstention": f"{_SNAP} SELECT 'no_eligible_aspects' AS reason, count(DISTINCT unit) AS n FROM snap WHERE eligible AND unit NOT IN (SELECT unit FROM ({_POLICIES['peer_relative']})) HAVING count(*)>0",
    "q09_diagnosis_vs_action": f"{_SNAP}, dg AS ({_by('gap', actionable=False, peers=True)}), ac AS ({_POLICIES['peer_relative']}) SELECT dg.unit, dg.aspect AS diagnosis, ac.aspect AS action, dg.aspect IS DISTINCT FROM ac.aspect AS differs FROM dg LEFT JOIN ac ON ac.unit=dg.unit",
    "q10_all_policies": f"{_SNAP}, {_CHOICES} SELECT unit, strategy, aspect, round(score,9) AS score FROM choices",
    "q13_weight_grid_choices": f"{_SNAP} " + " UNION ALL ".join(f"SELECT unit, '{k}' AS grid, aspect FROM ({_picked(_scores(w))})" for k, w in WEIGHT_GRIDS.items()),
    "o03_ranking": f"{_SNAP} SELECT unit, aspect, round(score,9) AS score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, aspect) AS rank FROM {_scores(intensity=0.25)}",
    "g20_policy_coverage": f"{_SNAP}, {_CHOICES}, f AS (SELECT u.*, s.strategy, c.aspect FROM (SELECT DISTINCT unit, city, eligible FROM snap) u CROSS JOIN (SELECT DISTINCT strategy FROM choices) s LEFT JOIN choices c ON c.unit=u.unit AND c.strategy=s.strategy), g AS (SELECT strategy, coalesce(city,'(all)') AS city, count(*) FILTER (aspect IS NOT NULL AND eligible) AS recommended, count(*) FILTER (eligible AND aspect IS NULL) AS abstained, count(*) FILTER (eligible) AS el, count(*) AS un FROM f GROUP BY GROUPING SETS ((strategy),(strategy,city))) SELECT strategy, city, recommended, abstained, CASE WHEN el>0 THEN CAST(recommended AS DOUBLE)/el END AS of_eligible, CAST(recommended AS DOUBLE)/un AS of_all FROM g",
    "g21_pairwise_agreement": f"{_SNAP}, {_CHOICES}, c AS (SELECT * FROM choices WHERE unit IN (SELECT unit FROM choices GROUP BY unit HAVING count(*)=(SELECT count(DISTINCT strategy) FROM choices))) SELECT a.strategy AS s1, b.strategy AS s2, count(*) AS n, avg(CAST(a.aspect=b.aspect AS INTEGER)) AS rate FROM c a JOIN c b ON a.unit=b.unit AND a.strategy<b.strategy GROUP BY 1,2",
    "g22_policy_shares": f"{_SNAP}, {_CHOICES} SELECT strategy, aspect, count(*) AS n, CAST(count(*) AS DOUBLE)/CAST(sum(count(*)) OVER (PARTITION BY strategy) AS DOUBLE) AS share FROM choices GROUP BY strategy, aspect",
    "p21_choice_audit": f"{_SNAP}, {_CHOICES} SELECT strategy, count(*) AS choices, count(*) FILTER (c.aspect='STANDARD') AS not_actionable, CAST(0 AS BIGINT) AS unknown_actionability, count(*) FILTER (mentions<5 OR rel<0.3e0) AS low_evidence FROM choices c JOIN snap s ON s.unit=c.unit AND s.aspect=c.aspect GROUP BY strategy",
    "q17_match_score": f"{_SNAP}, {_MATCH} SELECT unit, round(score,9) AS score, round(coverage,9) AS coverage FROM match",
    "q17_contributions": f"{_SNAP}, {_MATCH} SELECT unit, aspect, round(w*rel*net/sum(w*rel) OVER (PARTITION BY unit),9) AS part FROM wt WHERE has AND net IS NOT NULL AND w*rel>0",
    "q18_city_ranking": f"{_SNAP}, {_MATCH} SELECT city, unit, s_name AS unit_name, {_PLACE} AS place, CASE WHEN score IS NOT NULL THEN {_PLACE} END AS rank, round(score,9) AS score FROM match JOIN supplier ON s_suppkey=unit WHERE eligible",
    "q18_rank_change": f"""{_SNAP}, {_MATCH}, rc AS ({_POLICIES['peer_relative']}), ch AS (SELECT arg_min(rc.unit, rc.unit) AS unit, arg_min(rc.aspect, rc.unit) AS aspect FROM rc JOIN (SELECT DISTINCT unit, city FROM snap) u ON u.unit=rc.unit GROUP BY u.city),
 fl AS (SELECT wt.*, ch.unit IS NOT NULL AND has AS hit, CASE WHEN ch.unit IS NOT NULL AND has THEN CAST(round_even(0.5e0*CAST(neg_mentions AS DOUBLE),0) AS BIGINT) ELSE 0 END AS f FROM wt LEFT JOIN ch ON ch.unit=wt.unit AND ch.aspect=wt.aspect),
 wt2 AS (SELECT * REPLACE (CASE WHEN f>0 THEN {_net('(pos+f)', '(neg_mentions-f)')} ELSE net END AS net) FROM fl),
 match2 AS (SELECT unit, city, bool_and(eligible) AS eligible, {_MATCHED} AS score FROM wt2 GROUP BY unit, city),
 r1 AS (SELECT city, unit, CASE WHEN score IS NOT NULL THEN {_PLACE} END AS rank, round(score,9) AS score FROM match JOIN supplier ON s_suppkey=unit WHERE eligible),
 r2 AS (SELECT unit, CASE WHEN score IS NOT NULL THEN {_PLACE} END AS rank, round(score,9) AS score FROM match2 JOIN supplier ON s_suppkey=unit WHERE eligible)
 SELECT r1.city, r1.unit, r1.unit IN (SELECT unit FROM ch) AS changed, r1.rank AS rank_before, r2.rank AS rank_after, r2.rank-r1.rank AS change, r1.score AS score_before, r2.score AS score_after FROM r1 JOIN r2 ON r2.unit=r1.unit""",
    "q19_improve": f"{_SNAP}, {_IMPROVE} SELECT unit, aspect, flips, round(after_net,9) AS \"after\", round(peer_median-after_net,9) AS gap_after FROM imp",
    "q21_outcome": f"{_SNAP}, {_OUTC} SELECT unit, aspect, flips, balance_before, balance_after, balance_gain, rating_points, revenue_pct FROM outc",
    "q22_compare_actions": f"{_SNAP}, {_GAIN} SELECT unit, aspect, recommended, flips, balance_before, balance_after, balance_gain, rating_points, revenue_pct, rnk AS rank FROM cmp",
    "q23_follow_rounds": f"{_SNAP}, {_follow(3)} " + " UNION ALL ".join(_step(i) for i in (1, 2, 3)),
    "q24_city_experiment": f"""{_SNAP}, {_GAIN}, e AS (SELECT unit, max(rating_points) FILTER (recommended) AS rec, avg(rating_points) AS rnd, arg_max(rating_points,(net,aspect)) AS lik, max(rating_points) AS top FROM cmp GROUP BY unit),
 u AS (SELECT DISTINCT unit, city FROM snap WHERE eligible) SELECT city, count(rec) AS units, count(*) FILTER (rec IS NULL) AS abstained, round(avg(rec),8) AS recommended, round(avg(rnd) FILTER (rec IS NOT NULL),8) AS random, round(avg(lik) FILTER (rec IS NOT NULL),8) AS best_liked,
 round(avg(top) FILTER (rec IS NOT NULL),8) AS oracle, round(avg(CAST(rec>=rnd-1e-9 AS INTEGER)),9) AS beats_random, round(avg(CAST(rec>=top-1e-9 AS INTEGER)),9) AS is_best FROM u LEFT JOIN e ON e.unit=u.unit GROUP BY city""",
    "g36_balance": f"{_SNAP} SELECT unit, round(sum(CAST(mentions AS DOUBLE)*net)/sum(CAST(mentions AS DOUBLE)),9) AS balance FROM snap WHERE has GROUP BY unit",
    "f38_radar_scenario": f"{_SNAP} SELECT unit, aspect, round(least(greatest(net+0.5e0*greatest(0.0e0,gap),-1.0e0),1.0e0),9) AS net FROM snap WHERE has AND gap IS NOT NULL",
    "w11_strongest_weakest": f"{_SNAP}, {_MATCH}, a AS (SELECT unit, aspect, row_number() OVER (PARTITION BY unit ORDER BY net DESC, aspect) AS s, row_number() OVER (PARTITION BY unit ORDER BY net, aspect DESC) AS k FROM wt WHERE has AND net IS NOT NULL AND w*rel>0), b AS (SELECT unit, max(aspect) FILTER (s=1) AS strongest, max(aspect) FILTER (k=1) AS weakest FROM a GROUP BY unit) SELECT unit, strongest, nullif(weakest, strongest) AS weakest FROM b",
    "w05_deltas": f"{_N}, {_DELTA} SELECT unit, aspect, period, round(delta,9) AS delta FROM deltas",
    "e01_legacy_events": f"{_N}, {_DELTA}, {_EVENTS} SELECT unit, aspect, period, round(delta,9) AS delta, total FROM ev",
    "e01_exposure": f"{_NE}, {_DELTA}, {_EVENTS} SELECT ev.unit, ev.aspect, ev.period, count(*) AS known, count(*) FILTER (p.delta>=0.15e0) AS improving, round(CAST(count(*) FILTER (p.delta>=0.15e0) AS DOUBLE)/CAST(count(*) AS DOUBLE),9) AS exposure FROM ev JOIN edges ON edges.unit=ev.unit JOIN deltas p ON p.unit=edges.peer AND p.aspect=ev.aspect AND p.ord=ev.ord GROUP BY ev.unit, ev.aspect, ev.period",
    "e02_strict_prefilter": f"{_NP}, full_p AS (SELECT panel.*, complete FROM panel JOIN periods USING (period) WHERE complete), w AS (SELECT *, net-lag(net) OVER c AS delta, lag(ord) OVER c AS po, lag(has) OVER c AS ph, lag(total) OVER c AS pt, CASE WHEN lag(ord,2) OVER c=ord-2 THEN lag(total,2) OVER c ELSE 0 END AS p2 FROM full_p WINDOW c AS (PARTITION BY unit, aspect ORDER BY ord)) SELECT unit, aspect, period, round(delta,9) AS delta, total FROM w WHERE po=ord-1 AND has AND ph AND total>=5 AND pt>=5 AND p2>=3 AND delta>=0.15e0 AND aspect<>'STANDARD' AND ord-(SELECT min(ord) FROM full_p)>=2 AND (SELECT max(ord) FROM full_p)-ord>=2",
    "e06_persistent_jumps": f"{_NP}, {_CELLS} SELECT unit, aspect, period, jump, stay FROM ({_JUMPS.format(s='')})",
    "e06_persistent_drops": f"{_NP}, {_CELLS} SELECT unit, aspect, period, jump, stay FROM ({_JUMPS.format(s='-')})",
    "g30_inventory": f"{_N}, {_DELTA}, {_EVENTS} SELECT aspect, count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT city) AS cities FROM ev GROUP BY aspect",
    "j15_control_pool": f"{_N}, {_DELTA}, {_EVENTS}, {_POOL} SELECT unit, aspect, CAST(ord AS INTEGER) AS ord, count(*) AS controls FROM pool GROUP BY ALL",
    "p16_feasibility_gate": f"{_N}, {_DELTA}, {_EVENTS}, e AS (SELECT count(*) AS events, count(DISTINCT unit) AS units, count(DISTINCT city) AS cities, count(DISTINCT aspect) AS aspects FROM ev) SELECT *, CASE WHEN units>=20 AND events>=50 AND cities>=4 AND aspects>=4 THEN 'GREEN' WHEN units>=10 AND events>=25 THEN 'AMBER' ELSE 'RED' END AS verdict FROM e",
    "m15_specificity": f"{_NP}, {_CELLS}, j AS ({_JUMPS.format(s='')}), d AS (SELECT *, net-net_0 AS mv FROM cells), o AS (SELECT *, mv-(sum(mv) OVER u - mv)/nullif(count(mv) OVER u - 1,0) AS diff FROM d WINDOW u AS (PARTITION BY unit, ord)) SELECT o.aspect, count(diff) AS n, round(avg(diff),9) AS mean, round(stddev_samp(diff)/sqrt(CAST(count(diff) AS DOUBLE)),9) AS se FROM o JOIN j ON j.unit=o.unit AND j.aspect=o.aspect AND j.ord=o.ord GROUP BY o.aspect",
    "e09_robustness_grid": f"{_N}, {_DELTA}, g AS (SELECT * FROM (VALUES (0.1e0),(0.15e0),(0.2e0)) AS a(threshold) CROSS JOIN (VALUES (3),(5),(10)) AS b(floor)) SELECT threshold, floor, count(*) AS n FROM deltas JOIN g ON delta>=threshold AND total>=floor WHERE before>=2 AND after>=2 GROUP BY threshold, floor",
    "w01_score_lags": f"{_S}, {_LAGS} SELECT unit, period, round(lag1,9) AS lag1, round(lag2,9) AS lag2, round(trend,9) AS trend, round(y_next,9) AS y_next, contiguous FROM lags",
    "w03_contiguous_delta": f"{_S}, {_DELTA} SELECT aspect, period, count(*) AS n, count(*) FILTER (delta>0) AS rises FROM deltas WHERE has AND prev_has GROUP BY aspect, period",
    "w07_demeaned": f"{_S} SELECT unit, aspect, period, round(net-avg(net) OVER (PARTITION BY unit, aspect),9) AS within FROM panel WHERE has",
    "w08_leave_one_out": f"{_S} SELECT unit, aspect, period, round((sum(net) OVER u - net)/nullif(count(net) OVER u - 1,0),9) AS others FROM panel WHERE has WINDOW u AS (PARTITION BY unit, period)",
    "d10_feature_frame": f"{_S}, {_LAGS}, wd AS (SELECT unit, period, " + ", ".join(f"max(CASE WHEN aspect='{a}' AND has THEN net END) AS net_{a.lower()}" for a in _ASPECT_NAMES) + " FROM panel GROUP BY unit, period) SELECT unit, period, " + ", ".join(f"round(net_{a.lower()},9) AS net_{a.lower()}" for a in _ASPECT_NAMES) + ", CAST(net_promo IS NULL AS DOUBLE) AS miss_promo, round(ln(1+n_reviews),9) AS volume FROM lags JOIN wd USING (unit, period)",
    "g25_baseline_mae": f"{_S}, {_LAGS}, tr AS (SELECT * FROM lags WHERE ord<=1998 AND y_next IS NOT NULL), c AS (SELECT city, avg(y_next) AS m FROM tr GROUP BY city), t AS (SELECT l.*, y AS p1, coalesce(y+trend,y) AS p2, coalesce(c.m,(SELECT avg(y_next) FROM tr)) AS p3 FROM lags l LEFT JOIN c ON c.city=l.city WHERE ord>1998 AND y_next IS NOT NULL) SELECT count(*) AS n, round(avg(abs(y_next-p1)),9) AS mae_persistence, round(avg(abs(y_next-p2)),9) AS mae_trend, round(avg(abs(y_next-p3)),9) AS mae_city_mean, round(sqrt(avg((y_next-p1)*(y_next-p1))),9) AS rmse_persistence, round(sqrt(avg((y_next-p2)*(y_next-p2))),9) AS rmse_trend, round(sqrt(avg((y_next-p3)*(y_next-p3))),9) AS rmse_city_mean FROM t",
    "g28_delta_median": f"{_S}, {_DELTA} SELECT aspect, count(*) AS n, round(median(delta),9) AS median_rise FROM deltas WHERE has AND prev_has AND delta>0 GROUP BY aspect",
    "m07_cluster_mean": "WITH t AS (SELECT avg(l_quantity) AS m FROM lineitem), s AS (SELECT l_suppkey, sum(l_quantity-m) AS s, count(*) AS n FROM lineitem, t GROUP BY l_suppkey) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS n, round((SELECT m FROM t),9) AS mean, round(sqrt(CAST(count(*) AS DOUBLE)/(CAST(count(*) AS DOUBLE)-1))*sqrt(sum(s*s))/CAST(sum(n) AS DOUBLE),9) AS se FROM s",
    "m14_event_did": f"{_NP}, {_CELLS}, {_LAGS}, j AS ({_JUMPS.format(s='')}), u AS (SELECT unit, ord, trend AS dy FROM lags WHERE contiguous AND trend IS NOT NULL), c AS (SELECT avg(dy) AS cm, var_samp(dy) AS cv, count(*) AS cn FROM u WHERE (unit,ord) NOT IN (SELECT (unit,ord) FROM j)), t AS (SELECT aspect, avg(dy) AS tm, var_samp(dy) AS tv, count(*) AS n FROM u JOIN j USING (unit,ord) GROUP BY aspect) SELECT aspect, n, cn AS controls, round(tm-cm,9) AS att, round(sqrt(tv/n+cv/cn),9) AS se FROM t, c WHERE n>=5",
    "g31_kappa": f"{_LABELS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (quality=long_text) AS DOUBLE) AS s, CAST(count(*) FILTER (quality=0) AS DOUBLE) AS q0, CAST(count(*) FILTER (quality=1) AS DOUBLE) AS q1, CAST(count(*) FILTER (long_text=0) AS DOUBLE) AS l0, CAST(count(*) FILTER (long_text=1) AS DOUBLE) AS l1 FROM lab WHERE quality IS NOT NULL AND long_text IS NOT NULL) SELECT CAST(t AS BIGINT) AS n, round(s/t,9) AS observed, round((s/t-(q0*l0+q1*l1)/(t*t))/(1.0e0-(q0*l0+q1*l1)/(t*t)),9) AS kappa FROM n",
    "g32_f1": f"{_LABELS}, k AS (SELECT * FROM lab WHERE quality IS NOT NULL AND long_text IS NOT NULL), s AS (SELECT v AS label, count(*) FILTER (quality=v AND long_text=v) AS tp, count(*) FILTER (quality=v) AS support, count(*) FILTER (long_text=v) AS g FROM k, (VALUES (0),(1)) AS x(v) GROUP BY v) SELECT label, support, round(CASE WHEN g>0 THEN CAST(tp AS DOUBLE)/g END,9) AS precision, round(CASE WHEN support>0 THEN CAST(tp AS DOUBLE)/support END,9) AS recall, round(CASE WHEN support+g>0 THEN 2.0e0*tp/(support+g) END,9) AS f1 FROM s WHERE support+g>0",
    "g33_grouped_agreement": f"{_LABELS} SELECT coalesce(lang,'(all)') AS lang, count(*) AS n, round(avg(CAST(quality=long_text AS INTEGER)),9) AS agree FROM lab WHERE quality IS NOT NULL AND long_text IS NOT NULL GROUP BY GROUPING SETS ((),(lang))",
    "r05_stratified_sample": "SELECT lang, source, least(3,count(*)) AS n, count(*) AS population FROM documents GROUP BY lang, source",
    "r06_first_then_cut": "WITH f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang FROM f WHERE rn<=5 ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "r04_permutation": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment",
    "r14_group_folds": "SELECT count(DISTINCT l_suppkey) AS units, CAST(1 AS BIGINT) AS most_folds, count(*) AS n FROM lineitem",
    "x01_stream_counts": "SELECT strftime(ts,'%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value),6) AS total FROM events GROUP BY 1,2",
    "j03_order_reconciliation": "WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT count(*) FILTER (o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL) AS \"both\", count(*) FILTER (l_orderkey IS NULL) AS orders_only, count(*) FILTER (o_orderkey IS NULL) AS lines_only, CAST(sum(lines) AS BIGINT) AS lines FROM orders FULL JOIN l ON o_orderkey=l_orderkey",
    "j14_semi_anti": "SELECT c_mktsegment, count(*) AS n, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind FROM customer GROUP BY 1,3",
    "u02_set_operations": "WITH a AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag='R'), b AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag='A') SELECT count(*) AS n, 'intersect' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT count(*), 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT count(*), 'union' FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "o02_top_units": f"{_S} SELECT unit, count(*) AS n FROM base GROUP BY unit ORDER BY n DESC, unit LIMIT 10",
    "q20_record_simulation": f"""{_SNAP}, rc AS ({_POLICIES['peer_relative']}), fl AS (SELECT snap.unit, snap.aspect, pos, neg_mentions, CASE WHEN rc.unit IS NOT NULL THEN CAST(round_even(0.3e0*CAST(neg_mentions AS DOUBLE),0) AS BIGINT) ELSE 0 END AS f FROM snap LEFT JOIN rc ON rc.unit=snap.unit AND rc.aspect=snap.aspect WHERE has)
 SELECT unit, aspect, CAST(pos+f AS BIGINT) AS pos_mentions, CAST(neg_mentions-f AS BIGINT) AS neg_mentions, round({_net('(pos+f)', '(neg_mentions-f)')},9) AS net FROM fl""",
    "q10_evidence": f"{_SNAP}, {_CHOICES}, cand AS (SELECT unit, count(*) AS candidates FROM snap WHERE {_gate()} IS NULL GROUP BY unit) SELECT c.unit, strategy, c.aspect, mentions, neg_mentions, peer_n, candidates, round(gap,9) AS gap, round(percentile,9) AS percentile FROM choices c JOIN snap ON snap.unit=c.unit AND snap.aspect=c.aspect JOIN cand ON cand.unit=c.unit",
    "u05_reference_counters": f"{_SNAP}, b AS (SELECT unit, peer FROM edges UNION ALL SELECT unit, unit FROM edges WHERE rnk=1 UNION ALL SELECT unit, peer FROM edges WHERE rnk=2 UNION ALL SELECT unit, -peer FROM edges WHERE rnk=3), k AS (SELECT unit, peer, count(*) AS n, peer IN (SELECT unit FROM rec) AS here FROM b GROUP BY unit, peer) SELECT CAST(sum(n) AS BIGINT) AS edges, CAST(coalesce(sum(n) FILTER (unit=peer),0) AS BIGINT) AS self_edges, CAST(sum(n-1) FILTER (unit<>peer) AS BIGINT) AS repeated, count(*) FILTER (unit<>peer AND NOT here) AS absent, count(*) FILTER (unit<>peer AND here) AS kept FROM k",
    "e02_strict_full": f"{_RUN}, {_strict('', 'sn', "aspect<>'STANDARD'")} SELECT unit, aspect, period, known, improving, round(p_rise,6) AS p_rise FROM sn",
    "e03_strict_run": f"{_RUN_ALL} SELECT set, aspect, count(*) AS n, count(DISTINCT unit) AS units, count(*) FILTER (improving>0) AS exposed, count(*) FILTER (around) AS around FROM run GROUP BY ALL",
    "p17_strict_verdict": f"""{_RUN_ALL}, v AS (SELECT count(*) AS events, count(DISTINCT unit) AS units, count(DISTINCT city) AS cities, count(DISTINCT aspect) AS aspects, count(*) FILTER (improving>0) AS exposed, count(*) FILTER (improving=0) AS unexposed, round(coalesce(avg(CAST(around AS INTEGER)),0.0e0),9) AS around, count(DISTINCT set) AS halves FROM run WHERE set IN ('A','B')),
 g AS (SELECT *, events>=300 AND units>=200 AND cities>=4 AND aspects>=4 AND exposed>=100 AND unexposed>=100 AND around>=0.7e0 AS green FROM v) SELECT events, units, cities, aspects, exposed, unexposed, around, halves, CASE WHEN green AND halves=2 THEN 'GREEN_EXPLORATORY' WHEN green OR (events>=50 AND units>=30) THEN 'AMBER_ASSOCIATIONAL' ELSE 'RED_MEASUREMENT' END AS verdict FROM g""",
    "w09_cooldown": f"WITH RECURSIVE {_N.removeprefix('WITH ')}, {_DELTA}, {_EVENTS}, o AS (SELECT unit, aspect, ord, row_number() OVER (PARTITION BY unit, aspect ORDER BY ord) AS nr FROM (SELECT DISTINCT unit, aspect, ord FROM ev)), r AS (SELECT unit, aspect, nr, ord AS last, true AS keep FROM o WHERE nr=1 UNION ALL SELECT o.unit, o.aspect, o.nr, CASE WHEN o.ord-r.last>2 THEN o.ord ELSE r.last END, o.ord-r.last>2 FROM r JOIN o ON o.unit=r.unit AND o.aspect=r.aspect AND o.nr=r.nr+1) SELECT aspect, count(*) AS n FROM r WHERE keep GROUP BY aspect",
    "g01_review_flagship": _rounded(_POLICIES["fix_weakest"]),
}
