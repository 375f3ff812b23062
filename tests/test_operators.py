"""Operators on small made-up data."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import period as P
from larkspan.functions import score as S
from larkspan.functions import text as X
from larkspan.operators import agreement, events, panel, peers, policy, predict, sampling, snapshot, traveller
from larkspan.plans.queries import QUERIES, Tables
from larkspan.sources import reviews as R
from larkspan.streaming import panel_stream


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("No Negative", True), (" nothing. ", True), ("", True), (None, True), ("Great staff", False), ("\tN/A\n", True), ("all  good!", True)])
def test_placeholder(spark, text, want):
    assert one(spark, X.is_placeholder(F.lit(text).cast("string"), X.NEGATIVE_PLACEHOLDERS)) is want


@pytest.mark.parametrize("text,want", [("Breakfast buffet was excellent", ["breakfast"]), ("The cleaners smelled", ["cleanliness"]), ("unroomy embedded", []), ("good deal, close to a tram", ["location", "value"]), (None, [])])
def test_gate(spark, text, want):
    assert one(spark, X.gate_aspects(F.lit(text).cast("string"))) == want


def test_address_and_ids(spark):
    city, country = X.parse_city_country(F.lit("  1 Dam   Square Amsterdam Netherlands "))
    assert (one(spark, city), one(spark, country)) == ("Amsterdam", "Netherlands")
    city, country = X.parse_city_country(F.lit("5 Road Utrecht Atlantis"))
    assert (one(spark, city), one(spark, country)) == ("Utrecht", "Atlantis")
    import hashlib

    pos, neg = "très bon", "mauvais"
    want = hashlib.sha1(b"a|1/2/2017|8.5|FR|" + hashlib.sha1(pos.encode()).digest() + hashlib.sha1(neg.encode()).digest()).hexdigest()
    got = one(spark, X.review_fingerprint(*[F.lit(x) for x in ("a", "1/2/2017", "8.5", "FR", pos, neg)]))
    assert got == want and one(spark, X.fold_of(F.lit(got))) == ("A" if int(want[:8], 16) % 2 == 0 else "B")


@pytest.mark.parametrize("text,want", [("8/3/2017", "2017-08-03"), ("2017-08-03", "2017-08-03"), ("31/12/2016", "2016-12-31"), ("1/2/17", "2017-01-02"), ("", None), ("junk", None)])
def test_dates(spark, text, want):
    assert str(one(spark, P.parse_date(F.lit(text)))) == str(want)


def test_scores(spark):
    assert one(spark, S.smoothed_net(F.lit(3), F.lit(1), 10.0)) == 2.0 * ((3 + 5.0) / 14.0) - 1.0
    assert one(spark, S.raw_net(F.lit(0), F.lit(0))) is None and one(spark, S.reliability(F.lit(-3))) == 0.0
    assert one(spark, S.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278))) == pytest.approx(343.5, abs=1)
    assert one(spark, S.finite(F.lit(float("nan")))) is None and one(spark, S.finite(F.lit(float("-inf")))) is None
    assert one(spark, X.quote_formula(F.lit(" =1+1"))) == "' =1+1" and one(spark, X.fenced_json(F.lit('so: ```json\n{"a": 1}\n```'))) == '{"a": 1}'


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "reviews")
    R.fixture(spark).write.csv(path, header=True, quote='"', escape='"')
    return R.mentions(R.reviews(R.read_csv(spark, path))).cache()


def test_fixture_panel(spark, made):
    assert R.fixture(spark).count() == 1680
    full = panel.dense_panel(made, X.ASPECTS)
    assert full.count() == full.select("unit", "period", "aspect").distinct().count() == made.select("unit", "period").distinct().count() * 7
    bad = panel.integrity(full, X.ASPECTS).first().asDict()
    assert bad.pop("n_rows") > 0 and set(bad.values()) == {0}
    empty = full.where("total = 0").select("raw_net", "net").distinct().collect()
    assert all(r.raw_net is None and r.net == 0 for r in empty)
    assert not set(full.columns) & R.TEXT_COLUMNS
    assert made.where("aspect = 'room'").count() > 0 and {r.city for r in made.select("city").distinct().collect()} == set(X.CITIES)


def test_nested_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"review_id": "1", "hotel_url": "http://x/h.html?q", "aspects": {"room": {"sentiment": "Positive"}, "noise": {"sentiment": "negative"}}}\n{"review_id": "2", "hotel_url": "http://x/h.html", "aspects": {"room": {"sentiment": "neutral"}}}\n')
    rows = {(r.url, r.aspect): (r.positive, r.negative, r.neutral, r.mentions) for r in R.read_aspect_json(spark, str(tmp_path)).collect()}
    assert rows == {("http://x/h.html", "room"): (1, 0, 1, 2), ("http://x/h.html", "noise"): (0, 1, 0, 1)}


def test_peers(spark):
    p = spark.createDataFrame([(1, "X", 48.0, 16.0), (2, "X", 48.001, 16.0), (3, "X", 48.01, 16.0), (4, "Y", 48.0, 16.0), (5, "X", None, 16.0)], "unit long, city string, lat double, lon double")
    e = peers.knn(p, 2)
    got = {(r.unit, r.peer, r["rank"]) for r in e.collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)}
    assert peers.integrity(e, p).first().asDict() == {"n_edges": 6, "self_edges": 0, "cross_city": 0, "repeated": 0}
    assert {(r.unit, r.peer) for r in peers.mutual(peers.knn(p, 1)).collect()} == {(1, 2), (2, 1)}
    assert {(r.unit, r.peer) for r in peers.within_radius(p, 0.5).collect()} == {(1, 2), (2, 1)}


def test_peers_by_grid(spark, monkeypatch):
    """Large cities, by cells, against all pairs: crowds, one place shared by many, few units, a line, the far north."""
    rng = np.random.default_rng(9)
    rows = [(i, "A", 48 + rng.normal() * 0.1, 2 + rng.normal() * 0.1) for i in range(150)] + [(1000 + i, "A", 48.0, 2.0) for i in range(40)] + [(1100, "A", 50.0, 9.0)]
    rows += [(2000 + i, "B", 89.0 + rng.random() * 0.9, rng.random() * 100) for i in range(60)] + [(3000 + i, "C", 10.0, 20 + i / 7) for i in range(50)] + [(4000 + i, "D", float(i), 1.0) for i in range(3)]
    p = spark.createDataFrame([(i, c, float(a), float(b)) for i, c, a, b in rows], "unit long, city string, lat double, lon double")
    get = lambda df: {(r.unit, r.peer, r["rank"], round(r.km, 6)) for r in df.collect()}
    plain = get(peers.knn(p, 5))
    monkeypatch.setattr(peers, "DENSE", 2)
    assert get(peers.knn(p, 5)) == plain and len(plain) == 301 * 5 + 3 * 2
    for km in (3.0, 40.0, 2000.0):
        brute = peers._ranked(peers._measured(peers._own(p), peers._other(p), ["city"]).where(F.col("km") <= km), F.col("km"), F.col("peer"))
        assert get(peers.within_radius(p, km)) == get(brute)


SNAP = "unit long, city string, aspect string, has boolean, net double, rel double, mentions long, pos_mentions long, neg_mentions long, neg_rate double, mention_rate double, n_reviews long, peer_count long, peer_median double, peer_n long, gap double, percentile double, weak_share double, eligible boolean, ineligible_reason string, actionable boolean"


def rec(unit, aspect, net, gap, rate, rel=0.6, mentions=12, peer_n=4, eligible=True, share=0.2, has=True):
    neg = round(mentions * rate)
    return (unit, "X", aspect, has, net, rel, mentions, mentions - neg, neg, rate, 0.5, 40, 4, (net or 0) + (gap or 0), peer_n, gap, 50.0, share, eligible, None, aspect != "STANDARD")


@pytest.fixture(scope="module")
def snap(spark):
    rows = [rec(1, "A", -0.2, 0.3, 0.5), rec(1, "B", 0.1, 0.5, 0.2), rec(1, "STANDARD", -0.9, 0.9, 0.9), rec(1, "C", -0.8, 0.8, 0.8, mentions=2), rec(1, "D", -0.7, 0.7, 0.7, rel=0.1), rec(1, "E", -0.6, None, 0.7, peer_n=0)]
    rows += [rec(2, "A", 0.2, 0.1, 0.3), rec(2, "B", 0.2, 0.1, 0.3), rec(3, "A", -0.1, 0.2, 0.2, eligible=False)]
    return spark.createDataFrame(rows, SNAP)


def choice(df):
    return {r.unit: r.aspect for r in df.collect()}


def test_policies(snap):
    assert choice(policy.fix_weakest(snap)) == {1: "E", 2: "A"}
    assert choice(policy.largest_gap(snap)) == {1: "B", 2: "A"}
    assert choice(policy.diagnostic_gap(snap)) == {1: "STANDARD", 2: "A"}
    assert choice(policy.most_criticised(snap)) == {1: "E", 2: "A"}
    scores = {(r.unit, r.aspect): r.score for r in policy.peer_relative_scores(snap).collect()}
    assert scores == pytest.approx({(1, "A"): 0.35 - 0.2 * 0.4, (1, "B"): 0.45 - 0.2 * 0.4, (2, "A"): -0.08, (2, "B"): -0.08})
    assert choice(policy.peer_relative(snap)) == {1: "B", 2: "A"}
    assert choice(policy.value_aware(snap, {"A": 1.0, "B": 1.0})) == choice(policy.peer_relative(snap))
    reasons = {(r.unit, r.aspect): r.reason for r in policy.gate_reasons(snap).collect()}
    assert reasons[1, "STANDARD"] == "not_actionable" and reasons[1, "C"] == "insufficient_mentions" and reasons[1, "D"] == "insufficient_reliability" and reasons[1, "E"] == "nonfinite_gap" and reasons[3, "A"] == "unit_ineligible"
    everything = policy.all_policies(snap)
    assert not everything.where("aspect = 'STANDARD'").count() and {r.not_actionable for r in policy.audit(snap, everything).collect()} == {0}
    assert choice(policy.peer_relative(snap.orderBy(F.rand(1)))) == choice(policy.peer_relative(snap))


def test_traveller(snap):
    w = {"A": 2.0, "B": 1.0}
    parts = traveller.contributions(snap, w).groupBy("unit").agg(F.sum("part").alias("s")).collect()
    scores = {r.unit: r.score for r in traveller.match_scores(snap, w).collect()}
    assert all(scores[r.unit] == pytest.approx(r.s) for r in parts)
    assert [(r.unit, r["rank"]) for r in traveller.city_ranking(traveller.match_scores(snap, w)).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    with pytest.raises(ValueError):
        traveller.improve(snap, 1.5)
    for bad in ({"Z": 1.0}, {"A": -1.0}, {"A": 0.0}, {"A": float("inf")}):
        with pytest.raises(ValueError):
            traveller.checked_weights(bad, ["A", "B"])
    moved = {(r.unit, r.aspect): r for r in traveller.improve(snap, 0.5).collect()}
    assert moved[1, "A"].flips == 3 and moved[1, "A"].gain > 0 and traveller.improve(snap, 0.0).where("flips != 0").count() == 0


#: Counts of positive and negative mentions of a unit, and how its three peers differ.
COUNTS = {"location": (20, 2), "cleanliness": (12, 3), "breakfast": (8, 8), "service": (15, 2), "noise": (6, 6), "room": (10, 12), "value": (5, 5)}
DIFFER = [(0, 0), (4, -2), (2, 0), (6, -3)]


@pytest.fixture(scope="module")
def paris(spark):
    """Four units of a city, each the others' peer, through the panel to a snapshot."""
    rows = [(u, f"H{u}", "Paris", "2017Q1", 8069, a, k >= p + dp, 8.0, "AB"[k % 2]) for u, (dp, dn) in enumerate(DIFFER) for a, (p, n) in COUNTS.items() for k in range(p + dp + max(0, n + dn))]
    m = spark.createDataFrame(rows, "unit long, unit_name string, city string, period string, ord int, aspect string, neg boolean, score double, fold string")
    edges = spark.createDataFrame([(a, b, 1) for a in range(4) for b in range(4) if a != b], "unit long, peer long, rank int")
    places = spark.createDataFrame([(u, "Paris", 48.0, 2.0 + u) for u in range(4)], "unit long, city string, lat double, lon double")
    return snapshot.snapshot(panel.dense_panel(m, X.ASPECTS), edges, places, "2017Q1", X.ASPECTS).cache()


def test_simulated_improvement(paris):
    """Formulas, what an improvement changes, and that location is never acted on."""
    rows = {(r.unit, r.aspect): r for r in paris.collect()}
    room = rows[0, "room"]
    assert room.net == pytest.approx((10 - 12) / (22 + 10)) and room.rel == pytest.approx(22 / 32) and room.neg_rate == pytest.approx(12 / 22) and room.peer_n == 3
    assert room.gap == pytest.approx(room.peer_median - room.net) and not rows[0, "location"].actionable
    room_only = paris.sparkSession.createDataFrame([(0, "room")], "unit long, aspect string")
    after = {(r.unit, r.aspect): r for r in traveller.improved(paris, room_only, 0.5).collect()}
    new = after[0, "room"]
    assert (new.neg_mentions, new.pos_mentions, new.mentions, new.rel) == (6, 16, 22, room.rel) and new.net > room.net and new.gap < room.gap
    assert all(after[k] == rows[k] for k in rows if k != (0, "room"))
    o = {(r.unit, r.aspect): r for r in traveller.outcomes(paris, 0.5, 2.0, 4.0).collect()}[0, "room"]
    total = sum(p + n for p, n in COUNTS.values())
    net = {a: (p - n) / (p + n + 10) for a, (p, n) in COUNTS.items()}
    before = sum((p + n) * net[a] for a, (p, n) in COUNTS.items()) / total
    gain = 22 * ((16 - 6) / 32 - net["room"]) / total
    assert (o.flips, o.balance_before) == (6, pytest.approx(before, abs=1e-8)) and o.balance_gain == pytest.approx(gain, abs=1e-8) and o.rating_points == pytest.approx(2 * gain, abs=1e-8) and o.revenue_pct == pytest.approx(8 * gain, abs=1e-8)
    records = traveller.mention_records(paris)
    counted = {(r.unit, r.aspect): r for r in traveller.from_records(traveller.improve_records(records, room_only, 0.5)).collect()}
    assert all((r.pos_mentions, r.neg_mentions, r.net) == (after[k].pos_mentions, after[k].neg_mentions, pytest.approx(after[k].net)) for k, r in counted.items())
    assert len(counted) == 28 and set(records.columns) == {"unit", "aspect", "number", "review", "neg"}


def test_actions_rounds_and_city(paris, spark):
    wanted = choice(policy.peer_relative(paris))
    rows = traveller.compare_actions(paris, 0.5).orderBy("unit", "rank").collect()
    assert "location" not in {r.aspect for r in rows} and {r.unit: r.aspect for r in rows if r.recommended} == wanted
    mine = [r for r in rows if r.unit == 0]
    assert [r.rating_points for r in mine] == sorted((r.rating_points for r in mine), reverse=True)
    assert {r.aspect: r.rating_points for r in mine}["room"] > {r.aspect: r.rating_points for r in mine}["service"]
    steps = traveller.follow(paris, 0.5, 3).where("unit = 0").orderBy("round").collect()
    assert [s["round"] for s in steps] == [1, 2, 3] and steps[0].aspect == wanted[0] and [s.rating_points for s in steps] == sorted(s.rating_points for s in steps)
    # Each round by hand: ask again on the improved measures.
    state = paris
    for s in steps:
        now = policy.peer_relative(state).where("unit = 0")
        assert choice(now) == {0: s.aspect}
        state = traveller.improved(state, now, 0.5)
    still = traveller.follow(paris, 0.0, 3).collect()
    assert {(s["round"], s.flips, s.stalled, s.rating_points) for s in still} == {(1, 0, True, 0.0)}
    none = traveller.follow(paris.withColumn("eligible", F.lit(False)), 0.5, 3).collect()
    assert len(none) == 4 and {(s["round"], s.aspect, s.stalled, s.rating_points) for s in none} == {(1, None, False, None)}
    c = traveller.city_experiment(paris, 0.5).first()
    assert c.units + c.abstained == 4 and c.recommended <= c.oracle and c.random <= c.oracle and traveller.city_experiment(paris.where("city = 'London'"), 0.5).count() == 0
    d = policy.action_against_diagnosis(paris).where("unit = 0").first()
    assert d.action == wanted[0]


def test_traveller_order(spark):
    """Ties by name, then unit; units without evidence last and without a rank; strongest and weakest by configuration."""
    rows = [("d", "X", True, 0.4), ("c", "X", True, 0.4), ("b", "A", True, 0.4), ("a", "Z", True, 0.9), ("e", "B", True, None), ("f", "C", False, 0.9)]
    scores = spark.createDataFrame([(u, "Paris", e, s) for u, _, e, s in rows], "unit string, city string, eligible boolean, score double")
    names = spark.createDataFrame([(u, n) for u, n, *_ in rows], "unit string, unit_name string")
    got = [(r.unit, r["rank"]) for r in traveller.city_ranking(scores, names).orderBy("place").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", None)]
    aspects = [("service", 0.3), ("cleanliness", 0.3), ("room", None), ("noise", -0.9)]
    snap = spark.createDataFrame([(1, a, n is not None, n, 0.5) for a, n in aspects] + [(2, "service", True, 0.1, 0.5)], "unit long, aspect string, has boolean, net double, rel double")
    w = {"service": 1.0, "cleanliness": 1.0, "room": 1.0}
    found = {r.unit: (r.strongest, r.weakest) for r in traveller.strongest_and_weakest(snap, w, X.ASPECTS).collect()}
    assert found == {1: ("cleanliness", "service"), 2: ("service", None)}
    assert all(traveller.persona_of(p) == name for name, p in traveller.PERSONAS.items()) and traveller.persona_of({"room": 9}) is None
    assert all(set(p) == set(X.ASPECTS) for p in traveller.PERSONAS.values())


def test_reviews_count_as_reviews(spark):
    """A review that names two aspects, or none, is one review of its unit and period."""
    raw = spark.createDataFrame([("1 A Street Paris France", "1/2/2017", "8.0", "Clean room, friendly staff", "No Negative"), ("1 A Street Paris France", "2/2/2017", "6.0", "all fine", "Nothing"), ("1 A Street Paris France", "junk", "5.0", "room", "room")], "Hotel_Address string, Review_Date string, Reviewer_Score string, Positive_Review string, Negative_Review string")
    found = R.reviews(raw)
    up = panel.unit_periods(R.rows(found)).first()
    assert (up.n_reviews, up.mean_score) == (2, 7.0)
    full = panel.dense_panel(R.mentions(found), X.ASPECTS, reviews=R.rows(found)).collect()
    assert len(full) == 7 and {r.n_reviews for r in full} == {2} and {r.aspect for r in full if r.has} == {"cleanliness", "room", "service"}
    c = R.stream_counters(found).first()
    assert (c.n, c.days, c.no_day, c.negative_placeholders, c.positive_unnamed, c.positive_mentions) == (3, 2, 1, 2, 1, 4)


def cells(spark, nets, **more):
    rows = [(1, "X", "A", str(t), t, n, 0.8, True, True, 20, 12, 8, 3.0) for t, n in enumerate(nets)]
    return spark.createDataFrame(rows, "unit long, city string, aspect string, period string, ord int, net double, rel double, has boolean, complete boolean, total long, pos long, neg long, mean_score double")


def test_events(spark):
    jump = cells(spark, [0.0, 0.0, 0.5, 0.5, 0.5, 0.5])
    assert [r.ord for r in events.persistent_events(events.cells(jump)).collect()] == [2]
    spike = cells(spark, [0.0, 0.0, 0.5, 0.0, 0.0, 0.0])
    assert events.persistent_events(events.cells(spike)).count() == 0
    drop = cells(spark, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0])
    assert [r.ord for r in events.persistent_events(events.cells(drop), sign=-1).collect()] == [2] and events.persistent_events(events.cells(drop)).count() == 0
    e = spark.createDataFrame([(1, "A", o) for o in (1, 2, 4, 5, 7)], "unit long, aspect string, ord int")
    assert sorted(r.ord for r in events.cooldown(e, 2).collect()) == [1, 4, 7]
    assert [r.ord for r in events.permissive_events(jump).collect()] == [2]


def test_posterior():
    rng = np.random.default_rng(0)
    for a in ((15.0, 7.0, 12.0, 10.0), (12.5, 4.5, 9.5, 7.5), (5.0, 5.0, 5.0, 5.0)):
        mc = (rng.beta(a[0], a[1], 200_000) > rng.beta(a[2], a[3], 200_000)).mean()
        assert events.beta_greater(*a) == pytest.approx(mc, abs=0.01)
    assert events.beta_greater(5.0, 5.0, 5.0, 5.0) == pytest.approx(0.5, abs=1e-9)
    assert events.beta_greater(3.0, 2.0, 2.0, 4.0) == pytest.approx(1 - events.beta_greater(2.0, 4.0, 3.0, 2.0), abs=1e-12)


def test_estimators(spark):
    rng = np.random.default_rng(1)
    n = 400
    cell, t = rng.integers(0, 40, n), rng.integers(0, 6, n)
    x = rng.normal(size=n) + cell / 10
    y = 0.7 * x + cell * 0.3 + t * 0.2 + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(cell, t, x, y, strict=True)], "cell int, t int, x double, y double")
    fit = predict.fixed_effects(df, "y", ["x"], ["cell"], "t", "cell").first()
    assert fit.beta == pytest.approx(0.7, abs=0.03) and fit.lo < 0.7 < fit.hi and fit.clusters == 40
    b = predict.ridge(df, ["x"], "y", 0.0)
    assert b == pytest.approx(np.linalg.lstsq(np.stack([np.ones(n), x], 1), y, rcond=None)[0])
    with pytest.raises(ValueError):
        predict.fixed_effects(df.limit(10), "y", ["x"], ["cell"], "t", "cell")
    fitted = predict.fitted(df.where("t < 3"), df.where("t = 3"), df.where("t > 3"), ["x", "cell"], "y").first()
    assert fitted.n == int((t > 3).sum()) and fitted.mae < 1.0
    m = predict.cluster_mean(df, "y", "cell").first()
    assert m.mean == pytest.approx(y.mean(), abs=1e-8) and m.clusters == len(set(cell))


def test_sampling(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    s = sampling.stratified(df, ["g"], "id", 5)
    assert s.count() == 35 and {r.id for r in s.collect()} == {r.id for r in sampling.stratified(df.repartition(5), ["g"], "id", 5).collect()}
    p = sampling.permuted(df, "id", ["g"], "id")
    assert p.where("id % 7 = id_perm % 7").count() == 1000 and p.where("id != id_perm").count() > 800
    b = sampling.cluster_bootstrap(df, "g", "id", 300).first()
    assert b.lo <= b.mean <= b.hi and b.mean == pytest.approx(499.5)
    w = spark.range(20_000).select(sampling.poisson_weight(sampling.uniform("id", seed=1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1, abs=0.05) and w[1] == pytest.approx(1, abs=0.08)


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")], "x string, y string")
    assert agreement.kappa(df, "x", "y").first().kappa == pytest.approx(0.4)
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert agreement.kappa(same, "x", "y").first().kappa == 1.0 and agreement.kappa(same, "x", "y", None).first().kappa is None


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = panel_stream.window_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    finally:
        q.stop()
    assert got == {(r.start, r.event_type): r.n for r in panel_stream.window_counts(e).collect()} and got


def test_cooldown_stream(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 0{h}:00:00") for d, h in ((1, 0), (1, 5), (2, 1), (3, 0), (3, 2))] + [(2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = panel_stream.cooldown_stream(stream).writeStream.format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.user_id, str(r.ts)) for r in spark.table("cool").collect())
    finally:
        q.stop()
    assert got == [(1, "2024-01-01 00:00:00"), (1, "2024-01-02 01:00:00"), (1, "2024-01-03 02:00:00"), (2, "2024-01-01 00:00:00")]


def test_rows_only_queries(spark, sf):
    for name in ("e02_strict_full", "j16_matching", "m06_fe_ols", "r11_cluster_bootstrap", "w09_cooldown", "g26_event_time_means", "m02_ridge_fit", "q01_documents"):
        QUERIES[name](spark, sf).collect()
    t = Tables(spark, sf, "nation")
    strict = events.strict_events(t.whole, t.edges, peers=2, p=0.8, immutable="STANDARD")
    assert strict.where("aspect = 'STANDARD' OR p_rise < 0.8 OR known < 2").count() == 0
    pairs = events.match(events.control_pool(events.permissive_events(t.panel), t.panel))
    assert pairs.groupBy("city", "aspect", "ord", "control").count().where("count > 1").count() == 0
    assert math.isfinite(QUERIES["m06_fe_ols"](spark, sf).first().beta)


def test_contract_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['larkspan.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_whole_texts_and_props(spark, sf, tmp_path):
    rows = {(r.conv_id, r.turn): r.h for r in QUERIES["f01_normalise"](spark, sf).collect()}
    texts = R.table(spark, sf, "conversations").select("conv_id", "turn", "text").collect()
    assert max(len(r.text or "") for r in texts) > 40
    assert rows == {(r.conv_id, r.turn): hashlib.sha1(" ".join((r.text or "").lower().split()).encode()).hexdigest() for r in texts}
    spark.createDataFrame([('{"k":' + " " * 60 + "7}",)], "props string").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["f40_coercion"](spark, str(tmp_path)).first()["counts"] == 1


def test_pair_similarity_of_the_last_complete_period(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    monkeypatch.setattr(snapshot, "last_complete", lambda periods: "1997")
    then = t.panel.where("period = '1997'")
    assert QUERIES["j13_pair_similarity"](spark, sf).first() == peers.pair_similarity(t.edges, then).first()
    score = {r.unit: r.mean_score for r in then.collect() if r.mean_score is not None}
    want = np.mean([abs(score[r.unit] - score[r.peer]) for r in t.edges.collect() if r.unit in score and r.peer in score])
    assert abs(QUERIES["j13_pair_score_difference"](spark, sf).first().mean_score_diff - want) < 1e-8
