"""The registered queries of the review operators, bound to the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import period as P
from ..functions import score as S
from ..functions import text as X
from ..operators import agreement, events, panel, peers, policy, predict, sampling, traveller
from ..operators import snapshot as snap
from ..operators.shared import settled
from ..sources import reviews as R
from ..streaming import panel_stream

Query = Callable[[SparkSession, str], DataFrame]
#: The aspect of the tables at hand that stands for one that nobody can act on.
GIVEN = "STANDARD"
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The tables that queries share, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "supplier"):
        self.spark, self.dir, self.grain, self.kind = spark, sf_dir, grain, "year" if grain == "supplier" else "quarter"
        self.mentions = R.from_star_schema(spark, sf_dir, grain)
        self.aspects = panel.aspects_of(R.table(spark, sf_dir, "part").select("p_type"))
        self.places = R.places(spark, sf_dir, grain)

    @property
    def panel(self) -> DataFrame:
        return panel.dense_panel(self.mentions, self.aspects)

    @property
    def whole(self) -> DataFrame:
        return panel.with_complete(self.panel, self.mentions, self.kind)

    @property
    def actionable(self) -> list[str]:
        return [a for a in self.aspects if a != GIVEN]

    @property
    def names(self) -> DataFrame:
        return R.table(self.spark, self.dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("unit_name"))

    @property
    def edges(self) -> DataFrame:
        return peers.knn(self.places, 10)

    @property
    def snapshot(self) -> DataFrame:
        last = snap.last_complete(panel.complete_periods(self.mentions, self.kind))
        return snap.snapshot(self.panel, self.edges, self.places, last, self.actionable)



    @property
    def shared(self) -> DataFrame:
        """The snapshot for plans that read it several times."""
        return settled(self.snapshot)


def T(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> Tables:
    return Tables(spark, sf_dir, grain)


# Panel

@query
def g01_mention_counts(spark, d):
    return panel.mention_counts(T(spark, d).mentions)


@query
def g02_unit_period_scores(spark, d):
    return panel.unit_periods(T(spark, d).mentions).select("unit", "period", "city", "n_reviews", "n_A", "n_B", F.round("mean_score", 9).alias("mean_score"))


@query
def g03_first_seen(spark, d):
    return panel.first_seen(T(spark, d).mentions)


@query
def g04_period_coverage(spark, d):
    return panel.period_coverage(T(spark, d, "nation").mentions)


@query
def g05_stream_counters(spark, d):
    m = T(spark, d).mentions
    c = lambda x: F.count(F.when(x, 1))
    return m.agg(F.count("*").alias("n"), c(F.col("d").isNull()).alias("no_date"), c(F.col("neg")).alias("negative"), c(~F.col("neg")).alias("positive"), c(F.col("fold") == "A").alias("fold_a"))


@query
def g06_fold_outcomes(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return panel.unit_periods(T(spark, d).mentions).select("unit", "period", r("mean_A"), r("mean_B"), r("mean_score"))


@query
def g07_unit_dimension(spark, d):
    return T(spark, d).places.select("unit", "city", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query
def g08_pivot_nets(spark, d):
    t = T(spark, d)
    wide = t.panel.groupBy("unit", "period").pivot("aspect", t.aspects).agg(F.first(F.when(F.col("has"), F.round("net", 9))))
    return wide.select("unit", "period", *[F.col(f"`{a}`").alias(f"net_{a.lower()}") for a in t.aspects])


@query
def g09_coverage_by_aspect(spark, d):
    return panel.coverage(T(spark, d).panel, "aspect")


@query
def g09_coverage_by_city(spark, d):
    return panel.coverage(T(spark, d).panel, "city")


@query
def g10_prior_sensitivity(spark, d):
    return panel.prior_sensitivity(T(spark, d).panel)


@query
def g18_panel_audit(spark, d):
    t = T(spark, d)
    names = t.mentions.groupBy("unit_name").agg(F.countDistinct("unit").alias("ids")).agg(F.count("*").alias("names"), F.count(F.when(F.col("ids") > 1, 1)).alias("shared_names"))
    return t.panel.agg(F.countDistinct("unit").alias("units"), F.count(F.when(~F.col("has"), 1)).alias("empty_cells"), F.count("*").alias("cells")).join(F.broadcast(names))


@query
def g35_panel_stats(spark, d):
    p = panel.unit_periods(T(spark, d).mentions)
    per = p.groupBy("unit").agg(F.count("*").alias("n"))
    n = per.agg(F.count(F.when(F.col("n") >= 4, 1)).alias("units_with_4"))
    return p.agg(F.round(F.avg("mean_score"), 8).alias("mean"), F.round(F.stddev_samp("mean_score"), 8).alias("sd")).join(F.broadcast(n))


@query
def j04_dense_panel(spark, d):
    return T(spark, d).panel.select("unit", "period", "aspect", "pos", "neg", "total", "has", "raw_net", "net", "rel")


@query
def p01_complete_periods(spark, d):
    a = panel.complete_periods(T(spark, d).mentions, "year")
    return a.unionByName(panel.complete_periods(T(spark, d, "nation").mentions, "quarter"))


@query
def p14_all_measured(spark, d):
    return T(spark, d).panel.groupBy("unit", "period").agg(F.count(F.when(F.col("has"), 1)).alias("measured"), F.bool_and("has").alias("all_measured"))


@query
def p18_measurement_verdict(spark, d):
    t = T(spark, d).panel
    share = F.col("measured").cast("double") / F.col("cells").cast("double")
    return t.agg(F.count("*").alias("cells"), F.count(F.when(F.col("has"), 1)).alias("measured"), F.median("total").alias("median_total")).select("cells", "measured", F.when((share >= 0.9) & (F.col("median_total") >= 10), "STRONG").when(share >= 0.6, "USABLE").otherwise("WEAK").alias("verdict"))


@query
def q14_fold_panel(spark, d):
    p = T(spark, d).panel
    return p.select("unit", "period", "aspect", F.round("net_A", 12).alias("net_a"), F.round("net_B", 12).alias("net_b"), (F.col("pos_A") + F.col("neg_A") > 0).alias("has_a"), (F.col("pos_B") + F.col("neg_B") > 0).alias("has_b"))


@query
def v02_panel_integrity(spark, d):
    t = T(spark, d)
    return panel.integrity(t.panel, t.aspects)


@query
def v05_fold_reconciliation(spark, d):
    t = T(spark, d)
    return panel.fold_reconciliation(panel.unit_periods(t.mentions), t.panel)


@query
def s04_source_audit(spark, d):
    li = R.table(spark, d, "lineitem")
    return li.agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("units"), F.min(F.col("l_shipdate").cast("date")).cast("string").alias("first_day"), F.max(F.col("l_shipdate").cast("date")).cast("string").alias("last_day"), F.count(F.when(F.col("l_quantity").isNull(), 1)).alias("no_score"))


# Scalars

@query
def f01_normalise(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", F.sha1(X.normalise_placeholder(F.col("text")).cast("binary")).alias("h"))


@query
def f02_placeholder(spark, d):
    t = R.table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in ("No Negative", " nothing. ", "N/A", "Great stay", "", "none!;", "All Good")]), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("t"))
    return t.select("o_orderkey", X.is_placeholder(F.col("t"), X.NEGATIVE_PLACEHOLDERS).alias("placeholder"))


GATE = {"the": ["the"], "with": ["with", "and"], "que": ["que"], "und": ["und"]}


@query
def f03_keyword_gate(spark, d):
    t = R.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" near the metro, staff room")).alias("t"))
    return t.select("p_partkey", F.explode(X.gate_aspects(F.col("t"))).alias("aspect")).groupBy("aspect").agg(F.count("*").alias("n"))


@query
def f04_city_country(spark, d):
    n = R.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("1 Main Street "), F.element_at(F.array(*[F.lit(c) for c in ("London", "Utrecht", "Paris")]), F.col("n_nationkey") % 3 + 1), F.lit(" "), F.element_at(F.array(F.lit("United Kingdom"), F.lit("Netherlands"), F.lit("Atlantis")), F.col("n_nationkey") % 2 + 1)).alias("a"))
    city, country = X.parse_city_country(F.col("a"))
    return n.select("n_nationkey", city.alias("city"), country.alias("country"))


@query
def f05_hashed_ids(spark, d):
    return R.table(spark, d, "supplier").select("s_suppkey", X.unit_id(F.col("s_name")).alias("id"), X.unit_id(F.col("s_name"), "d1_europe:", 16).alias("legacy_id"))


@query
def f06_fingerprint(spark, d):
    p = R.table(spark, d, "pages")
    f = X.review_fingerprint(F.col("url"), F.lit("1/2/2017"), F.col("page_id"), F.lit("x"), F.col("url"), F.col("html"))
    return p.select("page_id", f.alias("fingerprint"), X.fold_of(f).alias("fold"))


@query
def f07_fold_split(spark, d):
    return T(spark, d).mentions.groupBy("fold").agg(F.count("*").alias("n"))


@query
def f08_date_parse(spark, d):
    o = R.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("day", "M/d/yyyy")).when(k == 1, F.date_format("day", "yyyy-MM-dd")).when(k == 2, F.concat(F.lit("31/"), F.date_format(F.trunc("day", "year"), "MM/yyyy"))).otherwise("junk")
    return o.select("o_orderkey", P.parse_date(text).cast("string").alias("day"))


@query
def f09_quarter_label(spark, d):
    day = F.col("o_orderdate").cast("date")
    return R.table(spark, d, "orders").groupBy(P.quarter_label(day).alias("quarter"), P.month_label(day).alias("month")).agg(F.count("*").alias("n"))


@query
def f10_quarter_bounds(spark, d):
    q = R.table(spark, d, "orders").select(P.quarter_label(F.col("o_orderdate").cast("date")).alias("quarter")).distinct()
    a, b = P.quarter_bounds(F.col("quarter"))
    return q.select("quarter", a.cast("string").alias("first_day"), b.cast("string").alias("last_day"), P.quarter_ordinal(F.col("quarter")).alias("ord"))


@query
def f12_shrinkage(spark, d):
    p = T(spark, d).panel
    return p.select("unit", "period", "aspect", S.smoothed_net(F.col("pos"), F.col("neg"), 5.0).alias("net5"), S.smoothed_net(F.col("pos"), F.col("neg"), 20.0).alias("net20"), S.reliability(F.col("total"), 5.0).alias("rel5"))


@query
def f15_haversine(spark, d):
    p = T(spark, d).places
    return p.select("unit", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.2082), F.lit(16.3738)), 6).alias("km"), S.valid_coordinates(F.col("lat"), F.col("lon")).alias("ok"))


@query
def f16_url_slug(spark, d):
    return R.table(spark, d, "pages").select("page_id", X.clean_url(F.col("url")).alias("url"), X.url_slug(F.col("url")).alias("slug"))


@query
def f17_formula_guard(spark, d):
    t = R.table(spark, d, "customer").select("c_custkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", " +", "@", "a", "-", "")]), (F.col("c_custkey") % 6 + 1).cast("int")), F.col("c_name")).alias("t"))
    return t.select("c_custkey", X.quote_formula(F.col("t")).alias("t"))


@query
def f18_opaque_ids(spark, d):
    return R.table(spark, d, "supplier").select("s_suppkey", X.opaque_id(F.lit("input"), F.col("s_suppkey")).alias("id"))


@query
def f19_truncation(spark, d):
    return R.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("head"), F.length(F.substring("text", 1, 800)).cast("bigint").alias("n"))


@query
def f21_percentile_rank(spark, d):
    c = R.table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("v"))
    # Counts by value first: a window over values, not rows.
    v = c.groupBy("c_mktsegment", "v").agg(F.count("*").alias("equal"))
    w = W.partitionBy("c_mktsegment").orderBy("v")
    v = v.withColumn("upto", F.sum("equal").over(w)).withColumn("all", F.sum("equal").over(W.partitionBy("c_mktsegment")))
    r = F.lit(100.0) * ((F.col("upto") - F.col("equal")).cast("double") + F.lit(0.5) * F.col("equal").cast("double")) / F.col("all").cast("double")
    return c.join(v.select("c_mktsegment", "v", F.round(r, 9).alias("pct")), ["c_mktsegment", "v"]).select("c_custkey", "pct")


@query
def f22_medians(spark, d):
    return R.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("median"), F.percentile("l_quantity", 0.9).alias("p90"))


@query
def f25_half_even(spark, d):
    return R.table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", F.bround(F.col("p_size").cast("double") * F.lit(0.5)).cast("bigint").alias("half"), "n")


@query
def f28_power_table(spark, d):
    g = R.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"))
    return g.select("l_returnflag", F.round(S.mde(F.lit(0.5), F.col("n"), F.col("n") * 2), 9).alias("mde"), S.required_n(F.lit(0.07), F.lit(0.5)).cast("bigint").alias("n_per_arm"))


@query
def f31_personas(spark, d):
    """Match scores of units for each made-up traveller; the reviews' aspects stand for the tables' in order."""
    t = T(spark, d)
    s = t.shared.withColumn("aspect", F.get(F.array(*[F.lit(a) for a in X.ASPECTS]), F.array_position(F.array(*[F.lit(a) for a in t.aspects]), F.col("aspect")).cast("int") - 1)).where("aspect IS NOT NULL")
    each = [traveller.match_scores(s, {a: float(w) for a, w in p.items()}).select(F.lit(name).alias("persona"), "unit", F.round("score", 9).alias("score"), F.round("coverage", 9).alias("coverage")) for name, p in traveller.PERSONAS.items()]
    return reduce(DataFrame.unionByName, each)


@query
def f32_criticism(spark, d):
    s = T(spark, d).snapshot
    return s.select("unit", "aspect", "neg_mentions", "neg_rate", S.ratio(F.col("neg_mentions"), F.col("n_reviews")).alias("neg_per_review"))


@query
def f34_labels(spark, d):
    c = R.table(spark, d, "part").select("p_partkey", "p_name")
    w = W.partitionBy("p_name")
    return c.select("p_partkey", F.when(F.count("*").over(w) > 1, F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise(F.col("p_name")).alias("label"))


@query
def f36_stratum_key(spark, d):
    return R.table(spark, d, "documents").groupBy(F.concat_ws("|", "lang", "source").alias("stratum")).agg(F.count("*").alias("n"))


@query
def f40_coercion(spark, d):
    e = R.table(spark, d, "events").select(F.expr("substring(props, 6)").alias("t"))
    n = F.regexp_extract("t", r"(\d+)", 1).try_cast("bigint")
    return e.agg(F.count("*").alias("n"), F.count(F.when(n.isNotNull() & (n >= 0), 1)).alias("counts"), F.count(F.when(F.col("t").try_cast("boolean").isNotNull(), 1)).alias("flags"))


@query
def f41_safe_ratio(spark, d):
    e = R.table(spark, d, "events").groupBy(X.normalise_choice(F.concat(F.lit(" "), F.col("event_type"))).alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 1e9, 1)).alias("big"))
    return e.select("kind", "n", S.ratio(F.col("n"), F.col("big")).alias("ratio"))


@query
def f42_json_props(spark, d):
    return R.table(spark, d, "events").groupBy("event_type").agg(F.sum(X.json_int(F.col("props"), "$.k")).cast("bigint").alias("k"), F.count(X.json_int(F.col("props"), "$.none")).alias("none"))


# Peers

@query
def j06_knn_k(spark, d):
    return T(spark, d).edges.select("unit", "peer", F.col("rank").cast("bigint").alias("rank"), F.round("km", 6).alias("km"))


@query
def j07_radius(spark, d):
    return peers.within_radius(T(spark, d).places, 120.0).select("unit", "peer", F.col("rank").cast("bigint").alias("rank"), F.round("km", 6).alias("km"))


@query
def j08_mutual(spark, d):
    return peers.mutual(peers.knn(T(spark, d).places, 5)).select("unit", "peer")


@query
def g14_graph_metrics(spark, d):
    t = T(spark, d)
    return peers.graph_metrics(t.edges, t.places)


@query
def g15_distance_bins(spark, d):
    return peers.distance_bins(T(spark, d).edges)


@query
def g16_histogram(spark, d):
    li = R.table(spark, d, "lineitem")
    ends = li.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    b = F.least(F.lit(29), F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(30.0)).cast("int"))
    return li.join(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row


@query
def g17_top1_stability(spark, d):
    p = T(spark, d).places
    return peers.top1_stability(peers.knn(p, 1), peers.mutual(peers.knn(p, 10)))


@query
def v03_peer_integrity(spark, d):
    t = T(spark, d)
    return peers.integrity(t.edges, t.places)


def _last_panel(t: Tables) -> DataFrame:
    last = snap.last_complete(panel.complete_periods(t.mentions, t.kind))
    return t.panel.where(F.col("period") == last)


@query
def j13_pair_similarity(spark, d):
    t = T(spark, d)
    return peers.pair_similarity(t.edges, _last_panel(t))


@query
def j13_pair_score_difference(spark, d):
    t = T(spark, d)
    return peers.pair_score_difference(t.edges, _last_panel(t))


@query
def j12_delta_correlation(spark, d):
    t = T(spark, d)
    return peers.delta_correlation(t.edges, events.deltas(t.whole).where("has AND prev_has"))


@query
def r01_random_peers(spark, d):
    p = T(spark, d).places
    e = peers.random_peers(p, 5).withColumn("kind", F.lit("local")).unionByName(peers.random_peers(p, 5, local=False).withColumn("kind", F.lit("other")))
    city = p.select(F.col("unit").alias("peer"), F.col("city").alias("pc"))
    per = e.join(city, "peer").groupBy("kind", "unit", "city").agg(F.count("*").alias("n"), F.countDistinct("peer").alias("distinct"), F.count(F.when(F.col("pc") == F.col("city"), 1)).alias("same"))
    return per.groupBy("kind").agg(F.count("*").alias("units"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("same").cast("bigint").alias("same_city"), F.sum(F.col("n") - F.col("distinct")).cast("bigint").alias("repeats"))


# Snapshot and policies

@query
def q01_snapshot(spark, d):
    return T(spark, d).snapshot.select("unit", "aspect", "has", F.round("net", 9).alias("net"), "mentions", "peer_count", "peer_n", F.round("peer_median", 9).alias("peer_median"), F.round("gap", 9).alias("gap"), F.round("percentile", 9).alias("percentile"), F.round("weak_share", 9).alias("weak_share"), "eligible", "ineligible_reason")


@query
def q01_documents(spark, d):
    docs = snap.documents(T(spark, d).snapshot)
    return docs.select("unit", F.to_json("aspects").alias("aspects"))


@query
def g19_counters(spark, d):
    return snap.counters(T(spark, d).snapshot)


@query
def p08_eligibility(spark, d):
    return T(spark, d, "nation").snapshot.select("unit", "city", "eligible", "ineligible_reason", "peer_count").distinct()


@query
def p02_gate_reasons(spark, d):
    return policy.gate_reasons(T(spark, d).snapshot)


def _policy(name: str, f, key: str = "score", **options) -> None:
    def q(spark, d):
        return f(T(spark, d).snapshot, **options).select("unit", "aspect", F.round(key, 9).alias("score"))

    q.__name__ = name
    query(q)


_policy("q03_fix_weakest", policy.fix_weakest)
_policy("q04_largest_gap", policy.largest_gap)
_policy("q05_most_criticised", policy.most_criticised)
_policy("q06_peer_relative", policy.peer_relative)
_policy("q06_crowding_scenario", policy.peer_relative, intensity=0.5)
_policy("q07_reliability_aware", policy.reliability_aware)
_policy("q11_value_aware", policy.value_aware, value={"ECONOMY": 2.0, "PROMO": 0.5, "SMALL": -1.0, "LARGE": 1.0, "MEDIUM": 1.0})


@query
def q06_abstention(spark, d):
    s = T(spark, d).shared
    return policy.abstention(s, policy.peer_relative(s)).groupBy("reason").agg(F.count("*").alias("n"))


@query
def q09_diagnosis_vs_action(spark, d):
    return policy.action_against_diagnosis(T(spark, d).snapshot)


@query
def q10_all_policies(spark, d):
    return policy.all_policies(T(spark, d).snapshot).select("unit", "strategy", "aspect", F.round("score", 9).alias("score"))


@query
def q13_weight_grid_choices(spark, d):
    return policy.grid_choices(T(spark, d).snapshot)


@query
def o03_ranking(spark, d):
    return policy.ranking(T(spark, d).snapshot, 0.25).select("unit", "aspect", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def g20_policy_coverage(spark, d):
    s = T(spark, d).shared
    return policy.coverage(s, policy.all_policies(s))


@query
def g21_pairwise_agreement(spark, d):
    return policy.agreement(policy.all_policies(T(spark, d).snapshot))


@query
def g22_policy_shares(spark, d):
    return policy.shares(policy.all_policies(T(spark, d).snapshot))


@query
def p21_choice_audit(spark, d):
    s = T(spark, d).shared
    return policy.audit(s, policy.all_policies(s))


# Traveller and simulation

WEIGHTS = {"ECONOMY": 2.0, "PROMO": 1.0, "STANDARD": 1.0, "LARGE": 0.5}


@query
def q17_match_score(spark, d):
    t = T(spark, d)
    return traveller.match_scores(t.snapshot, traveller.checked_weights(WEIGHTS, t.aspects)).select("unit", F.round("score", 9).alias("score"), F.round("coverage", 9).alias("coverage"))


@query
def q17_contributions(spark, d):
    return traveller.contributions(T(spark, d).snapshot, WEIGHTS).select("unit", "aspect", F.round("part", 9).alias("part"))


@query
def q18_city_ranking(spark, d):
    t = T(spark, d)
    return traveller.city_ranking(traveller.match_scores(t.snapshot, WEIGHTS), t.names)


@query
def q18_rank_change(spark, d):
    """Ranks before and after the first unit of each city that has a recommendation follows it."""
    t = T(spark, d)
    s = t.shared
    chosen = policy.peer_relative(s).join(s.select("unit", "city").distinct(), "unit").groupBy("city").agg(F.min(F.struct("unit", "aspect")).alias("c")).select("c.unit", "c.aspect")
    changed = traveller.improved(s.join(chosen.select("unit"), "unit", "left_semi"), chosen, 0.5)
    return traveller.rank_change(s, WEIGHTS, changed, t.names)


@query
def q19_improve(spark, d):
    return traveller.improve(T(spark, d).snapshot, 0.3).select("unit", "aspect", "flips", F.round("after", 9).alias("after"), F.round("gap_after", 9).alias("gap_after"))


@query
def q21_outcome(spark, d):
    return traveller.outcomes(T(spark, d).snapshot, 0.3)


@query
def q22_compare_actions(spark, d):
    return traveller.compare_actions(T(spark, d).shared, 0.3).drop("city", "net").withColumn("rank", F.col("rank").cast("bigint"))


@query
def q23_follow_rounds(spark, d):
    return traveller.follow(T(spark, d).snapshot, 0.3, 3).withColumn("round", F.col("round").cast("bigint"))


@query
def q24_city_experiment(spark, d):
    return traveller.city_experiment(T(spark, d).shared, 0.3)


@query
def g36_balance(spark, d):
    return traveller.balance(T(spark, d).snapshot)


@query
def f38_radar_scenario(spark, d):
    return traveller.radar(T(spark, d).snapshot, 0.5).select("unit", "aspect", F.round("net", 9).alias("net"))


@query
def w11_strongest_weakest(spark, d):
    t = T(spark, d)
    return traveller.strongest_and_weakest(t.snapshot, WEIGHTS, t.aspects)


@query
def q20_record_simulation(spark, d):
    """Mentions made from the counts, improved one by one and counted again: the counts that improving the counts gives."""
    s = T(spark, d).shared
    chosen = policy.peer_relative(s)
    counted = traveller.from_records(traveller.improve_records(traveller.mention_records(s), chosen, 0.3))
    return counted.select("unit", "aspect", "pos_mentions", "neg_mentions", F.round("net", 9).alias("net"))


@query
def q10_evidence(spark, d):
    s = T(spark, d).shared
    e = policy.evidence(s, policy.all_policies(s))
    return e.select("unit", "strategy", "aspect", "mentions", "neg_mentions", "peer_n", "candidates", F.round("gap", 9).alias("gap"), F.round("percentile", 9).alias("percentile"))


@query
def u05_reference_counters(spark, d):
    t = T(spark, d)
    last = snap.last_complete(panel.complete_periods(t.mentions, t.kind))
    broken = t.edges.select("unit", "peer", "rank").unionByName(t.edges.where("rank = 1").select("unit", F.col("unit").alias("peer"), "rank")).unionByName(t.edges.where("rank = 2").select("unit", "peer", "rank")).unionByName(t.edges.where("rank = 3").select("unit", (-F.col("peer")).alias("peer"), "rank"))
    return snap.reference_counters(broken, snap.records(t.panel, last))


# Events: nations by quarter

@query
def w05_deltas(spark, d):
    return events.deltas(T(spark, d, "nation").panel).select("unit", "aspect", "period", F.round("delta", 9).alias("delta"))


@query
def e01_legacy_events(spark, d):
    return events.permissive_events(T(spark, d, "nation").panel).select("unit", "aspect", "period", F.round("delta", 9).alias("delta"), "total")


@query
def e01_exposure(spark, d):
    t = T(spark, d, "nation")
    e = events.exposure(events.permissive_events(t.panel), t.edges, events.deltas(t.panel))
    return e.select("unit", "aspect", "period", "known", "improving", F.round("exposure", 9).alias("exposure"))


@query
def e02_strict_prefilter(spark, d):
    return events.strict_candidates(T(spark, d, "nation").whole, immutable=GIVEN).select("unit", "aspect", "period", F.round("delta", 9).alias("delta"), "total")


@query
def e02_strict_full(spark, d):
    t = T(spark, d, "nation")
    return events.strict_events(t.whole, t.edges, peers=2, p=0.8, immutable=GIVEN).select("unit", "aspect", "period", "known", "improving", F.round("p_rise", 6).alias("p_rise"))


@query
def e03_strict_run(spark, d):
    """Events of both halves, of all and of the aspect that nobody acts on."""
    t = T(spark, d, "nation")
    run = events.strict_run(settled(t.whole), t.edges, GIVEN, peers=2, p=0.8)
    return run.groupBy("set", "aspect").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"), F.count(F.when(F.col("exposure") > 0, 1)).alias("exposed"), F.count(F.when(F.col("around"), 1)).alias("around"))


@query
def p17_strict_verdict(spark, d):
    t = T(spark, d, "nation")
    found = events.strict_verdict(events.strict_run(settled(t.whole), t.edges, GIVEN, peers=2, p=0.8))
    return found.withColumn("around", F.round("around", 9))


@query
def e09_strict_grid(spark, d):
    t = T(spark, d, "nation")
    return events.strict_grid(settled(t.whole), settled(peers.knn(t.places, 20)), peers=2, p=0.8, immutable=GIVEN)


@query
def e06_persistent_jumps(spark, d):
    return events.persistent_events(events.cells(T(spark, d, "nation").whole), 0.2).select("unit", "aspect", "period", "jump", "stay")


@query
def e06_persistent_drops(spark, d):
    return events.persistent_events(events.cells(T(spark, d, "nation").whole), 0.2, sign=-1).select("unit", "aspect", "period", "jump", "stay")


@query
def g30_inventory(spark, d):
    return events.inventory(events.permissive_events(T(spark, d, "nation").panel))


@query
def w09_cooldown(spark, d):
    return events.cooldown(events.permissive_events(T(spark, d, "nation").panel)).groupBy("aspect").agg(F.count("*").alias("n"))


@query
def j15_control_pool(spark, d):
    t = T(spark, d, "nation")
    return events.control_pool(events.permissive_events(t.panel), t.panel).groupBy("unit", "aspect", "ord").agg(F.count("*").alias("controls"))


@query
def j16_matching(spark, d):
    t = T(spark, d, "nation")
    return events.match(events.control_pool(events.permissive_events(t.panel), t.panel)).select("unit", "aspect", "ord", "control", F.round("distance", 9).alias("distance"))


@query
def g26_event_time_means(spark, d):
    t = T(spark, d, "nation")
    pool = events.control_pool(events.permissive_events(t.panel), t.panel)
    return events.event_means(events.match(pool), t.panel)


@query
def p16_feasibility_gate(spark, d):
    t = T(spark, d, "nation")
    return events.feasibility(events.permissive_events(t.panel), t.panel)


@query
def m15_specificity(spark, d):
    c = events.cells(T(spark, d, "nation").whole)
    return events.specificity(c, events.persistent_events(c, 0.2))


@query
def e09_robustness_grid(spark, d):
    """Counts of permissive events over a grid of thresholds and mention floors."""
    t = T(spark, d, "nation")
    moved = events.permissive_events(t.panel, 0.1, 3)
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("threshold"), F.lit(b).alias("floor")) for a in (0.1, 0.15, 0.2) for b in (3, 5, 10)]))
    return moved.withColumn("g", grid).where("delta >= g.threshold AND total >= g.floor").groupBy("g.threshold", "g.floor").agg(F.count("*").alias("n"))


# Windows, prediction and estimators

@query
def w01_score_lags(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return predict.score_lags(panel.unit_periods(T(spark, d).mentions)).select("unit", "period", r("lag1"), r("lag2"), r("trend"), r("y_next"), "contiguous")


@query
def w03_contiguous_delta(spark, d):
    return events.deltas(T(spark, d).panel).where("has AND prev_has").groupBy("aspect", "period").agg(F.count("*").alias("n"), F.count(F.when(F.col("delta") > 0, 1)).alias("rises"))


@query
def w07_demeaned(spark, d):
    return predict.demeaned(T(spark, d).panel)


@query
def w08_leave_one_out(spark, d):
    return predict.leave_one_out(T(spark, d).panel)


@query
def d10_feature_frame(spark, d):
    t = T(spark, d)
    f = predict.features(t.panel, panel.unit_periods(t.mentions), t.aspects)
    return f.select("unit", "period", *[F.round(f"net_{a}", 9).alias(f"net_{a.lower()}") for a in t.aspects], F.col("miss_PROMO").alias("miss_promo"), F.round("volume", 9).alias("volume"))


@query
def g25_baseline_mae(spark, d):
    return predict.baselines(predict.score_lags(panel.unit_periods(T(spark, d).mentions)), 1998)


@query
def g28_delta_median(spark, d):
    return predict.median_rise(events.deltas(T(spark, d).panel).where("has AND prev_has"))


@query
def m07_cluster_mean(spark, d):
    return predict.cluster_mean(R.table(spark, d, "lineitem"), "l_quantity", "l_suppkey")


@query
def m02_ridge_fit(spark, d):
    t = T(spark, d)
    f = predict.features(t.panel, panel.unit_periods(t.mentions), t.aspects).where("y_next IS NOT NULL")
    x = ["y", "lag1", "volume", *[f"net_{a}" for a in t.aspects]]
    return predict.fitted(f.where("ord <= 1997"), f.where("ord = 1998"), f.where("ord > 1998"), x, "y_next")


def _changes(t: Tables) -> DataFrame:
    m = events.deltas(t.whole).where("has AND prev_has")
    s = predict.score_lags(panel.unit_periods(t.mentions)).where("contiguous").select("unit", "ord", F.col("trend").alias("dy"))
    return m.join(s, ["unit", "ord"])


@query
def m06_fe_ols(spark, d):
    return predict.fixed_effects(_changes(T(spark, d)), "dy", ["delta"], ["unit", "aspect"], "ord", "unit")


@query
def m14_event_did(spark, d):
    t = T(spark, d, "nation")
    s = predict.score_lags(panel.unit_periods(t.mentions)).where("contiguous").select("unit", "ord", F.col("trend").alias("dy"))
    return predict.did(s, events.persistent_events(events.cells(t.whole), 0.2))


@query
def r11_cluster_bootstrap(spark, d):
    return sampling.cluster_bootstrap(R.table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


# Quality and sampling

def _labels(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 1500).cast("int").alias("long_text"))
    return R.table(spark, d, "labels").select("doc_id", "quality", "toxic").join(docs, "doc_id")


@query
def g31_kappa(spark, d):
    return agreement.kappa(_labels(spark, d), "quality", "long_text")


@query
def g32_f1(spark, d):
    return agreement.precision_recall(_labels(spark, d), "quality", "long_text")


@query
def g33_grouped_agreement(spark, d):
    return agreement.by_group(_labels(spark, d), "quality", "long_text", ["lang"])


@query
def r05_stratified_sample(spark, d):
    s = sampling.stratified(R.table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)
    return s.groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("population").alias("population"))


@query
def r06_first_then_cut(spark, d):
    return sampling.first_then_cut(R.table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 5, 100).select("doc_id", "lang")


@query
def r04_permutation(spark, d):
    c = sampling.permuted(R.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_nationkey", ["c_mktsegment"], "c_custkey")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_nationkey_perm").cast("bigint").alias("s"))


@query
def r14_group_folds(spark, d):
    c = R.table(spark, d, "lineitem").select("l_suppkey").withColumn("fold", sampling.group_fold("l_suppkey", 5))
    per = c.groupBy("l_suppkey").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("units"), F.max("folds").alias("most_folds"), F.sum("n").cast("bigint").alias("n"))


@query
def x01_stream_counts(spark, d):
    e = panel_stream.window_counts(R.table(spark, d, "events"))
    return e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


# Relations between tables

@query
def j03_order_reconciliation(spark, d):
    line = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    both = R.table(spark, d, "orders").select("o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    c = lambda x: F.count(F.when(x, 1))
    return both.agg(c(F.col("o_orderkey").isNotNull() & F.col("l_orderkey").isNotNull()).alias("both"), c(F.col("l_orderkey").isNull()).alias("orders_only"), c(F.col("o_orderkey").isNull()).alias("lines_only"), F.sum("lines").cast("bigint").alias("lines"))


@query
def j14_semi_anti(spark, d):
    o, c = R.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), R.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    with_orders = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("with"))
    return with_orders.unionByName(c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("without")))


@query
def u02_set_operations(spark, d):
    li = R.table(spark, d, "lineitem")
    a, b = li.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey"), li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey")
    parts = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct()}
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).withColumn("op", F.lit(k)) for k, x in parts.items()])


@query
def o02_top_units(spark, d):
    return T(spark, d).mentions.groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(10)


@query
def g01_review_flagship(spark, d):
    """Weakest aspect of each unit in the last complete period."""
    return policy.fix_weakest(T(spark, d).snapshot).select("unit", "aspect", F.round("score", 9).alias("score"))
