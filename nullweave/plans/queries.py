"""Queries over networks from the driver's tables, one or more per operator, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.laws import Law, uniform
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..operators import filter as FO
from ..operators import fit as FIT
from ..operators import pairs as P
from ..operators import sample as SMP
from ..operators import stats as ST
from ..operators import synthetic as SY
from ..schema import Constraint, Ensemble, Family, normalize_edges
from . import networks as N
from .router import filter_model, fit_model, sample_model

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The networks in SQL.
OD = "(SELECT CAST(c_nationkey AS BIGINT) AS source, CAST(s_nationkey AS BIGINT) AS target, COUNT(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
ODQ = "(SELECT CAST(c_nationkey AS BIGINT) AS source, CAST(s_nationkey AS BIGINT) AS target, COUNT(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' AND l_returnflag = 'R' AND c_nationkey <> s_nationkey GROUP BY 1, 2)"
SEQ = "(SELECT source, target, COUNT(*) AS weight FROM (SELECT user_id AS source, LEAD(user_id) OVER (ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2)"
CS = "(SELECT o_custkey AS source, l_suppkey + (SELECT MAX(c_custkey) + 1 FROM customer) AS target, COUNT(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _base(net: str) -> str:
    """CTEs e (edges), n (node universe), s (strengths and degrees)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED {net},
n AS (SELECT UNNEST(range(0, (SELECT MAX(GREATEST(source, target)) + 1 FROM e))) AS node),
so AS (SELECT source AS node, SUM(weight) AS s, COUNT(*) AS k, SUM(CAST(weight AS DOUBLE) * weight) AS q FROM e GROUP BY 1),
si AS (SELECT target AS node, SUM(weight) AS s, COUNT(*) AS k, SUM(CAST(weight AS DOUBLE) * weight) AS q FROM e GROUP BY 1),
s AS MATERIALIZED (SELECT n.node, CAST(COALESCE(so.s, 0) AS BIGINT) AS s_out, CAST(COALESCE(si.s, 0) AS BIGINT) AS s_in, CAST(COALESCE(so.k, 0) AS BIGINT) AS k_out, CAST(COALESCE(si.k, 0) AS BIGINT) AS k_in, COALESCE(so.q, 0) AS q_out, COALESCE(si.q, 0) AS q_in
 FROM n LEFT JOIN so ON n.node = so.node LEFT JOIN si ON n.node = si.node),
t AS (SELECT SUM(weight) AS total, COUNT(*) AS edges FROM e)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- networks, statistics -------------------------------------------------


@query(f"SELECT * FROM {OD}")
def od_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nation_od(spark, sf_dir)


@query(f"SELECT * FROM {SEQ}")
def seq_edges(spark, sf_dir):
    return N.user_seq(spark, sf_dir)


@query(f"SELECT * FROM {CS}")
def cust_supp_edges(spark, sf_dir):
    return N.cust_supp(spark, sf_dir)


@query(_base(SEQ) + " SELECT node, s_out AS \"out\", s_in AS incoming FROM s")
def strengths(spark, sf_dir):
    return ST.directed_strengths(N.user_seq(spark, sf_dir))


@query(_base(CS) + " SELECT node, k_out AS \"out\", k_in AS incoming FROM s")
def degrees(spark, sf_dir):
    return ST.directed_degrees(N.cust_supp(spark, sf_dir))


@query(
    _base(SEQ)
    + """, f AS (SELECT e.source, e.target, e.weight, ts.s_in AS ts, ts.k_in AS tk, ss.s_out AS ss, ss.k_out AS sk FROM e JOIN s ts ON e.target = ts.node JOIN s ss ON e.source = ss.node),
fo AS (SELECT source AS node, SUM(CAST(weight AS DOUBLE) * ts) AS a, SUM(CAST(tk AS DOUBLE)) AS b FROM f GROUP BY 1),
fi AS (SELECT target AS node, SUM(CAST(weight AS DOUBLE) * ss) AS a, SUM(CAST(sk AS DOUBLE)) AS b FROM f GROUP BY 1)
SELECT s.node, s_out AS strength_out, s_in AS strength_in, k_out AS degree_out, k_in AS degree_in,
ROUND(CASE WHEN s_out > 0 THEN q_out / (CAST(s_out AS DOUBLE) * s_out) ELSE 0.0 END, 8) AS y2_out, ROUND(CASE WHEN s_in > 0 THEN q_in / (CAST(s_in AS DOUBLE) * s_in) ELSE 0.0 END, 8) AS y2_in,
ROUND(CASE WHEN s_out > 0 THEN fo.a / s_out ELSE 0.0 END, 6) AS s_nn_out, ROUND(CASE WHEN s_in > 0 THEN fi.a / s_in ELSE 0.0 END, 6) AS s_nn_in,
ROUND(CASE WHEN k_out > 0 THEN fo.b / k_out ELSE 0.0 END, 6) AS k_nn_out, ROUND(CASE WHEN k_in > 0 THEN fi.b / k_in ELSE 0.0 END, 6) AS k_nn_in
FROM s LEFT JOIN fo ON s.node = fo.node LEFT JOIN fi ON s.node = fi.node"""
)
def node_stats(spark, sf_dir):
    got = ST.node_stats(N.user_seq(spark, sf_dir))
    return _round(_round(got, 8, "y2_out", "y2_in"), 6, "s_nn_out", "s_nn_in", "k_nn_out", "k_nn_in")


@query(f"SELECT weight, COUNT(*) AS count FROM {SEQ} GROUP BY 1")
def weight_hist(spark, sf_dir):
    return ST.weight_distribution(N.user_seq(spark, sf_dir))


@query(
    f"SELECT COUNT(*) AS num_edges, CAST(SUM(weight) AS BIGINT) AS total_events, CAST(MAX(GREATEST(source, target)) + 1 AS BIGINT) AS nodes, CAST(MAX(weight) AS BIGINT) AS max_weight, ROUND(AVG(weight), 8) AS mean_weight, BOOL_OR(weight > 1) AS weighted, BOOL_OR(source = target) AS self_loops FROM {SEQ}"
)
def totals(spark, sf_dir):
    return _round(ST.totals(N.user_seq(spark, sf_dir)), 8, "mean_weight")


_UND = ", u AS MATERIALIZED (SELECT a, b, MAX(weight) AS weight FROM (SELECT source AS a, target AS b, weight FROM e UNION ALL SELECT target, source, weight FROM e) GROUP BY 1, 2), d AS (SELECT a AS node, COUNT(*) AS k, SUM(weight) AS sw FROM u GROUP BY 1), tri AS (SELECT x.a AS node, COUNT(*) AS c, SUM(x.weight + y.weight) AS w FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)"


@query(_base(SEQ) + _UND + " SELECT n.node, ROUND(CASE WHEN k > 1 THEN COALESCE(c, 0) * 2.0 / (k * (k - 1)) ELSE 0.0 END, 8) AS value FROM n LEFT JOIN d ON n.node = d.node LEFT JOIN tri ON n.node = tri.node")
def clustering(spark, sf_dir):
    return _round(ST.clustering(N.user_seq(spark, sf_dir)), 8, "value")


@query(_base(SEQ) + _UND + " SELECT n.node, ROUND(CASE WHEN k > 1 AND sw > 0 THEN COALESCE(w, 0) / (2.0 * sw * (k - 1)) ELSE 0.0 END, 8) AS value FROM n LEFT JOIN d ON n.node = d.node LEFT JOIN tri ON n.node = tri.node")
def wclustering(spark, sf_dir):
    return _round(ST.weighted_clustering(N.user_seq(spark, sf_dir)), 8, "value")


@query(f"SELECT COUNT(*) AS pairs FROM (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM {SEQ} UNION ALL SELECT target, source FROM {SEQ}))")
def undirected_distinct(spark, sf_dir):
    return ST.undirected(N.user_seq(spark, sf_dir)).agg(F.count("*").alias("pairs"))


_DIST = "SQRT((source % 5 - target % 5) * (source % 5 - target % 5) + (source // 5 - target // 5) * (source // 5 - target // 5))"


def _grid5(spark) -> DataFrame:
    return N.grid_nodes(spark.range(25).withColumnRenamed("id", "node"), 5)


@query(f"SELECT ROUND(SUM(weight * {_DIST}), 4) AS cost FROM {OD}")
def total_cost(spark, sf_dir):
    return _round(ST.total_cost(N.nation_od(spark, sf_dir), _grid5(spark)), 4, "cost")


@query(f"SELECT source, target, weight, ROUND({_DIST}, 8) AS distance FROM {OD}")
def pair_distance(spark, sf_dir):
    return _round(ST.with_coordinates(N.nation_od(spark, sf_dir), _grid5(spark)), 8, "distance").select("source", "target", "weight", "distance")


@query(f"SELECT source, target, weight, CAST(COALESCE(SUM(weight) OVER (PARTITION BY source ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {SEQ}")
def running_mass(spark, sf_dir):
    return ST.running_total(N.user_seq(spark, sf_dir))


# --- projections, predicates, limits --------------------------------------


@query("SELECT l_orderkey AS source, l_suppkey AS target, CAST(l_quantity AS BIGINT) AS weight FROM lineitem WHERE l_quantity > 0")
def normalize(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return normalize_edges(lines.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").alias("weight")))


@query("SELECT l_orderkey AS source, l_suppkey AS target, CAST(SUM(l_quantity) AS BIGINT) AS weight FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2")
def coalesced(spark, sf_dir):
    from ..schema import coalesce_edges

    return coalesce_edges(normalize(spark, sf_dir))


@query(f"SELECT source, target, CAST(weight AS DOUBLE) AS rate FROM {SEQ} ORDER BY weight DESC, source, target LIMIT (SELECT CAST(ROUND(0.05 * COUNT(*)) AS BIGINT) FROM {SEQ})")
def topk_known(spark, sf_dir):
    return SY.top_pairs(N.user_seq(spark, sf_dir), 0.05)


@query(f"SELECT source, target, weight, weight > 2 AS frozen FROM {SEQ}")
def cutoff_split(spark, sf_dir):
    return N.user_seq(spark, sf_dir).withColumn("frozen", F.col("weight") > 2)


@query("SELECT COUNT(*) AS pairs FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def candidates_noself(spark, sf_dir):
    fit = _me(spark, N.nation_od_q(spark, sf_dir), self_loops=False)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    from dataclasses import replace

    import numpy as np

    return P.candidates(spark, replace(fit, x=np.ones(n), y=np.ones(n))).agg(F.count("*").alias("pairs"))


# --- fits with closed forms, filters --------------------------------------


def _me(spark, edges, self_loops=True):
    own = ST.constraints_of(edges)
    return fit_model(family=Family.ME, constraint=Constraint.STRENGTH, strength_out=own["strength_out"], strength_in=own["strength_in"], self_loops=self_loops, spark=spark)


@query(_base(SEQ) + " SELECT node, ROUND(s_out / SQRT(total), 8) AS x, ROUND(s_in / SQRT(total), 8) AS y FROM s, t")
def fit_me_strength(spark, sf_dir):
    return _round(FIT.strength_multipliers(N.user_seq(spark, sf_dir)), 8, "x", "y")


@query(_base(OD) + " SELECT a.node AS source, b.node AS target, ROUND(CAST(a.s_out AS DOUBLE) * b.s_in / total, 6) AS expected, ROUND(1 - EXP(-(CAST(a.s_out AS DOUBLE) * b.s_in / total)), 8) AS occupation FROM s a, s b, t WHERE a.s_out > 0 AND b.s_in > 0")
def expected_me(spark, sf_dir):
    got = P.expectations(spark, _me(spark, N.nation_od(spark, sf_dir)))
    return _round(_round(got, 6, "expected"), 8, "occupation")


# conditional Poisson p-values of observed edges: r = s_out s_in / T, CDF by logarithms
_SCORED = (
    ", r AS (SELECT e.source, e.target, e.weight, CAST(a.s_out AS DOUBLE) * b.s_in / total AS r FROM e JOIN s a ON e.source = a.node JOIN s b ON e.target = b.node, t),"
    " c AS (SELECT *, LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight + 1), lambda k: EXP(k * LN(r) - r - LGAMMA(k + 1))))) AS lo, LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight), lambda k: EXP(k * LN(r) - r - LGAMMA(k + 1))))) AS below, 1 - EXP(-r) AS occ FROM r),"
    " p AS MATERIALIZED (SELECT source, target, weight, LEAST(GREATEST(1 - below, 0) / occ, 1) AS up, LEAST(GREATEST((lo - (1 - occ)) / occ, 0), 1) AS low, r AS expected, occ FROM c)"
)
_P = "source, target, weight, ROUND(up, 6) AS upper_pvalue, ROUND(low, 6) AS lower_pvalue, ROUND(expected, 6) AS expected, ROUND(occ, 6) AS occupation"


def _rounded(df: DataFrame) -> DataFrame:
    return _round(df, 6, "upper_pvalue", "lower_pvalue", "expected", "occupation").drop("is_absent")


@query(_base(OD) + _SCORED + f" SELECT {_P}, up < 0.05 AS is_upper, FALSE AS is_lower, NOT up < 0.05 AS compatible FROM p")
def filter_me_upper(spark, sf_dir):
    return _rounded(filter_model(N.nation_od(spark, sf_dir), alpha=0.05, tail="upper"))


@query(_base(OD) + _SCORED + f" SELECT {_P}, FALSE AS is_upper, low < 0.05 AS is_lower, NOT low < 0.05 AS compatible FROM p")
def filter_me_lower(spark, sf_dir):
    return _rounded(filter_model(N.nation_od(spark, sf_dir), alpha=0.05, tail="lower"))


@query(_base(SEQ) + _SCORED + f" SELECT {_P}, up < 0.025 AS is_upper, low < 0.025 AS is_lower, NOT (up < 0.025 OR low < 0.025) AS compatible FROM p")
def filter_me_two_sided(spark, sf_dir):
    return _rounded(filter_model(N.user_seq(spark, sf_dir), alpha=0.05))


@query(_base(SEQ) + _SCORED + f" SELECT {_P}, up < 0.25 / (2 * edges) AS is_upper, low < 0.25 / (2 * edges) AS is_lower, NOT (up < 0.25 / (2 * edges) OR low < 0.25 / (2 * edges)) AS compatible FROM p, t")
def filter_bonferroni(spark, sf_dir):
    return _rounded(filter_model(N.user_seq(spark, sf_dir), alpha=0.5, correction="bonferroni"))


@query(
    _base(OD)
    + _SCORED
    + """, o AS (SELECT *, RANK() OVER (ORDER BY up) + COUNT(*) OVER (PARTITION BY up) - 1 AS ru, RANK() OVER (ORDER BY low) + COUNT(*) OVER (PARTITION BY low) - 1 AS rl FROM p),
k AS (SELECT MAX(up) FILTER (WHERE up <= 0.1 * ru / edges) AS cu, MAX(low) FILTER (WHERE low <= 0.1 * rl / edges) AS cl FROM o, t),
m AS (SELECT o.*, COALESCE(up <= cu, FALSE) AS is_upper, COALESCE(low <= cl, FALSE) AS is_lower FROM o, k)
"""
    + f" SELECT {_P}, is_upper, is_lower, NOT (is_upper OR is_lower) AS compatible FROM m"
)
def filter_fdr(spark, sf_dir):
    return _rounded(filter_model(N.nation_od(spark, sf_dir), alpha=0.2, correction="fdr"))


@query(
    _base(SEQ)
    + ", r AS (SELECT a.node AS source, b.node AS target, CAST(a.s_out AS DOUBLE) * b.s_in / total AS r FROM s a, s b, t WHERE a.s_out > 0 AND b.s_in > 0)"
    + " SELECT source, target, ROUND(r, 6) AS expected, ROUND(EXP(-r), 6) AS lower_pvalue FROM r WHERE 1 - EXP(-r) >= 0.3 AND EXP(-r) < 0.7 AND NOT EXISTS (SELECT 1 FROM e WHERE e.source = r.source AND e.target = r.target)"
)
def absent_me(spark, sf_dir):
    edges = N.user_seq(spark, sf_dir)
    fit = _me(spark, edges)
    got = FO.absent(P.candidates(spark, fit), P.law(fit), edges, 0.7, min_occupation=0.3)
    return _round(got, 6, "expected", "lower_pvalue").select("source", "target", "expected", "lower_pvalue")


@query(ORACLE["absent_me"] + " ORDER BY source, target LIMIT 20")
def absent_limit(spark, sf_dir):
    """The max_absent option: the first pairs in row order."""
    edges = N.user_seq(spark, sf_dir)
    fit = _me(spark, edges)
    got = FO.absent(P.candidates(spark, fit), P.law(fit), edges, 0.7, min_occupation=0.3, max_absent=20)
    return _round(got, 6, "expected", "lower_pvalue").select("source", "target", "expected", "lower_pvalue")


@query(
    _base(SEQ)
    + ", r AS (SELECT source, target, weight, CASE WHEN (source + target) % 3 = 0 THEN 0.0 ELSE 0.5 + (source * 7 + target) % 5 END AS r FROM e),"
    " c AS (SELECT *, CASE WHEN r > 0 THEN LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight + 1), lambda k: EXP(k * LN(r) - r - LGAMMA(k + 1))))) ELSE 1 END AS lo, CASE WHEN r > 0 THEN LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight), lambda k: EXP(k * LN(r) - r - LGAMMA(k + 1))))) ELSE 1 END AS below, 1 - EXP(-r) AS occ FROM (SELECT source, target, weight, CAST(r AS DOUBLE) AS r FROM r)),"
    " p AS (SELECT source, target, weight, CASE WHEN r > 0 THEN LEAST(GREATEST(1 - below, 0) / occ, 1) ELSE 1 END AS up, CASE WHEN r > 0 THEN LEAST(GREATEST((lo - (1 - occ)) / occ, 0), 1) ELSE 1 END AS low, r AS expected, occ FROM c)"
    f" SELECT {_P}, up < 0.05 AS is_upper, FALSE AS is_lower, NOT up < 0.05 AS compatible FROM p"
)
def filter_custom_rates(spark, sf_dir):
    edges = N.user_seq(spark, sf_dir)
    rates = edges.where("(source + target) % 3 <> 0").select("source", "target", (F.lit(0.5) + (F.col("source") * 7 + F.col("target")) % 5).alias("rate"))
    return _rounded(filter_model(edges, rates=rates, alpha=0.05, tail="upper"))


@query(f"SELECT source, target, ROUND(1000.0 * weight / (SELECT SUM(weight) FROM {SEQ}), 8) AS rate FROM {SEQ}")
def custom_rate_normalise(spark, sf_dir):
    edges = N.user_seq(spark, sf_dir).select("source", "target", F.col("weight").cast("double").alias("probability"))
    return _round(P.normalised_rates(edges, 1000.0), 8, "rate")


@query(f"SELECT a.source, a.target FROM {SEQ} a WHERE a.weight = 1 EXCEPT SELECT b.target, b.source FROM {SEQ} b")
def absent_pairs(spark, sf_dir):
    edges = N.user_seq(spark, sf_dir)
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.where("weight = 1").select("source", "target").join(back, ["source", "target"], "left_anti").distinct()


# --- pair laws ------------------------------------------------------------

_GRID = "(SELECT q / 10.0 AS q, w, m FROM range(1, 10) a(q), range(0, 12) b(w), (SELECT UNNEST([1, 3, 8]) AS m) c)"


def _law_query(family: Family, term: str):
    """P(t <= w), P(t >= w) over a grid of rates, weights and layers against a direct sum of `term`(k)."""

    def run(spark, sf_dir):
        grid = spark.range(1, 10).withColumn("q", F.col("id") / 10.0).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(11)))).drop("id")
        parts = []
        for m in (1, 3, 8):
            law = Law(family, m, F.col("q"))
            w = F.col("w").cast("bigint")
            parts.append(grid.select("q", w.alias("w"), F.lit(m).cast("bigint").alias("m"), F.round(law.lower(w), 8).alias("lower"), F.round(law.upper(w), 8).alias("upper"), F.round(law.expected(), 8).alias("expected"), F.round(law.occupation(), 8).alias("occupation")))
        return parts[0].union(parts[1]).union(parts[2])

    mean, empty = {
        Family.ME: ("q", "EXP(-q)"),
        Family.B: ("m * q / (1 + q)", "POWER(1 + q, -m)"),
        Family.W: ("m * q / (1 - q)", "POWER(1 - q, m)"),
    }[family]
    sums = f"LIST_SUM(LIST_TRANSFORM(RANGE(0, w + 1), lambda k: {term}))", f"COALESCE(LIST_SUM(LIST_TRANSFORM(RANGE(0, w), lambda k: {term})), 0)"
    sql = f"SELECT CAST(q AS DOUBLE) AS q, CAST(w AS BIGINT) AS w, CAST(m AS BIGINT) AS m, ROUND(LEAST({sums[0]}, 1), 8) AS lower, ROUND(GREATEST(1 - {sums[1]}, 0), 8) AS upper, ROUND({mean}, 8) AS expected, ROUND(1 - {empty}, 8) AS occupation FROM (SELECT CAST(q AS DOUBLE) AS q, w, m FROM {_GRID})"
    return run, sql


for _name, _family, _term in (
    ("law_poisson", Family.ME, "EXP(k * LN(q) - q - LGAMMA(k + 1))"),
    ("law_binomial", Family.B, "CASE WHEN k <= m THEN EXP(LGAMMA(m + 1) - LGAMMA(k + 1) - LGAMMA(GREATEST(m - k, 0) + 1) + k * LN(q) - m * LN(1 + q)) ELSE 0 END"),
    ("law_negative_binomial", Family.W, "EXP(LGAMMA(m + k) - LGAMMA(k + 1) - LGAMMA(m) + k * LN(q) + m * LN(1 - q))"),
):
    QUERIES[_name], ORACLE[_name] = _law_query(_family, _term)


# --- iterative fits: expected constraints against the observed ones -------


#: What a constraint fixes over all nodes, by its column: the expected sums it is taken from, and its SQL.
_TOTALS = {
    Constraint.STRENGTH_EDGES: ("expected_edges", "degree_out", "edges"),
    Constraint.DEGREE_EVENTS: ("expected_events", "strength_out", "total"),
}


def _observed(net: str, kind: str, constraint: Constraint | None = None) -> str:
    out, incoming = (("s_out", "s_in") if kind == "strength" else ("k_out", "k_in"))
    total = ""
    if constraint in _TOTALS:
        name, _, sql = _TOTALS[constraint]
        total = f", ROUND(CAST({sql} AS DOUBLE), 1) AS {name}"
    elif constraint == Constraint.STRENGTH_COST:
        total = ", CAST(1 AS DOUBLE) AS cost_over_target"
    return _base(net) + f" SELECT node, ROUND(CAST({out} AS DOUBLE), 2) AS expected_out, ROUND(CAST({incoming} AS DOUBLE), 2) AS expected_in{total} FROM s, t"


def _recovered(spark, fit, kind: str) -> DataFrame:
    sums = P.expected_sums(spark, fit)
    clean = lambda c: (F.round(c, 2) + F.lit(0.0)).alias(c)
    got = sums.select("node", F.col(f"{kind}_out").alias("expected_out"), F.col(f"{kind}_in").alias("expected_in")).select("node", clean("expected_out"), clean("expected_in"))
    if fit.constraint in _TOTALS:
        name, column, _ = _TOTALS[fit.constraint]
        got = got.crossJoin(F.broadcast(sums.agg(F.round(F.sum(column), 1).alias(name))))  # one row
    return got


def _cost_over_target(cost: float, target: float):
    return F.round(F.lit(cost / target), 4).alias("cost_over_target")


def _layers(own) -> int:
    import numpy as np

    n = len(own["strength_out"])
    return max(10, 4 * int(np.ceil(max(own["strength_out"].max(), own["strength_in"].max()) / max(1, n - 1))))


def _fitted(spark, edges, family, constraint, layers=1, coordinates=None, self_loops=False):
    own = ST.constraints_of(edges, coordinates)
    names = {
        Constraint.STRENGTH: ["strength_out", "strength_in"],
        Constraint.STRENGTH_EDGES: ["strength_out", "strength_in", "target_edges"],
        Constraint.STRENGTH_DEGREE: ["strength_out", "strength_in", "degree_out", "degree_in"],
        Constraint.STRENGTH_COST: ["strength_out", "strength_in", "target_cost", "coordinates"],
        Constraint.DEGREE_EVENTS: ["degree_out", "degree_in", "total_events"],
        Constraint.DEGREE: ["degree_out", "degree_in"],
    }[constraint]
    layers = _layers(own) if layers == 0 else layers
    return fit_model(family=family, constraint=constraint, layers=layers, self_loops=self_loops, tolerance=1e-6, spark=spark, **{k: own[k] for k in names})


def _recovery_query(name, net, network, family, constraint, layers, kind):
    def run(spark, sf_dir):
        edges = network(spark, sf_dir)
        loops = network is N.nation_od or network is N.user_seq
        return _recovered(spark, _fitted(spark, edges, family, constraint, layers, self_loops=loops), kind)

    QUERIES[name], ORACLE[name] = run, _observed(net, kind, constraint)


_FAMILIES = (("me", Family.ME, 1), ("b", Family.B, 0), ("w1", Family.W, 1), ("w3", Family.W, 3))
for _label, _family, _m in _FAMILIES:
    _recovery_query(f"fit_{_label}_strength_recovery", ODQ, N.nation_od_q, _family, Constraint.STRENGTH, _m, "strength")
    _recovery_query(f"fit_{_label}_edges_recovery", SEQ, N.user_seq, _family, Constraint.STRENGTH_EDGES, _m, "strength")
    _recovery_query(f"fit_{_label}_degree_recovery", SEQ, N.user_seq, _family, Constraint.STRENGTH_DEGREE, _m, "degree")
    _recovery_query(f"fit_{_label}_degree_strength_recovery", SEQ, N.user_seq, _family, Constraint.STRENGTH_DEGREE, _m, "strength")
    _recovery_query(f"fit_degree_events_{_label}_recovery", ODQ, N.nation_od_q, _family, Constraint.DEGREE_EVENTS, _m, "degree")
_recovery_query("fit_bernoulli_degree_recovery", SEQ, N.user_seq, Family.ME, Constraint.DEGREE, 1, "degree")


def _cost_query(name, family, layers):
    def run(spark, sf_dir):
        edges = N.nation_od_q(spark, sf_dir)
        own = ST.constraints_of(edges)
        grid = N.grid(len(own["strength_out"]))
        layers_ = _layers(own) if layers == 0 else layers
        base = fit_model(family=family, constraint=Constraint.STRENGTH, strength_out=own["strength_out"], strength_in=own["strength_in"], layers=layers_, self_loops=False, tolerance=1e-6, spark=spark)
        from dataclasses import replace

        placed = replace(base, coordinates=grid)
        cost = P.candidates(spark, placed).agg(F.sum(P.law(placed).expected() * P.euclidean())).first()[0]
        fit = fit_model(family=family, constraint=Constraint.STRENGTH_COST, strength_out=own["strength_out"], strength_in=own["strength_in"], target_cost=0.9 * cost, coordinates=grid, layers=layers_, self_loops=False, tolerance=1e-6, spark=spark)
        got = P.candidates(spark, fit).agg(F.sum(P.law(fit).expected() * P.euclidean())).first()[0]
        return _recovered(spark, fit, "strength").select("*", _cost_over_target(got, 0.9 * cost))

    QUERIES[name], ORACLE[name] = run, _observed(ODQ, "strength", Constraint.STRENGTH_COST)


for _label, _family, _m in _FAMILIES:
    _cost_query(f"fit_{_label}_cost_recovery", _family, _m)


# --- filters of the other cells (given fits; results held against the laws' SQL in tests)


def _filter_query(name, family, constraint, layers):
    def run(spark, sf_dir):
        edges = N.user_seq(spark, sf_dir)
        fit = _fitted(spark, edges, family, constraint, layers, self_loops=True)
        return _rounded(filter_model(edges, fit=fit, alpha=0.05, tail="upper"))

    QUERIES[name] = run


for _label, _family, _m in _FAMILIES:
    for _constraint in (Constraint.STRENGTH, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.DEGREE_EVENTS):
        if (_label, _constraint) != ("me", Constraint.STRENGTH):
            _filter_query(f"filter_{_label}_{_constraint}", _family, _constraint, _m)


def _filter_cost_query(name, family, layers):
    def run(spark, sf_dir):
        edges = N.user_seq(spark, sf_dir)
        fit = _fitted(spark, edges, family, Constraint.STRENGTH_COST, layers, coordinates=N.grid(ST.node_count(edges)), self_loops=True)
        return _rounded(filter_model(edges, fit=fit, alpha=0.05, tail="upper"))

    QUERIES[name] = run


for _label, _family, _m in _FAMILIES:
    _filter_cost_query(f"filter_{_label}_strength_cost", _family, _m)


# --- filters of every cell under stated multipliers, against the laws written out in SQL ---

_CELL_Q = "(s1.s_out / SQRT(total)) * (s2.s_in / SQRT(total)) / 40"
_TERMS = {
    Family.ME: ("q", "q", "EXP(k * LN(q) - q - LGAMMA(k + 1))"),
    Family.B: ("{m} * LN(1 + q)", "{m} * q / (1 + q)", "CASE WHEN k <= {m} THEN EXP(LGAMMA({m} + 1) - LGAMMA(k + 1) - LGAMMA(GREATEST({m} - k, 0) + 1) + k * LN(q) - {m} * LN(1 + q)) ELSE 0 END"),
    Family.W: ("-{m} * LN(1 - q)", "{m} * q / (1 - q)", "EXP(LGAMMA({m} + k) - LGAMMA(k + 1) - LGAMMA({m}) + k * LN(q) + {m} * LN(1 - q))"),
}


def _cell_query(label, family, m, constraint):
    """Multipliers are fixed functions of the network, so that only the filter is at work."""
    u, mean, term = (t.format(m=m) for t in _TERMS[family])
    side = "CEIL(SQRT((SELECT COUNT(*) FROM s)))"
    dist = f"SQRT(POWER(s1.node % {side} - s2.node % {side}, 2) + POWER(FLOOR(s1.node / {side}) - FLOOR(s2.node / {side}), 2))"
    q, odds = {
        Constraint.STRENGTH: (_CELL_Q, None),
        Constraint.STRENGTH_COST: (f"{_CELL_Q} * EXP(-0.05 * {dist})", None),
        Constraint.STRENGTH_EDGES: (_CELL_Q, "0.7"),
        Constraint.STRENGTH_DEGREE: (_CELL_Q, "(s1.k_out / SQRT(edges)) * (s2.k_in / SQRT(edges))"),
        Constraint.DEGREE_EVENTS: ("0.4", "(s1.k_out / SQRT(edges)) * (s2.k_in / SQRT(edges))"),
    }[constraint]
    pi = "NULL" if odds is None else "o / (1 + o)" if constraint == Constraint.DEGREE_EVENTS else "1 / (1 + 1 / (o * (EXP(u) - 1)))"
    sql = _base(SEQ) + f"""
, r AS (SELECT e.source, e.target, e.weight, CAST({q} AS DOUBLE) AS q, CAST({odds or 0} AS DOUBLE) AS o FROM e JOIN s s1 ON e.source = s1.node JOIN s s2 ON e.target = s2.node, t),
v AS (SELECT *, {u} AS u, {mean} AS mean, LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight + 1), lambda k: {term}))) AS c, LEAST(1, LIST_SUM(LIST_TRANSFORM(RANGE(0, weight), lambda k: {term}))) AS b FROM r),
z AS (SELECT *, {pi} AS pi, 1 - EXP(-u) AS pos FROM v),
w AS (SELECT source, target, weight, COALESCE(pi, pos) AS occ, COALESCE(pi * mean / pos, mean) AS expected,
 COALESCE(pi * LEAST(1, GREATEST(0, (1 - b) / pos)), 1 - b) AS u0, COALESCE(1 - pi + pi * LEAST(1, GREATEST(0, (c - EXP(-u)) / pos)), c) AS l0 FROM z)
SELECT source, target, weight, ROUND(LEAST(u0 / occ, 1), 9) AS upper_pvalue, ROUND(LEAST(1, GREATEST(0, (l0 - (1 - occ)) / occ)), 9) AS lower_pvalue, ROUND(expected, 9) AS expected, ROUND(occ, 9) AS occupation FROM w"""

    def run(spark, sf_dir):
        import numpy as np

        from ..schema import Fit

        edges = N.user_seq(spark, sf_dir)
        own = ST.constraints_of(edges)
        t, k = np.sqrt(own["total_events"]), np.sqrt(own["target_edges"])
        x, y = own["strength_out"] / t, own["strength_in"] / t / 40
        z, w = own["degree_out"] / k, own["degree_in"] / k
        if constraint == Constraint.DEGREE_EVENTS:
            x, y = z, w
        fit = Fit(constraint, family, m, True, x, y, z, w, gamma=0.05, lam=0.7, q=0.4, coordinates=N.grid(len(x)))
        return _round(FO.observed(edges, fit), 9, "upper_pvalue", "lower_pvalue", "expected", "occupation")

    QUERIES[f"filter_cell_{label}_{constraint}"], ORACLE[f"filter_cell_{label}_{constraint}"] = run, sql


for _label, _family, _m in (("me", Family.ME, 1), ("b20", Family.B, 20), ("w1", Family.W, 1), ("w3", Family.W, 3)):
    for _constraint in (Constraint.STRENGTH, Constraint.STRENGTH_COST, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.DEGREE_EVENTS):
        _cell_query(_label, _family, _m, _constraint)


# --- partial fits ---------------------------------------------------------


def _partial_query(name, family, constraint, layers=1):
    def run(spark, sf_dir):
        edges = N.nation_od_q(spark, sf_dir)
        own = ST.constraints_of(edges)
        own["coordinates"] = N.grid(len(own["strength_out"]))
        known = SY.top_pairs(edges, 0.05)
        names = {Constraint.STRENGTH: [], Constraint.STRENGTH_EDGES: ["target_edges"], Constraint.STRENGTH_DEGREE: ["degree_out", "degree_in"]}[constraint]
        layers_ = _layers(own) if layers == 0 else layers
        got = fit_model(family=family, constraint=constraint, known=known, layers=layers_, self_loops=False, tolerance=1e-6, **{k: own[k] for k in ["strength_out", "strength_in", *names]})
        sums = EV.partial_recovery(got, len(own["strength_out"]))
        return sums.select("node", (F.round("strength_out", 2) + 0.0).alias("expected_out"), (F.round("strength_in", 2) + 0.0).alias("expected_in"))

    QUERIES[name], ORACLE[name] = run, _observed(ODQ, "strength")


for _label, _family, _m in _FAMILIES:
    _partial_query(f"partial_{_label}_strength_recovery", _family, Constraint.STRENGTH, _m)
    _partial_query(f"partial_{_label}_edges_recovery", _family, Constraint.STRENGTH_EDGES, _m)
    _partial_query(f"partial_{_label}_degree_recovery", _family, Constraint.STRENGTH_DEGREE, _m)


def _partial_cost_query(name, family, layers):
    def run(spark, sf_dir):
        edges = N.nation_od_q(spark, sf_dir)
        own = ST.constraints_of(edges)
        grid = N.grid(len(own["strength_out"]))
        layers_ = _layers(own) if layers == 0 else layers
        options = {"known": SY.top_pairs(edges, 0.05), "layers": layers_, "self_loops": False, "tolerance": 1e-6, "strength_out": own["strength_out"], "strength_in": own["strength_in"]}
        free = fit_model(family=family, constraint=Constraint.STRENGTH, **options)
        nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(grid)], "node long, cx double, cy double")
        cost = ST.total_cost(free.rates.withColumnRenamed("rate", "weight"), nodes).first()[0]
        got = fit_model(family=family, constraint=Constraint.STRENGTH_COST, target_cost=0.95 * cost, coordinates=grid, **options)
        sums = EV.partial_recovery(got, len(own["strength_out"]))
        reached = ST.total_cost(got.rates.withColumnRenamed("rate", "weight"), nodes).first()[0]
        return sums.select("node", (F.round("strength_out", 2) + 0.0).alias("expected_out"), (F.round("strength_in", 2) + 0.0).alias("expected_in"), _cost_over_target(reached, 0.95 * cost))

    QUERIES[name], ORACLE[name] = run, _observed(ODQ, "strength", Constraint.STRENGTH_COST)


for _label, _family, _m in _FAMILIES:
    _partial_cost_query(f"partial_{_label}_cost_recovery", _family, _m)


@query(_observed(ODQ, "strength"))
def cutoff_fit_recovery(spark, sf_dir):
    edges = N.nation_od_q(spark, sf_dir)
    got = FIT.fit_from_cutoff(edges, 4, Constraint.STRENGTH, Family.ME, self_loops=False, tolerance=1e-6)
    sums = EV.partial_recovery(got, ST.node_count(edges))
    return sums.select("node", (F.round("strength_out", 2) + 0.0).alias("expected_out"), (F.round("strength_in", 2) + 0.0).alias("expected_in"))


# --- samples --------------------------------------------------------------

_U = "((CAST('0x' || SUBSTR(MD5({}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query(_base(SEQ) + ' SELECT node, s_out AS "out", s_in AS incoming FROM s')
def sample_micro_strengths(spark, sf_dir):
    """Stub matching keeps every strength."""
    edges = N.user_seq(spark, sf_dir)
    s = ST.directed_strengths(edges)
    got = sample_model(spark, ensemble=Ensemble.MICROCANONICAL, strengths=s, seed=5)
    sums = ST.directed_strengths(got)
    return s.select("node").join(sums, "node", "left").fillna(0)


@query(f"SELECT CAST(SUM(weight) AS BIGINT) AS total_events FROM {SEQ}")
def sample_canonical_total(spark, sf_dir):
    """The canonical ensemble keeps the number of events."""
    edges = N.user_seq(spark, sf_dir)
    total = edges.agg(F.sum("weight")).first()[0]
    got = sample_model(spark, fit=_me(spark, edges), ensemble=Ensemble.CANONICAL, total_events=total, seed=5)
    return got.agg(F.sum("weight").cast("bigint").alias("total_events"))


@query(f"SELECT CAST(500 AS BIGINT) AS total_events, TRUE AS inside")
def sample_custom_multinomial(spark, sf_dir):
    """Exactly T events, on pairs of the table only."""
    edges = N.user_seq(spark, sf_dir)
    table = edges.select("source", "target", (F.col("weight") / 1000.0).alias("probability"))
    got = SMP.custom_multinomial(table, 500, seed=3)
    inside = got.join(table, ["source", "target"], "left").agg(F.sum("weight").cast("bigint").alias("total_events"), (F.sum(F.col("probability").isNull().cast("int")) == 0).alias("inside"))
    return inside


@query(
    _base(OD)
    + ", r AS (SELECT a.node AS source, b.node AS target, CAST(a.s_out AS DOUBLE) * b.s_in / total / 40 AS r, "
    + _U.format("'11:' || a.node || ':' || b.node")
    + " AS u FROM s a, s b, t WHERE a.s_out > 0 AND b.s_in > 0), d AS (SELECT source, target, CAST((SELECT COUNT(*) FROM (SELECT UNNEST(RANGE(0, 200)) AS w) z WHERE LIST_SUM(LIST_TRANSFORM(RANGE(0, z.w + 1), lambda k: EXP(k * LN(r) - r - LGAMMA(k + 1)))) <= u) AS BIGINT) AS weight FROM r) SELECT * FROM d WHERE weight > 0"
)
def sample_gc_poisson(spark, sf_dir):
    """Independent Poisson draws by the counter generator, repeated in SQL."""
    fit = _me(spark, N.nation_od(spark, sf_dir))
    rows = P.candidates(spark, fit).withColumn("q", F.col("x_i") * F.col("y_j") / 40)
    return SMP.independent(rows, Law(Family.ME, 1, F.col("q")), 11)


@query(
    _base(OD)
    + ", r AS (SELECT a.node AS source, b.node AS target, CAST(a.s_out AS DOUBLE) * b.s_in / total / 4000 AS q0, "
    + _U.format("'12:' || a.node || ':' || b.node")
    + " AS u FROM s a, s b, t WHERE a.s_out > 0 AND b.s_in > 0), d AS (SELECT source, target, CAST(FLOOR(LN(1 - u) / LN(q0 / (1 + q0))) AS BIGINT) AS weight FROM r) SELECT * FROM d WHERE weight > 0"
)
def sample_gc_geometric(spark, sf_dir):
    """Independent geometric draws by the counter generator, repeated in SQL."""
    fit = _me(spark, N.nation_od(spark, sf_dir))
    q0 = F.col("x_i") * F.col("y_j") / 4000
    return SMP.independent(P.candidates(spark, fit).withColumn("q", q0 / (q0 + 1)), Law(Family.W, 1, F.col("q")), 12)


@query("SELECT CAST(event_id AS BIGINT) AS event_id, " + _U.format("'7:' || event_id || ':1'") + " AS u FROM events")
def counter_uniform(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").cast("bigint").alias("event_id"), uniform(7, F.col("event_id"), 1).alias("u"))


@query()
def sample_custom_poisson(spark, sf_dir):
    edges = N.user_seq(spark, sf_dir).select("source", "target", F.col("weight").cast("double").alias("probability"))
    return SMP.custom_poisson(edges, 5000.0, seed=2)


def _sample_query(name, family, constraint, layers):
    def run(spark, sf_dir):
        edges = N.nation_od_q(spark, sf_dir)
        grid = N.grid(25) if constraint == Constraint.STRENGTH_COST else None
        own_n = ST.node_count(edges)
        fit = _fitted(spark, edges, family, constraint, layers, coordinates=None if grid is None else grid[:own_n])
        return sample_model(spark, fit=fit, seed=17)

    QUERIES[name] = run


for _label, _family, _m in _FAMILIES:
    for _constraint in (Constraint.STRENGTH, Constraint.STRENGTH_COST, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.DEGREE_EVENTS):
        _sample_query(f"sample_{_label}_{_constraint}", _family, _constraint, _m)


def _sample_cell_query(label, family, m, constraint):
    """Draws of all pairs by the counter generator under multipliers that are fixed functions of the whole network, repeated in SQL."""
    u, _, term = (t.format(m=m) for t in _TERMS[family])
    side = "CEIL(SQRT((SELECT COUNT(*) FROM s)))"
    dist = f"SQRT(POWER(s1.node % {side} - s2.node % {side}, 2) + POWER(FLOOR(s1.node / {side}) - FLOOR(s2.node / {side}), 2))"
    plain = "(0.6 * s1.s_out / most_out) * (s2.s_in / most_in)"  # 0.6 at most, so that every family has a law
    occupied = "(s1.k_out / SQRT(edges)) * (s2.k_in / SQRT(edges))"
    q, odds = {
        Constraint.STRENGTH: (plain, None),
        Constraint.STRENGTH_COST: (f"{plain} * EXP(-0.05 * {dist})", None),
        Constraint.STRENGTH_EDGES: (plain, "0.7"),
        Constraint.STRENGTH_DEGREE: (plain, occupied),
        Constraint.DEGREE_EVENTS: ("0.4", occupied),
        Constraint.DEGREE: ("0.4", occupied),
    }[constraint]
    pi = "NULL" if odds is None else "1 / (1 + 1 / (o * (EXP(u) - 1)))" if constraint in (Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE) else "o / (1 + o)"
    inner = "1" if constraint == Constraint.DEGREE else "GREATEST(1, n)"
    sql = _base(OD) + f"""
, most AS (SELECT CAST(MAX(s_out) AS DOUBLE) AS most_out, CAST(MAX(s_in) AS DOUBLE) AS most_in FROM s),
r AS (SELECT s1.node AS source, s2.node AS target, CAST({q} AS DOUBLE) AS q, CAST({odds or 0} AS DOUBLE) AS o, {_U.format("'23:' || s1.node || ':' || s2.node")} AS u0, {_U.format("'23:' || s1.node || ':' || s2.node || ':1'")} AS v0 FROM s s1, s s2, t, most WHERE s1.s_out > 0 AND s2.s_in > 0),
v AS (SELECT *, {u} AS u FROM r),
z AS (SELECT source, target, q, u0, CAST({pi} AS DOUBLE) AS pi, CASE WHEN {pi} IS NULL THEN u0 ELSE EXP(-u) + v0 * (1 - EXP(-u)) END AS reach FROM v),
c AS (SELECT source, target, reach, u0, pi, w, SUM({term.replace("k", "w")}) OVER (PARTITION BY source, target ORDER BY w) AS cdf FROM z, (SELECT UNNEST(RANGE(0, 150)) AS w)),
d AS (SELECT source, target, u0, pi, COUNT(*) FILTER (WHERE cdf <= reach) AS n FROM c GROUP BY ALL),
g AS (SELECT source, target, CAST(CASE WHEN pi IS NULL THEN n WHEN u0 < pi THEN {inner} ELSE 0 END AS BIGINT) AS weight FROM d)
SELECT * FROM g WHERE weight > 0"""

    def run(spark, sf_dir):
        import numpy as np

        from ..schema import Fit

        own = ST.constraints_of(N.nation_od(spark, sf_dir))
        k = np.sqrt(own["target_edges"])
        x, y = 0.6 * own["strength_out"] / own["strength_out"].max(), own["strength_in"] / own["strength_in"].max()
        z, w = own["degree_out"] / k, own["degree_in"] / k
        if constraint in (Constraint.DEGREE_EVENTS, Constraint.DEGREE):
            x, y = z, w
        fit = Fit(constraint, family, m, True, x, y, z, w, gamma=0.05, lam=0.7, q=0.4, coordinates=N.grid(len(x)))
        return sample_model(spark, fit=fit, seed=23)

    QUERIES[f"sample_cell_{label}_{constraint}"], ORACLE[f"sample_cell_{label}_{constraint}"] = run, sql


for _label, _family, _m in (("me", Family.ME, 1), ("b20", Family.B, 20), ("w1", Family.W, 1), ("w3", Family.W, 3)):
    for _constraint in (Constraint.STRENGTH, Constraint.STRENGTH_COST, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.DEGREE_EVENTS):
        _sample_cell_query(_label, _family, _m, _constraint)
_sample_cell_query("bernoulli", Family.ME, 1, Constraint.DEGREE)


@query()
def ensemble_mean(spark, sf_dir):
    """Mean and deviation of out-strengths over 20 samples."""
    fit = _me(spark, N.nation_od_q(spark, sf_dir))
    return EN.ensemble_average(SMP.grand_canonical(spark, fit, 4, 20), EN.out_strength, 20)


@query()
def ensemble_scalar(spark, sf_dir):
    fit = _me(spark, N.nation_od_q(spark, sf_dir))
    return EN.ensemble_scalar_average(SMP.grand_canonical(spark, fit, 4, 20), EN.events)


@query()
def ensemble_percentiles(spark, sf_dir):
    fit = _me(spark, N.nation_od_q(spark, sf_dir))
    return EN.percentiles(SMP.grand_canonical(spark, fit, 4, 20), EN.out_strength)


@query()
def fpr(spark, sf_dir):
    """False-positive rate of the upper filter on samples of the null model itself."""
    fit = _me(spark, N.nation_od_q(spark, sf_dir))
    sample = SMP.grand_canonical(spark, fit, 9)
    return FO.false_positive_rate(FO.classify(FO.observed(sample, fit), 0.05, "upper"))
