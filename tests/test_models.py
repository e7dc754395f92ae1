import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullweave.functions import kernels as K
from nullweave.functions.laws import Law, inflated, uniform
from nullweave.operators import ensemble as EN
from nullweave.operators import filter as FO
from nullweave.operators import fit as FIT
from nullweave.operators import pairs as P
from nullweave.operators import sample as SMP
from nullweave.operators import synthetic as SY
from nullweave.operators.evaluate import recovery
from nullweave.plans.router import filter_model, fit_model, sample_model
from nullweave.schema import Constraint, Ensemble, Family, UnsupportedModelCaseError

CELLS = [(Family.ME, 1), (Family.B, 40), (Family.W, 1), (Family.W, 3)]


@pytest.fixture(scope="module")
def network(spark):
    n = SY.spatial_network(spark, 10, average_degree=4, events_per_edge=4, seed=54320)
    return n, SY.derived_constraints(n)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_poisson_tail_of_a_large_rate(spark):
    law = Law(Family.ME, 1, F.lit(1000.0))
    r = one(spark, up=law.upper(F.lit(1000).cast("bigint")), low=law.lower(F.lit(1000).cast("bigint")))
    assert 0.49 < r.up < 0.52 and 0.49 < r.low < 0.52


def test_binomial_against_fractions(spark):
    q, m = Fraction(1, 3), 5
    p = q / (1 + q)
    pmf = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
    law = Law(Family.B, m, F.lit(1 / 3))
    for w in range(7):
        r = one(spark, up=law.upper(F.lit(w).cast("bigint")), low=law.lower(F.lit(w).cast("bigint")))
        assert r.low == pytest.approx(float(sum(pmf[: w + 1])), abs=1e-12)
        assert r.up == pytest.approx(float(sum(pmf[w:])), abs=1e-12)


@pytest.mark.parametrize(("family", "layers"), CELLS)
def test_inflated_laws_add_up(spark, family, layers):
    law = inflated(family, layers, F.lit(0.4), F.lit(0.7))
    w = F.explode(F.sequence(F.lit(0), F.lit(60))).alias("w")
    rows = spark.range(1).select(w).select("w", law.lower(F.col("w").cast("bigint")).alias("low"), law.upper(F.col("w").cast("bigint")).alias("up"), law.expected().alias("e"), law.occupation().alias("o")).orderBy("w").toPandas()
    pmf = np.diff(np.concatenate([[0], rows.low]))
    assert rows.low[0] == pytest.approx(1 - rows.o[0])
    assert (pmf * np.arange(61)).sum() == pytest.approx(rows.e[0], rel=1e-6)
    assert np.allclose(rows.up[1:], 1 - rows.low[:-1].to_numpy(), atol=1e-9)


def test_large_rates_do_not_overflow(spark):
    r = one(spark, o=inflated(Family.ME, 1, F.lit(2000.0), F.lit(1e-9)).occupation(), e=inflated(Family.B, 900, F.lit(50.0), F.lit(2.0)).expected())
    assert r.o == pytest.approx(1) and math.isfinite(r.e)


def test_uniform_is_fixed(spark):
    assert one(spark, u=uniform(42, 1, 2)).u == pytest.approx(0.058585394497644216, abs=1e-12)


@pytest.mark.parametrize(("family", "layers"), CELLS)
@pytest.mark.parametrize("constraint", [Constraint.STRENGTH, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.STRENGTH_COST, Constraint.DEGREE_EVENTS])
def test_fits_recover_constraints(spark, network, family, layers, constraint):
    net, own = network
    names = {"strength_edges": ["target_edges"], "strength_degree": ["degree_out", "degree_in"], "strength_cost": ["target_cost", "coordinates"]}.get(constraint, [])
    names = ["degree_out", "degree_in", "total_events"] if constraint == Constraint.DEGREE_EVENTS else ["strength_out", "strength_in", *names]
    fit = fit_model(family=family, constraint=constraint, layers=layers, self_loops=False, tolerance=1e-7, spark=spark, **{k: own[k] for k in names})
    got = recovery(spark, fit, own)
    assert max(v for k, v in got.items() if k.startswith("rel")) < 0.01
    if "edges_error" in got:
        assert abs(got["edges_error"]) < 0.01 * own["target_edges"]
    sample = sample_model(spark, fit=fit, seed=3).collect()
    assert sample == sample_model(spark, fit=fit, seed=3).collect()
    assert all(r.source != r.target and r.weight > 0 and (family != Family.B or r.weight <= layers) for r in sample)


def test_distributed_evaluation_is_the_local_one(spark, network):
    from nullweave.operators.dual import Problem

    _, own = network
    p = Problem(Family.B, 40, False, own["strength_out"], own["strength_in"])
    theta = p.start()
    assert np.allclose(p.local(theta), p.distributed(spark)(theta))


@pytest.mark.parametrize("family", [Family.ME, Family.B, Family.W])
@pytest.mark.parametrize("constraint", [Constraint.STRENGTH, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_COST])
def test_partial_fits(spark, network, family, constraint):
    net, own = network
    known = SY.top_pairs(net.edges, 0.1)
    extra = {"strength_edges": ["target_edges"], "strength_cost": ["target_cost", "coordinates"]}.get(constraint, [])
    got = fit_model(family=family, constraint=constraint, known=known, layers=40 if family == Family.B else 1, self_loops=False, **{k: own[k] for k in ["strength_out", "strength_in", *extra]})
    sums = got.rates.groupBy("source").agg(F.sum("rate").alias("s")).collect()
    assert all(abs(r.s - own["strength_out"][r.source]) < 0.01 * own["strength_out"].max() for r in sums)
    held = {(r.source, r.target): r.rate for r in known.collect()}
    rates = {(r.source, r.target): r.rate for r in got.rates.collect()}
    assert all(rates[k] == v for k, v in held.items()) and all(i != j for i, j in rates)


def test_ensembles_agree(spark):
    out, incoming = [0.35, 0.25, 0.20, 0.12, 0.08], [0.30, 0.22, 0.20, 0.15, 0.13]
    t = 500
    s_out, s_in = np.round(np.array(out) * t), np.round(np.array(incoming) * t)
    fit = fit_model(family=Family.ME, constraint=Constraint.STRENGTH, strength_out=s_out, strength_in=s_in)
    expected = np.outer(fit.x, fit.y)
    mean = {(r.source, r.target): r.w / 20 for r in SMP.grand_canonical(spark, fit, 1, 20).groupBy("source", "target").agg(F.sum("weight").alias("w")).collect()}
    assert abs(sum(mean.values()) - t) < 0.05 * t
    assert abs(mean[0, 0] - expected[0, 0]) < 0.15 * expected[0, 0]
    exact = sample_model(spark, fit=fit, ensemble=Ensemble.CANONICAL, total_events=t, seed=2)
    assert exact.agg(F.sum("weight")).first()[0] == t
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(s_out, s_in))], "node long, out long, incoming long")
    micro = sample_model(spark, ensemble=Ensemble.MICROCANONICAL, strengths=nodes, seed=2)
    got = {r.source: r.s for r in micro.groupBy("source").agg(F.sum("weight").alias("s")).collect()}
    assert [got[i] for i in range(5)] == s_out.tolist()


def test_custom_probabilities(spark):
    p = spark.createDataFrame([(0, 1, 0.25), (1, 2, 0.75)], "source long, target long, probability double")
    got = SMP.custom_multinomial(p, 100, seed=1).collect()
    assert sum(r.weight for r in got) == 100 and {(r.source, r.target) for r in got} <= {(0, 1), (1, 2)}


def test_filters(spark, edges):
    e = edges([(0, 0, 1), (0, 1, 40), (1, 0, 1), (1, 1, 1)])
    up = filter_model(e, alpha=0.95, tail="upper")
    assert (0, 1) in {(r.source, r.target) for r in up.where("is_upper").collect()}
    e = edges([(0, 0, 20), (1, 1, 20)])
    got = FO.groups(filter_model(e, alpha=0.9, detect_absent=True))
    assert got["absent_lower"].count() == 2 and got["lower"].count() == 0
    rates = spark.createDataFrame([(0, 1, 1.0), (1, 0, 5.0)], "source long, target long, rate double")
    got = FO.groups(filter_model(edges([(0, 1, 10)]), rates=rates, alpha=0.05, detect_absent=True))
    assert got["upper"].count() == 1 and got["absent_lower"].count() == 1
    for correction in ("bonferroni", "fdr"):
        assert filter_model(e, correction=correction).count() == 2


def test_false_positive_rate(spark, network):
    net, own = network
    fit = fit_model(family=Family.ME, constraint=Constraint.STRENGTH, strength_out=own["strength_out"], strength_in=own["strength_in"])
    sample = SMP.grand_canonical(spark, fit, 0, 5).drop("rep")
    assert FO.false_positive_rate(FO.classify(FO.observed(sample, fit), 0.05, "upper")).first().fpr <= 0.15
    mean = EN.ensemble_average(SMP.grand_canonical(spark, fit, 0, 5), EN.out_strength, 5).count()
    assert mean == 10


def test_infeasible_inputs():
    s = np.array([1.0, 2.0])
    with pytest.raises(ValueError, match="balanced"):
        FIT.fit(Constraint.STRENGTH, Family.ME, s, s + 1)
    with pytest.raises(ValueError, match="non-negative"):
        FIT.fit(Constraint.STRENGTH, Family.ME, -s, -s)
    with pytest.raises(ValueError, match="finite"):
        FIT.fit(Constraint.STRENGTH, Family.ME, s * np.nan, s)
    with pytest.raises(ValueError, match="infeasible"):
        FIT.fit(Constraint.STRENGTH, Family.B, 10 * s, 10 * s, layers=2)
    with pytest.raises(ValueError, match="target_edges"):
        FIT.fit(Constraint.STRENGTH_EDGES, Family.ME, s, s, target_edges=0)
    with pytest.raises(ValueError, match="events"):
        FIT.fit(Constraint.STRENGTH_EDGES, Family.ME, s, s, target_edges=9)
    with pytest.raises(ValueError, match="below its degree"):
        FIT.fit(Constraint.STRENGTH_DEGREE, Family.ME, s, s, 3 * s, 3 * s)
    with pytest.raises(TypeError):
        FIT.fit(Constraint.STRENGTH, Family.ME, s, None)
    with pytest.raises(UnsupportedModelCaseError):
        fit_model(family=Family.B, constraint=Constraint.STRENGTH, ensemble=Ensemble.CANONICAL, strength_out=s, strength_in=s)
    with pytest.raises(ValueError):
        FO.tail_alphas(0.05, "both")


def test_positive_means():
    for family, layers in CELLS:
        q = K.solve_positive_mean(family, layers, 1.7)
        assert K.positive_mean(family, layers, np.log(q)) == pytest.approx(1.7)
    assert K.solve_positive_mean(Family.B, 3, 3.0) == math.inf
    with pytest.raises(ValueError, match="infeasible"):
        K.solve_positive_mean(Family.B, 3, 4.0)
