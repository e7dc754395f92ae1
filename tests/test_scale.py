"""Fits of many nodes: the work grows with kinds of nodes, not with pairs of nodes."""

import math

import numpy as np
import pytest

from nullweave.functions import kernels as K
from nullweave.operators import filter as FO
from nullweave.operators.dual import Problem, minimise, solve
from nullweave.plans.router import fit_model
from nullweave.schema import Constraint, Family

NODES = 600


@pytest.fixture
def evaluated(monkeypatch):
    """Pairs whose law is evaluated by a fit."""
    seen, plain = [0], K.exponent

    def counted(family, layers, log_q):
        seen[0] += np.size(log_q)
        return plain(family, layers, log_q)

    monkeypatch.setattr(K, "exponent", counted)
    return seen


@pytest.fixture(scope="module")
def ring(spark):
    """Nodes of a few kinds on a ring, each with links to the next ones, weights 1 to 3."""
    rows = [(i, (i + 7 * k + 1) % NODES, 1 + (i + k) % 3) for i in range(NODES) for k in range(4 + i % 3)]
    return spark.createDataFrame(rows, "source long, target long, weight long")


def own_constraints(ring, constraint):
    from nullweave.operators.stats import constraints_of

    own = constraints_of(ring)
    return {k: own[k] for k in ("strength_out", "strength_in", *(("target_edges",) if constraint == Constraint.STRENGTH_EDGES else ("degree_out", "degree_in")))}


FILTERS = [
    (Family.B, 10, Constraint.STRENGTH_DEGREE),
    (Family.ME, 1, Constraint.STRENGTH_DEGREE),
    (Family.W, 1, Constraint.STRENGTH_DEGREE),
    (Family.W, 3, Constraint.STRENGTH_DEGREE),
    (Family.B, 10, Constraint.STRENGTH_EDGES),
    (Family.W, 1, Constraint.STRENGTH_EDGES),
    (Family.W, 3, Constraint.STRENGTH_EDGES),
]


@pytest.mark.parametrize(("family", "layers", "constraint"), FILTERS)
def test_filters_of_many_nodes(spark, ring, evaluated, family, layers, constraint):
    own = own_constraints(ring, constraint)
    fit = fit_model(family=family, constraint=constraint, layers=layers, tolerance=1e-6, spark=spark, **own)
    assert fit.converged and evaluated[0] < NODES * NODES  # less than one look at every pair
    got = FO.observed(ring, fit).toPandas()
    assert len(got) == ring.count() and got.upper_pvalue.between(0, 1).all() and (got.occupation > 0).all()


def test_constraints_take_one_pass(spark):
    from nullweave.operators.stats import constraints_of

    looks = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            looks.add(b.num_rows)
            yield b

    rows = [(0, 1, 2), (0, 3, 3), (3, 3, 1), (0, 1, 4)]
    got = constraints_of(spark.createDataFrame(rows, "source long, target long, weight long").mapInArrow(look, "source long, target long, weight long"))
    assert looks.value == len(rows)
    assert {k: np.asarray(v).tolist() for k, v in got.items()} == {"strength_out": [9, 0, 0, 1], "strength_in": [0, 6, 0, 4], "degree_out": [3, 0, 0, 1], "degree_in": [0, 2, 0, 2], "total_events": 10, "target_edges": 4}
    none = constraints_of(spark.createDataFrame([], "source long, target long, weight long"))
    assert none["strength_out"].tolist() == [] and none["total_events"] == 0 and none["target_edges"] == 0


@pytest.mark.parametrize("self_loops", [True, False])
@pytest.mark.parametrize("kind", ["strength", "edges", "degree", "bernoulli"])
def test_classes_stand_for_their_nodes(self_loops, kind):
    s, k = np.tile([9.0, 5.0, 5.0, 0.0], 5), np.tile([4.0, 3.0, 2.0, 0.0], 5)
    more = {"strength": {}, "edges": {"edges": 45.0}, "degree": {"k_out": k, "k_in": k[::-1].copy()}, "bernoulli": {"k_out": k, "k_in": k[::-1].copy(), "bernoulli": True}}[kind]
    out, incoming = (k, k[::-1].copy()) if kind == "bernoulli" else (s, s[::-1].copy())
    p = Problem(Family.B, 10, self_loops, out, incoming, **more)
    small, _ = p.collapsed()
    assert small.size < p.size
    got, want = solve(p, None, 1e-9, 3000), minimise(p, p.local, 1e-9, 3000)
    assert got.converged and np.allclose(got.expected, want.expected, atol=1e-6)
    assert np.allclose(p.local(got.theta)[1:], got.expected, atol=1e-9)
    assert got.objective == pytest.approx(want.objective, rel=1e-9)


@pytest.mark.parametrize(("family", "layers"), [(Family.ME, 1), (Family.B, 7), (Family.W, 1), (Family.W, 3)])
@pytest.mark.parametrize("kind", ["strength", "edges", "degree"])
def test_second_derivatives(family, layers, kind):
    s, k = np.array([9.0, 5.0, 5.0, 4.0]), np.array([3.0, 3.0, 2.0, 2.0])
    more = {"strength": {}, "edges": {"edges": 10.0}, "degree": {"k_out": k, "k_in": k}}[kind]
    for self_loops in (True, False):
        p, _ = Problem(family, layers, self_loops, np.tile(s, 2), np.tile(s, 2), **{n: np.tile(v, 2) if n != "edges" else v for n, v in more.items()}).collapsed()
        theta = p.start()
        moves = np.flatnonzero(p.nodes * p.targets != 0)
        h, step = p.curvature(theta), 1e-6
        for v in moves:
            up, down = theta.copy(), theta.copy()
            up[v] += step
            down[v] -= step
            assert np.allclose(h[v][moves], ((p.local(up) - p.local(down))[1:] / (2 * step))[moves], rtol=1e-5, atol=1e-6)


RECOVERIES = [
    (Family.B, 10, Constraint.STRENGTH_DEGREE, "degree"),
    (Family.B, 10, Constraint.STRENGTH_DEGREE, "strength"),
    (Family.ME, 1, Constraint.STRENGTH_DEGREE, "degree"),
    (Family.ME, 1, Constraint.STRENGTH_DEGREE, "strength"),
    (Family.W, 1, Constraint.STRENGTH_DEGREE, "degree"),
    (Family.W, 1, Constraint.STRENGTH_DEGREE, "strength"),
    (Family.W, 3, Constraint.STRENGTH_DEGREE, "degree"),
    (Family.W, 3, Constraint.STRENGTH_DEGREE, "strength"),
    (Family.B, 10, Constraint.STRENGTH_EDGES, "strength"),
    (Family.ME, 1, Constraint.STRENGTH_EDGES, "strength"),
    (Family.W, 1, Constraint.STRENGTH_EDGES, "strength"),
    (Family.W, 3, Constraint.STRENGTH_EDGES, "strength"),
]


@pytest.mark.parametrize(("family", "layers", "constraint", "kind"), RECOVERIES)
def test_recoveries_of_many_nodes(spark, ring, evaluated, monkeypatch, family, layers, constraint, kind):
    from nullweave.operators import pairs as P

    def every_pair(*_):
        raise AssertionError("sums go over all pairs of nodes")

    own = own_constraints(ring, constraint)
    fit = fit_model(family=family, constraint=constraint, layers=layers, tolerance=1e-6, spark=spark, **own)
    assert fit.converged and evaluated[0] < NODES * NODES
    monkeypatch.setattr(P, "expectations", every_pair)
    got = P.expected_sums(spark, fit).orderBy("node").toPandas()
    assert got.node.tolist() == list(range(NODES))
    if constraint == Constraint.STRENGTH_EDGES:
        assert got.degree_out.sum() == pytest.approx(own["target_edges"], rel=1e-5) == got.degree_in.sum()
    for end in ("out", "in"):
        assert np.allclose(got[f"{kind}_{end}"], own[f"{kind}_{end}"], atol=1e-4)


@pytest.mark.parametrize("constraint", list(Constraint))
def test_sums_by_class_are_those_of_pairs(spark, constraint):
    from nullweave.operators import pairs as P
    from nullweave.schema import Fit

    x, y = np.array([0.3, 0.0, 0.3, 0.2]), np.array([0.5, 0.5, 0.0, 0.1])
    fit = Fit(constraint, Family.W, 3, True, x, y, np.array([2.0, 1.0, 2.0, 3.0]), np.array([0.5, 0.5, 0.7, 0.1]), gamma=0.1, lam=0.7, q=0.4, coordinates=np.eye(4)[:, :2] if constraint == Constraint.STRENGTH_COST else None)
    got = P.expected_sums(spark, fit).orderBy("node").toPandas()
    want = P.expectations(spark, fit).toPandas()
    for column, key, value in (("strength_out", "source", "expected"), ("degree_out", "source", "occupation"), ("strength_in", "target", "expected"), ("degree_in", "target", "occupation")):
        assert np.allclose(got[column], want.groupby(key)[value].sum().reindex(range(4), fill_value=0.0))


@pytest.mark.parametrize("layers", [1, 3])
def test_small_rates_of_w_are_exact(layers):
    log_q = np.array([-36.0, -30.0, -18.0, -1.0, -0.7, -0.6999, -1e-3, -1e-9])
    got = K.exponent(Family.W, layers, log_q)
    want = [-layers * math.log1p(-math.exp(x)) if x < -0.5 else -layers * math.log(-math.expm1(x)) for x in log_q.tolist()]
    assert np.allclose(got, want, rtol=1e-14, atol=0)


@pytest.mark.parametrize("layers", [1, 3])
def test_w_degrees_with_nodes_of_single_weights(layers):
    """Nodes whose weights are all 1 have a multiplier next to 0; the others meet their strengths beside them."""
    s, k = np.tile([64.0, 66.0, 67.0], 400), np.tile([64.0, 66.0, 65.0], 400)
    s_in, k_in = np.roll(s, 1), np.roll(k, 1)
    got = solve(Problem(Family.W, layers, True, s, s_in, k_out=k, k_in=k_in), None, 1e-6, 300)
    assert got.converged


FULL = [
    (Family.B, 40),
    (Family.ME, 1),
    (Family.W, 1),
    (Family.W, 3),
]


@pytest.mark.parametrize(("family", "layers"), FULL)
def test_edges_on_every_pair(spark, family, layers):
    """As many edges as pairs: weights are positive on all of them, and meet the strengths."""
    from nullweave.operators import pairs as P
    from nullweave.plans.router import sample_model

    w = np.array([[0, 3, 1, 2], [5, 0, 2, 1], [1, 1, 0, 9], [2, 4, 3, 0]], float)
    for self_loops, w in ((False, w), (True, w + np.eye(4))):
        own = {"strength_out": w.sum(axis=1), "strength_in": w.sum(axis=0), "target_edges": float((w > 0).sum())}
        fit = fit_model(family=family, constraint=Constraint.STRENGTH_EDGES, layers=layers, self_loops=self_loops, tolerance=1e-8, spark=spark, **own)
        assert fit.converged and np.isfinite(fit.lam)
        got = P.expected_sums(spark, fit).orderBy("node").toPandas()
        assert np.allclose(got.strength_out, own["strength_out"], atol=1e-5) and np.allclose(got.strength_in, own["strength_in"], atol=1e-5)
        assert got.degree_out.sum() == pytest.approx(own["target_edges"], abs=1e-9)
        sample = sample_model(spark, fit=fit, seed=3).toPandas()
        assert len(sample) == own["target_edges"] and sample.weight.between(1, layers if family == Family.B else 1000).all()
        with pytest.raises(ValueError, match="capacity"):
            fit_model(family=family, constraint=Constraint.STRENGTH_EDGES, layers=layers, self_loops=self_loops, spark=spark, **own | {"target_edges": own["target_edges"] + 1})


@pytest.mark.parametrize("self_loops", [True, False])
def test_open_pairs_are_those_that_are_free(self_loops):
    s, s_in = np.array([3.0, 0, 2, 2]), np.array([1.0, 4, 2, 0])
    held = np.array([0, 0, 2, 1]), np.array([1, 1, 2, 0])
    for frozen in ((np.empty(0, np.int64), np.empty(0, np.int64)), held):
        p = Problem(Family.ME, 1, self_loops, s, s_in, edges=2.0, frozen=frozen)
        assert p.open_pairs() == p.free(p.rows, p.cols).sum()
        assert p.collapsed()[0].open_pairs() == p.open_pairs()
