"""Fits: constraints to multipliers (closed forms where there are any, else the dual)."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..schema import Constraint, Diagnostics, Family, Fit, PartialFit
from .dual import BOUND, Problem, solve

HUGE = 1e30


def array(x, what: str) -> np.ndarray:
    if x is None:
        raise TypeError(f"this constraint needs {what}")
    return np.asarray(x, float)


def _multiplier(logs: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Multipliers of logarithms; at the bound they stand for infinity."""
    return np.where(on, np.where(logs >= BOUND - 1e-9, HUGE, np.exp(logs)), 0.0)


def _result(p: Problem, s, constraint: Constraint, coordinates=None) -> Fit:
    t, at = s.theta, p.slices
    strength = np.abs(s.expected[: 2 * p.n] - p.targets[: 2 * p.n])
    degree = np.abs(s.expected[at["n"].start : at["o"].stop] - p.targets[at["n"].start : at["o"].stop]).max(initial=0) if "n" in at else 0.0
    a, b = t[at["a"]], t[at["b"]]
    top = float(np.exp(a[p.rows].max() + b[p.cols].max())) if len(p.rows) and len(p.cols) else 0.0
    gamma = float(t[at["gamma"]][0]) / p.scale if "gamma" in at else 0.0
    cost = float(-s.expected[at["gamma"]][0] * p.scale) if "gamma" in at else 0.0
    infeasible = "gamma" in at and gamma <= 0 and not p.signed_gamma and abs(cost - p.cost) > 1e-6 * max(p.cost, 1e-300)
    converged = s.converged and not infeasible
    d = Diagnostics(
        status="infeasible_cost" if infeasible else "solved" if converged else "not_converged",
        objective=s.objective,
        max_strength_residual=float(strength.max(initial=0)),
        total_strength_residual=float(strength.sum()),
        max_degree_residual=float(degree),
        edges_residual=float(s.expected[at["lam"]][0] - p.edges) if "lam" in at else 0.0,
        cost_residual=cost - p.cost if "gamma" in at else 0.0,
        min_margin=1 - top if p.family == Family.W else math.inf,
        max_q=top,
        boundary=bool((np.abs(t) >= BOUND - 1e-9)[np.abs(p.targets) > 0].any()),
    )
    if not converged:
        warnings.warn(f"{constraint} fit of family {p.family}: {d.status} after {s.iterations} iterations (residual {s.residual:.2e})", stacklevel=3)
    on_out, on_in = p.targets[at["a"]] > 0, p.targets[at["b"]] > 0
    z = w = None
    if "n" in at:
        z, w = _multiplier(t[at["n"]], p.k_out > 0), _multiplier(t[at["o"]], p.k_in > 0)
    lam = float(_multiplier(t[at["lam"]], True)[0]) if "lam" in at else 1.0
    return Fit(constraint, p.family, p.layers, p.self_loops, _multiplier(a, on_out), _multiplier(b, on_in), z, w, gamma, lam, coordinates=coordinates, converged=converged, iterations=s.iterations, diagnostics=d)


def closed_form(s_out: np.ndarray, s_in: np.ndarray) -> Fit:
    """ME strengths with self-loops: x = s_out / sqrt(T), y = s_in / sqrt(T)."""
    root = math.sqrt(s_out.sum()) or 1.0
    return Fit(Constraint.STRENGTH, Family.ME, 1, True, s_out / root, s_in / root)


def strength_multipliers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, x, y) of the closed form, as a DataFrame of any size: nothing is collected."""
    from .stats import directed_strengths

    s = directed_strengths(edges) if nodes is None else nodes
    total = s.agg(F.sqrt(F.sum("out").cast("double")).alias("root"))
    scaled = s.join(F.broadcast(total))  # one row
    ratio = lambda c: F.when(F.col("root") > 0, F.col(c) / F.col("root")).otherwise(F.lit(0.0))
    return scaled.select("node", ratio("out").alias("x"), ratio("incoming").alias("y"))


def fit(
    constraint: Constraint,
    family: Family,
    strength_out=None,
    strength_in=None,
    degree_out=None,
    degree_in=None,
    total_events: float | None = None,
    target_edges: float | None = None,
    target_cost: float | None = None,
    coordinates=None,
    layers: int = 1,
    self_loops: bool = True,
    tolerance: float = 1e-8,
    max_iterations: int = 10_000,
    signed_gamma: bool = False,
    frozen=None,
    spark=None,
) -> Fit:
    """Multipliers whose expected values meet the constraints; `frozen` pairs (two index arrays) are left out of the support."""
    constraint, family = Constraint(constraint), Family(family)
    if layers < 1:
        raise ValueError("layers must be 1 at least")
    if constraint in (Constraint.DEGREE, Constraint.DEGREE_EVENTS):
        return _degrees(constraint, family, array(degree_out, "degree_out"), array(degree_in, "degree_in"), total_events, layers, self_loops, tolerance, max_iterations, frozen, spark)
    s_out, s_in = array(strength_out, "strength_out"), array(strength_in, "strength_in")
    S.check_balanced(s_out, s_in, "strengths")
    extra: dict = {}
    if constraint == Constraint.STRENGTH_EDGES:
        if target_edges is None:
            raise TypeError("this constraint needs target_edges")
        S.check_edges(target_edges, s_out.sum(), len(s_out), self_loops)
        extra["edges"] = float(target_edges)
    if constraint == Constraint.STRENGTH_DEGREE:
        k_out, k_in = array(degree_out, "degree_out"), array(degree_in, "degree_in")
        S.check_strength_degree(s_out, s_in, k_out, k_in)
        S.check_balanced(k_out, k_in, "degrees")
        S.check_degrees(k_out, k_in, self_loops)
        extra |= {"k_out": k_out, "k_in": k_in}
    if constraint == Constraint.STRENGTH_COST:
        if target_cost is None or coordinates is None:
            raise TypeError("this constraint needs target_cost and coordinates")
        if not math.isfinite(target_cost) or target_cost < 0:
            raise ValueError("target_cost must be finite and non-negative")
        coordinates = S.check_coordinates(coordinates, len(s_out))
        extra |= {"cost": float(target_cost), "coordinates": coordinates, "signed_gamma": signed_gamma}
    if family == Family.B:
        S.check_binomial(s_out, s_in, layers, self_loops)
    if constraint == Constraint.STRENGTH and family == Family.ME and self_loops and frozen is None:
        return closed_form(s_out, s_in)
    if frozen is not None:
        extra["frozen"] = tuple(np.asarray(x, np.int64) for x in frozen)
    p = Problem(family, layers, self_loops, s_out, s_in, **extra)
    start = None
    if constraint != Constraint.STRENGTH:  # warm start: the strength fit of the same support
        plain = Problem(family, layers, self_loops, s_out, s_in, frozen=p.frozen)
        if constraint == Constraint.STRENGTH_COST:
            first = solve(plain, spark, 1e-6, 500)
            start = p.start()
            start[: 2 * p.n] = first.theta
    s = solve(p, spark, tolerance, max_iterations, start)
    return _result(p, s, constraint, coordinates if constraint == Constraint.STRENGTH_COST else None)


def _degrees(constraint, family, k_out, k_in, events, layers, self_loops, tolerance, iterations, frozen, spark) -> Fit:
    """Bernoulli degrees, and for DEGREE_EVENTS a positive law of one q for all pairs."""
    S.check_balanced(k_out, k_in, "degrees")
    S.check_degrees(k_out, k_in, self_loops)
    q = mu = math.nan
    if constraint == Constraint.DEGREE_EVENTS:
        if events is None:
            raise TypeError("this constraint needs total_events")
        if events < k_out.sum():
            raise ValueError("infeasible: fewer events than edges")
        mu = events / k_out.sum() if k_out.sum() else 1.0
        q = K.solve_positive_mean(family, layers, mu)
    extra = {} if frozen is None else {"frozen": tuple(np.asarray(x, np.int64) for x in frozen)}
    p = Problem(family, layers, self_loops, k_out, k_in, k_out=k_out, k_in=k_in, bernoulli=True, **extra)
    s = solve(p, spark, tolerance, iterations)
    got = _result(p, s, constraint)
    return Fit(**{**got.__dict__, "q": q, "positive_mean": mu})


def _balanced(out: np.ndarray, incoming: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a rounding difference to the largest entry of the deficient side."""
    out, incoming = out.copy(), incoming.copy()
    gap = out.sum() - incoming.sum()
    side = incoming if gap > 0 else out
    if len(side):
        side[side.argmax()] += abs(gap)
    return out, incoming


def partial_fit(spark, constraint: Constraint, family: Family, known: DataFrame, *, layers: int = 1, self_loops: bool = True, **targets) -> PartialFit:
    """Freezes the known (source, target, rate) pairs, fits the excess on the free pairs, and returns all rates.

    `known` is a bounded input (the caller's list of pairs, held on the driver like the node constraints)."""
    from .pairs import free_rates

    constraint, family = Constraint(constraint), Family(family)
    if constraint == Constraint.DEGREE_EVENTS:
        raise S.UnsupportedModelCaseError("DEGREE_EVENTS has no partial fit")
    held = known.groupBy("source", "target").agg(F.sum("rate").alias("rate"), F.count("*").alias("c")).toPandas()
    if (held.c > 1).any():
        raise ValueError("duplicate known pairs")
    src, dst, rate = held.source.to_numpy(np.int64), held.target.to_numpy(np.int64), held.rate.to_numpy(float)
    sides = [("strength_out", src, rate), ("strength_in", dst, rate)]
    if constraint in (Constraint.STRENGTH_DEGREE, Constraint.DEGREE):
        sides += [("degree_out", src, np.ones(len(src))), ("degree_in", dst, np.ones(len(src)))]
    if constraint == Constraint.DEGREE:
        sides = sides[2:]
    n = max([len(targets[name]) for name, _, _ in sides] + [int(src.max(initial=-1)) + 1, int(dst.max(initial=-1)) + 1])
    excess = {}
    for name, at, amount in sides:
        full = np.zeros(n)
        full[: len(targets[name])] = array(targets[name], name)
        left = full - np.bincount(at, amount, n)
        if (left < -1e-6).any():
            raise ValueError(f"infeasible: known pairs exceed {name}")
        excess[name] = np.maximum(left, 0)
    for a, b in (("strength_out", "strength_in"), ("degree_out", "degree_in")):
        if a in excess:
            excess[a], excess[b] = _balanced(excess[a], excess[b])
    coordinates = None
    if constraint == Constraint.STRENGTH_EDGES:
        excess["target_edges"] = max(float(targets["target_edges"]) - len(src), 0.0)
    if constraint == Constraint.STRENGTH_COST:
        coordinates = S.check_coordinates(targets["coordinates"], n)
        spent = float((rate * np.hypot(*(coordinates[src] - coordinates[dst]).T)).sum()) if len(src) else 0.0
        excess |= {"target_cost": max(float(targets["target_cost"]) - spent, 0.0), "coordinates": coordinates}
    known = known.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), F.col("rate").cast("double").alias("rate"))
    first = excess.get("strength_out", excess.get("degree_out"))
    if first.sum() <= 0 or constraint == Constraint.STRENGTH_EDGES and excess["target_edges"] <= 0:
        return PartialFit(known.where("rate > 0"), None, first.sum() <= 0, "known_only")
    free = fit(constraint, family, layers=layers, self_loops=self_loops, frozen=(src, dst), spark=spark, **excess, **{k: targets[k] for k in ("tolerance", "max_iterations", "signed_gamma") if k in targets})
    rates = known.where("rate > 0").unionByName(free_rates(spark, free, known))
    return PartialFit(rates, free, free.converged, free.status)


def fit_from_cutoff(edges: DataFrame, cutoff: float, constraint: Constraint, family: Family = Family.ME, coordinates=None, **options) -> PartialFit:
    """Freezes all pairs whose weight exceeds the cutoff and fits the rest to the network's own constraints."""
    from .stats import constraints_of

    spark = edges.sparkSession
    targets = constraints_of(edges, coordinates)
    known = edges.where(F.col("weight") > cutoff).select("source", "target", F.col("weight").cast("double").alias("rate"))
    if Constraint(constraint) == Constraint.DEGREE:
        known = known.withColumn("rate", F.lit(1.0))
    wanted = {Constraint.STRENGTH: (), Constraint.DEGREE: ("degree_out", "degree_in"), Constraint.STRENGTH_DEGREE: ("degree_out", "degree_in"), Constraint.STRENGTH_EDGES: ("target_edges",), Constraint.STRENGTH_COST: ("target_cost", "coordinates")}
    names = (() if Constraint(constraint) == Constraint.DEGREE else ("strength_out", "strength_in")) + wanted[Constraint(constraint)]
    return partial_fit(spark, constraint, family, known, **{k: targets[k] for k in names}, **options)
