"""How well fits recover their constraints, and the matrix of model cells."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Constraint, Ensemble, Family, Fit, PartialFit
from . import pairs as P
from .stats import constraints_of


def recovery(spark, fit: Fit, targets: dict) -> dict:
    """Largest and relative errors of the expected strengths, degrees, edges and cost against their targets."""
    sums = P.expected_sums(spark, fit).orderBy("node").toPandas()
    out: dict = {}
    for name in ("strength_out", "strength_in", "degree_out", "degree_in"):
        if targets.get(name) is not None and (name.startswith("strength") == (fit.constraint not in (Constraint.DEGREE, Constraint.DEGREE_EVENTS))):
            error = abs(sums[name].to_numpy() - targets[name])
            out[f"max_{name}_error"] = float(error.max(initial=0))
            out[f"rel_{name}_error"] = float(error.max(initial=0) / max(abs(targets[name]).max(initial=0), 1e-300))
    if fit.constraint == Constraint.STRENGTH_EDGES:
        out["edges_error"] = float(sums.degree_out.sum() - targets["target_edges"])
    if fit.constraint == Constraint.DEGREE_EVENTS:
        out["events_error"] = float(sums.strength_out.sum() - targets["total_events"])
    if fit.constraint == Constraint.STRENGTH_COST:
        law = P.law(fit)
        got = P.candidates(spark, fit).agg(F.sum(law.expected() * P.euclidean())).first()[0]
        out["cost_error"] = float(got - targets["target_cost"])
    return out


def partial_recovery(partial: PartialFit, n: int) -> DataFrame:
    """(node, strength_out, strength_in) of a partial fit's rate table."""
    r = partial.rates
    out = r.groupBy(F.col("source").alias("node")).agg(F.sum("rate").alias("strength_out"))
    incoming = r.groupBy(F.col("target").alias("node")).agg(F.sum("rate").alias("strength_in"))
    return r.sparkSession.range(n).withColumnRenamed("id", "node").join(out, "node", "left").join(incoming, "node", "left").fillna(0.0)


def matrix(edges: DataFrame, families=(Family.ME, Family.B, Family.W), constraints=(Constraint.STRENGTH, Constraint.STRENGTH_EDGES, Constraint.STRENGTH_DEGREE, Constraint.DEGREE_EVENTS), layers: int = 1, self_loops: bool = False, coordinates=None, null_samples: int = 0, alpha: float = 0.05, seed: int = 0) -> list[dict]:
    """fit, sample and filter of each cell: seconds, recovery errors and, on null samples, the false-positive rate."""
    from ..plans.router import fit_model, sample_model
    from .filter import classify, observed

    spark, own = edges.sparkSession, constraints_of(edges, coordinates)
    needs = {Constraint.STRENGTH_EDGES: ["target_edges"], Constraint.STRENGTH_DEGREE: ["degree_out", "degree_in"], Constraint.STRENGTH_COST: ["target_cost", "coordinates"], Constraint.STRENGTH: []}
    rows = []
    for family in families:
        for constraint in constraints:
            names = ["degree_out", "degree_in", "total_events"] if constraint == Constraint.DEGREE_EVENTS else ["strength_out", "strength_in", *needs[constraint]]
            row = {"family": str(family), "constraint": str(constraint)}
            try:
                t = time.perf_counter()
                fit = fit_model(family=family, constraint=constraint, layers=layers if family != Family.ME else 1, self_loops=self_loops, spark=spark, **{k: own[k] for k in names})
                row |= {"fit_s": time.perf_counter() - t, "converged": fit.converged, "iterations": fit.iterations} | recovery(spark, fit, own)
                for k in range(null_samples):
                    t = time.perf_counter()
                    sample = sample_model(spark, fit=fit, ensemble=Ensemble.GRAND_CANONICAL, seed=seed + k)
                    marked = classify(observed(sample, fit), alpha, "upper").agg(F.count("*"), F.sum(F.col("is_upper").cast("int"))).first()
                    row["edges"] = row.get("edges", 0) + marked[0]
                    row["upper"] = row.get("upper", 0) + (marked[1] or 0)
                    row["sample_s"] = row.get("sample_s", 0.0) + time.perf_counter() - t
                if row.get("edges"):
                    row["fpr"] = row["upper"] / row["edges"]
            except ValueError as e:
                row["error"] = str(e)
            rows.append(row)
    return rows
