"""The three verbs over the model cells: fit_model, sample_model, filter_model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import filter as FO
from ..operators import fit as FIT
from ..operators import pairs as P
from ..operators import sample as SMP
from ..operators.stats import constraints_of
from ..schema import Constraint, Ensemble, Family, Fit, PartialFit, UnsupportedModelCaseError, Verb


def route(verb: Verb, *args, **kwargs):
    return {Verb.FIT: fit_model, Verb.SAMPLE: sample_model, Verb.FILTER: filter_model}[Verb(verb)](*args, **kwargs)


def fit_model(*, family: Family, constraint: Constraint, ensemble: Ensemble = Ensemble.GRAND_CANONICAL, known: DataFrame | None = None, spark: SparkSession | None = None, **options) -> Fit | PartialFit:
    """Multipliers from constraints; with a `known` (source, target, rate) table, a partial fit."""
    family, constraint, ensemble = Family(family), Constraint(constraint), Ensemble(ensemble)
    if known is not None:
        return FIT.partial_fit(spark or known.sparkSession, constraint, family, known, **options)
    if ensemble == Ensemble.MICROCANONICAL:
        raise UnsupportedModelCaseError("the microcanonical ensemble needs no fit")
    if ensemble == Ensemble.CANONICAL and (family != Family.ME or constraint != Constraint.STRENGTH):
        raise UnsupportedModelCaseError("the canonical ensemble has ME strengths only")
    return FIT.fit(constraint, family, spark=spark, **options)


def sample_model(spark: SparkSession, *, fit: Fit | None = None, ensemble: Ensemble = Ensemble.GRAND_CANONICAL, seed: int = 0, total_events: int | None = None, strengths: DataFrame | None = None) -> DataFrame:
    """A (source, target, weight) sample."""
    return SMP.sample(spark, fit, ensemble, seed, total_events, strengths)


def filter_model(
    edges: DataFrame,
    *,
    family: Family = Family.ME,
    constraint: Constraint = Constraint.STRENGTH,
    fit: Fit | None = None,
    rates: DataFrame | None = None,
    layers: int = 1,
    self_loops: bool = True,
    alpha: float = 0.05,
    tail: str = "two-sided",
    correction: str = "none",
    detect_absent: bool = False,
    min_occupation: float = 0.5,
    min_expected: float = 0.0,
    max_absent: int | None = None,
    coordinates=None,
) -> DataFrame:
    """Edges (and absent pairs) with p-values and classes, as one table; `filter.groups` splits it.

    Without a fit, one is made from the network's own constraints; with `rates`
    (source, target, rate) the pairs follow Poisson laws at those rates."""
    spark = edges.sparkSession
    if rates is not None:
        scored = FO.observed_custom(edges, rates)
    else:
        if fit is None:
            own = constraints_of(edges, coordinates)
            needs = {
                Constraint.STRENGTH: ("strength_out", "strength_in"),
                Constraint.STRENGTH_COST: ("strength_out", "strength_in", "target_cost", "coordinates"),
                Constraint.STRENGTH_EDGES: ("strength_out", "strength_in", "target_edges"),
                Constraint.STRENGTH_DEGREE: ("strength_out", "strength_in", "degree_out", "degree_in"),
                Constraint.DEGREE_EVENTS: ("degree_out", "degree_in", "total_events"),
                Constraint.DEGREE: ("degree_out", "degree_in"),
            }[Constraint(constraint)]
            fit = FIT.fit(constraint, family, layers=layers, self_loops=self_loops, spark=spark, **{k: own[k] for k in needs})
        scored = FO.observed(edges, fit)
    result = FO.classify(scored, alpha, tail, correction)
    if not detect_absent:
        return result
    low = FO.tail_alphas(alpha, tail)[1]
    if rates is not None:
        from pyspark.sql import functions as F

        from ..functions.laws import Law

        pairs, law = rates.where("rate > 0"), Law(Family.ME, 1, F.col("rate"))
    else:
        pairs, law = P.candidates(spark, fit), P.law(fit)
    return FO.with_absent(result, FO.absent(pairs, law, edges, low, min_occupation, min_expected, max_absent))
