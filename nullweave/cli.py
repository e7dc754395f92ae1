"""Command line: nullweave fit|sample|filter|summary."""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import SparkSession

from . import __version__
from .operators.stats import constraints_of, directed_strengths
from .plans.router import filter_model, fit_model, sample_model
from .schema import Constraint, Ensemble, Family
from .sources import edges as IO


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nullweave", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def model(v, network: bool = True):
        if network:
            v.add_argument("edges", help="CSV, TSV, Parquet, Arrow IPC, GraphML, Matrix Market or Pajek")
        v.add_argument("--family", type=Family, default=Family.ME, choices=list(Family))
        v.add_argument("--constraint", type=Constraint, default=Constraint.STRENGTH, choices=list(Constraint))
        v.add_argument("--layers", type=int, default=1)
        v.add_argument("--no-self-loops", action="store_true")
        v.add_argument("--coordinates", help="table with x, y (and node): for strength_cost")
        v.add_argument("--tolerance", type=float, default=1e-8)
        v.add_argument("--output", "-o")
        return v

    model(verbs.add_parser("fit", help="multipliers of a network's constraints, as JSON"))
    s = model(verbs.add_parser("sample", help="a network drawn from the fitted model"))
    s.add_argument("--ensemble", type=Ensemble, default=Ensemble.GRAND_CANONICAL, choices=list(Ensemble))
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--custom", help="multinomial or poisson: `edges` is a probability table", choices=["poisson", "multinomial"])
    s.add_argument("--total-events", type=int)
    f = model(verbs.add_parser("filter", help="edges that the model can't explain"))
    f.add_argument("--alpha", type=float, default=0.05)
    f.add_argument("--tail", default="two-sided", choices=["upper", "lower", "two-sided"])
    f.add_argument("--correction", default="none", choices=["none", "bonferroni", "fdr"])
    f.add_argument("--detect-absent", action="store_true")
    f.add_argument("--max-absent", type=int)
    f.add_argument("--rates", help="table of Poisson rates instead of a fit")
    verbs.add_parser("summary", help="nodes, edges and weights").add_argument("edges")
    return p


def _fitted(a, spark, edges):
    own = constraints_of(edges, None if not a.coordinates else np.array([(r.cx, r.cy) for r in IO.read_coordinates(spark, a.coordinates).orderBy("node").collect()]))
    names = {
        Constraint.STRENGTH: ["strength_out", "strength_in"],
        Constraint.STRENGTH_COST: ["strength_out", "strength_in", "target_cost", "coordinates"],
        Constraint.STRENGTH_EDGES: ["strength_out", "strength_in", "target_edges"],
        Constraint.STRENGTH_DEGREE: ["strength_out", "strength_in", "degree_out", "degree_in"],
        Constraint.DEGREE_EVENTS: ["degree_out", "degree_in", "total_events"],
        Constraint.DEGREE: ["degree_out", "degree_in"],
    }[a.constraint]
    if a.constraint == Constraint.STRENGTH_COST and not a.coordinates:
        raise SystemExit("strength_cost needs --coordinates")
    return fit_model(family=a.family, constraint=a.constraint, layers=a.layers, self_loops=not a.no_self_loops, tolerance=a.tolerance, spark=spark, **{k: own[k] for k in names})


def _json(fit) -> str:
    arrays = {k: getattr(fit, k).tolist() for k in ("x", "y", "z", "w") if getattr(fit, k) is not None}
    return json.dumps(arrays | {"family": fit.family, "constraint": fit.constraint, "layers": fit.layers, "self_loops": fit.self_loops, "gamma": fit.gamma, "lambda": fit.lam, "q": None if np.isnan(fit.q) else fit.q, "converged": fit.converged, "iterations": fit.iterations, "status": fit.status})


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("nullweave").getOrCreate()
    try:
        if a.verb == "summary":
            out.write(IO.summary(IO.read_edges(spark, a.edges)))
            return 0
        if a.verb == "fit":
            text = _json(_fitted(a, spark, IO.read_edges(spark, a.edges)))
            if a.output:
                with open(a.output, "w") as f:
                    f.write(text)
            else:
                out.write(text + "\n")
            return 0
        if a.verb == "sample":
            if a.custom:
                from .operators.sample import custom_multinomial, custom_poisson

                if a.total_events is None:
                    raise ValueError("--custom needs --total-events")
                table = IO.read_probabilities(spark, a.edges)
                got = (custom_poisson if a.custom == "poisson" else custom_multinomial)(table, a.total_events, a.seed)
            else:
                edges = IO.read_edges(spark, a.edges)
                micro = a.ensemble == Ensemble.MICROCANONICAL
                got = sample_model(spark, fit=None if micro else _fitted(a, spark, edges), ensemble=a.ensemble, seed=a.seed, total_events=a.total_events, strengths=directed_strengths(edges) if micro else None)
            if a.output:
                IO.write_edges(got, a.output)
            else:
                out.write("source,target,weight\n" + "".join(f"{r.source},{r.target},{r.weight}\n" for r in got.orderBy("source", "target").toLocalIterator()))
            return 0
        edges = IO.read_edges(spark, a.edges)
        rates = IO.read_rates(spark, a.rates) if a.rates else None
        result = filter_model(edges, fit=None if a.rates else _fitted(a, spark, edges), rates=rates, alpha=a.alpha, tail=a.tail, correction=a.correction, detect_absent=a.detect_absent, max_absent=a.max_absent)
        if a.output:
            IO.write_groups(result, a.output)
        else:
            counts = result.selectExpr("sum(int(is_upper)) up", "sum(int(is_lower and not is_absent)) low", "sum(int(compatible)) same", "sum(int(is_absent)) gone").first()
            out.write(f"upper: {counts.up}\nlower: {counts.low}\ncompatible: {counts.same}\nabsent_lower: {counts.gone}\n")
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
