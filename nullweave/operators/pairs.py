"""The candidate-pair relation of a model, and edges with their pair laws.

A pair relation is never cached or collected: it streams through a nested-loop
join with the node table, whose broadcast is checked against `SMALL_NODES`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laws import Law, inflated
from ..schema import Constraint, Fit

#: Nodes up to which a node table (under 60 bytes a row) is broadcast.
SMALL_NODES = 2_000_000

CostExpr = Callable[[str, str], Column]


def small(nodes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(nodes) if n <= SMALL_NODES else nodes


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = nodes.columns
    left = nodes.select(*[F.col(c).alias("source" if c == "node" else f"{c}_i") for c in names])
    right = nodes.select(*[F.col(c).alias("target" if c == "node" else f"{c}_j") for c in names])
    return left, right


def euclidean() -> Column:
    return F.hypot(F.col("cx_i") - F.col("cx_j"), F.col("cy_i") - F.col("cy_j"))


def candidates(spark, fit: Fit, nodes: DataFrame | None = None) -> DataFrame:
    """All candidate pairs with both ends' multipliers; pairs that can't occur are pruned before the join."""
    nodes = fit.nodes(spark) if nodes is None else nodes
    left, right = _sides(nodes)
    left = left.where("x_i > 0").repartition(max(1, min(fit.n, spark.sparkContext.defaultParallelism * 4)), "source")
    right = small(right.where("y_j > 0"), fit.n)
    return left.crossJoin(right) if fit.self_loops else left.join(right, F.col("source") != F.col("target"))


def located(edges: DataFrame, fit: Fit) -> DataFrame:
    """Edges with both ends' multipliers (0 for nodes outside the fit)."""
    left, right = _sides(fit.nodes(edges.sparkSession))
    out = edges.join(small(left, fit.n), "source", "left").join(small(right, fit.n), "target", "left")
    return out.fillna(0.0, [c for c in out.columns if c.endswith(("_i", "_j"))])


def law(fit: Fit, cost: Column | None = None) -> Law:
    """The law of a pair row that carries x_i, y_j and what else the constraint needs."""
    q = F.col("x_i") * F.col("y_j")
    if fit.constraint == Constraint.STRENGTH:
        return Law(fit.family, fit.layers, q)
    if fit.constraint == Constraint.STRENGTH_COST:
        d = euclidean() if cost is None else cost
        return Law(fit.family, fit.layers, q * F.exp(d * -fit.gamma))
    if fit.constraint == Constraint.STRENGTH_EDGES:
        return inflated(fit.family, fit.layers, q, F.lit(fit.lam))
    if fit.constraint == Constraint.STRENGTH_DEGREE:
        return inflated(fit.family, fit.layers, q, F.col("z_i") * F.col("w_j"))
    pi = q / (q + 1)
    scalar = fit.q if fit.constraint == Constraint.DEGREE_EVENTS else 0.0
    if scalar == float("inf"):  # every layer of an occupied pair is taken
        scalar = 1e300
    return Law(fit.family, fit.layers, F.lit(scalar), pi)


def expectations(spark, fit: Fit) -> DataFrame:
    """(source, target, expected, occupation) of all candidate pairs."""
    own = law(fit)
    return candidates(spark, fit).select("source", "target", own.expected().alias("expected"), own.occupation().alias("occupation"))


def expected_sums(spark, fit: Fit) -> DataFrame:
    """(node, strength_out, strength_in, degree_out, degree_in): expected node constraints, partly summed before the shuffle.

    Where pairs differ by their multipliers alone, nodes of equal multipliers are one row with a count."""
    if fit.self_loops and fit.coordinates is None:
        return _sums_by_class(spark, fit)
    pairs = expectations(spark, fit)
    by_source = pairs.groupBy(F.col("source").alias("node")).agg(F.sum("expected").alias("so"), F.sum("occupation").alias("ko"))
    by_target = pairs.groupBy(F.col("target").alias("node")).agg(F.sum("expected").alias("si"), F.sum("occupation").alias("ki"))
    every = spark.range(fit.n).withColumnRenamed("id", "node").join(by_source, "node", "left").join(by_target, "node", "left").fillna(0.0)
    return every.select("node", F.col("so").alias("strength_out"), F.col("si").alias("strength_in"), F.col("ko").alias("degree_out"), F.col("ki").alias("degree_in"))


def _sums_by_class(spark, fit: Fit) -> DataFrame:
    nodes, own = fit.nodes(spark), law(fit)
    out, incoming = (["x"], ["y"]) if fit.z is None else (["x", "z"], ["y", "w"])
    left = nodes.where("x > 0").groupBy(*[F.col(c).alias(f"{c}_i") for c in out]).agg(F.count("*").alias("many_i"))
    right = nodes.where("y > 0").groupBy(*[F.col(c).alias(f"{c}_j") for c in incoming]).agg(F.count("*").alias("many_j"))
    pairs = left.repartition(max(1, min(fit.n, spark.sparkContext.defaultParallelism * 4))).crossJoin(small(right, fit.n))
    pairs = pairs.select(*left.columns, *right.columns, own.expected().alias("expected"), own.occupation().alias("occupation"))

    def sums(keys: list[str], side: str, partners: str) -> DataFrame:
        both = [F.sum(F.col(c) * F.col(partners)).alias(name) for c, name in (("expected", "strength"), ("occupation", "degree"))]
        total = pairs.groupBy(*[F.col(f"{c}_{side}").alias(c) for c in keys]).agg(*both)
        return nodes.select("node", *keys).join(total, keys).select("node", "strength", "degree")

    names = lambda df, end: df.select("node", F.col("strength").alias(f"strength_{end}"), F.col("degree").alias(f"degree_{end}"))
    every = spark.range(fit.n).withColumnRenamed("id", "node")
    every = every.join(names(sums(out, "i", "many_j"), "out"), "node", "left").join(names(sums(incoming, "j", "many_i"), "in"), "node", "left").fillna(0.0)
    return every.select("node", "strength_out", "strength_in", "degree_out", "degree_in")


def free_rates(spark, fit: Fit, known: DataFrame) -> DataFrame:
    """(source, target, rate) of the free pairs with a positive expected weight."""
    own = law(fit)
    rate = own.pi if fit.constraint == Constraint.DEGREE else own.expected()
    pairs = candidates(spark, fit).join(known.select("source", "target"), ["source", "target"], "left_anti")
    return pairs.select("source", "target", rate.alias("rate")).where("rate > 0")


def with_rates(edges: DataFrame, rates: DataFrame, column: str = "rate") -> DataFrame:
    """Edges with the rate of their pair; 0 where the table has none."""
    table = rates.select("source", "target", F.col(column).alias("rate"))
    return edges.join(table, ["source", "target"], "left").fillna(0.0, ["rate"])


def normalised_rates(probabilities: DataFrame, total_events: float) -> DataFrame:
    """rate = T p / sum of p."""
    total = probabilities.agg(F.sum("probability").alias("_sum"))  # one row
    return probabilities.join(F.broadcast(total)).where("_sum > 0").select("source", "target", (F.col("probability") * float(total_events) / F.col("_sum")).alias("rate"))
