"""Filters: which observed pairs, and which absent ones, the null model can't explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.laws import Law, conditional
from ..schema import Family, Fit
from ..storage import global_row_number, stored
from . import pairs as P

COLUMNS = ("source", "target", "weight", "upper_pvalue", "lower_pvalue", "expected", "occupation")


def tail_alphas(alpha: float, tail: str) -> tuple[float, float]:
    """(upper, lower) significance levels."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    if tail == "upper":
        return alpha, 0.0
    if tail == "lower":
        return 0.0, alpha
    if tail == "two-sided":
        return alpha / 2, alpha / 2
    raise ValueError(f"unknown tail {tail!r}")


def _scored(rows: DataFrame, law: Law, keep: tuple = ()) -> DataFrame:
    w = F.col("weight")
    scored = rows.select(*keep, "source", "target", "weight", law.upper(w).alias("_up"), law.lower(w).alias("_low"), law.expected().alias("expected"), law.occupation().alias("occupation"))
    up, low = conditional(F.col("_up"), F.col("_low"), F.col("occupation"))
    return scored.select(*keep, "source", "target", "weight", up.alias("upper_pvalue"), low.alias("lower_pvalue"), "expected", "occupation")


def observed(edges: DataFrame, fit: Fit, keep: tuple = ()) -> DataFrame:
    """p-values of observed edges given that they exist, beside the columns to `keep`; the law holds on the diagonal too, even where the fit has no self-loops."""
    return _scored(P.located(edges, fit), P.law(fit), keep)


def observed_custom(edges: DataFrame, rates: DataFrame, column: str = "rate") -> DataFrame:
    """The same under given Poisson rates (0 for pairs that the table lacks)."""
    return _scored(P.with_rates(edges, rates, column), Law(Family.ME, 1, F.col("rate")))


def absent(pairs: DataFrame, law: Law, edges: DataFrame, alpha_lower: float, min_occupation: float = 0.5, min_expected: float = 0.0, max_absent: int | None = None) -> DataFrame:
    """Unobserved candidate pairs whose absence is significant: P(0) below the lower alpha."""
    scored = pairs.select("source", "target", law.expected().alias("expected"), law.occupation().alias("occupation"))
    # cheap predicates first, then the anti-join with what was observed
    likely = scored.where((F.col("occupation") >= min_occupation) & (F.col("expected") >= min_expected) & (F.lit(1.0) - F.col("occupation") < alpha_lower))
    found = likely.join(edges.select("source", "target"), ["source", "target"], "left_anti")
    out = found.select("source", "target", F.lit(0).cast("bigint").alias("weight"), F.lit(1.0).alias("upper_pvalue"), (F.lit(1.0) - F.col("occupation")).alias("lower_pvalue"), "expected", "occupation")
    return out if max_absent is None else out.orderBy("source", "target").limit(max_absent)


def benjamini_hochberg(scored: DataFrame, column: str, alpha: float, name: str) -> DataFrame:
    """Adds the boolean `name`: p at or below the largest p with p <= alpha rank / m."""
    if alpha <= 0:
        return scored.withColumn(name, F.lit(False))
    counted = scored.groupBy(column).agg(F.count("*").alias("_n"))  # equal p-values share their last rank
    ranked = global_row_number(counted, [column], "_order")
    m = scored.count()
    ranks = _running(ranked, "_order", "_n", "_rank")
    cut = ranks.where(F.col(column) <= F.col("_rank") * (alpha / max(1, m))).agg(F.max(column).alias("_cut"))  # one row
    return scored.join(F.broadcast(cut)).withColumn(name, F.coalesce(F.col(column) <= F.col("_cut"), F.lit(False))).drop("_cut")


def _running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum of `value` in the order of the dense integer column `order`, by blocks of rows."""
    from pyspark.sql import Window

    size = 100_000
    blocked = df.withColumn("_block", F.floor((F.col(order) - 1) / size))
    before, rows = 0, []
    for block, n in sorted(map(tuple, blocked.groupBy("_block").agg(F.sum(value)).collect())):
        rows.append((block, before))
        before += n
    shift = df.sparkSession.createDataFrame(rows, "_block long, _shift long")
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocked.join(F.broadcast(shift), "_block").withColumn(name, F.col("_shift") + within).drop("_block", "_shift")


def classify(scored: DataFrame, alpha: float = 0.05, tail: str = "two-sided", correction: str = "none") -> DataFrame:
    """Adds is_upper, is_lower (an edge may be both) and compatible (neither)."""
    up, low = tail_alphas(alpha, tail)
    if correction == "none":
        out = scored.withColumn("is_upper", F.col("upper_pvalue") < up).withColumn("is_lower", F.col("lower_pvalue") < low)
    elif correction == "bonferroni":  # both tails of each edge count, whichever is asked for
        n = scored.agg(F.greatest(F.lit(1), F.count("*") * 2).alias("_n"))  # one row
        out = scored.join(F.broadcast(n)).withColumn("is_upper", F.col("upper_pvalue") < F.lit(up) / F.col("_n")).withColumn("is_lower", F.col("lower_pvalue") < F.lit(low) / F.col("_n")).drop("_n")
    elif correction == "fdr":
        scored = stored(scored, "scored")  # read by both tails
        out = benjamini_hochberg(benjamini_hochberg(scored, "upper_pvalue", up, "is_upper"), "lower_pvalue", low, "is_lower")
    else:
        raise ValueError(f"unknown correction {correction!r}")
    return out.withColumn("compatible", ~(F.col("is_upper") | F.col("is_lower"))).withColumn("is_absent", F.lit(False))


def with_absent(classified: DataFrame, missing: DataFrame) -> DataFrame:
    extra = missing.withColumns({"is_upper": F.lit(False), "is_lower": F.lit(True), "compatible": F.lit(False), "is_absent": F.lit(True)})
    return classified.unionByName(extra)


def groups(result: DataFrame) -> dict[str, DataFrame]:
    """The four tables upper, lower, compatible and absent_lower."""
    seen = result.where(~F.col("is_absent"))
    return {
        "upper": seen.where("is_upper").select(*COLUMNS),
        "lower": seen.where("is_lower").select(*COLUMNS),
        "compatible": seen.where("compatible").select(*COLUMNS),
        "absent_lower": result.where("is_absent").select(*COLUMNS),
    }


def false_positive_rate(classified: DataFrame) -> DataFrame:
    """Share of upper-significant edges (one row), for edges of samples of the null model itself."""
    return classified.agg(F.coalesce(F.avg(F.col("is_upper").cast("double")), F.lit(0.0)).alias("fpr"))
