"""Averages over samples: any function of a rep-tagged edge table is a statistic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensemble_average(samples: DataFrame, statistic: Callable[[DataFrame], DataFrame], repetitions: int) -> DataFrame:
    """(node, mean, std) over samples of a per-node statistic, with the population deviation.

    `statistic` turns (rep, source, target, weight) rows into (rep, node, value); a
    node that a sample lacks counts as 0 there."""
    got = statistic(samples).groupBy("node").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    mean = F.col("s") / repetitions
    return got.select("node", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / repetitions - mean * mean, F.lit(0.0))).alias("std"))


def ensemble_scalar_average(samples: DataFrame, statistic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(mean, std) over samples of a (rep, value) statistic, with the sample deviation (0 below two samples)."""
    got = statistic(samples).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    return got.select(F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("d", F.lit(0.0)).alias("std"))


def percentiles(samples: DataFrame, statistic: Callable[[DataFrame], DataFrame], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(node, low, high): exact percentiles of a per-node statistic over samples."""
    p = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return statistic(samples).groupBy("node").agg(p.alias("p")).select("node", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def out_strength(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rep", F.col("source").alias("node")).agg(F.sum("weight").cast("double").alias("value"))


def in_strength(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rep", F.col("target").alias("node")).agg(F.sum("weight").cast("double").alias("value"))


def events(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rep").agg(F.sum("weight").cast("double").alias("value"))
