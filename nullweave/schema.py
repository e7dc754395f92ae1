"""Names, schemas, fit results and input checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import StrEnum

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("source", "target", "weight")])
PROBABILITIES = T.StructType([T.StructField("source", T.LongType(), False), T.StructField("target", T.LongType(), False), T.StructField("probability", T.DoubleType(), False)])
RATES = T.StructType([T.StructField("source", T.LongType(), False), T.StructField("target", T.LongType(), False), T.StructField("rate", T.DoubleType(), False)])


class Verb(StrEnum):
    FIT = "fit"
    SAMPLE = "sample"
    FILTER = "filter"


class Ensemble(StrEnum):
    MICROCANONICAL = "microcanonical"
    CANONICAL = "canonical"
    GRAND_CANONICAL = "grand_canonical"


class Family(StrEnum):
    """Pair laws: Poisson (ME), binomial of M layers (B), negative binomial of M layers (W; M = 1 is geometric)."""

    ME = "me"
    B = "b"
    W = "w"


class Constraint(StrEnum):
    STRENGTH = "strength"
    STRENGTH_COST = "strength_cost"
    STRENGTH_EDGES = "strength_edges"
    STRENGTH_DEGREE = "strength_degree"
    DEGREE_EVENTS = "degree_events"
    #: Bernoulli degrees alone: the first half of DEGREE_EVENTS.
    DEGREE = "degree"


class UnsupportedModelCaseError(ValueError):
    """A cell of verb x ensemble x family x constraint that has no model."""


@dataclass(frozen=True)
class Diagnostics:
    status: str = "solved"
    objective: float = math.nan
    max_strength_residual: float = 0.0
    total_strength_residual: float = 0.0
    max_degree_residual: float = 0.0
    edges_residual: float = 0.0
    cost_residual: float = 0.0
    min_margin: float = math.inf  # of 1 - q over all pairs (W)
    max_q: float = 0.0
    boundary: bool = False


@dataclass(frozen=True)
class Fit:
    """Multipliers of a fitted model: node arrays x, y (and z, w) and scalars gamma, lam, q."""

    constraint: Constraint
    family: Family
    layers: int
    self_loops: bool
    x: np.ndarray
    y: np.ndarray
    z: np.ndarray | None = None
    w: np.ndarray | None = None
    gamma: float = 0.0
    lam: float = 1.0
    q: float = math.nan
    positive_mean: float = math.nan
    coordinates: np.ndarray | None = None
    converged: bool = True
    iterations: int = 0
    diagnostics: Diagnostics = field(default_factory=Diagnostics)

    @property
    def n(self) -> int:
        return len(self.x)

    @property
    def status(self) -> str:
        return self.diagnostics.status

    def nodes(self, spark) -> DataFrame:
        """(node, x, y[, z, w][, cx, cy]): the small side of every pair join."""
        columns = {"node": np.arange(self.n), "x": self.x, "y": self.y}
        if self.z is not None:
            columns |= {"z": self.z, "w": self.w}
        if self.coordinates is not None:
            columns |= {"cx": self.coordinates[:, 0], "cy": self.coordinates[:, 1]}
        rows = [tuple(v.item() for v in r) for r in zip(*columns.values())]
        return spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'node' else 'double'}" for c in columns))


@dataclass(frozen=True)
class PartialFit:
    """Known pairs and free pairs with their expected weights, as one rate table."""

    rates: DataFrame
    free: Fit | None
    converged: bool
    status: str = "solved"

    def as_probability_table(self) -> DataFrame:
        return self.rates.withColumnRenamed("rate", "probability")


def normalize_edges(df: DataFrame, check: bool = True) -> DataFrame:
    """(source, target, weight) as longs: whole, non-negative weights; rows of weight 0 go; other columns go."""
    missing = [c for c in ("source", "target", "weight") if c not in df.columns]
    if missing:
        raise ValueError(f"edge tables need the columns source, target and weight; missing: {missing}")
    if check:
        bad = F.col("weight").isNull() | (F.col("weight") < 0) | (F.col("weight") != F.floor("weight")) | F.col("source").isNull() | F.col("target").isNull() | (F.col("source") < 0) | (F.col("target") < 0)
        if df.where(bad).limit(1).count():
            raise ValueError("ids must be non-negative and weights non-negative integers")
    return df.where("weight > 0").select(*[F.col(c).cast("bigint").alias(c) for c in ("source", "target", "weight")])


def normalize_probabilities(df: DataFrame, check: bool = True) -> DataFrame:
    """(source, target, probability) in [0, 1], zeros dropped, pairs unique."""
    out = df.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), F.col("probability").cast("double").alias("probability"))
    if check:
        if out.where("probability is null or isnan(probability) or probability < 0 or probability > 1").limit(1).count():
            raise ValueError("probabilities must lie in [0, 1]")
        if out.groupBy("source", "target").count().where("count > 1").limit(1).count():
            raise ValueError("duplicate pairs in a probability table")
    return out.where("probability > 0")


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """Merges rows of the same pair (statistics otherwise keep repeated rows, as bags)."""
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def capacity(n: int, self_loops: bool) -> int:
    return n * n if self_loops else n * (n - 1)


def check_balanced(out: np.ndarray, incoming: np.ndarray, what: str) -> None:
    if len(out) != len(incoming):
        raise ValueError(f"{what}: out and in must have equal length")
    if not (np.isfinite(out).all() and np.isfinite(incoming).all()):
        raise ValueError(f"{what} must be finite")
    if (out < 0).any() or (incoming < 0).any():
        raise ValueError(f"{what} must be non-negative")
    if not math.isclose(out.sum(), incoming.sum(), rel_tol=1e-9, abs_tol=1e-6):
        raise ValueError(f"{what}: sums are not balanced ({out.sum()} and {incoming.sum()})")


def check_binomial(out: np.ndarray, incoming: np.ndarray, layers: int, self_loops: bool) -> None:
    most = layers * (len(out) if self_loops else len(out) - 1)
    if len(out) and max(out.max(), incoming.max()) > most:
        raise ValueError(f"infeasible: a strength exceeds layers x partners = {most}")


def check_edges(target: float, events: float, n: int, self_loops: bool) -> None:
    if not math.isfinite(target) or target <= 0:
        raise ValueError("target_edges must be finite and positive")
    if target > events:
        raise ValueError("infeasible: more edges than events")
    if target > capacity(n, self_loops):
        raise ValueError("infeasible: target_edges exceeds the candidate-pair capacity")


def check_degrees(k_out: np.ndarray, k_in: np.ndarray, self_loops: bool) -> None:
    most = len(k_out) if self_loops else len(k_out) - 1
    if len(k_out) and max(k_out.max(), k_in.max()) > most:
        raise ValueError(f"infeasible: a degree exceeds the candidate-pair capacity {most}")


def check_strength_degree(s_out, s_in, k_out, k_in) -> None:
    if not len(s_out) == len(k_out) == len(s_in) == len(k_in):
        raise ValueError("strengths and degrees must have equal length")
    if (s_out < k_out).any() or (s_in < k_in).any():
        raise ValueError("infeasible: a strength is below its degree")


def check_coordinates(coordinates, n: int, metric: str = "euclidean") -> np.ndarray:
    if metric != "euclidean":
        raise ValueError("the only coordinate metric is euclidean")
    c = np.asarray(coordinates, float)
    if c.shape != (n, 2):
        raise ValueError("coordinates must have the length of the strengths")
    if not np.isfinite(c).all():
        raise ValueError("coordinates must be finite")
    return c
