"""Samples of fitted models.

Every draw is keyed by (seed, pair or event), so a seed gives the same network
however the rows are partitioned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.laws import Law, uniform
from ..schema import Constraint, Ensemble, Family, Fit
from ..storage import global_row_number, stored
from . import pairs as P

#: Most buckets among which events are dealt by cumulative weight, and rows that fill one.
BUCKETS, BUCKET_ROWS = 256, 20_000
#: Events that fill one part of a bucket.
PART_EVENTS = 1_000_000


def independent(rows: DataFrame, law: Law, seed: int, keys=("source", "target")) -> DataFrame:
    """One draw per row of pairs; zeros go."""
    u = uniform(seed, *[F.col(k) for k in keys])
    v = uniform(seed, *[F.col(k) for k in keys], 1) if law.pi is not None else None
    return rows.select(*keys, law.draw(u, v).alias("weight")).where("weight > 0")


def grand_canonical(spark, fit: Fit, seed: int = 0, repetitions: int | None = None) -> DataFrame:
    """(source, target, weight) of independent pair draws; with `repetitions`, that many samples tagged `rep`."""
    rows = P.candidates(spark, fit)
    keys = ("source", "target")
    if repetitions is not None:
        rows, keys = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))), ("rep", *keys)
    return independent(rows, P.law(fit), seed, keys)


def custom_poisson(probabilities: DataFrame, total_events: float, seed: int = 0) -> DataFrame:
    """Poisson draws at rates T p / sum of p."""
    return independent(P.normalised_rates(probabilities, total_events), Law(Family.ME, 1, F.col("rate")), seed)


def placed(events: DataFrame, table: DataFrame, weight: str, u: str, keys: list[str]) -> DataFrame:
    """Places each event (a uniform in column `u`) in the row of `table` whose share of the cumulative weight holds it.

    Rows are dealt to buckets by a hash; an event finds its bucket by the bucket
    totals (`BUCKETS` numbers), and its row within the bucket."""
    positive = table.where(F.col(weight) > 0)
    buckets = max(1, min(BUCKETS, positive.count() // BUCKET_ROWS))
    parts = max(1, min(1024, events.count() // (buckets * PART_EVENTS)))
    bucketed = positive.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sums = dict(map(tuple, bucketed.groupBy("_bucket").agg(F.sum(weight)).collect()))
    names = sorted(sums)
    if not names:
        raise ValueError("no positive weights to place events in")
    edge = np.cumsum([sums[b] for b in names])
    total = float(edge[-1])
    lows = np.concatenate([[0.0], edge[:-1]])
    at = F.lit(0)
    cuts = F.array(*[F.lit(float(x) / total) for x in edge[:-1]]) if len(names) > 1 else None
    if cuts is not None:
        at = F.aggregate(cuts, F.lit(0), lambda a, x: a + (F.col(u) >= x).cast("int"))
    literal = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), at)
    dealt = events.select(literal(names, "int").alias("_bucket"), (F.col(u) * total - literal([float(x) for x in lows], "double")).alias("_x"), *[c for c in events.columns if c != u])
    columns = [c for c in events.columns if c != u]
    fields = [f for f in events.schema.fields if f.name != u] + [f for f in table.schema.fields if f.name in keys]
    from pyspark.sql import types as T

    def find(_, e, t):
        t = t.sort_values(keys)
        rows = np.minimum(np.searchsorted(np.cumsum(t[weight].to_numpy()), e["_x"].to_numpy(), side="right"), len(t) - 1)
        out = e[columns].reset_index(drop=True)
        for k in keys:
            out[k] = t[k].to_numpy()[rows]
        return out

    renamed = dealt.withColumnRenamed("_bucket", "_of")
    # a bucket of many events is split: placing needs no other events
    salted = renamed.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(parts)).cast("int"))
    spread = bucketed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.groupBy("_of", "_salt").cogroup(spread.groupBy("_bucket", "_salt")).applyInPandas(find, T.StructType(fields))


def _events(spark, total: int, seed: int, sides: int) -> DataFrame:
    rows = spark.range(int(total)).withColumnRenamed("id", "event")
    return rows.withColumns({f"u{k}": uniform(seed, F.col("event"), k) for k in range(sides)})


def canonical(spark, fit: Fit, total_events: int, seed: int = 0) -> DataFrame:
    """ME strengths with exactly T events: each falls on a source by x and on a target by y."""
    nodes = fit.nodes(spark)
    events = _events(spark, total_events, seed, 2)
    at_source = placed(events, nodes.select(F.col("node").alias("source"), "x"), "x", "u0", ["source"])
    both = placed(stored(at_source, "events"), nodes.select(F.col("node").alias("target"), "y"), "y", "u1", ["target"])
    return both.groupBy("source", "target").agg(F.count("*").alias("weight"))


def custom_multinomial(probabilities: DataFrame, total_events: int, seed: int = 0) -> DataFrame:
    """Exactly T events over the pairs of a probability table."""
    events = _events(probabilities.sparkSession, total_events, seed, 1)
    return placed(events, probabilities, "probability", "u0", ["source", "target"]).groupBy("source", "target").agg(F.count("*").alias("weight"))


def stubs(spark, strengths: DataFrame, seed: int = 0) -> DataFrame:
    """Microcanonical: out-stubs meet randomly ordered in-stubs; strengths come out exactly, self-loops are allowed.

    `strengths` is (node, out, incoming)."""
    sums = strengths.agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.sum("incoming"), F.lit(0))).first()
    if sums[0] != sums[1]:
        raise ValueError(f"strengths are not balanced: {sums[0]} and {sums[1]}")

    def unrolled(column: str, name: str) -> DataFrame:
        s = strengths.where(F.col(column) > 0).select(F.col("node").alias(name), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(column).cast("bigint"))).alias("k"))
        return s

    out = global_row_number(unrolled("out", "source"), ["source", "k"], "place").select("source", "place")
    shuffled = unrolled("incoming", "target").withColumn("u", uniform(seed, F.col("target"), F.col("k")))
    incoming = global_row_number(shuffled, ["u", "target", "k"], "place").select("target", "place")
    return out.join(incoming, "place").groupBy("source", "target").agg(F.count("*").alias("weight"))


def sample(spark, fit: Fit | None, ensemble: Ensemble = Ensemble.GRAND_CANONICAL, seed: int = 0, total_events: int | None = None, strengths: DataFrame | None = None) -> DataFrame:
    ensemble = Ensemble(ensemble)
    if ensemble == Ensemble.MICROCANONICAL:
        if strengths is None:
            raise TypeError("the microcanonical ensemble needs strengths")
        return stubs(spark, strengths, seed)
    if fit is None:
        raise TypeError("a fit is needed")
    if ensemble == Ensemble.CANONICAL:
        if fit.family != Family.ME or fit.constraint != Constraint.STRENGTH:
            from ..schema import UnsupportedModelCaseError

            raise UnsupportedModelCaseError("the canonical ensemble has ME strengths only")
        return canonical(spark, fit, round(float((fit.x * fit.y.sum()).sum())) if total_events is None else total_events, seed)
    return grand_canonical(spark, fit, seed)
