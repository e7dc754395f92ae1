"""Network statistics over edge tables (bags of (source, target, weight) rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def node_count(edges: DataFrame) -> int:
    """Nodes are 0 .. the largest id, seen or not."""
    top = edges.agg(F.max(F.greatest("source", "target"))).first()[0]
    return 0 if top is None else top + 1


def universe(edges: DataFrame) -> DataFrame:
    return edges.sparkSession.range(node_count(edges)).withColumnRenamed("id", "node")


def _ends(edges: DataFrame) -> DataFrame:
    """One row per end of an edge: one shuffle serves both directions, partly summed before it."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(True).alias("is_out")), F.struct(F.col("target").alias("node"), F.lit(False).alias("is_out"))))
    return edges.select(ends.alias("e"), "weight").select("e.node", "e.is_out", "weight")


def _both(edges: DataFrame, total) -> DataFrame:
    """(node, out, incoming) of an aggregate of each direction's rows, 0 where there are none."""
    out, incoming = total(F.col("is_out")), total(~F.col("is_out"))
    sums = _ends(edges).groupBy("node").agg(out.alias("out"), incoming.alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return universe(edges).join(sums, "node", "left").select("node", zero("out"), zero("incoming"))


def directed_strengths(edges: DataFrame) -> DataFrame:
    return _both(edges, lambda on: F.sum(F.when(on, F.col("weight"))))


def directed_degrees(edges: DataFrame) -> DataFrame:
    return _both(edges, lambda on: F.count(F.when(on, F.lit(1))))


def totals(edges: DataFrame) -> DataFrame:
    """num_edges, total_events, nodes, max and mean weight, whether weighted and with self-loops: one row."""
    return edges.agg(
        F.count("*").alias("num_edges"),
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("total_events"),
        F.coalesce(F.max(F.greatest("source", "target")) + 1, F.lit(0)).cast("bigint").alias("nodes"),
        F.coalesce(F.max("weight"), F.lit(0)).cast("bigint").alias("max_weight"),
        F.avg("weight").alias("mean_weight"),
        F.coalesce(F.max(F.col("weight") > 1), F.lit(False)).alias("weighted"),
        F.coalesce(F.max(F.col("source") == F.col("target")), F.lit(False)).alias("self_loops"),
    )


def weight_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("weight").agg(F.count("*").alias("count")).orderBy("weight")


def node_stats(edges: DataFrame) -> DataFrame:
    """Strength, degree, disparity and mean neighbour strength and degree of every node, each out and in (0 where undefined)."""
    one = _ends(edges).groupBy("node").agg(
        *[F.coalesce(F.sum(F.when(on, F.col("weight"))), F.lit(0)).cast("bigint").alias(f"strength_{d}") for d, on in (("out", F.col("is_out")), ("in", ~F.col("is_out")))],
        *[F.count(F.when(on, F.lit(1))).alias(f"degree_{d}") for d, on in (("out", F.col("is_out")), ("in", ~F.col("is_out")))],
        *[F.coalesce(F.sum(F.when(on, F.col("weight").cast("double") * F.col("weight"))), F.lit(0.0)).alias(f"squares_{d}") for d, on in (("out", F.col("is_out")), ("in", ~F.col("is_out")))],
    )
    one = stored(one, "node-sums")
    far = edges.join(one.select(F.col("node").alias("target"), F.col("strength_in").alias("ts"), F.col("degree_in").alias("tk")), "target")
    far = far.join(one.select(F.col("node").alias("source"), F.col("strength_out").alias("ss"), F.col("degree_out").alias("sk")), "source")
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("node"), (F.col("weight").cast("double") * F.col("ts")).alias("snn_out"), F.col("tk").cast("double").alias("knn_out"), F.lit(0.0).alias("snn_in"), F.lit(0.0).alias("knn_in")),
            F.struct(F.col("target").alias("node"), F.lit(0.0).alias("snn_out"), F.lit(0.0).alias("knn_out"), (F.col("weight").cast("double") * F.col("ss")).alias("snn_in"), F.col("sk").cast("double").alias("knn_in")),
        )
    )
    two = far.select(ends.alias("e")).select("e.*").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("snn_out", "knn_out", "snn_in", "knn_in")])
    full = universe(edges).join(one, "node", "left").join(two, "node", "left").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return full.select(
        "node", "strength_out", "strength_in", "degree_out", "degree_in",
        *[ratio(c(f"squares_{d}"), c(f"strength_{d}").cast("double") * c(f"strength_{d}")).alias(f"y2_{d}") for d in ("out", "in")],
        *[ratio(c(f"snn_{d}"), c(f"strength_{d}").cast("double")).alias(f"s_nn_{d}") for d in ("out", "in")],
        *[ratio(c(f"knn_{d}"), c(f"degree_{d}").cast("double")).alias(f"k_nn_{d}") for d in ("out", "in")],
    )


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): distinct pairs in both orders, the larger weight of the two directions."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").union(edges.select("target", "source", "weight"))
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def _triangles(und: DataFrame) -> DataFrame:
    """(i, j, k, w_ij, w_ik) of every node i with neighbours j < k that are joined.

    Wedges start at each triangle's corner of least (degree, id), so hubs open few of them."""
    pairs = und.where("a <> b")
    degree = pairs.groupBy("a").agg(F.count("*").alias("k"))
    ranked = pairs.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b").where("ka < kb or (ka = kb and a < b)").select("a", "b", "weight")
    left, right = ranked.toDF("u", "v", "w_uv"), ranked.toDF("u", "t", "w_ut")
    wedges = left.join(right, "u").where("v < t")
    closing = pairs.toDF("v", "t", "w_vt")
    found = wedges.join(closing, ["v", "t"])
    corners = F.explode(
        F.array(
            F.struct(F.col("u").alias("node"), (F.col("w_uv") + F.col("w_ut")).alias("w")),
            F.struct(F.col("v").alias("node"), (F.col("w_uv") + F.col("w_vt")).alias("w")),
            F.struct(F.col("t").alias("node"), (F.col("w_ut") + F.col("w_vt")).alias("w")),
        )
    )
    return found.select(corners.alias("c")).select("c.node", "c.w")


def _looped(und: DataFrame) -> DataFrame:
    """Triangles through a self-loop: node i, itself as a neighbour, and each other neighbour."""
    loops = und.where("a = b").select("a", F.col("weight").alias("loop"))
    other = und.where("a <> b")
    at_i = loops.join(other, "a").select(F.col("a").alias("node"), (F.col("loop") + F.col("weight")).alias("w"))
    return at_i


def clustering(edges: DataFrame) -> DataFrame:
    """(node, value): share of joined pairs among a node's neighbours, directions dropped; a self-loop makes a node its own neighbour."""
    und = stored(undirected(edges), "undirected")
    corners = _triangles(und).select("node").union(_looped(und).select("node"))
    hits = corners.groupBy("node").agg(F.count("*").alias("closed"))
    degree = und.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k"))
    full = universe(edges).join(degree, "node", "left").join(hits, "node", "left").fillna(0)
    return full.select("node", F.when(F.col("k") > 1, F.col("closed") * 2.0 / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0)).alias("value"))


def weighted_clustering(edges: DataFrame, normalise: bool = False) -> DataFrame:
    """(node, value): sum over closed pairs of neighbours of (w_ij + w_ik) / (2 s (k - 1)); `normalise` doubles it, so that a closed triangle has 1."""
    und = stored(undirected(edges), "undirected")
    hits = _triangles(und).union(_looped(und)).groupBy("node").agg(F.sum("w").alias("w"))
    degree = und.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k"), F.sum("weight").alias("s"))
    full = universe(edges).join(degree, "node", "left").join(hits, "node", "left").fillna(0)
    value = F.col("w") / (F.col("s") * (F.col("k") - 1) * (1.0 if normalise else 2.0))
    return full.select("node", F.when((F.col("k") > 1) & (F.col("s") > 0), value).otherwise(F.lit(0.0)).alias("value"))


def with_coordinates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds `distance`, the Euclidean distance of the ends, from (node, cx, cy)."""
    a, b = nodes.select(F.col("node").alias("source"), F.col("cx").alias("sx"), F.col("cy").alias("sy")), nodes.select(F.col("node").alias("target"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    return edges.join(a, "source").join(b, "target").withColumn("distance", F.hypot(F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty"))).drop("sx", "sy", "tx", "ty")


def total_cost(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_coordinates(edges, nodes).agg(F.coalesce(F.sum(F.col("weight") * F.col("distance")), F.lit(0.0)).alias("cost"))


def constraints_of(edges: DataFrame, coordinates=None) -> dict:
    """All constraints of a network for the fits: node arrays (a row per node) and scalars, by one pass over the edges."""
    out, weight = F.col("is_out"), F.col("weight")
    sums = {"strength_out": F.sum(F.when(out, weight)), "strength_in": F.sum(F.when(~out, weight)), "degree_out": F.count(F.when(out, F.lit(1))), "degree_in": F.count(F.when(~out, F.lit(1)))}
    s = _ends(edges).groupBy("node").agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()]).toPandas()
    got: dict = {k: np.zeros(int(s.node.max()) + 1 if len(s) else 0) for k in sums}
    for k, values in got.items():
        values[s.node.to_numpy(np.int64)] = s[k].to_numpy(float)
    got |= {"total_events": int(got["strength_out"].sum()), "target_edges": float(got["degree_out"].sum())}
    if coordinates is not None:
        c = np.asarray(coordinates, float)
        nodes = edges.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "node long, cx double, cy double")
        got |= {"coordinates": c, "target_cost": total_cost(edges, nodes).first()[0]}
    return got


def running_total(edges: DataFrame, by: str = "source") -> DataFrame:
    """Running sums of weight within each source (or target): the conditional mass that is left at each row."""
    w = Window.partitionBy(by).orderBy("target" if by == "source" else "source")
    before = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edges.withColumn("before", F.coalesce(before, F.lit(0)))
