"""Networks derived from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import global_row_number


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def nation_od(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """Customer nation to supplier nation, number of line items."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag")
    lines = lines if where is None else lines.where(where)
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    suppliers = _table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").cast("bigint").alias("source"), F.col("s_nationkey").cast("bigint").alias("target")).agg(F.count("*").alias("weight"))


def nation_od_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse part of nation_od: one quarter's returns, without the diagonal."""
    quarter = "l_shipdate >= timestamp'1997-01-01' and l_shipdate < timestamp'1997-04-01' and l_returnflag = 'R'"
    return nation_od(spark, sf_dir, quarter).where("source <> target")


def user_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User to the user of the next event, number of times; the order is global, so rows are ranked by range partitions."""
    ranked = global_row_number(_table(spark, sf_dir, "events", "ts", "event_id", "user_id"), ["ts", "event_id"])
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("target"))
    pairs = ranked.select("rank", F.col("user_id").alias("source")).join(following, "rank")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier (ids after the customers'), number of line items."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    shift = _table(spark, sf_dir, "customer", "c_custkey").agg((F.max("c_custkey") + 1).alias("shift"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(shift))
    return joined.groupBy(F.col("o_custkey").alias("source"), (F.col("l_suppkey") + F.col("shift")).alias("target")).agg(F.count("*").alias("weight"))


def grid(n: int):
    """Coordinates of n nodes on a square grid."""
    import numpy as np

    side = math.ceil(math.sqrt(n)) or 1
    ids = np.arange(n)
    return np.stack([ids % side, ids // side], axis=1).astype(float)


def grid_nodes(nodes: DataFrame, side: int) -> DataFrame:
    """(node, cx, cy) of a grid of the given side."""
    return nodes.select("node", (F.col("node") % side).cast("double").alias("cx"), F.floor(F.col("node") / side).cast("double").alias("cy"))
