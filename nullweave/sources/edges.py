"""Readers and writers of edge, probability, rate and coordinate tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import normalize_edges, normalize_probabilities
from .formats import register

CSV = {".csv": ",", ".tsv": "\t", ".tab": "\t"}
PARQUET = {".parquet", ".pq"}
ARROW = {".arrow", ".ipc", ".feather"}
GRAPHS = {".graphml": "nullweave_graphml", ".mtx": "nullweave_mtx", ".net": "nullweave_pajek", ".paj": "nullweave_pajek"}


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: CSV and TSV with a header, Parquet, Arrow IPC."""
    kind = suffix(path)
    if kind in CSV:
        return spark.read.option("header", True).option("sep", CSV[kind]).option("mode", "FAILFAST").option("inferSchema", True).csv(path)
    if kind in PARQUET:
        return spark.read.parquet(path)
    if kind in ARROW:
        register(spark)
        return spark.read.format("nullweave_ipc").load(path)
    raise ValueError(f"unknown format {kind!r} of {path}")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight) from CSV, TSV, Parquet, Arrow IPC, GraphML, Matrix Market or Pajek, by suffix.

    Graph formats are read as directed, undirected or symmetric ones too."""
    kind = suffix(path)
    if kind in GRAPHS:
        register(spark)
        return normalize_edges(spark.read.format(GRAPHS[kind]).load(path))
    return normalize_edges(_table(spark, path))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    return normalize_probabilities(_table(spark, path))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, rate): the column `rate`, else `probability`; any non-negative number."""
    t = _table(spark, path)
    column = "rate" if "rate" in t.columns else "probability"
    if column not in t.columns:
        raise ValueError("a rate table needs a column rate or probability")
    return t.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), F.col(column).cast("double").alias("rate"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(node, cx, cy) from columns x and y; without a `node` column the row order is the node id (one small file)."""
    t = _table(spark, path)
    if "node" not in t.columns:
        rows = t.rdd.zipWithIndex().map(lambda r: (r[1], float(r[0]["x"]), float(r[0]["y"])))
        return spark.createDataFrame(rows, "node long, cx double, cy double")
    return t.select(F.col("node").cast("bigint").alias("node"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"))


def read_snap(spark: SparkSession, path: str, default_weight: int = 1) -> DataFrame:
    """White-space edge lists with # comments; a third field is the weight."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return normalize_edges(rows.select(F.col("f")[0].cast("bigint").alias("source"), F.col("f")[1].cast("bigint").alias("target"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(float(default_weight))).alias("weight")))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", default_weight: int = 1) -> DataFrame:
    """source, target[, weight] with a header; a missing weight is the default."""
    t = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    w = F.coalesce(F.col("weight"), F.lit(default_weight)) if "weight" in t.columns else F.lit(default_weight)
    return normalize_edges(t.select("source", "target", w.alias("weight")))


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space tables of numbers under a # header line, as named doubles."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.select(*[F.col("f")[k].cast("double").alias(n) for k, n in enumerate(names)])


def flights(spark: SparkSession, airports: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): routes counted by endpoint pair over dense airport ids, with Web-Mercator coordinates.

    airports: code, lon, lat; routes: source_code, target_code."""
    from ..functions.laws import web_mercator
    from ..storage import global_row_number

    known = airports.where("code is not null").groupBy("code").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    counted = routes.groupBy("source_code", "target_code").agg(F.count("*").alias("weight"))
    used = counted.select(F.explode(F.array("source_code", "target_code")).alias("code")).distinct().join(known, "code", "left_semi")
    ids = global_row_number(used, ["code"], "node").select("code", (F.col("node") - 1).alias("node"))
    x, y = web_mercator(F.col("lon"), F.col("lat"))
    nodes = ids.join(known, "code").select("node", "code", x.alias("cx"), y.alias("cy"))
    edges = counted.join(ids.toDF("source_code", "source"), "source_code").join(ids.toDF("target_code", "target"), "target_code")
    return edges.select("source", "target", "weight"), nodes


def write_edges(edges: DataFrame, path: str) -> None:
    """A folder of CSV, TSV or Parquet parts, or one Arrow IPC file (collected: for small tables)."""
    kind = suffix(path)
    rows = edges.select("source", "target", "weight")
    if kind in CSV:
        rows.write.mode("overwrite").option("header", True).option("sep", CSV[kind]).csv(path)
    elif kind in PARQUET:
        rows.write.mode("overwrite").parquet(path)
    elif kind in ARROW:
        import os

        import pyarrow as pa

        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        table = rows.toArrow()
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    else:
        raise ValueError(f"no writer for {kind!r}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_groups(result: DataFrame, prefix: str) -> None:
    """The four tables of a filter's result, each a folder of CSV parts."""
    from ..operators.filter import groups

    for name, table in groups(result).items():
        table.write.mode("overwrite").option("header", True).csv(f"{prefix.rstrip('/')}/{name}.csv")


def summary(edges: DataFrame) -> str:
    """Nodes, edges and weights of a network, as YAML."""
    from ..operators.stats import totals

    t = totals(edges).first().asDict()
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return "".join(f"{k}: {show(v)}\n" for k, v in t.items())
