"""Exact top-k inner products by dual-tree cover-tree search.

Method: vectors are dealt into blocks of bounded size, near ones together; the
queries are dealt into blocks of bounded size too, and every block of queries
meets every block of vectors in one task.  There both are indexed by cover
trees (nested covers of halving radius).  A pair of nodes is pruned when the
largest inner product that its covering radii allow is below the worst kth
score of any query under the query node; leaves are compared by one matrix
product in exact integers.  Each task returns k rows per query; a window keeps
the best k of all.

Components x become floor(scale * x).  Ties go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite values,
and rows with a null id, take no part; vectors of different lengths never meet;
rows that share an id are one vector's copies: a query is not matched with its
own id, and of equal (score, id) one row is returned; a query without
candidates returns no rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, stored

#: Rows of a block at most (a few more where hashes are uneven).
BLOCK = 4096
LEAF = 64
#: Vectors that blocks are formed around at most; a documented sample.
PIVOTS = 256
_VECTOR = "vec_id bigint, dim int, vec binary"


class Node:
    __slots__ = ("center", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, center: np.ndarray):
        self.rows, self.center, self.children = rows, center, []
        self.radius = float(np.sqrt(((points[rows] - center) ** 2).sum(axis=1).max())) if len(rows) else 0.0
        self.norm = float(np.sqrt(center @ center))


def cover_tree(points: np.ndarray) -> Node:
    """A tree of covers: the children of a node lie around centers that are half its radius apart.

    Where halving the radius would need a center for every few points (high
    intrinsic dimension) the node stays a leaf."""
    root = Node(points, np.arange(len(points)), points[0])
    todo = [root]
    while todo:
        node = todo.pop()
        n = len(node.rows)
        if n <= LEAF or node.radius == 0:
            continue
        own = points[node.rows]
        distance = ((own - node.center) ** 2).sum(axis=1)
        home, centers = np.zeros(n, np.int64), [node.center]
        reach = (node.radius / 2) ** 2
        while distance.max() > reach and len(centers) <= n // 8:
            center = own[distance.argmax()]
            d = ((own - center) ** 2).sum(axis=1)
            nearer = d < distance
            distance[nearer], home[nearer] = d[nearer], len(centers)
            centers.append(center)
        if distance.max() > reach or len(centers) < 2:
            continue
        node.children = [Node(points, node.rows[home == k], c) for k, c in enumerate(centers) if (home == k).any()]
        todo += node.children
    return root


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best k points by inner product, its own id left out."""
    q, p = queries.astype(np.float64), points.astype(np.float64)  # whole numbers below 2^53: exact
    scores = [np.empty(0)] * len(q)
    found = [np.empty(0, np.int64)] * len(q)
    worst = np.full(len(q), -np.inf)

    def most(a: Node, b: Node) -> float:
        return float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + 1e-6 * (1 + a.norm * b.norm)

    def compare(a: Node, b: Node):
        products = q[a.rows] @ p[b.rows].T
        own = ids[b.rows]
        for row, line in zip(a.rows, products):
            good = (line >= worst[row]) & (own != query_ids[row])
            if not good.any():
                continue
            s, i = np.concatenate([scores[row], line[good]]), np.concatenate([found[row], own[good]])
            if len(s) > 4 * k:  # all but those that reach the kth score
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, i = s[keep], i[keep]
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            if len(s) > 1:
                new = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
                s, i = s[new], i[new]
            scores[row], found[row] = s[:k], i[:k]
            if len(scores[row]) == k:
                worst[row] = scores[row][-1]

    todo = [(cover_tree(q), cover_tree(p))] if len(q) and len(p) else []
    while todo:
        a, b = todo.pop()
        if most(a, b) < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            compare(a, b)
        elif a.children and (not b.children or a.radius >= b.radius):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in sorted(b.children, key=lambda c: most(a, c))]
    rows = np.repeat(np.arange(len(q)), [len(s) for s in scores])
    return rows, np.concatenate([*found, np.empty(0, np.int64)]), np.concatenate([*scores, np.empty(0)]).astype(np.int64)


def whole_vectors(table: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id, dim, vec (little-endian int32 of floor(scale * x)) of the rows that take part."""
    rows = plain(table, vec_id=id_column, v=vector).where("vec_id is not null and size(v) > 0")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, lists = batch.column("vec_id").to_pylist(), batch.column("v")
            out = {"vec_id": [], "dim": [], "vec": []}
            for k, own in enumerate(ids):
                values = lists[k].values
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if values.null_count or not np.isfinite(x).all():
                    continue
                out["vec_id"].append(own)
                out["dim"].append(len(x))
                out["vec"].append(np.floor(scale * x).astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())]))

    return rows.mapInArrow(run, _VECTOR)


def _dealt(vectors: DataFrame, total: int) -> DataFrame:
    """Adds `block`: vectors near the same pivot, split by a hash so that no block is large."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, total // BLOCK))).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(np.frombuffer(r["vec"], "<i4").astype(np.float64))
    pivots = {d: np.array(x) for d, x in by_dim.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            near = []
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist()):
                p = pivots.get(dim)
                near.append(-1 if p is None else int(((p - np.frombuffer(raw, "<i4")) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [*batch.schema.names, "pivot"])

    near = stored(vectors.mapInArrow(run, _VECTOR + ", pivot int"), "near")
    sizes = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    piece = F.pmod(F.xxhash64("vec_id", "vec"), F.col("pieces"))
    return near.join(F.broadcast(sizes), ["dim", "pivot"]).select("vec_id", "dim", "vec", F.concat_ws("/", "dim", "pivot", piece).alias("block"))


def top_k(table: DataFrame, is_query: Column | str, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with all other rows."""
    vectors = stored(whole_vectors(table, id_column, vector, scale), "vectors")
    points = stored(_dealt(vectors, vectors.count()), "points")
    queries = stored(vectors.where(is_query), "queries")
    pieces = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(pieces)).cast("int"))
    # a row per block: BLOCK vectors each, so this side stays small
    blocks = points.select("dim", "block").distinct()
    asked = queries.join(F.broadcast(blocks), "dim").select(F.col("block").alias("met"), F.col("part").alias("of"), "vec_id", "vec")
    given = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).select("block", "part", "vec_id", "vec")

    def search(_, q, p):
        import pandas as pd

        def matrix(x):
            return np.frombuffer(b"".join(x), "<i4").reshape(len(x), -1) if len(x) else np.empty((0, 0), np.int32)

        rows, ids, scores = dual_tree(matrix(q.vec), q.vec_id.to_numpy(), matrix(p.vec), p.vec_id.to_numpy(), k)
        return pd.DataFrame({"query_id": q.vec_id.to_numpy()[rows], "vec_id": ids, "score": scores})

    found = asked.groupBy("met", "of").cogroup(given.groupBy("block", "part")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
