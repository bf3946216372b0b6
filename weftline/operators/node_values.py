"""Node-valued graph algorithms: each gives ``(id, value)`` for every node of a topology.

Degrees, clustering inputs and neighbour aggregates are plain joins and aggregations. Iterative ones run
as a NumPy kernel in a single task if the graph was counted and found small, which saves the jobs of a
loop; any larger graph runs as a loop of distributed joins whose lineage is cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import checkpoint, col
from weftline.errors import ColumnNotFoundError, ComputeError
from weftline.functions.expr import Expr
from weftline.operators import distributed as D
from weftline.operators import kernels as K
from weftline.operators.draws import id_numbers
from weftline.operators.distributed import component_roots, label_votes, louvain_blocks, louvain_rounds, pagerank_loop, source_dependencies, source_distances, strong_component_roots, triangle_counts, weighted_dependencies
from weftline.operators.tail import DEFAULT_SEED
from weftline.topology import Topology, encode, kernel_edges

__all__ = ["degree", "pagerank", "connected_components", "triangle_count", "clustering_coefficient", "closeness", "betweenness", "label_propagation", "louvain", "neighbors_agg", "distance_totals", "broadcast_graph"]


def _schema(t: Topology, value: T.DataType) -> T.StructType:
    kind = T.LongType() if t.id_type == "bigint" else T.StringType()
    return T.StructType([T.StructField("id", kind), T.StructField("value", value)])


def whole_graph(t: Topology, edges: DataFrame, value: T.DataType, kernel: Callable) -> DataFrame:
    """Run ``kernel(ids, src, dst, w)`` over a small graph in one task. A kernel of identifiers returns positions."""
    positions = isinstance(value, T.NullType)
    schema = _schema(t, T.LongType() if positions else value)
    schema = T.StructType([schema[0], T.StructField("value", schema[0].dataType)]) if positions else schema

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        ids, s, d = encode(table.column("src"), table.column("dst"))
        w = table.column("w").to_numpy() if "w" in table.column_names else None
        out = kernel(ids, s, d, w)
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(out)) if positions else pa.array(out)], names=["id", "value"])

    def guarded(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from run(batches)

    return edges.repartition(1).mapInArrow(guarded, schema)


def _labelled(t: Topology, roots: DataFrame) -> DataFrame:
    """Integer labels from ``(id, root id)``: the root itself, or a hash of its name."""
    return roots if t.id_type == "bigint" else roots.select("id", F.xxhash64("value").alias("value"))


def degree(t: Topology, direction: str = "out") -> DataFrame:
    """Edge rows at each node; ``both`` counts a loop twice. One aggregation, no join."""
    counted = {"out": (1, 0), "in": (0, 1), "both": (1, 1)}
    if direction not in counted:
        raise ValueError(f"direction is 'out', 'in' or 'both', not {direction!r}")
    a, b = (F.lit(x).cast("long") for x in counted[direction])
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), a.alias("n")), F.struct(F.col("dst").alias("id"), b.alias("n"))))
    return t.edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.n").alias("value"))


def pagerank(t: Topology, damping: float = 0.85, max_iter: int = 30, tol: float = 1e-6, weight: Expr | None = None) -> DataFrame:
    """Ranks that sum to 1. Nodes without outgoing weight spread theirs over all; stops once ranks move less than ``tol``."""
    if not 0 <= damping <= 1 or max_iter < 0:
        raise ValueError("damping is within 0 and 1, and max_iter is 0 or more")
    edges = t.weighted(weight)
    if t.small:
        return whole_graph(t, edges, T.DoubleType(), lambda ids, s, d, w: K.pagerank(len(ids), s, d, w, damping, max_iter, tol))
    return pagerank_loop(t, edges, damping, max_iter, tol)


def connected_components(t: Topology, mode: str = "weak") -> DataFrame:
    """A label for each node: the least identifier of its component (for names, its hash)."""
    if mode not in ("weak", "strong"):
        raise NotImplementedError(f"mode is 'weak' or 'strong', not {mode!r}")
    if t.small:
        if mode == "weak":
            return _labelled(t, whole_graph(t, t.edges, T.NullType(), lambda ids, s, d, w: K.weak_roots(len(ids), s, d)))
        return _labelled(t, whole_graph(t, t.edges, T.NullType(), lambda ids, s, d, w: K.strong_roots(K.Csr(len(ids), s, d))))
    return _labelled(t, component_roots(t) if mode == "weak" else strong_component_roots(t))


def _triangles_and_degree(t: Topology) -> DataFrame:
    """``(id, triangles, k)`` over the simple undirected graph; nodes of loops only have neither."""
    if t.small:
        schema = T.ArrayType(T.LongType())

        def kernel(ids, s, d, w):
            n = len(ids)
            a, b = np.minimum(s, d), np.maximum(s, d)
            pair = np.unique((a * n + b)[a != b])
            a, b = pair // n, pair % n
            count = K.triangles(n, a, b) if len(a) else np.zeros(n, np.int64)
            k = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            return np.stack((count, k), axis=1).tolist()

        both = whole_graph(t, t.edges, schema, kernel)
        return both.select("id", F.col("value")[0].alias("triangles"), F.col("value")[1].alias("k"))
    return triangle_counts(t)


def triangle_count(t: Topology) -> DataFrame:
    """Triangles of the simple undirected graph that contain each node."""
    return _triangles_and_degree(t).select("id", F.col("triangles").alias("value"))


def clustering_coefficient(t: Topology) -> DataFrame:
    """The share of each node's pairs of neighbours that are joined; 0 below two neighbours."""
    k = F.col("k").cast("double")
    share = F.when(F.col("k") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (k * (k - 1)))
    return _triangles_and_degree(t).select("id", share.alias("value"))


def broadcast_graph(t: Topology, edges: DataFrame):
    """A small graph, encoded on the driver and shared with all tasks."""
    table = edges.toArrow()
    ids, s, d = encode(table.column("src"), table.column("dst"))
    w = table.column("w").to_numpy() if "w" in table.column_names else None
    return t.spark.sparkContext.broadcast((ids, s, d, w)), ids


def per_source(t: Topology, edges: DataFrame, sources: np.ndarray | None, schema: T.StructType, work: Callable) -> DataFrame:
    """Run ``work(ids, graph, positions)`` over sources spread across tasks, the graph being broadcast."""
    shared, ids = broadcast_graph(t, edges)
    at = np.arange(len(ids)) if sources is None else sources(len(ids))
    tasks = max(1, min(len(at), 4 * t.spark.sparkContext.defaultParallelism))
    rows = t.spark.createDataFrame(pa.table({"at": pa.array(at, pa.int64())})).repartition(tasks)

    def run(batches):
        mine = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if mine:
            ids, s, d, w = shared.value
            yield from work(ids, K.Csr(len(ids), s, d, w), np.concatenate(mine))

    return rows.mapInArrow(run, schema)


_DISTANCES = "sum_d double, n_reached long, max_d long"


def _distance_work(weighted: bool):
    def work(ids, graph, at):
        total, reached, most = np.zeros(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if weighted:
            k = 0
            for some in K.batches(at, graph.n):
                cost = K.cheapest(graph, some)[:, : len(some)]
                near = np.isfinite(cost)
                total[k : k + len(some)], reached[k : k + len(some)] = np.where(near, cost, 0.0).sum(axis=0), near.sum(axis=0) - 1
                k += len(some)
        else:
            back = graph.reversed()
            for k in range(0, len(at), 64):
                for level, n in enumerate(K.distances(back, at[k : k + 64]), 1):
                    total[k : k + 64] += level * n
                    reached[k : k + 64] += n
                    most[k : k + 64][n > 0] = level
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array(total), pa.array(reached), pa.array(most)], names=["id", "sum_d", "n_reached", "max_d"]
        )

    return work


def distance_totals(t: Topology, weight: Expr | None = None, sources: Callable | None = None) -> DataFrame:
    """``(id, sum_d, n_reached, max_d)`` for each source: over the other nodes that it leads to.

    ``sources`` picks positions out of 0..n-1, in order of identifiers; all of them by default.
    """
    edges = t.edges if weight is None else t.weighted(weight)
    if t.small:
        schema = T.StructType([_schema(t, T.LongType())[0], *T._parse_datatype_string(_DISTANCES).fields])
        if not t.n_edges:
            return t.spark.createDataFrame([], schema)
        return per_source(t, edges, sources, schema, _distance_work(weight is not None))
    return source_distances(t, edges, weight is not None, sources)


def closeness(t: Topology, weight: Expr | None = None) -> DataFrame:
    """Nodes reached over the sum of their distances, along out-edges; 0 where that sum is 0."""
    near = F.when(F.col("sum_d") > 0, F.col("n_reached") / F.col("sum_d")).otherwise(0.0)
    return distance_totals(t, weight).select("id", near.alias("value"))


def betweenness(t: Topology, sample: float | None = None, weight: Expr | None = None, seed: int | None = None) -> DataFrame:
    """Shortest paths through each node, directed and not normalised; each parallel edge is a path of its own.

    ``sample`` takes that share of sources, drawn by ``seed``, and scales up. Edges of weight 0 count, but in circles of them
    paths cannot be counted, which is an error.
    """
    edges = t.edges if weight is None else t.weighted(weight)

    def drawn(n: int) -> np.ndarray:
        if sample is None:
            return np.arange(n)
        k = min(n, max(1, ceil(n * min(1.0, max(0.0, sample)))))
        return np.sort(np.random.default_rng(DEFAULT_SEED if seed is None else seed).permutation(n)[:k])

    if not t.n_edges:
        return t.spark.createDataFrame([], _schema(t, T.DoubleType()))
    if not t.small:
        return source_dependencies(t, drawn) if weight is None else weighted_dependencies(t, edges, drawn)
    n = t.vertices.count()
    scale = n / len(drawn(n))

    def work(ids, graph, at):
        total = np.zeros(len(ids))
        if weight is None:
            for some in K.batches(at, graph.n):
                K.brandes(graph, some, total)
        else:
            for some in K.batches(at, graph.n + len(graph.src)):
                K.brandes_weighted(graph, some, total)
        yield pa.RecordBatch.from_arrays([ids, pa.array(total)], names=["id", "value"])

    partial = per_source(t, edges, drawn, _schema(t, T.DoubleType()), work)
    return partial.groupBy("id").agg((F.sum("value") * scale).alias("value"))


def label_propagation(t: Topology, max_iter: int = 20, seed: int | None = None) -> DataFrame:
    """Communities by majority vote of neighbours in both directions; ties go to the least label.

    Nodes vote in two halves a round, drawn by a seeded hash, so that neighbours do not swap labels for ever.
    """
    chosen = DEFAULT_SEED if seed is None else seed
    if t.small:
        kernel = lambda ids, s, d, w: K.label_propagation(len(ids), s, d, id_numbers(ids), max_iter, chosen)
        return _labelled(t, whole_graph(t, t.edges, T.NullType(), kernel))
    return _labelled(t, label_votes(t, max_iter, chosen))


def louvain(t: Topology, weight: Expr | None = None, resolution: float = 1.0, seed: int | None = None) -> DataFrame:
    """Communities of high modularity, numbered from 0 in order of their least members; edges count both ways, a loop once.

    Edges are merged into one weight a pair by a distributed aggregation first, so the bound that holds for
    what one task takes is on pairs of nodes, not on rows. Weights are scaled to whole numbers, so that sums are the same
    in any order, and nodes move in seeded half-sweeps, so that a task and a cluster find the same communities.
    """
    chosen = DEFAULT_SEED if seed is None else seed
    pairs = t.weighted(weight).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    if not t.small:
        if t.vertices.count() <= D.SHARED_NODES:
            return louvain_blocks(t, pairs, resolution, chosen)
        pairs = checkpoint(pairs)
        if pairs.count() > kernel_edges(pairs):
            return louvain_rounds(t, pairs, resolution, chosen)
    return whole_graph(t, pairs, T.LongType(), lambda ids, s, d, w: K.louvain(len(ids), s, d, w, id_numbers(ids), resolution, chosen))


def neighbors_agg(t: Topology, attributes: DataFrame, id_col: str, agg: Expr, direction: str = "out") -> DataFrame:
    """Fold an attribute of each node's neighbours over its edges; the value is a double.

    Neighbours without a row or with a null attribute are skipped. Over nothing, mean, min and max are null, and
    sum, count and n_unique are 0. Of several rows for a node the greatest
    attribute counts.
    """
    inner = agg.payload[0] if isinstance(agg, Expr) and agg.kind == "alias" else agg
    if not isinstance(inner, Expr) or inner.kind != "agg" or inner.payload[1].kind != "col":
        raise NotImplementedError(f"neighbors().agg takes col(name).fn(), not {agg!r}")
    fn, name = inner.payload[0], inner.payload[1].payload
    if name not in attributes.columns:
        raise ColumnNotFoundError(f"column not found: {name!r}; the columns are {attributes.columns}")
    numeric = isinstance(attributes.schema[name].dataType, T.NumericType)
    if not numeric and fn not in ("count", "n_unique"):
        raise ComputeError(f"{fn} needs a numeric attribute; {name!r} is {attributes.schema[name].dataType.simpleString()}")
    value = col(name).cast("double") if numeric else col(name)
    known = attributes.select(col(id_col).alias("dst"), value.alias("x")).groupBy("dst").agg(F.max("x").alias("x")).where(F.col("x").isNotNull())
    x = F.col("x")
    if numeric and fn in ("min", "max"):  # NaN is no extreme
        x = F.when(~F.isnan(x), x)
    folds = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "n_unique": F.count_distinct}
    folded = t.along(direction).join(known, "dst").groupBy("src").agg(folds[fn](x).cast("double").alias("value"))
    out = t.vertices.join(folded.withColumnRenamed("src", "id"), "id", "left")
    return out.select("id", F.coalesce("value", F.lit(0.0)).alias("value") if fn in ("sum", "count", "n_unique") else "value")
