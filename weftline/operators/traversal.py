"""Frame-valued traversals: k-hop expansion, single-pair shortest paths, random walks."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.columns import checkpoint
from weftline.functions.expr import Expr
from weftline.operators.distributed import numbered
from weftline.operators.draws import draw, draw_column
from weftline.operators.kernels import Csr, within
from weftline.operators.node_values import broadcast_graph
from weftline.operators.tail import DEFAULT_SEED
from weftline.topology import Topology, encode

__all__ = ["hop", "shortest_path", "random_walk"]

#: Expansions that are planned in one piece; longer ones stop as soon as nothing new is reached.
PLANNED_HOPS = 3

#: Rows, about, that a task hands on at once.
ROWS_A_BATCH = 1 << 19

#: Positions in the neighbour list that one row of the lookup of a large graph covers.
WALK_BLOCK = 1024


def hop(t: Topology, seeds: DataFrame, n: int, direction: str = "out") -> DataFrame:
    """``(src, dst)``: each node within ``n`` hops of each seed, once, without the seed itself.

    ``seeds`` has one column; a repeated seed repeats its rows, and unknown ones reach nothing. A small graph is
    broadcast to the seeds, so that pairs are neither shuffled nor kept. In a larger one each
    step expands the newest nodes only: few of them are broadcast to the edges, which then aren't shuffled.
    """
    if n < 0:
        raise ValueError("hop takes 0 hops or more")
    along = t.along(direction)
    wanted = seeds.toDF("seed").where(F.col("seed").isNotNull()).groupBy("seed").agg(F.count("*").cast("int").alias("times"))
    if n and t.small and t.n_edges and wanted.schema["seed"].dataType == along.schema["src"].dataType:
        return _hop_by_seed(t, along.distinct(), wanted, n)
    steps = along.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    front = wanted.select("seed", F.col("seed").alias("at"))
    seen, reached = front, None
    for k in range(n):
        front = front.join(steps, "at").select("seed", F.col("to").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")
        if n > PLANNED_HOPS:
            front = checkpoint(front)
            if front.isEmpty():
                break
        reached = front if reached is None else reached.unionByName(front)
        if k + 1 < n:
            seen = seen.unionByName(front)
    if reached is None:
        return t.edges.limit(0)
    repeated = reached.join(wanted, "seed").select("seed", "at", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return repeated.select(F.col("seed").alias("src"), F.col("at").alias("dst"))


def _hop_by_seed(t: Topology, edges: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Each task has all edges and a share of the seeds, and hands on what one seed after the other reaches."""
    shared, _ = broadcast_graph(t, edges)

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        ids, s, d, _ = shared.value
        graph, seen = Csr(len(ids), s, d), np.zeros(len(ids), bool)
        held, size = [], 0
        for b in batches:
            at = pc.index_in(b.column(0), value_set=ids)
            for seed, place, times in zip(b.column(0), at.to_pylist(), b.column(1).to_pylist()):
                found = within(graph, place, n, seen) if place is not None else ()
                if not len(found):
                    continue
                to = ids.take(pa.array(found))
                for _ in range(times):
                    held.append(pa.RecordBatch.from_arrays([pa.repeat(seed, len(to)), to], names=["src", "dst"]))
                    size += len(to)
                    if size >= ROWS_A_BATCH:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS_A_BATCH)
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS_A_BATCH)

    tasks = 4 * t.spark.sparkContext.defaultParallelism
    return wanted.repartition(tasks).mapInArrow(run, edges.select("src", "dst").schema)


_PATH = [T.StructField("hop", T.LongType(), False), T.StructField("cost", T.DoubleType(), False)]


def _path_schema(t: Topology) -> T.StructType:
    kind = T.LongType() if t.id_type == "bigint" else T.StringType()
    return T.StructType([T.StructField("src", kind), T.StructField("dst", kind), *_PATH])


def shortest_path(t: Topology, source, target, weight: Expr | None = None, direction: str = "out") -> DataFrame:
    """``(src, dst, hop, cost)``: the edges of one shortest path in order, with the cost up to each one's end.

    Fewest edges, or least total weight. Of equal paths each node is entered from the least
    identifier. No path, an unknown end, or twice the same end give no rows.
    """
    edges = t.weighted(weight)
    if direction == "in":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    elif direction == "both":
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    elif direction != "out":
        raise ValueError(f"direction is 'out', 'in' or 'both', not {direction!r}")
    schema = _path_schema(t)
    if (t.id_type == "bigint") != (isinstance(source, int) and isinstance(target, int)) or source == target:
        return t.spark.createDataFrame([], schema)
    if t.small:

        def run(batches):
            kept = [b for b in batches if b.num_rows]
            if kept:
                table = pa.Table.from_batches(kept)
                yield _path_batch(table, source, target, schema)

        return edges.repartition(1).mapInArrow(run, schema).orderBy("hop")
    return _joined_path(t, edges, source, target, schema)


def _path_batch(table: pa.Table, source, target, schema: T.StructType) -> pa.RecordBatch:
    ids, s, d = encode(table.column("src"), table.column("dst"))
    known = {v: k for k, v in enumerate(ids.to_pylist()) if v in (source, target)}
    rows: list[tuple[int, int, float]] = []
    if len(known) == 2:
        g = Csr(len(ids), s, d, table.column("w").to_numpy())
        a, b = known[source], known[target]
        best: dict[int, tuple[float, int]] = {a: (0.0, -1)}
        heap, done = [(0.0, a)], set()
        while heap and b not in done:
            cost, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            for k in range(g.start[v], g.start[v + 1]):
                u, far = int(g.dst[k]), cost + float(g.w[k])
                if u not in done and (u not in best or (far, v) < best[u]):
                    best[u] = (far, v)
                    heapq.heappush(heap, (far, u))
        if b in done:
            at = b
            while at != a:
                rows.append((best[at][1], at, best[at][0]))
                at = best[at][1]
            rows.reverse()
    take = lambda k: ids.take(pa.array([r[k] for r in rows], pa.int64()))
    columns = [take(0), take(1), pa.array(range(len(rows)), pa.int64()), pa.array([r[2] for r in rows], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _joined_path(t: Topology, edges: DataFrame, source, target, schema: T.StructType) -> DataFrame:
    """Relaxation by joins from the newest nodes, pruned by the target's best cost; then a walk back."""
    steps = checkpoint(edges.groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = checkpoint(t.vertices.where(F.col("id") == t.id_column(source)).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast(t.id_type).alias("parent")))
    front, held = best, None
    while not front.isEmpty():
        there = best.where(F.col("id") == t.id_column(target)).first()
        offers = front.select(F.col("id").alias("src"), "cost").join(steps, "src").select(F.col("dst").alias("id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent")).alias("o"))
        if there is not None:
            offers = offers.where(F.col("o.cost") <= there["cost"])
        offers = offers.groupBy("id").agg(F.min("o").alias("o"))
        both = best.join(offers, "id", "full")
        nearer = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.cost") < F.col("cost")))
        better = nearer | (F.col("o").isNotNull() & (F.col("o.cost") == F.col("cost")) & (F.col("o.parent") < F.col("parent")))
        new = checkpoint(
            both.select("id", F.when(better, F.col("o.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("o.parent")).otherwise(F.col("parent")).alias("parent"), nearer.alias("moved")), held
        )
        held, best, front = new, new.select("id", "cost", "parent"), new.where("moved").select("id", "cost")
    rows, at = [], target
    while at != source:
        entry = best.where(F.col("id") == t.id_column(at)).first()
        if entry is None:
            return t.spark.createDataFrame([], schema)
        rows.append((entry["parent"], at, entry["cost"]))
        at = entry["parent"]
    rows.reverse()
    return t.spark.createDataFrame([(a, b, k, c) for k, (a, b, c) in enumerate(rows)], schema)


def _part(name: str):
    """Where an edge stands among those of its source: in one of 64 parts by the hash of its end, and by its end within."""
    return F.pmod(F.xxhash64(name), F.lit(64))


def random_walk(t: Topology, start: DataFrame, steps: int, walks_per_node: int = 1, seed: int | None = None) -> DataFrame:
    """``(walk_id, step, node)``: walks along out-edges, each edge row equally likely; step 0 is the start.

    A walk ends where no edge leads on. ``start`` has an order ``at`` (of a list: the position; else the identifier) and an
    identifier ``id``; known starts are numbered in that order, then by repetition. The same seed gives the same walks however rows and work
    are split, and however large the graph is.
    """
    if steps < 0 or walks_per_node < 0:
        raise ValueError("steps and walks_per_node are 0 or more")
    chosen = DEFAULT_SEED if seed is None else seed
    known, _ = numbered(start.join(t.vertices, "id", "left_semi").select(F.col("at").alias("k0"), "id"), "k0")
    known = known.withColumnRenamed("at", "k")
    walkers = known.select(F.explode(F.sequence(F.lit(1), F.lit(walks_per_node))).alias("r"), "k", "id") if walks_per_node else known.select(F.lit(1).alias("r"), "k", "id").limit(0)
    walkers = walkers.select((F.col("k") * walks_per_node + F.col("r") - 1).cast("long").alias("walk_id"), F.col("id").alias("node"))
    kind = T.LongType() if t.id_type == "bigint" else T.StringType()
    schema = T.StructType([T.StructField("walk_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("node", kind)])
    if t.small:
        table = t.edges.withColumn("part", _part("dst").cast("int")).toArrow()
        ids, s, d = encode(table.column("src"), table.column("dst"))
        order = np.lexsort((d, table.column("part").to_numpy(), s))
        start = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=len(ids)), out=start[1:])
        shared = t.spark.sparkContext.broadcast((ids, start, d[order]))

        def run(batches):
            import pyarrow.compute as pc

            ids, start, ends = shared.value
            for b in batches:
                walk = b.column(0).to_numpy()
                at = pc.index_in(b.column(1), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
                for step in range(steps + 1):
                    if not len(at):
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(walk), pa.array(np.full(len(walk), step, np.int64)), ids.take(pa.array(at))], names=schema.names)
                    size = start[at + 1] - start[at]
                    on = size > 0
                    walk, at, size = walk[on], at[on], size[on]
                    if len(at):
                        at = ends[start[at] + draw(chosen, walk, step) % size]

        return walkers.repartition(t.spark.sparkContext.defaultParallelism, "walk_id").mapInArrow(run, schema)
    return _joined_walks(t, walkers, steps, chosen).select("walk_id", F.col("step").cast("long").alias("step"), "node")


def _joined_walks(t: Topology, walkers: DataFrame, steps: int, seed: int) -> DataFrame:
    """Neighbour lists as rows: each merged edge covers a range of positions at its source, cut into blocks.

    A node's positions are numbered in two stages (parts of its edges by hash, then within a part), so the busiest
    node is no single task's work; a walker looks up the block of the position it draws.
    """
    merged = checkpoint(t.edges.groupBy("src", "dst").agg(F.count("*").alias("m")).withColumn("part", _part("dst")))
    parts = merged.groupBy("src", "part").agg(F.sum("m").alias("size"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy("src")))
    within = Window.partitionBy("src", "part").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    placed = merged.join(parts, ["src", "part"]).withColumn("lo", F.col("base") + F.coalesce(F.sum("m").over(within), F.lit(0)))
    placed = placed.select("src", "dst", "lo", (F.col("lo") + F.col("m")).alias("hi"))
    first, last = F.floor(F.col("lo") / WALK_BLOCK), F.floor((F.col("hi") - 1) / WALK_BLOCK)
    lookup = checkpoint(placed.select(F.col("src").alias("node"), F.explode(F.sequence(first, last)).alias("block"), "dst", "lo", "hi"))
    size = checkpoint(parts.select(F.col("src").alias("node"), "total").distinct())
    now = checkpoint(walkers)
    out = now.withColumn("step", F.lit(0))
    for step in range(steps):
        drawn = now.join(size, "node").withColumn("draw", F.pmod(draw_column(seed, F.col("walk_id"), step), F.col("total")))
        drawn = drawn.withColumn("block", F.floor(F.col("draw") / WALK_BLOCK))
        met = drawn.join(lookup, ["node", "block"]).where((F.col("lo") <= F.col("draw")) & (F.col("draw") < F.col("hi")))
        now = checkpoint(met.select("walk_id", F.col("dst").alias("node")))
        if now.isEmpty():
            break
        out = out.unionByName(now.withColumn("step", F.lit(step + 1)))
    return out
