"""The canonical edge table behind a graph, built once for each frame and shared by its derivations."""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import col
from weftline.errors import ComputeError
from weftline.functions.expr import Expr, lower
from weftline.shipping import ship

__all__ = ["Topology", "TopologyCell", "canonical_id", "kernel_edges", "encode", "builds"]

#: Graphs of up to so many edges, and bytes of identifiers, may be handed to one task or broadcast; larger
#: ones are worked on by distributed joins, with the same results. Set ``weftline.kernel.edges`` and ``weftline.kernel.bytes`` in the session
#: to change it.
KERNEL_EDGES = 4_000_000
KERNEL_BYTES = 128 << 20

_builds = 0


def builds() -> int:
    """How many topologies this process has built."""
    return _builds


def kernel_edges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("weftline.kernel.edges", str(KERNEL_EDGES)))


def canonical_id(df: DataFrame, name: str) -> Column:
    """An identifier as long or string; anything else is no identifier."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return col(name).cast("long")
    if isinstance(kind, T.StringType):
        return col(name)
    if isinstance(kind, T.NullType):
        return col(name).cast("long")
    raise TypeError(f"column {name!r} holds {kind.simpleString()}: identifiers are integers or strings")


class Topology:
    """Edges ``(src, dst)`` along with all their other columns, kept in memory or on disk.

    What follows from them (vertices, degrees, the simple undirected graph) is derived lazily. Rows that another evaluation
    could choose otherwise (``once``) are kept whole, so that weights are of the same rows.
    """

    def __init__(self, edges: DataFrame, src: str, dst: str, on_null: str, once: bool = False):
        global _builds
        a, b = canonical_id(edges, src), canonical_id(edges, dst)
        kinds = edges.select(a.alias("a"), b.alias("b")).dtypes
        if kinds[0][1] != kinds[1][1]:
            raise TypeError(f"{src!r} is {kinds[0][1]} and {dst!r} is {kinds[1][1]}: both ends are integers, or both strings")
        self.id_type = kinds[0][1]
        self.spark = edges.sparkSession
        ship(self.spark)
        if on_null == "drop":
            edges = edges.where(col(src).isNotNull() & col(dst).isNotNull())
        if once:
            edges = edges.persist()
        self.source, self.src, self.dst = edges, src, dst
        self.edges = edges.select(a.alias("src"), b.alias("dst")).persist()
        self._kept, self._weighted, self._vertices = [self.edges, *([edges] if once else [])], {}, None
        size = F.octet_length("src") + F.octet_length("dst") if self.id_type == "string" else F.lit(16)
        counted = self.edges.agg(F.count("*").alias("n"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls"), F.sum(size).alias("bytes")).first()
        if counted["nulls"]:
            self.release()
            raise ValueError(f"{counted['nulls']} edges have a null endpoint; on_null='drop' leaves them out")
        self.n_edges: int = counted["n"]
        bound = int(self.spark.conf.get("weftline.kernel.bytes", str(KERNEL_BYTES)))
        self.small = self.n_edges <= kernel_edges(edges) and (counted["bytes"] or 0) <= bound
        _builds += 1

    def release(self) -> None:
        """Give back what is kept in memory or on executors' disks."""
        for df in self._kept:
            df.unpersist()

    @property
    def vertices(self) -> DataFrame:
        """``(id)``: every endpoint once; kept, as most algorithms end with a join to it."""
        if self._vertices is None:
            self._vertices = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().persist()
            self._kept.append(self._vertices)
        return self._vertices

    @property
    def undirected(self) -> DataFrame:
        """``(src, dst)`` with ``src < dst``: neither loops nor directions nor parallel edges."""
        e = self.edges.where(F.col("src") != F.col("dst"))
        return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def along(self, direction: str) -> DataFrame:
        """``(src, dst)`` in the direction of travel: both ways are the edges and their reverse."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        match direction:
            case "out":
                return self.edges
            case "in":
                return back
            case "both":
                return self.edges.unionByName(back)
        raise ValueError(f"direction is 'out', 'in' or 'both', not {direction!r}")

    def weighted(self, weight: Expr | None) -> DataFrame:
        """``(src, dst, w)``: one double a row, 1 without a weight. Null or negative weights are errors."""
        if weight is None:
            return self.edges.withColumn("w", F.lit(1.0))
        if not isinstance(weight, Expr):
            raise TypeError("weight is an expression over edge columns")
        value = lower(weight, self.source, {})
        kind = self.source.select(value.alias("w")).schema[0].dataType
        if not isinstance(kind, T.NumericType):
            raise ComputeError(f"weight must be numeric, not {kind.simpleString()}")
        if repr(weight) in self._weighted:
            return self._weighted[repr(weight)]
        out = self.source.select(
            canonical_id(self.source, self.src).alias("src"), canonical_id(self.source, self.dst).alias("dst"), value.cast("double").alias("w")
        ).persist()  # checked and used in one evaluation
        seen = out.agg(F.count_if(F.col("w").isNull()).alias("nulls"), F.count_if(F.col("w") < 0).alias("negative"), F.count_if(F.isnan("w")).alias("nan")).first()
        if seen["nulls"] or seen["negative"] or seen["nan"]:
            out.unpersist()
            raise ComputeError(f"weight is null on {seen['nulls']} edges" if seen["nulls"] else "weight must be non-negative")
        self._weighted[repr(weight)] = out
        self._kept.append(out)
        return out

    def id_column(self, value) -> Column:
        return F.lit(value).cast(self.id_type)


class TopologyCell:
    """Holds the topology that a frame and its property-preserving derivations share."""

    def __init__(self):
        self._lock = threading.Lock()
        self._made: Topology | None = None

    def get(self, make) -> Topology:
        with self._lock:
            if self._made is None:
                self._made = make()
            return self._made

    def drop(self) -> None:
        with self._lock:
            if self._made is not None:
                self._made.release()
                self._made = None


def encode(src: pa.Array, dst: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Identifiers in ascending order, and both endpoint columns as positions in them."""
    both = pa.concat_arrays([_flat(src), _flat(dst)])
    ids = pc.unique(both)
    ids = ids.take(pc.sort_indices(ids))
    codes = pc.index_in(both, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, codes[: len(src)], codes[len(src) :]


def _flat(a) -> pa.Array:
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    return a
