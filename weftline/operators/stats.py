"""Whole-graph statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.node_values import connected_components, distance_totals
from weftline.topology import Topology

__all__ = ["density", "describe", "avg_path_length", "diameter", "strided"]

#: Sources that an approximate diameter takes.
DIAMETER_SOURCES = 128


def _share(n: int, m: int) -> float:
    return m / (n * (n - 1)) if n > 1 else 0.0


def density(t: Topology) -> float:
    """Edge rows over ordered pairs of nodes; 0 below two nodes."""
    return _share(t.vertices.count(), t.n_edges)


def describe(t: Topology, full: bool = False) -> DataFrame:
    """One row: ``n_nodes, n_edges, density, avg_degree, n_components`` (null unless ``full``: it takes a search)."""
    n, m = t.vertices.count(), t.n_edges
    components = connected_components(t).agg(F.count_distinct("value")).first()[0] if full else None
    return t.spark.createDataFrame(
        [(n, m, _share(n, m), m / n if n else 0.0, components)],
        "n_nodes long, n_edges long, density double, avg_degree double, n_components long",
    )


def strided(share: float):
    """Positions at even strides: about ``share`` of them, one at least."""

    def pick(n: int) -> np.ndarray:
        exact = n * min(1.0, max(0.0, share))
        k = min(n, max(1, int(np.floor(exact + 0.5))))
        return np.minimum(np.floor(np.arange(k) * max(1.0, n / k)).astype(np.int64), n - 1)

    return pick


def avg_path_length(t: Topology, sample: float | None = None) -> float:
    """Mean distance over ordered pairs that a path along out-edges joins; 0 if there are none."""
    row = distance_totals(t, sources=None if sample is None else strided(sample)).agg(F.sum("sum_d"), F.sum("n_reached")).first()
    return row[0] / row[1] if row[1] else 0.0


def diameter(t: Topology, approximate: bool = True) -> int:
    """The greatest distance that occurs; the approximate one is a lower bound from evenly strided sources."""
    pick = (lambda n: strided(min(1.0, DIAMETER_SOURCES / n))(n)) if approximate else None
    return int(distance_totals(t, sources=pick).agg(F.coalesce(F.max("max_d"), F.lit(0))).first()[0])
