"""Graph analytics on Spark with a dataframe-first interface: an edge table is the graph."""

from weftline.errors import ColumnNotFoundError, ComputeError, WeftError
from weftline.frames import EdgeFrame, GraphExpr, MaterializedFrame, NodeFrame
from weftline.functions.expr import Expr, col, dst, id, lit, src
from weftline.sources import datasets
from weftline.sources.files import read_edges, read_nodes, scan_edges, scan_nodes
from weftline.sources.memory import (
    from_arrow,
    from_edgelist,
    from_networkx,
    from_numpy,
    from_pandas,
    from_polars,
    from_scipy_sparse,
    from_spark,
    nodes_from_networkx,
)
from weftline.verbs import (
    avg_path_length,
    betweenness,
    closeness,
    clustering_coefficient,
    connected_components,
    degree,
    density,
    describe,
    diameter,
    hop,
    label_propagation,
    louvain,
    neighbors,
    pagerank,
    random_walk,
    shortest_path,
    triangle_count,
)

__all__ = [n for n in dir() if not n.startswith("_")]
