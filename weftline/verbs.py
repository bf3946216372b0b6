"""The graph verbs: algorithms as expressions or frames, traversals, and whole-graph statistics."""

from __future__ import annotations

from typing import Any

from weftline.frames import EdgeFrame, GraphExpr, NodeFrame
from weftline.functions.expr import Expr
from weftline.operators import stats

__all__ = [
    "avg_path_length",
    "betweenness",
    "closeness",
    "clustering_coefficient",
    "connected_components",
    "degree",
    "density",
    "describe",
    "diameter",
    "hop",
    "label_propagation",
    "louvain",
    "neighbors",
    "pagerank",
    "random_walk",
    "shortest_path",
    "triangle_count",
]


def degree(edges: EdgeFrame, direction: str = "out") -> GraphExpr:
    return GraphExpr("degree", edges, direction=direction)


def pagerank(edges: EdgeFrame, damping: float = 0.85, max_iter: int = 30, tol: float = 1e-6, weight: Expr | None = None) -> GraphExpr:
    return GraphExpr("pagerank", edges, damping=damping, max_iter=max_iter, tol=tol, weight=weight)


def connected_components(edges: EdgeFrame, mode: str = "weak") -> GraphExpr:
    return GraphExpr("connected_components", edges, mode=mode)


def triangle_count(edges: EdgeFrame) -> GraphExpr:
    return GraphExpr("triangle_count", edges)


def clustering_coefficient(edges: EdgeFrame) -> GraphExpr:
    return GraphExpr("clustering_coefficient", edges)


def closeness(edges: EdgeFrame, weight: Expr | None = None) -> GraphExpr:
    return GraphExpr("closeness", edges, weight=weight)


def betweenness(edges: EdgeFrame, sample: float | None = None, weight: Expr | None = None, seed: int | None = None) -> GraphExpr:
    return GraphExpr("betweenness", edges, sample=sample, weight=weight, seed=seed)


def label_propagation(edges: EdgeFrame, max_iter: int = 20, seed: int | None = None, weight: Expr | None = None) -> GraphExpr:
    if weight is not None:
        raise NotImplementedError("label_propagation takes no weight")
    return GraphExpr("label_propagation", edges, max_iter=max_iter, seed=seed)


def louvain(edges: EdgeFrame, weight: Expr | None = None, resolution: float = 1.0, seed: int | None = None) -> GraphExpr:
    return GraphExpr("louvain", edges, weight=weight, resolution=resolution, seed=seed)


class neighbors:  # noqa: N801
    """``neighbors(edges).agg(col(c).mean())``: an attribute of each node's neighbours, folded."""

    def __init__(self, edges: EdgeFrame, direction: str = "out", from_: Any = None):
        self._edges, self._how = edges, {"direction": direction, "from_": from_}

    def agg(self, expr: Expr) -> GraphExpr:
        return GraphExpr("neighbors_agg", self._edges, agg=expr, **self._how)


class hop:  # noqa: N801
    """``hop(edges, n).from_(seeds)``: an edge frame ``(src=seed, dst=reached)``, and all its verbs."""

    def __init__(self, edges: EdgeFrame, n: int = 1, direction: str = "out", seeds: Any = None):
        self._args = {"edges": edges, "n": n, "direction": direction, "seeds": seeds}

    def from_(self, seeds: Any) -> hop:
        a = self._args
        return hop(a["edges"], a["n"], a["direction"], seeds)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(EdgeFrame._traversal("hop", **self._args), name)


def shortest_path(edges: EdgeFrame, source: Any, target: Any, weight: Expr | None = None, direction: str = "out") -> EdgeFrame:
    return EdgeFrame._traversal("shortest_path", edges=edges, source=source, target=target, weight=weight, direction=direction)


def random_walk(edges: EdgeFrame, start: Any, steps: int, walks_per_node: int = 1, seed: int | None = None) -> NodeFrame:
    return NodeFrame._traversal("random_walk", "node", edges=edges, start=start, steps=steps, walks_per_node=walks_per_node, seed=seed)


def describe(edges: EdgeFrame, full: bool = False) -> NodeFrame:
    return NodeFrame._traversal("describe", "id", edges=edges, full=full)


def density(edges: EdgeFrame) -> float:
    return stats.density(edges.topology())


def avg_path_length(edges: EdgeFrame, sample: float | None = None) -> float:
    return stats.avg_path_length(edges.topology(), sample)


def diameter(edges: EdgeFrame, approximate: bool = True) -> int:
    return stats.diameter(edges.topology(), approximate)
