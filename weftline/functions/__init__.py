"""The expression dialect: column, literal and role references, arithmetic, predicates, aggregates."""

from weftline.functions.expr import Expr, col, dst, id, lit, src

__all__ = ["Expr", "col", "dst", "id", "lit", "src"]
