"""Expression trees and their lowering to Spark columns.

A tree is kept apart from ``pyspark.sql.Column`` because it is written before any schema is known: role
references are resolved, names checked and integer division chosen when it meets a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import col as column
from weftline.errors import ColumnNotFoundError

__all__ = ["Expr", "col", "lit", "src", "dst", "id", "lower", "lower_predicate", "lower_aggregate", "aggregate_name", "AGGREGATES"]

_COMPARE = {"==", "!=", "<", "<=", ">", ">="}
_LOGIC = {"&", "|"}
_MATH = {"+", "-", "*", "/"}

AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "n_unique": F.count_distinct,
}


@dataclass(frozen=True, eq=False, repr=False)
class Expr:
    """A node of an expression tree. ``==`` builds a comparison, so trees have no hash."""

    kind: str
    payload: Any = None

    __hash__ = None  # type: ignore[assignment]

    def _with(self, op: str, other: Any, swapped: bool = False) -> Expr:
        pair = (self, other if isinstance(other, Expr) else lit(other))
        return Expr("binary", (op, *(pair[::-1] if swapped else pair)))

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return self._with("+", other, True)

    def __sub__(self, other):
        return self._with("-", other)

    def __rsub__(self, other):
        return self._with("-", other, True)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return self._with("*", other, True)

    def __truediv__(self, other):
        return self._with("/", other)

    def __rtruediv__(self, other):
        return self._with("/", other, True)

    def __eq__(self, other):  # type: ignore[override]
        return self._with("==", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._with("!=", other)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __and__(self, other):
        return self._with("&", other)

    def __rand__(self, other):
        return self._with("&", other, True)

    def __or__(self, other):
        return self._with("|", other)

    def __ror__(self, other):
        return self._with("|", other, True)

    def __invert__(self):
        return Expr("not", self)

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine predicates with & | ~")

    def mean(self) -> Expr:
        return Expr("agg", ("mean", self))

    def sum(self) -> Expr:
        return Expr("agg", ("sum", self))

    def min(self) -> Expr:
        return Expr("agg", ("min", self))

    def max(self) -> Expr:
        return Expr("agg", ("max", self))

    def count(self) -> Expr:
        return Expr("agg", ("count", self))

    def n_unique(self) -> Expr:
        return Expr("agg", ("n_unique", self))

    def alias(self, name: str) -> Expr:
        return Expr("alias", (self, name))

    def __repr__(self) -> str:
        p = self.payload
        match self.kind:
            case "col":
                return f"col({p!r})"
            case "lit":
                return repr(p)
            case "role":
                return f"{p}()"
            case "binary":
                return f"({p[1]!r} {p[0]} {p[2]!r})"
            case "not":
                return f"~{p!r}"
            case "agg":
                return f"{p[1]!r}.{p[0]}()"
            case "alias":
                return f"{p[0]!r}.alias({p[1]!r})"
            case _:
                return f"{self.kind}({p!r})"


def col(name: str) -> Expr:
    return Expr("col", name)


def lit(value: Any) -> Expr:
    if not isinstance(value, (bool, int, float, str)):
        raise TypeError(f"a literal is a bool, int, float or str, not {type(value).__name__}")
    return Expr("lit", value)


def src() -> Expr:
    return Expr("role", "src")


def dst() -> Expr:
    return Expr("role", "dst")


def id() -> Expr:  # noqa: A001
    return Expr("role", "id")


def _integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def lower(e: Expr, df: DataFrame, roles: dict[str, str]) -> Column:
    """The Spark column of ``e`` over ``df``; ``roles`` maps ``src``/``dst``/``id`` to columns of it."""
    p = e.payload
    match e.kind:
        case "col":
            if p not in df.columns:
                raise ColumnNotFoundError(f"column not found: {p!r}; the columns are {df.columns}")
            return column(p)
        case "role":
            if p not in roles:
                raise NotImplementedError(f"{p}() has no meaning here")
            return column(roles[p])
        case "lit":
            return F.lit(p)
        case "not":
            return ~lower(p, df, roles)
        case "alias":
            return lower(p[0], df, roles)
        case "binary":
            op, a, b = p[0], lower(p[1], df, roles), lower(p[2], df, roles)
            if op == "/":
                left, right = (f.dataType for f in df.select(a.alias("a"), b.alias("b")).schema.fields)
                if _integral(left) and _integral(right):  # two integers divide to an integer, toward zero
                    return F.call_function("div", a, b)
                return a.cast("double") / b.cast("double")
            return _apply(op, a, b)
        case _:
            raise NotImplementedError(f"{e!r} has no value in each row")


def _apply(op: str, a: Column, b: Column) -> Column:
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "==":
            return a == b
        case "!=":
            return a != b
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
        case ">=":
            return a >= b
        case "&":
            return a & b
        case "|":
            return a | b
    raise NotImplementedError(f"unknown operator {op!r}")


def lower_predicate(e: Any, df: DataFrame, roles: dict[str, str]) -> Column:
    """A filter condition: a comparison, or such combined by ``&``, ``|`` and ``~``."""
    if not isinstance(e, Expr):
        raise NotImplementedError(f"a filter takes an expression, not {type(e).__name__}")
    if not (e.kind == "not" or (e.kind == "binary" and e.payload[0] in _COMPARE | _LOGIC)):
        raise NotImplementedError(f"a filter takes a comparison or a combination of such, not {e!r}")
    return lower(e, df, roles)


def aggregate_name(e: Expr) -> str:
    if e.kind == "alias":
        return e.payload[1]
    fn, inner = e.payload
    return f"{inner.payload}_{fn}"


def lower_aggregate(e: Expr, df: DataFrame) -> Column:
    """``col(c).fn()``, perhaps with an alias, as an aggregate."""
    inner = e.payload[0] if e.kind == "alias" else e
    if not isinstance(inner, Expr) or inner.kind != "agg" or inner.payload[1].kind != "col":
        raise NotImplementedError(f"an aggregate is col(name).fn(), not {e!r}")
    fn, arg = inner.payload
    return AGGREGATES[fn](lower(arg, df, {}))
