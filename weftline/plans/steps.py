"""The steps of a lazy frame and their canonical order.

Steps do not run as written. Whatever the order of the calls, a plan means: filters, then grouping, distinct,
sample, sort, limit, rename, select. Of several sorts, limits or samples the last one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from weftline.errors import ColumnNotFoundError
from weftline.functions.expr import Expr, aggregate_name

__all__ = ["Step", "Tail", "normal_form", "names_of"]


@dataclass(frozen=True)
class Step:
    """One call on a frame, as ``explain()`` shows it."""

    op: str
    args: dict[str, Any] = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"{self.op}({', '.join(f'{k}={v!r}' for k, v in self.args.items())})"


@dataclass
class Tail:
    """The normal form of a plan's relational steps."""

    filters: list[Any] = field(default_factory=list)
    group_keys: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, Expr]] = field(default_factory=list)
    distinct: bool = False
    sample: tuple[int, int | None] | None = None
    sort: tuple[str, bool] | None = None
    limit: int | None = None
    rename: dict[str, str] = field(default_factory=dict)
    select: list[str] | None = None
    computed: dict[str, Expr] = field(default_factory=dict)
    join: dict[str, Any] | None = None


def names_of(columns: Any) -> list[str]:
    """Plain column names out of strings and ``col(name)``."""
    out = []
    for c in columns:
        if isinstance(c, str):
            out.append(c)
        elif isinstance(c, Expr) and c.kind == "col":
            out.append(c.payload)
        else:
            raise NotImplementedError(f"a column is named by a string or col(name), not {c!r}")
    return out


def _whole(n: Any, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} takes a whole number of 0 or more, not {n!r}")
    return n


def normal_form(steps: tuple[Step, ...], *, computing: bool, joining: bool = True, grouping: bool = True) -> Tail:
    """Fold the steps, refusing what would silently mean something else.

    ``computing``, ``joining`` and ``grouping`` say whether the frame takes graph columns, joins, groups.
    """
    t = Tail()
    for step in steps:
        a = step.args
        match step.op:
            case "filter":
                if t.group_keys:
                    raise NotImplementedError("filter after group_by is not supported: filter the collected groups")
                t.filters.append(a["predicate"])
            case "select":
                if t.select is not None:
                    raise NotImplementedError("one select in a plan")
                t.select = names_of(a["columns"])
            case "with_columns":
                if not computing:
                    raise NotImplementedError("with_columns takes graph algorithms and belongs on a NodeFrame")
                if t.computed:
                    raise NotImplementedError("one with_columns in a plan: give it all columns at once")
                if t.select is not None:
                    raise NotImplementedError("with_columns after select is not supported")
                t.computed = dict(a["exprs"])
            case "rename":
                t.rename.update(a["mapping"])
            case "sort":
                by = a["by"]
                if isinstance(by, (list, tuple)):
                    raise NotImplementedError("sort takes one column")
                t.sort = (names_of([by])[0], bool(a["descending"]))
            case "head":
                t.limit = _whole(a["n"], "head")
            case "sample":
                t.sample = (_whole(a["n"], "sample"), a["seed"])
            case "distinct":
                t.distinct = True
            case "group_by":
                if not grouping:
                    raise NotImplementedError("group_by is not supported here")
                if t.group_keys:
                    raise NotImplementedError("one group_by in a plan")
                if t.sort or t.limit is not None or t.rename:
                    raise NotImplementedError("sort, head and rename before group_by are not supported: they would run after it")
                t.group_keys, t.aggregates = _groups(a["keys"], a["exprs"], a["named"])
            case "join":
                if not joining:
                    raise NotImplementedError("join is not supported here")
                if t.join is not None:
                    raise NotImplementedError("one join in a plan: collect in between")
                t.join = a
            case other:
                raise NotImplementedError(f"{other} is not supported here")
    if t.group_keys and (t.distinct or t.sample or t.select is not None):
        raise NotImplementedError("distinct, sample and select do not go with group_by")
    if t.group_keys and t.join is not None:
        raise NotImplementedError("join and group_by in one plan are not supported: collect in between")
    return t


def _groups(keys: Any, exprs: Any, named: dict[str, Any]) -> tuple[list[str], list[tuple[str, Expr]]]:
    by = names_of(keys)
    if not by:
        raise ValueError("group_by takes at least one key")
    out: list[tuple[str, Expr]] = []
    for name, e in [(None, e) for e in exprs] + list(named.items()):
        inner = e.payload[0] if isinstance(e, Expr) and e.kind == "alias" else e
        if not isinstance(inner, Expr) or inner.kind != "agg" or inner.payload[1].kind != "col":
            raise NotImplementedError(f"agg takes col(name).fn(), not {e!r}")
        out.append((name or aggregate_name(e), e))
    if not out:
        raise ValueError("agg takes at least one aggregate")
    taken = set(by)
    for name, _ in out:
        if name in taken:
            raise ValueError(f"duplicate output column {name!r}")
        taken.add(name)
    return by, out


def check_exists(names: Any, columns: list[str]) -> None:
    for n in names:
        if n not in columns:
            raise ColumnNotFoundError(f"column not found: {n!r}; the columns are {columns}")
