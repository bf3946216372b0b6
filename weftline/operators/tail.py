"""Relational tails over any DataFrame, and joins of two: all left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.columns import col, fresh
from weftline.errors import ColumnNotFoundError
from weftline.functions.expr import lower_aggregate, lower_predicate
from weftline.plans.steps import Tail, check_exists, names_of

__all__ = ["apply_tail", "sample_rows", "join_frames", "DEFAULT_SEED"]

#: Used wherever no seed is given, so that results are the same on every run.
DEFAULT_SEED = 0x5EED5EED5EED5EED


def _comparable(df: DataFrame) -> list:
    """Every column in a form that can be hashed and ordered: maps as text."""
    return [F.to_json(col(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name) for f in df.schema.fields]


def sample_rows(df: DataFrame, n: int, seed: int | None) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same for the same seed however rows are laid out.

    Rows are drawn by the order of a seeded hash of their content; copies of a row are numbered first, so
    that they are drawn each for itself. A top-n by hash needs no full sort and no shuffle of the rest.
    """
    parts = _comparable(df)
    occurrence, draw = fresh(df.columns, "occurrence", "draw")
    seeded = F.lit(DEFAULT_SEED if seed is None else seed).cast("long")
    content = F.xxhash64(*parts)
    numbered = df.withColumn(occurrence, F.row_number().over(Window.partitionBy(content, *parts).orderBy(F.lit(0))))
    drawn = numbered.withColumn(draw, F.xxhash64(seeded, content, col(occurrence)))
    return drawn.orderBy(col(draw), *parts, col(occurrence)).limit(n).drop(occurrence, draw)


def apply_tail(df: DataFrame, tail: Tail, roles: dict[str, str]) -> DataFrame:
    """Run a normal form: filters, group, distinct, sample, sort, limit, rename, select."""
    for predicate in tail.filters:
        df = df.filter(lower_predicate(predicate, df, roles))
    if tail.group_keys:
        check_exists(tail.group_keys, df.columns)
        df = df.groupBy(*[col(k) for k in tail.group_keys]).agg(*[lower_aggregate(e, df).alias(name) for name, e in tail.aggregates])
    if tail.distinct:
        df = df.distinct()
    if tail.sample is not None:
        df = sample_rows(df, *tail.sample)
    if tail.sort is not None:
        by, descending = tail.sort
        check_exists([by], df.columns)
        df = df.orderBy(col(by).desc_nulls_last() if descending else col(by).asc_nulls_last())
    if tail.limit is not None:
        df = df.limit(tail.limit)
    if tail.rename:
        check_exists(tail.rename, df.columns)
        renamed = [tail.rename.get(c, c) for c in df.columns]
        if len(set(renamed)) < len(renamed):
            raise ValueError(f"duplicate column names after rename: {renamed}")
        df = df.select(*[col(c).alias(n) for c, n in zip(df.columns, renamed)])
    if tail.select is not None:
        check_exists(tail.select, df.columns)
        df = df.select(*[col(c) for c in tail.select])
    return df


def join_frames(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Equi-join on columns of the same names: the left columns, then the right ones without the keys.

    Null keys match nothing. Spark picks the strategy from the sides' sizes and splits skewed keys.
    """
    if how not in ("inner", "left"):
        raise NotImplementedError(f"how is 'inner' or 'left', not {how!r}")
    if on is None:
        raise NotImplementedError("join takes on=, the name or names of the key columns")
    keys = names_of(on if isinstance(on, (list, tuple)) else [on])
    if not keys:
        raise NotImplementedError("join takes at least one key column")
    for side, frame in (("left", left), ("right", right)):
        for k in keys:
            if k not in frame.columns:
                raise ColumnNotFoundError(f"join key {k!r} is not in the {side} frame; its columns are {frame.columns}")
    rest = [c for c in right.columns if c not in keys]
    if clash := [c for c in rest if c in left.columns]:
        raise ValueError(f"duplicate column {clash[0]!r} in both frames: rename one first")
    inner = fresh([*left.columns, *right.columns], *[f"key{i}" for i in range(len(keys))])
    other = right.select(*[col(k).alias(n) for k, n in zip(keys, inner)], *[col(c) for c in rest])
    condition = [col(k) == col(n) for k, n in zip(keys, inner)]
    return left.join(other, condition, how).select(*[col(c) for c in left.columns], *[col(c) for c in rest])
