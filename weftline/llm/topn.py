"""Top N items within every group.

Method: two-stage salted ranking. Each group is hashed into subgroups; every subgroup is ranked and
keeps N; the survivors are ranked by score and identifier. A subgroup is what a group has in one split of the input,
so no task works on more of it than a split holds. Spark prunes each ranking to N rows a subgroup before
its shuffle too, so a group with millions of items is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.columns import col, fresh, require

__all__ = ["top_n_per_group", "SUBGROUPS"]

#: Subgroups that a group's splits are hashed into: one a split, for any number of splits that occurs.
SUBGROUPS = 1 << 20


def _ordering(order: list[tuple[str, str]]) -> list[Column]:
    if bad := [d for _, d in order if d not in ("asc", "desc")]:
        raise ValueError(f"a direction is 'asc' or 'desc', not {bad[0]!r}")
    return [col(c).desc_nulls_last() if d == "desc" else col(c).asc_nulls_last() for c, d in order]


def top_n_per_group(
    df: DataFrame,
    group: str | list[str],
    order: list[tuple[str, str]],
    n: int,
    *,
    same: list[str] | None = None,
    subgroups: int = SUBGROUPS,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group in the given order, e.g. ``[("weight", "desc"), ("id", "asc")]``.

    A group of fewer rows comes out whole. ``order`` ends with an identifier, so that the choice is the
    same on every run; nulls come last in either direction. Rows with a null group key belong to no
    group. With ``same``, rows that agree in the group and these columns are one item, delivered
    repeatedly, and count once: they share a place in the rankings, so that pruning needs no merging before it, and are
    merged among the survivors. The result then has the group and these columns only, which must hold all columns
    of ``order``. Without ``same`` all columns are kept, whatever their names. ``rank`` names a column for the
    place, from 1. ``n`` of 0 and an empty input give an empty result.
    """
    groups = [group] if isinstance(group, str) else list(group)
    require(df, *groups, *[c for c, _ in order], *(same or []))
    if n < 0 or subgroups < 1:
        raise ValueError("n is 0 or more, and there is at least one subgroup")
    rows = df
    for g in groups:
        rows = rows.where(col(g).isNotNull())
    by = _ordering(order)
    if same is not None:
        kept = list(dict.fromkeys([*groups, *same]))
        if missing := [c for c, _ in order if c not in kept]:
            raise ValueError(f"order has {missing}, which are not in same")
        rows = rows.select(*[col(c) for c in kept])
        ordered = {c for c, _ in order}
        by += [col(c).asc_nulls_last() for c in kept if c not in ordered and c not in groups]  # so that none but copies tie
    salt, place, final = fresh(rows.columns, "salt", "place", "final")
    keys = [col(g) for g in groups]
    ranking = F.row_number if same is None else F.dense_rank
    once = (lambda df: df) if same is None else DataFrame.distinct  # where all copies already are: no shuffle
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(subgroups)))
    within = salted.withColumn(place, ranking().over(Window.partitionBy(*keys, col(salt)).orderBy(*by)))
    survivors = once(within.where(col(place) <= n).drop(place)).drop(salt)
    ranked = survivors.withColumn(final, ranking().over(Window.partitionBy(*keys).orderBy(*by))).where(col(final) <= n)
    ranked = once(ranked)
    return ranked.withColumnRenamed(final, rank) if rank else ranked.drop(final)
