"""One ranking from several differently-scaled scores.

Method: Borda count. Every score is replaced by its place among the scores of the group (competition
ranks), the places are weighted and summed, and the sums are sorted with the identifier as tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.columns import col, require, stored
from weftline.llm.topn import top_n_per_group
from weftline.operators.prefix import running_sums

__all__ = ["borda_points", "borda_ranking"]

#: Rows of one group that are ranked in one task. A group with more is ranked by its values, in ranges of equal size.
GROUP_ROWS = 1_000_000


def _number(score: Column) -> Column:
    """The score as a double, zero without a sign; null where it is null or NaN."""
    x = score.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(x), x)


def _missing_place(known: Column, unknown: Column, ties: str, missing: str) -> Column:
    if missing == "mid":
        return (known + unknown + 1) / 2.0
    return known + 1.0 + (unknown - 1) / 2.0 if ties == "average" else known + 1.0


def _small_points(rows: DataFrame, weights: list[float], ties: str, missing: str) -> DataFrame:
    """Points within groups of bounded size: one shuffle by group serves all scores."""
    out = rows.repartition("g").distinct()
    whole, total = Window.partitionBy("g"), F.lit(0.0)
    for k, weight in enumerate(weights):
        x = F.col(f"x{k}")
        down = whole.orderBy(x.desc_nulls_last())
        first = F.rank().over(down).cast("double")
        last = F.count("*").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        known, every = F.count(x).over(whole), F.count("*").over(whole)
        place = F.when(x.isNull(), _missing_place(known, every - known, ties, missing)).otherwise((first + last) / 2.0 if ties == "average" else first)
        total = total + F.lit(weight) * place
    return out.select("g", "i", total.alias("points"))


def _places(values: DataFrame, ties: str, missing: str) -> DataFrame:
    """From one row per group and value (null: missing) with its count ``n``: the place of the value.

    The rows of greater value are a running sum over the values in descending order, however many a group has.
    """
    there = values.where(F.col("x").isNotNull())
    placed = running_sums(there, "g", [F.col("x").desc()], {"upto": F.col("n")})
    place = (1 + F.col("upto") - F.col("n")).cast("double")
    ranked = placed.select("g", "x", (place + (F.col("n") - 1) / 2 if ties == "average" else place).alias("place"))
    absent = F.col("x").isNull()
    total = values.groupBy("g").agg(F.sum(F.when(absent, 0).otherwise(F.col("n"))).alias("known"), F.sum(F.when(absent, F.col("n")).otherwise(0)).alias("unknown"))
    at = _missing_place(F.col("known"), F.col("unknown"), ties, missing)
    return ranked.unionByName(total.where(F.col("unknown") > 0).select("g", F.lit(None).cast("double").alias("x"), at.alias("place")))


def _large_points(rows: DataFrame, weights: list[float], ties: str, missing: str) -> DataFrame:
    """Points within groups of any size: values are counted, placed by bucket, and joined back."""
    rows = stored(rows.distinct())
    out, total = rows, F.lit(0.0)
    for k, weight in enumerate(weights):
        values = stored(rows.groupBy("g", F.col(f"x{k}").alias("x")).agg(F.count("*").alias("n")))
        # Missing values join by a flag and a zero: null-safe equality would not be a hashed join key.
        lookup = _places(values, ties, missing).select(
            F.col("g").alias(f"g{k}"), F.coalesce("x", F.lit(0.0)).alias(f"v{k}"), F.col("x").isNull().alias(f"m{k}"), F.col("place").alias(f"place{k}")
        )
        x = F.col(f"x{k}")
        out = out.join(lookup, (F.col("g") == F.col(f"g{k}")) & (F.coalesce(x, F.lit(0.0)) == F.col(f"v{k}")) & (x.isNull() == F.col(f"m{k}")))
        total = total + F.lit(weight) * F.col(f"place{k}")
    return out.select("g", "i", total.alias("points"))


def _parts(df: DataFrame, group: str, item: str, scores: dict[str, float], ties: str, missing: str) -> tuple[DataFrame, DataFrame | None]:
    """``(g, i, points)`` of the small groups and, if there are any, of the large ones."""
    require(df, group, item, *scores)
    if ties not in ("average", "min") or missing not in ("mid", "last"):
        raise ValueError("ties is 'average' or 'min', missing is 'mid' or 'last'")
    rows = df.select(col(group).alias("g"), col(item).alias("i"), *[_number(col(s)).alias(f"x{k}") for k, s in enumerate(scores)])
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull())
    weights = [float(x) for x in scores.values()]
    large = stored(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("g"))
    if large.isEmpty():
        return _small_points(rows, weights, ties, missing), None
    return _small_points(rows.join(large, "g", "left_anti"), weights, ties, missing), _large_points(rows.join(large, "g", "left_semi"), weights, ties, missing)


def borda_points(
    df: DataFrame,
    group: str,
    item: str,
    scores: dict[str, float],
    *,
    ties: str = "average",
    missing: str = "mid",
) -> DataFrame:
    """``(group, item, points)``: the weighted sum of the item's places by each score; least is best.

    ``scores`` maps score columns to weights; greater scores take smaller places, from 1. Equal scores
    share the mean of their places (``ties="average"``) or all take the first (``"min"``). A null or NaN
    score takes the middle place (``missing="mid"``) or ranks below every number (``"last"``), with
    infinity as a number. Rows that agree in group, item and scores count once; further columns are
    ignored. A null group or item takes no part, and an empty input gives an empty result.

    Groups up to ``GROUP_ROWS`` rows are ranked as they are, by one shuffle. No larger one is gathered into one task:
    its values are counted first, and placed in ranges of equal size; the places are joined back, where Spark splits the
    partitions of very frequent values.
    """
    small, large = _parts(df, group, item, scores, ties, missing)
    both = small if large is None else small.unionByName(large)
    return both.select(F.col("g").alias(group), F.col("i").alias(item), "points")


def borda_ranking(df: DataFrame, group: str, item: str, scores: dict[str, float], n: int, *, ties: str = "average", missing: str = "mid") -> DataFrame:
    """``(group, item, points, rank)``: the first ``n`` items of each group by :func:`borda_points`.

    Equal sums put the smaller item first. An item with several different rows in a group takes its
    best sum.
    """
    small, large = _parts(df, group, item, scores, ties, missing)
    best = lambda points: points.groupBy("g", "i").agg(F.min("points").alias("points"))
    order = Window.partitionBy("g").orderBy("points", "i")
    ranked = best(small).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if large is not None:
        ranked = ranked.unionByName(top_n_per_group(best(large), "g", [("points", "asc"), ("i", "asc")], n, rank="rank"))
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "points", "rank")
