"""Running sums within keys of any number of rows: no key is gathered into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.columns import col, fresh, stored

__all__ = ["running_sums"]


def running_sums(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], totals: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a column for each of ``sums``: its total over the rows of ``key`` up to and with this one in ``order``.

    For those in ``totals`` there is a column ``total_<name>`` too, of all rows of the key. Sums are whole numbers of no nulls; keys are
    not null. Rows that tie in ``order`` are taken in any sequence, so ``order`` tells apart what matters.

    Rows are sorted into ranges of key and order, of about equal size: a key may fill many. What a key's earlier ranges sum
    to is added to the sums within each. Only keys at the ends of ranges go on from one to the next, two a range,
    so what is broadcast has a few rows a range, however many rows and keys there are.
    """
    part, *inner = fresh([*df.columns, *sums], "part", *[f"v{k}" for k in range(len(sums))])
    values = dict(zip(sums, inner))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({v: sums[n] for n, v in values.items()}).repartitionByRange(ranges, col(key), *order)
    placed = stored(placed.withColumn(part, F.spark_partition_id()))
    ends = placed.groupBy(part).agg(F.min(col(key)).alias("a"), F.max(col(key)).alias("z"))
    spanning = ends.select(F.explode(F.array_distinct(F.array("a", "z"))).alias(key)).groupBy(key).agg(F.count("*").alias("k")).where("k > 1").select(key)
    pieces = placed.join(F.broadcast(spanning), key, "left_semi").groupBy(key, part).agg(*[F.sum(col(v)).alias(v) for v in inner])
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    base = pieces.select(
        key, part,
        *[F.coalesce(F.sum(col(v)).over(before), F.lit(0)).alias(f"{v}_base") for v in inner],
        *[F.sum(col(values[n])).over(every).alias(f"{values[n]}_total") for n in totals],
    )
    here = Window.partitionBy(part, key)
    run = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = placed.join(F.broadcast(base), [key, part], "left")
    running = [(F.coalesce(col(f"{v}_base"), F.lit(0)) + F.sum(col(v)).over(run)).alias(n) for n, v in values.items()]
    whole = [F.coalesce(col(f"{values[n]}_total"), F.sum(col(values[n])).over(here)).alias(f"total_{n}") for n in totals]
    return both.select(*[col(c) for c in df.columns], *running, *whole)
