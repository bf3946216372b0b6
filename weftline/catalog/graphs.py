"""Graphs over the whole tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import weftline as w
from weftline.catalog.registry import read

__all__ = ["supply", "trade", "flow", "copurchase", "tree", "stars", "ring", "karate", "karate_w", "lesmis", "EDGES"]

#: Parts are offset in graphs that mix them with suppliers or customers.
OFFSET = 1_000_000

#: The same edges in SQL, as ``select src, dst, weight``.
EDGES = {
    "supply": f"select l_suppkey as src, {OFFSET} + l_partkey as dst, l_quantity as weight from lineitem",
    "trade": f"select o_custkey as src, {OFFSET} + l_suppkey as dst, l_extendedprice * (1 - l_discount) as weight from orders join lineitem on o_orderkey = l_orderkey",
    "flow": """select c_nationkey::bigint as src, s_nationkey::bigint as dst, 1.0 as weight
      from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey""",
    "copurchase": """select distinct a.l_partkey as src, b.l_partkey as dst, 1.0 as weight
      from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey""",
    "tree": """select concat('c', c_custkey) as src, concat('n', c_nationkey) as dst, 1.0 as weight from customer
      union all select concat('n', n_nationkey), concat('r', n_regionkey), 1.0 from nation""",
    "stars": "select concat('c', c_custkey) as src, concat('n', c_nationkey) as dst, 1.0 as weight from customer",
    "ring": """select concat('c', c_custkey) as src, concat('n', c_nationkey) as dst, 40.0 as weight from customer
      union all select concat('c', c_custkey), concat('n', (c_nationkey + 1) % 25), 1.0 from customer""",
    "karate_w": "select src, dst, (1 + edge_id % 5)::double as weight from karate_edges where src is not null and dst is not null",
    "karate": "select src, dst, 1.0 as weight from karate_edges where src is not null and dst is not null",
    "lesmis": "select src, dst, coalesce(weight, 0)::double as weight from lesmis_edges where src is not null and dst is not null",
}


def _frame(df) -> w.EdgeFrame:
    return w.from_spark(df, src="src", dst="dst")


def supply(spark: SparkSession, sf: str) -> w.EdgeFrame:
    d = read(spark, sf, "lineitem")
    return _frame(d.select(F.col("l_suppkey").alias("src"), (F.lit(OFFSET) + F.col("l_partkey")).alias("dst"), F.col("l_quantity").alias("weight")))


def trade(spark: SparkSession, sf: str) -> w.EdgeFrame:
    d = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _frame(d.select(F.col("o_custkey").alias("src"), (F.lit(OFFSET) + F.col("l_suppkey")).alias("dst"), "l_extendedprice", "l_discount"))


def flow(spark: SparkSession, sf: str) -> w.EdgeFrame:
    d = read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    d = d.join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _frame(d.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")))


def copurchase(spark: SparkSession, sf: str) -> w.EdgeFrame:
    a = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"))
    b = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return _frame(a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct())


def tree(spark: SparkSession, sf: str) -> w.EdgeFrame:
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    up = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return _frame(up.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))))


def _towards(d, key):
    return d.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), key).alias("dst"))


def stars(spark: SparkSession, sf: str) -> w.EdgeFrame:
    """Customers to their nation: each nation is a community, whatever the method."""
    return _frame(_towards(read(spark, sf, "customer"), F.col("c_nationkey")))


def ring(spark: SparkSession, sf: str) -> w.EdgeFrame:
    """Customers to their nation and, by a fortieth of the weight, to the next one: by weight nations are communities."""
    d = read(spark, sf, "customer")
    heavy = _towards(d, F.col("c_nationkey")).withColumn("weight", F.lit(40.0))
    return _frame(heavy.unionByName(_towards(d, (F.col("c_nationkey") + 1) % 25).withColumn("weight", F.lit(1.0))))


def _whole(df):
    return df.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def karate(spark: SparkSession, sf: str) -> w.EdgeFrame:
    return _frame(_whole(read(spark, sf, "karate_edges")))


def karate_w(spark: SparkSession, sf: str) -> w.EdgeFrame:
    d = _whole(read(spark, sf, "karate_edges"))
    return _frame(d.select("src", "dst", (1 + F.col("edge_id") % 5).cast("double").alias("weight")))


def lesmis(spark: SparkSession, sf: str) -> w.EdgeFrame:
    d = _whole(read(spark, sf, "lesmis_edges"))
    return _frame(d.withColumn("weight", F.coalesce("weight", F.lit(0))))
