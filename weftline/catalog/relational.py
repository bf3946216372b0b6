"""Queries of sources, sinks, expressions, joins, groups, sorts and samples."""

from __future__ import annotations

import os
import uuid
import warnings

import numpy as np
from pyspark.sql import functions as F

import weftline as w
from weftline.catalog import graphs as G
from weftline.catalog.registry import query, read
from weftline.columns import shared_folder


class _Listed:
    """A graph with networkx's interface, and a matrix with scipy's, out of rows of the tables."""

    def __init__(self, rows):
        self.rows = rows
        self.row, self.col, self.data = (np.array([r[k] for r in rows]) for k in range(3))

    def edges(self, data=True):
        return [(int(a), int(b), {"weight": float(x)}) for a, b, x in self.rows]

    def tocoo(self):
        return self


def _nation_rows(spark, sf):
    """The nation table as (key, region key, 1 + region key): a small table that a client holds in memory."""
    return [(r[0], r[1], 1 + r[1]) for r in read(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()]


_NATION = "select n_nationkey::bigint as src, n_regionkey::bigint as dst from nation"
_NATION_W = "select n_nationkey::bigint as src, n_regionkey::bigint as dst, (1 + n_regionkey)::double as weight from nation"


@query("select l_suppkey, l_partkey, l_quantity from lineitem where l_quantity > 30")
def scan_edges(spark, sf):
    e = w.scan_edges(f"{sf}/lineitem.parquet", src="l_suppkey", dst="l_partkey")
    return e.filter(w.col("l_quantity") > 30).select("l_suppkey", "l_partkey", "l_quantity").to_spark()


@query("select c_custkey, c_mktsegment from customer where c_acctbal > 0")
def scan_nodes(spark, sf):
    return w.scan_nodes(f"{sf}/customer.parquet", id="c_custkey").filter(w.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment").to_spark()


@query("select o_custkey, o_orderkey, o_totalprice from orders")
def read_edges(spark, sf):
    return w.read_edges(f"{sf}/orders.parquet", src="o_custkey", dst="o_orderkey").df.select("o_custkey", "o_orderkey", "o_totalprice")


@query("select s_suppkey, s_name, s_acctbal from supplier")
def read_nodes(spark, sf):
    return w.read_nodes(f"{sf}/supplier.parquet", id="s_suppkey").df.select("s_suppkey", "s_name", "s_acctbal")


@query(
    """with e as (select src, dst from karate_edges where src is not null and dst is not null)
    select id, sum(n)::bigint as degree from (select src as id, 1 as n from e union all select dst, 0 from e) group by id"""
)
def scan_on_null(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return w.degree(w.scan_edges(f"{sf}/karate_edges.parquet", src="src", dst="dst", on_null="drop")).to_spark()


@query("select l_orderkey, l_partkey from lineitem union all select l_orderkey, l_partkey from lineitem")
def scan_many_paths(spark, sf):
    path = f"{sf}/lineitem.parquet"
    return w.scan_edges([path, "file://" + os.path.abspath(path)], src="l_orderkey", dst="l_partkey").select("l_orderkey", "l_partkey").to_spark()


@query(_NATION)
def inmem_edges(spark, sf):
    rows = _nation_rows(spark, sf)
    return w.EdgeFrame({"src": [r[0] for r in rows], "dst": [r[1] for r in rows]}, src="src", dst="dst").to_spark()


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def inmem_nodes(spark, sf):
    return w.NodeFrame(read(spark, sf, "region").toArrow(), id="r_regionkey").to_spark()


@query(_NATION_W)
def from_edgelist(spark, sf):
    return w.from_edgelist([(a, b, float(x)) for a, b, x in _nation_rows(spark, sf)]).to_spark()


@query(_NATION_W)
def from_networkx(spark, sf):
    return w.from_networkx(_Listed(_nation_rows(spark, sf))).to_spark()


@query(_NATION_W)
def from_numpy(spark, sf):
    return w.from_numpy(np.array(_nation_rows(spark, sf)), kind="edges").to_spark()


@query(_NATION_W)
def from_scipy_sparse(spark, sf):
    return w.from_scipy_sparse(_Listed(_nation_rows(spark, sf)), weighted=True).to_spark()


@query("select n_nationkey::bigint as src, n_regionkey::bigint as dst from nation")
def from_pandas(spark, sf):
    d = read(spark, sf, "nation").toPandas().rename(columns={"n_nationkey": "src", "n_regionkey": "dst"})
    return w.from_pandas(d[["src", "dst"]].astype("int64"), src="src", dst="dst").to_spark()


@query("select * from (values ('Mr. Hi', 17::bigint, 155::bigint), ('Officer', 17, 406)) t(club, members, total_id)")
def ds_karate(spark, sf):
    _, nodes = w.datasets.load("karate", with_nodes=True)
    return nodes.group_by("club").agg(members=w.col("id").count(), total_id=w.col("id").sum()).to_spark()


@query("select id, sum(n)::bigint as degree from (select 1000000 + l_partkey as id, 1 as n from lineitem union all select l_suppkey, 0 from lineitem) group by id")
def reverse_degree(spark, sf):
    return w.degree(G.supply(spark, sf).reverse()).to_spark()


@query(f"select distinct src as id from ({G.EDGES['tree']}) union select dst from ({G.EDGES['tree']})")
def nodes_union(spark, sf):
    return G.tree(spark, sf).nodes().to_spark()


def _sink(spark, name):
    return f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}-{name}"


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_acctbal > 1000")
def sink_roundtrip(spark, sf):
    path = _sink(spark, "supplier.parquet")
    w.scan_nodes(f"{sf}/supplier.parquet", id="s_suppkey").filter(w.col("s_acctbal") > 1000).sink_parquet(path)
    return w.scan_nodes(path, id="s_suppkey").to_spark()


@query("select n_nationkey::bigint as n_nationkey, n_name from nation")
def sink_csv_roundtrip(spark, sf):
    path = _sink(spark, "nation.csv")
    w.scan_nodes(f"{sf}/nation.parquet", id="n_nationkey").select("n_nationkey", "n_name").sink_csv(path)
    return w.scan_nodes(path, id="n_nationkey").to_spark()


@query("select p_partkey, p_name, p_retailprice from part")
def select_cols(spark, sf):
    return w.scan_nodes(f"{sf}/part.parquet", id="p_partkey").select("p_partkey", w.col("p_name"), "p_retailprice").to_spark()


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_orderstatus <> 'F'")
def filter_pred(spark, sf):
    f = w.scan_nodes(f"{sf}/orders.parquet", id="o_orderkey").filter(w.col("o_totalprice") >= 100000).filter(w.col("o_orderstatus") != "F")
    return f.select("o_orderkey", "o_totalprice").to_spark()


@query("select p_partkey, p_size, p_retailprice from part where p_size // 7 = 3 and p_retailprice / 2 + 10 > 500 and 100 - p_size * 2 < 60")
def arith_pred(spark, sf):
    f = w.scan_nodes(f"{sf}/part.parquet", id="p_partkey")
    f = f.filter((w.col("p_size") / 7 == 3) & (w.col("p_retailprice") / 2 + 10 > 500) & (100 - w.col("p_size") * 2 < 60))
    return f.select("p_partkey", "p_size", "p_retailprice").to_spark()


@query("select id, club from karate_nodes where not (club = 'Heron') or id < 1200")
def bool_pred(spark, sf):
    f = w.scan_nodes(f"{sf}/karate_nodes.parquet", id="id")
    return f.filter(~(w.col("club") == "Heron") | (w.id() < 1200)).select("id", "club").to_spark()


@query("select src, dst, edge_id from karate_edges where src < dst and dst <> 1")
def role_filter(spark, sf):
    e = w.scan_edges(f"{sf}/karate_edges.parquet", src="src", dst="dst")
    return e.filter((w.src() < w.dst()) & (w.dst() != 1)).select("src", "dst", "edge_id").to_spark()


@query("select c_custkey as customer, c_name as label from customer where c_acctbal < 0")
def rename_tail(spark, sf):
    f = w.scan_nodes(f"{sf}/customer.parquet", id="c_custkey").rename({"c_custkey": "customer"}).rename({"c_name": "label"})
    return f.select("customer", "label").filter(w.col("c_acctbal") < 0).to_spark()


@query(
    """select c_mktsegment, avg(c_acctbal) as c_acctbal_mean, sum(c_custkey)::bigint as total, min(c_acctbal) as low, max(c_acctbal) as high,
      count(c_name)::bigint as n, count(distinct c_nationkey)::bigint as nations from customer group by c_mktsegment"""
)
def group_by_all(spark, sf):
    c = w.col
    f = w.scan_nodes(f"{sf}/customer.parquet", id="c_custkey").group_by("c_mktsegment")
    f = f.agg(c("c_acctbal").mean(), c("c_custkey").sum().alias("total"), c("c_acctbal").min().alias("low"), high=c("c_acctbal").max(), n=c("c_name").count(), nations=c("c_nationkey").n_unique())
    return f.to_spark().withColumn("c_acctbal_mean", F.round("c_acctbal_mean", 6))


@query("select l_returnflag, l_linestatus, sum(l_linenumber)::bigint as l_linenumber_sum, count(l_quantity)::bigint as n from lineitem where l_discount > 0.02 group by all")
def group_by_multi(spark, sf):
    e = w.scan_edges(f"{sf}/lineitem.parquet", src="l_orderkey", dst="l_partkey").filter(w.col("l_discount") > 0.02)
    return e.group_by("l_returnflag", w.col("l_linestatus")).agg(w.col("l_linenumber").sum(), n=w.col("l_quantity").count()).to_spark()


@query("select club, count(deleted_at)::bigint as n_deleted, count(distinct deleted_at)::bigint as times, max(deleted_at) as deleted_at_max from karate_nodes group by club")
def group_by_nulls(spark, sf):
    f = w.scan_nodes(f"{sf}/karate_nodes.parquet", id="id").group_by("club")
    return f.agg(w.col("deleted_at").max(), n_deleted=w.col("deleted_at").count(), times=w.col("deleted_at").n_unique()).to_spark()


@query(
    """with once as (select distinct graph_name, id, pagerank, in_degree, computed_at from readme)
    select graph_name, id, case when not isnan(pagerank) then pagerank end as pagerank, coalesce(isnan(pagerank), false) as pagerank_nan, in_degree, computed_at from once"""
)
def distinct_rows(spark, sf):
    """NaN has no common form to be compared in, so it is a column of its own."""
    once = w.scan_nodes(f"{sf}/readme.parquet", id="id").distinct().to_spark()
    return once.withColumns({"pagerank_nan": F.coalesce(F.isnan("pagerank"), F.lit(False)), "pagerank": F.when(~F.isnan("pagerank"), F.col("pagerank"))})


@query("select lang, count(doc_id)::bigint as n from documents group by lang order by lang desc nulls last limit 12")
def sort_nulls(spark, sf):
    f = w.scan_nodes(f"{sf}/documents.parquet", id="doc_id").group_by("lang").agg(n=w.col("doc_id").count())
    return f.sort("lang", descending=True).head(12).to_spark()


@query("select o_totalprice from orders order by o_totalprice desc limit 25")
def topk(spark, sf):
    """A sort has one column, so of equal prices any order may come; the prices are what is certain."""
    return w.scan_nodes(f"{sf}/orders.parquet", id="o_orderkey").head(25).sort("o_totalprice", descending=True).select("o_totalprice").to_spark()


@query("select least(1000, count(*))::bigint as n_rows, 0::bigint as n_too_often from lesmis_edges")
def sample_rows(spark, sf):
    """Rows drawn, and those that come out more often than they are in the table."""
    e = w.scan_edges(f"{sf}/lesmis_edges.parquet", src="src", dst="dst")
    count = lambda df, name: df.select(F.xxhash64("*").alias("row")).groupBy("row").agg(F.count("*").alias(name))
    both = count(e.sample(1000, seed=7).to_spark(), "drawn").join(count(e.to_spark(), "there"), "row", "left")
    return both.agg(F.sum("drawn").alias("n_rows"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("drawn") - F.coalesce("there", F.lit(0)))), F.lit(0)).alias("n_too_often"))


@query("select c.*, n_name, n_regionkey from (select c_custkey, c_name, c_nationkey as n_nationkey from customer) c join nation using (n_nationkey)")
def join_inner(spark, sf):
    left = w.NodeFrame(read(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_nationkey as n_nationkey"), id="c_custkey")
    return left.join(w.NodeFrame(read(spark, sf, "nation"), id="n_nationkey"), on="n_nationkey").to_spark()


@query("select e.edge_id, e.src as id, e.seen_at, n.first_at from karate_edges e left join (select id, min(arrived_at) as first_at from karate_nodes group by id) n on e.src = n.id")
def join_left(spark, sf):
    nodes = w.scan_nodes(f"{sf}/karate_nodes.parquet", id="id").group_by("id").agg(first_at=w.col("arrived_at").min())
    edges = w.EdgeFrame(read(spark, sf, "karate_edges").selectExpr("edge_id", "src as id", "dst", "seen_at"), src="id", dst="dst")
    return edges.join(nodes, on="id", how="left").select("edge_id", "id", "seen_at", "first_at").to_spark()


@query(
    """select l_orderkey, l_partkey, l_quantity, total from (select l_orderkey, l_partkey, l_quantity from lineitem) a
      join (select l_orderkey, l_partkey, sum(l_quantity) as total from lineitem group by all) b using (l_orderkey, l_partkey)"""
)
def join_multi(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    sums = w.EdgeFrame(d, src="l_orderkey", dst="l_partkey").group_by("l_orderkey", "l_partkey").agg(total=w.col("l_quantity").sum())
    return w.EdgeFrame(d, src="l_orderkey", dst="l_partkey").join(sums, on=["l_orderkey", "l_partkey"]).to_spark()
