"""Queries of graph algorithms, traversals and statistics, over whole graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import weftline as w
from weftline.catalog import graphs as G
from weftline.catalog.registry import query, read
from weftline.columns import stored


def _nodes(e: str = "e") -> str:
    return f"(select src as id from {e} union select dst from {e})"


def _degree_sql(graph: str, out: int, into: int, name: str) -> str:
    return f"""with e as ({G.EDGES[graph]}) select id, sum(n)::bigint as {name} from (
      select src as id, {out} as n from e union all select dst, {into} from e) group by id"""


@query(_degree_sql("supply", 1, 0, "degree"))
def degree_out(spark, sf):
    return w.degree(G.supply(spark, sf), "out").to_spark()


@query(_degree_sql("supply", 0, 1, "degree"))
def degree_in(spark, sf):
    return w.degree(G.supply(spark, sf), "in").to_spark()


@query(_degree_sql("lesmis", 1, 1, "degree"))
def degree_both(spark, sf):
    return w.degree(G.lesmis(spark, sf), "both").to_spark()


# ---- PageRank: a fixed number of rounds, so that SQL can follow


def _rank_sql(graph: str, rounds: int, weight: str, last: str) -> str:
    return f"""with recursive e as ({G.EDGES[graph]}), n as {_nodes()}, size as (select count(*)::double as n from n),
    m as (select src, dst, sum({weight})::double as w from e group by all),
    s as (select src, sum(w) as s from m group by all having sum(w) > 0),
    share as (select src, dst, w / s as share from m join s using (src)),
    pr(it, id, r) as (
      select 0, id, 1.0::double / (select n from size) from n
      union all
      select it + 1, id, 0.15::double / any_value(size.n) + 0.85::double * any_value(loose) / any_value(size.n) + 0.85::double * sum(c) from (
          select it, share.dst as id, r * share as c from pr join share on pr.id = share.src
          union all select it, id, 0.0::double from pr) x,
        (select coalesce(sum(r), 0.0)::double as loose from pr where id not in (select src from s)) y, size
      where it < {rounds} group by it, id),
    rank as (select id, r from pr where it = {rounds})
    {last}"""


@query(_rank_sql("karate", 20, "1.0", "select id, round(r, 9) as pagerank from rank"))
def pagerank(spark, sf):
    return w.pagerank(G.karate(spark, sf), max_iter=20, tol=0.0).to_spark().withColumn("pagerank", F.round("pagerank", 9))


@query(_rank_sql("trade", 10, "weight", "select id, round(r, 9) as pagerank from rank"))
def pagerank_w(spark, sf):
    value = w.col("l_extendedprice") * (1 - w.col("l_discount"))
    return w.pagerank(G.trade(spark, sf), max_iter=10, tol=0.0, weight=value).to_spark().withColumn("pagerank", F.round("pagerank", 9))


@query(
    _rank_sql(
        "lesmis", 30, "1.0",
        "select id, round(r, 9) as pr, indeg from rank join (select dst as id, count(*)::bigint as indeg from e group by dst) using (id) where indeg >= 3 order by r desc limit 20",
    )
)
def influencers(spark, sf):
    """Twenty nodes of highest PageRank among those with three or more incoming edges."""
    e = G.lesmis(spark, sf)
    top = e.nodes().with_columns(pr=w.pagerank(e, max_iter=30, tol=0.0), indeg=w.degree(e, "in"))
    return top.filter(w.col("indeg") >= 3).sort("pr", descending=True).head(20).to_spark().withColumn("pr", F.round("pr", 9))


@query(
    f"""with e as ({G.EDGES["supply"]}), d as (select src as id, count(*)::bigint as n_lines from e group by src)
    select s_suppkey, s_name, n_lines from supplier left join d on s_suppkey = id where s_acctbal > 0"""
)
def attr_enrich(spark, sf):
    e = G.supply(spark, sf)
    f = w.scan_nodes(f"{sf}/supplier.parquet", id="s_suppkey").with_columns(n_lines=w.degree(e))
    return f.filter(w.col("s_acctbal") > 0).select("s_suppkey", "s_name", "n_lines").to_spark()


@query(
    f"""with e as ({G.EDGES["trade"]}), d as (select src as id, count(*)::bigint as n from e group by src)
    select c_mktsegment, sum(n)::bigint as lines, max(n)::bigint as busiest from customer left join d on c_custkey = id group by all"""
)
def group_by_computed(spark, sf):
    e = G.trade(spark, sf)
    f = w.scan_nodes(f"{sf}/customer.parquet", id="c_custkey").with_columns(n=w.degree(e))
    return f.group_by("c_mktsegment").agg(lines=w.col("n").sum(), busiest=w.col("n").max()).to_spark()


@query(_rank_sql("karate_w", 15, "weight * 2 + 1", "select id, round(r, 9) as pagerank from rank"))
def weight_expr(spark, sf):
    return w.pagerank(G.karate_w(spark, sf), max_iter=15, tol=0.0, weight=w.col("weight") * 2 + 1).to_spark().withColumn("pagerank", F.round("pagerank", 9))


# ---- components


def _weak_sql(graph: str) -> str:
    return f"""with recursive e as ({G.EDGES[graph]}), u as (select src, dst from e union select dst, src from e), n as {_nodes()},
    c(id, label) using key (id) as (
      select id, id from n
      union select u.dst, min(c.label) from c join u on c.id = u.src join recurring.c as now on now.id = u.dst where c.label < now.label group by u.dst)"""


@query(f"{_weak_sql('karate')} select id, label as connected_components from c")
def cc_weak(spark, sf):
    return w.connected_components(G.karate(spark, sf)).to_spark()


@query(f"{_weak_sql('tree')} select count(*)::bigint as n_nodes, count(distinct label)::bigint as n_components from c")
def cc_weak_names(spark, sf):
    found = w.connected_components(G.tree(spark, sf)).to_spark()
    return found.agg(F.count("*").alias("n_nodes"), F.count_distinct("connected_components").alias("n_components"))


@query(
    f"""with recursive e as ({G.EDGES["karate"]}), m as (select distinct src, dst from e where src <> dst), n as {_nodes()},
    r(s, v) as (select id, id from n union select s, dst from r join m on r.v = m.src)
    select a.s as id, min(a.v) as connected_components from r a join r b on a.s = b.v and a.v = b.s group by a.s"""
)
def cc_strong(spark, sf):
    return w.connected_components(G.karate(spark, sf), mode="strong").to_spark()


# ---- triangles


_TRIANGLES = f"""with e as ({G.EDGES["copurchase"]}), u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst), n as {_nodes()},
    t as (select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b),
    k as (select id, count(*) as k from (select a as id from u union all select b from u) group by id),
    c as (select id, count(*) as t from (select a as id from t union all select b from t union all select c from t) group by id)"""


@query(f"{_TRIANGLES} select id, coalesce(t, 0)::bigint as triangle_count from n left join c using (id)")
def triangles(spark, sf):
    return w.triangle_count(G.copurchase(spark, sf)).to_spark()


@query(
    f"""{_TRIANGLES} select id, round(case when coalesce(k, 0) < 2 then 0.0 else 2.0 * coalesce(t, 0) / (k * (k - 1.0)) end, 9) as clustering_coefficient
    from n left join k using (id) left join c using (id)"""
)
def clustering(spark, sf):
    return w.clustering_coefficient(G.copurchase(spark, sf)).to_spark().withColumn("clustering_coefficient", F.round("clustering_coefficient", 9))


# ---- distances


def _distances_sql(graph: str) -> str:
    return f"""with recursive e as ({G.EDGES[graph]}), m as (select src, dst, count(*)::double as m from e group by all), n as {_nodes()},
    d(s, v, d) using key (s, v) as (
      select id, id, 0 from n
      union select d.s, m.dst, min(d.d) + 1 from d join m on d.v = m.src left join recurring.d as o on o.s = d.s and o.v = m.dst where o.d is null group by d.s, m.dst)"""


@query(f"{_distances_sql('karate')} select s as id, round(coalesce(count(*) filter (d > 0) / nullif(sum(d), 0), 0.0), 9) as closeness from d group by s")
def closeness(spark, sf):
    return w.closeness(G.karate(spark, sf)).to_spark().withColumn("closeness", F.round("closeness", 9))


def _costs_sql(graph: str) -> str:
    return f"""with recursive e as ({G.EDGES[graph]}), m as (select src, dst, min(weight) as w from e group by all), n as {_nodes()},
    d(s, v, d) using key (s, v) as (
      select id, id, 0.0::double from n
      union select d.s, m.dst, min(d.d + m.w) from d join m on d.v = m.src left join recurring.d as o on o.s = d.s and o.v = m.dst
        where o.d is null or d.d + m.w < o.d group by d.s, m.dst)"""


@query(f"{_costs_sql('karate_w')} select s as id, round(coalesce(count(*) filter (s <> v) / nullif(sum(d), 0), 0.0), 9) as closeness from d group by s")
def closeness_w(spark, sf):
    return w.closeness(G.karate_w(spark, sf), weight=w.col("weight")).to_spark().withColumn("closeness", F.round("closeness", 9))


def _betweenness_sql(distances: str, weight: str, kind: str = "double") -> str:
    """Over the edges on shortest paths, path counts outward and ``(1 + dependency) / paths`` back, by number of edges."""
    return f"""{distances},
    x as (select src, dst, {weight}::{kind} as w, count(*)::double as m from e where src <> dst group by all),
    tight as materialized (select a.s, x.src, x.dst, sum(x.m) as m from x join d a on a.v = x.src join d b on b.s = a.s and b.v = x.dst where a.d + x.w = b.d group by all),
    out(k, s, v, x) as (
      select 0, id, id, 1.0::double from n
      union all select k + 1, out.s, tight.dst, sum(out.x * tight.m) from out join tight on tight.s = out.s and tight.src = out.v group by k, out.s, tight.dst),
    sigma as materialized (select s, v, sum(x) as sigma from out group by all),
    back(k, s, v, x) as (
      select 0, s, v, 1 / sigma from sigma
      union all select k + 1, back.s, tight.src, sum(back.x * tight.m) from back join tight on tight.s = back.s and tight.dst = back.v group by k, back.s, tight.src),
    g as (select s, v, sum(x) as g from back group by all),
    b as (select v as id, sum(g * sigma - 1) as b from g join sigma using (s, v) where s <> v group by v)
    select id, round(coalesce(b, 0.0), 4) + 0.0 as betweenness from n left join b using (id)"""


@query(_betweenness_sql(_distances_sql("tree"), "1", "int"))
def betweenness(spark, sf):
    return w.betweenness(G.tree(spark, sf)).to_spark().withColumn("betweenness", F.round("betweenness", 4))


@query(_betweenness_sql(_distances_sql("karate"), "1", "int"))
def betweenness_karate(spark, sf):
    return w.betweenness(G.karate(spark, sf)).to_spark().withColumn("betweenness", F.round("betweenness", 4))


@query()
def betweenness_sampled(spark, sf):
    return w.betweenness(G.karate(spark, sf), sample=0.1, seed=5).to_spark().withColumn("betweenness", F.round("betweenness", 6))


@query(_betweenness_sql(_costs_sql("karate_w"), "weight"))
def betweenness_w(spark, sf):
    return w.betweenness(G.karate_w(spark, sf), weight=w.col("weight")).to_spark().withColumn("betweenness", F.round("betweenness", 4))


@query(f"{_distances_sql('karate')} select round(sum(d) / count(*), 9) as avg_path_length from d where d > 0")
def avg_path_length(spark, sf):
    return spark.createDataFrame([(round(w.avg_path_length(G.karate(spark, sf)), 9),)], "avg_path_length double")


@query(f"{_distances_sql('karate')} select max(d)::bigint as diameter from d")
def diameter(spark, sf):
    return spark.createDataFrame([(w.diameter(G.karate(spark, sf), approximate=False),)], "diameter long")


@query(
    f"""with recursive e as ({G.EDGES["lesmis"]}), m as (select distinct src, dst from e), n as {_nodes()},
    placed as (select id, row_number() over (order by id) - 1 as place from n), size as (select count(*) as n, least(128, count(*)) as k from n),
    chosen as (select id from placed where place in (select least(floor(i * greatest(1.0, n / k)), n - 1)::bigint from size, range(128) r(i) where i < k)),
    d(s, v, d) using key (s, v) as (
      select id, id, 0 from chosen
      union select d.s, m.dst, min(d.d) + 1 from d join m on d.v = m.src left join recurring.d as o on o.s = d.s and o.v = m.dst where o.d is null group by d.s, m.dst)
    select max(d)::bigint as diameter from d"""
)
def diameter_approx(spark, sf):
    """A lower bound from 128 sources at even strides of the identifiers in order."""
    return spark.createDataFrame([(w.diameter(G.lesmis(spark, sf)),)], "diameter long")


# ---- communities: labels are arbitrary, so each is named by its least member


def _by_least_member(labels: DataFrame, name: str) -> DataFrame:
    least = labels.groupBy(name).agg(F.min("id").alias("least"))
    return labels.join(least, name).select("id", "least")


_BY_NATION = """with c as (select concat('c', c_custkey) as id, c_nationkey as k from customer union select concat('n', c_nationkey), c_nationkey from customer)
    select id, min(id) over (partition by k) as least from c"""


@query(_BY_NATION)
def lpa(spark, sf):
    return _by_least_member(w.label_propagation(G.stars(spark, sf), max_iter=50, seed=3).to_spark(), "label_propagation")


@query(_BY_NATION)
def louvain(spark, sf):
    return _by_least_member(w.louvain(G.stars(spark, sf), seed=1).to_spark(), "louvain")


@query(_BY_NATION)
def louvain_w(spark, sf):
    """Without the weights nations would not be told from the next ones."""
    return _by_least_member(w.louvain(G.ring(spark, sf), weight=w.col("weight"), seed=1).to_spark(), "louvain")


@query()
def louvain_modularity(spark, sf):
    """``(n_nodes, n_communities, modularity)`` on a graph without planted communities, by weight; its bound is in the tests."""
    graph = G.lesmis(spark, sf)
    labels = stored(w.louvain(graph, weight=w.col("weight"), seed=1).to_spark())  # found once, used three times
    e = graph.topology().weighted(w.col("weight")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    a, b = (labels.select(F.col("id").alias(end), F.col("louvain").alias(f"c_{end}")) for end in ("src", "dst"))
    inside = e.join(a, "src").join(b, "dst").groupBy().agg(F.sum("w").alias("m"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w"))).alias("inside"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("k"))
    ends = ends.join(labels, "id").groupBy("louvain").agg(F.sum("k").alias("k"), F.count("*").alias("n"))
    spread = ends.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_communities"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    value = F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))
    return inside.join(F.broadcast(spread)).select("n_nodes", "n_communities", F.round(value, 6).alias("modularity"))


# ---- neighbour aggregates


def _neighbours_sql(fn: str, empty: str) -> str:
    return f"""with e as ({G.EDGES["supply"]}), a as (select {G.OFFSET} + p_partkey as id, p_size as x, p_brand as b from part),
    f as (select src as id, ({fn})::double as v from e join a on e.dst = a.id group by src)
    select s_suppkey, round(coalesce(v, {empty}), 6) as v from supplier s left join (select src as id from e union select dst from e) n on s.s_suppkey = n.id left join f on f.id = n.id
    where n.id is not null union all select s_suppkey, null from supplier where s_suppkey not in (select src from e union select dst from e)"""


def _neighbours(spark, sf, agg) -> DataFrame:
    parts = read(spark, sf, "part").select((F.lit(G.OFFSET) + F.col("p_partkey")).alias("s_suppkey"), F.col("p_size").alias("x"), F.col("p_brand").alias("b"))
    both = read(spark, sf, "supplier").select("s_suppkey").unionByName(parts, allowMissingColumns=True)
    f = w.NodeFrame(both, id="s_suppkey").with_columns(v=w.neighbors(G.supply(spark, sf)).agg(agg)).filter(w.id() < G.OFFSET)
    return f.select("s_suppkey", "v").to_spark().withColumn("v", F.round("v", 6))


@query(_neighbours_sql("avg(x)", "null"))
def nbr_mean(spark, sf):
    return _neighbours(spark, sf, w.col("x").mean())


@query(_neighbours_sql("sum(x)", "0"))
def nbr_sum(spark, sf):
    return _neighbours(spark, sf, w.col("x").sum())


@query(_neighbours_sql("min(x)", "null"))
def nbr_min(spark, sf):
    return _neighbours(spark, sf, w.col("x").min())


@query(_neighbours_sql("max(x)", "null"))
def nbr_max(spark, sf):
    return _neighbours(spark, sf, w.col("x").max())


@query(_neighbours_sql("count(x)", "0"))
def nbr_count(spark, sf):
    return _neighbours(spark, sf, w.col("x").count())


@query(_neighbours_sql("count(distinct b)", "0"))
def nbr_n_unique(spark, sf):
    return _neighbours(spark, sf, w.col("b").n_unique())


# ---- traversals


def _hop_sql(n: int, seeds: str, graph: str = "tree") -> str:
    return f"""with recursive e as ({G.EDGES[graph]}), r(seed, node, d) as (
      select id, id, 0 from ({seeds}) union select seed, dst, d + 1 from r join e on r.node = e.src where d < {n}),
    h as (select distinct seed as src, node as dst from r where node <> seed)"""


_CUSTOMERS = "select concat('c', c_custkey) as id from customer"


def _customers(spark, sf) -> w.NodeFrame:
    return w.NodeFrame(read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_mktsegment"), id="id")


@query(f"{_hop_sql(1, _CUSTOMERS)} select src, dst from h")
def hop1(spark, sf):
    return w.hop(G.tree(spark, sf), 1).from_(_customers(spark, sf)).to_spark()


@query(f"{_hop_sql(2, _CUSTOMERS)} select src, dst from h")
def hop2(spark, sf):
    return w.hop(G.tree(spark, sf), 2).from_(_customers(spark, sf)).to_spark()


@query(f"{_hop_sql(3, 'select * from (values (1), (2), (34), (1000)) t(id)', 'karate')} select src, dst from h")
def hop3(spark, sf):
    return w.hop(G.karate(spark, sf), 3).from_([1, 2, 34, 1000]).to_spark()


@query(f"{_hop_sql(2, 'select distinct id from karate_nodes where id % 20 = 0', 'karate')} select src, dst from h")
def hop_busy(spark, sf):
    """Two hops from all nodes of the stated query set (identifiers divisible by 20), through busy nodes."""
    seeds = w.NodeFrame(read(spark, sf, "karate_nodes").where("id % 20 = 0").select("id").distinct(), id="id")
    return w.hop(G.karate(spark, sf), 2).from_(seeds).to_spark()


@query(f"{_hop_sql(2, _CUSTOMERS + chr(32) + 'where c_mktsegment = ' + chr(39) + 'BUILDING' + chr(39))} select src, dst from h")
def hop_nodeframe_seeds(spark, sf):
    return w.hop(G.tree(spark, sf), 2).from_(_customers(spark, sf).filter(w.col("c_mktsegment") == "BUILDING")).to_spark()


@query(f"{_hop_sql(2, _CUSTOMERS)} select distinct dst as place from h where dst > 'n'")
def hop_tail(spark, sf):
    h = w.hop(G.tree(spark, sf), 2).from_(_customers(spark, sf))
    return h.filter(w.dst() > "n").rename({"dst": "place"}).select("place").to_spark().distinct()


@query(
    f"""{_distances_sql("karate")} select 1::bigint as source, 34::bigint as target, count(*)::bigint as hops, coalesce(max(d), 0)::double as cost
    from (select d, unnest(range(d)) from d where s = 1 and v = 34)"""
)
def sp_cost(spark, sf):
    path = w.shortest_path(G.karate(spark, sf), 1, 34).to_spark()
    return path.agg(F.count("*").alias("hops"), F.coalesce(F.max("cost"), F.lit(0.0)).alias("cost")).select(F.lit(1).cast("long").alias("source"), F.lit(34).cast("long").alias("target"), "hops", "cost")


@query(
    """select concat('c', c_custkey) as src, concat('n', c_nationkey) as dst, 0::bigint as hop, 1.0::double as cost from customer where c_custkey = 7
    union all select concat('n', n_nationkey), concat('r', n_regionkey), 1, 2.0 from nation join customer on c_nationkey = n_nationkey where c_custkey = 7"""
)
def sp_path(spark, sf):
    region = read(spark, sf, "customer").where("c_custkey = 7").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return w.shortest_path(G.tree(spark, sf), "c7", f"r{region}").to_spark()


@query(f"{_costs_sql('karate_w')} select round(max(d), 6) as cost from d where s = 1 and v = 34")
def sp_weighted(spark, sf):
    return w.shortest_path(G.karate_w(spark, sf), 1, 34, weight=w.col("weight")).to_spark().agg(F.round(F.max("cost"), 6).alias("cost"))


@query(
    f"""with e as ({G.EDGES["karate"]}), known as (select distinct id from karate_nodes where id in {_nodes()})
    select (2 * count(*))::bigint as n_walks, 0::bigint as n_broken from known"""
)
def walks(spark, sf):
    """Two walks of ten steps from every node; a step that follows no edge would be broken."""
    e = G.karate(spark, sf)
    start = w.NodeFrame(read(spark, sf, "karate_nodes").select("id").distinct(), id="id")
    found = w.random_walk(e, start, 10, walks_per_node=2, seed=11).to_spark().persist()
    pairs = found.select("walk_id", "step", F.col("node").alias("src")).join(found.select("walk_id", (F.col("step") - 1).alias("step"), F.col("node").alias("dst")), ["walk_id", "step"])
    broken = pairs.join(e.to_spark().select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return spark.createDataFrame([(found.where("step = 0").count(), broken.count())], "n_walks long, n_broken long")


# ---- whole graphs


def _describe_sql(graph: str, components: str) -> str:
    return f"""{_weak_sql(graph)}, s as (select (select count(*) from n) as n, (select count(*) from e) as m)
    select n::bigint as n_nodes, m::bigint as n_edges, round(m / (n * (n - 1.0)), 9) as density, round(m / n, 9) as avg_degree, {components} as n_components from s"""


def _described(df: DataFrame) -> DataFrame:
    return df.withColumn("density", F.round("density", 9)).withColumn("avg_degree", F.round("avg_degree", 9))


@query(_describe_sql("flow", "null::bigint"))
def describe(spark, sf):
    return _described(w.describe(G.flow(spark, sf)).to_spark())


@query(_describe_sql("tree", "(select count(distinct label) from c)::bigint"))
def describe_full(spark, sf):
    return _described(w.describe(G.tree(spark, sf), full=True).to_spark())


@query(f"with e as ({G.EDGES['lesmis']}), s as (select (select count(*) from {_nodes()}) as n, (select count(*) from e) as m) select round(m / (n * (n - 1.0)), 12) as density from s")
def density(spark, sf):
    return spark.createDataFrame([(round(w.density(G.lesmis(spark, sf)), 12),)], "density double")
