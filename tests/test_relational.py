"""Frames, expressions, the order of steps, joins, groups, samples, and what is refused."""

import threading

import pyarrow as pa
import pytest

import weftline as w
from weftline import topology

NODES = [
    {"id": 0, "region": "us", "tier": "a", "capacity": 10},
    {"id": 1, "region": "us", "tier": "a", "capacity": 20},
    {"id": 2, "region": "us", "tier": "b", "capacity": 30},
    {"id": 3, "region": "eu", "tier": "c", "capacity": 40},
    {"id": 4, "region": "eu", "tier": "c", "capacity": 50},
]


@pytest.fixture
def nodes(spark):
    return w.NodeFrame(NODES, id="id")


@pytest.fixture
def edges(spark):
    return w.from_edgelist([(1, 0), (2, 0), (3, 0), (0, 1)])


def ids(frame):
    return [r["id"] for r in frame.to_dicts()]


def test_steps_run_in_canonical_order(nodes):
    assert ids(nodes.head(2).filter(w.col("capacity") > 30)) == [3, 4]
    assert ids(nodes.sort("capacity").sort("id", descending=True).head(4).head(2)) == [4, 3]
    renamed = nodes.rename({"capacity": "size"}).filter(w.col("capacity") > 40).select("size")
    assert renamed.to_dicts() == [{"size": 50}]
    assert renamed.columns == ["size"]
    assert nodes.schema() == {"id": "bigint", "region": "string", "tier": "string", "capacity": "bigint"}


def test_expressions(nodes):
    c = w.col("capacity")
    assert ids(nodes.filter(~(w.col("region") == "us"))) == [3, 4]
    assert ids(nodes.filter((c + 5 > 30) & (w.col("tier") != "c"))) == [2]
    assert ids(nodes.filter((c / 7 == 4) | (100 - c * 2 == 0))) == [2, 4]
    assert ids(nodes.filter(c / 7.0 > 6)) == [4]
    assert ids(nodes.filter(1 / (c - 9) > 0)) == [0]
    assert ids(nodes.filter(w.id() >= 3)) == [3, 4]
    negative = w.NodeFrame([{"id": 0, "x": -7}], id="id")
    assert ids(negative.filter(w.col("x") / 2 == -3)) == [0]
    assert repr((c + 1 > 3) & ~(w.id() == 2)) == "(((col('capacity') + 1) > 3) & ~(id() == 2))"
    with pytest.raises(w.ComputeError):
        nodes.filter(c / (w.id() - w.id()) == 1).to_dicts()
    with pytest.raises(TypeError):
        hash(c)
    with pytest.raises(TypeError):
        bool(c > 1)
    with pytest.raises(TypeError):
        w.lit(None)
    for bad in (c, c + 1, True):
        with pytest.raises(NotImplementedError):
            nodes.filter(bad).collect()
    with pytest.raises(w.ColumnNotFoundError):
        nodes.filter(w.col("nothing") > 1).collect()
    with pytest.raises(NotImplementedError):
        nodes.filter(w.src() == 1).collect()


def test_names_with_dots_and_case(spark):
    f = w.NodeFrame({"id": [1, 2], "a.b": [3, 4], "we`ird": [5, 6]}, id="id")
    assert f.filter(w.col("a.b") > 3).select("we`ird").to_dicts() == [{"we`ird": 6}]


def test_three_valued_logic(spark):
    f = w.NodeFrame({"id": [0, 1, 2], "x": [1, None, 3]}, id="id")
    assert ids(f.filter(w.col("x") != 1)) == [2]
    assert ids(f.filter((w.col("x") > 2) | (w.id() == 1))) == [1, 2]
    assert ids(f.sort("x")) == [0, 2, 1] and ids(f.sort("x", descending=True)) == [2, 0, 1]


def test_group_by(nodes):
    c = w.col("capacity")
    rows = nodes.group_by("region").agg(c.mean(), c.sum(), c.min().alias("low"), high=c.max(), n=c.count(), tiers=w.col("tier").n_unique()).sort("region").to_dicts()
    assert rows == [
        {"region": "eu", "capacity_mean": 45.0, "capacity_sum": 90, "low": 40, "high": 50, "n": 2, "tiers": 1},
        {"region": "us", "capacity_mean": 20.0, "capacity_sum": 60, "low": 10, "high": 30, "n": 3, "tiers": 2},
    ]
    both = nodes.group_by("region", w.col("tier")).agg(c.sum())
    assert sorted(tuple(r.values()) for r in both.to_dicts()) == [("eu", "c", 90), ("us", "a", 30), ("us", "b", 30)]
    assert nodes.filter(c > 15).group_by("region").agg(s=c.sum()).sort("s", descending=True).head(1).to_dicts() == [{"region": "eu", "s": 90}]
    with pytest.raises(ValueError):
        nodes.group_by("region").agg(c.sum(), c.sum()).collect()
    with pytest.raises(ValueError):
        nodes.group_by("region").agg(region=c.sum()).collect()
    with pytest.raises(ValueError):
        nodes.group_by().agg(c.sum()).collect()
    with pytest.raises(ValueError):
        nodes.group_by("region").agg().collect()
    with pytest.raises(w.ColumnNotFoundError):
        nodes.group_by("nothing").agg(c.sum()).collect()
    with pytest.raises(NotImplementedError):
        nodes.group_by("region").agg(c).collect()
    grouped = nodes.group_by("region").agg(c.sum())
    for bad in (
        grouped.filter(w.col("capacity_sum") > 1),
        grouped.group_by("region").agg(c.sum()),
        grouped.distinct(),
        grouped.select("region"),
        nodes.sort("id").group_by("region").agg(c.sum()),
        nodes.head(1).group_by("region").agg(c.sum()),
    ):
        with pytest.raises(NotImplementedError):
            bad.collect()


def test_group_by_nulls(spark):
    f = w.NodeFrame({"id": [0, 1, 2, 3], "k": ["a", None, None, "a"], "x": [1, 2, None, None]}, id="id")
    rows = f.group_by("k").agg(n=w.col("x").count(), u=w.col("x").n_unique(), s=w.col("x").sum()).sort("k").to_dicts()
    assert rows == [{"k": "a", "n": 1, "u": 1, "s": 1}, {"k": None, "n": 1, "u": 1, "s": 2}]


def test_joins(spark):
    left = w.NodeFrame({"id": [0, 1, 2], "a": [10, 11, 12]}, id="id")
    right = w.NodeFrame({"id": [1, 2, 3], "b": [21, 22, 23]}, id="id")
    assert sorted(tuple(r.values()) for r in left.join(right, on="id").to_dicts()) == [(1, 11, 21), (2, 12, 22)]
    rows = left.join(right, on=w.col("id"), how="left").sort("id").to_dicts()
    assert rows[0] == {"id": 0, "a": 10, "b": None} and len(rows) == 3
    swapped = w.NodeFrame({"a": [10], "id": [5]}, id="id").join(w.NodeFrame({"b": [1], "id": [5]}, id="id"), on="id")
    assert swapped.columns == ["a", "id", "b"]
    two = w.NodeFrame({"id": [0, 0, 1], "k": ["x", "y", "x"], "v": [1, 2, 3]}, id="id")
    other = w.NodeFrame({"id": [0, 1], "k": ["x", "x"], "u": [9, 8]}, id="id")
    assert len(two.join(other, on=["id", "k"]).collect()) == 2
    assert len(left.join(left.rename({"a": "c"}), on="id").collect()) == 3
    for bad, error in (
        (left.join(right), NotImplementedError),
        (left.join(right, on="id", how="outer"), NotImplementedError),
        (left.join(right, on="a"), w.ColumnNotFoundError),
        (left.join(left, on="id"), ValueError),
        (left.join([1], on="id"), TypeError),
        (left.join(right, on="id").join(right, on="id"), NotImplementedError),
        (left.join(right, on="id").group_by("a").agg(w.col("b").sum()), NotImplementedError),
    ):
        with pytest.raises(error):
            bad.collect()


def test_null_keys_join_nothing(spark):
    left = w.NodeFrame({"id": [1, None], "a": [1, 2]}, id="id")
    assert len(left.join(w.NodeFrame({"id": [1, None], "b": [3, 4]}, id="id"), on="id").collect()) == 1


def test_sample_and_distinct(nodes):
    drawn = ids(nodes.sample(3, seed=1))
    assert len(drawn) == 3 == len(set(drawn)) and drawn == ids(nodes.sample(3, seed=1))
    assert len(ids(nodes.sample(99))) == 5 and ids(nodes.sample(0)) == []
    assert any(ids(nodes.sample(3, seed=k)) != drawn for k in range(2, 8))
    copies = w.NodeFrame({"id": [0, 0, 1], "r": ["us", "us", "eu"]}, id="id")
    assert len(copies.distinct().collect()) == 2 and len(copies.sample(2, seed=5).collect()) == 2
    with pytest.raises(ValueError):
        nodes.sample(-1).collect()
    with pytest.raises(ValueError):
        nodes.head(-1).collect()


def test_refusals(nodes, edges):
    pr = w.pagerank(edges)
    for bad in (
        nodes.select("id").select("id"),
        nodes.select("id").with_columns(p=pr),
        nodes.with_columns(p=pr).with_columns(q=pr),
        nodes.with_columns(p=w.col("capacity")),
        nodes.with_columns(p=pr, q=w.degree(w.from_edgelist([(0, 1)]))),
        nodes.sort(["id"]),
        edges.with_columns(p=pr),
        pr.with_columns(q=pr),
        w.random_walk(edges, [0], 2).group_by("node").agg(w.col("step").max()),
        nodes.select(w.col("capacity") + 1),
    ):
        with pytest.raises(NotImplementedError):
            bad.collect()
    with pytest.raises(ValueError):
        nodes.with_columns(id=pr).collect()
    with pytest.raises(ValueError):
        nodes.with_columns(capacity=pr).collect()
    for bad in (nodes.select("nothing"), nodes.sort("nothing"), nodes.rename({"nothing": "x"})):
        with pytest.raises(w.ColumnNotFoundError):
            bad.collect()
    with pytest.raises(ValueError):
        nodes.rename({"id": "region"}).collect()
    with pytest.raises(NotImplementedError):
        w.shortest_path(edges, 0, 1).reverse()
    with pytest.raises(NotImplementedError):
        w.pagerank(w.shortest_path(edges, 0, 1)).collect()
    with pytest.raises(NotImplementedError):
        w.connected_components(edges, mode="other").collect()
    with pytest.raises(ValueError):
        w.degree(edges, "sideways").collect()


def test_attributes_attach(nodes, edges):
    f = nodes.with_columns(indeg=w.degree(edges, "in"), outdeg=w.degree(edges))
    assert ids(f.filter(w.col("capacity") > 15).sort("indeg", descending=True)) [0] == 1
    assert ids(f.filter(w.col("indeg") > w.col("outdeg"))) == [0]
    rows = {r["id"]: r["indeg"] for r in f.to_dicts()}
    assert rows == {0: 3, 1: 1, 2: 0, 3: 0, 4: None}
    assert f.columns == ["id", "region", "tier", "capacity", "indeg", "outdeg"]
    clash = w.NodeFrame({"id": [0], "value": [1], "__node": [2], "__value0": [3]}, id="id")
    assert clash.with_columns(d=w.degree(edges, "in")).to_dicts() == [{"id": 0, "value": 1, "__node": 2, "__value0": 3, "d": 3}]
    names = w.NodeFrame({"id": ["0", "1"]}, id="id")
    assert [r["d"] for r in names.with_columns(d=w.degree(edges)).to_dicts()] == [None, None]


def test_standalone_expressions(edges):
    assert w.degree(edges, "in").sort("degree", descending=True).head(1).to_dicts() == [{"id": 0, "degree": 3}]
    assert w.degree(edges).filter(w.col("degree") > 0).select("id").distinct().to_arrow().num_rows == 4
    assert sorted(ids(edges.nodes())) == [0, 1, 2, 3]


def test_topology_is_shared(spark):
    edges = w.from_edgelist([(0, 1), (1, 2)])
    before = topology.builds()
    renamed = edges.rename({"src": "a"})
    threads = [threading.Thread(target=lambda f=f: w.degree(f).collect()) for f in (edges, renamed, edges, renamed)]
    [t.start() for t in threads], [t.join() for t in threads]
    w.pagerank(edges).collect()
    assert topology.builds() == before + 1
    filtered = edges.filter(w.src() > 0)
    assert sorted(ids(w.degree(filtered))) == [1, 2]
    assert topology.builds() == before + 2
    edges.release()
    w.degree(edges).collect()
    assert topology.builds() == before + 3
    assert "preserved" in renamed.explain() and "dropped" in filtered.explain()
    assert filtered.explain().splitlines()[1] == "  0: filter(predicate=(src() > 0))"
    assert "Physical Plan" in filtered.explain(physical=True)


def test_graphs_of_fewer_rows_are_their_own(spark):
    edges = w.from_edgelist([(0, 1), (1, 2), (2, 3)])
    first = edges.sort("src").head(1)
    assert sorted(ids(w.degree(first))) == [0, 1] and sorted(ids(w.degree(edges))) == [0, 1, 2, 3]
    assert sorted(ids(w.degree(edges.sort("src", descending=True).head(1)))) == [2, 3]
    assert first.to_spark() is first.to_spark() and first.head(1).to_spark() is not first.to_spark()


def test_roles(spark):
    e = w.EdgeFrame([{"u": 1, "v": 2, "x": 5}], src="u", dst="v")
    assert (e.src_col, e.dst_col, e.nodes().id_col) == ("u", "v", "id")
    assert e.filter(w.src() == 1).to_dicts() == [{"u": 1, "v": 2, "x": 5}]
    assert {r["id"]: r["degree"] for r in w.degree(e.reverse()).to_dicts()} == {1: 0, 2: 1}


def test_null_endpoints(spark):
    rows = {"src": [0, 1, None, 2], "dst": [1, 3, 0, None], "weight": [1.0, 1.0, 99.0, 99.0]}
    plain = w.EdgeFrame(rows, src="src", dst="dst")
    assert len(plain.collect()) == 4
    with pytest.raises(ValueError, match="null"):
        w.degree(plain).collect()
    with pytest.warns(UserWarning, match="dropped 2"):
        dropped = w.EdgeFrame(rows, src="src", dst="dst", on_null="drop")
    assert len(dropped.collect()) == 2 and len(w.pagerank(dropped, weight=w.col("weight")).collect()) == 3
    with pytest.raises(ValueError):
        w.EdgeFrame(rows, src="src", dst="dst", on_null="other")


def test_materialized(nodes, tmp_path):
    m = nodes.collect()
    assert len(m) == 5 and m.columns == ["id", "region", "tier", "capacity"] and isinstance(m.to_arrow(), pa.Table)
    assert m.to_pandas().shape == (5, 4)
    m.sink_parquet(str(tmp_path / "a.parquet"), compression="zstd")
    m.sink_csv(str(tmp_path / "a.csv"))
    m.sink_parquet(str(tmp_path / "one.parquet"), one_file=True, compression="zstd")
    m.sink_csv(str(tmp_path / "one.csv"), one_file=True)
    for name in ("a.parquet", "a.csv", "one.parquet", "one.csv"):
        assert len(w.read_nodes(str(tmp_path / name), id="id")) == 5
    assert (tmp_path / "a.parquet").is_dir() and (tmp_path / "one.parquet").is_file()
    with pytest.raises(NotImplementedError):
        m.sink_csv("s3://bucket/one.csv", one_file=True)
    with pytest.raises(TypeError):
        m.sink_csv(str(tmp_path / "b.csv"), sep=";")


def test_a_graph_expression_takes_the_verbs_of_its_frame(spark):
    e = w.from_edgelist([(0, 1), (1, 2), (2, 0), (0, 2)])
    d = w.degree(e)
    assert [r["degree"] for r in d.sort("degree", descending=True).head(1).to_dicts()] == [2]
    assert d.rename({"degree": "k"}).to_spark().columns == ["id", "k"] and len(d.sample(2, seed=1).collect()) == 2
    assert sorted(r["n"] for r in d.group_by("degree").agg(n=w.col("id").count()).to_dicts()) == [1, 2]
    assert d.to_pandas().shape == (3, 2) and "NodeFrame" in d.explain() and d.schema() == {"id": "bigint", "degree": "bigint"}
