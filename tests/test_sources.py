"""Constructors, files, object stores, HTTP, known datasets."""

import functools
import http.server
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import weftline as w
from weftline.sources import datasets

TABLE = pa.table({"src": pa.array([0, 0, 1, 2], pa.int64()), "dst": pa.array([1, 2, 2, 0], pa.int64()), "weight": [1.0, 2.0, 3.0, 4.0]})


def ranks(e):
    return {r["id"]: round(r["pagerank"], 9) for r in w.pagerank(e).to_dicts()}


class Graph:
    """The part of networkx's interface that is used."""

    def __init__(self, edges, nodes=()):
        self._edges, self._nodes = edges, nodes

    def edges(self, data=True):
        return self._edges

    def nodes(self, data=True):
        return self._nodes


class Matrix:
    def __init__(self, row, col, data):
        self.row, self.col, self.data = map(np.array, (row, col, data))

    def tocoo(self):
        return self


def test_all_constructors_agree(spark, tmp_path):
    pq.write_table(TABLE, tmp_path / "e.parquet")
    TABLE.to_pandas().to_csv(tmp_path / "e.csv", index=False)
    rows = TABLE.to_pylist()
    triples = [tuple(r.values()) for r in rows]
    made = [
        w.EdgeFrame(rows, src="src", dst="dst"),
        w.EdgeFrame(TABLE.to_pydict(), src="src", dst="dst"),
        w.EdgeFrame(TABLE.to_batches()[0], src="src", dst="dst"),
        w.from_arrow(TABLE, src="src", dst="dst"),
        w.from_arrow(TABLE.set_column(0, "src", TABLE["src"].cast(pa.uint32())).set_column(1, "dst", TABLE["dst"].cast(pa.int16())), src="src", dst="dst"),
        w.from_pandas(TABLE.to_pandas(), src="src", dst="dst"),
        w.from_spark(spark.createDataFrame(TABLE), src="src", dst="dst"),
        w.from_edgelist(triples),
        w.from_networkx(Graph([(a, b, {"weight": x}) for a, b, x in triples])),
        w.from_numpy(np.array(triples), kind="edges"),
        w.from_numpy(np.array([[0, 1, 2], [0, 0, 3], [4, 0, 0]]), weighted=True),
        w.from_scipy_sparse(Matrix(*zip(*triples)), weighted=True),
        w.scan_edges(str(tmp_path / "e.parquet"), src="src", dst="dst"),
        w.scan_edges(str(tmp_path / "e.csv"), src="src", dst="dst"),
        w.scan_edges(f"file://{tmp_path}/e.parquet", src="src", dst="dst"),
        w.scan_edges(f"{tmp_path}/*.parquet", src="src", dst="dst"),
    ]
    want = ranks(made[0])
    for e in made:
        assert ranks(e) == want
        assert sorted(e.columns) == ["dst", "src", "weight"]


def test_bad_input(spark):
    for bad in ([(0, 1)], 5, "text"):
        with pytest.raises(TypeError):
            w.EdgeFrame(bad, src="src", dst="dst")
    with pytest.raises(w.ColumnNotFoundError):
        w.EdgeFrame(TABLE, src="src", dst="to")
    with pytest.raises(w.ColumnNotFoundError):
        w.NodeFrame(TABLE, id="id")
    with pytest.raises(ValueError):
        w.from_pandas(TABLE.to_pandas())
    with pytest.raises(TypeError):
        w.EdgeFrame({"src": [0.5], "dst": [1.5]}, src="src", dst="dst")
    with pytest.raises(TypeError):
        w.degree(w.EdgeFrame({"src": [1], "dst": ["a"]}, src="src", dst="dst")).collect()
    for bad, error in (([], ValueError), ([(1, 2), (1, 2, 3)], ValueError), ([(1,)], ValueError), ([5], TypeError)):
        with pytest.raises(error):
            w.from_edgelist(bad)
    with pytest.raises(ValueError):
        w.from_edgelist([(1, 2)], weighted=True)
    for bad in (np.zeros(3), np.zeros((2, 4))):
        with pytest.raises(ValueError):
            w.from_numpy(bad)
    with pytest.raises(ValueError):
        w.from_numpy(np.zeros((3, 2)), kind="adjacency")
    with pytest.raises(ValueError):
        w.from_numpy(np.zeros((3, 2), int), weighted=True)
    with pytest.raises(ValueError):
        w.from_numpy(np.zeros((3, 3)), kind="other")
    with pytest.raises(TypeError):
        w.from_scipy_sparse(np.zeros((2, 2)))


def test_numpy_ambiguous(spark):
    square = np.array([[0, 1], [1, 0]])
    assert len(w.from_numpy(square).collect()) == 2
    assert w.from_numpy(square, kind="edges").to_dicts() == [{"src": 0, "dst": 1}, {"src": 1, "dst": 0}]


def test_networkx_attributes(spark):
    g = Graph([("a", "b", {"weight": 1}), ("b", "c", {})], [("a", {"x": 1}), ("b", {"y": "q"}), ("c", {})])
    assert w.from_networkx(g).columns == ["src", "dst"]
    assert w.nodes_from_networkx(g).to_dicts() == [{"id": "a", "x": 1, "y": None}, {"id": "b", "x": None, "y": "q"}, {"id": "c", "x": None, "y": None}]
    with pytest.raises(ValueError):
        w.nodes_from_networkx(g, id="x")
    assert w.degree(w.from_networkx(Graph([]))).to_dicts() == []


def test_pandas_index_is_no_column(spark):
    assert w.NodeFrame(pd.DataFrame({"id": [1]}, index=[9]), id="id").columns == ["id"]


def test_scans(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    pq.write_table(TABLE, path)
    scan = w.scan_edges(path, src="src", dst="dst")
    assert scan.filter(w.col("weight") > 2).select("dst").to_dicts() == [{"dst": 2}, {"dst": 0}]
    plan = scan.filter(w.col("weight") > 2).select("dst").explain(physical=True)
    assert "PushedFilters: [IsNotNull(weight), GreaterThan(weight,2.0)]" in plan and "ReadSchema: struct<dst:bigint,weight:double>" in plan
    assert len(w.read_edges(path, src="src", dst="dst")) == 4
    assert len(w.scan_edges([path, path], src="src", dst="dst").collect()) == 8
    with pytest.raises(w.ColumnNotFoundError):
        w.scan_edges(path, src="nothing", dst="dst").collect()
    with pytest.raises(NotImplementedError):
        w.scan_edges(path, src="src", dst="dst", sep=";")
    for bad in ("e.json", "ftp://host/e.csv", "http://host/e.csv?token=1", "http://host/*.csv"):
        with pytest.raises(NotImplementedError):
            w.scan_edges(bad, src="src", dst="dst")
    with pytest.raises(NotImplementedError):
        w.scan_nodes(path, id="src", store=object())
    with pytest.raises(w.ComputeError, match="unknown storage option"):
        w.scan_nodes("s3://bucket/n.parquet", id="src", storage_options={"nonsense": "1"})
    pq.write_table(TABLE.slice(0, 0), tmp_path / "none.parquet")
    with pytest.raises(w.ComputeError, match="no rows"):
        w.scan_nodes(str(tmp_path / "none.parquet"), id="src").collect()


def test_scan_nulls(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    pq.write_table(pa.table({"src": [0, None, 1], "dst": [1, 1, None]}), path)
    with pytest.raises(ValueError):
        w.degree(w.scan_edges(path, src="src", dst="dst")).collect()
    with pytest.warns(UserWarning, match="dropped 2"):
        assert len(w.degree(w.scan_edges(path, src="src", dst="dst", on_null="drop")).collect()) == 2


def test_http(spark, tmp_path):
    pq.write_table(TABLE, tmp_path / "e.parquet")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        assert len(w.scan_edges(f"{base}/e.parquet", src="src", dst="dst").collect()) == 4
        with pytest.raises(w.ComputeError):
            w.scan_edges(f"{base}/other.parquet", src="src", dst="dst").collect()
    finally:
        server.shutdown()


def test_datasets(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("WEFTLINE_DATA_HOME", str(tmp_path))
    for info in w.datasets.list_datasets():
        if info.bundled:
            d = w.describe(w.datasets.load(info.name)).to_dicts()[0]
            assert (d["n_nodes"], d["n_edges"]) == (info.nodes, info.edges)
    kite = w.datasets.load("kite")
    both = w.from_spark(kite.to_spark().union(kite.to_spark().select("dst", "src")), src="src", dst="dst")
    top = lambda e, name: e.sort(name, descending=True).head(1).to_dicts()[0]["id"]
    assert top(w.degree(both), "degree") == 3 and top(w.betweenness(both), "betweenness") == 7 and top(w.closeness(both), "closeness") in (5, 6)
    with pytest.raises(KeyError):
        w.datasets.load("nothing")
    with pytest.raises(RuntimeError):
        w.datasets.load("lesmis")
    (tmp_path / "lesmis_edges.csv").write_text("src,dst,weight\nA,B,3\n")
    assert w.datasets.load("lesmis").to_dicts() == [{"src": "A", "dst": "B", "weight": 3}]
    with pytest.raises(ValueError):
        datasets.fetch("file:///etc/hosts", "x")
    with pytest.raises(RuntimeError):
        datasets.fetch("http://127.0.0.1:9/none", "x")
