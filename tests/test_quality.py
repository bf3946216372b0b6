"""Dangling references, unreadable rows and per-key totals against brute force, with odd input."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import dense_counts
from weftline.operators import orphans as module
from weftline.operators.dense_counts import busy_keys, dense_totals
from weftline.operators.orphans import key_filter, orphan_references, orphan_report
from weftline.operators.strict_load import rejected_records, strict_load

T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


# ---- references

NODES = pa.schema([("id", pa.int64()), ("begin", pa.timestamp("us")), ("end", pa.timestamp("us")), ("loaded", pa.timestamp("us")), ("t", pa.string()), ("key", pa.string())])
EDGES = pa.schema([("edge_id", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("seen", pa.timestamp("us")), ("day", pa.string()), ("cause", pa.string())])
HOW = {"record_id": "edge_id", "seen_at": "seen", "key": "id", "begins_at": "begin", "ends_at": "end", "version": "loaded"}


def frames(spark, nodes, edges):
    n = pa.Table.from_pylist([dict(zip(("id", "begin", "end", "loaded"), r)) for r in nodes], schema=NODES)
    e = pa.Table.from_pylist([dict(zip(("edge_id", "src", "dst", "seen"), r)) for r in edges], schema=EDGES)
    return spark.createDataFrame(n), spark.createDataFrame(e)


def orphans(spark, nodes, edges):
    n, e = frames(spark, nodes, edges)
    return sorted(orphan_references(e, ["src", "dst"], n, **HOW).collect(), key=str)


def brute_orphans(nodes, edges):
    lives = {}
    for k, b, e, v in nodes:
        if k is not None and b is not None and ((k, b) not in lives or v > lives[k, b][0]):
            lives[k, b] = (v, e)
    out = []
    for edge_id, src, dst, seen in set(edges):
        for end, k in (("src", src), ("dst", dst)):
            mine = [(b, e) for (j, b), (_, e) in lives.items() if j == k]
            if k is None or any(b <= seen and (e is None or seen < e) for b, e in mine):
                continue
            out.append((edge_id, end, seen, "missing" if not mine else "late" if all(b > seen for b, _ in mine) else "deleted"))
    return sorted(out, key=str)


@pytest.mark.parametrize("busy", [100_000, 20, 0])
def test_orphans_against_brute_force(spark, monkeypatch, busy):
    monkeypatch.setattr(module, "KEY_ROWS", busy)
    rng = random.Random(4)
    nodes = []
    for k in range(60):
        start = rng.randrange(0, 300)
        for _ in range(rng.choice([1, 1, 2, 4])):
            stop = start + rng.randrange(1, 200)
            for v in range(rng.choice([1, 1, 3])):
                nodes.append((k, at(start), rng.choice([None, at(stop), at(stop)]) if v else at(stop), at(1000 + v)))
            start = stop + rng.randrange(0, 50)
    edges = [(k, rng.choice([None, 7, rng.randrange(90)]), rng.choice([7, rng.randrange(90)]), at(rng.randrange(900))) for k in range(800)]
    edges += edges[:80]
    assert [tuple(r) for r in orphans(spark, nodes, edges)] == brute_orphans(nodes, edges)


@pytest.mark.parametrize("busy", [100_000, 0])
def test_orphans_at_the_edges_of_lives(spark, monkeypatch, busy):
    monkeypatch.setattr(module, "KEY_ROWS", busy)
    nodes = [(1, at(10), at(20), at(0)), (1, at(20), None, at(0)), (2, at(5), None, at(1)), (2, at(5), at(6), at(2)), (None, at(0), None, at(0)), (3, None, None, at(0)), (4, at(9), at(9), at(0))]
    edges = [(1, 1, 2, at(10)), (2, 1, 2, at(5)), (3, 1, 2, at(19)), (4, 1, 3, at(20)), (5, 4, 4, at(9)), (6, 1, None, None), (6, 1, None, None)]
    assert [(r["edge_id"], r["endpoint"], r["cause"]) for r in orphans(spark, nodes, edges)] == [
        (1, "dst", "deleted"), (2, "src", "late"), (3, "dst", "deleted"), (4, "dst", "missing"), (5, "dst", "deleted"), (5, "src", "deleted"), (6, "src", "late"),
    ]


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], []) == [] == orphans(spark, [(1, at(0), None, at(0))], [])
    assert [r["cause"] for r in orphans(spark, [], [(1, 5, 6, at(0))])] == ["missing", "missing"]


def test_orphans_report(spark):
    n, e = frames(spark, [(1, at(0), None, at(0))], [(1, 9, 1, at(0)), (2, 9, 8, at(1)), (3, 9, 8, None)])
    report = orphan_report(orphan_references(e, ["src", "dst"], n, **HOW), table="edges", seen_at="seen")
    assert sorted(map(tuple, report.collect()), key=str) == [
        ("edges", "dst", "2024-01", "missing", 1), ("edges", "dst", None, "missing", 1), ("edges", "src", "2024-01", "missing", 2), ("edges", "src", None, "missing", 1),
    ]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    from weftline.operators.orphans import _tagged

    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "key")
    words = key_filter(keys, "key")
    assert words.dtype == np.uint64
    tagged = _tagged(spark.range(20_000).withColumnRenamed("id", "key"), words).toPandas()
    assert tagged[tagged.key % 2 == 0].maybe.all()
    assert tagged[tagged.key % 2 == 1].maybe.mean() < 0.05


def test_one_key_and_one_moment_hold_most(spark, monkeypatch):
    """Rows of one key at one time, or at none, are spread as well."""
    monkeypatch.setattr(module, "KEY_ROWS", 50)
    nodes = [(1, at(10), at(20), at(0)), (1, at(30), None, at(0)), (2, at(5), None, at(0))]
    edges = [(k, 1, 2, at(15)) for k in range(400)] + [(1000 + k, 1, None, at(25)) for k in range(200)] + [(2000 + k, None, 1, None) for k in range(90)]
    got = orphans(spark, nodes, edges)
    assert Counter((r["endpoint"], r["cause"]) for r in got) == {("src", "deleted"): 200, ("dst", "late"): 90}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_sums(spark, parts):
    from pyspark.sql import functions as F

    from weftline.operators.prefix import running_sums

    rng = random.Random(parts)
    rows = [(rng.choice("aaaaab"), k, rng.randrange(-3, 9)) for k in range(500)] + [("c", 0, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "key string, at int, part int").repartition(5)
        got = running_sums(df, "key", [F.col("at").desc()], {"s": F.col("part"), "n": F.lit(1)}, totals=("s",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for r in got:
        after = [x for k, a, x in rows if k == r["key"] and a >= r["at"]]
        assert (r["s"], r["n"], r["total_s"]) == (sum(after), len(after), sum(x for k, _, x in rows if k == r["key"]))
    assert len(got) == 501


# ---- records


def brute_parse(raw):
    """The fields of a record read character by character, or the reason why not."""
    text = raw or ""
    text = text[:-2] if text.endswith("\r\n") else text[:-1] if text.endswith(("\r", "\n")) else text
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(text):
                    return "quoting"
                if text[i] != '"':
                    value, i = value + text[i], i + 1
                elif text[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                else:
                    i += 1
                    break
            if i < len(text) and text[i] != ",":
                return "quoting"
        else:
            end = text.find(",", i)
            end = len(text) if end < 0 else end
            value = text[i:end]
            if '"' in value:
                return "quoting"
            i = end
        fields.append(value)
        if i >= len(text):
            break
        i += 1
    if len(fields) != 3:
        return "columns"
    src, dst, weight = (f.strip(" \t") for f in fields)
    if not src or not dst or not weight or any(c not in "0123456789" for c in weight) or int(weight) > 2147483647:
        return "value"
    return src, dst, int(weight)


ODD_RECORDS = [
    None, "", "a", ",,", "a,b,1", "a,b,1\n", "a,b,1\r\n", "a,b,1\n\r", "a,b,1\n\n", "a,b,01", "a,b,0000000000000000007", "a,b,2147483647", "a,b,2147483648", "a,b,99999999999999999999999",
    "a,b,-1", "a,b,1.0", "a,b,1e3", "a,b,١", "a,b, 1\t", " a ,\tb,1", " ,b,1", "a,\t,1", "a,b,", "a,b,1,", ",a,b,1", '"a","b","1"', '"a,b",c,1', '"a""b",c,1', '"",b,1', '"""",b,1', '"""a",b,1',
    '"a""",b,1', '"a"" ",b,1', '"a" ,b,1', '"a"x,b,1', ' "a",b,1', 'a"b,c,1', 'a,"b,1', 'a,b,"1', 'a,b,"1"\r\n', '"a\nb",c,1', "a\nb,c,1", "a,b\r,1", '"a\r\n', '"', '""', '"""', 'a,"",1', '"a","b"', '"a,b,c,1', "a ,b,1", " ,b,1",
    '"' + '""' * 20000 + '",b,1', "x" * 200000 + ",b,1", '"' + '""' * 20001, '"a",' * 5000 + "1", 'a,b,1"', '"a","b""c","2"\n',
]


def raw_frame(spark, records):
    rows = [{"line_id": k, "raw_line": r, "__body": "x", "src": k, "weight": None} for k, r in enumerate(records)]
    kinds = pa.schema([("line_id", pa.int64()), ("raw_line", pa.string()), ("__body", pa.string()), ("src", pa.int64()), ("weight", pa.int32())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=kinds))


def check_records(spark, records):
    raw = raw_frame(spark, records)
    good = {r["line_id"]: (r["src"], r["dst"], r["weight"]) for r in strict_load(raw, offset="line_id", line="raw_line").collect()}
    bad = {r["line_id"]: r["reason"] for r in rejected_records(raw, offset="line_id", line="raw_line").collect()}
    want = {k: brute_parse(r) for k, r in enumerate(records)}
    assert good.keys() | bad.keys() == want.keys() and not good.keys() & bad.keys()
    for k, x in want.items():
        assert (good.get(k) or bad.get(k)) == x, repr(records[k])[:80]


def test_odd_records(spark):
    check_records(spark, ODD_RECORDS)


def test_weight_of_many_zeros(spark):
    check_records(spark, [f"a,b,{'0' * n}" for n in (1, 10, 11, 12, 4000)] + ["a,b,000000000002147483648"])


def test_random_records(spark):
    rng = random.Random(9)
    check_records(spark, ["".join(rng.choices('ab1"",, \t\n\r', k=rng.randrange(14))) for _ in range(4000)])


def test_load_schema_and_empty_input(spark):
    raw = raw_frame(spark, [])
    loaded = strict_load(raw, offset="line_id", line="raw_line")
    assert loaded.dtypes == [("line_id", "bigint"), ("src", "string"), ("dst", "string"), ("weight", "int")]
    assert loaded.count() == 0 == rejected_records(raw, offset="line_id", line="raw_line").count()


# ---- totals

EDGE_KINDS = pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.int64()), ("endpoint", pa.string()), ("n_rows", pa.int32())])


def brute_totals(rows):
    out = defaultdict(lambda: [0, None])
    for src, dst, weight in rows:
        for end, k in (("src", src), ("dst", dst)):
            if k is not None:
                out[end, k][0] += 1
                if weight is not None:
                    out[end, k][1] = (out[end, k][1] or 0) + weight
    return {k: tuple(v) for k, v in out.items()}


def totals(spark, rows):
    table = pa.Table.from_pylist([dict(zip(("src", "dst", "weight"), r)) for r in rows], schema=EDGE_KINDS)
    df = dense_totals(spark.createDataFrame(table).repartition(3), ["src", "dst"], "weight")
    return df, {(r["endpoint"], r["node_name"]): (r["n_rows"], r["total_weight"]) for r in df.collect()}


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_totals_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dense_counts, "BLOCK_ROWS", block)
    rng = random.Random(2)
    names = ["hot"] * 30 + ["", "Hot", " hot", "é", None, "x" * 10000] + [f"n{k}" for k in range(40)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice([None, 0, 5, -3, 2**52, -(2**52) + 1])) for _ in range(300)]
    rows += [("only null", "z", None)] * 2
    _, got = totals(spark, rows)
    assert got == brute_totals(rows)


def test_sums_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        totals(spark, [("a", "b", 2**62)] * 4)


def test_totals_of_nothing(spark):
    assert totals(spark, [])[1] == {}
    assert totals(spark, [(None, None, 5)])[1] == {}


def test_busy_keys(spark):
    rows = [("a", "z", 1)] * 2 + [(f"n{k}", "z" if k % 2 else None, 1) for k in range(98)]
    df, _ = totals(spark, rows)
    assert {(r["endpoint"], r["node_name"]) for r in busy_keys(df, 0.02).collect()} == {("src", "a"), ("dst", "z")}
    per_column = dense_counts.rows_with_keys(spark.createDataFrame(rows, "src string, dst string, weight int"), ["src", "dst"])
    assert sorted(map(tuple, busy_keys(df, 0.02, per_column).select("endpoint", "node_name").collect())) == [("dst", "z"), ("src", "a")]
    assert len(busy_keys(df, 0.0).collect()) == 100 and Counter(r["endpoint"] for r in busy_keys(df, 0.01).collect())["src"] == 99
