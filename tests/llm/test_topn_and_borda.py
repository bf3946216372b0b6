"""Top N per group and Borda ranking against brute force, with ties, nulls, copies and hot groups."""

import math
import random

import pyarrow as pa
import pytest

from weftline.errors import ColumnNotFoundError
from weftline.llm import borda
from weftline.llm.borda import borda_points, borda_ranking
from weftline.llm.topn import top_n_per_group

KINDS = pa.schema([("g", pa.string()), ("score", pa.int64()), ("id", pa.int64()), ("__salt", pa.string()), ("__place", pa.string()), ("final", pa.string())])
ORDER = [("score", "desc"), ("id", "asc")]


def frame(spark, rows):
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(("g", "score", "id"), r)) for r in rows], schema=KINDS))


def brute_top(rows, n, once):
    groups = {}
    for r in (set(rows) if once else rows):
        if r[0] is not None:
            groups.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0)
    return sorted((r for g in groups.values() for r in sorted(g, key=key)[:n]), key=str)


@pytest.mark.parametrize("subgroups", [1, 5, 64])
@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_against_brute_force(spark, n, subgroups):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 8 + [None, "", "a", "b", "é"]), rng.choice([None, 1, 2, 2, 2, 3]), k if rng.random() < 0.95 else None) for k in range(400)]
    rows += rows[:60] + [("hot", 3, 1)] * 100
    df = frame(spark, rows).repartition(5)
    got = top_n_per_group(df, "g", ORDER, n, same=["score", "id"], subgroups=subgroups)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, n, True)
    kept = top_n_per_group(df, "g", ORDER, n, subgroups=subgroups)
    assert kept.columns == KINDS.names
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == brute_top(rows, n, False)


def test_top_n_places_and_odd_input(spark):
    df = frame(spark, [("a", 1, 1), ("a", 2, 2), ("b", None, 3), (None, 9, 9)])
    ranked = top_n_per_group(df, ["g"], ORDER, 5, same=["score", "id"], rank="place")
    assert sorted(map(tuple, ranked.collect()), key=str) == [("a", 1, 1, 2), ("a", 2, 2, 1), ("b", None, 3, 1)]
    assert top_n_per_group(df, "g", ORDER, 0).count() == 0 == top_n_per_group(frame(spark, []), "g", ORDER, 3).count()
    with pytest.raises(ColumnNotFoundError):
        top_n_per_group(df, "other", ORDER, 1)
    for bad in ({"order": [("score", "down")], "n": 1}, {"order": ORDER, "n": -1}, {"order": ORDER, "n": 1, "same": ["score"]}):
        with pytest.raises(ValueError):
            top_n_per_group(df, "g", **bad)


def test_top_n_prunes_before_its_shuffles(spark):
    df = frame(spark, [("a", k, k) for k in range(100)])
    plan = top_n_per_group(df, "g", ORDER, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # partial and final, in both stages


# ---- Borda

SCORES = pa.schema([("g", pa.string()), ("i", pa.int64()), ("a", pa.float64()), ("b", pa.int64()), ("x0", pa.string()), ("place", pa.string()), ("points", pa.string())])


def scored(spark, rows):
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(("g", "i", "a", "b"), r)) for r in rows], schema=SCORES))


def brute_points(rows, weights, ties, missing):
    known = {r for r in {tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows} if r[0] is not None and r[1] is not None}
    out = []
    for r in known:
        total = 0.0
        for k, weight in enumerate(weights):
            mine = [q[2 + k] for q in known if q[0] == r[0]]
            there = [x for x in mine if x is not None]
            absent = len(mine) - len(there)
            if r[2 + k] is not None:
                place = 1 + sum(x > r[2 + k] for x in there)
                if ties == "average":
                    place += (sum(x == r[2 + k] for x in there) - 1) / 2
            elif missing == "mid":
                place = (len(mine) + 1) / 2
            else:
                place = len(there) + 1 + ((absent - 1) / 2 if ties == "average" else 0)
            total += weight * place
        out.append((r[0], r[1], total))
    return sorted(out, key=str)


@pytest.mark.parametrize("ties", ["average", "min"])
@pytest.mark.parametrize("missing", ["mid", "last"])
@pytest.mark.parametrize("large", [100_000, 60, 0])
def test_borda_against_brute_force(spark, monkeypatch, ties, missing, large):
    monkeypatch.setattr(borda, "GROUP_ROWS", large)
    rng = random.Random(3)
    pool = [None, float("nan"), 0.0, -0.0, 1e-300, 5e-324, -1e-9, 1.0, math.nextafter(1.0, 2), 1e300, float("inf"), float("-inf"), -7.0]
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), k, rng.choice([*pool, rng.gauss(0, 1)]), rng.choice([None, 0, 0, 0, 1, 2, rng.randrange(10**9)])) for k in range(300)]
    rows += rows[:20] + [("a", None, 1.0, 1)]
    got = borda_points(scored(spark, rows).repartition(4), "g", "i", {"a": 1.0, "b": 0.5}, ties=ties, missing=missing)
    assert sorted(map(tuple, got.collect()), key=str) == brute_points(rows, [1.0, 0.5], ties, missing)


@pytest.mark.parametrize("large", [100_000, 0])
def test_borda_ranking(spark, monkeypatch, large):
    monkeypatch.setattr(borda, "GROUP_ROWS", large)
    rows = [("g", 1, 1000.0, 1), ("g", 2, 10.0, 2), ("g", 3, 900.0, 3), ("g", 4, 1000.0, 1), ("h", 9, None, None)]
    ranked = borda_ranking(scored(spark, rows), "g", "i", {"a": 1.0, "b": 1.0}, 2)
    assert ranked.columns == ["g", "i", "points", "rank"]
    assert sorted((r["g"], r["i"], r["rank"]) for r in ranked.collect()) == [("g", 1, 2), ("g", 3, 1), ("h", 9, 1)]
    assert borda_ranking(scored(spark, []), "g", "i", {"a": 1.0}, 2).count() == 0
    with pytest.raises(ValueError):
        borda_points(scored(spark, rows), "g", "i", {"a": 1.0}, ties="other")


def test_copies_share_a_place_and_are_pruned_before_the_shuffle(spark):
    """Deliveries of one item tie in every ranking, however many there are, and no merge comes ahead of the pruning."""
    rows = [("a", k % 3, 1.0 * (k % 3)) for k in range(3000)] + [("b", 7, None)] * 5
    df = spark.createDataFrame(rows, "g string, id int, score double").repartition(6)
    top = top_n_per_group(df, "g", [("score", "desc"), ("id", "asc")], 2, same=["id", "score"], rank="place")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") >= 3
    assert sorted(map(tuple, top.collect()), key=str) == [("a", 1, 1.0, 2), ("a", 2, 2.0, 1), ("b", 7, None, 1)]
