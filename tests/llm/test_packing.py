"""Token counts and packing: every item placed once, nothing split or overfull, little room lost."""

import os
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from weftline.llm.packing import TOKENIZER_DIR, SumOfSquares, pack, token_counts

here = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no tokenizers here")


def packed(spark, sizes, capacity, **how):
    kinds = pa.schema([("item", pa.string()), ("n", pa.int64()), ("shard", pa.string()), ("h", pa.string())])
    df = spark.createDataFrame(pa.Table.from_pylist([{"item": k, "n": n, "shard": "x"} for k, n in sizes], schema=kinds))
    return pack(df, "item", "n", capacity, **how).collect()


def check(rows, sizes, capacity):
    """Windows used."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["item"]].append(r)
        if r["window"] is None:
            assert r["n_tokens"] == 0 and r["piece"] == 0
        else:
            windows[r["shard"], r["window"]].append((r["starts_at"], r["n_tokens"]))
    want = defaultdict(int)
    for k, n in sizes:
        want[k] += max(0, n or 0)
    assert {k: sum(r["n_tokens"] for r in p) for k, p in pieces.items()} == dict(want)
    for parts in windows.values():
        end = 0
        for start, n in sorted(parts):
            assert start == end and n > 0
            end += n
        assert end <= capacity
    return len(windows)


def test_everything_is_placed_once(spark):
    rng = random.Random(1)
    sizes = [(f"i{k}", rng.choice([1, 2, rng.randrange(1, 100), rng.randrange(1, 100)])) for k in range(3000)]
    rows = packed(spark, sizes, 100, shard_items=1000)
    assert all(r["piece"] == 0 for r in rows) and len(rows) == len(sizes)
    used = check(rows, sizes, 100)
    assert used * 100 <= 1.03 * sum(n for _, n in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, packed(spark, sizes, 100, n_items=len(sizes), shard_items=1000)))


def test_large_items_fill_windows_of_their_own(spark):
    sizes = [("a", 250), ("b", 100), ("c", 50), ("d", 1000)]
    rows = packed(spark, sizes, 100)
    assert check(rows, sizes, 100) == 14
    assert sorted((r["piece"], r["n_tokens"]) for r in rows if r["item"] == "a") == [(0, 100), (1, 100), (2, 50)]


def test_odd_sizes(spark):
    sizes = [("none", None), ("zero", 0), ("less", -5), ("one", 1), (None, 3), ("twice", 2), ("twice", 2), ("full", 10)]
    assert check(packed(spark, sizes, 10), sizes, 10) == 2
    assert packed(spark, [], 10) == []
    with pytest.raises(ValueError):
        packed(spark, sizes, 0)
    ones = [(str(k), 1) for k in range(25)]
    assert check(packed(spark, ones, 1), ones, 1) == 25


def brute_place(open_windows, capacity, size):
    """The least sum of squares over all choices, by trying each."""

    def squares(levels):
        return sum(c * c for h, c in levels.items() if 0 < h < capacity)

    levels = defaultdict(int)
    for h in open_windows:
        levels[h] += 1
    best = None
    for h in {0, *(x for x in open_windows if x + size <= capacity)}:
        after = dict(levels)
        if h:
            after[h] -= 1
        after[h + size] = after.get(h + size, 0) + 1
        if best is None or squares(after) < best:
            best = squares(after)
    return best, squares


def test_placement_is_the_least_sum_of_squares():
    rng = random.Random(7)
    for capacity in (5, 12, 30):
        packer, fill = SumOfSquares(capacity), {}
        for _ in range(400):
            size = rng.randrange(1, capacity + 1)
            best, squares = brute_place([h for h in fill.values() if h < capacity], capacity, size)
            window, start = packer.place(size)
            assert fill.get(window, 0) == start
            fill[window] = start + size
            levels = defaultdict(int)
            for h in fill.values():
                levels[h] += 1
            assert squares(levels) == best


@here
def test_token_counts(spark):
    texts = ["", None, "hello world", "naïve 語 🎉", "a" * 100_000, " " * 50_000, "x\n\n y", "<|endoftext|>"]
    kinds = pa.schema([("id", pa.int64()), ("text", pa.string()), ("item", pa.string()), ("n_tokens", pa.string())])
    df = spark.createDataFrame(pa.Table.from_pylist([{"id": k, "text": t} for k, t in enumerate(texts)], schema=kinds))
    counts = dict(map(tuple, token_counts(df, "id", "text").collect()))
    assert counts.keys() == set(range(len(texts)))
    assert counts[0] == 0 == counts[1] and counts[2] == 2 and counts[4] > 1000 and counts[7] > 1
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for k, t in enumerate(texts):
        if t:
            assert counts[k] == len(other.encode(t, add_special_tokens=False).ids)


def test_rows_without_identifier_are_spread(spark):
    """One identifier, or none, on most rows is no single packer's work."""
    df = spark.createDataFrame([(None, 7)] * 900 + [(5, 3)] * 100, "id int, n int").repartition(8)
    placed = pack(df, "id", "n", 20, shard_items=100).groupBy("shard").count().collect()
    assert len(placed) > 3 and sum(r["count"] for r in placed) == 1000
