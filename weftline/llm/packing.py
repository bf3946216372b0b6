"""Filling fixed-capacity containers with items.

Method: sum-of-squares online packing. A packer keeps an array of how many open windows there are at
each fill level, and puts every item where the sum of squares of these counts becomes least. Items are
the texts' sizes in tokens of a public tokenizer.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import col, require
from weftline.shipping import ship

__all__ = ["token_counts", "pack", "SumOfSquares", "TOKENIZER_DIR", "TOKENIZER_FILE", "SHARD_ITEMS"]

#: Where the public tokenizers' files lie on every machine; the directory can be set per call too.
TOKENIZER_DIR = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"

#: Items of one packer on average. Each packer leaves a few windows partly filled, so shards are large.
SHARD_ITEMS = 25_000

# Fixed value: the published pattern by which this vocabulary splits text ahead of merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("weftline", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, item: str, text: str, *, tokenizer: str | None = None) -> DataFrame:
    """``(item, n_tokens)`` for every row: the size of its whole text in tokens, 0 if null or empty."""
    require(df, item, text)
    ship(df.sparkSession)
    path = tokenizer or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    schema = T.StructType([T.StructField("item", df.schema[item].dataType), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        encode = _encoding(path).encode_to_numpy  # four bytes a token, however long the text
        for b in batches:
            sizes = [len(encode(t, disallowed_special=())) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["item", "n_tokens"])

    counted = df.select(col(item).alias("item"), col(text).cast("string").alias("text")).mapInArrow(count, schema)
    return counted.withColumnRenamed("item", item)


class SumOfSquares:
    """The level array of one packer.

    ``place(size)`` gives the window for an item of 1 to ``capacity`` units and the level it starts at.
    The choice among all levels, a new window among them, is the one after which the sum of squared
    numbers of open windows by level is least; ties go to the fullest window.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)  # by level; level 0 and a full window count as none
        self.stacks: dict[int, list[int]] = {}
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        cap, n = self.capacity, self.open
        # Moving a window from level h to h + size changes the sum by 2 (n[h + size] - n[h] + 1), without
        # the second part if it becomes full; opening one changes it by 2 n[size] + 1.
        levels = np.flatnonzero(n[1 : cap - size + 1]) + 1
        best, level = (2 * int(n[size]) + 1 if size < cap else 0), 0
        if len(levels):
            after = levels + size
            change = np.where(after < cap, 2 * (n[np.minimum(after, cap)] - n[levels] + 1), 1 - 2 * n[levels])
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(levels[k])
        if level:
            n[level] -= 1
            window = self.stacks[level].pop()
        else:
            window, self.windows = self.windows, self.windows + 1
        if level + size < cap:
            n[level + size] += 1
            self.stacks.setdefault(level + size, []).append(window)
        return window, level


def pack(items: DataFrame, item: str, size: str, capacity: int, *, n_items: int | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(item, piece, n_tokens, shard, window, starts_at)``: a place for every piece of every item.

    An item of at most ``capacity`` units is one piece and is never split. A larger one fills whole
    windows of its own and leaves its rest as a last piece, packed like any item. Items of null, zero or
    negative size take no room: one row with piece 0, 0 tokens, and null window. A window is named by
    ``shard`` and ``window``. Repeated identifiers are packed each for itself; further columns are
    ignored; an empty input gives an empty result.

    Items are spread over packers of about ``shard_items``, whatever the size of the input, so a packer's time and memory
    stay the same as data grows: by the hash of identifier, size and split of the input, so that rows of one identifier, or
    of none, are spread as well. Within a packer items come in order of identifier and size by hash: the same input in the same splits
    gives the same windows. ``n_items`` is the number of items where it is known more cheaply than by counting ``items``,
    which may have to be computed.
    """
    require(items, item, size)
    if capacity < 1:
        raise ValueError("a container holds at least one unit")
    shards = max(1, ceil((items.count() if n_items is None else n_items) / shard_items))
    kind = items.schema[item].dataType
    sized = items.select(
        col(item).alias("item"),
        F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
        F.spark_partition_id().alias("split"),
    )
    sized = sized.select("item", "n", F.xxhash64("item", "n").alias("h"), F.pmod(F.xxhash64("item", "n", "split"), F.lit(shards)).cast("int").alias("shard"))
    schema = T.StructType(
        [T.StructField("item", kind), T.StructField("piece", T.LongType()), T.StructField("n_tokens", T.LongType())]
        + [T.StructField("shard", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("starts_at", T.LongType())]
    )

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("item", "ascending"), ("n", "descending")])
        packer = SumOfSquares(capacity)
        at, piece, got, window, start = [], [], [], [], []
        for row, n in enumerate(table.column("n").to_pylist()):
            whole, rest = divmod(n, capacity)
            parts = [capacity] * whole + ([rest] if rest or not n else [])
            for p, part in enumerate(parts):
                w, s = packer.place(part) if part else (None, None)
                at.append(row), piece.append(p), got.append(part), window.append(w), start.append(s)
        columns = [table.column("item").take(pa.array(at, pa.int64())), pa.array(piece, pa.int64()), pa.array(got, pa.int64())]
        columns += [pa.array([key[0].as_py()] * len(at), pa.int32()), pa.array(window, pa.int64()), pa.array(start, pa.int64())]
        return pa.Table.from_arrays(columns, names=schema.names)

    return sized.groupBy("shard").applyInArrow(fill, schema).withColumnRenamed("item", item)
