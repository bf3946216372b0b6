"""Per-key counts and sums where a few keys hold most rows.

Method: dense accumulator arrays. Every input split dictionary-encodes its keys and adds its rows into
arrays indexed by the code (``numpy.bincount``). The arrays are cut into slices by the hash of their names, and each
slice is summed by a distributed reduction: its own dictionary codes the names of all blocks, and their
arrays are added into the slice's. Work depends on rows and names only, never on how many rows share a key.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.columns import col, require
from weftline.shipping import ship

__all__ = ["dense_totals", "rows_with_keys", "busy_keys"]

#: Rows that are encoded together. At 2**20, sums of 32-bit halves stay below 2**53, so that float
#: accumulators are exact.
BLOCK_ROWS = 1 << 20

#: Entries of array blocks that a slice adds at a time, with the same bound for exact sums.
SLICE_ENTRIES = 1 << 20

_SUMS = ("n_rows", "n_weights", "total_weight")
_BLOCK = "slice int, endpoint int, node_name array<string>, n_rows array<bigint>, n_weights array<bigint>, total_weight array<bigint>"
_TOTALS = "endpoint string, node_name string, n_rows bigint, n_weights bigint, total_weight bigint"


def _summed(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact int64 sums by code, from the values' high and low halves."""
    high = np.bincount(codes, weights=(values >> 32).astype(np.float64), minlength=size)
    low = np.bincount(codes, weights=(values & 0xFFFFFFFF).astype(np.float64), minlength=size)
    if len(high) and np.abs(high + low / 2.0**32).max() >= 2.0**31:
        raise OverflowError("a sum of weights is beyond 64 bits")
    return (high.astype(np.int64) << 32) + low.astype(np.int64)


def _flat(a) -> pa.Array:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def _block(table: pa.Table, at: int, weights: np.ndarray, known: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """The names of one key column in a block of rows, and the arrays indexed by their codes."""
    keys = _flat(table.column(at)).dictionary_encode()
    there = keys.is_valid().to_numpy(zero_copy_only=False)
    codes = keys.indices.drop_null().to_numpy()
    size = len(keys.dictionary)
    known = known[there]
    counted = np.bincount(codes, minlength=size)
    return keys.dictionary.cast(pa.string()), [counted, np.bincount(codes[known], minlength=size), _summed(codes[known], weights[there][known], size)]


def _sliced(endpoint: int, names: pa.Array, arrays: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """A row for each slice of the arrays; a name is in the same slice whatever the block."""
    of = (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    there, start = np.unique(of[order], return_index=True)
    ends = pa.array(np.append(start, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, names.take(pa.array(order)))] + [pa.ListArray.from_arrays(ends, pa.array(a[order], pa.int64())) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([endpoint] * len(there), pa.int32()), *lists], names=["slice", "endpoint", "node_name", *_SUMS])


class _Slice:
    """The accumulators of one key column's names in a slice."""

    def __init__(self):
        self.names, self.arrays = [pa.array([], pa.string())], [[np.zeros(0, np.int64)] for _ in _SUMS]
        self.waiting = 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.names.append(_flat(rows.column("node_name")).flatten())
        for held, name in zip(self.arrays, _SUMS):
            held.append(_flat(rows.column(name)).flatten().to_numpy())
        self.waiting += len(self.names[-1])
        if self.waiting >= SLICE_ENTRIES:
            self.settle()

    def settle(self) -> tuple[pa.Array, list[np.ndarray]]:
        coded = pa.concat_arrays([x.cast(pa.string()) for x in self.names]).dictionary_encode()
        codes = coded.indices.to_numpy()
        summed = [_summed(codes, np.concatenate(held), len(coded.dictionary)) for held in self.arrays]
        self.names, self.arrays, self.waiting = [coded.dictionary], [[a] for a in summed], 0
        return coded.dictionary, summed


def dense_totals(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``(endpoint, node_name, n_rows, total_weight)`` for each key column (``endpoint``) and each of its values.

    ``n_rows`` counts all rows with the key, repeated ones too; ``total_weight`` sums the weights that
    are not null, and is null if there is none. Null keys are no keys; the empty string is one. Names
    are compared exactly. ``weight`` is an integer column; a sum beyond 64 bits is an error. Other columns are ignored, and an empty
    input has no keys.
    """
    require(df, *keys, weight)
    ship(df.sparkSession)

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            w = _flat(table.column(len(keys)))
            known = w.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(w, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(len(keys)):
                names, arrays = _block(table, at, values, known)
                if len(names):
                    yield _sliced(at, names, arrays, slices)

        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS // 2):
                held.append(b.slice(start, BLOCK_ROWS // 2))
                n += held[-1].num_rows
                if n > BLOCK_ROWS // 2:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def reduced(batches):
        mine = [_Slice() for _ in keys]
        for b in batches:
            endpoint = b.column(1).to_numpy()
            for at, accumulators in enumerate(mine):
                rows = np.flatnonzero(endpoint == at)
                for k in range(0, len(rows), 256):
                    accumulators.add(b.take(pa.array(rows[k : k + 256])))
        for at, accumulators in enumerate(mine):
            names, arrays = accumulators.settle()
            for k in range(0, len(names), 1 << 16):
                some = names.slice(k, 1 << 16)
                columns = [pa.array([keys[at]] * len(some), pa.string()), some, *[pa.array(a[k : k + (1 << 16)]) for a in arrays]]
                yield pa.RecordBatch.from_arrays(columns, names=["endpoint", "node_name", *_SUMS])

    narrow = df.select(*[col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], col(weight).cast("long").alias("w"))
    summed = narrow.mapInArrow(blocks, _BLOCK).repartition("slice").mapInArrow(reduced, _TOTALS)
    return summed.select("endpoint", "node_name", "n_rows", F.when(F.col("n_weights") > 0, F.col("total_weight")).alias("total_weight"))


def rows_with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(endpoint, n_column)``: the rows of each key column that are not null."""
    require(df, *keys)
    counted = df.agg(*[F.count(col(k)).alias(f"c{i}") for i, k in enumerate(keys)])
    each = F.array(*[F.struct(F.lit(k).alias("endpoint"), F.col(f"c{i}").alias("n_column")) for i, k in enumerate(keys)])
    return counted.select(F.explode(each).alias("x")).select("x.*")


def busy_keys(totals: DataFrame, share: float, per_column: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`dense_totals` whose key fills at least ``share`` of its column's non-null rows.

    The comparison is exact decimal arithmetic. ``per_column`` is :func:`rows_with_keys` where the rows are at hand, which
    spares adding up the totals. It is one row a key column, so it is broadcast.
    """
    if per_column is None:
        per_column = totals.groupBy("endpoint").agg(F.sum("n_rows").alias("n_column"))
    least = F.lit(Decimal(str(share))) * F.col("n_column").cast("decimal(20,0)")
    return totals.join(F.broadcast(per_column), "endpoint").where(F.col("n_rows").cast("decimal(20,0)") >= least)
