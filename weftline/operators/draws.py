"""One stream of random draws for arrays and for Spark columns: Spark's own 64-bit hash, and the same over NumPy arrays.

A draw depends on the seed and on what it is for, never on how work is split or which side of a size it runs on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["draw", "draw_column", "id_numbers", "id_number_column"]

# The primes of the public XXH64 function, and the seed that Spark's xxhash64 starts from.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SPARK_SEED = 42
#: Draws are of 62 bits: never negative.
_BITS = (1 << 62) - 1


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(number: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of eight bytes."""
    h = seed + _P5 + np.uint64(8)
    h = h ^ (_rotated(number * _P2, 31) * _P1)
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _long(x: int) -> int:
    """The whole number as 64 bits with sign."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def draw(seed: int, what: np.ndarray, step: int) -> np.ndarray:
    """A number of 62 bits for each of ``what`` (whole numbers) at a step."""
    one = lambda x: np.array([x], np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = _hashed(one(_long(seed)), one(_SPARK_SEED))
        h = _hashed(one(step), _hashed(np.ascontiguousarray(what, np.int64).view(np.uint64), h))
    return (h & np.uint64(_BITS)).view(np.int64)


def draw_column(seed: int, what: Column, step: int) -> Column:
    """As :func:`draw`, of a bigint column."""
    return F.xxhash64(F.lit(_long(seed)).cast("long"), what, F.lit(step).cast("long")).bitwiseAND(F.lit(_BITS))


def id_numbers(ids: pa.Array) -> np.ndarray:
    """A whole number for each identifier: itself, or the 64-bit hash of a name that Spark has as ``xxhash64``."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), seed=42) for x in ids.to_pylist()), np.uint64, len(ids)).view(np.int64)


def id_number_column(name: str, kind: str) -> Column:
    return F.col(name) if kind == "bigint" else F.xxhash64(name)
