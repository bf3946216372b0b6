"""References to records that do not exist (at the time of the reference).

Method: a Bloom filter of all parent keys, of fixed size, is broadcast and proves most dangling
references at once; only the references that pass it are verified by an exact join with the
parents' lives; the verdicts are then aggregated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.columns import col, require, stored
from weftline.operators.prefix import running_sums

__all__ = ["orphan_references", "orphan_report", "key_filter", "FILTER_MAX_BITS"]

#: Hash functions of the filter, and the bounds of its size in bits (64 MiB at most, whatever the data). At most size
#: it has ten bits a key for 54 million parent keys; of 200 million it still proves half of what is missing.
FILTER_HASHES = 4
FILTER_MIN_BITS = 1 << 16
FILTER_MAX_BITS = 1 << 29

#: Rows of one key that are swept in one task. The rows of a key with more are spread by time.
KEY_ROWS = 1_000_000


def _positions(key, bits: int):
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(FILTER_HASHES)]


def key_filter(keys: DataFrame, key: str, n_keys: int | None = None) -> np.ndarray:
    """The Bloom filter of ``keys[key]`` as 64-bit words.

    About ten bits a key within the fixed bounds: past ``FILTER_MAX_BITS`` it only lets more
    references through to the exact join. The bits are gathered by a partial aggregation, so at
    most ``bits / 64`` rows are shuffled from a task or sent to the driver.
    """
    n = keys.count() if n_keys is None else n_keys
    bits = FILTER_MIN_BITS
    while bits < 10 * n and bits < FILTER_MAX_BITS:
        bits *= 2
    at = keys.where(col(key).isNotNull()).select(F.explode(F.array(*_positions(col(key), bits))).alias("p"))
    rows = (
        at.groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def _tagged(refs: DataFrame, words: np.ndarray) -> DataFrame:
    """``refs`` with ``maybe``: whether the filter knows the key. Done batch by batch on Arrow columns."""
    shared = refs.sparkSession.sparkContext.broadcast(words)
    names = refs.columns
    hashes = [f"__h{i}" for i in range(FILTER_HASHES)]
    hashed = refs.select(*names, *[p.alias(h) for p, h in zip(_positions(col("key"), len(words) * 64), hashes)])
    out = T.StructType([*refs.schema.fields, T.StructField("maybe", T.BooleanType())])

    def tag(batches):
        w = shared.value
        for b in batches:
            hit = np.ones(b.num_rows, dtype=bool)
            for h in hashes:
                p = b.column(b.schema.get_field_index(h)).to_numpy(zero_copy_only=False)
                hit &= (w[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hit)], names=[*names, "maybe"])

    return hashed.mapInArrow(tag, out)


def orphan_references(
    records: DataFrame,
    references: list[str],
    parents: DataFrame,
    *,
    record_id: str,
    seen_at: str,
    key: str,
    begins_at: str,
    ends_at: str,
    version: str,
) -> DataFrame:
    """Dangling references: ``(record_id, endpoint, seen_at, cause)``, one row for each.

    ``records[references]`` hold keys of ``parents``. A parent lives from ``begins_at`` (inclusive) to
    ``ends_at`` (exclusive, null: for ever) and may have several lives; of rows with the same key and
    begin, the one of the greatest ``version`` holds. The cause is ``missing`` if the key has no life,
    ``late`` if all its lives begin after the reference was seen, else ``deleted``.

    Records repeated with the same id, references and ``seen_at`` count once; null references are no
    references. A null ``seen_at`` is before all times, so such a reference to a known key is
    ``late``. Parent rows with a null key or begin, and lives that end before they begin, hold no
    moment (the latter still make the key known). Other columns, whatever their names, are ignored;
    empty tables give an empty result, or all references as ``missing``.

    References are verified key by key, with lives and references swept in order of time: one shuffle. The rows of a key
    with more than ``KEY_ROWS`` are no single task's work: they are sorted into ranges of time of equal size, and what happened
    before a range enters it as two numbers.
    """
    require(records, record_id, seen_at, *references)
    require(parents, key, begins_at, ends_at, version)
    lives = stored(
        parents.where(col(key).isNotNull() & col(begins_at).isNotNull())
        .groupBy(col(key).alias("key"), col(begins_at).alias("t"))
        .agg(F.max(F.struct(col(version).alias("v"), col(ends_at).alias("e")))["e"].alias("e"))
    )
    words = key_filter(lives.select("key").distinct(), "key")

    at = F.posexplode(F.array(*[col(r) for r in references])).alias("endpoint", "key")
    refs = records.select(col(record_id).alias("record_id"), col(seen_at).alias("t"), at).where(F.col("key").isNotNull())
    tagged = stored(_tagged(refs, words))
    proven = tagged.where(~F.col("maybe")).select("record_id", "endpoint", "key", "t").distinct().withColumn("cause", F.lit("missing"))

    # What passes the filter is verified exactly, against the moments at which lives begin and end.
    none = {f.name: F.lit(None).cast(f.dataType) for f in refs.schema.fields if f.name in ("record_id", "endpoint")}
    begun = lives.select("key", "t", F.when(F.col("e") <= F.col("t"), _FLEETING).otherwise(_BEGIN).alias("kind"))
    ended = lives.where(F.col("e") > F.col("t")).select("key", F.col("e").alias("t"), F.lit(_END).alias("kind"))
    moments = begun.unionByName(ended).select("key", "t", "kind", *[c.alias(n) for n, c in none.items()])
    asked = tagged.where("maybe").select("key", "t", F.lit(_REFERENCE).alias("kind"), "record_id", "endpoint")
    rows = moments.unionByName(asked)
    busy = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("key"))
    if busy.isEmpty():
        verified = _by_key(rows)
    else:
        verified = _by_key(rows.join(busy, "key", "left_anti")).unionByName(_by_time(rows.join(busy, "key", "left_semi")))
    cause = F.when(F.col("lives") == 0, "missing").when(F.col("born") == 0, "late").otherwise("deleted")
    dangling = verified.where((F.col("kind") == _REFERENCE) & (F.col("alive") <= 0)).withColumn("cause", cause)
    names = F.array(*[F.lit(r) for r in references])
    both = proven.select("record_id", "endpoint", "t", "cause").unionByName(dangling.select("record_id", "endpoint", "t", "cause"))
    return both.select(F.col("record_id").alias(record_id), names[F.col("endpoint")].alias("endpoint"), F.col("t").alias(seen_at), "cause")


#: Kinds of rows in the sweep, in the order that holds among those of one moment. A fleeting life begins only.
_BEGIN, _END, _FLEETING, _REFERENCE = 0, 1, 2, 3


def _born():
    return F.when(F.col("kind").isin(_BEGIN, _FLEETING), 1).otherwise(0)


def _alive():
    return F.when(F.col("kind") == _BEGIN, 1).when(F.col("kind") == _END, -1).otherwise(0)


def _by_key(rows: DataFrame) -> DataFrame:
    """Repeated references are merged and all swept where the key's rows already are."""
    once = rows.repartition("key").distinct()
    every = Window.partitionBy("key")
    sweep = every.orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return once.select(
        "record_id", "endpoint", "t", "kind",
        F.sum(_born()).over(every).alias("lives"), F.sum(_born()).over(sweep).alias("born"), F.sum(_alive()).over(sweep).alias("alive"),
    )


def _by_time(rows: DataFrame) -> DataFrame:
    """As :func:`_by_key`, for keys of any number of rows."""
    order = [F.col("t").asc_nulls_first(), F.col("kind"), F.col("record_id"), F.col("endpoint")]
    swept = running_sums(rows.distinct(), "key", order, {"born": _born(), "alive": _alive()}, totals=("born",))
    return swept.select("record_id", "endpoint", "t", "kind", F.col("total_born").alias("lives"), "born", "alive")


def orphan_report(orphans: DataFrame, *, table: str, seen_at: str) -> DataFrame:
    """Counts of dangling references by table, endpoint, month (``YYYY-MM``, null if unseen) and cause."""
    return orphans.groupBy(
        F.lit(table).alias("table_name"), "endpoint", F.substring(col(seen_at).cast("string"), 1, 7).alias("month_seen"), "cause"
    ).agg(F.count("*").alias("n_orphans"))
