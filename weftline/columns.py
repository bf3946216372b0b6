"""Small helpers on column names and sessions that every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shipping import ship

__all__ = ["col", "fresh", "require", "checkpoint", "discard", "stored", "shared_folder"]


def col(name: str) -> Column:
    """A column by its exact name: dots, blanks and backticks in it are not syntax."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for internal columns that clash with none of ``taken`` (compared without case)."""
    used = {c.lower() for c in taken}
    out = []
    for base in wanted:
        name, k = f"__{base}", 0
        while name.lower() in used:
            k += 1
            name = f"__{base}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def require(df: DataFrame, *names: str) -> None:
    from weftline.errors import ColumnNotFoundError

    for name in names:
        if name not in df.columns:
            raise ColumnNotFoundError(f"column not found: {name!r}; the columns are {df.columns}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets one of its own.

    A session with executors on other machines has to name one: they could not read a folder of the driver's machine.
    """
    ship(spark)
    sc = spark.sparkContext
    if not (known := sc._jsc.sc().getCheckpointDir()).isEmpty():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame, *superseded: DataFrame | None) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder, so that executors can be lost later.

    What it was made from and nothing else needs, ``superseded``, is deleted from there.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    discard(*superseded)
    return out


def discard(*checkpoints: DataFrame | None) -> None:
    """Delete checkpoints that no frame in use is made from."""
    for df in checkpoints:
        plan = df._jdf.queryExecution().logical() if df is not None else None
        if plan is None or plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if not file.isEmpty():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`checkpoint`, as a Parquet table of the shared folder: what is read of it later is the columns needed only."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
