"""Files as frames: Parquet and CSV, local, on object stores, or one file over HTTP."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.parse
import urllib.request
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from weftline.columns import col, shared_folder
from weftline.errors import ColumnNotFoundError, ComputeError
from weftline.frames import CONNECTORS, EdgeFrame, MaterializedFrame, NodeFrame, store_path
from weftline.sources.memory import session
from weftline.topology import canonical_id

__all__ = ["Scan", "scan_edges", "scan_nodes", "read_edges", "read_nodes"]

# Options for stores, and the Hadoop settings that they become.
_OPTIONS = {
    "s3a": {
        "aws_access_key_id": "fs.s3a.access.key",
        "aws_secret_access_key": "fs.s3a.secret.key",
        "aws_session_token": "fs.s3a.session.token",
        "aws_endpoint": "fs.s3a.endpoint",
        "aws_region": "fs.s3a.endpoint.region",
    },
    "gs": {"google_service_account": "fs.gs.auth.service.account.json.keyfile"},
    "abfss": {"azure_storage_account_key": "fs.azure.account.key", "azure_storage_sas_token": "fs.azure.sas.fixed.token"},
}


def _format(path: str) -> str:
    name = urllib.parse.urlsplit(path).path if "://" in path else path
    for kind in ("parquet", "csv"):
        if name.lower().rstrip("/").endswith("." + kind):
            return kind
    raise NotImplementedError(f"a scan reads .parquet and .csv files, not {path!r}")


@dataclass
class Scan:
    """Where files are and how to reach them. Nothing is read before a frame is collected."""

    paths: list[str]
    storage_options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        kinds = {_format(p) for p in self.paths}
        if len(kinds) > 1:
            raise NotImplementedError("all files of a scan have one format")
        self.kind = kinds.pop()
        for p in self.paths:
            self._located(p, check_only=True)

    def _located(self, path: str, check_only: bool = False) -> str:
        parts = urllib.parse.urlsplit(path)
        if "://" not in path:
            return path
        if parts.scheme in ("http", "https"):
            if parts.query:
                raise NotImplementedError("an http(s) URL with a query string is not supported: use an object store for signed access")
            if any(c in parts.path for c in "*?["):
                raise NotImplementedError("http(s) URLs have no wildcards")
            return path if check_only else _fetched(path)
        if parts.scheme not in CONNECTORS:
            raise NotImplementedError(f"unsupported URL scheme {parts.scheme!r}; known are {', '.join([*CONNECTORS, 'http', 'https'])}")
        connector = CONNECTORS[parts.scheme]
        known = _OPTIONS.get(connector, {})
        for name in self.storage_options:
            if name not in known and not name.startswith("fs."):
                raise ComputeError(f"unknown storage option {name!r} for {parts.scheme}://; known are {sorted(known)} and Hadoop's fs.* settings")
        return store_path(path)

    def frame(self) -> DataFrame:
        spark = session()
        located = [self._located(p) for p in self.paths]
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for connector, known in _OPTIONS.items():
            if any(p.startswith(connector + ":") for p in located):
                for name, value in self.storage_options.items():
                    hadoop.set(known.get(name, name), value)
        reader = spark.read
        return reader.parquet(*located) if self.kind == "parquet" else reader.csv(located, header=True, inferSchema=True)

    def _checked(self, names: list[str]) -> DataFrame:
        df = self.frame()
        for name in names:
            if name not in df.columns:
                raise ColumnNotFoundError(f"column not found: {name!r} in {self.paths[0]}; the columns are {df.columns}")
        if df.isEmpty():  # one row of one file
            raise ComputeError(f"no rows in {self.paths[0]}")
        for name in names:
            df = df.withColumn(name, canonical_id(df, name))
        return df.select(*[col(c) for c in df.columns])

    def edges(self, src: str, dst: str) -> DataFrame:
        return self._checked([src, dst])

    def nodes(self, name: str) -> DataFrame:
        return self._checked([name])


def _fetched(url: str) -> str:
    """One file over HTTP, brought by the driver to the session's shared folder, which all tasks can read."""
    spark = session()
    name = hashlib.sha256(url.encode()).hexdigest()[:16] + "-" + os.path.basename(urllib.parse.urlsplit(url).path)
    with tempfile.TemporaryDirectory(prefix="weftline-http-") as folder:
        local = os.path.join(folder, name)
        try:
            with urllib.request.urlopen(url, timeout=60) as response, open(local, "wb") as out:
                while block := response.read(1 << 20):
                    out.write(block)
        except OSError as e:
            raise ComputeError(f"could not read {url}: {e}") from e
        path = spark._jvm.org.apache.hadoop.fs.Path
        target = path(shared_folder(spark) + "/http/" + name)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(path(local), target)
    return target.toString()


def _scan(path: Any, storage_options: dict[str, str] | None, store: Any, format_opts: dict[str, Any]) -> Scan:
    if format_opts:
        raise NotImplementedError(f"format options are not supported: {sorted(format_opts)}")
    if store is not None:
        raise NotImplementedError("store= is not supported: give storage_options")
    return Scan([path] if isinstance(path, str) else [str(p) for p in path] if isinstance(path, (list, tuple)) else [str(path)], dict(storage_options or {}))


def scan_edges(path: str | list[str], *, src: str, dst: str, storage_options: dict[str, str] | None = None, store: Any = None, on_null: str = "error", **format_opts: Any) -> EdgeFrame:
    """A lazy edge frame over files; filters and columns reach the Parquet reader."""
    if on_null not in ("error", "drop"):
        raise ValueError(f"on_null is 'error' or 'drop', not {on_null!r}")
    return EdgeFrame._scanned(_scan(path, storage_options, store, format_opts), src=src, dst=dst, on_null=on_null)


def scan_nodes(path: str | list[str], *, id: str, storage_options: dict[str, str] | None = None, store: Any = None, **format_opts: Any) -> NodeFrame:  # noqa: A002
    return NodeFrame._scanned(_scan(path, storage_options, store, format_opts), id=id)


def read_edges(path: str | list[str], **how: Any) -> MaterializedFrame:
    return scan_edges(path, **how).collect()


def read_nodes(path: str | list[str], **how: Any) -> MaterializedFrame:
    return scan_nodes(path, **how).collect()
