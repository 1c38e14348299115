"""Tables in versions: data folders that never change, and small files that say which of them are the table.

A commit first writes its data to a folder of its own, then creates the file of the next version.
Creating a file that must not exist yet is the one atomic step, so a reader sees the
table before or after a commit, never between, and a job that dies leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class _Files:
    """The file system of a path, whatever store Spark reaches it through."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        at = self._path(name)
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if someone else has made it meanwhile."""
        whole = self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(whole, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        at = self._path(name)
        self.fs.mkdirs(at.getParent())
        if not self.fs.exists(at) and self.fs.rename(whole, at):
            return True
        self.fs.delete(whole, False)
        return False


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _Files(spark, path).names("versions") if n.endswith(".json") and not n.startswith(".")]


def _state(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    known = versions(spark, path)
    version = version if version is not None else max(known, default=0)
    if version == 0:
        return 0, {"schema": None, "partition_by": [], "parts": {}}
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    return version, json.loads(_Files(spark, path).read(f"versions/{version:010d}.json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest version, or an older one."""
    number, state = _state(spark, path, version)
    if not number:
        raise ValueError(f"{path} holds no table")
    schema = StructType.fromJson(state["schema"])
    folders: dict[str, list[str]] = {}
    for part, folder in state["parts"].items():
        folders.setdefault(folder, []).append(part)
    frames = []
    for folder, parts in sorted(folders.items()):
        base = f"{path.rstrip('/')}/data/{folder}"
        frames.append(spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" if p else base for p in sorted(parts)]))
    out = spark.createDataFrame([], schema)
    for frame in frames:
        out = out.unionByName(frame.select(*schema.names))
    return out


def _parts(files: _Files, folder: str, depth: int) -> list[str]:
    """The partition folders that Spark's writer made below ``folder``."""
    if not depth:
        return [""]
    return [f"{name}/{rest}".rstrip("/") for name in files.names(folder) if "=" in name for rest in _parts(files, f"{folder}/{name}", depth - 1)]


def commit(df: DataFrame, path: str, partition_by: Sequence[str] = (), check: Callable[[DataFrame], None] | None = None,
           whole: bool = False) -> int:
    """Make ``df`` the content of its partitions (``whole``: of the table) and return the new version.

    ``check`` gets the written batch before it counts and may raise. Other partitions stay. If another
    commit comes first, this one is put on top of it.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    target = f"{path.rstrip('/')}/data/{folder}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(target)
    batch = spark.read.schema(df.schema).parquet(target)
    if check is not None:
        check(batch)
    files = _Files(spark, path)
    fresh = {part: folder for part in _parts(files, f"data/{folder}", len(partition_by))}
    while True:
        number, state = _state(spark, path)
        if number and state["partition_by"] != list(partition_by):
            raise ValueError(f"{path} is partitioned by {state['partition_by']}")
        parts = fresh if whole or not partition_by else {**state["parts"], **fresh}
        text = json.dumps({"schema": df.schema.jsonValue(), "partition_by": list(partition_by), "parts": parts})
        if files.create(f"versions/{number + 1:010d}.json", text):
            return number + 1
